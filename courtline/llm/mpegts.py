"""Media columns as MPEG transport streams.

A payload of 8-bit samples is carried by one elementary stream: PES packets with presentation
times, cut into transport packets of 188 bytes with continuity counters, preceded at every random
access point by the program tables. Reading parses the tables, checks their CRC and the counters,
reassembles the PES packets and gives the samples, the times and the random access points.

The query writes the table of streams, with their times and access points, to the shared folder,
reads it again and takes everything from the stored bytes; a stream with a gap in its counters or
times, or with other times than those stored beside it, is an error.

Null and empty texts are 64 bytes 0. Texts are never cut. Equal texts give equal streams; repeated
rows are rows of their own. An empty table gives an empty result. Only doc_id and text are read;
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import in_slices
from .common import in_tasks, saved

# Fixed values of ISO/IEC 13818-1
PACKET = 188
SYNC = 0x47
PAT_PID = 0
PRIVATE_DATA = 0x06
AUDIO_STREAM_ID = 0xC0
CLOCK = 90_000
MASK = (1 << 33) - 1

PMT_PID, SAMPLES_PID, PROGRAM = 0x1000, 0x0100, 1
SAMPLE_RATE = 8_000
#: A PES packet fills 16 transport packets: 162 samples in the first, after its adaptation field and PES header, 184 in the others.
PES_PACKETS, FIRST, OTHER = 16, 162, 184
PES_SAMPLES = FIRST + (PES_PACKETS - 1) * OTHER
#: PES packets from one random access point to the next.
ACCESS_EVERY = 8
UNIT = 64


class Broken(ValueError):
    """A stream that is not whole."""


@lru_cache(maxsize=1024)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def table_packet(pid: int, table_id: int, number: int, body: bytes) -> np.ndarray:
    """A program table section in one transport packet, with counter 0."""
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2) + number.to_bytes(2) + b"\xc1\x00\x00" + body
    section += crc32_mpeg(section).to_bytes(4)
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), dtype=np.uint8)


@lru_cache(maxsize=1)
def tables() -> np.ndarray:
    pat = table_packet(PAT_PID, 0, 1, PROGRAM.to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2))
    pmt = table_packet(PMT_PID, 2, PROGRAM, (0xE000 | SAMPLES_PID).to_bytes(2) + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | SAMPLES_PID).to_bytes(2) + b"\xf0\x00")
    return np.stack([pat, pmt])


def stamped(times: np.ndarray) -> np.ndarray:
    """PTS fields of 5 bytes."""
    t = times.astype(np.int64)
    return np.stack([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 0x01 | (t >> 14) & 0xFE, t >> 7 & 0xFF, 0x01 | (t << 1) & 0xFE], axis=1).astype(np.uint8)


def stream_times(n: int) -> np.ndarray:
    """The presentation times of n PES packets."""
    return np.arange(n) * PES_SAMPLES * CLOCK // SAMPLE_RATE & MASK


def multiplex(samples: bytes) -> bytes:
    """The transport stream of samples (at least one)."""
    n = -(-len(samples) // PES_SAMPLES)
    data = np.zeros(n * PES_SAMPLES, dtype=np.uint8)
    data[: len(samples)] = np.frombuffer(samples, dtype=np.uint8)
    data = data.reshape(n, PES_SAMPLES)
    numbers = np.arange(n)
    times = stream_times(n)
    out = np.zeros((n, PES_PACKETS, PACKET), dtype=np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, SAMPLES_PID >> 8, SAMPLES_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10 | np.arange(PES_PACKETS) & 15  # 16 packets: every PES packet begins with counter 0
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = 7
    out[:, 0, 5] = np.where(numbers % ACCESS_EVERY == 0, 0x50, 0x10)
    out[:, 0, 6:10] = (times >> 1).astype(">u4").view(np.uint8).reshape(n, 4)
    out[:, 0, 10] = (times & 1) << 7 | 0x7E
    out[:, 0, 12:26] = [0, 0, 1, AUDIO_STREAM_ID, *(PES_SAMPLES + 8).to_bytes(2), 0x80, 0x80, 5, 0, 0, 0, 0, 0]
    out[:, 0, 21:26] = stamped(times)
    out[:, 0, 26:] = data[:, :FIRST]
    out[:, 1:, 4:] = data[:, FIRST:].reshape(n, PES_PACKETS - 1, OTHER)
    left = len(samples) - (n - 1) * PES_SAMPLES
    packets = out.reshape(-1, PACKET)
    if left < PES_SAMPLES:
        packets = shortened(packets, data[-1], left)
    parts = []
    for k, start in enumerate(range(0, len(packets), PES_PACKETS * ACCESS_EVERY)):
        both = tables().copy()
        both[:, 3] |= k & 15
        parts += [both, packets[start : start + PES_PACKETS * ACCESS_EVERY]]
    return np.concatenate(parts).tobytes()


def shortened(packets: np.ndarray, data: np.ndarray, left: int) -> np.ndarray:
    """The packets with only left samples in the last PES packet; stuffing fills its last transport packet."""
    more = -(-max(0, left - FIRST) // OTHER)
    packets = packets[: len(packets) - PES_PACKETS + 1 + more]
    first = packets[len(packets) - 1 - more]
    first[16:18] = list((left + 8).to_bytes(2))
    if more:
        tail, kept, head = packets[-1], left - FIRST - (more - 1) * OTHER, 4
    else:
        tail, kept, head = first, left, 12
    stuffing = (OTHER if more else FIRST) - kept
    if stuffing:
        body = (first[12:26].tobytes() if not more else b"") + data[left - kept : left].tobytes()
        if more:
            tail[3] |= 0x20
            tail[4] = stuffing - 1
            if stuffing > 1:
                tail[5] = 0
                tail[6 : 4 + stuffing] = 0xFF
        else:
            tail[4] = 7 + stuffing
            tail[head : head + stuffing] = 0xFF
        tail[PACKET - len(body) :] = np.frombuffer(body, dtype=np.uint8)
    return packets


def section_of(packet: bytes, table_id: int) -> bytes:
    """The body of the table section in a packet, after its CRC has been checked."""
    start = 5 + packet[4]
    length = int.from_bytes(packet[start + 1 : start + 3]) & 0xFFF
    section = packet[start : start + 3 + length]
    if section[0] != table_id or crc32_mpeg(section):
        raise Broken("a program table is damaged")
    return section[8:-4]


def demultiplex(stream: bytes) -> dict:
    """samples, pts (of each PES packet), access (numbers of the PES packets at random access points), pids, packets, errors (gaps in counters and times)."""
    if not stream or len(stream) % PACKET:
        raise Broken("not whole packets")
    packets = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise Broken("a packet without its sync byte")
    pids = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    maps = [section_of(p.tobytes(), 0) for p in packets[pids == PAT_PID]]
    if not maps:
        raise Broken("no program association table")
    map_pid = int.from_bytes(maps[0][2:4]) & 0x1FFF
    programs = [section_of(p.tobytes(), 2) for p in packets[pids == map_pid]]
    if not programs:
        raise Broken("no program map table")
    start = 4 + (int.from_bytes(programs[0][2:4]) & 0xFFF)
    kind, pid = programs[0][start], int.from_bytes(programs[0][start + 1 : start + 3]) & 0x1FFF
    errors = 0
    for p in (PAT_PID, map_pid, pid):
        counters = packets[pids == p, 3].astype(np.int64) & 15
        errors += int(((np.diff(counters) & 15) != 1).sum())
    own = packets[pids == pid]
    adapted = own[:, 3] & 0x20 != 0
    offsets = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    begins = own[:, 1] & 0x40 != 0
    access = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)
    data = own[np.arange(PACKET) >= offsets[:, None]].tobytes()
    ends = np.cumsum(PACKET - offsets)
    starts = (ends - (PACKET - offsets))[begins].tolist()
    samples, pts = [], []
    for at, until in zip(starts, [*starts[1:], len(data)], strict=True):
        if data[at : at + 3] != b"\x00\x00\x01" or int.from_bytes(data[at + 4 : at + 6]) != until - at - 6:
            raise Broken("a PES packet is not whole")
        t = data[at + 9 : at + 14]
        pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        samples.append(data[at + 9 + data[at + 8] : until])
    played = np.concatenate([[0], np.cumsum([len(x) for x in samples])])[:-1]  # losses of whole turns of the counter show in the times only
    errors += int((np.array(pts, dtype=np.int64) - pts[0] & MASK != played * CLOCK // SAMPLE_RATE & MASK).sum()) if pts else 0
    return {"samples": b"".join(samples), "pts": pts, "access": np.flatnonzero(access[begins]).tolist(), "program_pid": map_pid, "pid": pid, "kind": kind, "packets": len(packets), "errors": errors}


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes and bytes 0 up to a positive multiple of unit."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


MEDIA = "doc_id long, n_bytes long, media binary, pts array<long>, access array<int>"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_media(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, media (the stream), pts, access (numbers of the PES packets at random access points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            payloads = [padded(t) for t in texts]
            n = [-(-len(p) // PES_SAMPLES) for p in payloads]
            columns = [pa.array(map(len, texts), pa.int64()), pa.array(map(multiplex, payloads), pa.binary()), pa.array(map(stream_times, n), pa.list_(pa.int64())), pa.array([np.arange(0, k, ACCESS_EVERY) for k in n], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "media", "pts", "access"])

    return in_tasks(docs.select("doc_id", "text"), run, MEDIA)


def feature(read: dict) -> str:
    return f"program={read['program_pid']};stream={read['pid']}/{read['kind']};packets={read['packets']};pes={len(read['pts'])};pts={read['pts'][0]}-{read['pts'][-1]};access={len(read['access'])};errors={read['errors']}"


def digests(media: DataFrame) -> DataFrame:
    """Per stored stream: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in in_slices(batches, "media"):
            rows = []
            for doc_id, n_bytes, stream, pts, access in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "pts", "access")), strict=True):
                read = demultiplex(stream)
                if read["errors"] or read["pts"] != pts or read["access"] != access:
                    raise Broken(f"the stream of document {doc_id} is not as stored")
                samples = read["samples"]
                rows.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(read)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return in_tasks(media, run, DIGESTS)


def media_digests(docs: DataFrame) -> DataFrame:
    """The digests of the streams of docs, from the table of streams written to the shared folder and read again."""
    return digests(saved(with_media(docs), "media"))
