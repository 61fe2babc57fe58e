"""What a feed, a benchmark and a rating are, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EventSpec:
    """Columns and vocabulary of an ordered event log."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    event: str
    team: str
    player: str
    sides: tuple[str, str]
    start: str
    receive: str
    terminal: tuple[str, ...]
    direct: str
    known: tuple[str, ...]


@dataclass(frozen=True)
class Benchmark:
    """A metric is met at threshold or above, or at threshold or below."""

    metric: str
    threshold: float
    higher: bool = True
    label: str = ""
    phase: str = ""

    @property
    def flag(self) -> str:
        return f"b_{self.metric}"


@dataclass(frozen=True)
class EloConfig:
    """Fixed values of the rating: mean 1500, scale 400, and the damping constants 2.2 and 0.001.

    margin: whether a win's size counts; margin_column: where it is.
    """

    k: float = 60.0
    home: float = 50.0
    carryover: float = 0.95
    margin: bool = True
    margin_column: str = "margin"
    mean: float = 1500.0
    scale: float = 400.0
    damping: tuple[float, float] = field(default=(2.2, 0.001))
