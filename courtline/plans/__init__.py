"""Views of the given tables and the registered queries over them."""

from . import contest_queries, feed_queries, landing_queries, match_queries, model_queries, player_queries, text_queries, tournament_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
