"""Thresholds of the business questions."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class QueryConfig:
    """The two years form a set, not a range: with (2022, 2025), 2023 and 2024 are out."""

    years: tuple[int, int] = (2024, 2025)
    start: str = "06:00:00"
    end: str = "23:00:00"
    min_amount: float = 75.0
    top_items: int = 1
    top_users: int = 3
    #: How equal counts rank among a store's customers: row_number, rank or dense_rank.
    ties: str = "row_number"
    #: Anonymous purchases (user 0) take a place in the ranking and are then left out.
    compat_anonymous: bool = False
    #: Facts are read from the January files alone.
    reduced: bool = False

    @classmethod
    def from_environment(cls, environment=os.environ) -> "QueryConfig":
        """Thresholds from the variables MIN_YEAR, MAX_YEAR, START_HOUR, END_HOUR, MIN_AMOUNT, TOP_ITEMS_COUNT,
        TOP_USERS_COUNT and REDUCED (true, 1, yes or on; without it, true); others as by default.

        Hours are whole hours of the day: from START_HOUR:00:00 to END_HOUR:00:00. Empty variables are as missing ones.
        """
        base = cls()
        get = lambda name, default: type(default)(environment.get(name) or default)
        years = (get("MIN_YEAR", base.years[0]), get("MAX_YEAR", base.years[1]))
        hour = lambda name, default: f"{get(name, int(default[:2])):02d}:00:00"
        reduced = get("REDUCED", "true").strip().lower() in ("true", "1", "yes", "on")
        return cls(years, hour("START_HOUR", base.start), hour("END_HOUR", base.end), get("MIN_AMOUNT", base.min_amount), get("TOP_ITEMS_COUNT", base.top_items), get("TOP_USERS_COUNT", base.top_users), reduced=reduced)
