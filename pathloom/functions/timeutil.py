"""Calendar arithmetic on textual periods, and windows relative to a graph time."""

from __future__ import annotations

import calendar
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pathloom.naming import window_name

UNITS = ("day", "month", "year")
#: Strptime directives and their Spark patterns.
SPARK_PATTERNS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%p": "a", "%f": "SSSSSS"}
AGG_FUNCS = ("count_*", "count", "mean", "sum", "max", "min", "first")


def spark_pattern(fmt: str) -> str:
    """Spark's datetime pattern for a strptime format; unknown directives raise."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i : i + 2] not in SPARK_PATTERNS:
                raise ValueError(f"no pattern for {fmt[i:i + 2]}")
            out += SPARK_PATTERNS[fmt[i : i + 2]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def parse(values: Sequence[str], formats: Sequence[str]) -> datetime:
    return datetime.strptime("\x1f".join(values), "\x1f".join(formats))


def render(when: datetime, formats: Sequence[str]) -> tuple[str, ...]:
    return tuple(when.strftime(f) for f in formats)


def reformat(values: Sequence[str], source: Sequence[str], target: Sequence[str]) -> tuple[str, ...]:
    return render(parse(values, source), target)


def shift(when: datetime, n: int, unit: str) -> datetime:
    """``n`` calendar units later; a day that the month lacks becomes its last."""
    if unit == "day":
        return when + timedelta(days=n)
    if unit not in UNITS:
        raise ValueError(f"unknown time unit {unit}")
    months = when.year * 12 + when.month - 1 + n * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    return when.replace(year=year, month=month + 1, day=min(when.day, calendar.monthrange(year, month + 1)[1]))


@dataclass(frozen=True)
class TimeWindow:
    """Periods start to start + length - 1, counted in ``unit`` from the graph time."""

    start: int
    length: int
    unit: str

    def __post_init__(self):
        if self.unit not in UNITS:
            raise ValueError(f"unknown time unit {self.unit}")
        if self.length < 1:
            raise ValueError("a window has a period at least")

    @property
    def name(self) -> str:
        return window_name(self.start, self.length, self.unit)


@dataclass(frozen=True)
class WindowGroup:
    """Windows that are aggregated by the same functions."""

    funcs: tuple[str, ...]
    windows: tuple[TimeWindow, ...]

    def __post_init__(self):
        for f in self.funcs:
            if f not in AGG_FUNCS:
                raise ValueError(f"unknown aggregate {f}")

    def aggregates(self, features: Sequence[str]) -> list[tuple[str, str | None, str]]:
        """(function, feature, name) in the order of the output."""
        out: list[tuple[str, str | None, str]] = []
        for f in self.funcs:
            out += [("count", None, "count_all")] if f == "count_*" else [(f, x, f"{f}_{x}") for x in features]
        return out

    def columns(self, features: Sequence[str]) -> list[str]:
        return [f"{w.name}_{name}" for w in self.windows for _, _, name in self.aggregates(features)]


def window_groups(configs: Iterable[dict]) -> tuple[WindowGroup, ...]:
    """Groups from configs of start_times_range, time_interval_len, time_unit and agg_funcs; equal function lists are merged."""
    merged: dict[tuple[str, ...], list[TimeWindow]] = {}
    for c in configs:
        own = merged.setdefault(tuple(c.get("agg_funcs", ["first"])), [])
        own += [TimeWindow(s, c["time_interval_len"], c["time_unit"]) for s in range(*c["start_times_range"])]
    return tuple(WindowGroup(f, tuple(w)) for f, w in merged.items())


def time_map(targets: Iterable[Sequence[str]], target_formats: Sequence[str], source_formats: Sequence[str], windows: Sequence[TimeWindow]) -> list[tuple[tuple[str, ...], tuple[str, ...], int]]:
    """(source time, graph time, number of the window): each source period that lies in a window of a graph time, once."""
    out = {}
    for t in targets:
        when = parse(t, target_formats)
        for k, w in enumerate(windows):
            for i in range(w.start, w.start + w.length):
                try:
                    moved = shift(when, i, w.unit)
                except (ValueError, OverflowError):
                    continue  # before year 1
                out[render(moved, source_formats), tuple(t), k] = None
    return list(out)
