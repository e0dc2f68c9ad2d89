"""What a physical plan does: for tests that hold plans to their shape."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(frame: DataFrame) -> int:
    """Shuffles in the plan, broadcasts not counted."""
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single|RoundRobin)", plan_text(frame)))


def runs_python(frame: DataFrame) -> bool:
    return bool(re.search(r"Python|Pandas|MapInArrow", plan_text(frame)))


def pushed_filters(frame: DataFrame) -> list[str]:
    return [x for group in re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(frame)) for x in group.split(", ") if x]


def read_columns(frame: DataFrame) -> set[str]:
    return {c.split(":")[0] for group in re.findall(r"ReadSchema: struct<([^\n]*?)>(?:\n|$|,? ?\[)", plan_text(frame)) for c in re.split(r",(?![^<]*>)", group)}
