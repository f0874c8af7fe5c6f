"""Dry runs: what an extraction would do, as JSON, without doing it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Extraction:
    """Settings of an extraction; checked when made."""

    start: str
    end: str
    tiles: tuple[str, ...]
    scale: int = 10
    mode: str = "historical"

    def __post_init__(self) -> None:
        if self.start > self.end or self.scale <= 0 or self.mode not in ("historical", "full"):
            raise ValueError(f"no such extraction: {self}")
        if not self.tiles:
            raise ValueError("no tile")


def months(start: str, end: str) -> list[str]:
    y, m = map(int, start.split("-"))
    out = []
    while (label := f"{y:04d}-{m:02d}") <= end:
        out.append(label)
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out


def plan(config: Extraction, selectors: list[str], df: DataFrame | None = None) -> str:
    """JSON of the settings, the tasks (tile by month, tiles once each) and, for a frame, its schema and physical plan."""
    tiles = list(dict.fromkeys(config.tiles))
    tasks = [f"{t}_{config.scale}m_{m}-01" for m in months(config.start, config.end) for t in tiles]
    out: dict = {"settings": asdict(config), "selectors": selectors, "tasks": tasks, "submitted": False}
    if df is not None:
        out |= {"schema": df.schema.simpleString(), "plan": df._jdf.queryExecution().executedPlan().toString()}
    return json.dumps(out, indent=2, sort_keys=True)
