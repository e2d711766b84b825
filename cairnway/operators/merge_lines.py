"""Merging lines end to end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def join_ends(lines: list[list[tuple]]) -> list[list[tuple]]:
    """Join lines where exactly two ends meet; a chain comes where its first line stood, running from the chain's open end.

    Every line is walked over once, so long chains cost no more than their points.
    """
    lines, ends = [list(x) for x in lines if len(x) > 1], {}
    for k, x in enumerate(lines):
        for p, side in ((x[0], 0), (x[-1], 1)):
            ends.setdefault(p, []).append((k, side))

    def beyond(k: int, side: int):
        """The line and side that meet this side of line ``k``, if just one other line does."""
        at = ends[lines[k][-1 if side else 0]]
        other = next((e for e in at if e != (k, side)), None)
        return other if len(at) == 2 and other[0] != k else None

    out, done = [], set()
    for k in range(len(lines)):
        if k in done:
            continue
        start, into = (k, 0), beyond(k, 0)  # back to the chain's beginning, or once round a ring
        while into and into[0] != k:
            start = (into[0], 1 - into[1])
            into = beyond(*start)
        if into:
            start = (k, 0)
        chain, at = [], start
        while at and at[0] not in done:
            done.add(at[0])
            part = lines[at[0]] if at[1] == 0 else lines[at[0]][::-1]
            chain += part[1:] if chain else part
            at = beyond(at[0], 1 - at[1])
        out.append(chain)
    return out


def merged(lines: DataFrame, by: str) -> DataFrame:
    """(by, ogc_fid, line) -> by, parts (how many lines are left), vertices; one group is one named feature, so small."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = join_ends([[(p["lat"], p["lon"]) for p in line] for line in rows.sort_values("ogc_fid").line])
        return pd.DataFrame({by: [key[0]], "parts": [len(out)], "vertices": [sum(map(len, out))]})

    return lines.groupBy(by).applyInPandas(fold, f"{by} long, parts int, vertices int")
