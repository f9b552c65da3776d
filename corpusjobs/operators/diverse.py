"""Diverse samples: greedy farthest points, exactly in one group or as a core-set over many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import draw
from .pairing import shingles


def farthest(sets: list[set], n: int, start: int = 0) -> list[int]:
    """n positions: start, then ever the one whose best similarity to any chosen one is smallest (ties: the first)."""
    if n >= len(sets):
        return list(range(len(sets)))
    best, out = np.full(len(sets), -1.0), []
    at = start
    while True:
        out.append(at)
        if len(out) == n:
            return out
        for i, s in enumerate(sets):
            both = len(sets[at] | s)
            best[i] = max(best[i], len(sets[at] & s) / both if both else 1.0)
        best[out] = np.inf
        at = int(best.argmin())


def select_diverse(seeds: DataFrame, n: int, seed: int, k: int = 3, id_col: str = "id", content: str = "content", group: int = 2000) -> DataFrame:
    """Ids of n seeds that are unlike each other (all where there are not more).

    Seeds are dealt by a hash into groups of about `group`; each group gives its own n farthest points, and the
    same rule picks n of those of all groups (a composable core-set, Indyk et al. 2014). With one group this is
    the exact greedy choice from a drawn start. Groups and the last step are bounded by group and groups x n; the
    merge goes on in rounds while more than `group` candidates are left and rounds still shrink them.
    """
    rows = seeds.select(F.col(id_col).alias("id"), F.transform(shingles(F.coalesce(F.col(content), F.lit("")), k), lambda s: F.xxhash64(s)).alias("s"), draw(seed, F.col(id_col)).alias("d"))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["d", "id"]).reset_index(drop=True)
        return frame.loc[farthest([set(x) for x in frame["s"]], n), ["id", "s", "d"]]

    kind = f"id {rows.schema['id'].dataType.simpleString()}, s array<bigint>, d string"
    left = rows.count()
    while left > group:
        groups = -(-left // max(group, 2 * n))
        if groups == 1:
            break
        dealt = rows.withColumn("g", F.pmod(F.xxhash64("d", F.lit(groups)), F.lit(groups)))
        rows, left = dealt.groupBy("g").applyInPandas(lambda f: pick(f), kind), min(left, groups * n)
    return rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda f: pick(f), kind).select("id")
