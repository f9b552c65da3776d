"""Best-fit packing of documents into sequences under several capacities at once.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).
Pieces are packed largest first; among the open sequences that can take a piece under every capacity, the
one with the largest weighted dot product of what is left with what is asked, or the one with the smallest
weighted norm of what would be left, takes it.

Pieces are dealt evenly into groups of bounded size, which Spark packs apart from each other; sequences that
a group leaves open are dealt again, many groups together, and packed whole. Only ids and lengths move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, cut
from .tokens import WORD_BPE, encoder

#: Tokens of a sequence; the id that ends a document; pieces of a group.
CAPACITY, END, GROUP = 4096, 1, 4096
#: Chunks of text that a worker remembers: some 80 MB, which stay with it while other jobs run.
REMEMBERED = 1 << 19


def best_fit(items: np.ndarray, capacity: np.ndarray, rule: str = "norm", weights: np.ndarray | None = None) -> np.ndarray:
    """The bin of each item. items: n x d demands; capacity: d. Every item must fit an empty bin.

    Bins open one at a time, when no open bin can take an item under every constraint. rule: "norm" picks the
    bin that leaves the smallest weighted residual norm, "dot" the one with the largest weighted dot product;
    the first opened wins ties. A bin with no room in some dimension is closed.
    """
    n, d = items.shape
    if n == 0:
        return np.zeros(0, np.int64)
    need = items / capacity
    if (need > 1).any():
        raise ValueError("an item exceeds the capacity of an empty bin")
    w = np.ones(d) if weights is None else np.asarray(weights, float)
    least = items.min(axis=0)
    order = np.lexsort((np.arange(n), *(-items[:, j] for j in range(d - 1, -1, -1))))
    out = np.empty(n, np.int64)
    left = np.empty((min(n, 64), d))  # of open bins
    names = np.empty(len(left), np.int64)
    count = opened = 0
    for i in order:
        x = items[i]
        fits = (left[:count] >= x).all(axis=1).nonzero()[0]
        if len(fits):
            rest = left[fits] / capacity
            score = (w * need[i] * rest).sum(axis=1) if rule == "dot" else -(w * (rest - need[i]) ** 2).sum(axis=1)
            at = fits[score.argmax()]
        else:
            if count == len(left):
                left, names = np.concatenate((left, np.empty_like(left))), np.concatenate((names, np.empty_like(names)))
            at = count
            left[at], names[at] = capacity, opened
            count, opened = count + 1, opened + 1
        out[i] = names[at]
        left[at] -= x
        if (left[at] < least).any():
            count -= 1
            left[at], names[at] = left[count], names[count]
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document; a document has one or more."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, REMEMBERED)
        for batch in by_bytes(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, groups: int, capacity: int = CAPACITY, most_docs: int | None = None, most_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.25, 0.25), merge: int = 64) -> DataFrame:
    """items with sequence_id and offset. items has doc_id, piece and length (at most `capacity`).

    groups: how many groups the pieces are dealt into. The `merge` emptiest sequences of a group are packed again,
    as whole items, with those of `merge` groups; this bounds a lot at merge squared and leaves no piece out.
    Repeated rows spread over the groups. The defaults for documents and cost never bind.
    """
    caps = np.array([capacity, most_docs or capacity, most_cost or capacity * capacity], float)
    columns = items.columns

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["length"].to_numpy(np.float64)
        full = n == capacity
        frame = frame.reset_index(drop=True)
        frame["bin"] = np.arange(len(frame)) + len(frame)
        frame.loc[~full, "bin"] = best_fit(np.stack([n, np.ones(len(n)), n * n], axis=1)[~full], caps, rule, np.array(weights))
        frame = frame.sort_values(["bin", "length", "doc_id", "piece"], ascending=[True, False, True, True])
        frame["place"] = frame.groupby("bin")["length"].cumsum() - frame["length"]
        return frame

    def second(frame: pd.DataFrame) -> pd.DataFrame:
        bins = best_fit(frame[["length", "docs", "cost"]].to_numpy(np.float64), caps, rule, np.array(weights))
        frame = frame.reset_index(drop=True)
        frame["to_grp"], frame["to_bin"] = frame["grp"].min(), bins
        frame = frame.sort_values(["to_bin", "length", "grp", "bin"], ascending=[True, False, True, True])
        frame["shift"] = frame.groupby("to_bin")["length"].cumsum() - frame["length"]
        return frame[["grp", "bin", "to_grp", "to_bin", "shift"]]

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    local = dealt.groupBy("grp").applyInPandas(lambda f: first(f)[[*columns, "grp", "bin", "place"]], f"{kinds}, grp int, bin long, place long")
    if groups > 1:
        local = cut(local)
        bins = local.groupBy("grp", "bin").agg(F.sum("length").alias("length"), F.count("*").cast("double").alias("docs"), F.sum(F.col("length").cast("double") * F.col("length")).alias("cost"))
        emptiest = F.row_number().over(W.partitionBy("grp").orderBy("length", "bin"))
        loose = bins.filter(F.col("length") < capacity * 15 // 16).withColumn("nth", emptiest).filter(F.col("nth") <= merge).withColumn("lot", F.floor(F.col("grp") / merge))
        moved = loose.groupBy("lot").applyInPandas(second, "grp int, bin long, to_grp int, to_bin long, shift long")
        local = local.join(moved, ["grp", "bin"], "left")
        sequence = F.when(F.col("to_bin").isNull(), F.col("grp").cast("long") * (1 << 32) + F.col("bin")).otherwise(F.col("to_grp").cast("long") * (1 << 32) + (1 << 31) + F.col("to_bin"))
        place = F.col("place") + F.coalesce("shift", F.lit(0))
    else:
        sequence, place = F.col("grp").cast("long") * (1 << 32) + F.col("bin"), F.col("place")
    return local.select(*columns, sequence.alias("sequence_id"), place.alias("offset"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, capacity: int = CAPACITY, end: int = END, group: int = GROUP, **rules) -> DataFrame:
    """Every piece of every document with its sequence and its place there; see pieces() and pack().

    A null or empty text is one piece that holds the end id only. Rows with null ids and repeated rows are
    packed like any other, each on its own. An empty table gives an empty result. Columns of docs other than
    the id and the text are not read, so their names cannot clash.
    """
    groups = max(1, -(-docs.select(id_col).count() // group))
    return pack(pieces(docs, id_col, text_col, vocabulary, capacity, end), groups, capacity, **rules)
