"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive words of a benchmark item; an item of fewer words is one pattern. The
patterns of one length are searched together: the last block of two words under the search window gives a
shift; a shift above zero skips positions where no pattern can end, a shift of zero selects the bucket of
patterns that end with that block, and their words are compared directly.

Words are numbers, and the tables sorted arrays of them. They are small for any usual benchmark and are sent to the tasks;
a larger benchmark is dealt out by its windows into rounds with bounded tables, whose findings are merged for each row of
the documents.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, free_name, removed, stored

WINDOW, BLOCK = 13, 2
#: Bytes of benchmark words whose tables one round sends to the tasks: tables take about seven times as much.
ROUND_BYTES = 8 << 20
#: Of a round's bytes one word of an item's part is taken for so many.
PART_BYTES = 64
#: Words: letters a-z (after lower-casing A-Z), digits and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


class Patterns:
    """Wu-Manber tables of patterns of one length: stretches of word ids in `flat`, every run of `length` ids in one a pattern of its owner.

    All tables are sorted arrays of numbers: blocks with their shifts, and patterns by the hash of their last block and of all
    of them, which names the bucket.
    """

    def __init__(self, length: int, flat: np.ndarray, first: np.ndarray, size: np.ndarray, owner: np.ndarray):
        self.length, self.block, self.flat = length, min(BLOCK, length), flat
        self.most = length - self.block + 1  # the shift of a block that no pattern has
        n = size - self.block + 1  # blocks of each stretch
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # A block is at most so far from the end of the pattern that begins with its stretch, or ends one itself.
        shift = np.maximum(self.most - 1 - place, 0).astype(np.uint8)
        keys = self.keys(flat, np.repeat(first, n) + place)
        order = np.argsort(keys, kind="stable")
        lead = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        self.blocks, self.shifts = keys[order][lead], np.minimum.reduceat(shift[order], lead)
        n = size - length + 1
        self.start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.owner = np.repeat(owner, n)
        bucket = self.hashes(flat, self.start)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.start, self.owner = bucket[order], self.start[order], self.owner[order]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.blocks, self.shifts, self.bucket, self.start, self.owner))

    def keys(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The block at each place as a number; -1 with a word that no pattern has."""
        one = ids[at].astype(np.int64)
        if self.block == 1:
            return one
        two = ids[at + 1].astype(np.int64)
        return np.where((one < 0) | (two < 0), -1, one << 32 | two)

    def hashes(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(self.length):
            out = (out ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def find(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, owner) of every occurrence in texts of word ids, whose last words are before ends."""
        m, b = self.length, self.block
        if len(ids) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = self.keys(ids, np.arange(len(ids) - b + 1))
        at = np.minimum(np.searchsorted(self.blocks, keys), len(self.blocks) - 1)
        shifts = np.where(self.blocks[at] == keys, self.shifts[at], self.most).tolist()  # of the block that begins at a place
        last, start = [], 0
        for stop in ends.tolist():
            end = start + m
            while end <= stop:
                if step := shifts[end - b]:
                    end += step
                else:
                    last.append(end)
                    end += 1
            start = stop
        begin = np.array(last, np.int64) - m
        bucket = self.hashes(ids, begin)
        low, high = np.searchsorted(self.bucket, bucket, "left"), np.searchsorted(self.bucket, bucket, "right")
        n = high - low
        row = np.repeat(np.arange(len(begin)), n)
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = np.ones(len(row), bool)
        for k in range(m):  # the words themselves
            same &= ids[begin[row] + k] == self.flat[self.start[which] + k]
        return begin[row[same]], self.owner[which[same]]


class Tables:
    """Words by number, items by number, and the patterns of each length, of (item, words) rows: the words of an item or of a part of it, blank-joined."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        self.number: dict[str, int] = {}
        self.items = sorted({item for item, _ in rows}, key=lambda x: (x is not None, x or ""))
        named = {item: i for i, item in enumerate(self.items)}
        flat, sizes = array("i"), []
        for _, text in rows:
            own = text.split(" ")
            sizes.append(len(own))
            flat.extend([self.number.setdefault(w, len(self.number)) for w in own])
        size = np.array(sizes, np.int64)
        first, owner = np.cumsum(size) - size, np.array([named[item] for item, _ in rows], np.int64)
        ids = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        length = np.minimum(size, WINDOW)
        self.patterns = [Patterns(int(m), ids, *(x[length == m] for x in (first, size, owner))) for m in np.unique(length)]

    @property
    def nbytes(self) -> int:
        """About what they take: numbers of words are some hundred bytes each."""
        return sum(p.nbytes for p in self.patterns) + (self.patterns[0].flat.nbytes if self.patterns else 0) + 150 * len(self.number)

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Of each text the number of words, the merged word ranges that occurrences cover, and the items that occur."""
        ids, ends = array("i"), []
        for t in texts:
            ids.extend(map(self.number.get, words(t), repeat(-1)))
            ends.append(len(ids))
        flat, ends = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32), np.array(ends, np.int64)
        starts = np.append(0, ends[:-1])
        ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[set[int]] = [set() for _ in texts]
        for p in self.patterns:
            at, owner = p.find(flat, ends)
            text = np.searchsorted(ends, at, "right")
            for i, a, o in zip(text.tolist(), (at - starts[text]).tolist(), owner.tolist(), strict=True):
                ranges[i].append((a, a + p.length))
                found[i].add(o)
        return np.diff(np.append(0, ends)).tolist(), [merged(r) for r in ranges], [[self.items[o] for o in sorted(x)] for x in found]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start: long, end: long>>"


def item_parts(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> DataFrame:
    """(item, words): the words of every item, once; an item of more than `most` words in parts that overlap by a window less one word, so that each window is in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text)
                for at in range(0, max(1, len(own) - WINDOW + 1) if own else 0, most):
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "words": pa.array([" ".join(own[at : at + most + WINDOW - 1])], pa.string())})

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.filter("text IS NOT NULL").mapInArrow(run, "item string, words string").distinct()


def rounds(benchmark: DataFrame, item_col: str, text_col: str, most: int, paths: list[str]) -> Iterator[list[tuple[str, str]]]:
    """Parts of items in lists of about `most` bytes at most; each list is fetched only when its round comes."""
    parts = stored(item_parts(benchmark, item_col, text_col, max(1, most // PART_BYTES)), paths)
    total = parts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = -(-2 * total // most) if total > most else 1
    for i in range(n):
        own = parts if n == 1 else parts.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i)
        yield [(r.item, r.words) for r in own.collect()]


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs: merged word ranges inside occurrences, and the ids of the items that occur, as strings.

    Null and empty texts have no words and no spans; items without words never occur. Repeated rows, equal ids and
    null ids stay rows of their own, in one round or several. Items that share an id are one item with the windows of all;
    items without an id are one too, a null in the list. An empty table of documents gives no rows, an empty benchmark no spans. Texts are read whole, however long. Other columns of either table are not read.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    lists = (pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))
    spark, paths = docs.sparkSession, []

    def found_in(rows: DataFrame, name: str, kind: str, tables: Tables) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, 1, 2 << 20):
                n, spans, items = tables.scan(batch.column(1).to_pylist())
                spans = [[{"start": a, "end": b} for a, b in x] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *map(pa.array, (spans, items), lists)], [name, "n_words", "spans", "items"])

        return rows.select(name, "text").mapInArrow(run, f"`{name}` {kind}, n_words long, spans {SPANS}, items array<string>")

    every = rounds(benchmark, item_col, item_text_col, round_bytes, paths)
    first, second = next(every), next(every, None)
    if second is None:
        removed(spark, paths[0])
        return found_in(kept, "doc_id", kind, Tables(first))
    # Rows are numbered, so that each finds its own again; a round's findings are written before the next one's tables are built.
    numbered = stored(kept.withColumn("row", F.monotonically_increasing_id()), paths)
    found = [cut(found_in(numbered, "row", "long", Tables(first)))]
    while second is not None:
        found.append(cut(found_in(numbered, "row", "long", Tables(second)).filter(F.size("items") > 0)))
        second = next(every, None)
    one = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate("spans", F.lit(None).cast(SPANS), lambda out, x: F.when(out.isNull(), F.array(x)).when(x["start"] <= F.element_at(out, -1)["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))))
    merged_rows = cut(numbered.select("row", "doc_id").join(one, "row").select("doc_id", "n_words", F.coalesce(joined, F.array().cast(SPANS)).alias("spans"), "items"))
    for path in paths:
        removed(spark, path)
    return merged_rows


def contamination(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): a document is contaminated if at least a twentieth of its words, and one or more, lie inside occurrences. One row for each row of docs; see occurrences()."""
    found = occurrences(docs, benchmark, **columns)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """docs without contaminated documents; all columns stay, whatever their names.

    Rows of an id of which any row is contaminated go together; rows with a null id stay, as do null and empty texts of
    other ids. Empty tables of documents or benchmark items take nothing away.
    """
    bad_id = free_name(docs, "bad_id")
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, round_bytes=round_bytes).filter("contaminated").select(F.col("doc_id").alias(bad_id)).distinct()
    return docs.join(bad, F.col(id_col) == F.col(bad_id), "left_anti")
