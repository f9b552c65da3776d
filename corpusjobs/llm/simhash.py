"""SimHash near-duplicates by anchor-point covering.

A document's 64-bit fingerprint is the bitwise majority of the hashes of its word shingles. Anchors are the
codewords of a covering code: the direct sum of two perfect binary Golay codes [23, 12] (every 23-bit block
lies within covering radius 3 of exactly one codeword) and, on the 18 bits left, the zero code. Two
fingerprints within 3 bits have a midpoint within 2 bits of both, and the midpoint has an anchor within the
covering radius; so when each fingerprint is copied to every anchor within covering radius plus 2 (about 61
of the 2**24 anchors), any two within 3 bits meet at an anchor, where they are compared directly. Excess
over the radius is counted block by block, which is the exact condition for a direct sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, components, cut, free_name, joined_by_share

#: Generator polynomial of the binary Golay code, its length, the hash seed.
GOLAY, LENGTH, SEED = 0b101011100011, 23, 42
#: Bits by which linked fingerprints may differ, and the share of them on each side of the midpoint.
THRESHOLD, SIDE = 3, 2
#: Fingerprints of one anchor that one task compares; larger anchors are dealt out as pairs of parts before the shuffle.
CELL = 1 << 15
#: Fingerprints of one anchor that are compared as a matrix.
MATRIX = 1 << 10


# -- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: str | None, size: int = 3) -> int:
    """The signed 64-bit fingerprint; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(size, len(words))
    stops = ends[k - 1 :]
    starts = np.concatenate(([0], ends[: len(stops) - 1] + 1))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts.tolist(), stops.tolist())), repeat(SEED)), np.uint64, len(stops))
    return majority(hashes)


@cache
def byte_bits() -> np.ndarray:
    return (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def majority(hashes: np.ndarray) -> int:
    """Signed integer whose bit i is 1 if bit i is set in over half of the hashes."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ byte_bits() for j in range(8)])
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            fps = pa.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- anchors --------------------------------------------------------------------------------------


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial (11 bits)."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GOLAY << (bit - 11)), left)
    return left


@cache
def covers() -> list[np.ndarray]:
    """For excess 0, 1, 2: by syndrome, the errors that lead to the codewords at that excess; -1 fills up."""
    tables = []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        errors = np.array([sum(1 << i for i in at) for w in weights for at in combinations(range(LENGTH), w)], np.int64)
        of = syndromes(errors)
        order = np.argsort(of, kind="stable")
        of, errors = of[order], errors[order]
        first = np.searchsorted(of, np.arange(2048))
        rank = np.arange(len(of)) - first[of]
        full = np.full((2048, rank.max() + 1), -1, np.int64)
        full[of, rank] = errors
        tables.append(full)
    return tables


def anchors(fps: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within covering radius plus `side` of each fingerprint.

    An anchor is named by the 12 message bits of its two codewords.
    """
    bits = fps.astype(np.int64)
    blocks = (bits & 0x7FFFFF, bits >> 23 & 0x7FFFFF)
    by = [[np.where(t[s] < 0, -1, (b[:, None] ^ t[s]) >> 11) for t in covers()] for b in blocks for s in (syndromes(b),)]
    rows, names = [], []
    for i in range(side + 1):
        for j in range(side + 1 - i):
            low, high = by[0][i][:, :, None], by[1][j][:, None, :]
            at, x, y = np.nonzero((low >= 0) & (high >= 0))
            rows.append(at)
            names.append(by[1][j][at, y] << 12 | by[0][i][at, x])
    return np.concatenate(rows), np.concatenate(names)


def anchored(fps: DataFrame, parts: dict[int, int] | None = None) -> DataFrame:
    """(key, fp): every fingerprint at each of its anchors.

    parts: into how many parts the fingerprints of an anchor are dealt; each goes to every pair of parts with its own.
    """
    parts = parts or {}

    def dealt(names: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        large = np.isin(names, list(parts))
        out_names, out_fps = [names[~large]], [fps[~large]]
        for name in np.unique(names[large]).tolist():
            own, k = fps[names == name], parts[name]
            at = ((own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % k
            for other in range(k):
                low, high = np.minimum(at, other), np.maximum(at, other)
                some = at != other
                out_names.append((name + 1 << 36 | low << 18 | high)[some])
                out_fps.append(own[some])
        return np.concatenate(out_names), np.concatenate(out_fps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2000):
                part = values[at : at + 2000]
                rows, names = anchors(part)
                names, own = dealt(names, part[rows]) if parts else (names, part[rows])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(own)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def large_anchors(fps: DataFrame, cell: int, coarse: int = 12) -> dict[int, int]:
    """Parts of each anchor with more than `cell` fingerprints: counted in the tasks, then summed.

    Anchors are counted in groups of 2**coarse first, and one by one only in groups with more than `cell` fingerprints.
    Of n fingerprints, each at about 61 of the 2**24 anchors, under 61 n / `cell` anchors are that large.
    """

    def counted(shift: int, groups: set[int] | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << 24 - shift, np.int64)
            for batch in batches:
                values = batch.column(0).to_numpy()
                for at in range(0, len(values), 2000):
                    total += np.bincount(anchors(values[at : at + 2000])[1] >> shift, minlength=len(total))
            some = np.flatnonzero(total)
            if groups is not None:
                some = some[np.isin(some >> coarse, list(groups))]
            for at in range(0, len(some), 1 << 16):
                own = some[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["key", "n"])

        return fps.select("fp").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > cell)

    groups = {r.key for r in counted(coarse, None).collect()}
    return {r.key: -(-2 * r.n // cell) for r in counted(0, groups).collect()} if groups else {}


# -- comparison per anchor ------------------------------------------------------------------------


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed integers numpy counts the bits of the magnitude


def forest(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one cell: each fingerprint is compared with all not yet reached."""
    a, b, left = [], [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = differing(left, x) <= threshold
            if near.any():
                got = left[near]
                a.append(np.full(len(got), x))
                b.append(got)
                queue.extend(got)
                left = left[~near]
    none = fps[:0]
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def block_links(rows: np.ndarray, columns: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row with the columns behind it; the columns begin with the rows."""
    at = np.flatnonzero(differing(rows[:, None], columns[None, :]) <= threshold)
    i, j = np.divmod(at, len(columns))
    return rows[i[i < j]], columns[j[i < j]]


def cell_links(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: all of them, or a spanning forest where there are many."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [fps[:0]], [fps[:0]]
    short = sizes <= 16
    for lag in range(1, 16):
        runs = short & (sizes > lag)
        if not runs.any():
            break
        firsts, n = starts[runs], sizes[runs] - lag
        at = np.repeat(firsts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        near = differing(fps[at], fps[at + lag]) <= threshold
        a.append(fps[at[near]])
        b.append(fps[at[near] + lag])
    for s, n in zip(starts[~short], sizes[~short], strict=True):
        own = fps[s : s + n]
        x = y = own[:0]
        if n <= MATRIX:
            x, y = map(np.concatenate, zip(*(block_links(own[at : at + 128], own[at:], threshold) for at in range(0, n, 128)), strict=True))
        if n > MATRIX or len(x) > 4 * n:
            x, y = forest(own, threshold)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def compared(cells: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of cells (key, fp), each compared in one task."""

    def ended(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cell_links(keys, fps, threshold))), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the cell that goes on in the next batch
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(keys) == 0:
                continue
            if held and held[0][0][0] == keys[-1]:
                held.append((keys, fps))
                continue
            own = np.searchsorted(keys, keys[-1])  # the last cell may go on
            yield from ended(*map(np.concatenate, zip(*held, (keys[:own], fps[:own]), strict=True)))
            held = [(keys[own:], fps[own:])]
        if held:
            yield from ended(*map(np.concatenate, zip(*held, strict=True)))

    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that hold together all that differ in `threshold` bits or fewer."""
    if threshold > THRESHOLD:
        raise ValueError("two sides of 2 bits cover thresholds up to 3")
    # Anchors that would be too much for one task are known before anything is shuffled.
    parts = large_anchors(fps, cell) if fps.count() > cell else {}
    return compared(anchored(fps, parts), threshold).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document: component_id is the smallest id that links reach.

    Links join documents whose fingerprints differ in `threshold` bits or fewer; equal texts always link. Null
    and empty texts have fingerprint zero and link with each other. Rows with a null id are kept and take the
    component of their fingerprint (null if no member has an id). Repeated rows and ids stay as they are. An
    empty table gives an empty result. Further columns of docs are not read, so their names cannot clash.
    """
    each = cut(fingerprints(docs, id_col, text_col, size))
    firsts = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    groups = cut(components(links(firsts, threshold, cell)))
    led = groups.join(firsts, groups.node == firsts.fp).groupBy("root").agg(F.min("first").alias("led"))
    moved = groups.join(led, "root").select(F.col("node").alias("fp"), "led")
    whole = cut(firsts.join(moved, "fp", "left").select("fp", "n", F.coalesce("led", "first").alias("component_id")))
    return joined_by_share(each, whole, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest id.

    All columns stay, whatever their names. Rows with a null id are kept (nothing shows which row they are). Where
    several rows bear the id that stays, all of them stay. Null and empty texts are one group. An empty table stays empty.
    """
    kept_id = free_name(docs, "kept_id")
    kept = near_duplicates(docs, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.filter(F.col(id_col).isNull()).unionByName(docs.join(kept, F.col(id_col).cast("long") == F.col(kept_id), "left_semi"))
