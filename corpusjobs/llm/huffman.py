"""Token ids in a compressed block format: canonical length-limited Huffman codes.

Lengths come from the counts of all ids of the corpus by package-merge, so they are optimal under the limit;
the codes are canonical, so the lengths alone restore them. A block holds whole documents and can be read
without any other block. It keeps the bit offset of every 256th id of its stream, so decoding starts at any of
those checkpoints, and a reader decodes all of them at once, one table lookup per id.

A block (little-endian): magic "HUFB", then unsigned 32-bit: ids, documents, payload bytes, ids per
checkpoint; per document: signed 64-bit doc_id, one byte that is 1 for a null id, unsigned 32-bit ids; per
checkpoint an unsigned 64-bit bit offset; the payload, most significant bit first, and 4 zero bytes.
Blocks lie in Parquet files beside the code table, one row per block, in the order of (part, block).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, removed, shared_folder
from .tokens import WORD_BPE, encoder

#: Fixed values of the format.
MAGIC, HEAD, DOC, EVERY, LIMIT, SLACK = b"HUFB", struct.Struct("<4sIIII"), np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")]), 256, 16, 4
#: Ids after which a block ends with the document at hand; the id that ends a document.
BLOCK, END = 1 << 16, 2


# -- codes ----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each symbol: 0 where the count is 0, else optimal under the limit (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes under the limit")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    # From level to level pairs are packed and merged with the leaves; a leaf is known by its rank.
    levels, weights = [], leaves
    levels.append(np.ones(len(leaves), bool))
    for _ in range(limit - 1):
        packs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((leaves, packs))
        by = np.argsort(merged, kind="stable")
        weights, is_leaf = merged[by], (by < len(leaves))
        levels.append(is_leaf)
    need = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        head = is_leaf[:need]
        n = int(head.sum())
        out[order[:n]] += 1
        need = 2 * (len(head) - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for n in np.unique(lengths[order]):
        own = order[lengths[order] == n]
        code <<= int(n) - last
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), int(n)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next `limit` bits."""
    symbols, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    codes = canonical(lengths)
    for s in np.flatnonzero(lengths):
        n = int(lengths[s])
        at = int(codes[s]) << (limit - n)
        symbols[at : at + (1 << (limit - n))] = s
        sizes[at : at + (1 << (limit - n))] = n
    return symbols, sizes


# -- blocks ---------------------------------------------------------------------------------------


def write_block(docs: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """The bytes of a block that holds the ids of the given documents."""
    table = np.array([(d or 0, d is None, len(x)) for d, x in docs], DOC)
    ids = np.concatenate([np.zeros(0, np.int64), *(x for _, x in docs)]).astype(np.int64)
    size = lengths[ids].astype(np.int64)
    if len(size) and size.min() == 0:
        raise ValueError("an id has no code")
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = -(-total // 32) + 1
    # A code spans two words of 32 bits at most; bits of different codes never overlap, so sums are unions.
    spread = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    word = at >> 5
    bits = np.bincount(word, weights=(spread >> np.uint64(32)).astype(np.float64), minlength=words + 1) + np.bincount(word + 1, weights=(spread & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)
    payload = bits.astype(np.uint64).astype(">u4").tobytes()[: -(-total // 8)]
    return HEAD.pack(MAGIC, len(ids), len(docs), len(payload), EVERY) + table.tobytes() + at[::EVERY].astype("<u8").tobytes() + payload + bytes(SLACK)


def block_parts(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    magic, n, docs, size, every = HEAD.unpack_from(block)
    if magic != MAGIC or len(block) < HEAD.size + docs * DOC.itemsize + 8 * -(-n // every) + size + SLACK:
        raise ValueError("not a whole block")
    at = HEAD.size
    table = np.frombuffer(block, DOC, docs, at)
    at += table.nbytes
    points = np.frombuffer(block, "<u8", -(-n // every), at).astype(np.int64)
    payload = np.frombuffer(block, np.uint8, size + SLACK, at + points.nbytes)
    return table, points, payload, n, every


def decode_from(payload: np.ndarray, points: np.ndarray, n: np.ndarray, tables: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """n[i] ids from each bit offset points[i], as rows; all offsets advance together, one lookup per id."""
    symbols, sizes = tables
    p = payload.astype(np.uint32)
    windows = np.concatenate((p[:-2] << 16 | p[1:-1] << 8 | p[2:], [0]))  # 24 bits from each byte
    out = np.zeros((int(n.max(initial=0)), len(points)), np.uint32)
    at, last = points.copy(), len(windows) - 1
    for i in range(len(out)):
        code = windows[np.minimum(at >> 3, last)] >> (24 - limit - (at & 7)).astype(np.uint32) & ((1 << limit) - 1)
        out[i] = symbols[code]
        at += sizes[code]
    return out.T


def read_block(block: bytes, tables: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a block."""
    table, points, payload, n, every = block_parts(block)
    counts = np.full(len(points), every)
    if len(points):
        counts[-1] = n - every * (len(points) - 1)
    ids = decode_from(payload, points, counts, tables).reshape(-1)[:n] if n else np.zeros(0, np.uint32)
    ends = np.cumsum(table["n"].astype(np.int64))
    for row, end in zip(table, ends, strict=True):
        yield (None if row["null"] else int(row["doc_id"])), ids[end - row["n"] : end]


# -- jobs -----------------------------------------------------------------------------------------


def id_counts(ids: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """Counts of all ids of the corpus: a histogram per task, summed by id; as many rows as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in by_bytes(batches, 0):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, end: int = END, parts: int | None = None, block: int = BLOCK) -> None:
    """Write the ids of all documents, each with `end` after it, in ascending order of ids to path/blocks and the code table to path/codes."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = encoder(vocabulary).size
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
    tail = np.array([end], "<u4").tobytes()

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in by_bytes(batches, 1):
            ids = [np.frombuffer(encode(t) + tail, "<u4").astype(kind).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], ["doc_id", "ids", "part"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        part, number, start, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([write_block(held, lengths, codes)], pa.binary())], ["part", "block", "start", "n_ids", "bytes"])

        for batch in by_bytes(batches, 1):
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, np.frombuffer(ids, kind)))
                n += len(held[-1][1])
                if n >= block:
                    yield made()
                    number, start, held, n = number + 1, start + n, [], 0
        if held:
            yield made()

    # Bounds of the parts from all ids, without the texts; a part holds a range of ids. Rows without an id have parts of
    # their own before them, and an id that fills several parts is dealt over these, so one id never makes a part too large.
    number = F.monotonically_increasing_id()
    asked = [F.count("*"), F.count("doc_id")] + ([F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)] if parts > 1 else [])
    n, known, *cuts = docs.agg(*asked).first()
    loose = -(-(n - known) * parts // n) if n > known else 0
    bounds = sorted(cuts[0]) if cuts and cuts[0] else []
    after = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("doc_id"))) if bounds else F.lit(0)
    part = F.lit(loose) + after
    for hot in sorted({x for x in bounds if bounds.count(x) > 1}):
        part = part + F.when(F.col("doc_id") == hot, F.pmod(number, F.lit(bounds.count(hot)))).otherwise(0)
    part = F.when(F.col("doc_id").isNull(), F.pmod(number, F.lit(max(loose, 1)))).otherwise(part)
    ranged = docs.withColumn("part", part.cast("int")).mapInArrow(tokenised, "doc_id long, ids binary, part int")
    # The texts are coded once: the counts and then the blocks come from these ids.
    ranged.write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    lengths = code_lengths(id_counts(ids, kind, size))
    spark.createDataFrame([(bytearray(lengths.tobytes()), LIMIT)], "lengths binary, longest int").coalesce(1).write.parquet(f"{path}/codes")
    ordered = ids.repartitionById(loose + len(bounds) + 1, "part").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, "part int, block int, start long, n_ids long, bytes binary").write.parquet(f"{path}/blocks")
    removed(spark, f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; start counts the ids before it."""
    code = spark.read.parquet(f"{path}/codes").first()
    lengths, limit = np.frombuffer(code.lengths, np.uint8), code.longest
    blocks = spark.read.parquet(f"{path}/blocks")
    whole = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part, however many documents
    base = whole.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decode_table(lengths, limit)
        for batch in batches:
            for base, start, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, at = [], base + start
                for doc, ids in read_block(data, tables):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc, at, len(ids), zlib.crc32(raw), raw))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.join(F.broadcast(base), "part").select("base", "start", "bytes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write docs in the block format (to a new folder in the shared one where no path is given) and read them back.

    A null or empty text has the end id only. Rows with a null id come first; rows of the same id follow each
    other, in the order of their ids within a part. Texts are read whole. An empty table gives no rows. Columns other
    than the id and the text are not read, so their names cannot clash. The files are the operator's product and stay.
    """
    path = path or f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write(docs, path, **options)
    return read(docs.sparkSession, path)
