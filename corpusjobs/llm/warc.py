"""Merkle fixity audit of WARC files.

A file holds a range of ids, and every id has a place in it; the leaf of a place covers the SHA-256 of its record and
its length. Up to FANOUT neighbours make a node, whose hash covers the places, lengths and hashes of its children, so
its range of offsets relative to its start, up to one root for each file. Two replicas are compared by their roots;
only below a node that differs are its children looked at, so the work below the roots is in proportion to the damage.
A record that is lost, added or longer changes the leaf of its own id and the nodes above, and no other leaf: what
only moved is not reported. Everything runs as joins and aggregations on thin rows: the bytes of a record are hashed
where they are read and never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Children of a node, and places of a file.
FANOUT, PER_FILE = 16, 1024
#: Records without an id are dealt to so many files by their hash, numbered below this one, which no id leads to.
LOOSE, BELOW = 1 << 16, -(1 << 62)


def record_bytes(uri: Column, body: Column) -> Column:
    """A WARC resource record: header, body and the two line ends after it. Null counts as empty."""
    data = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(data).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), data, F.lit(b"\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file, place, id, record) for every row. Records with a null id are dealt to files of their own by the hash of their bytes.

    A null address or body counts as empty. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), record_bytes(F.col(uri_col), F.col(body_col)).alias("record"))
    own, loose = F.pmod("id", F.lit(per_file)), F.xxhash64("record")
    file = F.when(F.col("id").isNotNull(), F.expr(f"(id - pmod(id, {per_file})) div {per_file}")).otherwise(F.lit(BELOW) - F.pmod(loose, F.lit(LOOSE)))
    place = F.when(F.col("id").isNotNull(), own).otherwise(F.pmod(F.shiftrightunsigned(loose, 20), F.lit(per_file)))
    return rows.select(file.alias("file"), place.cast("long").alias("place"), "id", "record")


def leaves(found: DataFrame) -> DataFrame:
    """(file, idx, id, n, size, hash) of (file, place, id, record): one leaf for each place.

    Several records of one place (of an id that repeats, or without ids) make one leaf with their number, their total
    length and the sum of their hashes, whatever their order: nothing is collected, so an id may have any number.
    """
    digest = F.sha2("record", 256)
    quarter = lambda i: F.expr(f"cast(conv(substring(digest, {16 * i + 1}, 15), 16, 10) as decimal(20,0))")
    thin = found.select("file", "place", "id", F.octet_length("record").cast("long").alias("size"), digest.alias("digest"))
    parts = [F.sum(quarter(i)).cast("string").alias(f"q{i}") for i in range(4)]
    grouped = thin.groupBy("file", F.col("place").alias("idx")).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.sum("size").alias("size"), F.min("digest").alias("digest"), *parts)
    whole = F.when(F.col("n") == 1, F.col("digest")).otherwise(F.sha2(F.concat_ws(":", "n", *(f"q{i}" for i in range(4))).cast("binary"), 256))
    return grouped.select("file", "idx", "id", "n", "size", whole.alias("hash"))


def levels(per_file: int) -> int:
    """Levels above the leaves."""
    n = 0
    while FANOUT**n < per_file:
        n += 1
    return n


def tree(found: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(file, level, idx, id, n, size, hash): leaves at level 0, one root for each file at the highest level."""
    level = cut(leaves(found).withColumn("level", F.lit(0)))
    out = level
    for k in range(1, levels(per_file) + 1):
        children = F.sort_array(F.collect_list(F.struct("idx", "size", "hash")))  # at most FANOUT
        joined = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["idx"], c["size"], c["hash"])), ",")
        up = level.groupBy("file", F.shiftright("idx", FANOUT.bit_length() - 1).alias("up")).agg(F.sum("n").alias("n"), F.sum("size").alias("size"), children.alias("children"))
        level = up.select("file", F.col("up").alias("idx"), F.lit(None).cast("long").alias("id"), "n", "size", F.sha2(joined.cast("binary"), 256).alias("hash"), F.lit(k).alias("level"))
        out = out.unionByName(level)
    return cut(out)


def audit(one: DataFrame, other: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Places whose records differ between two trees, or that only one has: (file, place, id, n, start, end, other_n, other_start, other_end, status).

    status: changed, missing (the other lacks it) or extra (only the other has it); start and end are the offsets in
    each replica's file, null where it has no such record. A file that only one replica has differs at its root. Equal
    trees and empty tables give no rows. Of an id that repeats all its records are one place.
    """
    a, b = (t.select("file", "level", "idx", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "size", "hash"))) for t, s in ((one, "a"), (other, "b")))
    differ = None
    for level in range(levels(per_file), -1, -1):
        mine, theirs = (x.filter(F.col("level") == level).drop("level") for x in (a, b))
        if differ is not None:
            above = cut(differ.select("file", F.col("idx").alias("up")))
            mine, theirs = (x.withColumn("up", F.shiftright("idx", FANOUT.bit_length() - 1)).join(above, ["file", "up"], "left_semi").drop("up") for x in (mine, theirs))
        same = F.col("a_hash").eqNullSafe(F.col("b_hash")) & F.col("a_size").eqNullSafe(F.col("b_size"))
        differ = mine.join(theirs, ["file", "idx"], "full").filter(~same)
    differ = cut(differ)
    # Offsets only of files with damage; a file has per_file places at most.
    hurt = differ.select("file").distinct()

    def placed(t: DataFrame, s: str) -> DataFrame:
        end = F.sum("size").over(W.partitionBy("file").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
        return t.filter("level = 0").join(hurt, "file", "left_semi").select("file", "idx", (end - F.col("size")).alias(f"{s}_start"), end.alias(f"{s}_end"))

    status = F.when(F.col("a_hash").isNull(), "extra").when(F.col("b_hash").isNull(), "missing").otherwise("changed")
    both = differ.join(placed(one, "a"), ["file", "idx"], "left").join(placed(other, "b"), ["file", "idx"], "left")
    return both.select("file", F.col("idx").alias("place"), F.coalesce("a_id", "b_id").alias("id"), F.col("a_n").alias("n"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_n").alias("other_n"), F.col("b_start").alias("other_start"), F.col("b_end").alias("other_end"), status.alias("status"))


# -- files ----------------------------------------------------------------------------------------


def write_files(found: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Write (file, place, id, record) as rows of bytes: (file, part, content).

    A file is one part; one with over four times as many records as places, as of an id that repeats, has more.
    """
    large = found.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * per_file).select("file", F.ceil(F.col("n") / per_file).alias("parts"))
    dealt = found.join(large, "file", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))))
    rows = dealt.groupBy("file", "part").agg(F.sort_array(F.collect_list(F.struct("place", "id", F.sha2("record", 256).alias("hash"), "record"))).alias("r"))
    rows.select("file", "part", F.transform("r", lambda x: x["record"]).alias("r")).select("file", "part", F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x)).alias("content")).write.parquet(path)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, end, headers, body) of every record; fails on a record that is cut short."""
    at = 0
    while at < len(data):
        split = data.find(b"\r\n\r\n", at)
        lines = data[at:split].decode("utf-8", "replace").split("\r\n")
        if split < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = split + 4, int(headers["Content-Length"])
        end = start + size + 4
        if data[end - 4 : end] != b"\r\n\r\n":
            raise ValueError(f"record at offset {at} is cut short")
        yield at, end, headers, data[start : start + size]
        at = end


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_no, start, end, uri, body) of every record of files that write_files() wrote; numbers and offsets are within a part."""
    names = ["file", "record_no", "start", "end", "uri", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(file, i, a, b, h.get("WARC-Target-URI", ""), body) for i, (a, b, h, body) in enumerate(parse(data))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.parquet(path).select("file", "content").mapInArrow(run, "file long, record_no long, start long, end long, uri string, body binary")
