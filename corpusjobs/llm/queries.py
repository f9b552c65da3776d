"""Queries of the operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, flac, huffman, lines, packing, pii, simhash, spelling, suffixes, token_trie, toxicity, warc
from .common import cut, removed, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trie.token_counts(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.media(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_files(table(spark, sf_dir, "documents")).drop("ids")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a damaged replica of all pages: some records have another first byte, some are longer, some are lost, some are only there.

    Both replicas also hold copies of some pages without an id.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    loose = pages.filter("page_id % 211 = 1").withColumn("page_id", F.lit(None).cast("long"))
    more = pages.filter("page_id % 89 = 4").withColumn("page_id", -1 - F.col("page_id"))
    html = F.when((F.col("page_id") % 53 == 7) & F.col("html").startswith("<"), F.concat(F.lit("#"), F.substring("html", 2, 2147483647))).when(F.col("page_id") % 71 == 9, F.concat("html", F.lit(" more"))).otherwise(F.col("html"))
    damaged = pages.filter("page_id % 101 <> 5").withColumn("html", html).unionByName(more)
    one, other = (warc.tree(warc.records(x.unionByName(loose))) for x in (pages, damaged))
    return warc.audit(one, other)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op11_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.col("centroid").cast("binary"), 256)).drop("centroid")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths: list[str] = []
    left = suffixes.without_repeats(table(spark, sf_dir, "documents"), paths)
    kept = F.coalesce("kept", F.lit(b""))
    found = cut(left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length(kept)).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256")))
    for p in paths:
        removed(spark, p)
    return found


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_flac": op4_flac,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_huffman": op7_huffman,
    "op8_pii": op8_pii,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_packing": op10_packing,
    "op11_bisector_clusters": op11_bisector_clusters,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Words and windows as in decontam.py; positions of a document's words that lie in an occurrence are counted.
OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n)),
m AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p USING (n, t)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Records in files of 1,024 page ids; lengths of a record as warc.record_bytes() writes it.
OP9 = """
WITH p AS (SELECT page_id AS id, url, html FROM pages),
q AS (SELECT id, url, CASE WHEN id % 53 = 7 AND html LIKE '<%' THEN '#' || html[2:] WHEN id % 71 = 9 THEN html || ' more' ELSE html END AS html FROM p WHERE id % 101 <> 5
  UNION ALL SELECT -1 - id, url, html FROM p WHERE id % 89 = 4),
r AS (SELECT side, id, ((id % 1024) + 1024) % 1024 AS place, (id - ((id % 1024) + 1024) % 1024) // 1024 AS file, coalesce(url, '') || chr(10) || coalesce(html, '') AS said,
  strlen('WARC/1.0WARC-Type: resourceWARC-Target-URI: Content-Type: text/htmlContent-Length: ') + 12 + strlen(coalesce(url, '')) + length(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) + 4 AS size
  FROM (SELECT 'a' AS side, * FROM p UNION ALL SELECT 'b', * FROM q)),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY side, file ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM r),
a AS (SELECT * FROM o WHERE side = 'a'), b AS (SELECT * FROM o WHERE side = 'b')
SELECT coalesce(a.file, b.file) AS file, coalesce(a.place, b.place) AS place, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN 1 END AS n, a."end" - a.size AS start, a."end" AS "end",
  CASE WHEN b.id IS NOT NULL THEN 1 END AS other_n, b."end" - b.size AS other_start, b."end" AS other_end, CASE WHEN a.id IS NULL THEN 'extra' WHEN b.id IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.id = b.id WHERE a.said IS DISTINCT FROM b.said
"""

#: One assignment and its new centroids, by distances to all centroids; the rounds are chained.
NEAREST = """SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, x, k.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS BIGINT) AS d FROM v, {k} AS k) GROUP BY vec_id, x"""
MOVED = """SELECT k.c, coalesce(y2, y) AS y FROM {k} AS k LEFT JOIN (SELECT c, list(y ORDER BY i) AS y2 FROM (SELECT c, i, CAST((sum(z) - (((sum(z) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT) AS y FROM (SELECT c, unnest(x) AS z, unnest(range(64)) AS i FROM {a}) GROUP BY c, i) GROUP BY c) USING (c)"""
OP11 = (
    """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(CAST(e AS DOUBLE)))) = 64),
k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),
"""
    + "".join(f"a{i} AS MATERIALIZED ({NEAREST.format(k=f'k{i}')}),\nk{i + 1} AS MATERIALIZED ({MOVED.format(k=f'k{i}', a=f'a{i}')}),\n" for i in range(5))
    + f"""a5 AS MATERIALIZED ({NEAREST.format(k="k5")})
SELECT vec_id, CAST(a5.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a5.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a5 JOIN k5 ON a5.c = k5.c
"""
)

#: Bytes as hexadecimal digits, cut into pieces of 512 bytes with the 49 after them; a removed run begins at a start that no start of the 50 bytes before it reaches.
OP12 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, CAST(i AS BIGINT) AS base, substr(h, 2 * i + 1, 2 * (512 + 49)) AS t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 512)) AS i FROM d)),
w AS (SELECT doc_id, base + j AS pos, substr(t, CAST(2 * j + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, base, t, unnest(range(0, least(512, length(t) // 2 - 49))) AS j FROM p)),
f AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE doc_id > least),
g AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, n, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM g) GROUP BY doc_id, n),
e AS (SELECT r.doc_id, r.n, r.a, r.b, coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.n), 0) AS before FROM r),
k AS (SELECT e.doc_id, string_agg(substr(d.h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY n) AS head, max(b) AS tail, sum(b - a) AS gone, count(*) AS n FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

#: CRC-32 byte by byte over a table made of its polynomial; near words by strings with one letter out.
OP13 = """
WITH RECURSIVE c AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) AS x(i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]{7,}')) AS run FROM documents),
h AS (SELECT run, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, any_value(length(hex(encode(said)))) // 2 + 1), lambda i: CAST('0x' || substr(hex(encode(said)), 2 * i - 1, 2) AS BIGINT))), lambda a, b: xor(t[CAST(xor(a % 256, b) + 1 AS BIGINT)], a // 256))) AS h
  FROM (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said FROM r), c GROUP BY run, said, t),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
o AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM o a JOIN o b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT o.word, o.n, w.word, w.n FROM o JOIN w ON o.less = w.word
  UNION SELECT w.word, w.n, o.word, o.n FROM o JOIN w ON o.less = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON s.further = f.word)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s USING (word) WHERE s.further IS NULL
"""

ORACLES: dict[str, str] = {"op6_decontamination": OP6, "op9_warc_fixity": OP9, "op11_bisector_clusters": OP11, "op12_suffix_dedup": OP12, "op13_spelling_variants": OP13}
