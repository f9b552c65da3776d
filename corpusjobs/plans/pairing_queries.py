"""Queries over source text profiles and pairs, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles as P
from ..operators import pairing as J
from .views import VIEWS, cte, escaped, view

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


CODE = cte("code_seeds")


def code(spark, sf_dir, language):
    return view(spark, sf_dir, "code_seeds").filter(F.col("type") == language)


def joined(c):
    return F.array_join(c, "|")


@query(CODE + r"""SELECT seed_no, array_to_string(regexp_extract_all(content, '(?m)^\s*use\s+([^;]+);', 1), '|') AS imports, array_to_string(regexp_extract_all(content, 'fn\s+([a-zA-Z0-9_]+)\s*\(', 1), '|') AS functions, array_to_string(regexp_extract_all(content, 'struct\s+([a-zA-Z0-9_]+)', 1), '|') AS structs FROM code_seeds WHERE type = 'rust'""")
def f1_rust_parse(spark, sf_dir):
    p = P.rust_parse(F.col("content"))
    return code(spark, sf_dir, "rust").select("seed_no", joined(p["imports"]).alias("imports"), joined(p["functions"]).alias("functions"), joined(p["structs"]).alias("structs"))


@query(CODE + r""", r AS (SELECT *, regexp_extract_all(content, '\blet\s+(?:mut\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*([^=;\n]+?)\s*(?:=|;)', 1) AS n, regexp_extract_all(content, '\blet\s+(?:mut\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*([^=;\n]+?)\s*(?:=|;)', 2) AS t FROM code_seeds WHERE type = 'rust')
SELECT seed_no, array_to_string(list_sort(list_transform(list_zip(n, t), lambda x: x[1] || ':' || x[2])), '|') AS typed, array_to_string(list_sort(list_transform(list_filter(list_zip(n, t), lambda x: x[2] IN ('i32', 'u8')), lambda x: x[1])), '|') AS primitive,
array_to_string(list_filter(list_transform(regexp_extract_all(content, '\bfn\s+[a-zA-Z_][a-zA-Z0-9_]*\s*(?:<[^>]*>)?\s*\([^)]*\)(?:\s*->\s*[^{;]+)?'), lambda x: trim(x)), lambda x: NOT starts_with(x, 'fn main')), '|') AS signatures,
CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_count, CAST(len(string_split(content, chr(10))) + 5 AS INTEGER) AS complexity FROM r""")
def f2_rust_profile(spark, sf_dir):
    rows = code(spark, sf_dir, "rust").select("seed_no", P.rust_profile(F.col("content")).alias("p"))
    typed = F.array_sort(F.transform(F.map_entries("p.var_types"), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return rows.select("seed_no", joined(typed).alias("typed"), joined(F.array_sort("p.primitive_vars")).alias("primitive"), joined("p.fn_signatures").alias("signatures"), "p.line_count", F.col("p.complexity_score").alias("complexity"))


@query(CODE + r""", s AS (SELECT *, regexp_replace(regexp_replace(content, '"[^"\n]*"', ' ', 'g'), '#[^\n]*', ' ', 'g') AS bare FROM code_seeds WHERE type = 'cpython'),
u AS (SELECT seed_no, unnest(regexp_extract_all(bare, '\b([A-Za-z_]\w*)\b', 1)) AS w, regexp_extract_all(content, '(?m)^([A-Za-z_]\w*)\s*=', 1) AS top, regexp_extract_all(content, '(?m)^\s*import\s+([A-Za-z_]\w*)', 1) AS imports, regexp_extract_all(content, '(?m)^\s*def\s+([A-Za-z_]\w*)', 1) AS fns FROM s)
SELECT seed_no, array_to_string(any_value(top), '|') AS top, array_to_string(any_value(imports), '|') AS imports, array_to_string(any_value(fns), '|') AS functions, coalesce(string_agg(DISTINCT w, '|' ORDER BY w) FILTER (NOT list_contains(top, w) AND NOT list_contains(imports, w) AND NOT list_contains(fns, w) AND w NOT IN ('import', 'def', 'return')), '') AS undefined FROM u GROUP BY seed_no""")
def f3_python_profile(spark, sf_dir):
    rows = code(spark, sf_dir, "cpython").select("seed_no", P.python_profile(F.col("content")).alias("p"))
    return rows.select("seed_no", joined("p.top_level_vars").alias("top"), joined("p.imports").alias("imports"), joined("p.functions").alias("functions"), joined("p.undefined_refs").alias("undefined"))


C_TYPES = r"""SELECT seed_no, unnest(regexp_extract_all(content, '\b(int|long)\s*(\*{0,2})\s*([A-Za-z_]\w*)\s*(?:=|;|,|\))', 1)) AS t, unnest(regexp_extract_all(content, '\b(int|long)\s*(\*{0,2})\s*([A-Za-z_]\w*)\s*(?:=|;|,|\))', 3)) AS n FROM code_seeds WHERE type = 'clang'"""


@query(CODE + f", e AS ({C_TYPES}), o AS (SELECT *, row_number() OVER () AS i FROM e) SELECT seed_no, n AS name, arg_max(t, i) AS type FROM o GROUP BY 1, 2")
def f10_c_types(spark, sf_dir):
    return code(spark, sf_dir, "clang").select("seed_no", F.explode(P.c_types(F.col("content"))).alias("name", "type"))


@query(CODE + "SELECT seed_no, CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_count, strlen(content) AS byte_size FROM code_seeds")
def f12_generic_profile(spark, sf_dir):
    p = P.generic_profile(F.col("content"))
    return view(spark, sf_dir, "code_seeds").select("seed_no", p["line_count"].alias("line_count"), p["byte_size"].cast("long").alias("byte_size"))


@query(CODE + r"""SELECT seed_no, regexp_matches(content, '\b(?:class|struct|union|enum)\s+[A-Za-z_]\w*') AS declared, array_to_string(regexp_extract_all(content, '\b(?:class|struct)\s+([A-Za-z_]\w*)\s*\{', 1), '|') AS headers FROM code_seeds WHERE type = 'clang'""")
def f13_f15_c_declarations(spark, sf_dir):
    heads = F.transform(P.class_headers(F.col("content")), lambda h: h["name"])
    return code(spark, sf_dir, "clang").select("seed_no", P.has_declaration(F.col("content")).alias("declared"), joined(heads).alias("headers"))


@query(CODE + r"""SELECT seed_no, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\bfunction ([a-zA-Z_]\w*)', 1))), '|') AS names, regexp_replace(regexp_replace(content, '\$[a-zA-Z_]\w*', '$_', 'g'), '\b\d+\b', '0', 'g') AS normal FROM code_seeds WHERE type = 'php'""")
def f16_f18_php(spark, sf_dir):
    return code(spark, sf_dir, "php").select("seed_no", joined(P.php_names(F.col("content"))).alias("names"), P.normalize_php(F.col("content")).alias("normal"))


@query(CODE + r"""SELECT seed_no, array_to_string(regexp_extract_all(content, '(?m)^([A-Za-z_]\w*)\s*=', 1), '|') AS producers, array_to_string(list_filter(regexp_extract_all(content, '\b([A-Za-z_]\w*)\b', 1), lambda x: x NOT IN ('import', 'def', 'return')), '|') AS consumers FROM code_seeds WHERE type = 'cpython'""")
def f17_python_bridges(spark, sf_dir):
    return code(spark, sf_dir, "cpython").select("seed_no", joined(P.python_producers(F.col("content"))).alias("producers"), joined(P.python_consumers(F.col("content"))).alias("consumers"))


@query(CODE + r"""SELECT seed_no, 'S' || (seed_no % 7) AS symbol, array_to_string(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x), 'import ')), '|') AS imports, array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT starts_with(trim(x), 'import ')), chr(10)) AS body FROM code_seeds WHERE type = 'cpython'""")
def f19_f23_symbols_and_imports(spark, sf_dir):
    raw = F.concat(F.lit(" &mut pkg.mod::S"), (F.col("seed_no") % 7).cast("string"), F.lit("<T> "))
    p = P.split_imports(F.col("content"))
    return code(spark, sf_dir, "cpython").select("seed_no", P.base_symbol(raw).alias("symbol"), joined(p["imports"]).alias("imports"), p["body"].alias("body"))


# -- similarity -----------------------------------------------------------------------------------

WORDS = "list_filter(string_split_regex(content, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}]+'), lambda x: x <> '')".replace("\\\\", "\\")
SHINGLED = cte("seeds") + f""", w AS (SELECT seed_no AS id, {WORDS} AS w FROM seeds), s AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w)"""


@query(SHINGLED + " SELECT id, CAST(len(s) AS INTEGER) AS n FROM s")
def d1_shingles(spark, sf_dir):
    return view(spark, sf_dir, "seeds").select(F.col("seed_no").alias("id"), F.size(J.shingles(F.col("content"), 5)).alias("n"))


@query(SHINGLED + """, r AS (SELECT list_sort(s) AS s, min(id) AS id FROM s WHERE len(s) > 0 GROUP BY 1), x AS (SELECT id, len(s) AS n, unnest(s) AS h FROM r),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2, 3, 4) SELECT a, b, round(c / (na + nb - c), 6) AS similarity FROM p WHERE c / (na + nb - c) >= 0.8""")
def d3_similar_pairs(spark, sf_dir):
    rows = view(spark, sf_dir, "seeds").select(F.col("seed_no").alias("id"), "content")
    return J.similar_pairs(rows, 0.8).withColumn("similarity", F.round("similarity", 6))


@query(ORACLES["d3_similar_pairs"])
def d3_likely_pairs(spark, sf_dir):
    """The pairs of d3_similar_pairs by bands of MinHash values; with 40 bands of 4 a pair at the threshold is missed once in a billion."""
    rows = view(spark, sf_dir, "seeds").select(F.col("seed_no").alias("id"), "content")
    return J.likely_pairs(rows, 0.8, bands=40, rows=4).withColumn("similarity", F.round("similarity", 6))


@query(cte("seeds") + "SELECT seed_no FROM seeds ORDER BY md5('11|' || seed_no), seed_no LIMIT 100")
def d5_sample(spark, sf_dir):
    return J.sample_n(view(spark, sf_dir, "seeds").select("seed_no"), 100, 11, "seed_no")


@query(cte("seeds") + ", b AS (SELECT seed_no, CAST('0x' || left(md5('5|' || seed_no), 8) AS BIGINT) % 100 AS b FROM seeds) SELECT seed_no, CAST(least(CASE WHEN b < 89 THEN 1 WHEN b < 99 THEN 2 ELSE 3 END, seed_no % 4) AS BIGINT) AS n FROM b")
def d6_weighted_occurrences(spark, sf_dir):
    return view(spark, sf_dir, "seeds").select("seed_no", J.weighted_occurrences(5, F.col("seed_no"), F.col("seed_no") % 4).cast("long").alias("n"))


# -- pairs ----------------------------------------------------------------------------------------


def resources(spark, sf_dir):
    """Python and C seeds: what they define and what they use."""
    python = code(spark, sf_dir, "cpython").select(F.col("seed_no").alias("id"), "content", P.python_profile(F.col("content")).alias("p"))
    made = python.select("id", "content", F.array().cast("array<string>").alias("types"), F.col("p.functions").alias("produces"), F.array_union("p.imports", "p.undefined_refs").alias("consumes"))
    c = code(spark, sf_dir, "clang").select(F.col("seed_no").alias("id"), "content", F.map_values(P.c_types(F.col("content"))).alias("types"), P.c_type_names(F.col("content")).alias("produces"), F.array().cast("array<string>").alias("consumes"))
    bare = code(spark, sf_dir, "php").select(F.col("seed_no").alias("id"), "content", *(F.array().cast("array<string>").alias(x) for x in ("types", "produces", "consumes")))
    return J.resource_profile(made.unionByName(c).unionByName(bare))


RESOURCES = CODE + r""", py AS (SELECT seed_no, regexp_replace(regexp_replace(content, '"[^"\n]*"', ' ', 'g'), '#[^\n]*', ' ', 'g') AS bare, regexp_extract_all(content, '(?m)^([A-Za-z_]\w*)\s*=', 1) AS top, regexp_extract_all(content, '(?m)^\s*import\s+([A-Za-z_]\w*)', 1) AS imports, regexp_extract_all(content, '(?m)^\s*def\s+([A-Za-z_]\w*)', 1) AS fns FROM code_seeds WHERE type = 'cpython'),
r AS (SELECT DISTINCT * FROM (
  SELECT seed_no AS id, 'produces' AS role, unnest(fns) AS symbol FROM py
  UNION ALL SELECT seed_no, 'consumes', unnest(imports) FROM py
  UNION ALL SELECT seed_no, 'consumes', w FROM (SELECT *, unnest(regexp_extract_all(bare, '\b([A-Za-z_]\w*)\b', 1)) AS w FROM py) WHERE NOT list_contains(top, w) AND NOT list_contains(imports, w) AND NOT list_contains(fns, w) AND w NOT IN ('import', 'def', 'return')
  UNION ALL SELECT seed_no, role, t FROM (SELECT seed_no, unnest(regexp_extract_all(content, '\b(int|long)\s*\*{0,2}\s*[A-Za-z_]\w*\s*(?:=|;|,|\))', 1)) AS t FROM code_seeds WHERE type = 'clang'), (VALUES ('produces'), ('consumes')) v(role)
  UNION ALL SELECT seed_no, 'produces', unnest(regexp_extract_all(content, '\bstruct\s+([A-Za-z_]\w*)', 1)) FROM code_seeds WHERE type = 'clang'
  UNION ALL SELECT seed_no, role, w FROM (SELECT seed_no, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS w FROM code_seeds WHERE type = 'php'), (VALUES ('produces'), ('consumes')) v(role)))
"""


@query(RESOURCES + "SELECT id, role, symbol FROM r")
def j1_resource_profile(spark, sf_dir):
    return resources(spark, sf_dir)


#: Pairs of classes with equal symbols in equal roles, from all pairs of seeds.
CLASSES = RESOURCES + """, g AS (SELECT id, string_agg(role || ':' || symbol, '|' ORDER BY role || ':' || symbol) AS marks FROM r GROUP BY id), k AS (SELECT id, min(id) OVER (PARTITION BY marks) AS kind, row_number() OVER (PARTITION BY marks ORDER BY id) - 1 AS seat, count(*) OVER (PARTITION BY marks) AS seeds FROM g),
m AS (SELECT a.id AS x, b.id AS y FROM r a JOIN r b ON a.role = 'produces' AND b.role = 'consumes' AND a.symbol = b.symbol AND a.id <> b.id), s AS (SELECT least(x, y) AS lo, greatest(x, y) AS hi, count(*) AS score FROM m GROUP BY 1, 2),
f AS (SELECT lo, hi, score, CASE WHEN a.kind <= b.kind THEN a.kind ELSE b.kind END AS k1, greatest(a.kind, b.kind) AS k2, CASE WHEN a.kind <= b.kind THEN a.seat ELSE b.seat END AS s1, CASE WHEN a.kind <= b.kind THEN b.seat ELSE a.seat END AS s2, CASE WHEN a.kind <= b.kind THEN b.seeds ELSE a.seeds END AS n2 FROM s JOIN k a ON a.id = lo JOIN k b ON b.id = hi) """


@query(CLASSES + "SELECT k1, k2, any_value(score) AS score, count(*) AS pairs FROM f GROUP BY k1, k2")
def j2_j3_compatibility(spark, sf_dir):
    """The compatible classes of seeds with their score and number of pairs."""
    return J.compatible_classes(J.seed_classes(resources(spark, sf_dir)))


#: The symbols of the classes, and of their pairs those that meet by a symbol of few.
RARER = RESOURCES + """, g AS (SELECT id, string_agg(role || ':' || symbol, '|' ORDER BY role || ':' || symbol) AS marks FROM r GROUP BY id), k AS (SELECT marks, min(id) AS kind, count(*) AS seeds FROM g GROUP BY marks),
o AS (SELECT kind, role, symbol FROM r JOIN k ON r.id = k.kind), n AS (SELECT symbol, count(*) FILTER (role = 'produces') AS makers, count(*) FILTER (role = 'consumes') AS users FROM o GROUP BY symbol),
m AS (SELECT least(a.kind, b.kind) AS k1, greatest(a.kind, b.kind) AS k2, symbol FROM o a JOIN o b USING (symbol) WHERE a.role = 'produces' AND b.role = 'consumes') """


@query(RARER + "SELECT symbol, makers, users FROM n WHERE makers * users > 40")
def j2_dropped_symbols(spark, sf_dir):
    return J.dropped_symbols(J.seed_classes(resources(spark, sf_dir)), 40)


@query(RARER + """SELECT k1, k2, CASE WHEN k1 = k2 THEN 2 ELSE 1 END * count(*) AS score, CASE WHEN k1 = k2 THEN any_value(a.seeds * (a.seeds - 1) // 2) ELSE any_value(a.seeds * b.seeds) END AS pairs FROM m JOIN k a ON a.kind = k1 JOIN k b ON b.kind = k2
GROUP BY k1, k2 HAVING bool_or(symbol IN (SELECT symbol FROM n WHERE makers * users BETWEEN 1 AND 40)) AND pairs > 0""")
def j2_bounded_compatibility(spark, sf_dir):
    """The compatible classes that meet by a symbol of at most 40 pairs of classes, scored by all symbols."""
    return J.compatible_classes(J.seed_classes(resources(spark, sf_dir)), most=40)


@query(CLASSES + f", c AS (SELECT DISTINCT least(id_a, id_b) AS lo, greatest(id_a, id_b) AS hi FROM ({VIEWS['fused_pairs']}) WHERE id_a <> id_b) SELECT lo AS id_lo, hi AS id_hi, score FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lo = f.lo AND c.hi = f.hi) ORDER BY score DESC, k1, k2, CASE WHEN k1 = k2 THEN greatest(s1, s2) * (greatest(s1, s2) - 1) // 2 + least(s1, s2) ELSE s1 * n2 + s2 END LIMIT 300")
def j5_guided_pairs(spark, sf_dir):
    """The 300 compatible pairs of seeds with the best scores that the log does not hold."""
    return J.guided_pairs(J.seed_classes(resources(spark, sf_dir)), view(spark, sf_dir, "fused_pairs"), 300)


PAIRS = cte("fused_pairs") + ", c AS (SELECT DISTINCT least(id_a, id_b) AS id_lo, greatest(id_a, id_b) AS id_hi FROM fused_pairs WHERE id_a <> id_b) "


@query(PAIRS + ", k AS (SELECT a.p_partkey AS id_lo, b.p_partkey AS id_hi FROM part a JOIN part b ON b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 50) SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id_lo = k.id_lo AND c.id_hi = k.id_hi)")
def j4_unfused_pairs(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    near = part.select(F.col("p_partkey").alias("id_lo"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 50)).alias("id_hi"))
    return J.unfused_pairs(near.join(part.select(F.col("p_partkey").alias("id_hi")), "id_hi", "left_semi").select("id_lo", "id_hi"), view(spark, sf_dir, "fused_pairs"))


def planned(seed: int, n: int, ids: str, log: str, scored: str | None) -> str:
    """SQL of a plan: every number below the power of four goes through the rounds, and the pairs of the numbers that are unfused come in their order."""
    rounds = [f"f0 AS (SELECT place, place >> half AS l, place & ((1 << half) - 1) AS r, half, m FROM z, range(0, (SELECT 1 << (2 * half) FROM z)) AS x(place))"]
    for k in range(4):
        y = f"((r + {(seed * 2654435761 + k * 40503) % (1 << 31)}) * 747796405)"
        rounds.append(f"f{k + 1} AS (SELECT place, r AS l, xor(l, xor({y} >> 13, {y}) & ((1 << half) - 1)) AS r, half, m FROM f{k})")
    own = f"SELECT DISTINCT id_lo, id_hi FROM ({scored}) s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id_lo = s.id_lo AND k.id_hi = s.id_hi) ORDER BY md5('{seed}|' || id_lo || '|' || id_hi) LIMIT {n}" if scored else "SELECT id_lo, id_hi FROM known LIMIT 0"
    return f"""ids AS (SELECT DISTINCT CAST(id AS BIGINT) AS id FROM ({ids})), known AS (SELECT DISTINCT CAST(least(id_a, id_b) AS BIGINT) AS id_lo, CAST(greatest(id_a, id_b) AS BIGINT) AS id_hi FROM ({log}) WHERE id_a <> id_b AND id_a IN (SELECT id FROM ids) AND id_b IN (SELECT id FROM ids)),
p0 AS MATERIALIZED ({own}), gone AS (SELECT * FROM known UNION ALL SELECT * FROM p0), degree AS (SELECT id, count(*) AS n FROM (SELECT id_lo AS id FROM gone UNION ALL SELECT id_hi FROM gone) GROUP BY id),
seat AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS number FROM ids LEFT JOIN degree USING (id) WHERE coalesce(n, 0) < (SELECT count(*) - 1 FROM ids)),
z AS MATERIALIZED (SELECT m, greatest(1, (length(bin(m * (m - 1) // 2)) + 1) // 2) AS half FROM (SELECT count(*) AS m FROM seat)), {", ".join(rounds)},
t AS (SELECT place, (l << half) | r AS t FROM f4 WHERE ((l << half) | r) < m * (m - 1) // 2), j AS (SELECT place, t, CAST(floor((1 + sqrt(1 + 8 * t)) / 2) AS BIGINT) AS j FROM t),
i AS (SELECT place, t - j * (j - 1) // 2 AS i, j FROM (SELECT place, t, CASE WHEN j * (j - 1) // 2 > t THEN j - 1 WHEN j * (j + 1) // 2 <= t THEN j + 1 ELSE j END AS j FROM j)),
p1 AS MATERIALIZED (SELECT a.id AS id_lo, b.id AS id_hi FROM i JOIN seat a ON a.number = i JOIN seat b ON b.number = j WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id_lo = a.id AND g.id_hi = b.id) ORDER BY place LIMIT {n} - (SELECT count(*) FROM p0)),
p2 AS (SELECT id_lo, id_hi FROM known ORDER BY md5('{seed}|' || id_lo || '|' || id_hi) LIMIT {n} - (SELECT count(*) FROM p0) - (SELECT count(*) FROM p1))
SELECT id_lo, id_hi, 0 AS priority FROM p0 UNION ALL SELECT id_lo, id_hi, 1 FROM p1 UNION ALL SELECT id_lo, id_hi, 2 FROM p2"""


NEXT_PART = "SELECT p_partkey AS id_lo, p_partkey + 1 AS id_hi, p_size AS score FROM part WHERE p_size > 40 AND p_partkey + 1 IN (SELECT p_partkey FROM part)"


@query("WITH " + planned(3, 700, "SELECT p_partkey AS id FROM part", VIEWS["fused_pairs"], NEXT_PART))
def j5_plan_pairs(spark, sf_dir):
    """700 pairs of parts: neighbours of large size that are not logged, then others that are not."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    scored = spark.sql("WITH part AS (SELECT * FROM {part}) " + NEXT_PART, part=part)
    return J.plan_pairs(part.select(F.col("p_partkey").alias("id")), view(spark, sf_dir, "fused_pairs"), 700, 3, scored)


NATION_LOG = "SELECT s_nationkey AS id_a, s_suppkey % 25 AS id_b FROM supplier"


@query("WITH " + planned(5, 290, "SELECT n_nationkey AS id FROM nation", NATION_LOG, None))
def j5_plan_saturated(spark, sf_dir):
    """290 of the 300 pairs of nations: all that are not logged, then logged ones."""
    log = spark.sql("SELECT s_nationkey AS id_a, s_suppkey % 25 AS id_b FROM {supplier}", supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    return J.plan_pairs(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id")), log.select(*(F.col(c).cast("long").alias(c) for c in log.columns)), 290, 5)


N = "(SELECT count(*) FROM part)"


@query(PAIRS + f"SELECT count(*) AS covered, CAST({N} * ({N} - 1) / 2 AS BIGINT) AS total, round(least(count(*), {N} * ({N} - 1) / 2) / ({N} * ({N} - 1) / 2), 6) AS ratio, count(*) >= {N} * ({N} - 1) / 2 AS saturated FROM c")
def j6_pair_coverage(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.count("*").alias("n"))
    return J.pair_coverage(n, view(spark, sf_dir, "fused_pairs")).withColumn("ratio", F.round("ratio", 6))


@query(PAIRS + "SELECT id_lo, id_hi FROM c WHERE id_lo % 3 > 0 AND id_hi % 3 > 0")
def j7_viable_pairs(spark, sf_dir):
    declared = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "p_partkey % 3 > 0 AS has_declaration")
    return J.viable_pairs(J.canonical(view(spark, sf_dir, "fused_pairs")), declared, "declaration")


@query(PAIRS + """, p AS (SELECT id_lo || '-' || id_hi AS pair FROM c), t AS (SELECT pair, t, md5('9|' || pair || '|' || t) AS d, CAST('0x' || left(md5('10|' || pair || '|' || t), 8) AS BIGINT) % 100 < 80 AS k FROM p, (VALUES ('dataflow'), ('declaration'), ('state')) v(t))
SELECT pair, coalesce(string_agg(t, ',' ORDER BY d) FILTER (k), arg_min(t, d)) AS chain FROM t GROUP BY pair""")
def j8_j9_strategy_chain(spark, sf_dir):
    pairs = J.canonical(view(spark, sf_dir, "fused_pairs")).select(F.concat_ws("-", "id_lo", "id_hi").alias("pair"))
    return pairs.select("pair", F.array_join(J.strategy_chain(F.col("pair"), J.technique_pool("clang"), 9), ",").alias("chain"))


C_PAIRS = "SELECT seed_no AS id_lo, seed_no + 4 AS id_hi FROM code_seeds WHERE type = 'clang'"


@query(CODE + f", p AS ({C_PAIRS}), e AS (SELECT DISTINCT seed_no, t, n FROM ({C_TYPES})) SELECT id_lo, id_hi, a.n AS var_a, b.n AS var_b, a.t AS type_a, false AS needs_clone FROM p JOIN e a ON a.seed_no = id_lo JOIN e b ON b.seed_no = id_hi AND a.t = b.t")
def j10_typed_bridges(spark, sf_dir):
    own = code(spark, sf_dir, "clang")
    typed = own.select(F.col("seed_no").alias("id"), F.explode(P.c_types(F.col("content"))).alias("name", "type"))
    return J.typed_bridges(own.selectExpr("seed_no AS id_lo", "seed_no + 4 AS id_hi"), typed)


@query(CODE + rf""", p AS ({C_PAIRS}), n AS (SELECT seed_no, list_distinct(list_concat(regexp_extract_all(content, '\b([A-Za-z_]\w*)\s*\([^;{{}}()]*\)\s*\{{', 1), regexp_extract_all(content, '\bstruct\s+([A-Za-z_]\w*)', 1))) AS names FROM code_seeds WHERE type = 'clang')
SELECT id_lo, id_hi, array_to_string(list_sort(list_intersect(a.names, b.names)), '|') AS conflicts FROM p JOIN n a ON a.seed_no = id_lo JOIN n b ON b.seed_no = id_hi""")
def j12_name_conflicts(spark, sf_dir):
    own = code(spark, sf_dir, "clang")
    names = own.select(F.col("seed_no").alias("id"), P.c_names(F.col("content")).alias("names"))
    return J.name_conflicts(own.selectExpr("seed_no AS id_lo", "seed_no + 4 AS id_hi"), names).withColumn("conflicts", joined("conflicts"))


@query(CODE + rf""", p AS ({C_PAIRS}), n AS (SELECT seed_no, content, list_distinct(list_concat(regexp_extract_all(content, '\b([A-Za-z_]\w*)\s*\([^;{{}}()]*\)\s*\{{', 1), regexp_extract_all(content, '\bstruct\s+([A-Za-z_]\w*)', 1))) AS names FROM code_seeds WHERE type = 'clang'),
x AS (SELECT id_lo, id_hi, list_sort(list_intersect(a.names, b.names)) AS c, b.content FROM p JOIN n a ON a.seed_no = id_lo JOIN n b ON b.seed_no = id_hi)
SELECT id_lo, id_hi, CASE WHEN len(c) = 0 THEN content ELSE regexp_replace(content, '\b(' || array_to_string(c, '|') || ')\b', '\1_b', 'g') END AS content FROM x""")
def j12_renamed(spark, sf_dir):
    """C seeds in pairs: the second, with what both define renamed."""
    own = code(spark, sf_dir, "clang")
    names = own.select(F.col("seed_no").alias("id"), P.c_names(F.col("content")).alias("names"))
    return J.without_conflicts(own.selectExpr("seed_no AS id_lo", "seed_no + 4 AS id_hi"), names, own.select(F.col("seed_no").alias("id"), "content")).drop("conflicts")


@query(CODE + rf", p AS ({C_PAIRS}), n AS (SELECT seed_no, unnest(regexp_extract_all(content, '\bstruct\s+([A-Za-z_]\w*)\s*\{{', 1)) AS name FROM code_seeds WHERE type = 'clang') SELECT id_lo, id_hi, a.name AS host, b.name AS donor FROM p JOIN n a ON a.seed_no = id_lo JOIN n b ON b.seed_no = id_hi WHERE a.name <> b.name")
def j16_declaration_pairs(spark, sf_dir):
    own = code(spark, sf_dir, "clang")
    heads = own.select(F.col("seed_no").alias("id"), F.explode(P.class_headers(F.col("content"))).alias("h"))
    return J.declaration_pairs(own.selectExpr("seed_no AS id_lo", "seed_no + 4 AS id_hi"), heads.select("id", F.col("h.name").alias("host")), heads.select("id", F.col("h.name").alias("donor"), F.col("h.template").alias("template")))




TYPED_MLIR = r"""SELECT seed_no, replace(replace(content, '(%a: i32)', concat('(%a: i32, %m: memref<4x', 'f', CASE WHEN seed_no % 4 < 2 THEN '32' ELSE '64' END, ', strided<[1], offset: 3>>, %t: tensor<2xindex>)')), 'func @g() {}', concat('func.func @g(%v: vector<', seed_no % 5 + 1, 'xi8>) -> (index, i', seed_no % 3 + 1, ') {}')) AS content FROM more_code WHERE type = 'mlir'"""


@query(cte("more_code") + f", t AS ({TYPED_MLIR})" + r""", y AS (SELECT seed_no, list_sort(list_distinct(['i32', 'memref<4x' || CASE WHEN seed_no % 4 < 2 THEN 'f32' ELSE 'f64' END || ', strided<[1], offset: 3>>', 'tensor<2xindex>', 'vector<' || seed_no % 5 + 1 || 'xi8>', 'index', 'i' || seed_no % 3 + 1])) AS types FROM t)
SELECT a.seed_no AS id_lo, b.seed_no AS id_hi, unnest(regexp_extract_all(c.content, 'func\.func @(\w+)', 1)) AS host, array_to_string(list_filter(b.types, lambda x: NOT list_contains(a.types, x)), '|') AS donor FROM y a JOIN y b ON b.seed_no = a.seed_no + 6 JOIN t c ON c.seed_no = a.seed_no WHERE len(list_filter(b.types, lambda x: NOT list_contains(a.types, x))) > 0""")
def j16_mlir_donors(spark, sf_dir):
    """MLIR seeds in pairs: the functions of the first, and the types in signatures of the second that the first has in none."""
    own = spark.sql("WITH more_code AS (SELECT * FROM {more_code}) " + escaped(TYPED_MLIR), more_code=view(spark, sf_dir, "more_code"))
    typed = own.select("seed_no", F.transform(P.mlir_signatures(F.col("content")), lambda s: s["name"]).alias("names"), P.mlir_donor_types(F.col("content")).alias("types"))
    a, b = typed.toDF("id_lo", "hosts", "host_types"), typed.select((F.col("seed_no") - 6).alias("id_lo"), F.col("seed_no").alias("id_hi"), F.col("types").alias("donor_types"))
    new = a.join(b, "id_lo").withColumn("new", F.array_except("donor_types", "host_types")).filter(F.size("new") > 0)
    return new.select("id_lo", "id_hi", F.explode("hosts").alias("host"), joined("new").alias("donor"))


TYPED_FORTRAN = r"""SELECT seed_no, concat('module m', chr(10), '  type :: Base', seed_no % 5, chr(10), '  end type', chr(10), '  TYPE, ', CASE WHEN seed_no % 4 < 2 THEN 'public' ELSE 'Extends (Other)' END, ' :: Child', seed_no % 7, chr(10), '  end type', chr(10), content) AS content FROM more_code WHERE type = 'flang'"""


@query(cte("more_code") + f", t AS ({TYPED_FORTRAN})" + r""", h AS (SELECT seed_no, unnest(CASE WHEN seed_no % 4 < 2 THEN ['Base' || seed_no % 5, 'Child' || seed_no % 7] ELSE ['Base' || seed_no % 5] END) AS host FROM t), d AS (SELECT seed_no, unnest(['Base' || seed_no % 5, 'Child' || seed_no % 7]) AS donor FROM t)
SELECT h.seed_no AS id_lo, d.seed_no AS id_hi, host, donor FROM h JOIN d ON d.seed_no = h.seed_no + 6 WHERE host <> donor""")
def j16_fortran_extends(spark, sf_dir):
    """Fortran seeds in pairs: types of the first that extend none yet, and types of the second."""
    own = spark.sql("WITH more_code AS (SELECT * FROM {more_code}) " + TYPED_FORTRAN, more_code=view(spark, sf_dir, "more_code"))
    heads = P.declaration_headers(F.col("content"), "flang")
    hosts = own.select(F.col("seed_no").alias("id"), F.explode(P.extendable(heads)).alias("h")).select("id", F.col("h.name").alias("host"))
    donors = own.select(F.col("seed_no").alias("id"), F.explode(heads).alias("h")).select("id", F.col("h.name").alias("donor"), F.lit(False).alias("template"))
    return J.declaration_pairs(own.selectExpr("seed_no AS id_lo", "seed_no + 6 AS id_hi"), hosts, donors)


@query(CODE + r""", l AS (SELECT seed_no - (seed_no // 4 % 2) * 4 AS pair, seed_no // 4 % 2 AS side, unnest([regexp_extract(content, 'mut (a\d)', 1), 's', 'z']) AS name, unnest(['i32', 'String', 'u8']) AS type, unnest([4, 5, 5]) AS line FROM code_seeds WHERE type = 'rust'), p AS (SELECT *, 2 * line + side AS place FROM l)
SELECT a.pair, a.name AS var_a, b.name AS var_b, a.type AS type_a, a.side = 0 AS first_to_second, a.type = 'String' AS needs_clone FROM p a JOIN p b ON a.pair = b.pair AND a.side <> b.side AND (a.type = 'String') = (b.type = 'String') AND a.place < b.place""")
def j10_ordered_bridges(spark, sf_dir):
    """Rust seeds in pairs whose lines alternate: which earlier variable of one may stand for a later one of the other."""
    own = code(spark, sf_dir, "rust").select("seed_no", F.posexplode(F.split("content", "\n")).alias("line", "text")).select("seed_no", "line", P.rust_profile(F.col("text"))["var_types"].alias("types"))
    side = F.floor(F.col("seed_no") / 4) % 2
    lets = own.select((F.col("seed_no") - side * 4).alias("pair"), side.alias("seed"), (2 * F.col("line") + side).alias("place"), F.explode("types").alias("name", "type"))
    return J.ordered_bridges(lets).select("pair", "var_a", "var_b", "type_a", (F.col("from_seed") == 0).alias("first_to_second"), "needs_clone")
