"""Queries over more languages and over scans of code, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as X
from ..functions import profiles as P
from ..functions import signatures as G
from ..functions import statements as S
from ..operators import grafts
from .views import cte, view

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Register a query and its SQL under its function's name."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


MORE = cte("more_code")
CODE = cte("code_seeds")


def more(spark, sf_dir, language):
    return view(spark, sf_dir, "more_code").filter(F.col("type") == language)


def code(spark, sf_dir):
    return view(spark, sf_dir, "code_seeds")


def joined(c):
    return F.array_join(c, "|")


def entries(c):
    """A map as sorted key:value texts."""
    return joined(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"]))))


# -- profiles -------------------------------------------------------------------------------------


@query(MORE + r""", p AS (SELECT seed_no, CAST(regexp_extract(printed, '(?m)^TYPES:(\{.*\})\s*$', 1) AS JSON) AS j FROM more_code), k AS (SELECT seed_no, j, unnest(json_keys(j)) AS k FROM p)
SELECT seed_no, k AS name, CASE WHEN json_type(j, '$.' || k) = 'ARRAY' THEN array_to_string(CAST(json_extract(j, '$.' || k) AS VARCHAR[]), '|') ELSE json_extract_string(j, '$.' || k) END AS types FROM k""")
def f4_python_probe(spark, sf_dir):
    return view(spark, sf_dir, "more_code").select("seed_no", F.explode(P.python_probe(F.col("printed"))).alias("name", "types")).withColumn("types", joined("types"))


@query(MORE + r""", p AS (SELECT seed_no, CAST(nullif(regexp_extract(printed, '__TYPES_START__(.*)__TYPES_END__', 1), '') AS JSON) AS j FROM more_code) SELECT seed_no, CASE WHEN j IS NOT NULL THEN json_keys(j)[1] || ':' || json_extract_string(j, '$.' || json_keys(j)[1]) END AS types FROM p""")
def f5_traced_types(spark, sf_dir):
    return view(spark, sf_dir, "more_code").select("seed_no", P.traced_types(F.col("printed")).alias("t")).select("seed_no", F.when(F.col("t").isNotNull(), entries("t")).alias("types"))


@query(MORE + r""", d AS (SELECT *, regexp_extract_all(content, '\bvar\s+([a-zA-Z_]\w*)\s+([a-zA-Z_][\w.]*)', 1) AS dn, regexp_extract_all(content, '\bvar\s+([a-zA-Z_]\w*)\s+([a-zA-Z_][\w.]*)', 2) AS dt,
  regexp_extract_all(content, '\b([a-zA-Z_]\w*)\s*:=\s*(?:([a-zA-Z_][\w.]*)\s*\(|(\d+(?:\.\d+)?)|")', 1) AS n, regexp_extract_all(content, '\b([a-zA-Z_]\w*)\s*:=\s*(?:([a-zA-Z_][\w.]*)\s*\(|(\d+(?:\.\d+)?)|")', 2) AS f, regexp_extract_all(content, '\b([a-zA-Z_]\w*)\s*:=\s*(?:([a-zA-Z_][\w.]*)\s*\(|(\d+(?:\.\d+)?)|")', 3) AS v FROM more_code WHERE type = 'go'),
e AS (SELECT *, list_concat(list_transform(list_zip(dn, dt), lambda x: x[1] || ':' || x[2]), list_transform(list_filter(list_zip(n, f, v), lambda x: NOT list_contains(dn, x[1])), lambda x: x[1] || ':' || CASE WHEN x[2] <> '' THEN x[2] WHEN contains(x[3], '.') THEN 'float64' WHEN x[3] <> '' THEN 'int' ELSE 'string' END)) AS t FROM d)
SELECT seed_no, array_to_string(list_sort(t), '|') AS types, array_to_string(regexp_extract_all(content, 'type\s+(\w+)\s+struct', 1), '|') AS structs, regexp_matches(content, '\[T comparable') AS generic, CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_count FROM e""")
def f6_go_profile(spark, sf_dir):
    rows = more(spark, sf_dir, "go").select("seed_no", P.go_profile(F.col("content")).alias("p"))
    return rows.select("seed_no", entries("p.var_types").alias("types"), joined("p.struct_names").alias("structs"), F.col("p.has_generics").alias("generic"), "p.line_count")


@query(MORE + r""", c AS (SELECT *, regexp_extract_all(content, 'arith\.constant\s+(\S+)\s*:\s*(\w+)', 1) AS v, regexp_extract_all(content, 'arith\.constant\s+(\S+)\s*:\s*(\w+)', 2) AS t FROM more_code WHERE type = 'mlir')
SELECT seed_no, array_to_string(regexp_extract_all(content, 'func\.func @([A-Za-z_]\w*)', 1), '|') AS functions, array_to_string(list_transform(list_zip(v, t), lambda x: x[1] || ':' || x[2]), '|') AS constants,
array_to_string(list_sort(list_distinct(regexp_extract_all(content, ':\s*(i\d+|f\d+|index|memref<[^>]+>)', 1))), '|') AS types, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '//')), '|') AS hints FROM c""")
def f7_mlir_profile(spark, sf_dir):
    rows = more(spark, sf_dir, "mlir").select("seed_no", "content", P.mlir_profile(F.col("content")).alias("p"))
    return rows.select("seed_no", joined("p.functions").alias("functions"), joined(F.transform("p.constants", lambda x: F.concat_ws(":", x["value"], x["type"]))).alias("constants"), joined(F.array_sort("p.types_used")).alias("types"), joined(P.mlir_hints(F.col("content"))).alias("hints"))


@query(MORE + r""", v AS (SELECT *, regexp_extract_all(content, '\bvar\s*(?:<[^>]+>)?\s+(\w+)\s*:\s*([A-Za-z_][\w<>, ]*?)(?:\s*=|\s*;)', 1) AS n, regexp_extract_all(content, '\bvar\s*(?:<[^>]+>)?\s+(\w+)\s*:\s*([A-Za-z_][\w<>, ]*?)(?:\s*=|\s*;)', 2) AS t FROM more_code WHERE type = 'wgsl')
SELECT seed_no, array_to_string(regexp_extract_all(content, 'fn (\w+)\s*\(', 1), '|') AS functions, array_to_string(regexp_extract_all(content, 'struct (\w+)', 1), '|') AS structs, array_to_string(list_sort(list_transform(list_zip(n, t), lambda x: x[1] || ':' || x[2])), '|') AS types FROM v""")
def f8_wgsl_profile(spark, sf_dir):
    rows = more(spark, sf_dir, "wgsl").select("seed_no", P.wgsl_profile(F.col("content")).alias("p"))
    return rows.select("seed_no", joined("p.functions").alias("functions"), joined("p.structs").alias("structs"), entries("p.var_types").alias("types"))


@query(MORE + r""", v AS (SELECT *, regexp_extract_all(content, '(?m)^\s*(?:var|let)\s+(\w+)(?:\s*:\s*\w+)?\s*=\s*(.+)$', 1) AS n, regexp_extract_all(content, '(?m)^\s*(?:var|let)\s+(\w+)(?:\s*:\s*\w+)?\s*=\s*(.+)$', 2) AS v FROM more_code WHERE type = 'swift')
SELECT seed_no, contains(content, '// RUN:') AS has_run, array_to_string(list_sort(list_transform(list_zip(n, v), lambda x: x[1] || ':' || CASE WHEN regexp_full_match(x[2], '\d+') THEN 'Int' WHEN starts_with(x[2], '"') THEN 'String' WHEN x[2] IN ('true', 'false') THEN 'Bool' WHEN starts_with(x[2], '[') THEN 'Array' ELSE 'Any' END)), '|') AS types FROM v""")
def f9_swift_profile(spark, sf_dir):
    rows = more(spark, sf_dir, "swift").select("seed_no", P.swift_profile(F.col("content")).alias("p"))
    return rows.select("seed_no", "p.has_run", entries("p.var_types").alias("types"))


@query(MORE + r""", l AS (SELECT seed_no, unnest(string_split(content, chr(10))) AS line FROM more_code WHERE type = 'flang'), d AS (SELECT seed_no, lower(regexp_extract(line, '^\s*(\w+(?:\(\d+\))?)', 1)) AS kind, unnest(string_split(regexp_extract(line, '::\s*([\w, ]+\w)', 1), ',')) AS name FROM l WHERE regexp_matches(line, '^\s*(integer|real|character)'))
SELECT seed_no, array_to_string(list_sort(list(upper(trim(name)) || ':' || kind)), '|') AS types FROM d GROUP BY seed_no""")
def f10_fortran_types(spark, sf_dir):
    return more(spark, sf_dir, "flang").select("seed_no", entries(P.fortran_types(F.regexp_replace("content", r"![^\n]*", ""))).alias("types"))


HASKELL = r"""h AS (SELECT *, regexp_replace(regexp_replace(content, '\{-#.*?#-\}', '', 'g'), '--[^\n]*|"[^"]*"', '', 'g') AS shadow FROM more_code WHERE type = 'haskell')"""


@query(MORE + ", " + HASKELL + r""" SELECT seed_no, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(shadow, '(?m)^([a-z_]\w*)\s*(?:::|[^=\n]*=)', 1), lambda x: x NOT IN ('module', 'import', 'main', 'data')), regexp_extract_all(shadow, '(?m)^data\s+(\w+)', 1)))), '|') AS names,
array_to_string(regexp_extract_all(shadow, '(\w+)\s*<-\s*newIORef', 1), '|') AS handles, array_to_string(regexp_extract_all(shadow, 'writeIORef\s+(\w+)', 1), '|') AS used, array_to_string(list_sort(regexp_extract_all(content, '(?m)^import .*$')), '|') AS imports, array_to_string(regexp_extract_all(content, '\{-#.*?#-\}'), '|') AS pragmas FROM h""")
def f11_haskell_profile(spark, sf_dir):
    def parts(text: str) -> list[str]:
        p = S.haskell_profile(text)
        return ["|".join(x) for x in (p["toplevel_names"], [h["name"] for h in p["state_handles"]], p["state_used"], p["imports"], p["pragmas"])]

    rows = more(spark, sf_dir, "haskell").select("seed_no", "content")
    rows = X.scanned(rows, p=(X.Scan(parts, "array<string>", X.WORDS), "content"))
    return rows.select("seed_no", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("names", "handles", "used", "imports", "pragmas"))))


@query(MORE + r"""SELECT seed_no, regexp_replace(coloured, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g') AS plain FROM more_code""")
def f21_strip_ansi(spark, sf_dir):
    return view(spark, sf_dir, "more_code").select("seed_no", G.strip_ansi(F.col("coloured")).alias("plain"))


@query(MORE + r"""SELECT seed_no, replace(array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(trim(x), '^// (RUN:|CHECK-NEXT:)')), chr(10)), chr(10) || 'func @', chr(10) || 'func.func @') AS cleaned FROM more_code WHERE type = 'mlir'
UNION ALL SELECT -p_partkey, chr(10) || '$a = ' || p_size || ';' || CASE WHEN p_size % 2 = 0 THEN chr(10) ELSE '' END || chr(10) FROM part""")
def f22_clean_code(spark, sf_dir):
    php = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("-p_partkey AS seed_no", "concat('<?php', chr(10), '$a = ', p_size, ';', CASE WHEN p_size % 2 = 0 THEN concat(chr(10), 'goto x;') ELSE '' END, chr(10), '?>', chr(10), '===DONE===') AS content")
    return more(spark, sf_dir, "mlir").select("seed_no", P.clean_mlir(F.col("content")).alias("cleaned")).unionByName(php.select("seed_no", P.clean_php(F.col("content")).alias("cleaned")))


@query(cte("more_code", "code_seeds") + "SELECT seed_no, type, CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_count FROM (SELECT seed_no, content, type FROM more_code UNION ALL SELECT seed_no, content, type FROM code_seeds) WHERE type IN ('go', 'mlir', 'wgsl', 'haskell', 'cpython', 'rust')")
def u1_u2_profilers(spark, sf_dir):
    """Each language's profiler by its name; Haskell has none, so the generic one is taken."""
    both = view(spark, sf_dir, "more_code").select("seed_no", "content", "type").unionByName(code(spark, sf_dir).select("seed_no", "content", "type"))
    out = None
    for name in ("go", "MLIR", "wgsl", "haskell", "cpython", "rust"):
        own = P.profile_seeds(both, name).select("seed_no", "type", "profile.line_count")
        out = own if out is None else out.unionByName(own)
    return out


@query(cte("more_code") + r""", x AS (SELECT seed_no, string_split('import Foo' || seed_no % 5 || chr(10) || content || chr(10) || '  import Bar ' || chr(10) || 'important()', chr(10)) AS ls FROM more_code WHERE type = 'swift')
SELECT seed_no, array_to_string(list_transform(list_filter(ls, lambda l: starts_with(trim(l), 'import ')), lambda l: trim(l)), '|') AS imports, array_to_string(list_filter(ls, lambda l: NOT starts_with(trim(l), 'import ')), chr(10)) AS body FROM x""")
def f23_swift_imports(spark, sf_dir):
    text = F.concat(F.lit("import Foo"), (F.col("seed_no") % 5).cast("string"), F.lit("\n"), "content", F.lit("\n  import Bar \nimportant()"))
    return more(spark, sf_dir, "swift").select("seed_no", P.split_swift_imports(text).alias("p")).select("seed_no", F.array_join("p.imports", "|").alias("imports"), "p.body")


@query(cte("more_code", "code_seeds") + r""" SELECT seed_no, ['c', 'cpp', 'objc'][seed_no % 3 + 1] AS type, CASE WHEN regexp_matches(content, '\b(?:class|struct|union|enum)\s+[A-Za-z_]\w*') THEN 'declares' ELSE '' END AS said FROM (SELECT seed_no, CASE WHEN seed_no % 5 = 0 THEN replace(content, 'struct', 'strict') ELSE content END AS content FROM code_seeds WHERE type = 'clang')
UNION ALL SELECT seed_no, ['naga', 'wgslc'][seed_no % 2 + 1], array_to_string(regexp_extract_all(content, 'fn\s+(\w+)', 1), '|') || ';' || regexp_extract(content, 'struct\s+(\w+)', 1) FROM more_code WHERE type = 'wgsl'""")
def u2_more_profilers(spark, sf_dir):
    """Seeds under the names of dialects and tools that share a profiler."""
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("seed_no") % len(names)).cast("int")).alias("type")
    c = code(spark, sf_dir).filter("type = 'clang'").select("seed_no", F.when(F.col("seed_no") % 5 == 0, F.replace("content", F.lit("struct"), F.lit("strict"))).otherwise(F.col("content")).alias("content"), pick("c", "cpp", "objc"))
    w = more(spark, sf_dir, "wgsl").select("seed_no", "content", pick("naga", "wgslc"))
    said = [P.profile_seeds(c, t).select("seed_no", "type", F.when(F.col("profile.has_declaration"), "declares").otherwise("").alias("said")) for t in ("c", "CPP", "objc")]
    said += [P.profile_seeds(w, t).select("seed_no", "type", F.concat_ws(";", F.array_join("profile.functions", "|"), F.array_join("profile.structs", "|")).alias("said")) for t in ("naga", "wgslc")]
    return reduce(DataFrame.unionByName, said)


@query(cte("more_code") + """, m AS (SELECT seed_no, p FROM (SELECT seed_no, map {'a': 'x', 'k' || seed_no % 3: 's'} AS p FROM more_code)) SELECT seed_no, array_to_string(list_sort(list_concat(['a:x'], CASE WHEN seed_no % 4 = 0 THEN ['k' || seed_no % 3 || ':s'] WHEN seed_no % 3 = 1 THEN ['k1:d'] ELSE ['k' || seed_no % 3 || ':s', 'k1:d'] END)), '|') AS merged FROM m""")
def u4_merged(spark, sf_dir):
    static = F.create_map(F.lit("a"), F.lit("x"), F.concat(F.lit("k"), F.col("seed_no") % 3), F.lit("s"))
    dynamic = F.when(F.col("seed_no") % 4 != 0, F.create_map(F.lit("k1"), F.lit("d")))
    return view(spark, sf_dir, "more_code").select("seed_no", entries(P.merged(static, dynamic)).alias("merged"))


# -- scans ----------------------------------------------------------------------------------------

#: The code of each line: without comments and strings, whose signs these texts have in few forms.
LINES = CODE + r""", l AS (SELECT seed_no, type, i - 1 AS i, line, CASE type WHEN 'cpython' THEN regexp_replace(line, '#.*|"[^"]*"', '', 'g') ELSE regexp_replace(line, '//.*', '') END AS code
  FROM (SELECT seed_no, type, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM code_seeds)) """


@query(LINES + "SELECT seed_no, string_agg(code, chr(10) ORDER BY i) AS code FROM l GROUP BY seed_no")
def x1_code_only(spark, sf_dir):
    return X.scanned(code(spark, sf_dir).select("seed_no", "content", "type"), code=("code", "content", "type")).select("seed_no", "code")


@query(CODE + r"""SELECT seed_no, regexp_replace(regexp_replace(content, '#[^\n]*', ' ', 'g'), '"[^"\n]*"', ' ', 'g') AS bare FROM code_seeds WHERE type = 'cpython'""")
def x2_strip_python(spark, sf_dir):
    return code(spark, sf_dir).filter("type = 'cpython'").select("seed_no", P.strip_python(F.col("content")).alias("bare"))


@query(MORE + r"""SELECT seed_no, regexp_replace(regexp_replace(regexp_replace(content, '\{-#[^}]*\}', repeat(' ', length(regexp_extract(content, '\{-#[^}]*\}', 0)))), '"[^"]*"', repeat(' ', length(regexp_extract(content, '"[^"]*"', 0)))), '--[^\n]*', repeat(' ', length(regexp_extract(content, '--[^\n]*', 0)))) AS shadow FROM more_code WHERE type = 'haskell'""")
def x3_haskell_shadow(spark, sf_dir):
    return X.scanned(more(spark, sf_dir, "haskell").select("seed_no", "content"), shadow=(X.Scan(S.haskell_shadow, "string", pa.string()), "content")).select("seed_no", "shadow")


#: Names that live at each line: in Python and PHP until the next unit, else until the block around the declaration closes.
LIVE = LINES + r""", b AS (SELECT *, CASE type WHEN 'cpython' THEN regexp_matches(line, '^(def|class) ') WHEN 'php' THEN regexp_matches(line, '^\s*function ') ELSE false END AS resets,
  CASE type WHEN 'cpython' THEN regexp_extract_all(code, '^\s*([A-Za-z_]\w*)\s*=', 1) WHEN 'php' THEN regexp_extract_all(code, '\$([A-Za-z_]\w*)\s*=', 1) WHEN 'rust' THEN regexp_extract_all(code, '\blet\s+(?:mut\s+)?([A-Za-z_]\w*)', 1) ELSE regexp_extract_all(code, '\b(?:int|long)\s+([A-Za-z_]\w*)\s*(?:=|;|,|\))', 1) END AS names,
  CASE WHEN type IN ('rust', 'clang') THEN length(regexp_replace(code, '[^{]', '', 'g')) - length(regexp_replace(code, '[^}]', '', 'g')) ELSE 0 END AS net FROM l),
s AS (SELECT *, sum(net) OVER w AS depth, sum(net) OVER w - net AS before, sum(CASE WHEN resets THEN 1 ELSE 0 END) OVER w AS unit FROM b WINDOW w AS (PARTITION BY seed_no ORDER BY i ROWS UNBOUNDED PRECEDING)),
n AS (SELECT seed_no, i, unit, before, unnest(names) AS name FROM s),
v AS (SELECT s.seed_no, s.i, s.line, s.code, s.type, CAST(count(DISTINCT n.name) AS INTEGER) AS live FROM s LEFT JOIN n ON n.seed_no = s.seed_no AND n.i <= s.i AND n.unit = s.unit AND NOT EXISTS (SELECT 1 FROM s z WHERE z.seed_no = s.seed_no AND z.i >= n.i AND z.i < s.i AND z.depth < n.before) GROUP BY ALL)
"""


@query(LIVE + "SELECT seed_no, string_agg(CAST(live AS VARCHAR), ',' ORDER BY i) AS counts FROM v GROUP BY seed_no")
def x4_live_counts(spark, sf_dir):
    rows = X.scanned(code(spark, sf_dir).select("seed_no", "content", "type"), counts=("live_counts", "content", "type"))
    return rows.select("seed_no", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


#: Safe lines: blank, or at least half of their letters are code.
POINTS = LIVE + r""", p AS (SELECT *, max(live) OVER (PARTITION BY seed_no) AS most FROM v WHERE NOT (trim(line) <> '' AND length(code) < length(trim(line)) / 2)), q AS (SELECT seed_no, CAST(i AS INTEGER) AS line_idx, 'live' || most AS category, regexp_extract(line, '^[ \t]*', 0) AS indent FROM p WHERE live = most AND most > 0)"""


@query(POINTS + " SELECT * FROM q")
def x5_complex_states(spark, sf_dir):
    return states(spark, sf_dir).select("seed_no", F.explode("p").alias("p")).select("seed_no", "p.line_idx", "p.category", "p.indent")


def states(spark, sf_dir):
    return X.scanned(code(spark, sf_dir).select("seed_no", "content", "type"), p=("complex_states", "content", "type"))


@query(POINTS + ", g AS (SELECT seed_no, list(line_idx ORDER BY line_idx) AS places FROM q GROUP BY seed_no) SELECT seed_no, places[CAST('0x' || left(md5('4|' || seed_no), 8) AS BIGINT) % len(places) + 1] AS line_idx FROM g")
def x6_pick_point(spark, sf_dir):
    return states(spark, sf_dir).filter(F.size("p") > 0).select("seed_no", X.pick_point(F.col("p"), 4, F.col("seed_no"))["line_idx"].alias("line_idx"))


@query(cte("code_seeds") + r""", l AS (SELECT seed_no, string_split(content, chr(10)) AS ls, CASE seed_no % 3 WHEN 1 THEN [7, 8] WHEN 2 THEN [] END AS cached FROM code_seeds WHERE type = 'cpython'), d AS (SELECT *, CAST('0x' || left(md5('4|' || seed_no), 8) AS BIGINT) AS d, CAST('0x' || left(md5('6|' || seed_no), 8) AS BIGINT) AS e FROM l)
SELECT seed_no, CAST(e % len(ls) AS INTEGER) AS any_line, regexp_extract(ls[e % len(ls) + 1], '^[ \t]*', 0) AS indent, CAST(CASE WHEN len(cached) > 0 THEN cached[d % 2 + 1] WHEN cached IS NULL THEN 1 + d % 1 END AS INTEGER) AS line_idx FROM d""")
def x6_any_and_cached_points(spark, sf_dir):
    """Any line of Python seeds, and a point where some have cached ones, or none."""
    rows = states(spark, sf_dir).filter("type = 'cpython'")
    point = lambda i: F.struct(F.lit(i).alias("line_idx"), F.lit("").alias("category"), F.lit("").alias("matched_text"), F.lit("").alias("indent"))
    cached = F.when(F.col("seed_no") % 3 == 1, F.array(point(7), point(8))).when(F.col("seed_no") % 3 == 2, F.array().cast(f"array<{X.POINT}>"))
    some, least = X.any_point(F.col("content"), 6, F.col("seed_no")), F.slice("p", 1, 1)
    return rows.select("seed_no", some["line_idx"].alias("any_line"), some["indent"].alias("indent"), X.pick_point(least, 4, F.col("seed_no"), cached)["line_idx"].alias("line_idx"))


@query(POINTS + r""", g AS (SELECT seed_no, list({'i': line_idx, 'c': category, 't': indent} ORDER BY line_idx) AS ps FROM q GROUP BY seed_no),
r AS (SELECT seed_no, type, list(CASE WHEN type = 'php' AND i = 0 THEN '' ELSE line END ORDER BY i) AS ls FROM s WHERE type IN ('clang', 'php') GROUP BY seed_no, type),
d AS (SELECT r.*, ps[CAST('0x' || left(md5('4|' || seed_no), 8) AS BIGINT) % len(ps) + 1] AS h, ps[CAST('0x' || left(md5('5|' || seed_no), 8) AS BIGINT) % len(ps) + 1].i + 1 AS b FROM r JOIN g USING (seed_no)),
u AS (SELECT d.*, coalesce((SELECT min(y.i) FROM s x JOIN s y ON y.seed_no = x.seed_no AND y.i >= x.i AND y.depth < x.before WHERE x.seed_no = d.seed_no AND x.i = d.b), len(ls)) AS e FROM d),
k AS (SELECT a.seed_no AS id_lo, a.seed_no + 4 AS id_hi, unnest(['ab', 'ba']) AS direction, unnest([a.seed_no, a.seed_no + 4]) AS h, unnest([a.seed_no + 4, a.seed_no]) AS o FROM u a WHERE a.seed_no + 4 IN (SELECT seed_no FROM u))
SELECT id_lo, id_hi, direction, a.h.c AS category, array_to_string(list_concat(list_concat(a.ls[: a.h.i + 1], list_transform(z.ls[z.b + 1 : z.e], lambda x, n: CASE WHEN a.h.t <> '' AND trim(x) <> '' THEN a.h.t || ltrim(x) ELSE x END || CASE WHEN n = 1 THEN '  // state' ELSE '' END)), a.ls[a.h.i + 2 :]), chr(10)) AS grafted FROM k JOIN u a ON a.seed_no = k.h JOIN u z ON z.seed_no = k.o""")
def j13_whole_grafts(spark, sf_dir):
    """C and PHP seeds in pairs, both ways: the lines behind a point of one, up to where they would close a bracket, behind a point of the other."""
    out = []
    for language in ("clang", "php"):
        own = code(spark, sf_dir).filter(F.col("type") == language).select(F.col("seed_no").alias("id"), "content")
        points = grafts.splice_points(own, language, 4)
        out.append(grafts.grafts(own.selectExpr("id AS id_lo", "id + 4 AS id_hi"), points, "// state"))
    return out[0].unionByName(out[1])


@query(LIVE + ", e AS (SELECT a.seed_no, min(b.i) AS at FROM s a JOIN s b ON a.seed_no = b.seed_no AND a.i = 2 AND b.i >= 2 AND b.depth < a.before WHERE a.type IN ('rust', 'clang') GROUP BY 1) SELECT c.seed_no, CAST(coalesce(e.at, c.n) AS INTEGER) AS line FROM (SELECT seed_no, count(*) AS n FROM s WHERE type IN ('rust', 'clang') GROUP BY 1) c LEFT JOIN e ON e.seed_no = c.seed_no")
def x7_balanced_end(spark, sf_dir):
    """Where a continuation from the third line closes a bracket that it did not open."""
    rows = code(spark, sf_dir).filter("type IN ('rust', 'clang')").select("seed_no", "content", "type", F.lit(2).alias("start"))
    return X.scanned(rows, line=("balanced_end", "content", "type", "start")).select("seed_no", "line")


# -- signatures -----------------------------------------------------------------------------------


@query(cte("more_runs") + r""", t AS (SELECT *, stderr || stdout AS b, stderr || chr(10) || stdout AS c FROM more_runs), g AS (SELECT *,
  CASE project
    WHEN 'swift' THEN coalesce(nullif(trim(regexp_extract(stderr, 'SUMMARY: AddressSanitizer:\s+([^\n]*)', 1)), ''), nullif(trim(regexp_extract(stderr, '(Assertion failed: [^\n]*)', 1)), ''), nullif(trim(regexp_extract(stderr, '\d+\.\s+(While evaluating request [^(]*)', 1)), ''))
    WHEN 'haskell' THEN coalesce('ghc panic: ' || nullif(trim(regexp_extract(c, 'ghc: panic! \(the .impossible. happened\)([^\n]*(?:\n[^\n]*){0,3})', 1), ' ' || chr(10) || chr(9)), ''), 'GHC internal error: ' || nullif(regexp_extract(c, 'GHC internal error:\s*([^\n]+)', 1), ''), nullif(regexp_extract(c, '(RTS invariant[^\n]*)', 1), ''), nullif(regexp_extract(c, '(ASSERT failed![^\n]*)', 1), ''), CASE WHEN contains(c, 'Segmentation fault') THEN 'ghc: Segmentation fault' WHEN contains(lower(c), 'out of memory') THEN 'ghc: out of memory' END)
    WHEN 'flang' THEN coalesce('UBSAN: ' || nullif(trim(regexp_extract(b, 'SUMMARY: UndefinedBehaviorSanitizer:\s+([^\n]+)', 1)), ''), 'LLVM ERROR: ' || nullif(trim(regexp_extract(b, 'LLVM ERROR:\s+([^\n]+)', 1)), ''), CASE WHEN contains(b, 'Stack dump:') THEN 'Stack dump: ' || regexp_extract(b, '(?m)^1\.\t(.+)$', 1) || ' [' || regexp_extract(b, '(Fortran::lower::f\d)', 1) || ' > main]' END, CASE WHEN contains(b, 'Aborted') THEN 'Aborted' WHEN contains(b, 'Segmentation fault') THEN 'Segmentation fault' END)
    ELSE coalesce(CASE WHEN contains(b, 'Internal Compiler Error') THEN 'ICE: ' || regexp_extract(b, '\n(\w+: f\d)', 1) END, CASE WHEN contains(b, 'Segfault: Signal') THEN 'SIGSEGV [' || regexp_extract(b, ', in (LCompilers::\w+)', 1) || ']' END, 'terminate: ' || nullif(regexp_extract(b, 'an instance of .(std::E\d)', 1), ''), 'runtime_error: ' || nullif(regexp_extract(b, 'runtime_error:\s*([^\n]+)', 1), ''), CASE WHEN contains(b, 'Unknown Exception') THEN 'Unknown Exception' END) END AS own FROM t)
SELECT run_id, project, own AS signature FROM g WHERE own IS NOT NULL""")
def g5_g8_signatures(spark, sf_dir):
    """The cascades of Swift, Haskell, Flang and LFortran, where they find anything."""
    runs = view(spark, sf_dir, "more_runs")
    own = F.lit(None).cast("string")
    for name in ("swift", "haskell", "flang", "lfortran"):
        own = F.when(F.col("project") == name, G.CASCADES[name](F.col("stdout"), F.col("stderr"))).otherwise(own)
    return runs.select("run_id", "project", F.nullif(own, F.lit("")).alias("signature")).filter("signature IS NOT NULL")
