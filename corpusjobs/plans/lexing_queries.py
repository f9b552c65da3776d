"""Queries over scans of source text, with the SQL that DuckDB checks them by, or plain forms in the tests where SQL cannot express them."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as X
from ..functions import mutations as M
from ..functions import profiles as P
from ..functions import statements as S
from ..operators import bridges, diverse, mutants, pairing
from ..operators.tables import cut
from .views import cte, view

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def code(spark, sf_dir):
    return view(spark, sf_dir, "code_seeds")


@query(cte("code_seeds") + r"""SELECT seed_no, CASE type WHEN 'php' THEN '$b|' || regexp_extract(content, '(\$a\d)', 1) || '|$c'
  ELSE regexp_extract(content, 'struct (\w+)', 1) || '|a;' || regexp_extract(content, 'int (g\d)', 1) || '|x|y' || CASE WHEN regexp_extract(content, 'int (g\d)', 1) = regexp_extract(content, '\+ (g\d)', 1) THEN '' ELSE '|' || regexp_extract(content, '\+ (g\d)', 1) END END AS groups FROM code_seeds WHERE type IN ('clang', 'php')""")
def x8_same_line_groups(spark, sf_dir):
    rows = X.scanned(code(spark, sf_dir).filter("type IN ('clang', 'php')").select("seed_no", "content", "type"), groups=("same_line_groups", "content", "type"))
    return rows.select("seed_no", joined_groups())


def joined_groups():
    return F.array_join(F.transform("groups", lambda g: F.array_join(g, "|")), ";").alias("groups")


@query(cte("more_code") + r""", f AS (SELECT seed_no, 'P' || regexp_extract(content, 'program p(\d)', 1) AS p, regexp_extract(content, 'integer :: a, b(\d)', 1) AS b, regexp_extract(content, ':: C(\d)', 1) AS c FROM more_code WHERE type = 'flang')
SELECT seed_no, unnest([false, true]) AS fixed_form, unnest([p || ';A|B' || b || ';C' || c || ';S|A2|X;C|NOTE', p || ';A|B' || b || ';C' || c || ';S|A2|X']) AS groups FROM f""")
def x8_fortran_groups(spark, sf_dir):
    """Fortran seeds with lines that join strings, hold exclamation marks in comments and begin with a C, read in both forms."""
    more = F.concat("content", F.lit("\n  s = a2 // 'x! y'\nC note = 1 ! d = e"))
    rows = view(spark, sf_dir, "more_code").filter("type = 'flang'").select("seed_no", more.alias("content"), "type", F.explode(F.array(F.lit(False), F.lit(True))).alias("fixed_form"))
    return X.scanned(rows, groups=("same_line_groups", "content", "type", "fixed_form")).select("seed_no", "fixed_form", joined_groups())


@query(cte("code_seeds") + r"""SELECT seed_no, regexp_extract(content, 'return (v\d) \+ (w\d)', 1) || '|' || regexp_extract(content, 'return (v\d) \+ (w\d)', 2) AS groups FROM code_seeds WHERE type = 'cpython'""")
def x9_python_groups(spark, sf_dir):
    return X.scanned(code(spark, sf_dir).filter("type = 'cpython'").select("seed_no", "content"), groups=("python_groups", "content")).select("seed_no", joined_groups())


#: Every document twice, every other one with a crash between; of texts over 1,500 characters 2 lines before the crash and 4 from it are kept, or the last 4.
LONG = "SELECT doc_id, concat(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN 'x Segmentation fault' ELSE 'none' END, chr(10), text) AS said FROM documents"


def truncated_sql(source: str, key: str) -> str:
    """The SQL of truncation with these bounds over (key, said)."""
    return f"""o AS ({source}), r AS (SELECT *, CASE WHEN said LIKE '%' || chr(10) THEN string_split(said, chr(10))[:-2] ELSE string_split(said, chr(10)) END AS rows FROM o),
p AS (SELECT *, len(rows) AS n, list_position(list_transform(rows, lambda x: contains(x, 'Segmentation fault')), true) AS place FROM r),
q AS (SELECT *, greatest(place - 3, 0) AS first, least(place + 3, n) AS last FROM p)
SELECT {key}, CASE WHEN length(said) <= 1500 THEN said
  WHEN place IS NULL OR place = 0 THEN CASE WHEN n <= 4 THEN said ELSE '[... ' || format('{{:,}}', n - 4) || ' lines / ' || format('{{:,}}', length(said) - list_sum(list_transform(rows[-4:], lambda x: length(x) + 1))::BIGINT) || ' bytes of output truncated — no crash signature found; showing tail ...]' || chr(10) || array_to_string(rows[-4:], chr(10)) END
  ELSE CASE WHEN first > 0 THEN '[... ' || format('{{:,}}', first) || ' lines / ' || format('{{:,}}', list_sum(list_transform(rows[:first], lambda x: length(x) + 1))::BIGINT) || ' bytes of output truncated before crash signature ...]' || chr(10) ELSE '' END
    || array_to_string(rows[first + 1 : last], chr(10)) || CASE WHEN last < n THEN chr(10) || '[... ' || format('{{:,}}', n - last) || ' more lines truncated after crash report ...]' ELSE '' END END AS shown FROM q"""


@query("WITH " + truncated_sql(LONG, "doc_id"))
def f14_truncated_output(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = spark.sql(f"WITH documents AS (SELECT * FROM {{documents}}) {LONG}", documents=documents)
    return said.select("doc_id", X.truncated(F.col("said"), 1500, 2, 4).alias("shown"))


@query("WITH " + truncated_sql("SELECT doc_id, rtrim(text, chr(10)) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'y Segmentation fault' || chr(10) ELSE '' END AS said FROM documents WHERE text <> ''", "doc_id"))
def s14_truncated_bundle(spark, sf_dir):
    """Documents as stderr, a crash as some stdout."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text <> ''")
    out = F.when(F.col("doc_id") % 3 == 0, "y Segmentation fault\n\n").otherwise("")
    return documents.select("doc_id", X.bundled(F.col("text"), out, 1500, 2, 4).alias("shown"))


@query(cte("code_seeds") + """, p AS (SELECT a.seed_no AS id_lo, b.seed_no AS id_hi, string_split(a.content, chr(10)) AS h, string_split(b.content, chr(10)) AS d FROM code_seeds a JOIN code_seeds b ON b.seed_no = a.seed_no + 4 WHERE a.type = 'clang')
SELECT id_lo, id_hi, array_to_string(list_concat(list_concat(h[1:3], list_transform(d[3:], lambda x, i: '  ' || ltrim(x) || CASE WHEN i = 1 THEN '  // state fusion' ELSE '' END)), h[4:]), chr(10)) AS grafted FROM p""")
def j13_graft(spark, sf_dir):
    """C seeds in pairs: what follows line 1 of the second goes behind line 2 of the first."""
    own = code(spark, sf_dir).filter("type = 'clang'").select("seed_no", "content")
    pairs = own.selectExpr("seed_no AS id_lo", "seed_no + 4 AS id_hi", "content AS a").join(own.selectExpr("seed_no AS id_hi", "content AS b"), "id_hi")
    put = X.graft(F.col("a"), F.col("b"), F.lit(2), F.lit("  "), F.lit(1), F.lit("// state fusion"))
    return pairs.select("id_lo", "id_hi", put.alias("grafted"))


@query()
def d4_select_diverse(spark, sf_dir):
    rows = view(spark, sf_dir, "seeds").select(F.col("seed_no").alias("id"), "content")
    return diverse.select_diverse(rows, 20, 5)


PHP_NAMES = X.Scan(lambda s: list(S.php_defines_uses(s, P.PHP_SKIP)), "array<array<string>>", X.GROUPS)


@query(cte("code_seeds") + r""", p AS (SELECT seed_no, content, regexp_extract(content, '(\$a\d)', 1) AS a, regexp_extract(content, 'function (h\d)', 1) AS h FROM code_seeds WHERE type = 'php')
SELECT seed_no, unnest([0, 1, 2]) AS unit, unnest(['<?php' || chr(10) || a || ' = 1;', '$b = ' || a || ' + 2;', '// $c' || chr(10) || 'function ' || h || '() { return $b; }']) AS statement, unnest([a, '$b', h]) AS defines, unnest([a, a || '|$b', '$b|$c|' || h]) AS uses FROM p""")
def x10_x11_php_statements(spark, sf_dir):
    own = X.scanned(code(spark, sf_dir).filter("type = 'php'").select("seed_no", "content"), statements=(X.Scan(S.php_statements, "array<string>", X.WORDS), "content"))
    units = own.select("seed_no", F.posexplode("statements").alias("unit", "statement"))
    return X.scanned(units, names=(PHP_NAMES, "statement")).select("seed_no", "unit", "statement", F.array_join(F.get("names", F.lit(0)), "|").alias("defines"), F.array_join(F.get("names", F.lit(1)), "|").alias("uses"))


@query(cte("code_seeds") + r"""SELECT seed_no, unnest([0, 1, 2]) AS unit, unnest([regexp_extract(content, '^(struct [^}]*\})', 1), ';', regexp_extract(content, '(int g[\s\S]*\})', 1)]) AS statement,
unnest([regexp_extract(content, 'struct (\w+)', 1), '', regexp_extract(content, 'int (g\d)', 1) || '|y']) AS defines, unnest([regexp_extract(content, 'struct (\w+)', 1), '', regexp_extract(content, 'int (g\d)', 1)]) AS shared,
unnest([array_to_string(list_sort([regexp_extract(content, 'struct (\w+)', 1), 'a']), '|'), '', array_to_string(list_sort(list_distinct([regexp_extract(content, 'int (g\d)', 1), regexp_extract(content, '\+ (g\d)', 1), 'x', 'y', 'z'])), '|')]) AS uses FROM code_seeds WHERE type = 'clang'""")
def x10_x11_c_statements(spark, sf_dir):
    own = X.scanned(code(spark, sf_dir).filter("type = 'clang'").select("seed_no", "content"), statements=(X.Scan(S.c_statements, "array<string>", X.WORDS), "content"))
    units = own.select("seed_no", F.posexplode("statements").alias("unit", "statement"))
    return named(units, lambda s: list(S.c_defines_uses(s, P.C_KEYWORDS)))


def named(units, parts):
    """units with what each statement defines, shares and uses."""
    return X.scanned(units, names=(X.Scan(parts, "array<array<string>>", X.GROUPS), "statement")).select("seed_no", "unit", "statement", *(F.array_join(F.get("names", F.lit(i)), "|").alias(n) for i, n in enumerate(("defines", "shared", "uses"))))


FORTRAN = cte("more_code") + r""", l AS (SELECT seed_no, line, unit FROM (SELECT seed_no, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS unit FROM more_code WHERE type = 'flang')),
u AS (SELECT seed_no, unit, line AS statement, CASE WHEN line LIKE 'program %' THEN [upper(regexp_extract(line, '^program (\w+)', 1))] WHEN contains(line, '::') THEN list_transform(string_split(regexp_extract(line, ':: ([\w, ]*\w)', 1), ','), lambda x: upper(trim(x))) WHEN contains(line, '=') THEN ['A'] ELSE [] END AS d,
  list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(line, '\b([A-Za-z_]\w*)\b', 1), lambda x: upper(x)), lambda x: x NOT IN ('PROGRAM', 'END', 'INTEGER', 'REAL', 'INTENT', 'IN', 'CHARACTER')))) AS s FROM l)
"""


@query(FORTRAN + "SELECT seed_no, unit, statement, array_to_string(list_sort(d), '|') AS defines, CASE WHEN statement LIKE 'program %' THEN d[1] ELSE '' END AS shared, array_to_string(s, '|') AS uses FROM u")
def x10_x11_fortran_statements(spark, sf_dir):
    return named(fortran_units(spark, sf_dir), lambda s: list(S.fortran_defines_uses(s)))


def fortran_units(spark, sf_dir):
    own = X.scanned(view(spark, sf_dir, "more_code").filter("type = 'flang'").select("seed_no", "content"), statements=(X.Scan(S.fortran_statements, "array<string>", X.WORDS), "content"))
    return own.select("seed_no", F.posexplode("statements").alias("unit", "statement"))


@query(FORTRAN + """, e AS (SELECT b.seed_no, b.unit AS later, a.unit AS earlier FROM u a JOIN u b ON a.seed_no = b.seed_no AND a.unit <> b.unit AND list_has_any(a.d, b.s)) SELECT seed_no, later, earlier FROM e UNION SELECT seed_no, unit, unit - 1 FROM u WHERE unit > 0""")
def j14_fortran_edges(spark, sf_dir):
    """What each statement of a Fortran seed must follow: what it uses, and within a unit the statement before it."""
    units = fortran_units(spark, sf_dir)
    names, kind = X.Scan(lambda s: list(S.fortran_defines_uses(s)), "array<array<string>>", X.GROUPS), X.Scan(S.fortran_kind, "string", pa.string())
    rows = X.scanned(units, names=(names, "statement"), kind=(kind, "statement")).select(F.col("seed_no").alias("pair"), F.col("seed_no").alias("seed"), "unit", *(F.get("names", F.lit(i)).alias(n) for i, n in enumerate(("defines", "shared", "uses"))), F.when(F.col("kind") == "unit_open", 1).when(F.col("kind") == "unit_close", -1).otherwise(0).alias("opens"))
    return pairing.statement_edges(rows).unionByName(pairing.unit_order_edges(rows)).distinct().select(F.col("pair").alias("seed_no"), "later", "earlier")


@query(cte("code_seeds") + r""", p AS (SELECT seed_no, seed_no - seed_no % 8 AS pair, regexp_extract(content, '(\$a\d)', 1) AS a, regexp_extract(content, 'function (h\d)', 1) AS h FROM code_seeds WHERE type = 'php'),
u AS (SELECT pair, seed_no, seed_no * 100 + unnest([0, 1, 2]) AS unit, unnest([a, '$b', h]) AS made, unnest([[a], [a, '$b'], ['$b', '$c', h]]) AS uses FROM p)
SELECT DISTINCT y.pair, y.unit AS later, x.unit AS earlier FROM u x JOIN u y ON x.pair = y.pair AND x.unit <> y.unit AND list_contains(y.uses, x.made) AND (x.seed_no = y.seed_no OR NOT starts_with(x.made, '$'))""")
def j14_statement_edges(spark, sf_dir):
    """PHP seeds in pairs: which of their statements must follow which."""
    own = X.scanned(code(spark, sf_dir).filter("type = 'php'").select("seed_no", "content"), statements=(X.Scan(S.php_statements, "array<string>", X.WORDS), "content"))
    units = own.select("seed_no", F.posexplode("statements").alias("unit", "statement"))
    rows = X.scanned(units, names=(PHP_NAMES, "statement")).select((F.col("seed_no") - F.col("seed_no") % 8).alias("pair"), F.col("seed_no").alias("seed"), (F.col("seed_no") * 100 + F.col("unit")).alias("unit"), F.get("names", F.lit(0)).alias("defines"), F.get("names", F.lit(1)).alias("uses"))
    return pairing.statement_edges(rows)


def variants(spark, sf_dir):
    """Twenty variants of each seed."""
    both = code(spark, sf_dir).select("seed_no", "content", "type").unionByName(view(spark, sf_dir, "more_code").select("seed_no", "content", "type"))
    return both.select("seed_no", "content", "type", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("variant")).withColumn("seed", F.concat_ws("|", "seed_no", "variant"))


@query()
def j17_mutations(spark, sf_dir):
    """The variants of all seeds after the rules of their languages."""
    return mutants.mutated(variants(spark, sf_dir)).select("seed_no", "variant", "type", F.col("mutated").alias("content"))


#: The chances of the rules, and of the base for languages without rules.
CHANCES = ", ".join(f"('{name}', {nth}, {rule.chance})" for name, rules in (*M.FAMILIES.items(), ("", M.BASE)) for nth, rule in enumerate(rules))


@query(cte("code_seeds", "more_code") + f""", r(language, nth, chance) AS (VALUES {CHANCES}), b AS (SELECT seed_no, type FROM code_seeds UNION ALL SELECT seed_no, type FROM more_code), v AS (SELECT seed_no, type, unnest(range(1, 21)) AS variant FROM b),
d AS (SELECT seed_no, type, variant, nth FROM v JOIN r ON language = CASE WHEN type IN (SELECT language FROM r) THEN type ELSE '' END WHERE CAST('0x' || left(md5(seed_no || '|' || variant || '|' || nth || '|chance'), 12) AS BIGINT) % 1000 < chance)
SELECT seed_no, type, CAST(variant AS INTEGER) AS variant, string_agg(CAST(nth AS VARCHAR), ',' ORDER BY nth) AS rules FROM d GROUP BY ALL""")
def j17_rules_drawn(spark, sf_dir):
    """The variants that a rule is tried on, with the numbers of their rules."""
    drawn = variants(spark, sf_dir).withColumn("rules", mutants.rules_drawn(F.col("seed"), F.col("type")))
    return drawn.filter(F.size("rules") > 0).select("seed_no", "type", "variant", F.array_join("rules", ",").alias("rules"))


@query(cte("code_seeds") + r""", s AS (SELECT seed_no, content, regexp_extract(content, 'return (v\d) ', 1) AS v, regexp_extract(content, '\+ (w\d)', 1) AS w FROM code_seeds WHERE type = 'cpython'),
p AS (SELECT a.seed_no AS id_lo, b.seed_no AS id_hi, a.seed_no || '-' || b.seed_no AS pair, a.content AS x, b.content AS y, [a.v, a.w] AS ga, [b.v, b.w] AS gb FROM s a JOIN s b ON b.seed_no = a.seed_no + 4),
d AS (SELECT *, ga[CAST('0x' || left(md5('7|' || pair || '|a|name'), 8) AS BIGINT) % 2 + 1] AS var_a, gb[CAST('0x' || left(md5('7|' || pair || '|b|name'), 8) AS BIGINT) % 2 + 1] AS var_b, CAST('0x' || left(md5('7|' || pair), 8) AS BIGINT) % 100 AS bucket FROM p),
n AS (SELECT *, CAST(least(CASE WHEN bucket < 89 THEN 1 WHEN bucket < 99 THEN 2 ELSE 3 END, CASE WHEN starts_with(var_b, 'v') THEN 2 ELSE 1 END) AS INTEGER) AS n, strpos(y, chr(10) || var_b) AS one, strpos(y, CASE WHEN starts_with(var_b, 'v') THEN 'return ' ELSE '+ ' END || var_b) + CASE WHEN starts_with(var_b, 'v') THEN 6 ELSE 1 END AS two FROM d),
m AS (SELECT *, CASE WHEN starts_with(var_b, 'w') THEN false WHEN n >= 2 THEN true ELSE md5('7|' || pair || '|' || one) < md5('7|' || pair || '|' || two) END AS at_one, CASE WHEN starts_with(var_b, 'w') OR n >= 2 THEN true ELSE md5('7|' || pair || '|' || two) < md5('7|' || pair || '|' || one) END AS at_two FROM n)
SELECT id_lo, id_hi, var_a, var_b, n, x || chr(10) || 'fusion = ' || var_a || '  # dataflow' || chr(10) || CASE WHEN at_one THEN left(y, one) || 'fusion' || y[one + 3 : two] ELSE left(y, two) END || CASE WHEN at_two THEN 'fusion' || y[two + 3 :] ELSE y[two + 1 :] END AS bridged FROM m""")
def j11_dataflow_bridges(spark, sf_dir):
    """Python seeds in pairs: a name of the first is bridged into the second."""
    own = X.scanned(code(spark, sf_dir).filter("type = 'cpython'").select(F.col("seed_no").alias("id"), "content"), groups=("python_groups", "content"))
    return bridges.dataflow_bridges(own.selectExpr("id AS id_lo", "id + 4 AS id_hi"), own, 7, largest=True, tag="# dataflow")


def paired_units(spark, sf_dir, language):
    """The statements of seeds in pairs of neighbours, with what they define and use, and their normal forms."""
    if language == "flang":
        own = view(spark, sf_dir, "more_code").filter("type = 'flang'").select("seed_no", "content", F.floor(F.col("seed_no") / 12).alias("pair"))
        scan, names, normal = S.fortran_statements, lambda s: list(S.fortran_defines_uses(s)), P.normalize_fortran(F.col("statement"), S.FORTRAN_KEYWORDS)
    else:
        own = code(spark, sf_dir).filter(F.col("type") == language).select("seed_no", "content", F.floor(F.col("seed_no") / 8).alias("pair"))
        scan, names, normal = (S.php_statements, lambda s: [(x := S.php_defines_uses(s, P.PHP_SKIP))[0], [n for n in x[0] if not n.startswith("$")], x[1]], P.normalize_php(F.col("statement"))) if language == "php" else (S.c_statements, lambda s: list(S.c_defines_uses(s, P.C_KEYWORDS)), P.normalize_c(F.col("statement")))
    rows = X.scanned(own, statements=(X.Scan(scan, "array<string>", X.WORDS), "content")).select("pair", F.col("seed_no").alias("seed"), F.posexplode("statements").alias("n", "statement"))
    rows = X.scanned(rows, names=(X.Scan(names, "array<array<string>>", X.GROUPS), "statement")).withColumn("unit", F.col("seed") * 1000 + F.col("n"))
    return cut(rows.select("pair", "unit", "seed", "statement", normal.alias("normal"), *(F.get("names", F.lit(i)).alias(n) for i, n in enumerate(("defines", "shared", "uses")))))


@query()
def j15_interleaved(spark, sf_dir):
    """PHP, C and Fortran seeds in pairs: their statements in one order that respects what each defines and uses."""
    out = []
    for language in ("php", "clang", "flang"):
        units = paired_units(spark, sf_dir, language)
        edges = pairing.statement_edges(units)
        if language == "flang":
            kind = X.scanned(units.select("pair", "unit", "seed", "statement"), kind=(X.Scan(S.fortran_kind, "string", pa.string()), "statement"))
            edges = edges.unionByName(pairing.unit_order_edges(kind.withColumn("opens", F.when(F.col("kind") == "unit_open", 1).when(F.col("kind") == "unit_close", -1).otherwise(0)))).distinct()
        out.append(pairing.merged_programs(pairing.interleaved(units, edges, 5)).select(F.lit(language).alias("language"), "pair", "program"))
    return reduce(DataFrame.unionByName, out)
