"""Scans of text, samples and expressions against hand-worked rows and plain forms."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusjobs.functions import lexing as X
from corpusjobs.functions import profiles as P
from corpusjobs.functions import text as T
from corpusjobs.operators import corpus as C
from corpusjobs.operators import diverse
from corpusjobs.operators import pairing as J
from corpusjobs.operators import tables


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\r\nb\r", "\n\n", " a\x0bb\x85c\u2028d "])
def test_lines_and_strip_are_those_of_python(spark, text):
    assert one(spark, text, T.lines) == text.splitlines()
    assert one(spark, text, T.strip) == text.strip()
    assert one(spark, text, T.words) == text.split()


@pytest.mark.parametrize(("language", "text", "code"), [
    ("rust", 'a "b\\"c" d // e\nf /* g */ h', "a  d \nf  h"),
    ("python", "x = '''a # b''' # c\ny", "x =  \ny"),
    ("clang", 'a "never closed', "a "),
    ("clang", "a /* never closed", "a "),
    ("haskell", "f -- c\n{- b -} g", "f \n g"),
    ("flang", "x ! c\ny", "x \ny"),
    ("unknown", "a // b", "a "),
    ("clang", 'a "ends in \\', "a "),
])
def test_masks(language, text, code):
    assert "".join(c for c, real in zip(text, X.lexical_mask(text, language), strict=True) if real) == code


def test_live_counts():
    assert X.live_counts("a = 1\nfor i in a:\n    b = 2\ndel a\ndef f():\n    c = 1", "python") == [1, 2, 3, 2, 0, 1]
    assert X.live_counts("fn f() {\n  let a = 1;\n  {\n    let a = 2; // let z\n  }\n  drop(a);\n}", "rust") == [0, 1, 1, 2, 2, 0, 0]
    assert X.live_counts("integer :: a, B(3), a\nreal :: c", "f90") == [2, 3]
    assert X.live_counts("x", "haskell") is None


def test_complex_states():
    text = "int f() {\n  int a = 1;\n  int b = 2;\n}\n"
    assert X.complex_states(text, "c") == [(2, "live2", "", "  "), (3, "live2", "", "")]
    drawn = X.complex_states("f();\n  g();\nh();", "c")
    assert drawn == [(1, "random_mid", "", "  ")] and X.complex_states("", "c") == [] and X.complex_states("x", "hs") == []
    assert X.balanced_end("f() {\n  a;\n}\nb;", 1, "c") == 2 and X.balanced_end("a;\nb;", 0, "c") == 2 and X.balanced_end("a", 5, "c") == 1


def test_dataflow_groups():
    assert X.first_overlap([["a", "b"], ["c", "d"], ["d", "a"], ["e"]]) == [["a", "b", "d"], ["c", "d"], ["e"]]
    rng = random.Random(1)
    for _ in range(300):
        groups = [list(dict.fromkeys(rng.choices("abcdefgh", k=rng.randint(1, 3)))) for _ in range(rng.randint(0, 8))]
        merged: list[list[str]] = []
        for g in groups:
            into = next((m for m in merged if set(m) & set(g)), None)
            if into is None:
                merged.append(list(g))
            else:
                into.extend(x for x in g if x not in into)
        assert X.first_overlap(groups) == merged
    assert X.same_line_groups("#include <a>\nint x = y; // z\nchar *s = \"q\";\nx = w;", "c") == [["x", "y", "w"], ["s"]]
    assert X.same_line_groups("$a = $b;\n$c;\n$b = $d;", "php") == [["$c"], ["$a", "$b", "$d"]]
    assert X.python_groups("a = b + c\nd = 1\nprint(e)\nc = f") == [["a", "b", "c", "f"], ["e", "print"]]
    assert X.python_groups("not python (") == []


def test_truncation():
    rows = [f"line {i}" for i in range(1000)]
    text = "\n".join(rows)
    assert X.smart_truncate(text, 10**6) == text
    assert X.smart_truncate(text, 100, 2, 5).split("\n")[1:] == rows[-5:]
    rows[500] = "x Segmentation fault"
    cut = X.smart_truncate("\n".join(rows), 100, 2, 5).split("\n")
    assert cut[1:-1] == rows[498:505] and cut[0].startswith("[... 498 lines") and cut[-1].startswith("[... 495 more lines")


def test_grafts(spark):
    rows = [("a\n  b\nc", "x\n    y\n\nz", 1, "  ", 0, "# t"), ("a", "x\ny", 5, "", None, None), ("a\nb", "x", 0, "", 0, "# t"), ("a\nb", "", 0, " ", None, "t"), ("", "x", 0, None, None, None), ("a", "\n\n", 0, " ", None, "t"), (None, "x", 0, "", None, "")]
    frame = spark.createDataFrame(rows, "h string, d string, hl int, i string, dl int, t string")
    got = [r.x for r in frame.select(X.graft(*map(F.col, ("h", "d", "hl", "i", "dl", "t"))).alias("x")).collect()]
    assert got == ["a\n  b\n  y  # t\n\n  z\nc", "a\nx\ny", "a\nb", "a\nb", "x", "a\n  t\n", None]


def test_lives_within_braces():
    """Against a plain walk with a stack of frames."""
    rng = random.Random(11)
    for _ in range(300):
        text = "\n".join(" ".join(rng.choices(["{", "}", "let a = 1;", "let b = 2;", "drop(a);", "drop(b);", "// let c", "x"], k=rng.randint(0, 4))) for _ in range(rng.randint(0, 9)))
        frames, want, mask = [set()], [], X.lexical_mask(text, "rust")
        for start, line in X.line_spans(text):
            code = "".join(c if mask[start + i] else " " for i, c in enumerate(line))
            for f in frames:
                f -= {x for x in "ab" if f"drop({x})" in code}
            frames[-1] |= {x for x in "ab" if f"let {x}" in code}
            want.append(sum(map(len, frames)))
            for c in code:
                frames = [*frames, set()] if c == "{" else frames[:-1] if c == "}" and len(frames) > 1 else frames
        assert X.live_counts(text, "rust") == want


def test_grafts_and_bridges():
    assert X.replace_words("r struct r for r", "r", "Q", 2, "s").count("Q") == 2 and "stQuct" not in X.replace_words("r struct", "r", "Q", 1, "s")
    assert X.bridge("a", "b = x", [["p"]], [["x"]], 1, "s") == "a\nfusion = p\nb = fusion" and X.bridge("a", "b", [], [["x"]], 1, "s") == "a\nb"
    order = X.interleave([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], [set(), {0}, {3}, {2}], "s")
    assert order == [0, 1, 2, 3]


def test_columns_give_null_for_what_cannot_be_read(spark):
    frame = spark.createDataFrame([("a = 1", "python"), (None, "python"), ("", "clang")], "t string, l string")
    found = X.scanned(frame, x=("live_counts", "t", "l"), y=("complex_states", "t", "l")).collect()
    assert [r.x for r in found] == [[1], None, []] and found[0].y[0].category == "live1"
    assert [r.x for r in frame.select(X.truncated(F.col("t"), 3).alias("x")).collect()][1:] == [None, ""]


def test_diverse_samples(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdef", k=12))) for i in range(60)] + [(60, ""), (61, None)]
    frame = spark.createDataFrame(rows, "id long, content string")
    exact = diverse.select_diverse(frame, 8, 1)
    assert exact.count() == 8 and {r.id for r in exact.collect()} == {r.id for r in diverse.select_diverse(frame.repartition(7), 8, 1).collect()}
    assert diverse.select_diverse(frame, 8, 1, group=20).count() == 8 and diverse.select_diverse(frame, 99, 1).count() == 62
    assert diverse.farthest([{1}, {1, 2}, {9}, {1}], 3) == [0, 2, 1]


def test_shingles_and_jaccard(spark):
    assert one(spark, "a b a b a", J.shingles) == ["a b a", "b a b"] and one(spark, "a b", J.shingles) == ["a b"] and one(spark, "  ", J.shingles) == []
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(J.jaccard(empty, empty).alias("x"), J.jaccard(F.array(F.lit("a")), empty).alias("y")).first() == (1.0, 0.0)


@pytest.mark.parametrize(("raw", "want"), [("&mut Foo<T>", "mut"), ("*pkg.Foo", "Foo"), ("a::b::C", "C"), ("", ""), ("123", "")])
def test_base_symbol(spark, raw, want):
    assert one(spark, raw, P.base_symbol) == want


def test_profiles(spark):
    rust = one(spark, "use std::io;\nfn main() {}\nfn helper(x: i32) -> i32 { { x } }\nstruct Point { x: f64 }\nstruct Point;\nlet a: &mut i32 = 1;\nlet a: Vec<u8> = b;\nlet s: &'a str = c;", P.rust_profile)
    assert rust.var_types == {"a": "Vec<u8>", "s": "str"} and rust.primitive_vars == [] and rust.cloneable_vars == ["a"]
    assert rust.fn_signatures == ["fn helper(x: i32) -> i32"] and rust.struct_names == ["Point"] and rust.has_lifetimes and rust.complexity_score == 8 + 10
    go = one(spark, "var x int\nvar x string\ny := 1.5\ny := 2\nz := Foo(1)\nw := \"q\"\nx := 3", P.go_profile)
    assert go.var_types == {"x": "string", "y": "float64", "z": "Foo", "w": "string"}
    python = one(spark, "import os\nx = 1\ndef f():\n    return g(x, 'h i') # j\nx = 2", P.python_profile)
    assert python.top_level_vars == ["x"] and python.undefined_refs == ["g"] and python.line_count == 5
    assert one(spark, "func.func @f() {\n %0 = arith.constant 1 : i32\n}", P.mlir_profile).functions == ["f"]
    assert one(spark, "// CHECK: arith.addi\n// RUN: mlir-opt\nfunc @test() {}", P.clean_mlir) == "func.func @test() {}"
    assert one(spark, "x\nTYPES:{\"a\": [\"int\"], \"b\": \"str\"}", P.python_probe) == {"a": ["int"], "b": ["str"]}
    swift = one(spark, "// RUN: x\nlet a = 1\nvar b = \"s\"\nlet c = [1]", P.swift_profile)
    assert swift.has_run and swift.var_types == {"a": "Int", "b": "String", "c": "Array"}
    assert one(spark, " <?php\n$a = 1;\n?> ", P.clean_php) == "\n$a = 1;\n" and one(spark, "<?php\n$a;\ngoto x;\nx:\nb(); ?>\n==DONE==", P.clean_php) == "\n$a;\n\n\nb();\n"
    assert P.get_profiler("RUST") is P.rust_profile and P.get_profiler("x") is P.generic_profile


def test_plans_for_few_seeds(spark):
    log = spark.createDataFrame([(1, 2), (2, 1)], "id_a long, id_b long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert J.plan_pairs(ids(), log, 3, 1).count() == 0 and [tuple(r) for r in J.plan_pairs(ids(5), log, 3, 1).collect()] == [(5, 5, 2)]
    scored = spark.createDataFrame([(1, 3, 2), (1, 2, 9)], "id_lo long, id_hi long, score long")
    plan = [tuple(r) for r in J.plan_pairs(ids(1, 2, 3), log, 3, 1, scored).collect()]
    assert plan[0] == (1, 3, 0) and plan[-1][2] == max(p[2] for p in plan)
    cover = J.pair_coverage(spark.createDataFrame([(2,)], "n long"), log).first()
    assert (cover.covered, cover.total, cover.ratio, cover.saturated) == (1, 1, 1.0, True)


def test_plans_find_the_last_unfused_pairs(spark):
    left = {(1, 2), (5, 19), (20, 30)}
    log = spark.createDataFrame([(a, b) for a in range(1, 31) for b in range(a + 1, 31) if (a, b) not in left], "id_a long, id_b long")
    plan = [tuple(r) for r in J.plan_pairs(spark.createDataFrame([(i,) for i in range(1, 31)], "id long"), log, 400, 1).collect()]
    assert {p[:2] for p in plan[:3]} == left and [p[2] for p in plan] == [1] * 3 + [2] * 397


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(40)] for _ in range(12)]
    rows = [" ".join(w if rng.random() > rate else "zz" for w in b) for b in base for rate in (0, 0, 0.01, 0.02, 0.05)] + ["", None, "a b", "a b"]
    sets = {}
    for i, t in enumerate(rows):
        w = (t or "").split()
        s = frozenset(" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
        if s:
            sets.setdefault(s, i)
    want = {(min(i, j), max(i, j)) for a, i in sets.items() for b, j in sets.items() if i != j and len(a & b) / len(a | b) >= 0.6}
    got = J.similar_pairs(spark.createDataFrame(list(enumerate(rows)), "id long, content string"), 0.6, 3).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 5


def test_guided_pairs_skip_what_is_logged(spark):
    seeds = [(i, role, s) for i in range(12) for role, s in (("produces", f"p{i % 3}"), ("consumes", f"p{(i + 1) % 3}"))] + [(20, "produces", "p0"), (20, "produces", "p1")]
    profiles = spark.createDataFrame(seeds, "id long, role string, symbol string")
    made = {i: {s for j, r, s in seeds if j == i and r == "produces"} for i, _, _ in seeds}
    used = {i: {s for j, r, s in seeds if j == i and r == "consumes"} for i, _, _ in seeds}
    score = {(i, j): n for i in made for j in made if i < j and (n := len(made[i] & used[j]) + len(made[j] & used[i]))}
    classes = J.seed_classes(profiles)
    assert {r.pairs for r in J.compatible_classes(classes).collect()} and sum(r.pairs for r in J.compatible_classes(classes).collect()) == len(score)
    logged = sorted(score)[::2]
    log = spark.createDataFrame([(b, a) for a, b in logged], "id_a long, id_b long")
    for n in (1, 5, 1000):
        got = [(r.id_lo, r.id_hi, r.score) for r in J.guided_pairs(classes, log, n).collect()]
        left = {p: k for p, k in score.items() if p not in logged}
        assert len(got) == min(n, len(left)) and all(left[a, b] == k for a, b, k in got) and sorted((k for *_, k in got), reverse=True) == sorted(left.values(), reverse=True)[: len(got)]


def test_unknown_ids_fail(spark):
    corpus = spark.createDataFrame([(1, "{}")], "id long, translations string")
    with pytest.raises(LookupError):
        C.set_translation(corpus, spark.createDataFrame([(2, "go", "x")], "id long, target string, text string"))


@pytest.mark.parametrize(("text", "want"), [("--FILE--\n a \n--EXPECT--\nx", "a"), ("--TEST--\nx", None), ("none", None), ("--FILE--\nto the end\n", "to the end")])
def test_phpt_file(spark, text, want):
    assert one(spark, text, C.phpt_file) == want


@pytest.mark.parametrize(("language", "text", "want"), [
    ("php", "class A extends B implements C, D {\n} interface I {", [("class", "A", "extends B implements C, D"), ("interface", "I", "")]),
    ("cpython", "class A(B, C):\n    class D:\n  pass", [("class", "A", "B, C"), ("class", "D", "")]),
    ("swift", "struct S<T>: P, Q {\n}\nenum E {", [("struct", "S", "P, Q"), ("enum", "E", "")]),
    ("haskell", "class (Eq a) => Show a where\n f :: a", [("class", "Show", "")]),
    ("flang", "TYPE, extends(base) :: t\n type :: u", [("type", "t", ", extends(base)"), ("type", "u", "")]),
    ("clang", "template <class T> struct A : B {", [("struct", "A", "B")]),
])
def test_declaration_headers(spark, language, text, want):
    assert [tuple(h) for h in one(spark, text, lambda c: P.declaration_headers(c, language))] == want


def test_fortran_types(spark):
    assert one(spark, "INTEGER(4), intent(in) :: a, b\nreal*8 :: C\ndouble  precision :: a", P.fortran_types) == {"B": "integer(4)", "C": "real*8", "A": "double precision"}


def test_fortran_and_php_texts(spark):
    assert one(spark, "PROGRAM a\n real function f(x) ! function no\nend function f\nsub&\n  &x\nsubroutine s(y)", P.fortran_names) == ["A", "F", "S"]
    assert one(spark, "x = y + 1.5e3 // 'it''s'", lambda c: P.normalize_fortran(c, ("IF",))) == "_ = _ + 0 // '_'"
    assert one(spark, "a('// no', \"# no\"); // c\n/* d\n*/ b; # e", P.strip_php) == "a('// no', \"# no\"); \n b; "
    assert one(spark, 'f(x, "a\\"b", 0x1FuL, 2.5f) + int', P.normalize_c) == '_(_, "_", 0, 0) + int'


def test_scans_of_long_and_deep_texts(spark):
    """A text of 50 MB is scanned whole, beside short ones; one that nests too deep for the parser gives none."""
    line = "    int x = call(1, \"{ text\"); // }\n"
    long = "int f() {\n" + line * (50_000_000 // len(line)) + "}\n"
    rows = spark.createDataFrame([(1, "int a;\n"), (3, "x = 1\n" * 3), (4, None)], "id int, t string")
    rows = rows.unionByName(spark.range(1).select(F.lit(2).alias("id"), F.concat(F.lit("int f() {\n"), F.repeat(F.lit(line), 50_000_000 // len(line)), F.lit("}\n")).alias("t")))
    found = X.scanned(rows.withColumn("l", F.lit("c")).withColumn("start", F.lit(1)).coalesce(1), end=("balanced_end", "t", "l", "start"), counts=("live_counts", "t", "l")).select("id", "end", F.size("counts").alias("n"), F.array_max("counts").alias("most")).collect()
    lines = long.count("\n")
    assert {r.id: (r.end, r.n, r.most) for r in found if r.id < 4} == {1: (1, 1, 1), 2: (lines - 1, lines, 1), 3: (3, 3, 0)}
    assert [r.end for r in found if r.id == 4] == [None]
    deep = spark.createDataFrame([("(" * 100_000, 1), ("a = b", 2)], "t string, id int")
    assert {r.id: r.g for r in X.scanned(deep, g=("python_groups", "t")).collect()} == {1: [], 2: [["a", "b"]]}


def test_parts_of_bytes():
    batch = pa.RecordBatch.from_pydict({"a": ["x" * n for n in (3, 3, 50, 1, 1, 1)], "n": range(6)})
    assert [b.column(1).to_pylist() for b in tables.parts_of_bytes(batch, 6)] == [[0, 1], [2], [3, 4, 5]]
    assert [b.num_rows for b in tables.parts_of_bytes(batch.slice(0, 0), 6)] == [0]


def test_fortran_groups():
    text = "program p\nC  comment with names\n  s = a // b ! c\n  t = 'x!y' // d\nend program"
    assert X.same_line_groups(text, "flang") == [["P"], ["C", "COMMENT", "WITH", "NAMES"], ["S", "A", "B"], ["T", "X"]]  # comments go before strings
    assert X.same_line_groups(text, "flang", True) == [["P"], ["S", "A", "B"], ["T", "X"]]


def test_points_of_any_line_and_cached_ones(spark):
    frame = spark.createDataFrame([(1, "a\n\tb", [(5, "c", "", "")]), (2, "", []), (3, "x", None)], f"id int, t string, cached array<{X.POINT}>")
    own = F.array(F.struct(F.lit(0).alias("line_idx"), F.lit("own").alias("category"), F.lit("").alias("matched_text"), F.lit("").alias("indent")))
    found = {r.id: (r.p and r.p.category, r.a and (r.a.category, r.a.indent)) for r in frame.select("id", X.pick_point(own, 1, F.col("id"), F.col("cached")).alias("p"), X.any_point(F.col("t"), 1, F.col("id")).alias("a")).collect()}
    assert found[1][0] == "c" and found[1][1] in (("random", ""), ("random", "\t")) and found[2] == (None, None) and found[3] == ("own", ("random", ""))
