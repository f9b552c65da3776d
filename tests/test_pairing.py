"""Pairs by shared keys: frequent keys in parts, hashed bands, bounded candidates."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusjobs.operators import pairing as J
from corpusjobs.operators import tables as T


@pytest.mark.parametrize("most", [T.MOST_FREQUENT, 0])
def test_keys_in_parts_meet_once_and_spread(spark, monkeypatch, most):
    monkeypatch.setattr(T, "MOST_FREQUENT", most)
    left = [("hot", i) for i in range(700)] + [(f"k{i % 40}", i) for i in range(200)] + [("mine", 1), (None, 5)]
    right = [("hot", -i) for i in range(90)] + [(f"k{i % 50}", -i) for i in range(100)] + [(None, 6)]
    a, b = spark.createDataFrame(left, "key string, x long"), spark.createDataFrame(right, "key string, y long")
    met = T.joined_in_parts(a, b, "key", 20)
    want = Counter((k, x, y) for k, x in left for j, y in right if k == j and k is not None)
    assert Counter((r.key, r.x, r.y) for r in met.collect()) == want
    cells = met.select(F.pmod(F.xxhash64("key", "x"), F.lit(35)).alias("l"), F.pmod(F.xxhash64("key", "y"), F.lit(5)).alias("r"), "key").filter("key = 'hot'")
    assert cells.groupBy("l", "r").count().agg(F.max("count")).first()[0] <= 60 * 60  # 20 rows of a side on average


def profiles(spark, seed, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        for role in ("produces", "consumes"):
            rows += [(i, role, f"s{rng.randint(0, 25)}") for _ in range(rng.randint(0, 3))] + ([(i, role, "int")] if hot else [])
    return sorted(set(rows)), spark.createDataFrame(sorted(set(rows)), "id long, role string, symbol string")


def plain_scores(rows):
    made, used = ({i: {s for j, r, s in rows if j == i and r == role} for i, _, _ in rows} for role in ("produces", "consumes"))
    return {(i, j): n for i in made for j in made if i < j and (n := len(made[i] & used[j]) + len(made[j] & used[i]))}


@pytest.mark.parametrize("part", [T.PART, 7])
def test_a_symbol_of_all_classes_gives_equal_scores_in_parts(spark, part):
    rows, df = profiles(spark, part, True)
    found = J.compatible_classes(J.seed_classes(df), part=part).collect()
    plain = plain_scores(rows)
    assert sum(r.pairs for r in found) == len(plain) and sum(r.pairs * r.score for r in found) == sum(plain.values())


def test_bounded_candidates_are_scored_by_all_symbols(spark):
    rows, df = profiles(spark, 3, True)
    classes = J.seed_classes(df)
    out = {(r.symbol, r.makers, r.users) for r in J.dropped_symbols(classes, 500).collect()}
    kinds = {r.kind for r in classes.collect()}
    n = lambda s, role: len({i for i, r, x in rows if i in kinds and (r, x) == (role, s)})
    assert out == {(s, n(s, "produces"), n(s, "consumes")) for s in {s for *_, s in rows} if n(s, "produces") * n(s, "consumes") > 500} and {s for s, *_ in out} == {"int"}
    exact = {(r.k1, r.k2): (r.score, r.pairs) for r in J.compatible_classes(classes).collect()}
    bounded = {(r.k1, r.k2): (r.score, r.pairs) for r in J.compatible_classes(classes, most=500).collect()}
    rare = {(r.k1, r.k2) for r in J.compatible_classes(J.seed_classes(df.filter("symbol <> 'int'"))).collect()}
    assert all(exact[p] == v for p, v in bounded.items()) and 0 < len(bounded) < len(exact)
    named = {r.id: r.kind for r in classes.collect()}
    assert {tuple(sorted((named[a], named[b]))) for (a, b) in plain_scores([r for r in rows if r[2] != "int"])} >= set(bounded) and rare


def near_texts(n, seed=4):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 4000)}" for _ in range(60)] for _ in range(n)]
    return [" ".join(w if rng.random() > rate else f"z{rng.randint(0, 99)}" for w in b) for b in base for rate in (0, 0, 0.01, 0.02)] + ["", None, "a b", "a b"]


@pytest.mark.parametrize("part", [T.PART, 5])
def test_frequent_shingles_in_parts_give_equal_pairs(spark, part):
    rows = [f"common start of all of them {t}" if t else t for t in near_texts(15)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, content string")
    sets = {}
    for i, t in enumerate(rows):
        w = (t or "").split()
        s = frozenset(" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
        if s:
            sets.setdefault(s, i)
    want = {(min(i, j), max(i, j)) for a, i in sets.items() for b, j in sets.items() if i != j and len(a & b) / len(a | b) >= 0.6}
    assert {(r.a, r.b) for r in J.similar_pairs(df, 0.6, 3, part=part).collect()} == want and len(want) > 10


def test_bands_find_what_the_exact_mode_finds(spark):
    df = spark.createDataFrame(list(enumerate(near_texts(150))), "id long, content string")
    exact = {(r.a, r.b): r.similarity for r in J.similar_pairs(df, 0.8, 3).collect()}
    for part in (T.PART, 3):
        likely = {(r.a, r.b): r.similarity for r in J.likely_pairs(df, 0.8, 3, part=part).collect()}
        assert len(exact) > 150 and set(likely.items()) <= set(exact.items()) and len(likely) >= 0.97 * len(exact)
    assert J.likely_pairs(df.limit(0), 0.8).collect() == []


def test_the_permutation_is_one(spark):
    for half, seed in ((1, 0), (3, 7), (6, 123456)):
        n = 4**half
        found = [r.y for r in spark.range(n).select(J.permuted(F.col("id"), half, seed).alias("y")).collect()]
        assert sorted(found) == list(range(n)) and (n < 16 or found != list(range(n)))
    i, j = J.corner(F.col("id"))
    assert [(r.i, r.j) for r in spark.range(10).select(i.alias("i"), j.alias("j")).collect()] == [(i, j) for j in range(1, 5) for i in range(j)]
    big = 10**9 * (10**9 - 1) // 2 - 1
    assert spark.range(big, big + 1).select(*(c.alias(n) for c, n in zip(J.corner(F.col("id")), "ij", strict=True))).first().asDict() == {"i": 10**9 - 2, "j": 10**9 - 1}


def test_plans_find_what_is_left_of_millions(spark):
    """Of 3,000 seeds 400 have one partner left each; only their pairs are looked at."""
    n = 3000
    ids = spark.range(n)
    left = ids.filter("id % 2 = 0 AND id < 400").select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    log = ids.select(F.col("id").alias("id_a"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("id_b")).filter(f"id_a < {n - 1}")
    log = log.join(left, (F.col("id_a") == F.col("x")) & (F.col("id_b") == F.col("y")), "left_anti")
    plan = J.plan_pairs(ids, log, 150, 9).collect()
    assert len({(r.id_lo, r.id_hi) for r in plan}) == 150 and all(r.priority == 1 and r.id_lo % 2 == 0 and r.id_hi == r.id_lo + 1 and r.id_lo < 400 for r in plan)
    plan = J.plan_pairs(ids, log, 260, 9).collect()
    assert [sum(r.priority == p for r in plan) for p in (0, 1, 2)] == [0, 200, 60]


def test_guided_pairs_beside_a_log_larger_than_what_is_wanted(spark):
    """Two classes of 60 seeds each whose first 3,000 pairs are logged."""
    rows = [(i, "produces" if i < 60 else "consumes", "s") for i in range(120)]
    classes = J.seed_classes(spark.createDataFrame(rows, "id long, role string, symbol string"))
    every = [(i, 60 + j) for i in range(60) for j in range(60)]
    log = spark.createDataFrame([(b, a) for a, b in every[:3000]] + [(0, 1), (500, 2)], "id_a long, id_b long")
    assert [(r.id_lo, r.id_hi) for r in J.guided_pairs(classes, log, 40).collect()] == every[3000:3040]
    holes = spark.createDataFrame([p for k, p in enumerate(every) if k % 7], "id_a long, id_b long")
    assert [(r.id_lo, r.id_hi) for r in J.guided_pairs(classes, holes, 10_000).collect()] == every[::7]


def test_donors_and_hosts(spark):
    from corpusjobs.functions import profiles as P

    text = "func.func @f(%a: i32, %b: memref<4xf32, strided<[1], offset: 3>>) -> (index, tensor<2xvector<4xi8>>) {\n}\nfunc.func private @g(i64)\nfunc.func @h() {\n}"
    r = spark.createDataFrame([(text,)], "c string").select(P.mlir_signatures(F.col("c")).alias("s"), P.mlir_donor_types(F.col("c")).alias("t")).first()
    assert [(x.name, x.types) for x in r.s] == [("f", ["i32", "memref<4xf32, strided<[1], offset: 3>>", "index", "tensor<2xvector<4xi8>>"]), ("h", [])]
    assert r.t == sorted(r.s[0].types)
    heads = P.declaration_headers(F.col("c"), "flang")
    text = "type :: A\nTYPE, extends (B) :: C\n type, public :: D"
    assert [h.name for h in spark.createDataFrame([(text,)], "c string").select(P.extendable(heads).alias("h")).first().h] == ["A", "D"]


def test_later_variables_are_bridged_from_earlier_ones_of_the_other_seed(spark):
    lets = [(1, 0, "a", "x", "i32"), (1, 1, "b", "y", "u64"), (1, 2, "a", "v", "Vec<i32>"), (1, 3, "a", "w", "String"), (1, 4, "b", "z", "Vec<u8>"), (2, 0, "a", "q", "i32")]
    df = spark.createDataFrame(lets, "pair int, place int, seed string, name string, type string")
    found = {(r.var_a, r.var_b): r.needs_clone for r in J.ordered_bridges(df).collect()}
    assert found[("x", "y")] is False and ("y", "x") not in found and ("x", "v") not in found and all(a != "q" for a, _ in found)
    every = {(r.var_a, r.var_b): r.needs_clone for r in J.ordered_bridges(df, type_match=False).collect()}
    assert set(every) == {("x", "y"), ("y", "v"), ("y", "w"), ("x", "z"), ("v", "z"), ("w", "z")} and every[("w", "z")] is True and every[("x", "z")] is False


def test_names_of_both_are_renamed_but_not_members(spark):
    rows = spark.createDataFrame([("foo(); a.foo(); x->foo; ns::foo(foobar, foo); // foo", ["foo", "foobar"]), ("foo", []), ("f$x", ["x"])], "t string, n array<string>")
    got = [r.x for r in rows.select(J.renamed(F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == ["foo_b(); a.foo(); x->foo; ns::foo(foobar_b, foo_b); // foo_b", "foo", "f$x_b"]
    assert spark.range(1).select(J.renamed(F.lit("(foo) $this->foo()"), F.array(F.lit("foo")), "_c", "php").alias("x")).first().x == "(foo_c) $this->foo()"


def test_whole_grafts(spark):
    from corpusjobs.functions import lexing as X
    from corpusjobs.operators import grafts

    texts = {1: "int f() {\n  int a = 1;\n  int b = a;\n  g(b);\n}\n", 2: "void h() {\n\tlong z = 3;\n\tif (z) {\n\t\tk();\n\t}\n}\nint end;", 3: "", 4: None}
    seeds = spark.createDataFrame(list(texts.items()), "id long, content string")
    points = {r.id: r for r in grafts.splice_points(seeds, "clang", 7).collect()}
    for i, t in texts.items():
        if t:
            states = {p[0]: p for p in X.complex_states(t, "clang")}
            assert points[i].host in states and points[i].begin - 1 in states and points[i].until == X.balanced_end(t, points[i].begin, "clang")
    assert (points[3].host, points[3].category, points[3].begin, points[3].until) == (0, "fallback", 0, 0)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 9)], "id_lo long, id_hi long")
    got = {(r.id_lo, r.id_hi, r.direction): r.grafted for r in grafts.grafts(pairs, grafts.splice_points(seeds, "clang", 7), "// tag").collect()}
    assert set(got) == {(1, 2, "ab"), (1, 2, "ba"), (1, 3, "ab"), (1, 3, "ba")}
    for (a, b, way), text in got.items():
        h, d = (points[a], points[b]) if way == "ab" else (points[b], points[a])
        own, given = (texts[h.id] or "").splitlines(), (texts[d.id] or "").splitlines()[d.begin : d.until]
        moved = [h.indent + x.lstrip() if h.indent and x.strip() else x for x in given]
        if moved:
            at = next((i for i, x in enumerate(moved) if x.strip()), 0)
            moved[at] += "  // tag"
        assert text == "\n".join(own[: h.host + 1] + moved + own[h.host + 1 :])
    php = spark.createDataFrame([(1, "<?php\n$a = 1;\n$b = $a;\n?>\n")], "id long, content string")
    r = grafts.splice_points(php, "php", 1).first()
    assert r.body == "\n$a = 1;\n$b = $a;\n" and r.host == 2


def test_interleaved_statements_respect_their_edges(spark):
    from corpusjobs.plans import lexing_queries as Q

    sf = "/root/testdata/sf0.001"
    for language in ("php", "clang", "flang"):
        units = Q.paired_units(spark, sf, language)
        edges = J.statement_edges(units)
        ordered = J.interleaved(units, edges, 5).collect()
        assert sorted((r.pair, r.unit, r.statement) for r in ordered) == sorted((r.pair, r.unit, r.statement) for r in units.collect())
        place = {(r.pair, r.unit): r.place for r in ordered}
        after = {}
        for r in edges.collect():
            after.setdefault((r.pair, r.later), set()).add((r.pair, r.earlier))

        def free(u, seen=()):  # not behind a cycle
            return u not in seen and all(free(v, (*seen, u)) for v in after.get(u, ()))

        checked = [(u, v) for u, own in after.items() for v in own if free(u)]
        assert all(place[v] < place[u] for u, v in checked) and (checked or language == "flang")
        seeds = {}
        for r in sorted(ordered, key=lambda r: (r.pair, r.place)):
            seeds.setdefault(r.pair, []).append(r.seed)
        assert any(len(set(x)) > 1 and x != sorted(x) for x in seeds.values())
        again = J.interleaved(units.repartition(7), edges.repartition(3), 5).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, ordered))


def test_bridges(spark):
    from corpusjobs.functions import lexing as X
    from corpusjobs.operators import bridges

    seeds = spark.createDataFrame([(1, "a = b", [["a", "b"], ["c", "d", "e"]]), (2, "x = xx + x; x", [["x"]]), (3, "none", []), (4, None, None)], "id long, content string, groups array<array<string>>")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (3, 1), (1, 4)], "id_lo long, id_hi long")
    for largest in (False, True):
        found = {(r.id_lo, r.id_hi): r for r in bridges.dataflow_bridges(pairs, seeds, 3, largest=largest, tag="# t").collect()}
        one = found[1, 2]
        assert one.var_a in ("cde" if largest else "abcde") and one.var_b == "x" and 1 <= one.n <= 3
        first, second, third = one.bridged.split("\n")
        assert (first, second) == ("a = b", f"fusion = {one.var_a}  # t") and third.count("fusion") == one.n and third.replace("fusion", "x") == "x = xx + x; x"
        assert (found[1, 3].bridged, found[3, 1].bridged, found[1, 3].n, found[1, 4].bridged) == ("a = b\nnone", "none\na = b", 0, None)
    light = spark.createDataFrame([(["a", "b", "a"],)], "n array<string>").select(bridges.each_alone(F.col("n")).alias("g")).first().g
    assert light == [["a"], ["b"]]
    php = bridges.dataflow_bridges(pairs.limit(1), seeds, 3, name="$fusion", statement="{name} = {value};").first()
    assert f"\n$fusion = {php.var_a};\n" in php.bridged and X.replace_words("x", "x", "$fusion", 1, "") == "$fusion"


def test_mutants_are_those_of_one_text_at_a_time(spark):
    from corpusjobs.functions import mutations as M
    from corpusjobs.operators import mutants

    texts = {"php": "<?php\n$a = 1 + 2;\n$b = 'x' . \"y\";\nif ($a == $b and true) { f((int) $a ?? null); }", "cpython": "x = 1\ny += 'a' * 3\nprint(x.y, None)", "rust": "fn main() {\n  let a = 1i32;\n  f(a);\n}", "haskell": "main = print (1 + 2)\nx = \"s\" ++ show True", "go": "a := 1 + 2 // 'x'", "": "a += 0x1"}
    rows = [(i, f"{t}|{i}", t, c) for i in range(30) for t, c in texts.items()] + [(99, "k", "php", None), (99, "k", None, "a = 1")]
    for boost in (1, 100):
        found = mutants.mutated(spark.createDataFrame(rows, "i int, seed string, type string, content string"), boost=boost).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r.mutated == (None if r.content is None else M.mutate(r.content, r.seed, r.type or "", boost))
        assert sum(r.mutated != r.content for r in found) > (100 if boost == 100 else -1) and all(r.mutated == r.content for r in found if not r.rules)
