"""Signatures of known outputs, and the rules around them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corpusjobs.functions import signatures as G
from corpusjobs.operators import triage

GOLDEN = [
    ("cpython", "", "Fatal Python error: Segmentation fault\nThread 0x00007f...", "Segmentation fault"),
    ("cpython", "", "python: Objects/dictobject.c:1503: insertdict: Assertion `value != NULL` failed.", "Assertion: value != NULL"),
    ("cpython", "", "Bus error (core dumped)", "Bus error"),
    ("cpython", "hello world", "", None),
    ("php", "", "Assertion: value != NULL failed at zend_hash.c:800", "Assertion: value != NULL failed at zend_hash.c:800"),
    ("php", "SUMMARY: AddressSanitizer: use-after-poison", "", "SUMMARY: AddressSanitizer: use-after-poison"),
    ("clang", "", "SUMMARY: AddressSanitizer: stack-buffer-overflow", "ASAN: stack-buffer-overflow"),
    ("clang", "", "LLVM ERROR: out of memory", "LLVM ERROR: out of memory"),
    ("clang", "", "Stack dump:\n0.\tProgram arguments: clang test.c\n1.\t<eof> parser at end of file\n\n", "Stack dump: <eof> parser at end of file"),
    ("clang", "", "Stack dump:\n0.\tProgram arguments: c\n1.\tt.c:3:1: current token\n 0  libA 0x7f1 llvm::sys::PrintStackTrace(raw) + 1\n 1  clang 0x7f2 std::optional<A<B>>::Act(int) + 9\n", "Stack dump: current token [std::optional<A<B>>::Act]"),
    ("clang", "", "Stack dump:\n0.\tProgram arguments: c\n 0  /usr/lib/libA.so 0x7f1\n 1  /usr/lib/libB.so 0x7f2\n", "Stack dump: libB.so+0x7f2"),
    ("clang", "", "Aborted (core dumped)", "Aborted"),
    ("flang", "", "Stack dump:\n0.\tProgram arguments: c\n #0 0x0000 raise(int)\n #1 0x0001 Fortran::evaluate::Fold(x)\n", "Stack dump: Fortran::evaluate::Fold"),
    ("swift", "", "1. While evaluating request TypeCheckFunctionBodyRequest(x)", "While evaluating request TypeCheckFunctionBodyRequest"),
    ("swift", "normal output", "", None),
    ("haskell", "", "internal error: PAP object entered!", "GHC internal error: PAP object entered!"),
    ("haskell", "", "Segmentation fault", "ghc: Segmentation fault"),
    ("haskell", "", "ghc: panic! (the 'impossible' happened)\n  a\n  b\n  c\n  d", "ghc panic: a\n  b\n  c"),
    ("lfortran", "", 'Traceback (most recent call last):\n  File "a", line 1, in main\n  File "b", line 2, in visit(x)\nInternal Compiler Error: x\nLCompilersException: bad thing', "ICE: LCompilersException: bad thing [visit]"),
    ("rust", "", "thread 'rustc' panicked at src/m1.rs:7:9:\nindex out of bounds", "RustPanic:src/m1.rs:7:9:index out of bounds"),
    ("rust", "", "error: Cannot redeclare foo in x", "Error:Cannot redeclare foo"),
    ("rust", "", "error: bad /tmp/x/a.c thing\n --> f.rs:12:5", "Error:bad  thing_L12"),
    ("mlir", "", "==1== x\n odd line\n", "Stderr:odd line"),
    ("mlir", "", "", None),
]


def test_golden_signatures(spark):
    frame = spark.createDataFrame([(i, *g[:3]) for i, g in enumerate(GOLDEN)], "i int, project string, out string, err string")
    got = {r.i: r.s for r in frame.select("i", G.signature_for(F.col("project"), F.col("out"), F.col("err")).alias("s")).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [g[3] for g in GOLDEN]


def test_golden_signatures_of_a_table(spark):
    frame = spark.createDataFrame([(i, *g[:3]) for i, g in enumerate(GOLDEN)], "i int, project string, out string, err string")
    signed = G.with_signature(frame, F.col("project"), F.col("out"), F.col("err"))
    assert signed.columns == ["i", "project", "out", "err", "signature"]
    assert [r.signature for r in signed.orderBy("i").collect()] == [g[3] for g in GOLDEN]
    odd = G.with_signature(frame, F.col("project"), F.col("out"), F.col("err"), F.col("i") % 2 == 1).filter("signature IS NOT NULL")
    assert {r.i: r.signature for r in odd.collect()} == {i: g[3] for i, g in enumerate(GOLDEN) if i % 2 and g[3] is not None}
    own = G.with_signature(frame, F.col("project"), F.col("out"), F.col("err"), cascades={"rust": G.php}, last=None)
    column = {r.i: r.s for r in frame.select("i", G.php(F.coalesce("out", F.lit("")), F.coalesce("err", F.lit(""))).alias("s")).collect()}
    assert {r.i: r.signature for r in own.collect()} == {i: (column[i] or None) if g[0] == "rust" else None for i, g in enumerate(GOLDEN)}


def test_a_table_of_signatures_is_planned_small(spark):
    """Each rule stands once in the plan, whatever is asked of the signature."""
    runs = spark.createDataFrame([("clang", "", "LLVM ERROR: x", 1)], "project string, stdout string, stderr string, return_code int")
    plan = triage.with_signatures(runs).filter("crashed AND signature IS NOT NULL").groupBy("signature").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("BackendError:") == 1 and len(plan) < 60_000


def test_a_text_that_every_issue_holds(spark):
    said = lambda i: f"Issue {i}: the compiler panic in module m{i % 7} of the pass p{i % 3}, New{i % 5} != Old"
    issues = spark.createDataFrame([(i, said(i), None if i % 2 else f"body {i}") for i in range(400)], "number long, title string, body string")
    signatures = ["Assertion: the compiler panic in module", "Assertion: m3 of the pass p1,", "LLVM ERROR: of the pass", "ASAN: New2 != Old", "Assertion: nothing like it", "Segmentation fault"]
    found = {(r.signature, r.nth): (r.term, r.total, r.top) for r in triage.match_issues(spark.createDataFrame([(s,) for s in signatures], "signature string"), issues).collect()}
    for term, total, top in found.values():
        parts = re.findall('"([^"]*)"', term) or [term]
        hit = [i for i in range(400) if all(p.lower() in (said(i) + ("" if i % 2 else f"\nbody {i}")).lower() for p in parts)]
        assert (total, top) == (len(hit), hit[:5])
    assert max(n for _, n, _ in found.values()) == 400 and min(n for _, n, _ in found.values()) == 0


@pytest.mark.parametrize(("out", "err", "want"), [("SUMMARY: x", "", True), ("", ": Assertion `", True), ("a", None, False)])
def test_crashed(spark, out, err, want):
    frame = spark.createDataFrame([(out, err)], "o string, e string")
    assert frame.select(G.crashed(F.lit("cpython"), F.col("o"), F.col("e")).alias("c")).first().c is want
    assert frame.select(G.crashed(F.lit("cpython"), F.col("o"), F.col("e"), {"cpython": ()}).alias("c")).first().c is False


@pytest.mark.parametrize(("err", "rc", "want"), [("Error: x", 0, True), ("\x1b[31mSyntax\x1b[0mError", 0, True), ("fine", 0, False), ("fine", 1, False), ("fine", 139, False), ("fine", 2, True), (None, 0, False)])
def test_syntax_error(spark, err, rc, want):
    frame = spark.createDataFrame([(err, rc)], "e string, rc int")
    assert frame.select(G.syntax_error(F.col("e"), F.col("rc")).alias("c")).first().c is want


@pytest.mark.parametrize(("hits", "want"), [([0, 60], 0), ([60, 0], 60), ([60, 50], 50), ([51], 51), ([None, 1, 0], 1), ([70, 60, 80], 60), ([None], None)])
def test_best_query(spark, hits, want):
    frame = spark.createDataFrame([("s", i, f"q{i}", n) for i, n in enumerate(hits)], "signature string, nth int, term string, total long")
    assert triage.best_query(frame).first().total == want


def test_matches(spark):
    a = "Stack dump: x [A::f > std::optional<B<C>>::g > lib+0x12]"
    b = "Stack dump: <eof> parser at end of file [A::f > std::optional<B<C>>::g]"
    frame = spark.createDataFrame([(1, a), (2, b), (3, "Stack dump: only a message"), (4, None), (5, ""), (6, "SIGSEGV")], "id int, signature string")
    assert {(r.first, r.n) for r in triage.signature_classes(frame).collect()} == {(min(a, b), 2), ("Stack dump: only a message", 1), ("SIGSEGV", 1)}
    assert {r.id for r in triage.matched(frame, frame.filter("id IN (2, 4, 5)")).collect()} == {1, 2}
    left = spark.createDataFrame([(1, "ASAN: a"), (2, "x ASAN: b"), (3, None), (4, None), (5, "other"), (6, ""), (7, "SIGSEGV")], "id int, signature string")
    right = spark.createDataFrame([(1, "ASAN: c"), (3, None), (5, "other")], "id int, signature string")
    assert {r.id for r in triage.keyword_matched(left, right).collect()} == {1, 2, 3, 4, 5}
    assert {r.id for r in triage.keyword_matched(left, right.filter("id = 5")).collect()} == {5} and triage.keyword_matched(left, right.limit(0)).count() == 0
    assert {(r.key, r.n) for r in triage.keyword_classes(left).collect()} == {("ASAN:", 2), ("null:", 2), ("SIGSEGV", 1), ("text:", 1), *((f"text:{r}", 1) for r in ("ASAN: a", "x ASAN: b", "other", "SIGSEGV"))}


def test_clusters_show_their_smallest_members(spark):
    members = spark.createDataFrame([("s", f"m{i:02}") for i in range(9)] + [("t", "a"), ("u", "b")], "signature string, member string").repartition(3)
    assert {r.signature: (r.size, list(r.first)) for r in triage.clusters(members, 2).collect()} == {"s": (9, ["m00", "m01"]), "t": (1, ["a"]), "u": (1, ["b"])}
    assert [(r["rank"], r.signature, r.shown) for r in triage.cluster_report(triage.clusters(members, 2), 2).orderBy("rank").collect()] == [(1, "s", "m00, m01 +7 more"), (2, "t", "a"), (3, "u", "b")]


def test_first_seen_keeps_runs_without_a_signature(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "run_id long, signature string")
    known = spark.createDataFrame([("b",)], "signature string")
    assert {(r.key, r.first, r.n) for r in triage.first_seen(frame, known).collect()} == {("a", 1, 2), ("NoSig_3", 3, 1), ("NoSig_4", 4, 1)}
