"""Operators 11 to 13 against brute force, and with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusjobs.llm import centroids, spelling, suffixes

# -- 11 -------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == dimensions and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centres = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[nearest(x)[1]].append(x)
        centres = [[sum(v) // len(members[n]) for v in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centres)]
    return [(i, nearest(x)[1], nearest(x)[0]) for i, x in kept], centres


def by_row(found):
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=repr)


@pytest.mark.parametrize(("k", "large"), [(5, 1.0), (12, 1.0), (40, 1.0), (6, 1e9)])
def test_clusters_equal_plain_rounds(spark, k, large):
    rng = random.Random(k)
    rows = [(i, [rng.choice((-1, 0, 0.5, 1)) * large + rng.choice((0.0, rng.gauss(0, 0.3))) for _ in range(4)]) for i in range(120)]
    rows += [(500 + i, [0.25, 0.5, 0.25, 0.5]) for i in range(60)] + [(1, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 1.0])]
    rows += [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).repartition(5)
    found = centroids.clusters(df, k=k, dimensions=4).collect()
    plain, centres = plain_clusters(rows, k, 5, 4)
    told = sorted(((i, c, d if d < 2**63 else None) for i, c, d in plain), key=repr)
    assert by_row(found) == told
    total = Counter()
    for _, c, d in plain:
        total[c] += d
    for r in found:
        assert r.centroid == ",".join(map(str, centres[r.cluster]))
        assert r.cluster_inertia == (total[r.cluster] if total[r.cluster] < 2**63 else None)
        assert r.inertia == (sum(total.values()) if sum(total.values()) < 2**63 else None)


def test_vectors_beyond_longs_are_exact(spark):
    rows = [(i, [float(10 ** (i % 30)) * s, 1.5]) for i, s in enumerate((1, -1, 3) * 12)]
    found = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, dimensions=2).collect()
    plain, _ = plain_clusters(rows, 7, 5, 2)
    assert by_row(found) == sorted(((i, c, d if d < 2**63 else None) for i, c, d in plain), key=repr)


def test_zero_favours_the_smaller_number():
    table = centroids.Bisectors([[0, 0], [4, 0], [0, 0], [2, 2]], 2)
    winner, distance = table.nearest(np.array([[2, 0], [0, 0], [4, 0], [2, 1], [3, 0]]))
    assert winner.tolist() == [0, 0, 1, 3, 1] and distance.tolist() == [4, 0, 0, 1, 1]


def test_no_vectors_no_clusters(spark):
    assert centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert centroids.clusters(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []


# -- 12 -------------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    place = {id(r): (1, 0) if r[0] is None else (0, r[0]) for r in rows}
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], (2, 0)), place[id(r)])
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < place[id(r)]:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((r[0], len(b), spans, None if r[1] is None else bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def texts_with_passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (6, 8, 9, 12, 30, 80)]
    rows = []
    for i in range(200):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i - 3, None]) if i % 7 == 0 else i, rng.choice([" ", "", "\n"]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "a" * 700), (1003, "a" * 500), (1004, "b" + "a" * 60), (1005, "ab" * 300), (1006, "ab" * 200), (2, rows[1][1]), (5000, rows[20][1]), (5000, rows[20][1]), (None, None)]
    return rows


@pytest.mark.parametrize(("length", "chunk", "part", "hot"), [(50, 8 << 20, 1 << 20, 4096), (50, 3000, 4000, 8), (13, 20000, 900, 2), (5, 3000, 4000, 8), (3, 3000, 4000, 4096)])
def test_removed_bytes_equal_brute_force(spark, length, chunk, part, hot):
    rows = texts_with_passages(length)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit("x"), "data": F.lit(1), "part": F.lit(None)}).repartition(4)
    found = suffixes.without_repeats(df, [], length=length, chunk=chunk, part=part, hot=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], None if r.kept is None else bytes(r.kept)) for r in found), key=repr) == plain_repeats(rows, length)


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, "x" + long[1000:300_000] + "y"), (3, long[-50:]), (4, long[-49:])]
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), [], chunk=1 << 16).collect()}
    assert found == {1: [], 2: [(1, 299_001)], 3: [(0, 50)], 4: []}
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string"), []).collect() == []


def test_equal_groups_are_the_equal_strings():
    rng = np.random.default_rng(2)
    for length in (1, 3, 8, 9, 16, 21):
        data = rng.integers(0, 2, 400).astype(np.uint8)
        starts = rng.permutation(400 - length)
        of = rng.integers(0, 3, len(starts))
        members, group = suffixes.equal_groups(suffixes.eights(data), starts, length, of)
        plain = defaultdict(set)
        for i, s in enumerate(starts):
            plain[of[i], data[s : s + length].tobytes()].add(i)
        found = defaultdict(set)
        for m, g in zip(members.tolist(), group.tolist(), strict=True):
            found[g].add(m)
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in plain.values() if len(v) > 1)


# -- 13 -------------------------------------------------------------------------------------------


def plain_words(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: c for w, c in n.items() if c > 1}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def words_with_variants(seed):
    rng = random.Random(seed)
    letters = "abcdeé×ÿÀ"
    rows, at = [], 0
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice((7, 7, 8, 9, 15)))) for _ in range(25)] + ["aaaaaaaa", "abababab", "bbbbbbbbb"]
    for b in bases:
        forms = {b: rng.choice((2, 30, 400))}
        for _ in range(rng.randint(0, 12)):
            w, i = rng.choice(list(forms)), rng.randrange(7)
            forms[rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]))] = rng.choice((1, 2, 3, 20))
        for w, k in forms.items():
            for _ in range(k):
                rows.append((at % 50, rng.choice((w, w.upper() if w.isascii() else w))))
                at += 1
    rows = [(d, " ".join(w for _, w in g)) for d, g in itertools.groupby(sorted(rows), key=lambda r: r[0])]
    return rows + [(None, "abababab, abababac"), (7, None), (8, ""), (9, "short words only"), (1, rows[1][1]), (3, "x" * 3000 + " " + "x" * 3000), (4, "x" * 3001 + "-" + "x" * 3001)]


@pytest.mark.parametrize(("parts", "hot"), [(4, 50_000), (4, 3), (3, 50_000), (6, 5)])
def test_variants_equal_brute_force(spark, parts, hot):
    rows = words_with_variants(parts)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(None), "id": F.lit(2)}).repartition(5)
    found = sorted((tuple(r) for r in spelling.variants(df, parts=parts, hot=hot).collect()), key=repr)
    assert found == plain_variants(plain_words(rows))


def test_near_words_of_slices_and_chains(spark):
    words = [("aaaaaaaaaa", 100_000), ("aaaaaaaaab", 9_000), ("aaaaaaaabb", 800), ("aaaaaaabbb", 70), ("aaaaaabbbb", 6), ("aaaaaabbbbc", 6)]
    text = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)]
    found = {r.word: (r.form, r.root, r.form_n) for r in spelling.variants(spark.createDataFrame(text, "doc_id long, text string")).collect()}
    counts = plain_words(text)
    assert found == {w: (f, r, k) for w, f, r, _, _, k in plain_variants(counts)}
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
