"""What models are fitted on, and tables in rounds."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusjobs.llm import token_trie as T


def test_words_of_any_length_teach(spark, monkeypatch):
    rng = random.Random(1)
    chinese = "的一是不了人我在有他这中大来上国"
    texts = [("".join(rng.choice(chinese) for _ in range(200)),) for _ in range(60)] + [("short words here",), (None,), ("x" * 100_000,)]
    docs = spark.createDataFrame(texts, "text string").repartition(3)
    counts = {r.word: r.n for r in T.word_counts(docs).collect()}
    assert sum(len(w) for w in counts) == sum(len(t.replace(" ", "")) for (t,) in texts if t)
    scores = T.fit(docs)
    known = T.numbers(T.PIECES)[0]
    taught = [known[c] for c in chinese if c in known]
    assert len(taught) > 5 and min(scores[taught]) > scores.min() + 3


def test_best_ways_of_long_words_are_those_of_the_trie():
    rng = random.Random(2)
    known, sizes, longest = T.numbers(T.PIECES)
    some = [p for p in T.pieces() if p.isascii()][300:900]
    words = ["".join(rng.choice(some) for _ in range(rng.randint(1, 12))) + rng.choice(["", "é", "日", "🙂"]) for _ in range(200)]
    n = np.array([rng.randint(1, 5) for _ in words])
    scores = np.log(np.random.default_rng(3).dirichlet(np.ones(len(T.pieces()))) + 1e-12)
    trie = T.Trie([T.MARK + w for w in words], scores, T.backward(T.PIECES))
    total = np.zeros(len(scores))
    for w, k in zip(words, n.tolist(), strict=True):
        T.used_in_long(T.MARK + w, k, known, sizes, scores, longest, total)
    assert np.array_equal(total, trie.used(n.astype(float)))
    assert [T.long_word(T.MARK + w, known, scores, longest) for w in words] == trie.terminal().tolist()


def test_tables_of_a_round_are_bounded_and_long_items_are_dealt_out(spark):
    from corpusjobs.llm import decontam as D

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = " ".join(rng.choice(vocabulary) for _ in range(300_000))
    tables = D.Tables([("a", text)])
    assert tables.nbytes < 8 * len(text)
    items = spark.createDataFrame([(1, text), (2, "only five words are here"), (None, " ".join(text.split()[100:140])), (3, None), (4, "!!")], "item_id long, text string")
    parts = D.item_parts(items, "item_id", "text", 1000).collect()
    longest = [r.words.split(" ") for r in parts if r.item == "1"]
    assert max(map(len, longest)) <= 1000 + D.WINDOW - 1 and len(longest) == 300 and {r.item for r in parts} == {"1", "2", None}
    own = text.split()
    docs = spark.createDataFrame([(i, " ".join([*["x"] * i, *own[at : at + n], "y"])) for i, (at, n) in enumerate([(0, 40), (990, 30), (5_000, 12), (299_980, 20), (150_000, 2000), (110, 20)])] + [(9, "Only FIVE words, are: here"), (10, None)], "doc_id long, text string")
    one, many = (sorted(map(repr, D.occurrences(docs, items, round_bytes=n).collect())) for n in (8 << 20, 200_000))
    assert one == many
    found = {r.doc_id: ([tuple(s) for s in r.spans], r.items) for r in D.occurrences(docs, items).collect()}
    assert found[0] == ([(0, 40)], ["1"]) and found[1] == ([(1, 31)], ["1"]) and found[2] == ([], []) and found[4] == ([(4, 2004)], ["1"]) and found[9] == ([(0, 5)], ["2"]) and found[10] == ([], [])
    assert found[5] == ([(5, 25)], [None, "1"])


def toxic_texts(seed, n=240):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    bad = ["horribleperson", "dreadfulfool", "wretchedvermin", "stinkingrat", "uselesscoward"]
    return plain, bad, [(i, " ".join(rng.choices(plain, k=40) + (rng.choices(bad, k=2) if i % 2 else [])), i % 2) for i in range(n)]


def test_toxicity_learns_from_whole_texts_as_tables_and_as_bags(spark):
    from corpusjobs.llm import toxicity as X

    plain, bad, rows = toxic_texts(5)
    rng = random.Random(6)
    # A word that tells the class stands behind ten thousand others.
    long = [(1000 + i, " ".join([f"filler{rng.randrange(10**7)}" for _ in range(10_000)] + ["horribleperson"] * 60 if i % 2 else [f"filler{rng.randrange(10**7)}" for _ in range(10_000)]), i % 2) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + long], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + long], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    learnt = sorted(((y, str(i)), t) for i, t, y in rows + long if zlib.crc32(str(i).encode()) % 5)
    same = X.train([X.bag(t) for _, t in learnt], [y for (y, _), _ in learnt])
    assert model.vocabulary == same.vocabulary and np.allclose([model.score(t) for _, t, _ in rows], [same.score(t) for _, t, _ in rows], atol=1e-6)
    held = [(t, y) for i, t, y in rows + long if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in held]) > 0.95
    # Misspelt forms of toxic words, which training never saw.
    rng, caught, clean = random.Random(7), 0, 0
    for _ in range(100):
        words = rng.choices(plain, k=40)
        w = rng.choice(bad)
        at = rng.randrange(2, len(w) - 2)
        wrong = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice("xyzw") + w[at:], w[:at] + w[at + 1] + w[at] + w[at + 2 :]))
        caught += model.score(" ".join([*words, wrong, wrong])) >= 0.5
        clean += model.score(" ".join(words)) < 0.5
    assert caught >= 65 and clean >= 95  # 72 of 100 at the time of writing
