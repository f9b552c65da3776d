"""Token counts under a unigram model by dynamic programming that shares prefixes in a trie.

The pre-tokens of a text are its words, each with the piece vocabulary's word mark before it. Distinct pre-tokens go
into a trie; a node keeps the forward score of its prefix - the best sum of log probabilities over all ways to cut the
prefix into pieces - and the number of pieces of that best way, so both are computed once for all words that share the
prefix, and the node of a whole word holds its terminal count. A text's count is the sum of those of its words.

The trie of a batch of words is built level by level: the nodes of a depth are the distinct prefixes of that length,
and all of them look back together, one letter at a time, through a trie of the reversed pieces.

The vocabulary file gives the pieces alone: its scores are merge ranks, no probabilities. Log probabilities are fitted
here, on all documents: ROUNDS of hard expectation-maximisation over the counts of all distinct words, from the
counts of pieces in the best ways under the last ones. A character that no piece covers counts as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, gathered, removed, stored
from .tokens import vocabulary

PIECES, MARK = "piece_bpe_32k.model", "\u2581"
#: Words, and the controls at which Python would split as well.
RUN, CONTROLS = re.compile(r"[^\t-\r ]+"), re.compile(r"[\x1c-\x1f]")
#: Rounds of the fit, what is added to each piece's count, and how far below the rarest piece an uncovered character is.
ROUNDS, ADDED, BELOW = 2, 0.1, 10.0
#: Words of one trie, words that a task remembers or counts at a time, and characters up to which a word goes into a trie.
BATCH, REMEMBERED, LONGEST = 1 << 16, 1 << 20, 64
#: Characters of texts with longer words whose words a task counts at a time.
HELD = 32 << 20


@cache
def pieces(name: str = PIECES) -> tuple[str, ...]:
    """The pieces of a vocabulary in the order of their ids, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
    return tuple(model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))


def first_scores(n: int) -> np.ndarray:
    """Log probabilities to begin with: pieces that were merged early are taken to be frequent (1 / rank)."""
    share = 1.0 / np.arange(1, n + 1)
    return np.log(share / share.sum())


class Back:
    """A trie of the reversed pieces: from a node and a letter to the next node, as sorted arrays; `piece` is what a node completes, or -1."""

    def __init__(self, own: tuple[str, ...]):
        nodes: dict[tuple[int, str], int] = {}
        done = {0: -1}
        for number, piece in enumerate(own):
            at = 0
            for c in reversed(piece):
                at = nodes.setdefault((at, c), len(nodes) + 1)
                done.setdefault(at, -1)
            done[at] = number
        edges = sorted((at << 21 | ord(c), to) for (at, c), to in nodes.items())
        self.edges, self.to = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
        self.piece = np.array([done[i] for i in range(len(nodes) + 1)], np.int64)

    def step(self, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes that follow, -1 where there are none."""
        if not len(self.edges):
            return np.full(len(at), -1)
        wanted = at << 21 | letters
        place = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
        return np.where(self.edges[place] == wanted, self.to[place], -1)


class Trie:
    """The trie of some words, its nodes numbered by depth: parent, letter, forward score, pieces of the best way, and its last piece."""

    def __init__(self, words: list[str], scores: np.ndarray, back: Back):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        self.scores, self.n_pieces = scores, len(scores)
        self.uncovered = float(scores.min(initial=0.0)) - BELOW
        self.end = np.zeros(len(words), np.int64)  # the node of each whole word
        self.parent, self.letter = np.full(1, -1), np.zeros(1, np.int64)
        self.score, self.count, self.last, self.size = np.zeros(1), np.zeros(1, np.int64), np.full(1, -1), np.zeros(1, np.int64)
        self.levels = []
        going, depth = np.flatnonzero(lengths > 0), 0
        while len(going):
            # The distinct (parent, letter) of this depth are its nodes.
            pairs, node = np.unique(self.end[going] << 21 | letters[starts[going] + depth], return_inverse=True)
            first = len(self.parent)
            self.parent, self.letter = np.concatenate((self.parent, pairs >> 21)), np.concatenate((self.letter, pairs & 0x1FFFFF))
            self.end[going] = first + node
            self.levels.append((first, first + len(pairs)))
            self.forward(first, len(pairs), back)
            depth += 1
            going = going[lengths[going] > depth]

    def forward(self, first: int, n: int, back: Back) -> None:
        """Scores of the nodes from `first` on; of equal scores the way with the longer last piece wins."""
        own = np.arange(first, first + n)
        up = self.parent[own]
        code = self.letter[own]
        best, count = self.score[up] + self.uncovered, self.count[up] + 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        last, size = np.full(n, -1), np.ones(n, np.int64)
        at, row, here, length = np.zeros(n, np.int64), np.arange(n), own, 0
        while len(row):
            at = back.step(at, self.letter[here])
            keep = at >= 0
            at, row, here = at[keep], row[keep], self.parent[here[keep]]
            length += 1
            ends = back.piece[at]
            some = np.flatnonzero(ends >= 0)
            total = self.score[here[some]] + self.scores[ends[some]]
            better = some[total >= best[row[some]]]
            which = row[better]
            best[which] = self.score[here[better]] + self.scores[ends[better]]
            count[which], last[which], size[which] = self.count[here[better]] + 1, ends[better], length
            more = here > 0  # at the root the word begins
            at, row, here = at[more], row[more], here[more]
        self.score, self.count = np.concatenate((self.score, best)), np.concatenate((self.count, count))
        self.last, self.size = np.concatenate((self.last, last)), np.concatenate((self.size, size))

    def terminal(self) -> np.ndarray:
        """Pieces of the best way of each word."""
        return self.count[self.end]

    def used(self, weights: np.ndarray) -> np.ndarray:
        """How often each piece stands in the best ways of the words, which count `weights` times."""
        flow = np.bincount(self.end, weights=weights, minlength=len(self.parent))
        out = np.zeros(self.n_pieces)
        for first, upto in reversed(self.levels):
            own = np.arange(first, upto)
            own = own[flow[own] > 0]
            known = own[self.last[own] >= 0]
            out += np.bincount(self.last[known], weights=flow[known], minlength=self.n_pieces)
            before = own
            for length in range(1, int(self.size[own].max(initial=0)) + 1):
                before = self.parent[before]
                done = self.size[own] == length
                flow += np.bincount(before[done], weights=flow[own[done]], minlength=len(flow))
                own, before = own[~done], before[~done]
        return out


def long_word(word: str, known: dict[str, int], scores: np.ndarray, longest: int) -> int:
    """Pieces of the best way of a word outside a trie: only the last `longest` scores are held."""
    return best_way(word, known, scores, longest)[0]


def best_way(word: str, known: dict[str, int], scores: np.ndarray, longest: int, last: array | None = None) -> tuple[int, array | None]:
    """(pieces of the best way, last); with an array `last` the number of the last piece of the best way to each place, -1 for an uncovered character."""
    uncovered = float(scores.min(initial=0.0)) - BELOW
    held = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        score, n, piece = held[-1][0] + uncovered, held[-1][1] + len(word[j - 1].encode("utf-8", "surrogatepass")), -1
        for back, (s, k) in enumerate(reversed(held), 1):
            number = known.get(word[j - back : j])
            if number is not None and s + scores[number] >= score:
                score, n, piece = s + scores[number], k + 1, number
        held.append((score, n))
        if last is not None:
            last.append(piece)
        if len(held) > longest:
            del held[0]
    return held[-1][1], last


def used_in_long(word: str, n: int, known: dict[str, int], sizes: list[int], scores: np.ndarray, longest: int, total: np.ndarray) -> None:
    """Adds to total how often each piece stands in the best way of a word outside a trie, which counts n times."""
    _, last = best_way(word, known, scores, longest, array("i"))
    at = len(word)
    while at:
        piece = last[at - 1]
        if piece < 0:
            at -= 1
        else:
            total[piece] += n
            at -= sizes[piece]


@cache
def numbers(name: str) -> tuple[dict[str, int], list[int], int]:
    """Pieces by their text, their sizes, and the longest size."""
    sizes = list(map(len, pieces(name)))
    return {p: i for i, p in enumerate(pieces(name))}, sizes, max(sizes, default=1)


class Counts:
    """Terminal counts of words; at most REMEMBERED words are kept, and a batch of new ones makes one trie."""

    def __init__(self, name: str, scores: np.ndarray):
        self.scores, self.back = scores, backward(name)
        self.known, _, self.longest = numbers(name)
        self.memory: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = list(words)
        short = [w for w in new if len(w) <= LONGEST]
        for at in range(0, len(short), BATCH):
            some = short[at : at + BATCH]
            self.memory.update(zip(some, Trie([MARK + w for w in some], self.scores, self.back).terminal().tolist(), strict=True))
        for w in new:
            if len(w) > LONGEST:
                self.memory[w] = long_word(MARK + w, self.known, self.scores, self.longest)

    def forget_long(self, words: set[str]) -> None:
        for w in words:
            if len(w) > LONGEST:
                self.memory.pop(w, None)


@cache
def backward(name: str) -> Back:
    return Back(pieces(name))


def words(text: str | None) -> list[str]:
    """Runs of anything but the six ASCII white-space characters."""
    text = text or ""
    return text.split() if text.isascii() and not CONTROLS.search(text) else RUN.findall(text)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all documents; words are counted in the tasks first, some MB of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        held = 0  # bytes of texts with long words

        def made() -> Iterator[pa.RecordBatch]:
            own = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            yield from by_bytes(iter([own]), 0)

        for batch in by_bytes(batches, 0):
            for text in batch.column(0).to_pylist():
                own = words(text)
                counts.update(own)
                held += len(text or "") if own and len(max(own, key=len)) > LONGEST else 0
                if len(counts) > REMEMBERED // 4 or held > HELD:
                    yield from made()
                    held = 0
        if counts:
            yield from made()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", name: str = PIECES, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, from all words of all documents. Without documents those to begin with."""
    spark, scores, tables = docs.sparkSession, first_scores(len(pieces(name))), []
    counted = stored(word_counts(docs, text_col), tables)
    for _ in range(rounds):

        def used(batches: Iterator[pa.RecordBatch], scores: np.ndarray = scores) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(scores))
            known, sizes, longest = numbers(name)

            def short() -> Iterator[pa.RecordBatch]:
                for batch in by_bytes(batches, 0):
                    long = pc.greater(pc.utf8_length(batch.column(0)), LONGEST)
                    for word, n in zip(*(c.to_pylist() for c in batch.filter(long).columns), strict=True):
                        used_in_long(MARK + word, n, known, sizes, scores, longest, total)
                    yield batch.filter(pc.invert(long))

            for batch in gathered(short(), BATCH):
                total += Trie([MARK + w for w in batch.column(0).to_pylist()], scores, backward(name)).used(batch.column(1).to_numpy().astype(np.float64))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

        found = counted.mapInArrow(used, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # as many rows as pieces at most
        if found:
            total = np.full(len(scores), ADDED)
            for r in found:
                total[r.piece] += round(r.n)
            scores = np.log(total / total.sum())
    for path in tables:
        removed(spark, path)
    return scores


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = PIECES, scores: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row, under the given log probabilities or those that fit(docs) gives.

    Null and empty texts have none; repeated rows give repeated rows, null ids stay null, an empty table gives no rows.
    Texts are read whole; a word of any length is counted with as many scores in memory as the longest piece has
    letters. Other columns are not read.
    """
    given = fit(docs, text_col, name) if scores is None else scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(name, given)
        for batch in by_bytes(batches, 1):
            own = [words(t) for t in batch.column(1).to_pylist()]
            distinct = set().union(*own)
            counts.learn(distinct)
            count = counts.memory.__getitem__
            totals = [sum(map(count, x)) for x in own]
            counts.forget_long(distinct)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, own), pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
