"""Fuzzy line deduplication.

Lines are normalised (A-Z in lower case, white space, controls and ASCII punctuation as one space). A line of at least
MIN_WORDS words, or of as many characters as MIN_WORDS words of five letters have, takes part. Every distinct
normalised line has a SimHash of 128 bits over its words; a word over LONG bytes, as whole lines are in scripts without
spaces, stands for its runs of GRAM characters. The bits are cut into blocks in several fixed orders, and lines whose
bits of one block agree are a group that one task gets. In a group the other bits are cut into inner blocks in the same way,
and lines meet where an inner block agrees too: of the blocks of one order no pair of fewer differing bits than blocks is
lost (pigeonhole), and each further block finds more of the rest. Blocks are as wide as groups of about GROUP lines need, inner
ones as wide as leaves about BY_CHANCE lines that agree by chance. There are as many inner blocks as let INSIDE of the pairs of a
group meet whose bits agree as often as AGREE says, and as many blocks as let SHARE of all such pairs meet; only for blocks
do lines move. Short lines, whose bits one edit moves most, have blocks of their own.
Of lines that meet within BITS bits the edit similarity of the texts is verified, the nearest first and no pair that is
connected by then, and the connected groups of verified links, together with equal lines, keep the occurrence that comes first by (document id, line number).

Lines move as packed records, one row for many lines of one group of cells. Groups are counted first, and one that
holds too many lines for a task is dealt out as pairs of parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, components, cut, free_name, freed, gathered, joined_by_share, packed_rows, removed, stored

MIN_WORDS, SIMILARITY, WIDTH = 5, 0.8, 128
LONG, GRAM = 24, 3
#: Lines that should agree by chance in an inner block, and the share of pairs that should meet, in a group and of all. Narrow
#: inner blocks cost comparisons, wide ones more sorting.
BY_CHANCE, INSIDE, SHARE = 16, 0.9, 0.99
#: Characters of short lines; how often a bit agrees of pairs that should meet: of all lines, and of short ones.
SHORT, AGREE, AGREE_SHORT = 160, 0.85, 0.79
#: Bits by which lines may differ to be compared as texts, and by which short ones may.
BITS, BITS_SHORT = 28, 33
#: Lines of a group on average; a group over the second number, but at least a 65,536th of all, is dealt out in parts of the third.
GROUP, HOT, PART = 1 << 17, 1 << 19, 1 << 17
#: Bits by which few lines are dealt out too, if groups keep so many lines; a group of so many is compared whole.
SPREAD, LEAST = 4, 1 << 11
#: Words whose hashes are summed at once.
WORDS = 1 << 15
#: Lines of a cell up to which cells are compared side by side, lines that are so compared at once, and pairs handed on at once.
SIDE, ROWS, PAIRED = 1 << 11, 1 << 15, 1 << 16
#: Blocks for which all lines are dealt out at once, so that the records on disk stay at about half the size of the texts.
ROUND = 4
#: Normalisation of UTF-8 bytes; a line feed stays.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c == 10 or c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
REMEMBERED = 1 << 20
#: Bits of the filter by which the texts of candidate lines are fetched: 8 for each line, within these bounds; the driver gets it in so many chunks.
FILTER, CHUNKS = (1 << 20, 1 << 27), 1 << 10


# -- normalised lines -----------------------------------------------------------------------------


class Lines:
    """The non-empty normalised lines of some texts: of each its text's place, its number there, its words and characters."""

    def __init__(self, texts: list[bytes | None]):
        data = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]).translate(NORMAL), np.uint8)
        gap = data <= 32
        gap[1:] &= gap[:-1]  # behind another gap, or at the beginning
        data = data[~gap | (data == 10)]
        feeds = np.flatnonzero(data == 10)
        starts = np.concatenate(([0], feeds[:-1] + 1))[: len(feeds)]
        upto = feeds - (data[feeds - 1] == 32)
        own = np.flatnonzero(upto > starts)
        text = data.tobytes()
        self.lines: list[bytes] = [text[s:e] for s, e in zip(starts[own].tolist(), upto[own].tolist(), strict=True)]
        counts = np.array([(t or b"").count(b"\n") + 1 for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), counts)[own]
        self.number = own - (np.cumsum(counts) - counts)[self.text]
        self.words = np.array([x.count(b" ") + 1 for x in self.lines], np.int64)
        self.size = np.array([len(x) if x.isascii() else len(x.decode("utf-8", "surrogatepass")) for x in self.lines], np.int64)

    def __len__(self) -> int:
        return len(self.lines)

    def takes_part(self, min_words: int) -> np.ndarray:
        """Whether a line is long enough, in words or, as in text without spaces, in characters."""
        return (self.words >= min_words) | (self.size - self.words + 1 >= 5 * min_words)

    def keys(self) -> np.ndarray:
        """Two longs of a 128-bit hash of each line."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.lines)), "<i8").reshape(-1, 2)

    def simhashes(self) -> np.ndarray:
        """Two longs of the SimHash of each line."""
        out, bounds, at = [np.zeros((0, 2), np.int64)], np.cumsum(self.words), 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + WORDS, side="right")))
            out.append(simhashes(self.lines[at:upto], self.words[at:upto]))
            at = upto
        return np.concatenate(out)


def simhashes(lines: list[bytes], words: np.ndarray) -> np.ndarray:
    """Two longs of the SimHash of each of under 2**24 normalised lines, which have so many words."""
    data = b" ".join(lines) + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts
    line = np.repeat(np.arange(len(lines)), words)
    found = line.astype(np.uint64) << np.uint64(40) | word_hashes(data, starts, lengths) >> np.uint64(24)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        more = [found[lengths <= LONG]]
        for i in long.tolist():
            text = data[starts[i] : ends[i]].decode("utf-8", "surrogatepass")
            grams = {text[j : j + GRAM] for j in range(max(1, len(text) - GRAM + 1))}
            more.append(np.array([xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) >> 24 | int(line[i]) << 40 for g in grams], np.uint64))
        found = np.concatenate(more)
    found.sort()
    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    return majority((found >> np.uint64(40)).astype(np.int64), found & np.uint64((1 << 40) - 1), len(lines))


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing of unsigned longs in which each bit depends on all (the finaliser of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the first LONG bytes of each word."""
    padded = data + bytes(LONG)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # the eight bytes from each position on
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    out = mixed((eight[starts] & masks[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(8, LONG, 8):
        more = np.flatnonzero(lengths > k)
        out[more] = mixed(out[more] * np.uint64(0x9E3779B97F4A7C15) + (eight[starts[more] + k] & masks[np.minimum(lengths[more] - k, 8)]))
    return out


@cache
def lanes() -> np.ndarray:
    """By a byte: its eight bits, each in a byte of an unsigned long."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


def majority(line: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
    """The SimHash of lines 0 to n - 1, each with one feature or more: a bit is 1 if over half its features have it."""
    both = np.stack((mixed(features + np.uint64(0x9E3779B97F4A7C15)), mixed(features ^ np.uint64(0xD1B54A32D192ED03))), axis=1).view(np.uint8)
    both = np.ascontiguousarray(both.T)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    sizes = np.diff(np.append(first, len(line)))
    chunks = -(-sizes // 255)  # a byte counts to 255
    at = np.cumsum(chunks) - chunks
    starts = np.repeat(first, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(at, chunks))
    ones = np.empty((len(starts), WIDTH // 8), np.uint64)
    for j in range(WIDTH // 8):
        ones[:, j] = np.add.reduceat(lanes().take(both[j]), starts)
    ones = ones.view(np.uint8)
    ones = ones.astype(np.int32) if len(at) == len(ones) else np.add.reduceat(ones, at, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None]).view("<i8").reshape(n, 2)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """(doc_id, line_no, k1, k2, f1, f2, size) of the lines that take part; k1 and k2 are a 128-bit hash of the normalised
    line, f1 and f2 its SimHash, size its characters. With `short` also all shorter lines that are not empty, without a SimHash."""
    names = ["doc_id", "line_no", "k1", "k2", "f1", "f2", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, 1 << 20):
            found = Lines(batch.column(1).cast(pa.binary()).to_pylist())
            part = found.takes_part(min_words)
            own = np.arange(len(found)) if short else np.flatnonzero(part)
            if len(own):
                keys, fps = found.keys()[own], found.simhashes()[own]
                ids = batch.column(0).take(pa.array(found.text[own]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.number[own].astype(np.int32)), *(pa.array(keys[:, i]) for i in (0, 1)), *(pa.array(fps[:, i], mask=~part[own]) for i in (0, 1)), pa.array(found.size[own].astype(np.int32))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, line_no int, k1 long, k2 long, f1 long, f2 long, size int")


# -- candidates -----------------------------------------------------------------------------------

#: A line in a group, and one whose connected group is known.
RECORD = np.dtype([("size", "<u4"), ("id", "<i8"), ("f1", "<i8"), ("f2", "<i8")])
ROOTED = np.dtype([*RECORD.descr, ("root", "<i8")])
PAIRS = "a long, b long, bits int"


def group_bits(n: int, group: int = GROUP) -> int:
    """The bits that deal n lines out to groups."""
    return min(30, max(0, round(math.log2(max(n, 1) / group)), min(SPREAD, int(math.log2(max(n, 1) / LEAST)))))


def needed(agree: float, share: float) -> int:
    """The number of tries, of which `agree` succeed, of which one should in `share` of all cases."""
    return 1 if agree >= 1 else math.ceil(math.log(1 - share) / math.log(1 - agree))


def cut_bits(bits: np.ndarray, width: int, n: int, *seed: int) -> list[np.ndarray]:
    """n blocks of some of the bits, without overlap within each order."""
    each, out = len(bits) // max(width, 1), []
    for order in range(-(-n // each)):
        own = np.random.default_rng((*seed, order)).permutation(bits)
        out += [own[width * i : width * (i + 1)] for i in range(each)]
    return out[:n]


def inner_width(n: int, width: int) -> int:
    """The bits of an inner block in a group of the n lines for which a block of `width` bits agrees; none if the group is small and compared whole."""
    return 0 if n <= LEAST << width else min(30 - width, max(0, round(math.log2(max(n, 1) / BY_CHANCE)) - width))


def blocks_for(n: int, agree: float, share: float = SHARE) -> list[np.ndarray]:
    """The bits of all blocks for n lines: as many as let `share` of the pairs meet of whose bits `agree` agree."""
    width = group_bits(n)
    inside = 1 - (1 - agree ** inner_width(n, width)) ** needed(agree ** inner_width(n, width), INSIDE)
    return cut_bits(np.arange(WIDTH), width, needed(agree**width * inside, share))


def inner_blocks(block: np.ndarray, number: int, n: int, agree: float) -> list[np.ndarray]:
    """The bits of the inner blocks of a group of that block, which has this number, of n lines."""
    width = inner_width(n, len(block))
    return cut_bits(np.setdiff1d(np.arange(WIDTH), block), width, needed(agree**width, INSIDE), number, WIDTH)


def cells_of(f1: np.ndarray, f2: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """The value of each block (columns) for each line (rows)."""
    kind = np.float32 if max(map(len, blocks)) <= 24 else np.float64  # whole numbers below 2**24 and 2**53
    weights = np.zeros((WIDTH, len(blocks)), kind)
    for i, block in enumerate(blocks):
        weights[block, i] = 2.0 ** np.arange(len(block))[::-1]
    out = np.empty((len(f1), len(blocks)), np.uint32)
    for at in range(0, len(f1), 2048):
        own = np.stack((f1[at : at + 2048], f2[at : at + 2048]), axis=1).astype("<i8").view(np.uint8)
        out[at : at + 2048] = np.unpackbits(own, axis=1).astype(kind) @ weights
    return out


def allowed(size: np.ndarray) -> np.ndarray:
    """Bits by which a line may differ from one as long or longer."""
    return np.where(size <= SHORT, BITS_SHORT, BITS).astype(np.uint8)


def side_by_side(group: tuple[np.ndarray, ...], ends: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Places (i, j) and bits of near lines of fitting lengths in cells that are sorted by size; ends has where each line's cell ends, `at` the lines to look from."""
    f1, f2, size = group
    most, far = allowed(size), size * similarity - 1e-9
    for first in range(0, len(at), ROWS):
        own, lag = at[first : first + ROWS], 1
        upto, least = ends[own], size[own]
        while len(own):
            other = own + lag
            stays = other < upto
            stays[stays] = far[other[stays]] <= least[stays]  # the next ones are longer still
            if not stays.all():
                own, other, upto, least = own[stays], other[stays], upto[stays], least[stays]
            apart = np.bitwise_count(f1[own] ^ f1[other]) + np.bitwise_count(f2[own] ^ f2[other])
            near = np.flatnonzero(apart <= most[own])
            if len(near):
                yield own[near], other[near], apart[near]
            lag += 1


def within_cell(group: tuple[np.ndarray, ...], start: int, end: int, similarity: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for one large cell, some rows at a time."""
    f1, f2, size = (x[start:end] for x in group)
    most, n = allowed(size), end - start
    for at in range(0, n - 1, 64):
        upto = min(at + 64, n)
        last = int(np.searchsorted(size, int(size[upto - 1] / similarity) + 1, side="right"))
        apart = np.bitwise_count(f1[at:upto, None] ^ f1[None, at:last]) + np.bitwise_count(f2[at:upto, None] ^ f2[None, at:last])
        near = np.flatnonzero(apart <= most[at:upto, None])
        i, j = np.divmod(near, last - at)
        keep = (i < j) & (size[at + j] * similarity - 1e-9 <= size[at + i])
        yield start + at + i[keep], start + at + j[keep], apart.ravel()[near[keep]]


def nearest_of(n: int, found: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of pairs (i, j, bits) of n lines, some at a time, the one with the fewest bits of each line (ties: the first found)."""
    best, partner = np.full(n, 255, np.uint8), np.full(n, -1)
    for i, j, bits in found:
        for one, two in ((i, j), (j, i)):
            order = np.argsort(bits, kind="stable")[::-1]  # of a line that comes several times the last one written has the fewest
            closer = order[bits[order] < best[one[order]]]
            best[one[closer]], partner[one[closer]] = bits[closer], two[closer]
    own = np.flatnonzero(partner >= 0)
    return own, partner[own], best[own]


def gathered_pairs(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same pairs, more of them at a time."""
    held, n = [], 0
    for own in found:
        held.append(own)
        n += len(own[0])
        if n >= PAIRED:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def met_inside(f1: np.ndarray, f2: np.ndarray, size: np.ndarray, inner: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Places (i, j) and bits of near lines of a group that agree in one of the inner blocks, once each; lines are sorted by size."""
    cells = cells_of(f1, f2, inner).T
    cells = np.ascontiguousarray(cells, np.uint16 if max(map(len, inner)) <= 16 else np.uint32)
    for k, cell in enumerate(cells):
        order = np.argsort(cell, kind="stable")
        cell, group = cell[order], (f1[order].view(np.uint64), f2[order].view(np.uint64), size[order])
        edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        sizes = np.diff(edges)
        every, ends = np.repeat(sizes, sizes), np.repeat(edges[1:], sizes)
        large = (within_cell(group, int(edges[c]), int(edges[c + 1]), similarity) for c in np.flatnonzero(sizes > SIDE).tolist())
        for i, j, bits in gathered_pairs(chain(side_by_side(group, ends, np.flatnonzero((every > 1) & (every <= SIDE)), similarity), chain.from_iterable(large))):
            i, j = order[i], order[j]
            new = np.ones(len(i), bool)
            for before in cells[:k]:
                new &= before[i] != before[j]
            if new.any():
                yield i[new], j[new], bits[new]


def group_links(group: np.ndarray, inner: list[np.ndarray], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, bits) of a group of records that meet in an inner block: the nearest of each line, or of rooted records all with different roots."""
    group = group[np.argsort(group["size"], kind="stable")]
    found = met_inside(*(np.ascontiguousarray(group[c]) for c in ("f1", "f2", "size")), inner, similarity)

    def batch(i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        a, b = group["id"][i], group["id"][j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits.astype(np.int32))], ["a", "b", "bits"])

    if "root" not in group.dtype.names:
        yield batch(*nearest_of(len(group), found))
        return
    root = np.ascontiguousarray(group["root"])
    for i, j, bits in found:
        other = root[i] != root[j]
        if other.any():
            yield batch(i[other], j[other], bits[other])


def met(lines: DataFrame, blocks: list[np.ndarray], n: int, similarity: float, group: int = GROUP, hot: int = HOT, part: int = PART, agree: float = AGREE, first: int = 0) -> DataFrame:
    """(a, b, bits) of n lines (id, f1, f2, size) for the given blocks, a < b, of which the first has that number: the nearest
    of each line that agrees in a block and an inner block of it; with a column root all that have different roots."""
    rooted = "root" in lines.columns
    kind = ROOTED if rooted else RECORD
    width = len(blocks[0])
    leading = min(width, group_bits(n, group))  # bits of a block that name a group
    inner = [[np.concatenate((b[leading:], more)) for more in inner_blocks(b, first + i, n, agree)] for i, b in enumerate(blocks)]
    blocks = [b[:leading] for b in blocks]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(blocks), 1 << leading), np.int64)
        for batch in gathered(batches, 1 << 16):
            cells = cells_of(*(batch.column(i).to_numpy() for i in (0, 1)), blocks)
            for i in range(len(blocks)):
                total[i] += np.bincount(cells[:, i], minlength=1 << leading)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["name", "n"])

    limit = max(hot, n >> 16)
    large = lines.select("f1", "f2").mapInArrow(counted, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).collect() if n > limit else []
    parts = {r.name: -(-r.n // part) for r in large}  # under 65,536 groups of each block can be that large

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1 << 17):
            ids, f1, f2, size, *roots = (c.to_numpy() for c in batch.columns)
            cells = cells_of(f1, f2, blocks)
            for i in range(len(blocks)):
                record = np.empty(len(ids), kind)
                if rooted:
                    record["root"] = roots[0]
                record["size"], record["id"], record["f1"], record["f2"] = size, ids, f1, f2
                names = cells[:, i]
                order = np.argsort(names.astype(np.uint16) if leading <= 16 else names, kind="stable")
                record, names = record[order], names[order]
                edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1], [True]))).tolist()
                rows = []
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    name, own = int(names[s]) + (i << leading), record[s:e]
                    if name not in parts:
                        rows.append((name, 0, own.tobytes()))
                        continue
                    of = (mixed(own["id"].astype(np.uint64)) % np.uint64(parts[name])).astype(np.int64)
                    for p in range(parts[name]):
                        if len(mine := own[of == p]):
                            rows += [(name, 1 + min(p, q) * parts[name] + max(p, q), mine.tobytes()) for q in range(parts[name]) if q != p]
                yield from packed_rows(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for name, pair, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (name, pair) != now:
                    yield from group_links(np.frombuffer(b"".join(held), kind), inner[now[0] >> leading], similarity)
                    held = []
                now = (name, pair)
                held.append(data)
        if held:
            yield from group_links(np.frombuffer(b"".join(held), kind), inner[now[0] >> leading], similarity)

    rows = lines.select("id", "f1", "f2", "size", *(["root"] if rooted else [])).mapInArrow(dealt, "name long, pair long, data binary")
    return rows.repartition("name", "pair").sortWithinPartitions("name", "pair").mapInArrow(compare, PAIRS)


def candidates(lines: DataFrame, n: int, n_few: int, similarity: float) -> DataFrame:
    """Candidate pairs (a, b, bits) of lines (id, f1, f2, size and, if known, root), a < b, by the blocks for n lines, of them n_few short ones.

    Blocks are taken some at a time, so that only their records are on disk.
    """
    few = lines.filter(F.col("size") <= SHORT)
    found = []
    for some, m, agree in ((lines, n, AGREE), (few, n_few, AGREE_SHORT)):
        blocks, each = blocks_for(m, agree), max(ROUND, ROUND * n // max(m, 1))
        if "root" in lines.columns:
            each = len(blocks)  # few lines are left
        for at in range(0, len(blocks) if m else 0, each):
            found.append(cut(met(some, blocks[at : at + each], m, similarity, agree=agree, first=at)))
            freed(lines.sparkSession)
    if not found:
        found = [lines.sparkSession.createDataFrame([], PAIRS)]
    few_tasks = reduce(DataFrame.unionByName, found).coalesce(max(1, *(x.rdd.getNumPartitions() for x in found)))
    return cut(few_tasks.distinct())


# -- verification ---------------------------------------------------------------------------------


def line_filter(wanted: DataFrame, bits: int) -> bytes:
    """A filter of so many bits with those set that k1 of the wanted lines names: the lowest bit of a byte is its first.

    Tasks set the bits of whole chunks, so the driver gets CHUNKS rows at most, of the filter's size together.
    """
    each = bits // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(batch.column(1).to_numpy())
            for own in np.split(at, np.flatnonzero(np.diff(at // each)) + 1):
                if len(own):
                    chunks.setdefault(int(own[0]) // each, np.zeros(each, bool))[own % each] = True
        for chunk, ones in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(ones, bitorder="little").tobytes()], pa.binary())], ["chunk", "data"])

    at = F.expr(f"cast(pmod(k1, {bits}) as int)")
    rows = wanted.select(F.floor(at / each).cast("int").alias("chunk"), at.alias("at")).repartition("chunk").mapInArrow(run, "chunk int, data binary")
    out = bytearray(bits >> 3)
    for chunk, data in rows.collect():
        out[chunk * (each >> 3) : (chunk + 1) * (each >> 3)] = data
    return bytes(out)


def line_texts(docs: DataFrame, wanted: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """(id, line): the normalised lines of the wanted (id, k1, k2).

    The keys are told to the tasks by a bit filter of bounded size, so only lines that pass it move. A fuller
    filter lets more lines pass, never fewer.
    """
    bits = min(FILTER[1], max(FILTER[0], 1 << math.ceil(math.log2(8 * wanted.count() + 1))))
    sent = docs.sparkSession.sparkContext.broadcast(line_filter(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, seen = np.frombuffer(sent.value, np.uint8), set()
        for batch in by_bytes(batches, 0, 1 << 20):
            found = Lines(batch.column(0).cast(pa.binary()).to_pylist())
            if not len(found):
                continue
            keys, part = found.keys(), found.takes_part(min_words)
            at = keys[:, 0] & (bits - 1)
            near = np.flatnonzero(part & (filled[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)).tolist()
            own = [i for i, k in zip(near, keys[near, 0].tolist(), strict=True) if k not in seen]
            if len(seen) < REMEMBERED:  # only spares rows
                seen.update(keys[own, 0].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys[own, 0]), pa.array(keys[own, 1]), pa.array([found.lines[i].decode("utf-8", "surrogatepass") for i in own], pa.string())], ["k1", "k2", "line"])

    some = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "k1 long, k2 long, line string")
    return some.join(wanted, ["k1", "k2"]).groupBy("id").agg(F.first("line").alias("line"))


def within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance of two texts is at most `most`; their common ends are left out first."""
    if abs(len(x) - len(y)) > most:
        return False
    a, n = 0, min(len(x), len(y))
    if x[:n] == y[:n]:
        a = n
    else:
        step = 1 << max(0, n.bit_length() - 1)
        while step:  # the length of the common beginning, by halving
            if a + step <= n and x[a : a + step] == y[a : a + step]:
                a += step
            step >>= 1
    x, y = x[a:], y[a:]
    n, b = min(len(x), len(y)), 0
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        if b + step <= n and x[len(x) - b - step : len(x) - b] == y[len(y) - b - step : len(y) - b]:
            b += step
        step >>= 1
    x, y = x[: len(x) - b], y[: len(y) - b]
    if max(len(x), len(y)) <= most:
        return True
    if not x or not y:
        return False
    return script_cost(x.split(" "), y.split(" ")) <= most or edits(x, y, most) is not None


def script_cost(x: list[str], y: list[str]) -> int:
    """The cost of one way to edit words x into y, a bound of the edit distance from above: words are left out, put in or exchanged."""
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
        elif i + 1 < n and x[i + 1] == y[j]:
            cost, i = cost + len(x[i]) + 1, i + 1
        elif j + 1 < m and x[i] == y[j + 1]:
            cost, j = cost + len(y[j]) + 1, j + 1
        else:
            cost, i, j = cost + max(len(x[i]), len(y[j])), i + 1, j + 1
    return cost + sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j


def edits(x: Sequence, y: Sequence, most: int) -> int | None:
    """The edit distance of two sequences (neither empty) if it is at most `most`: bit-parallel (Myers 1999)."""
    at: dict = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, distance, left = full, 0, len(x), len(y)
    for c in y:
        eq = at.get(c, 0)
        flat = ((eq & up) + up ^ up | eq) & full
        rise, fall = down | ~(flat | up) & full, up & flat
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        left -= 1
        if distance - left > most:
            return None
        eq |= down
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1 | ~(eq | rise)) & full, rise & eq
    return distance if distance <= most else None


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of lines with an edit similarity of `similarity` or more: 1 - distance / longer length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            lines = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            near = pa.array([within(x, y, int(max(len(x), len(y)) * (1 - similarity) + 1e-9)) for x, y in lines], pa.bool_())
            yield batch.select(["a", "b"]).filter(near)

    one, two = texts.select(F.col("id").alias("a"), F.col("line").alias("x")), texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, bits) the one with the fewest bits of each line, once."""
    best = lambda c: pairs.groupBy(c).agg(F.min(F.struct("bits", "a", "b")).alias("p")).select("p.a", "p.b")
    return best("a").unionByName(best("b")).distinct()


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of groups (node, root) that links (x, y) of different roots connect further; lines of no group are roots of their own.

    Only the roots are linked, which are few; as a root is the least of its group, so is the one of what is merged.
    """
    above = cut(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    freed(groups.sparkSession)
    new = above.select(F.col("node").alias("root"), F.col("root").alias("over"))
    old = groups.join(new, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    return cut(old.unionByName(above.join(groups, "node", "left_anti").select("node", "root")))


def groups_of(docs: DataFrame, keys: DataFrame, text_col: str, min_words: int, similarity: float, tables: list[str]) -> DataFrame:
    """(node, root) of the ids of lines that verified links connect.

    Of the first pass the nearest pair of each line is verified, then every other pair that is not connected yet; of the
    second pass all that are not. Nothing is thinned that verification has not decided.
    """
    fuzzy = keys.filter("f1 IS NOT NULL").select("id", "f1", "f2", "size")
    n, n_few = fuzzy.agg(F.count("*"), F.count_if(F.col("size") <= SHORT)).first()
    pairs = candidates(fuzzy, n, n_few, similarity)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = cut(keys.join(ids, "id", "left_semi").select("id", "k1", "k2", "f1", "f2", "size"))
    texts = stored(line_texts(docs, wanted.select("id", "k1", "k2"), text_col, min_words), tables)

    def known(rows: DataFrame, groups: DataFrame, line: str, name: str) -> DataFrame:
        own = rows.join(groups.select(F.col("node").alias(line), F.col("root").alias(name)), line, "left")
        return own.withColumn(name, F.coalesce(name, line))

    def linked(found: DataFrame, groups: DataFrame) -> DataFrame:
        """groups after verification of pairs (a, b) of different groups."""
        more = cut(verified(found.select("a", "b"), texts, similarity))
        freed(docs.sparkSession)
        if more.isEmpty():
            return groups
        return merged(groups, known(known(more, groups, "a", "x"), groups, "b", "y").select("x", "y"))

    def apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return known(known(rows, groups, "a", "x"), groups, "b", "y").filter("x <> y")

    tried = cut(nearest(pairs))
    sure = cut(verified(tried, texts, similarity))
    groups = cut(components(sure))
    freed(docs.sparkSession)
    groups = linked(apart(pairs.join(tried, ["a", "b"], "left_anti"), groups), groups)
    again = cut(known(wanted.select("id", "f1", "f2", "size"), groups, "id", "root"))
    left = candidates(again, n, n_few, similarity).select("a", "b").join(pairs, ["a", "b"], "left_anti")
    return linked(left, groups)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, short: bool = False) -> DataFrame:
    """(doc_id, dropped): for each document that loses lines, their numbers from 0, ascending.

    Of the lines of a group all but the first by (doc_id, line number) go. Lines that are too short to take part
    stay, or with `short` take part as exact copies. Documents with a null id take no part; rows of one id are
    treated alike. Null and empty texts and empty tables have no lines. Columns other than the id and the text are
    not read.
    """
    tables: list[str] = []
    known = docs.filter(F.col(id_col).isNotNull())
    lines = stored(occurrences(known, id_col, text_col, min_words, short), tables)
    distinct = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), *(F.min(c).alias(c) for c in ("f1", "f2", "size")), F.count("*").alias("n"))
    keys = stored(distinct.withColumn("id", F.monotonically_increasing_id()), tables)
    groups = groups_of(known, keys, text_col, min_words, similarity, tables)
    named = groups.join(keys.select(F.col("id").alias("node"), "first"), "node")
    led = named.groupBy("root").agg(F.min("first").alias("led"))
    moved = groups.join(led, "root").select(F.col("node").alias("id"), "led")
    kept = cut(keys.join(moved, "id", "left").filter("n > 1 OR led IS NOT NULL").select("k1", "k2", "n", F.coalesce("led", "first").alias("kept")))
    gone = joined_by_share(lines.select("k1", "k2", "doc_id", "line_no"), kept, ["k1", "k2"], "n").filter("NOT (doc_id = kept.doc_id AND line_no = kept.line_no)")
    out = cut(gone.select("doc_id", "line_no").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("dropped")))
    for path in tables:
        removed(docs.sparkSession, path)
    return out


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, short: bool = False, count_col: str = "n_lines", dropped_col: str = "dropped") -> DataFrame:
    """docs with text without its dropped lines, and two more columns, n_lines and dropped (an array, never null).

    All rows and columns stay; null and empty texts stay as they are (a null text has 0 lines); see dropped_lines()
    for the rest. A column of docs that bears the name of one of the two more is replaced; count_col and dropped_col
    choose other names.
    """
    gone_id, gone_lines = free_name(docs, "gone_id"), free_name(docs, "gone_lines")
    gone = dropped_lines(docs, id_col, text_col, min_words, similarity, short).select(F.col("doc_id").alias(gone_id), F.col("dropped").alias(gone_lines))
    joined = docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left")
    own, text = F.coalesce(gone_lines, F.array().cast("array<int>")), F.col(text_col)
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(own, i)), "\n")
    count = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).cast("long")
    columns = {c: F.col(c) for c in docs.columns} | {text_col: F.when(F.size(own) == 0, text).otherwise(left)} | {count_col: count, dropped_col: own}
    return joined.select(*(c.alias(name) for name, c in columns.items()))
