"""Language-model scoring with a hierarchical Pitman-Yor model, fitted by Gibbs sampling.

*Model.* Tokens are lower-cased words and one end per text (spelled as the empty word). Every token sits in the
restaurant of the token before it (the first of a text in that of the end), whose tables serve words. These context
restaurants share a parent: their tables are the customers of the word restaurant, and its
tables are the customers of the spelling model below, which writes a word byte by byte up to a closing
space. Spelling restaurants are contexts of the three bytes before, whose parents drop the farthest
byte, down to the empty context and a uniform base; restaurants with the same shorter context share
that parent. Context bytes are held as classes (64, 64 and 16 of them), so the
spelling model has at most ``2**24`` cells whatever the corpus is: that bounds what the
driver holds and what is broadcast. Pairs of words are all kept and grow with the corpus.

As in the base score, all words that training does not have are one type: its base probability is
what the spelling model leaves for strings outside the vocabulary, so after every context the probabilities of the
vocabulary and of that type sum to one.

*Gibbs sweeps.* A sweep seats every pair's customers anew, one after the other, given the word probabilities and
the other tables of its context as the sweep before left them; the tables become customers of the words, which are seated given
the spelling model of the sweep before; then the tables' spellings are
counted, and the spelling restaurants are seated level by level, each sending its tables to its parent.
Past ``SINGLE`` customers of one dish, customers are seated in blocks of an eighth of
those present: the block's new tables are their expected number, rounded at random. Random numbers
are hashes of the dish and the sweep, so reruns agree. After ``BURN_IN`` sweeps the predictive
probabilities of ``SAMPLES`` sweeps are averaged. Discounts come from counts of counts.

*Scale.* The vocabulary lives in shards by word hash. The pairs live in a square grid of shards, the row by the context's hash and the
column by the word's, so a hot context or word is spread over a whole row or column. In a sweep a pair shard asks the ``1 << WORD_BITS`` word shards of
its row for its contexts' tables and those of its column for its words' probabilities (of pairs seen twice or more), and
sends back how many tables they have: rows in proportion to the number of pair shards, not to its product with that of word
shards. Pairs seen once always have one table and are counted once. Documents
are dealt into chunks; a chunk asks each shard once for its distinct words and pairs and gets counts and
probabilities back, so neither the vocabulary nor occurrences are broadcast or shuffled one by one. Chunks are scored in ``TURNS`` turns, so that
only a part of the texts, questions and answers is on disk at once. Shuffle
files of a finished step are given up with it, where Spark can do so.

Defined results: null text counts as empty (one token, the end); without training texts every
count is zero and every token is the unknown type, of probability 1; a null id is dealt and held out by its hash of 0;
repeated rows are scored and learned as often as they occur; an empty table gives an empty
one; other columns are ignored. Words are named by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.op3_fertility import ranges
from framefold.llm.scratch import chunk_of, drop_stored, power_of_two, stored, table, text_bytes
from framefold.llm.words import _LOWER, Words, mix, slices
from framefold.session import scratch_path

FOLDS = 10
CHUNK_BYTES = 8 << 20
BURN_IN = 2
SAMPLES = 3
SINGLE = 64
STRENGTH = 1.0
TURNS = 2  # the chunks are scored in so many turns, each of which gives up its shuffle files before the next
PAIRS_HELD = 5 << 17  # tokens whose pairs a task gathers before it sends them
PAIR_SHARD = 16 << 20  # bytes of text to a shard
WORD_BITS = 3  # word shards to a row of the grid of pair shards, in bits
SPELT = 1 << 15  # words that are spelt at once
MOST_BITS = 10  # of a side of the grid of pair shards
SPACE = 32
END = np.uint64(0x5DEECE66D1234567)  # name of the end token
LEVEL_BITS = (0, 6, 12, 16)  # context bits of each level

#: Context classes of bytes: 0 before the word, 1-26 letters, 27 digits, 28 other ASCII, 29-63 others.
CLASS = np.full(256, 28, np.int32)
CLASS[97:123] = np.arange(1, 27)
CLASS[48:58] = 27
CLASS[128:] = 29 + np.arange(128) % 35
CLASS[SPACE] = 0


def uniform(name: np.ndarray, step: int) -> np.ndarray:
    return (mix(name + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * 2.0 ** -53


def seat(name: np.ndarray, customers: np.ndarray, new: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables of each dish after its customers sat down one by one.

    ``new``: the weight of a new table for the dish, (strength + discount * tables) * base.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    falling = -customers[order]
    n, turn = 1, 0
    while True:
        active = order[:np.searchsorted(falling, -n, "left")]  # dishes with more than n customers
        if not len(active):
            return tables.astype(np.int64)
        block = 1 if n < SINGLE else n // 8
        turn += 1
        size = np.minimum(customers[active] - n, block)
        a, t = new[active], tables[active]
        p = a / (a + n + (size - 1) / 2 - discount * t)
        tables[active] = np.minimum(t + np.floor(size * p + uniform(name[active], 1000 * sweep + turn)), n + size)
        n += block


def positions(blob: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of every byte and closing space, first position of each word).

    A cell is context << 8 | byte; the nearest byte has the lowest context bits.
    """
    size = length + 1
    first = np.cumsum(size) - size
    seq = np.full(int(size.sum()), SPACE, np.uint8)
    seq[ranges(first, length)] = blob
    at = np.arange(len(seq), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    c = CLASS[seq]
    before = [np.where(at >= k, np.concatenate([np.zeros(k, np.int32), c[:-k]])[:len(c)], 0) for k in (1, 2, 3)]
    context = before[0] | before[1] << 6 | (before[2] % 16) << 12
    return context << 8 | seq, first


def picked(blob: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spellings of some of the words."""
    start = np.cumsum(length) - length
    return blob[ranges(start[which], length[which])], length[which]


def spelt(blob: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
    """(from, to, ``positions``) of so many words at a time."""
    cut = np.concatenate([[0], np.cumsum(length)])
    for lo in range(0, len(length), SPELT):
        hi = min(lo + SPELT, len(length))
        yield lo, hi, positions(blob[cut[lo]:cut[hi]], length[lo:hi])


def log10_under(models: list["Spelling"], blob: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log10 probability of each spelling, a row for each model."""
    out = np.zeros((len(models), len(length)))
    for lo, hi, placed in spelt(blob, length):
        for x, model in zip(out, models, strict=True):
            x[lo:hi] = model.log10_at(*placed)
    return out


@dataclass
class Spelling:
    """One sample of the spelling model and of the word restaurant's totals."""

    parent: np.ndarray  # P(byte | two context bytes), dense
    cells: np.ndarray  # seen cells of the top level, in order
    own: np.ndarray  # their part of the probability
    rest: np.ndarray  # share of the parent, per context
    unseen: float = 1.0  # probability of strings outside the vocabulary
    tables: float = 0.0
    discount: float = 0.5
    tokens: float = 0.0

    def own_of(self, cell: np.ndarray) -> np.ndarray:
        """``own`` of any cells (0: not seen): a bit for each cell, and the number of seen cells before each 64."""
        if not len(self.cells):
            return np.zeros(len(cell))
        if "seen" not in self.__dict__:
            seen = np.zeros(1 << (LEVEL_BITS[3] + 8), bool)
            seen[self.cells] = True
            self.seen = np.packbits(seen, bitorder="little").view("<u8")
            count = np.bitwise_count(self.seen).astype(np.int32)
            self.earlier = np.cumsum(count, dtype=np.int32) - count
        at, bit = cell >> 6, (cell & 63).astype(np.uint64)
        word = self.seen[at]
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        hit = (word >> bit & np.uint64(1)).astype(bool)
        return np.where(hit, self.own[np.minimum(self.earlier[at] + below, len(self.own) - 1)], 0.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "earlier")}  # a worker makes its own

    def log10_at(self, cell: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = self.own_of(cell) + self.rest[cell >> 8] * self.parent[cell & ((1 << (LEVEL_BITS[2] + 8)) - 1)]
        return np.add.reduceat(np.log10(p), first)

    def log10(self, blob: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 probability of each spelling."""
        return log10_under([self], blob, length)[0]

    def fresh(self, spelled: np.ndarray) -> np.ndarray:
        return (STRENGTH + self.discount * self.tables) * 10.0 ** spelled

    def word_tables(self, name: np.ndarray, count: np.ndarray, blob: np.ndarray, length: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of the words whose customers sit down under this model."""
        new, many = np.zeros(len(name)), np.flatnonzero(count > 1)  # a single customer has one table whatever its weight
        new[many] = self.fresh(self.log10(*picked(blob, length, many)))
        return seat(name, count, new, self.discount, sweep)

    def word(self, count: np.ndarray, tables: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Predictive probability of the words, given the tables that the sweep gave them."""
        return (count - self.discount * tables + self.fresh(spelled)) / (STRENGTH + self.tokens)


def flat() -> Spelling:
    return Spelling(np.full(1 << (LEVEL_BITS[2] + 8), 1 / 256), np.zeros(0, np.int64), np.zeros(0), np.ones(1 << LEVEL_BITS[3]))


def discount_from(one: float, two: float) -> float:
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def discount_of(n: np.ndarray) -> float:
    return discount_from(float((n == 1).sum()), float((n == 2).sum()))


def seat_spellings(cells: np.ndarray, n: np.ndarray, last: Spelling, sweep: int) -> Spelling:
    """Seat the levels from the longest contexts down, then build the predictive tables upwards."""
    dense_last = {3: None, 2: last.parent}
    levels = {}
    for level in (3, 2, 1, 0):
        bits = LEVEL_BITS[level]
        context = cells >> 8
        below = (cells & 255) | (context & ((1 << LEVEL_BITS[level - 1]) - 1)) << 8 if level else cells
        d = discount_of(n)
        seats = np.bincount(context, minlength=1 << bits)
        base = dense_last[2][below] if level == 3 else average(last.parent, LEVEL_BITS[level - 1])[below] if level else np.full(len(cells), 1 / 256)
        t = seat(cells.astype(np.uint64) + np.uint64(level << 32), n, (STRENGTH + d * seats[context]) * base, d, sweep)
        levels[level] = (cells, n, t, d)
        cells, back = np.unique(below, return_inverse=True)
        n = np.bincount(back, weights=t, minlength=len(cells)).astype(np.int64)
    p = np.full(256, 1 / 256)
    for level in (0, 1, 2, 3):
        c, n, t, d = levels[level]
        bits = LEVEL_BITS[level]
        context = c >> 8
        total = STRENGTH + np.bincount(context, weights=n, minlength=1 << bits)
        rest = (STRENGTH + d * np.bincount(context, weights=t, minlength=1 << bits)) / total
        own = (n - d * t) / total[context]
        if level == 3:
            return Spelling(p, c, own, rest)
        lower = 0 if not level else LEVEL_BITS[level - 1]
        full = np.arange(1 << (bits + 8))
        p = rest[full >> 8] * p[(full & 255) | ((full >> 8) & ((1 << lower) - 1)) << 8]
        p[c] += own
    raise AssertionError


def average(parent: np.ndarray, bits: int) -> np.ndarray:
    """The dense predictive table of a shorter context: the mean over the bytes dropped."""
    return parent.reshape(-1, 1 << (bits + 8)).mean(axis=0)


def token_names(w: Words) -> np.ndarray:
    return w.hashes(lower=True)


def runs(ordered: np.ndarray) -> np.ndarray:
    """First place of every run of equal values."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)])


def merged(names: list, counts: list, blobs: list, lengths: list):
    """Concatenated parts with equal names added up."""
    name, count, blob, length = map(np.concatenate, (names, counts, blobs, lengths))
    order = np.argsort(name)
    name = name[order]
    run = runs(name)
    return name[run], np.add.reduceat(count[order], run), *picked(blob, length, order[run])


def raw(a: np.ndarray, kind: str) -> bytes:
    """The numbers by byte place, names (``<u8``, in order) as differences: what compression of shuffles and files makes small."""
    a = np.ascontiguousarray(a).astype(kind).ravel()
    if kind == "<u8":
        a = np.diff(a, prepend=np.uint64(0))
    return a.view("u1").reshape(len(a), a.itemsize).T.tobytes()


def numbers(data: bytes | None, kind: str) -> np.ndarray:
    """What ``raw`` wrote."""
    planes = np.frombuffer(data or b"", "u1").reshape(np.dtype(kind).itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(a, dtype=np.uint64) if kind == "<u8" else a


def taken(row: dict, column: str, kind: str) -> np.ndarray:
    return numbers(row[column], kind)


def each_row(part) -> Iterator[dict]:
    """The rows of a batch or table, one in memory at a time."""
    for i in range(part.num_rows):
        yield {c: part.column(c)[i].as_py() for c in part.schema.names}


SHARD = "shard int, names binary, counts binary, blob binary, lengths binary"


def shard_rows(name, count, blob, length, bits: int) -> pa.Table:
    shard = (name >> np.uint64(64 - bits)).astype(np.int32)
    edge = np.flatnonzero(np.diff(shard, prepend=-1))
    stop = np.append(edge, len(name))[1:]
    cut = np.concatenate([[0], np.cumsum(length)])
    cells = lambda a, kind: pa.array([raw(a[i:j], kind) for i, j in zip(edge, stop, strict=True)], pa.binary())
    return pa.table({"shard": pa.array(shard[edge]), "names": cells(name, "<u8"), "counts": cells(count, "<i8"),
                     "blob": pa.array([blob[cut[i]:cut[j]].tobytes() for i, j in zip(edge, stop, strict=True)], pa.binary()), "lengths": cells(length, "<i4")})


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, c, b, k = (taken(row, x, kind) for x, kind in (("names", "<u8"), ("counts", "<i8"), ("blob", "u1"), ("lengths", "<i4")))
    return n, c, b, k.astype(np.int64)


def rows_of(batch) -> Iterator[tuple]:
    return map(unpack, each_row(batch))


def with_ends(w: Words, of_word: np.ndarray, of_end: int | np.uint64) -> np.ndarray:
    """A value for every token of the slice, ends included."""
    return np.insert(of_word, w.bounds[1:], of_end)


def sequence(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token before, token, text) of every token of the slice, ends included."""
    token = with_ends(w, token_names(w), END)
    return np.concatenate([[END], token[:-1]]), token, np.insert(w.doc, w.bounds[1:], np.arange(len(w.counts)))


def pair_names(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


#: The bits of a number, a zero between them and above.
SPREAD = sum((np.arange(1 << MOST_BITS, dtype=np.uint64) >> np.uint64(i) & np.uint64(1)) << np.uint64(2 * i) for i in range(MOST_BITS))


def grid_shard(before: np.ndarray, token: np.ndarray, bits: int) -> np.ndarray:
    """The pair shard: the first half of ``bits`` bits of both names, taken in turns."""
    half = np.uint64(64 - bits // 2)
    return SPREAD[before >> half] << np.uint64(1) | SPREAD[token >> half]


def pair_keys(before: np.ndarray, token: np.ndarray, bits: int) -> np.ndarray:
    """Names of pairs that begin with their shard."""
    return grid_shard(before, token, bits) << np.uint64(64 - bits) | pair_names(before, token) >> np.uint64(bits)


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def by_shard(names: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the runs of ordered names."""
    shard = (names >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(shard, prepend=-1))
    yield from zip(shard[edge].tolist(), edge.tolist(), np.append(edge, len(names))[1:].tolist(), strict=True)


#: Rows for pair shards (kind 0) and for word shards (contexts: kind 1, words: kind 2, the vocabulary: kind 3).
PAIRS = "kind int, shard int, names binary, others binary, u binary, w binary, counts binary, keys binary, singles binary, blob binary, lengths binary, one long, two long"
ASKED = "kind int, shard int, chunk int, base int, names binary"
WORDS = SHARD + ", fixed binary, customers binary, tables binary, seats binary"


def counted(texts: DataFrame, word_bits: int, bits: int) -> DataFrame:
    """Training pairs by shard of pairs (kind 0), the pairs of each context (kind 1) and word (kind 2), seen once or oftener, by shard of words, and
    the training tokens' counts and spellings (kind 3: words ``one``, tokens ``two``)."""
    kind = "kind int, shard int, names binary, others binary, each binary, at binary, counts binary, blob binary, lengths binary"

    def rows(tokens, start, length, data) -> pa.Table:
        """The pairs of neighbours (contexts, words, pairs of each context, word and count of each pair) and the tokens after the first."""
        order = np.argsort(tokens)
        names = tokens[order]
        new = np.concatenate([[True], names[1:] != names[:-1]])
        names, rank = names[new], np.empty(len(tokens), np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64) - np.uint64(1)
        one, length = order[new], length[order[new]]
        words = shard_rows(names, np.bincount(rank[1:].astype(np.int64), minlength=len(names)), _LOWER[data[ranges(start[one], length)]], length, word_bits)
        out = [(3, r["shard"], r["names"], None, None, None, r["counts"], r["blob"], r["lengths"]) for r in each_row(words)]
        size = np.uint64(len(names).bit_length())  # at most 21 bits for 2 * PAIRS_HELD tokens, beside 2 * MOST_BITS
        u, w = rank[:-1], rank[1:]
        code = np.sort(grid_shard(names[u], names[w], bits) << size * np.uint64(2) | u << size | w)
        first = runs(code)
        count, code = np.diff(first, append=len(code)), code[first]
        mask = (np.uint64(1) << size) - np.uint64(1)
        shard, u, w = (code >> size * np.uint64(2)).astype(np.int64), code >> size & mask, code & mask
        edge = runs(shard)
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(code)], strict=True):
            begin = runs(u[i:j])
            other, at = np.unique(w[i:j], return_inverse=True)
            out.append((0, int(shard[i]), raw(names[u[i:j][begin]], "<u8"), raw(names[other], "<u8"), raw(np.diff(begin, append=j - i), "<i4"), raw(at, "<i4"), raw(count[i:j], "<i4"), None, None))
        return as_table(out, kind)

    def pieces(held) -> Iterator[pa.RecordBatch]:
        """Slices put together, cut where one alone is too long; each piece begins with the token before it."""
        ends = np.cumsum([0, *[len(data) for *_, data in held]])
        tokens, length = (np.concatenate([[first], *[x[i] for x in held]]) for i, first in ((0, END), (2, 0)))
        start = np.concatenate([[0], *[x[1] + at for x, at in zip(held, ends[:-1], strict=True)]])
        data, size = np.concatenate([x[3] for x in held]), len(tokens) - 1
        cut = np.linspace(0, size, size // (2 * PAIRS_HELD) + 2).astype(np.int64)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield from rows(tokens[lo:hi + 1], start[lo:hi + 1], length[lo:hi + 1], data).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, w in slices(batch.column(0)):
                held.append((sequence(w)[1], with_ends(w, w.starts, 0), with_ends(w, w.ends - w.starts, 0), w.data))
                size += len(held[-1][0])
                if size >= PAIRS_HELD:
                    yield from pieces(held)
                    held, size = [], 0
        if held:
            yield from pieces(held)

    def merge(part: pa.Table) -> pa.Table:
        if part.column("kind")[0].as_py():
            words = merged(*zip(*rows_of(part), strict=True))
            total = (len(words[0]), int(words[1].sum()))
            return as_table([(3, r["shard"], r["names"], None, None, None, r["counts"], None, None, r["blob"], r["lengths"], *total) for r in each_row(shard_rows(*words, word_bits))], PAIRS)
        names, others, each, ats, counts = ([taken(row, c, k) for row in each_row(part)] for c, k in
                                            (("names", "<u8"), ("others", "<u8"), ("each", "<i4"), ("at", "<i4"), ("counts", "<i4")))
        before = np.concatenate([[0], np.cumsum([len(x) for x in others])])
        names, u = np.unique(np.concatenate(names), return_inverse=True)
        others, w = np.unique(np.concatenate(others), return_inverse=True)
        code = np.repeat(u, np.concatenate(each)) << 32 | w[np.concatenate([at + np.int64(b) for at, b in zip(ats, before[:-1], strict=True)])]
        order = np.argsort(code)
        code = code[order]
        first = runs(code)
        c = np.add.reduceat(np.concatenate(counts)[order], first, dtype=np.int64)
        u, w = code[first] >> 32, code[first] & 0xFFFFFFFF
        many, key = c > 1, pair_keys(names[u], others[w], bits)
        order = np.flatnonzero(many)[np.argsort(key[many])]
        (some_u, at_u), (some_w, at_w) = (np.unique(x[order], return_inverse=True) for x in (u, w))
        out = [(0, part.column("shard")[0].as_py(), raw(names[some_u], "<u8"), raw(others[some_w], "<u8"), raw(at_u, "<i4"), raw(at_w, "<i4"), raw(c[order], "<i8"),
                raw(key[order], "<u8"), raw(np.sort(key[~many]), "<u8"), None, None, int((~many).sum()), int((c == 2).sum()))]
        for kind, own, at in ((1, names, u), (2, others, w)):
            once, often = (np.bincount(at, weights=x, minlength=len(own)) for x in (~many, many))
            for shard, i, j in by_shard(own, word_bits):
                out.append((kind, shard, raw(own[i:j], "<u8"), None, raw(once[i:j], "<i8"), raw(often[i:j], "<i8"), *[None] * 5, 0, 0))
        return as_table(out, PAIRS)

    return texts.mapInArrow(count, kind).groupBy("kind", "shard").applyInArrow(merge, PAIRS)


def state(held: dict, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(customers, tables as a context, tables as a word) of a shard's words in one of the kept states, -1 the last."""
    size = len(held["names"])  # eight bytes a number, as names have
    first = which * size if which >= 0 else len(held["customers"]) - size
    return tuple(numbers(held[c][first:first + size], "<i8") for c in ("customers", "tables", "seats"))


def placed(names: np.ndarray, part: pa.Table, kind: int, columns: tuple[str, ...]) -> list[np.ndarray]:
    """Sums of the columns of the rows of a kind, per name."""
    out = [np.zeros(len(names), np.int64) for _ in columns]
    for row in each_row(part):
        if row["kind"] == kind:
            at = np.searchsorted(names, taken(row, "names", "<u8"))
            for x, c in zip(out, columns, strict=True):
                x[at] += taken(row, c, "<i8")  # a row names a word once
    return out


def first_state(pairs: DataFrame) -> DataFrame:
    """The vocabulary with one table for every distinct pair; ``fixed``: those of pairs seen once."""
    def start(held: pa.Table, part: pa.Table) -> pa.Table:
        out = []
        for row in each_row(held):
            name, _, blob, length = unpack(row)
            (t1, t2), (n1, n2) = (placed(name, part, kind, ("u", "w")) for kind in (1, 2))
            seats = flat().word_tables(name, n1 + n2, blob, length, 0)
            out.append((*(row[c] for c in ("shard", "names", "counts", "blob", "lengths")), raw(np.stack([n1, t1]), "<i8"), raw(n1 + n2, "<i8"), raw(t1 + t2, "<i8"), raw(seats, "<i8")))
        return as_table(out, WORDS)

    told = pairs.where("kind IN (1, 2)").select("kind", "shard", "names", "u", "w")
    words = pairs.where("kind = 3").select("shard", "names", "counts", "blob", "lengths")
    return words.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(start, WORDS)


@dataclass
class Fitted:
    """The fitted model: words and pairs in shards, spelling samples."""

    held: DataFrame  # words (kind 0) and pairs (kind 1)
    samples: Broadcast  # sent once: the later jobs read the same copy
    unknown: np.ndarray  # probability of the unknown type in each sample
    discount: float  # of the context restaurants
    tokens: int
    distinct: int
    word_bits: int
    pair_bits: int


HELD = "kind int, " + WORDS
SEATED = "kind int, shard int, names binary, counts binary"
TOLD = "chunk int, kind int, base int, vals binary"


def sweep_pairs(words: DataFrame, pairs: DataFrame, asked: DataFrame, model: Broadcast, discount: float, sweep: int, word_bits: int) -> DataFrame:
    """Pairs seated anew: tables by pair shard (kind 0), and what they add to words as contexts (kind 1) and as words (kind 2)."""
    def tell(questions: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if questions.num_rows and held.num_rows:
            row = next(each_row(held))
            name, _, blob, length = unpack(row)
            n, t, seats = state(row, -1)
            places = [(q["chunk"], q["kind"], q["base"], np.searchsorted(name, taken(q, "names", "<u8"))) for q in each_row(questions)]
            some, p = np.zeros(len(name), bool), np.zeros(len(name))
            for _, kind, _, at in places:
                some[at] |= kind == 2
            p[some] = model.value.word(n[some], seats[some], model.value.log10(*picked(blob, length, np.flatnonzero(some))))
            out = [(chunk, kind, base, raw(t[at], "<i8") if kind == 1 else raw(p[at], "<f4")) for chunk, kind, base, at in places]
        return as_table(out, TOLD)

    def sit(held: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in each_row(held):
            names, others, u, w, c = (taken(row, x, k) for x, k in (("names", "<u8"), ("others", "<u8"), ("u", "<i4"), ("w", "<i4"), ("counts", "<i8")))
            t, p = np.zeros(len(names)), np.zeros(len(others))
            for a in each_row(told):
                x, some = (t, taken(a, "vals", "<i8")) if a["kind"] == 1 else (p, taken(a, "vals", "<f4"))
                x[a["base"]:a["base"] + len(some)] = some
            tables = seat(pair_names(names[u], others[w]), c, (STRENGTH + discount * t[u]) * p[w], discount, sweep)
            out.append((0, row["shard"], None, raw(tables, "<i8")))
            for kind, own, at in ((1, names, u), (2, others, w)):
                sums = np.bincount(at, weights=tables, minlength=len(own))
                for shard, i, j in by_shard(own, word_bits):
                    out.append((kind, shard, raw(own[i:j], "<u8"), raw(sums[i:j], "<i8")))
        return as_table(out, SEATED)

    told = asked.groupBy("shard").cogroup(words.drop("fixed").groupBy("shard")).applyInArrow(tell, TOLD)
    return pairs.where("kind = 0").select("shard", "names", "others", "u", "w", "counts").groupBy("shard").cogroup(told.groupBy("chunk")).applyInArrow(sit, SEATED)


def next_state(words: DataFrame, seated: DataFrame, model: Broadcast, sweep: int, keep: bool) -> DataFrame:
    """The vocabulary after a sweep under ``model``; ``keep``: the state before it is kept as well."""
    def put(held: pa.Table, part: pa.Table) -> pa.Table:
        out = []
        for row in each_row(held):
            name, _, blob, length = unpack(row)
            fixed = taken(row, "fixed", "<i8").reshape(2, -1)
            (t,), (n,) = (placed(name, part, kind, ("counts",)) for kind in (1, 2))
            now = (fixed[0] + n, fixed[1] + t, model.value.word_tables(name, fixed[0] + n, blob, length, sweep))
            before = [row[c] if keep else b"" for c in ("customers", "tables", "seats")]
            out.append((*(row[c] for c in ("shard", "names", "counts", "blob", "lengths", "fixed")), *(b + raw(x, "<i8") for b, x in zip(before, now, strict=True))))
        return as_table(out, WORDS)

    return words.groupBy("shard").cogroup(seated.where("kind > 0").groupBy("shard")).applyInArrow(put, WORDS)


def spell(words: DataFrame, now: Spelling, sweep: int) -> Spelling:
    """The spellings of the words' tables, which sat down under ``now``, seated anew."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                _, _, blob, length = unpack(row)
                n, _, t = state(row, -1)
                for lo, hi, (cell, _) in spelt(blob, length):
                    both = np.sort(cell.astype(np.int64) << 39 | np.repeat(t[lo:hi], length[lo:hi] + 1))
                    first = runs(both >> 39)
                    each = np.add.reduceat(both & (1 << 39) - 1, first)
                    yield pa.RecordBatch.from_arrays([pa.array(both[first] >> 39), pa.array(each)], ["cell", "n"])
                sums = [t.sum(), n.sum(), (n == 1).sum(), (n == 2).sum()]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([-1, -2, -3, -4])), pa.array(np.array(sums).astype(np.int64))], ["cell", "n"])

    # At most 2**24 cells: the bound of the spelling model.
    got = words.drop("fixed").mapInArrow(tables, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    cell, n = got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    total = dict(zip(cell[cell < 0].tolist(), n[cell < 0].tolist(), strict=True))
    after = seat_spellings(cell[cell >= 0], n[cell >= 0], now, sweep)
    after.tables, after.tokens = float(total.get(-1, 0)), float(total.get(-2, 0))
    after.discount = discount_from(total.get(-3, 0), total.get(-4, 0))
    return after


def stored_kinds(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written with a folder for each kind, so that one kind can go before the other; and the path."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_answers(spark: SparkSession, path: str, last: int = 2) -> None:
    """Delete what word shards have read of a table of pairs."""
    for kind in range(1, last + 1):
        drop_folder(spark, f"{path}/kind={kind}")


@contextmanager
def finished_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a step are deleted with its end: every step is a written table, so nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fit(training: DataFrame, size: int) -> Fitted:
    """The model of all texts of ``training``; ``size``: bytes, for the number of shards."""
    spark = training.sparkSession
    side = min(MOST_BITS, power_of_two(size / PAIR_SHARD, 4, 1 << 2 * MOST_BITS).bit_length() // 2)
    word_bits, pair_bits = side + WORD_BITS, 2 * side
    pairs, pairs_path = stored_kinds(counted(training, word_bits, pair_bits), "pairs")
    total = {r.kind: (int(r.one), int(r.two)) for r in pairs.groupBy("kind").agg(F.sum("one").alias("one"), F.sum("two").alias("two")).collect()}
    distinct_words, tokens = total.get(3, (0, 0))
    discount = discount_from(*total.get(0, (0, 0)))

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                for kind, names in ((1, taken(row, "names", "<u8")), (2, taken(row, "others", "<u8"))):
                    yield from as_table([(kind, s, row["shard"], i, raw(names[i:j], "<u8")) for s, i, j in by_shard(names, word_bits)], ASKED).to_batches()

    asked = stored(pairs.where("kind = 0").select("shard", "names", "others").mapInArrow(questions, ASKED), "asked")
    words = stored(first_state(pairs), "words")
    drop_answers(spark, pairs_path, 3)
    now = spell(words, flat(), 0)
    samples, seats = [], []
    for sweep in range(1, BURN_IN + SAMPLES + 1):
        sent = spark.sparkContext.broadcast(now)
        seated, seated_path = stored_kinds(sweep_pairs(words, pairs, asked, sent, discount, sweep, word_bits), "seated")
        last, words = words, stored(next_state(words, seated, sent, sweep, sweep > BURN_IN + 1), "words")
        sent.destroy()
        drop_stored(spark, last)
        now = spell(words, now, sweep)
        if sweep > BURN_IN:
            samples.append(now)
            seats.append((seated, seated_path))
            drop_answers(spark, seated_path)
        else:
            drop_folder(spark, seated_path)
    drop_stored(spark, asked)
    sent = spark.sparkContext.broadcast(samples)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, blob, length in rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array([float((10.0 ** x).sum())]) for x in log10_under(sent.value, blob, length)], [f"s{i}" for i in range(SAMPLES)])

    mass = words.select("names", "counts", "blob", "lengths").mapInArrow(seen, ", ".join(f"s{i} double" for i in range(SAMPLES))).agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(SAMPLES)]).first()
    unknown = np.array([(STRENGTH + s.discount * s.tables) * max(1e-9, 1.0 - m) / (STRENGTH + s.tokens) for s, m in zip(samples, mass, strict=True)])

    def own(held: pa.Table, parts: pa.Table) -> pa.Table:
        """Customers less discounted tables, the mean over the samples, of a shard's pairs."""
        out = []
        for row in each_row(held):
            t = [taken(x, "counts", "<i8") for x in each_row(parts)]
            out.append((1, row["shard"], row["keys"], raw(taken(row, "counts", "<i8") - discount * np.mean(t, axis=0), "<f4"), row["singles"], *[None] * 5))
        return as_table(out, HELD)

    seats_of = seats[0][0]
    for more, _ in seats[1:]:
        seats_of = seats_of.unionByName(more)
    pair_rows = pairs.where("kind = 0").select("shard", "counts", "keys", "singles").groupBy("shard").cogroup(seats_of.where("kind = 0").groupBy("shard")).applyInArrow(own, HELD)
    found = stored(words.select(F.lit(0).alias("kind"), "*").unionByName(pair_rows), "model")
    drop_stored(spark, words)
    for path in (pairs_path, *(path for _, path in seats)):
        drop_folder(spark, path)
    return Fitted(found, sent, unknown, discount, tokens, distinct_words, word_bits, pair_bits)


def scores(docs: DataFrame, model: Fitted, chunks: int, ends: bool = True, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row of (id, text).

    Without ``ends`` texts are beginnings: how they end is not scored. ``turn`` (which, of how many): the rows of
    every so many-th chunk only; all turns together give every row once.
    """
    sent, unknown, discount, tokens, distinct_words = model.samples, model.unknown, model.discount, model.tokens, model.distinct
    all_bits = (model.word_bits, model.pair_bits)
    keyed = docs.select(chunk_of(chunks, F.col("id"), F.col("text")).alias("chunk"), "id", "text").where(F.col("chunk") % turn[1] == turn[0])

    def chunk_tokens(part: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
        """Slices of the chunk, and the names of its words (after that of the end) and pairs as they occur."""
        found, tokens, pairs = [], [np.array([END])], [np.zeros(0, np.uint64)]
        for lo, hi, w in slices(part.column("text")):
            before, token, doc = sequence(w)
            found.append((lo, hi, doc.astype(np.int32)))
            tokens.append(token)
            pairs.append(pair_keys(before, token, all_bits[1]))
        return found, np.concatenate(tokens), np.concatenate(pairs)

    def ask(part: pa.Table) -> pa.Table:
        chunk, out = part.column("chunk")[0].as_py(), []
        for kind, names in enumerate(chunk_tokens(part)[1:]):
            names = np.sort(names)
            names = names[runs(names)]
            out += [(kind, s, chunk, i, raw(names[i:j], "<u8")) for s, i, j in by_shard(names, all_bits[kind])]
        return as_table(out, ASKED)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        """Words: count, probability and tables in each sample. Pairs: customers less discounted tables."""
        out = []
        if held.num_rows and asked.num_rows:
            row = next(each_row(held))
            name = taken(row, "names", "<u8")
            if row["kind"]:
                own, single = taken(row, "counts", "<f4"), taken(row, "blob", "<u8")
            else:
                _, count, blob, length = unpack(row)
                states, spelled_ = [state(row, i) for i in range(SAMPLES)], log10_under(sent.value, blob, length)
                each = [s.word(n, seats, x) for s, (n, _, seats), x in zip(sent.value, states, spelled_, strict=True)] + [t for _, t, _ in states]
            for i in range(asked.num_rows):
                q = numbers(asked.column("names")[i].as_py(), "<u8")

                def find(x, q=q):
                    at = np.minimum(np.searchsorted(x, q), max(len(x) - 1, 0))
                    return at, (x[at] == q if len(x) else np.zeros(len(q), bool))

                at, hit = find(name)
                if row["kind"]:
                    values = np.where(find(single)[1], 1 - discount, 0.0)
                    values[hit] = own[at[hit]]
                    counts = b""
                else:
                    counts = raw(np.where(hit, count[at], 0), "<i8")
                    values = np.stack([np.where(hit, x[at], 0) for x in each])
                out.append((row["kind"], asked.column("chunk")[i].as_py(), asked.column("base")[i].as_py(), counts, raw(values, "<f4")))
        return as_table(out, "kind int, chunk int, base int, counts binary, vals binary")

    def finish(part: pa.Table, told: pa.Table) -> pa.Table:
        found, *both = chunk_tokens(part)
        names, word_at = np.unique(both.pop(0), return_inverse=True)
        pairs, pair_at = np.unique(both.pop(), return_inverse=True)
        word_at, pair_at = word_at.astype(np.int32), pair_at.astype(np.int32)
        count, each, own = np.zeros(len(names), np.int64), np.zeros((2 * SAMPLES, len(names))), np.zeros(len(pairs))
        for row in each_row(told):
            lo, values = row["base"], taken(row, "vals", "<f4")
            if row["kind"]:
                own[lo:lo + len(values)] = values
            else:
                c = taken(row, "counts", "<i8")
                count[lo:lo + len(c)], each[:, lo:lo + len(c)] = c, values.reshape(2 * SAMPLES, -1)
        p, open_ = each[:SAMPLES], (STRENGTH + discount * each[SAMPLES:])
        p[:, count == 0] = unknown[:, None]
        base = np.log10((count + 0.1) / (tokens + 0.1 * (distinct_words + 1)))
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        done = 0
        for lo, hi, doc in found:
            # A slice begins and ends with an end, whose place is the first of ``word_at``.
            own_at, w = pair_at[done:done + len(doc)], word_at[1 + done:1 + done + len(doc)]
            u = np.concatenate([word_at[:1], w[:-1]])
            done += len(doc)
            chance = own[own_at].copy()
            for s in range(SAMPLES):
                chance += open_[s, u] * p[s, w] / SAMPLES
            log = np.log10(chance / (STRENGTH + count[u]))
            scored = np.ones(len(w)) if ends else (names[w] != END).astype(float)
            total = lambda x: np.bincount(doc, weights=x * scored, minlength=hi - lo)  # noqa: B023, E731
            for k, x in (("n_tokens", 1.0), ("n_known", count[w] > 0), ("base_score", base[w]), ("score", log)):
                out[k].append(total(x))
        return pa.table({"id": part.column("id"), **{k: pa.array(np.concatenate(v).astype(np.int64 if k[0] == "n" else float) if v else [], pa.int64() if k[0] == "n" else pa.float64()) for k, v in out.items()}})

    asked = keyed.groupBy("chunk").applyInArrow(ask, ASKED)
    told = asked.groupBy("kind", "shard").cogroup(model.held.groupBy("kind", "shard")).applyInArrow(answer, "kind int, chunk int, base int, counts binary, vals binary")
    kind = docs.schema["id"].dataType.simpleString()
    return keyed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, training: DataFrame) -> tuple[DataFrame, int]:
    """Scores of all rows of (id, text) under a model of the ``training`` texts, and the number of training tokens."""
    spark, size = docs.sparkSession, text_bytes(docs)
    chunks = size // CHUNK_BYTES + 1
    turns = min(TURNS, chunks)
    with finished_shuffles_go(spark):
        model = fit(training.select("text"), size)
        found = [stored(scores(docs, model, chunks, turn=(i, turns)), "scores") for i in range(turns)]
    drop_stored(spark, model.held)
    model.samples.destroy()
    return reduce(DataFrame.unionByName, found), model.tokens


def op8_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (a token)."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS == 0
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").alias("id"), "text")
    found, tokens = score_texts(docs.select("id", "text"), docs.where(~held_out))
    return (found.withColumnRenamed("id", "doc_id")
            .select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
                    F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")))


QUERIES = {"op8_hpylm": op8_hpylm}
ORACLE: dict[str, str] = {}
