"""BPE encoding by prefix-sharing trie traversal, and decoding.

The tokens of a word follow from a *last-token state* per prefix: the last token of the
encoding of a prefix is the only vocabulary entry ``t`` that ends the prefix and may stand
after the last token of the rest. Prefixes of different words that are equal have equal states,
so the distinct words of a slice are walked as a trie, level by level, and each node's state
is computed once, those of a level together. A word's encoding is read back along its states. Whether two tokens may
stand side by side follows from the merge ranks alone: they may, unless at some
rank a piece at the end of the first and one at the start of the second would merge.
Pieces of words longer than ``LONG`` bytes are walked one by one.

Words are named by 64-bit hashes. A worker keeps the encodings of up to ``CACHE_WORDS`` distinct words between slices and
tasks; a full cache is emptied, which costs time and changes nothing.

The tokenizer file is a parameter. Supported: byte-level BPE with an end-of-word suffix, any of the normaliser's ``STEPS``,
the splitting rule ``SPLIT`` (neither joins or looks across white space), plain added tokens that start with ``<|``, and no decoder
(decoding then joins the token strings by a space); others raise ValueError.

Defined results: null text counts as empty: no ids, empty decoded text; special tokens
written in a text become their ids; ids outside the vocabulary are left out in decoding, as
are nulls; an empty table gives an empty one; other columns pass through, and columns
named like the results are replaced.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framefold.llm.op3_fertility import ranges
from framefold.llm.scratch import table
from framefold.llm.words import _LOWER, Words, _powers, _prefix, _weights, held, mix, slices

FILE = "word_bpe_49k.json"
CACHE_WORDS = 300_000
PAIR_CACHE = 200_000
SLICE_BYTES = 1 << 20
DECODE_ROWS = 200
TAIL = 3
LONG = 48  # bytes of the longest piece that is walked together with others
NAME_SALT = 4
MEMO_BITS, TOKEN_BITS = 20, 24  # remembered pairs of tokens; bits of a token id
#: What words are normalised and split by, as tokenizer files state it (fixed values); other files are refused.
STEPS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SPACE = re.compile(r"\s")
PRINTABLE = re.compile(r"[\x21-\x7e]+")
#: Byte-level characters: printable bytes are themselves, the others follow from U+0100 on.
_ITSELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARACTER = dict(zip([*_ITSELF, *sorted(set(range(256)) - set(_ITSELF))], [*map(chr, _ITSELF), *map(chr, range(256, 512))], strict=False))
CHARACTERS = frozenset(CHARACTER.values())
BYTE = np.zeros(512, np.uint8)
BYTE[[ord(CHARACTER[b]) for b in range(256)]] = np.arange(256)
#: Classes of ASCII bytes: 1 letters, 2 digits, 3 others.
KIND = np.full(256, 3, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2


def reach(names: dict[str, int]) -> dict[str, int]:
    """Length of the longest name with each ending of TAIL characters."""
    out: dict[str, int] = {}
    for s in names:
        if len(s) >= TAIL:
            out[s[-TAIL:]] = max(len(s), out.get(s[-TAIL:], 0))
    return out


class Lookup:
    """Small numbers by 64-bit key, looked up many at a time (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = (4 * len(keys) + 1).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.values[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], values[free[first]]
            left = np.setdiff1d(left, free[first])
            slot[left] = slot[left] + 1 & self.last

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none."""
        slot = self.slot(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & self.last
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(self.keys[slot[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        return out


def tails(data: np.ndarray) -> np.ndarray:
    """A 16-bit number for the TAIL bytes before each position (the first positions have none: 0)."""
    out = np.zeros(len(data) + 1, np.uint32)
    d = data.astype(np.uint32)
    out[TAIL:] = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(0x9E3779B1) >> 16)[:max(0, len(data) - TAIL + 1)]
    return out


class Names:
    """The vocabulary's names as bytes: their tokens by hash, and by tail the lengths (as bits) that they may have."""

    def __init__(self, names: dict[str, int]):
        known = {BYTE[list(map(ord, s))].tobytes(): i for s, i in names.items() if 0 < len(s) <= LONG and CHARACTERS.issuperset(s)}
        size = np.array([len(s) for s in known], np.int64)
        data = np.frombuffer(b"".join(known), np.uint8)
        stop = np.cumsum(size)
        self.tokens = Lookup(hashed(data)(stop - size, stop), np.array(list(known.values()), np.int32))
        self.lengths_short = sum({1 << n for n in size.tolist() if n < TAIL})
        self.lengths = np.full(1 << 16, self.lengths_short, np.int64)
        far = size >= TAIL
        np.bitwise_or.at(self.lengths, tails(data)[stop[far]], np.int64(1) << size[far])


def hashed(data: np.ndarray):
    """A function from positions to the hashes of the bytes between them."""
    c, back = _prefix(_weights(NAME_SALT, False)[data], NAME_SALT), _powers(NAME_SALT, len(data) + 1, True)
    return lambda lo, hi: (c[hi] - c[lo]) * back[lo]


class Vocabulary:
    """Merge ranks and which tokens may stand side by side."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.suffix or spec.get("decoder") or model.get("byte_fallback"):
            raise ValueError(f"{path}: only byte-level BPE with an end-of-word suffix and no decoder is supported")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError(f"{path}: dropout, unknown tokens, inner prefixes and ignored merges are not supported")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")) or any(
                not t["content"].startswith("<|") or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain added tokens that start with <| and hold no space are supported")
        self.id: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair = self.id[left], self.id[right]
            self.rank[pair] = r
            self.parts[self.id[left + right]] = (*pair, r)
        # Lengths in symbols: an inner token has its own characters, a final one those before the suffix.
        self.inner = {s: i for s, i in self.id.items() if not s.endswith(self.suffix)}
        self.final = {s[:-len(self.suffix)]: i for s, i in self.id.items() if s.endswith(self.suffix)}
        self.inner_reach, self.final_reach = reach(self.inner), reach(self.final)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.inner_names, self.final_names = Names(self.inner), Names(self.final)
        self.size = np.zeros(1 + max(self.id.values(), default=0), np.int64)
        for s, i in (*self.inner.items(), *self.final.items()):
            self.size[i] = len(s)
        self.memo = np.zeros(1 << MEMO_BITS, np.int64)  # a pair that may stand together or not, in the last bit

    def spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The pieces at one end of a token while it is built, and the rank at which each is merged away."""
        out, gone = [], float("inf")
        while True:
            out.append((token, gone))
            if token not in self.parts:
                return out
            a, b, gone = self.parts[token]
            token = b if right else a

    def meet(self, a: int, b: int, before: float) -> bool:
        """Whether no piece ending ``a`` merges with one starting ``b`` at a rank below ``before``."""
        starts = self.spine(b, right=False)
        for x, x_gone in self.spine(a, right=True):
            for y, y_gone in starts:
                r = self.rank.get((x, y))
                # At equal ranks the pair further left merges first.
                if r is not None and r < before and r < x_gone and r <= y_gone:
                    return False
        return True

    def adjacent(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.meet(a, b, float("inf"))
        return known

    def whole(self, token: int) -> bool:
        """Whether the token's own characters are encoded as this one token."""
        known = self.alone.get(token)
        if known is None:
            a, b, r = self.parts.get(token, (-1, -1, 0))
            known = self.alone[token] = a < 0 or (self.whole(a) and self.whole(b) and self.meet(a, b, r))
        return known

    def last(self, word: str, end: int, states: list[tuple[int, int]], names: dict[str, int], longest: dict[str, int]) -> tuple[int, int]:
        """(last token, its length) of the encoding of ``word[:end]``; ``states`` has those of shorter prefixes."""
        pairs = self.pairs
        for n in range(min(end, longest.get(word[end - TAIL:end], TAIL - 1) if end >= TAIL else end), 0, -1):
            token = names.get(word[end - n:end])
            if token is not None:
                if n == end:
                    fits = self.whole(token)
                else:
                    before = states[end - n][0]
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.adjacent(before, token)
                if fits:
                    return token, n
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode_all(self, words: list[str]) -> dict[str, list[int]]:
        """Encodings of distinct non-empty words.

        Words in order are the leaves of their trie in depth-first order: ``states`` is the
        path to the current node, cut back to the prefix that the next word shares.
        """
        out, states, before = {}, [(-1, 0)], ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(len(states), len(word)):
                states.append(self.last(word, end, states, self.inner, self.inner_reach))
            token, n = self.last(word, len(word), states, self.final, self.final_reach)
            ids, end = [token], len(word) - n
            while end:
                token, n = states[end]
                ids.append(token)
                end -= n
            out[word] = ids[::-1]
            before = word
        return out


    def fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may stand after the one before (-1: it is the first)."""
        pair = (before.astype(np.int64) + 1 << TOKEN_BITS) + token + 1
        slot = (mix(pair.astype(np.uint64)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        found = self.memo[slot]
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            _, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            asked = zip(before[new[first]].tolist(), token[new[first]].tolist(), strict=True)
            fits = np.array([self.whole(b) if a < 0 else self.meet(a, b, float("inf")) for a, b in asked])
            found[new] = self.memo[slot[new]] = pair[new] << 1 | fits[back]
        return found & 1 == 1

    def last_all(self, lo: np.ndarray, end: np.ndarray, token_at: np.ndarray, key, tail: np.ndarray, names: Names) -> np.ndarray:
        """``last`` for many prefixes, from ``lo`` to ``end``; ``token_at`` has the states of shorter ones, -1 for empty ones."""
        out, left = np.full(len(end), -1, np.int32), np.arange(len(end))
        open_ = names.lengths[tail[end]] & (np.int64(2) << end - lo) - 1
        short = end - lo < TAIL  # their tails would reach into the piece before
        open_[short] = names.lengths_short & (np.int64(2) << (end - lo)[short]) - 1
        while len(left):
            if not open_.all():
                raise ValueError("no token ends a word")
            n = np.frexp(open_.astype(float))[1].astype(np.int64) - 1  # the longest first
            open_ ^= np.int64(1) << n
            start = end[left] - n
            token = names.tokens.find(key(start, end[left]))
            hit = np.flatnonzero(token >= 0)
            hit = hit[self.fit(token_at[start[hit]], token[hit])]
            out[left[hit]] = token[hit]
            rest = np.ones(len(left), bool)
            rest[hit] = False
            left, open_ = left[rest], open_[rest]
        return out

    def encode_short(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of distinct pieces of 1 to LONG bytes at ``first`` in ``data``."""
        count = len(first)
        grid = np.zeros((count, LONG), np.uint8)
        grid.reshape(-1)[ranges(np.arange(count) * LONG, length)] = data[ranges(first, length)]
        order = np.argsort(grid.view(f"S{LONG}").ravel(), kind="stable")
        grid, length = grid[order], length[order]
        # Bytes that a piece shares with the one before it, in order: its nodes down to there are that one's.
        differ = grid[1:] != grid[:-1]
        shared = np.zeros(count, np.int64)
        shared[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), LONG), length[:-1] - 1)
        first = np.cumsum(length) - length
        data = grid.reshape(-1)[ranges(np.arange(count) * LONG, length)]
        key, tail = hashed(data), tails(data)
        token_at = np.full(len(data), -1, np.int32)  # the state of the prefix before each byte
        active, depth = np.flatnonzero(length > 1), 1
        while len(active):
            own = shared[active] < depth
            lo = first[active[own]]
            token_at[first[active] + depth] = self.last_all(lo, lo + depth, token_at, key, tail, self.inner_names)[np.cumsum(own) - 1]
            depth += 1
            active = active[length[active] > depth]
        end = first + length
        token = self.last_all(first, end, token_at, key, tail, self.final_names)
        steps, active, size = [], np.arange(count), np.zeros(count, np.int64)
        while len(active):
            steps.append((active, token))
            size[active] += 1
            end = end - self.size[token]
            more = end > first[active]
            active, end = active[more], end[more]
            token = token_at[end]
        # Back in the order given; the tokens were read from the last on.
        given = np.empty(count, np.int64)
        given[order] = np.arange(count)
        size = size[given]
        stop = np.cumsum(size)
        ids = np.zeros(int(size.sum()), np.int32)
        for step, (which, token) in enumerate(steps):
            ids[stop[order[which]] - 1 - step] = token
        return ids, size

    def encode_pieces(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of non-empty pieces that stand end to end in ``data``."""
        first = np.cumsum(length) - length
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        _, which, back = np.unique(mix(hashed(data)(first, first + length)), return_index=True, return_inverse=True)
        long = length[which] > LONG
        ids, size = self.encode_short(data, first[which[~long]], length[which[~long]]) if not long.all() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        words = ["".join(map(CHARACTER.__getitem__, data[first[i]:first[i] + length[i]].tolist())) for i in which[long]]
        coded = self.encode_all(words)
        ids = np.concatenate([ids, *[np.array(coded[x], np.int32) for x in words]])
        each = np.zeros(len(which), np.int64)
        each[~long], each[long] = size, [len(coded[x]) for x in words]
        at = np.zeros(len(which), np.int64)
        at[np.argsort(long, kind="stable")] = np.cumsum(np.concatenate([size, each[long]])) - np.concatenate([size, each[long]])
        return ids[ranges(at[back], each[back])], each[back]


def split_ascii(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of printable ASCII words begin, by the rule SPLIT; ``first``: where the words do."""
    kind = KIND[data]
    begins = kind == 2
    begins[1:] |= kind[1:] != kind[:-1]
    begins[first] = True
    mark = np.flatnonzero((data == 39) & begins)  # an apostrophe that a run of other characters begins with
    if len(mark):
        end = np.append(first, len(data))[np.searchsorted(first, mark, "right")]
        after = [np.where(mark + k < end, data[np.minimum(mark + k, len(data) - 1)], 0) for k in (1, 2)]
        one = np.isin(after[0], list(b"stmd"))
        two = np.zeros(len(mark), bool)
        for a, b in (b"re", b"ve", b"ll"):
            two |= (after[0] == a) & (after[1] == b)
        begins[mark[one | two] + 1] = False
        next_ = mark + 2 + two
        begins[next_[(one | two) & (next_ < end)]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Words of a slice to ids, with the file's own normaliser and splitting rule."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        spec = json.loads(open(path, encoding="utf-8").read())
        steps = [spec["normalizer"]] if spec["normalizer"] else []
        if steps and steps[0]["type"] == "Sequence":
            steps = steps[0]["normalizers"]
        if not all(s in STEPS for s in steps):
            raise ValueError(f"{path}: the normaliser has other steps than NFC, Replace of spaces and Lowercase")
        if spec["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}:
            raise ValueError(f"{path}: words are split by another rule than the supported one")
        self.lower = STEPS[-1] in steps
        self.pattern = regex.compile(SPLIT["pattern"]["Regex"])
        self.special = re.compile("|".join(sorted(map(re.escape, self.vocabulary.special), key=len, reverse=True)) or r"(?!)")
        named = {i: s for s, i in [*self.vocabulary.id.items(), *self.vocabulary.special.items()]}
        self.strings = pa.array([named.get(i) for i in range(max(named) + 1)], pa.string())
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}  # by word hash
        self.ids = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int64)

    def pieces(self, word: str) -> list[str]:
        """The units that BPE runs on, in byte-level characters; special tokens as they are."""
        if "<|" in word and self.special.search(word):
            out, at = [], 0
            for m in self.special.finditer(word):
                out += [*self.pieces(word[at:m.start()]), m[0]]
                at = m.end()
            return out + self.pieces(word[at:])
        if PRINTABLE.fullmatch(word):  # byte-level characters are the characters themselves
            return self.pattern.findall(word.lower() if self.lower else word)
        normal = self.normalizer.normalize_str(word) if self.normalizer else word
        return [p for p, _ in self.splitter.pre_tokenize_str(normal)] if word else []

    def coded(self, w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of the words numbered ``which``."""
        size = (w.ends - w.starts)[which]
        data = w.data[ranges(w.starts[which], size)]
        first = np.cumsum(size) - size
        mark = np.zeros(len(data), bool)
        mark[:-1] = (data[:-1] == 60) & (data[1:] == 124)  # <|
        mark |= (data < 33) | (data > 126)
        plain = np.add.reduceat(mark, first, dtype=np.int64) == 0
        own = np.flatnonzero(plain)
        # Printable ASCII: byte-level characters are the characters themselves.
        ascii_data = data[ranges(first[own], size[own])]
        ascii_data = _LOWER[ascii_data] if self.lower else ascii_data
        begin = np.cumsum(size[own]) - size[own]
        starts = split_ascii(ascii_data, begin) if len(own) else begin
        owner = [own[np.searchsorted(begin, starts, "right") - 1]]
        lengths, parts = [np.diff(starts, append=len(ascii_data))], [ascii_data]
        # Others together, joined by spaces, which no step looks across; those with special tokens or other white space one by one.
        rest = np.flatnonzero(~plain)
        texts = [data[first[i]:first[i] + size[i]].tobytes().decode() for i in rest]
        odd = [("<|" in t and self.special.search(t) is not None) or SPACE.search(t) is not None for t in texts]
        together = [i for i, x in zip(rest, odd, strict=True) if not x]
        joined = " ".join(t for t, x in zip(texts, odd, strict=True) if not x)
        normal = self.normalizer.normalize_str(joined) if self.normalizer and joined else joined
        if together:
            found = self.splitter.pre_tokenize_str(normal)
            starts = np.array([0, *[i + 1 for i, c in enumerate(normal) if c == " "]])
            at = np.fromiter((x[0] for _, x in found), np.int64, len(found))
            owner.append(np.array(together)[np.searchsorted(starts, at, "right") - 1])
            lengths.append(np.fromiter((len(p) for p, _ in found), np.int64, len(found)))
            parts.append(BYTE[np.frombuffer("".join(p for p, _ in found).encode("utf-16-le"), "<u2")])
        ids, count = self.vocabulary.encode_pieces(np.concatenate(parts), np.concatenate(lengths))
        special = self.vocabulary.special
        split = {i: self.pieces(t) for i, t, x in zip(rest.tolist(), texts, odd, strict=True) if x}
        coded = self.vocabulary.encode_all(list({p for s in split.values() for p in s} - special.keys()))
        lists = [[j for p in s for j in ([special[p]] if p in special else coded[p])] for s in split.values()]
        owner = np.concatenate([*owner, np.fromiter(split, np.int64, len(split))])
        count = np.concatenate([count, np.fromiter(map(len, lists), np.int64, len(lists))])
        ids = np.concatenate([ids, *[np.array(x, np.int32) for x in lists]])
        order = np.argsort(owner, kind="stable")
        start = np.cumsum(count) - count
        return ids[ranges(start[order], count[order])], np.bincount(owner, weights=count, minlength=len(which)).astype(np.int64)

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each text)."""
        names, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        listed = names.tolist()
        if len(self.row) > CACHE_WORDS:
            self.clear()
        new = [i for i, x in enumerate(listed) if x not in self.row]
        if new:
            ids, length = self.coded(w, first[new])
            have = len(self.row)
            self.row.update((listed[i], have + j) for j, i in enumerate(new))
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, ids])
        row = np.fromiter(map(self.row.__getitem__, listed), np.int64, len(listed))[back]
        length, start = self.length[row], (np.cumsum(self.length) - self.length)[row]
        per_text = np.bincount(w.doc, weights=length, minlength=len(w.counts)).astype(np.int64)
        return self.ids[ranges(start, length)], per_text


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def strings(path: str) -> pa.Array:
    """Token strings by id (null: no such id)."""
    return encoder(path).strings


def encoding(text: str, file: str):
    """Arrow batches with ``ids`` made from ``text``, slice by slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passing = [c for c in batch.schema.names if c != "ids"]
            for lo, hi, w in slices(batch.column(text), SLICE_BYTES):
                ids, size = encoder(file).of(w) if len(w) else (np.zeros(0, np.int32), np.zeros(hi - lo, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in passing], lists], [*passing, "ids"])

    return run


def decoding(ids: str, file: str):
    """Arrow batches with ``decoded`` made from ``ids``, some rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = strings(file)
        for batch in batches:
            passing = [c for c in batch.schema.names if c != "decoded"]
            for lo in range(0, len(batch), DECODE_ROWS):
                part = batch.column(ids)[lo:lo + DECODE_ROWS]
                flat = part.flatten()
                known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), False)
                words = names.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
                keep = np.asarray(words.is_valid())
                size = np.asarray(pc.fill_null(pc.list_value_length(part), 0)).astype(np.int64)
                size = np.bincount(np.repeat(np.arange(len(part)), size)[keep], minlength=len(part))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), words.filter(pa.array(keep)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:lo + len(part)] for c in passing], pc.binary_join(lists, " ")], [*passing, "decoded"])

    return run


def with_columns(docs: DataFrame, run, added: dict[str, T.DataType], dropped: tuple[str, ...] = ()) -> DataFrame:
    passing = [docs.schema[c] for c in docs.columns if c not in added and c not in dropped]
    schema = T.StructType([*passing, *[T.StructField(c, kind) for c, kind in added.items()]])
    return docs.mapInArrow(lambda batches: (b.select(schema.names) for b in run(batches)), schema)


IDS, DECODED = {"ids": T.ArrayType(T.IntegerType())}, {"decoded": T.StringType()}


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``: array<int> of each whole text."""
    return with_columns(docs, encoding(text, path or public_tokenizers.path(FILE)), IDS)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the text that the ids stand for, special tokens included."""
    return with_columns(encoded, decoding(ids, path or public_tokenizers.path(FILE)), DECODED)


def encode_and_decode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``ids`` and ``decoded``: both steps in one Python worker."""
    file = path or public_tokenizers.path(FILE)
    to_ids, to_text = encoding(text, file), decoding("ids", file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return to_text(to_ids(batches))

    return with_columns(docs, run, IDS | DECODED, (text,))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_and_decode(docs)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE: dict[str, str] = {}
