"""Operators on documents against brute force, with every edge case of the fixture."""
from __future__ import annotations

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framefold.llm import catalog, op1_mix, op2_license_scan, op3_fertility, op4_bpe, op6_language, op7_substring_dedup, op8_hpylm, op10_minhash
from framefold.llm.components import components
from framefold.llm.words import slices

from .conftest import SCHEMA, prose, rows, words


def known() -> list[tuple]:
    return [r for r in rows() if r[0] is not None]


def test_words_are_found_at_every_slice_size():
    texts = [r[1] for r in rows()]
    for limit in (1, 100, 1 << 20):
        got = []
        for _, _, w in slices(pa.array(texts), limit):
            got += [[w.text(i).decode() for i in range(a, b)] for a, b in zip(w.bounds, w.bounds[1:])]
        assert got == [words(t) for t in texts]


def brute_repeats(window: int) -> dict[int, tuple]:
    first: dict[tuple, int] = {}
    for i, t, *_ in known():
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t, *_ in known():
        w = words(t)
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(docs, window):
    got = op7_substring_dedup.remove_repeats(docs, window)
    assert set(docs.columns) <= set(got.columns)
    found = got.collect()
    want = brute_repeats(window)
    assert len(found) == len(rows())
    for r in found:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.kept_text == " ".join(words(r.text))
        else:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
            assert r.n_removed == sum(s.end - s.start for s in r.removed) and r.group == "clash"


def brute_components(k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t, *_ in known():
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(docs, k):
    found = op10_minhash.near_duplicates(docs, k).collect()
    want = brute_components(k)
    assert len(found) == len(rows())
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_minhash_finds_chains_of_near_copies(spark):
    """A chain in which neighbours link and others do not, and copies around one base."""
    r, texts = random.Random(5), {}
    chain = prose(50, 150).split()
    for i in range(12):
        texts[i] = " ".join(chain)
        for _ in range(5):
            chain[r.randrange(len(chain))] = f"new{r.randrange(10 ** 6)}"
    base = prose(51, 200).split()
    for i in range(100, 160):
        copy = list(base)
        for _ in range(r.randrange(0, 14)):
            copy[r.randrange(len(copy))] = f"edit{r.randrange(10 ** 6)}"
        texts[i] = " ".join(copy)
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in texts.items()}
    link = {(i, j) for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    label = {i: i for i in sets}
    for _ in sets:
        for i, j in link:
            label[i] = label[j] = min(label[i], label[j])
    got = op10_minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2)
    assert {x.doc_id: x.component_id for x in got.collect()} == label


@pytest.mark.parametrize("items", [op10_minhash.BLOCK_ITEMS, 400])
def test_minhash_finds_near_copies_among_many_of_one_template(spark, monkeypatch, items):
    """Forms of one template share buckets without linking; the pairs of near copies among them are no bucket's centre."""
    monkeypatch.setattr(op10_minhash, "BLOCK_ITEMS", items)
    r, texts = random.Random(8), {}
    template = prose(60, 200).split()
    for i in range(240):
        form = list(template)
        for j in r.sample(range(len(form)), 18):
            form[j] = f"field{r.randrange(10 ** 9)}"
        texts[i] = " ".join(form)
    for i in range(240, 252):
        copy = texts[i - 240].split()
        copy[r.randrange(len(copy))] = f"typo{i}"
        texts[i] = " ".join(copy)
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in texts.items()}
    link = {(i, j) for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(i, i - 240) for i in range(240, 252)} <= link and len(link) < 40
    label = {i: i for i in sets}
    for _ in sets:
        for i, j in link:
            label[i] = label[j] = min(label[i], label[j])
    got = op10_minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2)
    assert {x.doc_id: x.component_id for x in got.collect()} == label


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_quality_counts(docs):
    found = op3_fertility.quality(docs).collect()
    assert len(found) == len(rows())
    texts = {r[0]: r[1] for r in known()}
    for r in found:
        if r.doc_id is None:
            continue
        t, w = texts[r.doc_id] or "", words(texts[r.doc_id])
        places = collections.defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i:i + 8])].append(i)
        repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    keep = {r.doc_id for r in op3_fertility.kept_documents(docs).collect()}
    assert keep == {r.doc_id for r in found if r.kept}


def test_quality_bands_reject_what_is_far_from_its_language(spark):
    plain = [(i, prose(i, 100), "en", "a", 0) for i in range(200)]
    odd = [(900 + i, " ".join(["一龥龤"] * 60 + words(prose(i, 40))), "en", "a", 0) for i in range(3)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in op3_fertility.quality(spark.createDataFrame(plain + odd, SCHEMA)).collect()}
    assert all(got[i][1] for i in range(200)) and not any(got[900 + i][1] for i in range(3))


def test_quality_bands_reach_sparse_groups(spark):
    """Odd texts of a length, a language or a script of their own, and in a table of a few texts."""
    def odd(i: int, n: int) -> str:
        r = random.Random(i)
        return " ".join("".join(chr(r.randrange(0x9F00, 0x9FA0)) for _ in range(3)) for _ in range(n))

    plain = [(i, prose(i, 100), "en", "a", 0) for i in range(200)]
    few = [(300 + i, prose(300 + i, 100), "de", "a", 0) for i in range(20)] + [(330, prose(330, 260), "en", "a", 0)]
    strange = [(900, odd(1, 200), "en", "a", 0), (901, odd(2, 60), "de", "a", 0), (902, odd(3, 60), "xx", "a", 0), (903, odd(4, 60), None, "a", 0)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in op3_fertility.quality(spark.createDataFrame(plain + few + strange, SCHEMA)).collect()}
    assert not any(base for base, _ in got.values())
    assert all(got[r[0]][1] for r in plain + few) and not any(got[i][1] for i in (900, 901, 902, 903))
    small = op3_fertility.quality(spark.createDataFrame(plain[:12] + strange[1:2], SCHEMA)).collect()
    assert {r.doc_id for r in small if not r.kept} == {901}


def test_quality_bands_against_sorted_values(spark):
    r = random.Random(3)
    texts = [(g, False, r.gauss(4, 1), r.random() / 9, r.random()) for g, n in (("en 6", 137), ("de 6", 50), ("fr 6", 49)) for _ in range(n)]
    texts += [("en 6", True, 9.9, 1.0, 1.0)] * 500
    found = op3_fertility.bands(spark.createDataFrame(texts, ["group", "base_failed", *op3_fertility.MEASURES])).collect()
    assert {x["of"] for x in found} == {"en 6", "de 6"}
    for x in found:
        for i, (m, ((a, b), least)) in enumerate(op3_fertility.MEASURES.items()):
            step = (b - a) / op3_fertility.BINS
            have = sorted(a + step * (int((t[2 + i] - a) / step) + 0.5) for t in texts if t[0] == x["of"] and not t[1])
            q1, q2, q3 = (have[max(1, -(-len(have) * k // 4)) - 1] for k in (1, 2, 3))
            half = op3_fertility.WIDTH * max(q3 - q1, least)
            assert x[f"low_{m}"] == pytest.approx(q2 - half) and x[f"high_{m}"] == pytest.approx(q2 + half)


def test_mix(docs):
    found = op1_mix.copies(docs)
    assert found.orderBy("doc_id").collect() == op1_mix.copies(docs.repartition(5)).orderBy("doc_id").collect()
    found = found.collect()
    sizes = collections.Counter()
    for _, t, _, source, _ in rows():
        sizes[source] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_sources = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        full = {s for s in open_sources if share[s] >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s], left = 2 * sizes[s], left - 2 * sizes[s]
        open_sources -= full
    target |= share
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert r.copies in {math.floor(r.target / r.source_size), math.ceil(r.target / r.source_size)} and r.copies <= 2
    out = collections.Counter(r.doc_id for r in op1_mix.mix(docs).collect())
    want = collections.Counter()
    for r in found:
        want[r.doc_id] += r.copies
    assert out == +want


def test_licenses(spark):
    t = op2_license_scan.TEMPLATES
    long = t["MIT text"].split()
    cut = " ".join(long[:20] + ["inserted", "words"] + long[20:30] + long[33:])
    texts = [f"é {t['MIT']}. {prose(1, 30)} {t['MIT'].upper()}!", prose(2, 50) + " " + cut + " " + prose(3, 50), prose(4, 200), None, "",
             t["CC-BY-NC-4.0"], " ".join(long[:20]), f"{t['GPL-3.0']}\n{t['Apache-2.0']}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in op2_license_scan.scan(docs).collect()}
    assert set(got) == {(0, "MIT"), (1, "MIT text"), (5, "CC-BY-NC-4.0"), (7, "GPL-3.0"), (7, "Apache-2.0")}
    assert [texts[0][s.start:s.end].lower() for s in got[0, "MIT"].spans] == [t["MIT"].lower()] * 2
    r = got[1, "MIT text"]
    n = len(long)
    assert 0.9 < r.coverage < 1 and texts[1][r.spans[0].start:r.spans[0].end] == cut.rstrip(".") and r.n_spans == 1 and n > 50


def test_licenses_in_a_list_and_after_partial_mentions(spark):
    t = op2_license_scan.TEMPLATES
    listed = " ".join(f"file{i} {t['MIT']}" for i in range(10))
    close = " ".join([t["MIT"]] * 7)
    notice = t["MPL-2.0"].split()
    scraps = " ".join([*notice[:5], "x", *notice[:5], *notice])  # votes at diagonals 0, 6 and 11
    docs = spark.createDataFrame(list(enumerate([listed, close, scraps])), "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in op2_license_scan.scan(docs).collect()}
    assert [listed[s.start:s.end] for s in got[0, "MIT"].spans] == [t["MIT"]] * 10
    assert [close[s.start:s.end] for s in got[1, "MIT"].spans] == [t["MIT"]] * 7
    assert got[2, "MPL-2.0"].n_spans == 1 and got[2, "MPL-2.0"].coverage == 1
    assert scraps[got[2, "MPL-2.0"].spans[0].start:] == t["MPL-2.0"]


def test_bpe_equals_the_library_and_decodes(docs):
    lib = Tokenizer.from_file(public_tokenizers.path(op4_bpe.FILE))
    got = op4_bpe.decode(op4_bpe.encode(docs)).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False) and r.group == "clash"
    assert sorted(map(str, op4_bpe.encode_and_decode(docs).select("doc_id", "decoded").collect())) == sorted(str(r) for r in op4_bpe.decode(op4_bpe.encode(docs)).select("doc_id", "decoded").collect())


def test_decoding_leaves_out_what_is_no_id(spark):
    rows_ = [([320, -1, None, 10 ** 8, 49407],), ([],), (None,)]
    got = [r.decoded for r in op4_bpe.decode(spark.createDataFrame(rows_, "ids array<int>")).collect()]
    assert got[0].endswith("<|endoftext|>") and len(got[0].split(" ")) == 2 and not got[1] and not got[2]


def test_language(spark):
    r = random.Random(1)
    parts = {"xx": ["ka", "ko", "ki", "tak"], "yy": ["ul", "el", "ol", "lum"], "zz": ["ни", "на", "по", "ст"]}

    def text(lang):
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(30))

    train = spark.createDataFrame([(lang, text(lang)) for lang in parts for _ in range(30)], "lang string, text string")
    names, models = op6_language.prototypes(train)
    assert names == ["xx", "yy", "zz"]
    test = [(f"{lang}", text(lang)) for lang in parts for _ in range(20)] + [("und", None), ("und", ""), ("und", "12 . 3")]
    got = op6_language.predictions(spark.createDataFrame(test, "want string, text string"), names, models, ["want"]).collect()
    assert all(x.want == x.lang_pred and 0 <= x.score <= 1 for x in got) and len(got) == len(test)
    names, models = op6_language.prototypes(train.limit(0))
    assert {x.lang_pred for x in op6_language.predictions(train, names, models, ["lang"]).collect()} == {"und"}


def test_scores(spark, docs):
    keyed = docs.select(F.col("doc_id").alias("id"), "text")
    training = keyed.where("id % 2 = 0 OR id IS NULL")
    found, tokens = op8_hpylm.score_texts(keyed, training)
    count: collections.Counter = collections.Counter()
    token = lambda t: [*words("".join(c.lower() if c.isascii() else c for c in t or "")), None]
    for i, t, *_ in rows():
        if i is None or i % 2 == 0:
            count.update(token(t))
    n, v = sum(count.values()), len(count)
    assert tokens == n
    texts = collections.defaultdict(list)
    for i, t, *_ in rows():
        texts[i].append(t)
    got = found.collect()
    assert len(got) == len(rows())
    for r in got:
        wanted = [(len(token(t)), sum(count[x] > 0 for x in token(t)), sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in token(t))) for t in texts[r.id]]
        assert any((r.n_tokens, r.n_known) == w[:2] and math.isclose(r.base_score, w[2], rel_tol=1e-9) for w in wanted)
        assert r.score < 0


def test_score_probabilities_sum_to_one(spark):
    train = [(i, prose(i, 50)) for i in range(30)]
    docs = spark.createDataFrame(train, "id long, text string")
    vocabulary = sorted({w for _, t in train for w in words(t)})
    model = op8_hpylm.fit(docs.select("text"), 1000)
    assert model.tokens == sum(len(words(t)) + 1 for _, t in train) and model.distinct == len(vocabulary) + 1

    def score(texts, ends):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        return {texts[r.id]: r.score for r in op8_hpylm.scores(df, model, 2, ends).collect()}

    contexts = ["", *words(train[0][1])[:2], "neverseen"]  # the beginning, seen words, an unseen word
    texts = contexts + [f"{u} {x}" for u in contexts for x in [*vocabulary, "unheardof"]]
    begun, ended = score(texts, False), score(contexts, True)
    assert begun[""] == 0
    for u in contexts:
        total = sum(10 ** (begun[f"{u} {x}"] - begun[u]) for x in [*vocabulary, "unheardof"]) + 10 ** (ended[u] - begun[u])
        assert abs(total - 1) < 1e-3


def seated_one_by_one(train, spelling, discount, word_discount, sweeps, burn_in):
    """Textbook Gibbs sampling of the two word levels: each customer leaves and sits down again. P(word | context)."""
    r = random.Random(5)
    contexts, top = collections.defaultdict(lambda: collections.defaultdict(list)), collections.defaultdict(list)
    strength = op8_hpylm.STRENGTH

    def chance_top(w):
        n, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (sum(top[w]) - word_discount * len(top[w]) + (strength + word_discount * t) * spelling[w]) / (strength + n)

    def sit(tables, d, fresh):
        at = r.choices(range(len(tables) + 1), [*(x - d for x in tables), fresh])[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return tables[at] == 1

    def leave(tables):
        at = r.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True
        return False

    def enter(u, w):
        room = contexts[u]
        if sit(room[w], discount, (strength + discount * sum(map(len, room.values()))) * chance_top(w)):
            sit(top[w], word_discount, (strength + word_discount * sum(map(len, top.values()))) * spelling[w])

    for u, w in train:
        enter(u, w)
    mean = collections.Counter()
    for sweep in range(sweeps):
        for u, w in train:
            if leave(contexts[u][w]):
                leave(top[w])
            enter(u, w)
        if sweep >= burn_in:
            for u in list(contexts):
                room = contexts[u]
                n, t = sum(map(sum, room.values())), sum(map(len, room.values()))
                for w in spelling:
                    mean[u, w] += (sum(room[w]) - discount * len(room[w]) + (strength + discount * t) * chance_top(w)) / (strength + n) / (sweeps - burn_in)
    return mean


def test_scores_agree_with_customers_seated_one_by_one(spark):
    r = random.Random(3)
    chain = {None: "abc", "a": "aab", "b": "cad", "c": "de", "d": "abcde", "e": "ab"}
    texts = []
    for _ in range(12):
        t = []
        for _ in range(r.randrange(2, 8)):
            t.append(r.choice(chain[t[-1] if t else None]))
        texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    model = op8_hpylm.fit(docs.select("text"), 1000)
    blob = np.frombuffer(b"abcde", np.uint8)
    length = np.array([1, 1, 1, 1, 1, 0])
    samples = model.samples.value
    spelling = dict(zip([*"abcde", None], np.mean([10.0 ** s.log10(blob, length) for s in samples], axis=0).tolist(), strict=True))
    pairs = [(u, w) for t in texts for u, w in zip([None, *t], [*t, None], strict=True)]
    mean = seated_one_by_one(pairs, spelling, model.discount, float(np.mean([s.discount for s in samples])), 250, 50)
    for row in op8_hpylm.scores(docs, model, 2).collect():
        t = texts[row.id]
        want = sum(math.log10(mean[u, w]) for u, w in zip([None, *t], [*t, None], strict=True))
        assert abs(row.score - want) < 0.06 * (len(t) + 1), (row, want)


def test_order_of_words_counts(spark):
    train = [(i, "the quick fox jumps over a lazy dog") for i in range(5)] + [(9, "a dog over the fox")]
    docs = spark.createDataFrame(train, "id long, text string")
    model = op8_hpylm.fit(docs.select("text"), 1000)
    probe = spark.createDataFrame([(0, "the quick fox jumps over a lazy dog"), (1, "dog lazy a over jumps fox quick the")], "id long, text string")
    got = {r.id: (r.base_score, r.score) for r in op8_hpylm.scores(probe, model, 2).collect()}
    assert math.isclose(got[0][0], got[1][0]) and got[0][1] > got[1][1] + 3


def test_empty_tables(empty, spark):
    assert op7_substring_dedup.remove_repeats(empty).count() == 0
    assert op10_minhash.near_duplicates(empty).count() == 0
    assert op3_fertility.quality(empty).count() == 0
    assert op1_mix.copies(empty).count() == 0 and op1_mix.mix(empty).count() == 0
    assert op2_license_scan.scan(empty).count() == 0
    assert op4_bpe.decode(op4_bpe.encode(empty)).count() == 0
    found, tokens = op8_hpylm.score_texts(empty.select(F.col("doc_id").alias("id"), "text"), empty)
    assert tokens == 0 and found.count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_equal_their_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF_SMALL)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_digests_of_op4(spark):
    lib, sha = Tokenizer.from_file(public_tokenizers.path(op4_bpe.FILE)), lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in catalog.QUERIES["op4_bpe"](spark, SF_SMALL).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
