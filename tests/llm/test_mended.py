"""Rows without id in the mix, other tokenizer files, and language profiles of scripts with many letters."""
from __future__ import annotations

import collections
import json
import random
import tracemalloc
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framefold.llm import catalog, op1_mix, op4_bpe, op6_language, op8_hpylm
from framefold.llm.words import slices

from .conftest import SCHEMA, prose


def test_rows_without_id_are_taken_in_proportion(spark):
    docs = spark.createDataFrame([(None, prose(i, 10), "en", "a", 1) for i in range(400)] + [(i, prose(i, 20), "en", "b", 1) for i in range(100)], SCHEMA)
    got = [r for r in op1_mix.copies(docs).collect() if r.source == "a"]
    taken, target = sum(r.size * r.copies for r in got), got[0].target
    assert len(got) == 400 and abs(taken - target) < 0.08 * target
    assert len({r.copies for r in got}) == 2
    assert op1_mix.mix(docs).where("source = 'a'").count() == sum(r.copies for r in got)


def variant(tmp_path, name: str, change) -> str:
    spec = json.load(open(public_tokenizers.path(op4_bpe.FILE), encoding="utf-8"))
    change(spec)
    path = tmp_path / name
    path.write_text(json.dumps(spec), encoding="utf-8")
    return str(path)


TEXTS = ["Hello World THE quick fox", "É Straße ΣΑΣ it's 42 <|endoftext|> ok", "é   a b", "", None]


@pytest.mark.parametrize("left", [[0, 1], [2], [0], []])
def test_files_with_fewer_normaliser_steps_equal_the_library(spark, tmp_path, left):
    def change(spec):
        steps = spec["normalizer"]["normalizers"]
        spec["normalizer"] = {"type": "Sequence", "normalizers": [steps[i] for i in left]} if left else None

    path = variant(tmp_path, "fewer.json", change)
    lib = Tokenizer.from_file(path)
    got = op4_bpe.encode(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"), path=path).collect()
    assert {r.doc_id: r.ids for r in got} == {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("change", [
    lambda s: s["normalizer"]["normalizers"].append({"type": "StripAccents"}),
    lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\s?\S+"),
    lambda s: s["model"].update(dropout=0.1),
    lambda s: s["added_tokens"][0].update(lstrip=True),
    lambda s: s["added_tokens"][0].update(content="[START]"),
])
def test_other_files_are_refused(tmp_path, change):
    with pytest.raises(ValueError):
        op4_bpe.Encoder(variant(tmp_path, "other.json", change))


def test_nodes_of_short_pieces_are_walked_together_and_equal_the_library(monkeypatch):
    r = random.Random(5)
    letters = "abcdefgstrvemldAB\u00e9's'd'll're'vm't0123-.,!\"<|>\u65e5\u672c\u8a9e\u00f1\u00c5\u0301\u0302\u00df\u03a3\u03c2\u00a0\u3000\x85\x00\x1f\x7f\U0001d4b3\ufb01\u00bd"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.choice([1, 2, 4, 9, 15]))) for _ in range(r.randrange(60))) for _ in range(300)]
    odd = ["<|endoftext|>a<|startoftext|>", "a<|b it's IT'S 's's '' 've've 're'r 'l 'll'l a'", "\u0301 a\u0301", *("b" * n + " " + "\u00e9" * n for n in (24, 25, 47, 48, 49, 500))]
    path, walked, last = public_tokenizers.path(op4_bpe.FILE), [], op4_bpe.Vocabulary.last
    monkeypatch.setattr(op4_bpe.Vocabulary, "last", lambda self, *a: walked.append(0) or last(self, *a))
    lib, own = Tokenizer.from_file(path), op4_bpe.Encoder(path)
    for part in (texts, odd):
        walked.clear()
        (_, _, w), = slices(pa.array(part))
        ids, size = own.of(w)
        want = [lib.encode(t, add_special_tokens=False).ids for t in part]
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        # One by one only: words with special tokens or wide spaces, and long pieces.
        assert len(walked) < (0.2 * sum(map(len, texts)) if part is texts else 3000)


def test_own_parts_of_cells_are_those_of_a_search():
    r = np.random.default_rng(3)
    cells = np.unique(np.concatenate([r.integers(0, 1 << 24, 50_000), [0, 63, 64, (1 << 24) - 1]]))
    model = replace(op8_hpylm.flat(), cells=cells, own=r.random(len(cells)))
    asked = np.concatenate([r.integers(0, 1 << 24, 50_000), cells, [1, 62, 65, (1 << 24) - 2]])
    known = dict(zip(cells.tolist(), model.own.tolist(), strict=True))
    assert model.own_of(asked).tolist() == [known.get(c, 0.0) for c in asked.tolist()]
    assert not op8_hpylm.flat().own_of(asked).any()


def test_scores_in_turns_are_whole_and_the_model_goes(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i % 7 else None, prose(i % 50, 40) if i % 11 else None) for i in range(200)], "id long, text string")
    whole, tokens = op8_hpylm.score_texts(docs, docs)
    assert not [f for f in whole.inputFiles() if "/scores-" not in f]
    monkeypatch.setattr(op8_hpylm, "CHUNK_BYTES", 1000)
    turns, parts = [], op8_hpylm.scores
    monkeypatch.setattr(op8_hpylm, "scores", lambda *a, **k: turns.append(k["turn"]) or parts(*a, **k))
    found, same = op8_hpylm.score_texts(docs, docs)
    rows = lambda df: sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 4)) for r in df.collect())
    assert turns == [(0, 2), (1, 2)] and same == tokens and rows(found) == rows(whole) and len(rows(found)) == 200


def test_questions_of_a_sweep_grow_with_the_pair_shards_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i % 40, 200)) for i in range(60)], "id long, text string")
    asked, keep = [], op8_hpylm.stored

    def stored(df, label):
        out = keep(df, label)
        if label == "asked":
            asked.append((out.count(), out.select("chunk").distinct().count()))
        return out

    monkeypatch.setattr(op8_hpylm, "stored", stored)
    found = []
    for size in (1000, 1 << 30):
        model = op8_hpylm.fit(docs.select("text"), size)
        found.append({r.id: (r.n_known, round(r.score, 6)) for r in op8_hpylm.scores(docs, model, 2).collect()})
    assert asked[0][1] == 4 and asked[1][1] == 64 and all(n <= 16 * shards for n, shards in asked)
    assert found[0] == found[1] and len(found[0]) == 60


def test_pairs_of_a_text_longer_than_a_piece_are_all_counted(spark):
    r = random.Random(8)
    tokens = [r.choice("abcdefgh") * r.randrange(1, 40) for _ in range(40_000)] * 70
    text = " ".join(tokens)
    pairs, words_ = {}, {}
    for kind in op8_hpylm.counted(spark.createDataFrame([(text,), (None,)], "text string"), 4, 2).collect():
        if kind.kind == 3:
            names = op8_hpylm.numbers(kind.names, "<u8").tolist()
            words_ |= dict(zip(names, op8_hpylm.numbers(kind.counts, "<i8").tolist(), strict=True))
        if kind.kind == 0:
            key = [op8_hpylm.numbers(kind[c], "<u8").tolist() for c in ("keys", "singles")]
            pairs |= dict(zip(key[0], op8_hpylm.numbers(kind.counts, "<i8").tolist(), strict=True)) | dict.fromkeys(key[1], 1)
    assert len(tokens) > 2 * op8_hpylm.PAIRS_HELD
    assert sorted(words_.values()) == sorted(collections.Counter([*tokens, "", ""]).values())
    assert sorted(pairs.values()) == sorted(collections.Counter(zip(["", *tokens, ""], [*tokens, "", ""])).values())


def brute_bundle(text: str) -> np.ndarray:
    """Bind permuted letter vectors into trigrams around every letter and add them up."""
    symbols, out = [0], np.zeros(op6_language.DIMENSIONS)
    for c in text.lower():
        s = ord(c) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    symbols.append(0)
    vector = op6_language.Profiles.vector
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b:
            out += np.roll(vector(a), 2).astype(int) * np.roll(vector(b), 1) * vector(c)
    return out


def han(r: random.Random, n: int) -> str:
    return "".join(chr(0x4E00 + r.randrange(8000)) for _ in range(n))


def test_bundles_equal_brute_force(monkeypatch):
    r = random.Random(5)
    texts = ["The cat, the CAT", "", "12 . 3", "a", han(r, 40), "x" * 500, "ab " * 200, prose(3, 30), "ΣΑΣ İ é", han(r, 200) + " the end"]
    want = np.stack([brute_bundle(t) for t in texts])
    for dense, gathered, block in ((16, 1 << 12, 1 << 12), (10 ** 9, 1 << 12, 1 << 12), (0, 7, 5), (2, 7, 5)):
        for name, value in (("DENSE", dense), ("GATHERED", gathered), ("BLOCK_TRIGRAMS", block)):
            monkeypatch.setattr(op6_language, name, value)
        assert np.array_equal(op6_language.Profiles().bundles(texts), want)


def test_memory_does_not_follow_texts_times_trigrams():
    r = random.Random(6)
    texts = [han(r, 166) for _ in range(op6_language.SLICE_TEXTS)]
    tracemalloc.start()
    try:
        made = op6_language.Profiles().bundles(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 500 << 20
    assert np.array_equal(made[7], brute_bundle(texts[7]))


def test_cosines_ties_and_edges_through_the_operator(spark, tmp_path):
    schema = "doc_id long, text string, lang string, score string, held_out string"
    rows = [(i, t, lang, "clash", "clash") for i, (t, lang) in enumerate(
        [("alpha beta gamma", "en"), ("alpha beta gamma", "aa"), ("wir gehen heim", "de"), (None, "en"), ("", "de"), ("42", None),
         ("ja " * 60000, None), ("wir gehen heim", "de"), ("wir gehen heim", "de")])]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.QUERIES["op6_language"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    import zlib
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}
    models: dict = {}
    for i, t, lang, *_ in rows:
        if lang and not held[i]:
            models[lang] = models.get(lang, 0) + brute_bundle(t or "")
    for i, t, *_ in rows:
        v = brute_bundle((t or "")[:300] if (t or "").startswith("ja ") else t or "")
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        cosine = {k: float(v @ m / max(np.linalg.norm(v) * np.linalg.norm(m), 1e-300)) for k, m in models.items()}
        if not (t or "").startswith("ja "):
            best = max(sorted(cosine), key=lambda k: round(cosine[k], 9))
            assert got[i].lang_pred == best and got[i].score == pytest.approx(max(0.0, min(1.0, cosine[best])), abs=1e-6)
        assert got[i].held_out == held[i]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert catalog.QUERIES["op6_language"](spark, f"{tmp_path}/none").count() == 0
