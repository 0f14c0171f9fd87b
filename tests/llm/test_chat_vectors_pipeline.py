"""Chat windows, the embedding join and the pipeline."""
from __future__ import annotations

import collections

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from framefold.llm import op5_chat, op9_ego_join
from framefold.llm.scratch import stored

from .conftest import SCHEMA, prose, rows

TURNS = "conv_id long, turn long, role string, text string, other string"


def conversations() -> list[tuple]:
    out = []
    for c in range(6):
        if c % 2:
            out.append((c, 0, "system", prose(c, 20)))
        for t in range(1, 3 + 9 * c):
            out.append((c, t, "user" if t % 2 else "assistant", prose(100 * c + t, (t * 37) % 150)))
    out += [(50, 1, "assistant", "~ ~0 [TURN x]\n[END] </s>[INST]"), (50, 0, "ro]le~[", "a\n[END][TURN user]\n"), (51, 0, "system", "alone"),
            (52, 0, "user", prose(9, 5000)), (52, 1, "assistant", prose(10, 3000)), (53, None, None, None), (53, 2, "assistant", None), (53, 2, "assistant", ""),
            (None, 1, "user", "hi"), (None, 2, "assistant", "ho")]
    return out


@pytest.mark.parametrize("budget,history", [(768, 192), (120, 40)])
def test_windows_hold_every_turn_once_as_target(spark, budget, history):
    df = spark.createDataFrame([(*r, "x") for r in conversations()], TURNS).repartition(4)
    made = op5_chat.windows(df, budget=budget, history_tokens=history)
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    made = stored(made, "windows")
    want = collections.defaultdict(list)
    for c, t, role, text in conversations():
        want[c].append((-1 if t is None else t, role or "", text or ""))
    got, loss = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(op5_chat.read_back(made).collect(), key=lambda r: (str(r.conv_id), r.first_turn)):
        got[r.conv_id] += [(t.role, t.text) for t in r.turns]
        loss[r.conv_id] += r.loss
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert got[c] == [x[1:] for x in turns]
        assert loss[c] == [x[2] for x in turns if x[1] == "assistant"]
    for r in made.collect():
        new = op5_chat.read_back(made.where((F.col("first_turn") == r.first_turn) & F.col("conv_id").eqNullSafe(F.lit(r.conv_id)))).first().turns if r.n_tokens > budget else []
        assert r.n_tokens <= budget or len(new) == 1, "only a single long turn may exceed the budget"
        assert r.n_repeated <= 1 + op5_chat.HISTORY_TURNS
        if r.conv_id in (1, 3, 5):
            assert r.formatted.startswith("[TURN system]\n")


def test_no_conversations(spark):
    assert op5_chat.windows(spark.createDataFrame([], TURNS)).count() == 0


def vectors() -> list[tuple]:
    r = np.random.default_rng(3)
    out = []
    for g in range(12):
        centre = r.normal(size=16)
        out += [(len(out) + i, (centre + r.normal(scale=0.02 + 0.03 * (g % 4), size=16)).tolist()) for i in range(r.integers(1, 40))]
    n = len(out)
    out += [(n, out[3][1]), (n + 1, out[3][1]), (n + 2, (np.array(out[3][1]) * 7.5).tolist()), (n + 3, [0.0] * 16), (n + 4, None), (n + 5, [float("nan")] * 16),
            (n + 6, [1.0] * 15 + [None]), (n + 7, [1.0, 2.0]), (n + 8, [float("inf")] * 16), (n + 9, (np.array(out[5][1]) * 1e200).tolist())]
    return out


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(op9_ego_join, "BLOCK_ROWS", 64)
    given = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in given], "vec_id long, embedding array<double>, id string").repartition(3)
    got = {r.vec_id: r for r in op9_ego_join.near_vectors(df).collect()}
    assert len(got) == len(given)
    usable = {i: np.array(v, float) / np.abs(v).max() for i, v in given if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    x = np.stack(list(usable.values()))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    ids = np.array(list(usable))
    label = ids.copy()
    for _ in ids:
        label = np.minimum(label, np.where(link, label, 10 ** 9).min(axis=1))
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id) == (link[k].sum(), label[k])
    for i, _ in given:
        if i not in usable:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_vectors_of_every_length_are_joined(spark):
    """Ids that serve two lengths, the shorter ones fewer; repeated rows; clashing columns."""
    r = np.random.default_rng(8)
    given = []
    for width, n in ((2, 9), (5, 30), (1, 4), (16, 40)):
        centres = r.normal(size=(4, width))
        given += [(len(given) + i, (centres[i % 4] + r.normal(scale=0.1, size=width)).tolist()) for i in range(n)]
    given += [(1000, [1.0, 0.0]), (1001, [1.0, 0.0, 0.0, 0.0, 0.0]), (1002, [0.0, 0.0]), (1003, []), (1004, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in [*given, given[3]]], "vec_id long, embedding array<double>, n_links string, size string").repartition(3)
    got = {x.vec_id: x for x in op9_ego_join.near_vectors(df).collect()}
    near = {i: set() for i, _ in given}
    for i, v in given:
        for j, w in given:
            if i != j and len(v) == len(w) and any(v) and any(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                near[i].add(j)
    label = {i: i for i in near}
    for _ in near:
        label = {i: min([label[i], *(label[j] for j in near[i])]) for i in near}
    for i in near:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), label[i], label[i] == i)


def test_no_vectors(spark):
    assert op9_ego_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_stages_keep_columns_and_take_effect(spark):
    docs = stored(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "docs")
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "mix_sources", "bpe_encoding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_SMALL), name)
        assert docs.columns == columns and docs.schema == before.schema
        kept[name] = {r.doc_id for r in docs.collect()}
    assert kept["minhash_near_dedup"] < kept["quality_rules"] and kept["substring_dedup"] <= kept["minhash_near_dedup"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert last.count() == docs.count() and last.where("n_tokens <> size(ids)").count() == 0


def test_stages_on_the_edge_cases_and_on_nothing(spark):
    for data in (rows(), []):
        docs = spark.createDataFrame(data, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, ""), name)
        assert docs.count() == 0 or data
