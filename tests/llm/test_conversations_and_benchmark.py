"""Conversation repair, the prefix trie and benchmark decontamination against brute force and their SQL."""
from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framefold.llm import op11_repair, op12_prefix_trie, op13_decontaminate

from .conftest import prose

TURNS = "conv_id long, turn long, role string, text string"
CLASHING = ("at", "conv", "chunk", "n_words", "a", "words", "span", "fp", "form", "key")


def saved(spark, folder, name, data, schema):
    df = spark.createDataFrame(data, schema).repartition(3).withColumns({c: F.lit("clash") for c in CLASHING})
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def by_sql(sql, folder, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet/*.parquet')")
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    return collections.Counter(tuple(sorted(zip(columns, map(str, r)))) for r in rel.fetchall())


def counted(df):
    return collections.Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in df.collect())


# ------------------------------------------------------------------ benchmark
def plain(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def shared(docs, items, span=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = plain(t)
        n = min(len(w), span)
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s:s + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = plain(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                for i in windows.get(tuple(w[s:s + n]), ()):
                    hit |= set(range(s, s + n))
                    found.add(str(i)) if i is not None else None
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return collections.Counter(out)


def leaks():
    items = [(i, prose(40 + i, 8 + 6 * i)) for i in range(8)]
    items += [(20, "one two three"), (21, "single"), (22, "again " * 14), (23, None), (24, " ,;"), (None, prose(90, 25)), (25, items[3][1]), (3, prose(91, 12)),
              (110, items[4][1] + " tail of its own"), (26, "Ünï çödé ÉTÉ été 你好 ß İ x y z w"), (27, prose(92, 9)), (28, "a b " * 10)]
    texts = [prose(1, 200), items[5][1], items[5][1].upper(), prose(2, 50) + ", " + items[4][1] + "! " + prose(3, 30), " ".join(plain(items[7][1])[5:16]),
             " ".join(plain(items[7][1])[5:14]), "One, TWO; three", "we saw a single bird", "again " * 60, None, "", " \n,", items[9][1], "a b " * 300,
             items[-4][1] or "", "été ÉTÉ Ünï", items[-3][1].lower(), items[-2][1] + " " + items[-2][1], prose(6, 4000) + " " + items[6][1], "x" * 5000]
    docs = list(enumerate(texts))
    return [*docs, docs[3], docs[3], (3, texts[1]), (None, texts[1]), (None, None)], items


@pytest.mark.parametrize("rows", [1 << 19, -1])
def test_shared_spans_are_found_whole(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(op13_decontaminate, "BROADCAST_ROWS", rows)
    docs, items = leaks()
    saved(spark, tmp_path, "documents", docs, "doc_id long, text string")
    saved(spark, tmp_path, "benchmark", items, "item_id long, text string")
    df = op13_decontaminate.op13_decontaminate(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())
    assert got == shared(docs, items)
    assert counted(df) == by_sql(op13_decontaminate.ORACLE["op13_decontaminate"], tmp_path, "documents", "benchmark")


def test_spans_are_merged_and_sets_listed(spark):
    docs = spark.createDataFrame([(1, "x " + prose(5, 30) + " y " + prose(6, 12))], "doc_id long, text string")
    items = spark.createDataFrame([(7, prose(5, 30)), (8, prose(6, 12)), (9, prose(5, 30))], "item_id long, text string")
    found, sets = op13_decontaminate.shared_spans(docs, items)
    (r,) = found.collect()
    assert [tuple(s) for s in r.spans] == [(1, 31), (32, 44)] and r.n_hit == 42
    assert {s.item_set: s["items"] for s in sets.collect()}[r.item_set] == ["7", "8", "9"]


@pytest.mark.parametrize("docs,items", [([], [(1, "a b")]), ([(1, "a b"), (2, None)], []), ([], [])])
def test_empty_documents_or_benchmark(spark, tmp_path, docs, items):
    saved(spark, tmp_path, "documents", docs, "doc_id long, text string")
    saved(spark, tmp_path, "benchmark", items, "item_id long, text string")
    got = op13_decontaminate.op13_decontaminate(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_hit, r.contaminated) for r in got) == [(d, 0, False) for d, _ in docs]


# ------------------------------------------------------------------ trie
def talks(seed=4):
    """Conversations of 0 to 30 turns that share openings; one long, copies, nulls."""
    r = random.Random(seed)
    stems = [[("system" if t == 0 else ("user", "assistant")[t % 2], prose(100 * s + t, 4 + t % 5)) for t in range(30)] for s in range(3)]
    out = []
    for c in list(range(60)) + [120, 121, 127, 261, 999, -3, -21]:
        stem = stems[c % 3]
        n = r.randrange(0, 9) if c % 7 else 30
        turns = stem[:n] + [("user", f"own {c % 11}")] * (c % 2)
        out += [(c, t * 2, role, text) for t, (role, text) in enumerate(turns)]
    out += [(60, t, ("user", "assistant")[t % 2], f"long {t}") for t in range(130)]
    return [*out, (70, None, None, None), (70, 1, "user", None), (70, 2, None, "x"), (None, 1, "user", "nobody"), (71, None, "user", "first"), (71, 0, "user", "second")]


def trie(rows, openings=True):
    own = collections.defaultdict(list)
    for c, t, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "")):
        own[c].append((role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if openings else 0
        base = int(c - np.fmod(c, 20))
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved_tokens = collections.Counter(), collections.Counter()
    for p, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\t-\r]+", p[-1][1])) if p else 0
        for e in range(len(p) + 1):
            leaves[p[:e]] += children[p] == 0
            saved_tokens[p[:e]] += gain
    return collections.Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved_tokens[p],
         hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_query_against_brute_force_and_sql(spark, tmp_path):
    saved(spark, tmp_path, "conversations", talks(), TURNS)
    df = op12_prefix_trie.op12_prefix_trie(spark, str(tmp_path))
    assert collections.Counter(tuple(r[c] for c in NODE) for r in df.collect()) == trie(talks())
    assert counted(df) == by_sql(op12_prefix_trie.ORACLE["op12_prefix_trie"], tmp_path, "conversations")


@pytest.mark.parametrize("width", [1, 3, 16])
def test_blocks_of_any_width_give_the_same_trie(spark, width):
    rows = [(c, t, role, text) for c, t, role, text in talks(9) if c is not None]
    turns = op12_prefix_trie.turns_of(spark.createDataFrame(rows, TURNS))
    nodes, ends = op12_prefix_trie.prefix_trie(turns, turns.select("conv"), width)
    got = collections.Counter(tuple(r[c] for c in NODE[:-1]) for r in nodes.collect())
    assert got == collections.Counter(x[:-1] for x in trie(rows, openings=False).elements())
    at = {(r.a, r.b): (r.conv_id, r.depth) for r in nodes.collect()}
    size = collections.Counter(c for c, *_ in rows)
    assert all(at[r.a, r.b][1] == size[r.conv] for r in ends.collect())


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, 1, "user", "only")], [(3, t, "user", "same") for t in range(4)]])
def test_small_tries(spark, tmp_path, rows):
    saved(spark, tmp_path, "conversations", rows, TURNS)
    got = collections.Counter(tuple(r[c] for c in NODE) for r in op12_prefix_trie.op12_prefix_trie(spark, str(tmp_path)).collect())
    assert got == trie(rows)


# ------------------------------------------------------------------ repair
def cheapest(symbols):
    """(cost, audit) by trying, for every suffix and state, all edits; symbols are (initial, fault)."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    fits = {0: 2, 1: 2, 2: 3, 3: 2}
    memo = {}

    def best(i, q, inserts):
        if (i, q, inserts) not in memo:
            found = [(0, "")] if i == len(symbols) and q in (0, 3) else []
            if inserts < 3:
                c, a = best(i, fits[q], inserts + 1)
                found.append((c + 5, "I" + a))
            if i < len(symbols):
                initial, fault = symbols[i]
                c, a = best(i + 1, q, 0)
                found.append((c + 2, "D" + a))
                if fault != 2:
                    c, a = best(i + 1, fits[q], 0)
                    found.append((c + 1 + 5 * fault, "R" + a))
                    if (q, initial) in moves:
                        c, a = best(i + 1, moves[q, initial], 0)
                        found.append((c + 5 * fault, "K" + a))
            memo[i, q, inserts] = min(found, default=(10 ** 6, ""))
        return memo[i, q, inserts]
    for i in range(len(symbols), -1, -1):  # short stacks for long conversations
        for q in range(4):
            best(i, q, 0)
    return best(0, 0, 0)


def dialogues(seed=11):
    r = random.Random(seed)
    out = []
    for c in range(40):
        n = (0, 1, 2, 3, 7, 20)[c % 6] or 90
        for t in range(n):
            role = r.choice(("system", "user", "user", "assistant", "assistant", "tool", "", None)) if r.random() < 0.4 else ("assistant", "user")[t % 2]
            text = r.choice((f"turn {t} of {c}.", f"turn {t} of {c}!", f"cut {t}", "same words?", "", " \t", None, "Ok. \n"))
            out.append((c, t + t // 5, role, text))
    return out


def seen_faults(turns):
    """Symbols of one conversation's ordered turns, and its faults."""
    seen, symbols, faults = set(), [], []
    for role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        symbols.append((role[:1], {None: 0, "truncated": 1}.get(fault, 2)))
    return symbols, faults


@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_edits_are_the_cheapest_and_least(spark, chunk):
    rows = dialogues()
    edits, report = op11_repair.repair(spark.createDataFrame(rows, TURNS).repartition(4), chunk=chunk)
    lines = collections.defaultdict(list)
    for r in sorted(edits.collect(), key=lambda r: (r.conv_id, r.chunk, r.step)):
        lines[r.conv_id].append(r)
    report = {r.conv_id: r for r in report.collect()}
    for c, group in itertools.groupby(sorted(rows, key=lambda x: x[:2]), key=lambda x: x[0]):
        turns = [(" " if role is None else role, " " if text is None else text) for _, _, role, text in group]
        symbols, faults = seen_faults(turns)
        assert (report[c].cost, report[c].audit) == cheapest(symbols)
        for f in ("blank", "duplicate", "truncated"):
            assert report[c][f] == faults.count(f)
        assert report[c].illegal == sum(x[:1] + y[:1] not in ("su", "ua", "au") for (x, _), (y, _) in itertools.pairwise(turns))
        left = iter(turns)
        for r in lines[c]:
            if r.edit == "I":
                assert r.text == ""
            else:
                role, text = next(left)
                assert r.text == text and (r.edit == "R" or r.role == role)
        assert next(left, None) is None and re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in lines[c] if r.edit != "D"))


def test_repair_query_against_its_sql(spark, tmp_path):
    rows = [*dialogues(3), *dialogues(3)[:5], (77, None, "user", "Hi."), (77, None, None, None), (78, 5, "assistant", "x" * 4000), (None, 1, "user", "a."), (None, 2, "assistant", "b."),
            *[(200 + i, i, "user", "Gone.") for i in range(60)]]
    saved(spark, tmp_path, "conversations", rows, TURNS)
    df = op11_repair.op11_repair(spark, str(tmp_path))
    assert counted(df) == by_sql(op11_repair.ORACLE["op11_repair"], tmp_path, "conversations")
    assert any(r.audit == "" and r.cost == 0 for r in df.collect())


def test_no_turns(spark, tmp_path):
    saved(spark, tmp_path, "conversations", [], TURNS)
    assert op11_repair.op11_repair(spark, str(tmp_path)).count() == 0


def test_vectors_that_differ_by_a_constant_need_no_further_pass(spark, monkeypatch):
    passes = []
    real = op11_repair.stored
    monkeypatch.setattr(op11_repair, "stored", lambda df, label: passes.append(label) or real(df, label))
    symbols = "bcbcbgbcdbcccb" * 40  # users and assistants, with faults
    chunks = spark.createDataFrame([(1, i, symbols[i * 10:i * 10 + 10], i == 55) for i in range(56)], "conv long, chunk long, symbols string, last boolean")
    settled = {r.chunk: r for r in op11_repair.settled(chunks).collect()}
    assert passes.count("pass") < 8, "costs converge long before a pass a chunk"
    codes = np.frombuffer(symbols.encode(), np.uint8).reshape(1, -1) - 97
    true = op11_repair.backward(codes, np.array([560]), np.array([op11_repair.FINAL]))
    for i, r in settled.items():
        after = sum(settled[j].constant for j in range(i, 56))
        assert (np.array(r.start) + after).tolist() == true[i * 10, 0].tolist()


@pytest.mark.parametrize("fan", [2, 7])
def test_entries_are_composed_in_groups(spark, fan):
    r = random.Random(2)
    maps = [(c, i, [r.randrange(4) for _ in range(4)]) for c in (1, 2, None) for i in range(33 if c else 1)]
    got = {(x.conv, x.chunk): x.entry for x in op11_repair.entered(spark.createDataFrame(maps, "conv long, chunk long, exits array<long>"), fan).collect()}
    for c in (1, 2, None):
        state = 0
        for _, i, exits in (m for m in maps if m[0] == c):
            assert got[c, i] == state
            state = exits[state]


def test_places_inside_keys_of_any_size(spark):
    from framefold.llm.ordered import numbered
    rows = [(k, i * 7 % 501, i) for k, n in ((1, 400), (2, 3), (None, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(5)
    want = {}
    for k in (1, 2, None):
        total = mixed = 0
        for at, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == k)):
            want[k, o] = (at, total, mixed)
            total, mixed = total + v, mixed ^ v
    got = {(r.k, r.o): (r["at"], r.total, r.mixed) for r in numbered(df, "k", ["o"], sums={"total": "v"}, xors={"mixed": "v"}).collect()}
    assert got == want
