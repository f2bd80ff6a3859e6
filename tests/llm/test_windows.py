"""Repeated windows against brute force: suffix_dedup and automata."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from treespan.llm import automata, suffix_dedup, windows


def removed_bytes(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        on = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                on[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if on[i] and (i == 0 or not on[i - 1]))
        out.append((len(r), sum(on), spans, hashlib.sha256(bytes(b for b, x in zip(r, on) if not x)).hexdigest()))
    return out


def removed_words(rows, length):
    docs = [(1 << 63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in docs:
        for a in range(len(w) - length + 1):
            k = tuple(w[a : a + length])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in docs:
        on = [False] * len(w)
        for a in range(len(w) - length + 1):
            if least[tuple(w[a : a + length])] < i:
                on[a : a + length] = [True] * length
        out.append((len(w), sum(on), hashlib.sha256(b" ".join(x for x, y in zip(w, on) if not y)).hexdigest()))
    return out


def texts(seed, unit):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    parts = [unit.join(word() for _ in range(rng.randint(3, 12))) for _ in range(6)]
    some = [unit.join(rng.choice(parts) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 12))) for _ in range(50)]
    return [*some, None, "", some[0], some[0], "a" * 60, unit.join(["a"] * 50), " \t "]


@pytest.mark.parametrize("length, most, together", [(8, 8, 1 << 20), (13, 8, 1 << 20), (8, 1, 1 << 20), (8, 0, 40), (13, 1, 64)])
def test_bytes(spark, monkeypatch, length, most, together):
    monkeypatch.setattr(suffix_dedup, "MOST_SPANS", most)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", together)
    rows = list(enumerate(texts(length, "")))
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    want = removed_bytes([t for _, t in rows], length)
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("told", [0, 1 << 16])
@pytest.mark.parametrize("shard, most, together", [(1, 64, 1 << 20), (4096, 64, 1 << 20), (4096, 1, 1 << 20), (4096, 0, 20), (3, 2, 50)])
def test_words(spark, monkeypatch, shard, most, together, told):
    monkeypatch.setattr(automata, "TOLD_WORDS", told)
    monkeypatch.setattr(automata, "SHARD", shard)
    monkeypatch.setattr(automata, "MOST_SPANS", most)
    monkeypatch.setattr(automata, "WINDOWS", together)
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts(3, " "))]
    rows[7] = (None, rows[7][1])
    got = automata.digest(spark.createDataFrame(rows, "doc_id long, text string"), length=4, gram=2).collect()
    want = [(i, *w) for (i, _), w in zip(rows, removed_words(rows, 4))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_whole_sizes(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long), (2, "x" + long[500:900] + "y"), (3, long[100:299]), (4, long[100:300]), (5, "q" * 450)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 600, 2: 400, 3: 0, 4: 200, 5: 450}


def test_long_documents_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(windows, "TOGETHER", 64)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 3, n).astype(np.uint64) * np.uint64(2) + np.uint64(1) for n in (500, 7, 0, 90)]
    seen = [set() for _ in docs]
    for doc, _, _, low, more in windows.spans(iter(docs), 9, 4):
        for d, a, m in zip(doc, low, more):
            seen[d] |= set(range(a, a + m + 1))
    assert [len(s) for s in seen] == [max(0, len(d) - 8) for d in docs]


def test_automaton():
    rng = random.Random(4)
    for _ in range(40):
        held = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(4)]
        a = automata.Automaton()
        for h in held:
            a.add(h)
        text = "".join(rng.choice("abc") for _ in range(20))
        want = [max(n for n in range(i + 2) if any(text[i + 1 - n : i + 1] in h for h in held)) for i in range(20)]
        assert a.matches(text) == want


def test_least_ranks_of_runs():
    rng = random.Random(14)
    for _ in range(60):
        held = sorted((rng.randint(0, 4), "".join(rng.choice("ab") for _ in range(rng.randint(0, 10)))) for _ in range(5))
        a = automata.Automaton()
        for rank, h in held:
            a.add(h, rank)
        text = "".join(rng.choice("abc") for _ in range(25))
        for length in (1, 2, 3, 5):
            want = [(i, min(r for r, h in held if text[i : i + length] in h)) for i in range(26 - length) if any(text[i : i + length] in h for _, h in held)]
            assert list(a.windows(text, length)) == want


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digest(none).count() == automata.digest(none).count() == 0
    rows = [(1, "z" * 10 + "é" * 150, "k", 5), (2, "é" * 150, "v", 6), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, place int")
    got = {r.doc_id: (r.text, r.key, r.place) for r in suffix_dedup.dedup(df).collect()}
    assert got == {1: ("z" * 10, "k", 5), 2: ("", "v", 6), 3: (None, None, None)}


def boilerplate(n, seed=11):
    """Documents that share a passage between texts of their own, in several blocks."""
    rng = random.Random(seed)
    own = lambda k: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(1 << 30)}" for _ in range(k))
    passage = own(30)
    return [f"{own(rng.randrange(8, 20))} {passage} {own(rng.randrange(8, 20))}" if i % 3 else own(20) for i in range(n)]


def test_hot_passage_is_settled_in_blocks(spark, monkeypatch):
    rows = list(enumerate(boilerplate(240)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(df, length=100).collect()}
    assert got == dict(enumerate(removed_bytes([t for _, t in rows], 100)))
    for told in (1 << 16, 0):
        monkeypatch.setattr(automata, "TOLD_WORDS", told)
        got = {r.doc_id: tuple(r)[1:] for r in automata.digest(df).collect()}
        assert got == dict(enumerate(removed_words(rows, 13)))


def test_a_hot_passage_sends_few_rows():
    rows = boilerplate(2000)
    key = np.arange(len(rows))
    for n, most, kinds in ((2000, 8, (0, 1, 2)), (2000, 4000, (0, 3))):
        doc, anchor, span, low, more = next(windows.spans((suffix_dedup._tokens(t.encode()) for t in rows[:n]), 200, 100))
        dealt, _, _, _, _, weight, kind = windows.settled(anchor, span, None, key[doc], low << 20 | more, most)
        assert set(kinds) <= set(kind.tolist()) and weight.sum() >= len(doc)
        plain = np.unique(dealt[kind == windows.ROW], return_counts=True)[1]
        assert plain.max() <= most


def test_long_runs_of_two_tokens_are_told_apart():
    bits = np.array([i.bit_count() & 1 for i in range(4096)])
    a, b = (windows.Hashes(suffix_dedup._BYTE[x + 97]) for x in (bits, 1 - bits))
    zero = np.zeros(1, np.int64)
    assert a.of(zero, 4096) != b.of(zero, 4096)
    assert a.of(zero, 4096) == a.every(4096)[0] and a.of(zero, 100) == a.every(100)[0]


@pytest.mark.parametrize("plan", ["repartition", "distinct", "join"])
def test_any_plan_before(spark, plan):
    """Rows are told apart by written keys: AQE may deal them differently each time that a plan runs."""
    rows = [(i, t) for i, t in enumerate(texts(21, "") * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = {
        "repartition": lambda: df.repartition(40, "doc_id"),
        "distinct": lambda: df.dropDuplicates(["doc_id"]),
        "join": lambda: df.hint("merge").join(spark.range(len(rows)).withColumnRenamed("id", "doc_id"), "doc_id"),
    }[plan]
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.removed_bytes for r in suffix_dedup.dedup(made(), length=9).collect()}
        assert got == {i: w[1] for i, w in enumerate(removed_bytes([t for _, t in rows], 9))}
        got = {r.doc_id: r.n_removed for r in automata.dedup(made(), length=4, gram=2).collect()}
        assert got == {i: w[1] for i, w in enumerate(removed_words(rows, 4))}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["op5_suffix_array_dedup", "op9_substring_dedup"])
def test_registered_sql(spark, name):
    import duckdb

    from treespan.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, data).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_very_long_texts(spark):
    """Passages that recur across the pieces that a text of millions of bytes is hashed in."""
    rng = random.Random(31)
    own = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = "{" + own(398) + "}"
    long = own(1_048_400) + "1" + passage + "2" + own(900_000) + "3" + passage + "4" + own(200_000)
    rows = [(1, long), (2, own(50) + "5" + passage), (3, own(3000))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (len(long), 800, 2), 2: (451, 400, 1), 3: (3000, 0, 0)}
    words = [f"w{i}" for i in range(300_000)]
    said = " ".join(words[:200_000] + ["x"] + words[100:140] + ["y"] + words[200_000:])
    got = {r.doc_id: (r.n_words, r.n_removed) for r in automata.digest(spark.createDataFrame([(1, said), (2, " ".join(words[199_990:200_010])), (3, " ".join(words[120:160]))], "doc_id long, text string")).collect()}
    assert got == {1: (300_042, 0), 2: (20, 0), 3: (40, 40)}
