"""The pipeline's stages on the smallest data, each held against its own input."""

import random
import re
import zlib

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treespan.llm import pii, simhash
from treespan.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = table(spark, DATA, "documents"), []
    for _, stage in pipeline.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, DATA))
    return [*out, docs]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_columns(kept):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "PII", "packing"]
    for df in kept[1:5]:
        assert df.columns == kept[0].columns
        assert df.where("n_chars <> length(text)").count() == 0


def test_quality_keeps_good_documents(spark, kept):
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    stayed = {r.doc_id for r in kept[1].collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    good = [d for d in held if labels[d]]
    assert sum(d in stayed for d in good) >= 0.9 * len(good)


def test_near_copies_go(kept):
    before, after = kept[1].collect(), {r.doc_id for r in kept[2].collect()}
    s = {r.doc_id: shingles(r.text) for r in before}
    ids = sorted(s)
    near = {d: [e for e in ids if e != d and len(s[d] & s[e]) >= 0.88 * len(s[d] | s[e])] for d in ids}
    alone = [d for d in ids if not any(e != d and len(s[d] & s[e]) > 0.5 * len(s[d] | s[e]) for e in ids)]
    assert set(alone) <= after
    assert not [(d, e) for d in after for e in near[d] if e in after]


def test_repeats_go(kept):
    raw = [(r.text or "").encode() for r in kept[3].collect()]
    before = {r.doc_id: (r.text or "").encode() for r in kept[2].collect()}
    count = {}
    for t in before.values():
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    for r in kept[3].collect():
        t = before[r.doc_id]
        on = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                on[i : i + 200] = b"\1" * 200
        assert r.text.encode() == bytes(b for b, x in zip(t, on) if not x).decode("utf-8", "ignore").encode()
    assert len(raw) == len(before)


def test_no_personal_data_stays(kept):
    for r in kept[4].collect():
        assert not [s for s in pii.find(r.text) if s.kind == "email"]
    assert kept[4].count() == kept[3].count()
    assert sum(len(re.findall("<EMAIL>|<IP>|<CARD>|<PHONE>", r.text)) for r in kept[4].collect()) > 0


def test_packed_whole(spark, kept):
    got = kept[5]
    per = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert per.where("n <> t").count() == 0 and per.count() == kept[4].select("doc_id").distinct().count()
    seq = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert seq.where("n > 4096 or n <> e").count() == 0
    assert pipeline.run(spark, DATA).count() == got.count()


def edited(rng, words, share):
    """The words, a share of them made anew."""
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"n{rng.randrange(1 << 40)}"
    return out


def family(seed=5, variants=300, copies=40):
    """A template's variants, of a similarity of 0.7 to 0.79 to each other, near copies of 0.8 to 0.88 of some of them, and texts alone."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(300)]
    texts = [template[:-40] + [f"o{rng.randrange(1 << 40)}" for _ in range(rng.randrange(38, 54))] for _ in range(variants)]
    texts += [edited(rng, texts[7 * k % variants], 0.014 + 0.008 * (k % 2)) for k in range(copies)]
    texts += [[f"a{rng.randrange(1 << 40)}" for _ in range(60)] for _ in range(40)]
    return [" ".join(t) for t in texts]


def components_of(texts):
    """The least index of each text's component at a similarity of exactly 0.8, by brute force."""
    s = [shingles(t) for t in texts]
    root = list(range(len(s)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            x = len(s[i] & s[j])
            if 5 * x >= 4 * (len(s[i]) + len(s[j]) - x):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(s))]


def grouped_of(spark, texts):
    got = {r.k: r.group for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()}
    least = {}
    for k in sorted(got):
        least.setdefault(got[k], k)
    return [least[got[k]] for k in range(len(texts))]


def errors(got, want):
    """Shares of linked pairs that are not of one group, and of pairs of one group that nothing links."""
    n = range(len(want))
    linked = [(i, j) for i in n for j in range(i) if want[i] == want[j]]
    joined = [(i, j) for i in n for j in range(i) if got[i] == got[j]]
    return sum(got[i] != got[j] for i, j in linked) / len(linked), sum(want[i] != want[j] for i, j in joined) / max(1, len(joined))


def test_dense_family_loses_no_link(spark):
    texts = family()
    assert errors(grouped_of(spark, texts), components_of(texts))[0] == 0


def test_links_do_not_hang_on_nearest(spark, monkeypatch):
    texts = family(seed=6, variants=200, copies=60)
    want = components_of(texts)
    for nearest in (3, 1):
        monkeypatch.setattr(simhash, "NEAREST", nearest)
        assert errors(grouped_of(spark, texts), want)[0] == 0


def test_only_similar_texts_are_joined(spark):
    rng = random.Random(8)
    line = " ".join(f"l{i}" for i in range(9))
    texts = [" ".join([line] * 200 + [f"r{rng.randrange(1 << 40)}" for _ in range(1000)]) for _ in range(4)]
    texts += [texts[0], "", None, "one two", " One  two ", "one three"] + family(seed=7, variants=200, copies=20)
    want = components_of(texts)
    assert errors(grouped_of(spark, texts), want) == (0, 0)


def test_stage_at_exactly_its_similarity(spark):
    rng = random.Random(9)
    line = " ".join(f"l{i}" for i in range(11))
    texts = family(seed=10) + [" ".join([line] * 200 + [f"r{rng.randrange(1 << 40)}" for _ in range(1000)]) for _ in range(3)]
    want = components_of(texts)
    assert errors(grouped_of(spark, texts), want) == (0, 0)
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(want)


def test_sketches_rule_out_only_what_cannot_be_similar():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for n in [1, 2, 5, 63, 64, 65, 129, 700, 5000] * 20:
        both, more = int(rng.integers(0, n + 1)), int(rng.integers(0, n + 1))
        hashes = rng.integers(0, 1 << 63, n + more, np.uint64)
        x, y = np.unique(hashes[:n]), np.unique(hashes[n - both :])
        apart = len(np.setxor1d(x, y))
        least = simhash.at_least_apart(simhash.sketch_of(x), simhash.sketch_of(y))
        assert least == simhash.at_least_apart(simhash.sketch_of(y), simhash.sketch_of(x)) <= apart
        ruled_out += 5 * len(np.intersect1d(x, y)) < 4 * len(np.union1d(x, y)) and 9 * least > len(x) + len(y)
    assert ruled_out > 60
    assert simhash.at_least_apart(simhash.sketch_of(np.zeros(0, np.uint64)), simhash.sketch_of(np.zeros(0, np.uint64))) == 0


def test_told_keys(spark):
    df = spark.range(-300, 300).withColumnRenamed("id", "key").withColumn("x", F.col("key") * 2)
    asked = {k for k in range(-300, 300) if k % 7 == 0}
    keys = spark.createDataFrame([(k,) for k in sorted(asked)] * 2, "key long")
    having, rest = ([(r.key, r.x) for r in simhash._told(df, keys, among).collect()] for among in (True, False))
    assert asked <= {k for k, _ in having} and not asked & {k for k, _ in rest}
    assert sorted(having + rest) == [(k, 2 * k) for k in range(-300, 300)]
    assert simhash._told(df, keys.limit(0), False).count() == 600


def test_unlike_texts_that_meet_are_not_moved(spark, monkeypatch):
    """Texts of a passage in common are pairs that meet; only those that may be similar are read to be judged."""
    rng = random.Random(12)
    texts = [" ".join([f"p{k // 4}x{i}" for i in range(14)] + [f"u{rng.randrange(1 << 40)}" for _ in range(60)]) for k in range(240)]
    texts += [" ".join(edited(rng, texts[k].split(), 0.02)) for k in range(0, 20, 2)]
    met, judged, unmet, verified = [], [], simhash.unmet, simhash._verified
    monkeypatch.setattr(simhash, "unmet", lambda *a: met.append(unmet(*a)) or met[-1])
    monkeypatch.setattr(simhash, "_verified", lambda docs, pairs, size: judged.append((len(met) and met[-1].count(), pairs.count())) or verified(docs, pairs, size))
    monkeypatch.setattr(simhash, "discard", lambda *tables: None)
    assert grouped_of(spark, texts) == components_of(texts)
    assert judged[-1][0] > 100 and judged[-1][1] < 20


def test_one_text_of_many_pairs_is_judged_in_parts(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:-1] + [f"x{k}"] if k % 3 else [f"y{k}x{i}" for i in range(60)]) for k in range(400)] + [" ".join(words)]
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "key long, text string"))
    pairs = materialize(spark.createDataFrame([(400, b) for b in range(400)] + [(399, 1), (2, 0), (2, 1)], "a long, b long"))
    alike = {(400, b) for b in range(400) if b % 3} | {(2, 1)}
    assert {(r.a, r.b) for r in simhash._verified(docs, pairs, 5).collect()} == alike

    def sizes(size):
        def run(parts):
            n = sum(p.num_rows for p in parts)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([0])], names=["a", "b"])

        return run

    monkeypatch.setattr(simhash, "_alike", sizes)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "100"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert max(r.a for r in simhash._verified(docs, pairs, 5).collect()) < 250
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_texts_are_not_dealt_to_their_groups(spark, monkeypatch):
    docs = materialize(spark.createDataFrame([(k, f"a b c d e f g h i j k l m {k // 2}") for k in range(40)], "key long, text string"))
    groups = materialize(spark.createDataFrame([(k, k - k % 4) for k in range(0, 40, 2)], "key long, group long"))
    plans, real = [], simhash.materialize

    def seen(df, **more):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return real(df, **more)

    monkeypatch.setattr(simhash, "materialize", seen)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "-1")
        got = {(r.a, r.b) for r in simhash.unmet(docs, groups, 5).collect()}
    finally:
        spark.conf.set(threshold, before)
    assert got == {(a, b) for a in range(0, 40, 2) for b in range(0, a, 2) if a // 4 != b // 4}
    dealt = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plans[-1])
    assert dealt and not [x for x in dealt if "text#" in x]


@pytest.mark.parametrize("plan", ["repartition", "distinct", "join"])
def test_any_plan_before(spark, plan):
    """Half of the rows are copies: whatever plan they come from and however AQE deals it, the other half stays."""
    rng = random.Random(14)
    own = [" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(30)) for _ in range(400)]
    df = spark.createDataFrame([(i, own[i // 2]) for i in range(800)], "doc_id long, text string")
    made = {
        "repartition": lambda: df.repartition(40, "doc_id"),
        "distinct": lambda: df.dropDuplicates(["doc_id"]),
        "join": lambda: df.hint("merge").join(spark.range(800).withColumnRenamed("id", "doc_id"), "doc_id"),
    }[plan]
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert sorted(r.doc_id for r in simhash.one_of_each(made()).collect()) == list(range(0, 800, 2))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stages_on_empty_null_and_repeated_rows(spark, tmp_path):
    """Every stage, and the whole, on a table without rows, and on one of nulls, empty texts and repeated rows."""
    kind = table(spark, DATA, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y z", "en", "s", 5), (3, "a b c d e f g", None, None, 13), (3, "a b c d e f g", None, None, 13), (4, " \t ", "en", "s", 3)]
    for name, some in (("none", []), ("few", rows)):
        docs = spark.createDataFrame([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in some], kind)
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (None, 0, None), (3, None, 1)], table(spark, DATA, "labels").schema).limit(len(some)).write.parquet(str(tmp_path / name / "labels.parquet"))
        for _, stage in pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path / name))
            assert got.count() <= max(len(some), 0)
        assert pipeline.run(spark, str(tmp_path / name)).count() <= len(some)
    kept = [r.doc_id for r in simhash.one_of_each(spark.createDataFrame([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows], kind)).collect()]
    assert sorted(kept, key=str) == [1, 3, None]
