"""SimHash near-duplicates: BK-trees of fingerprints, searched only along edges that the radius allows.

The trees are shards, so that none grows with the corpus. Of four blocks of 16 bits two are equal where at most two
bits differ; so each of the six pairs of blocks deals the fingerprints to shards by its 32 bits, and links lie within
shards. A shard of over SPLIT fingerprints is dealt out once more by the same rule over its other 32 bits; then 48
bits are fixed and a shard has 2^16 fingerprints at most. Each tree goes to one task with the fingerprints to look up.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespan.llm.common import batches_of, discard, materialize, with_row_key
from treespan.llm.components import components, firsts
from treespan.llm.windows import mix

RADIUS = 2
SHINGLE = 3
SPLIT = 2048
#: Fingerprints that are looked up at once, and pairs of one and a node that are held at once.
LOOKED_UP = 1 << 13


#: Multipliers that make further hashes of a shingle's hash, for fingerprints of more than 64 bits.
_FURTHER = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def fingerprint_of(text: str | None, size: int = SHINGLE, words: int = 1) -> bytes:
    """Each bit is 1 if it is 1 in over half the hashes of the shingles; 64 bits a word, least first. All 0 without words.

    Words after the first, at most three, have the bits of hashes made from the shingles' hashes.
    """
    import xxhash

    said = (text or "").encode().lower().split()  # bytes: A-Z, and white space from 9 to 13 and 32, only
    if not said:
        return bytes(8 * words)
    if len(said) < size:
        shingles = [b" ".join(said)]
    else:
        shingles = map(b" ".join, zip(*(said[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter([digest(s, 42) for s in shingles], np.uint64), words)


def _majority(hashes: np.ndarray, words: int) -> bytes:
    ones = np.zeros((words, 64), np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = hashes[a : a + (1 << 14)]
        for w in range(words):
            own = part if w == 0 else mix(part * np.uint64(_FURTHER[w - 1]))
            ones[w] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").tobytes()


def fingerprints(df: DataFrame, text_col: str = "text", fingerprint_col: str = "fingerprint", size: int = SHINGLE, words: int = 0) -> DataFrame:
    """Puts the fingerprint of each whole text in the text's place, as a long or, of `words` words, as bytes; null and empty texts have 0. A column of that name is replaced."""
    kept = [c for c in df.columns if c not in (fingerprint_col, text_col)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            made = [fingerprint_of(t, size, words or 1) for t in b.column(len(kept)).to_pylist()]
            made = pa.array(made, pa.binary()) if words else pa.array(np.frombuffer(b"".join(made), "<i8"), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*kept, fingerprint_col])

    return df.select(*kept, text_col).mapInArrow(run, df.select(*kept).withColumn(fingerprint_col, F.lit(None).cast("binary" if words else "long")).schema)


class Forest:
    """BK-trees over fingerprints, one for each shard: a child lies under its parent by its distance, at most one each.

    `absorb`, where true, lets a value that meets a node within the radius on its way down end there instead of
    becoming a node: a tree of a large group of near copies stays small. Such values are in `held` by their node.
    """

    def __init__(self, shard: np.ndarray, value: np.ndarray, radius: int, absorb: np.ndarray | None = None):
        """Values, a row of words each, of equal shard follow each other and differ; the first of a shard is its root."""
        n = len(value)
        self.value, self.radius, self.far = value, radius, 64 * value.shape[1] + 1
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        edge = np.full(n, -1, np.int64)  # parent * far + distance
        cur, waiting = self.root.copy(), np.flatnonzero(~first)
        at_node, below = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(waiting):
            under = cur[waiting]
            distance = self.distance(waiting, under)
            if absorb is not None and (near := (distance <= radius) & absorb[waiting]).any():
                at_node.append(under[near])
                below.append(waiting[near])
                waiting, under, distance = waiting[~near], under[~near], distance[~near]
            code = under * self.far + distance
            _, at, back = np.unique(code, return_index=True, return_inverse=True)
            child = waiting[at]
            edge[child] = code[at]
            cur[waiting] = child[back]
            waiting = waiting[cur[waiting] != waiting]
        self.held = np.concatenate(at_node), np.concatenate(below)
        node = np.ones(n, bool)
        node[self.held[1]] = False
        self.nodes = np.flatnonzero(node)
        self.child = self.nodes[np.argsort(edge[self.nodes], kind="stable")]
        self.edges = edge[self.child]

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.value[i] ^ self.value[j]).sum(axis=1, dtype=np.int64)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of values of a shard at most the radius apart: each two nodes, and each value that a node holds with it."""
        if len(self.held[0]):
            yield self.held
        for a in range(0, len(self.nodes), LOOKED_UP):
            asked = self.nodes[a : a + LOOKED_UP]
            todo = [(asked, self.root[asked])]
            while todo:
                asked, node = todo.pop()
                if len(asked) > 64 * LOOKED_UP:
                    half = len(asked) // 2
                    todo += [(asked[:half], node[:half]), (asked[half:], node[half:])]
                    continue
                distance = self.distance(asked, node)
                hit = (distance <= self.radius) & (asked < node)
                if hit.any():
                    yield asked[hit], node[hit]
                low = np.searchsorted(self.edges, node * self.far + np.maximum(distance - self.radius, 0), "left")
                count = np.searchsorted(self.edges, node * self.far + np.minimum(distance + self.radius, self.far - 1), "right") - low
                if total := int(count.sum()):
                    which = np.repeat(np.arange(len(asked)), count)
                    step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                    todo.append((asked[which], self.child[low[which] + step]))


def _links(radius: int):
    """Over rows (shard, value) in order of shard: each value, and the first that it is joined to in its shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def made(n: int) -> pa.RecordBatch:
            s, v = shard[:n], value[:n]
            order = np.lexsort((v, s))
            s, v = s[order], v[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])])
            forest = Forest(s[new], v[new][:, None], radius)
            to = firsts(len(forest.value), forest.pairs())
            moved = np.flatnonzero(to != np.arange(len(to)))
            return pa.RecordBatch.from_arrays([pa.array(forest.value[x, 0].view(np.int64)) for x in (moved, to[moved])], names=["a", "b"])

        for b in parts:
            shard = np.concatenate([shard, b.column(0).to_numpy()])
            value = np.concatenate([value, b.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(shard, shard[-1], "left")) if len(shard) else 0
            if whole >= 1 << 15:
                yield made(whole)
                shard, value = shard[whole:], value[whole:]
        if len(shard):
            yield made(len(shard))

    return run


def _block(k: int):
    return F.shiftrightunsigned("value", 16 * k).bitwiseAND(F.lit(0xFFFF))


PAIRS = tuple(combinations(range(4), 2))


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join exactly the fingerprints that chains of steps of at most `radius` (0 to 2) bits join.

    `values` has distinct longs in a column of that name.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four blocks find at most two differing bits")
    pair = lambda i, a, b: F.struct(F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(F.shiftleft(_block(a), 16)).bitwiseOR(_block(b)).alias("shard"), F.lit(i).alias("pair"))
    dealt = values.select("value", F.explode(F.array(*(pair(i, a, b) for i, (a, b) in enumerate(PAIRS)))).alias("p")).select("value", "p.shard", "p.pair")
    large = dealt.groupBy("shard").count().where(F.col("count") > SPLIT).select("shard", F.lit(True).alias("large"))
    # the other two blocks as four of 8 bits, of which two are equal again
    other = F.lit(None).cast("array<int>")
    for i, (a, b) in enumerate(PAIRS):
        c, d = (k for k in range(4) if k not in (a, b))
        eights = F.array(*(F.shiftrightunsigned("value", 16 * k + 8 * h).bitwiseAND(F.lit(0xFF)).cast("int") for k in (c, d) for h in (0, 1)))
        other = F.when(F.col("pair") == i, eights).otherwise(other)
    finer = F.transform(F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in PAIRS)), lambda p: F.xxhash64(F.col("shard"), F.get(p, F.lit(0)), F.get(F.col("other"), F.get(p, F.lit(0))), F.get(p, F.lit(1)), F.get(F.col("other"), F.get(p, F.lit(1)))))
    shards = dealt.withColumn("other", other).join(large, "shard", "left").select(F.explode(F.when(F.col("large"), finer).otherwise(F.array("shard"))).alias("shard"), "value")
    return shards.repartition("shard").sortWithinPartitions("shard").select("shard", "value").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """For each row its id, fingerprint (16 hexadecimal digits) and component: the smallest id that links reach.

    Texts without words have fingerprint 0 and are linked like any others; repeated rows and equal ids stay rows
    of their own. A row of null id is counted, but its id is no component's.
    """
    docs = materialize(fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), size=size))
    values = materialize(docs.groupBy(F.col("fingerprint").alias("value")).agg(F.min("doc_id").alias("least")), few_files=True)
    joined = components(links(values.select("value"), radius)).select(F.col("node").alias("value"), "root")
    rooted = values.join(joined, "value", "left").withColumn("root", F.coalesce("root", "value"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("value").alias("fingerprint"), "component_id")
    return docs.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: For documents that are similar rather than nearly equal: words of a fingerprint, bits that two of a shard share,
#: shards that each document is dealt to, and the radius. At a Jaccard similarity of 0.8 of the shingles their cosine
#: is 2 * 0.8 / 1.8, and a share of acos(cosine) / pi = 0.15 of 256 bits differs.
WORDS = 4
SHARD_BITS = 16
SHARDS = 72
SIMILAR_RADIUS = 50
#: Differing bits at a similarity of 0.8 are 38 on average, give or take 5.7. They only propose: the texts themselves
#: decide, for each document and its NEAREST candidates. What those leave out is found by `unmet`.
SIMILARITY = 0.8
NUM, DEN = Fraction(str(SIMILARITY)).as_integer_ratio()
NEAREST = 3
#: Fingerprints of a shard beyond which near ones end at a node.
DENSE = 256
#: One row of so many is counted to learn which shingles are common, the most of them that are told to all tasks, and
#: pairs of postings and texts of pairs that are held at once.
COUNTED = 16
MOST_COMMON = 250_000
PAIRS_AT_ONCE = 1 << 18
TEXTS_AT_ONCE = 256
#: Texts that are judged against one in one go, about; more are dealt out in parts, each with that text.
JUDGED = 64
#: Hashes that keys are told by to all tasks, 64 of them a row.
CODES = 1 << 24


def _bits(shard: int) -> np.ndarray:
    return np.random.default_rng([2, shard]).choice(64 * WORDS, SHARD_BITS, replace=False)


def _dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key, fingerprint), SHARDS for each (key, fingerprint)."""
    chosen = np.stack([_bits(i) for i in range(SHARDS)])
    for b in parts:
        for a in range(0, b.num_rows, 4096):
            part = b.slice(a, 4096)
            fps = np.frombuffer(b"".join(part.column("fingerprint").to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            bits = np.unpackbits(fps, axis=1, bitorder="little")[:, chosen].astype(np.int64)  # row, shard, bit
            shard = (bits << np.arange(SHARD_BITS)).sum(axis=2) | (np.arange(SHARDS, dtype=np.int64) << SHARD_BITS)
            at = pa.array(np.repeat(np.arange(len(fps)), SHARDS))
            yield pa.RecordBatch.from_arrays([pa.array(shard.ravel()), part.column("key").take(at), part.column("fingerprint").take(at)], names=["shard", "key", "fingerprint"])


def _similar(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (shard, key, fingerprint) in order of both: each key, and the nearest of those before it there."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def made(shard, key, value) -> pa.RecordBatch:
        _, at, count = np.unique(shard, return_inverse=True, return_counts=True)
        forest = Forest(shard, value, SIMILAR_RADIUS, count[at] > DENSE)
        none = np.int64(1 << 62)
        best = np.full(len(value), none)
        for i, j in forest.pairs():
            np.minimum.at(best, np.maximum(i, j), forest.distance(i, j) << 40 | np.minimum(i, j))
        near = np.flatnonzero(best < none)
        cols = (key[near], key[best[near] & ((1 << 40) - 1)], best[near] >> 40)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "bits"])

    def all_held():
        return tuple(np.concatenate(x) for x in zip(*held))

    for b in parts:
        if not b.num_rows:
            continue
        value = np.frombuffer(b"".join(b.column("fingerprint").to_pylist()), np.uint64).reshape(-1, WORDS)
        held.append((b.column("shard").to_numpy(), b.column("key").to_numpy(), value))
        shard, key, value = all_held()
        whole = int(np.searchsorted(shard, shard[-1], "left"))
        held = [(shard[whole:], key[whole:], value[whole:])]
        if whole:
            yield made(shard[:whole], key[:whole], value[:whole])
    if held:
        yield made(*all_held())


def shingles_of(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, one of none has none."""
    import xxhash

    said = (text or "").encode().lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(said)] if len(said) < size else map(b" ".join, zip(*(said[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def _alike(size: int):
    """Over rows (a, b, text), those of equal a and part together and a's own text, of null b, before them: the pairs (a, b) whose texts have a Jaccard similarity of SIMILARITY or more."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for p in parts:
            keep = []
            for b, text in zip(p.column("b"), p.column("text")):
                y = shingles_of(text.as_py(), size)
                if not b.is_valid:
                    x = y
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([p.column("a").filter(keep), p.column("b").filter(keep)], names=["a", "b"])

    return run


def _told(df: DataFrame, keys: DataFrame, among: bool) -> DataFrame:
    """The rows of `df` whose key has the hash of one of `keys`, or those whose key hasn't. Nothing of `df` is shuffled."""
    code = F.pmod(F.xxhash64("key"), F.lit(CODES))
    coded = lambda x: x.withColumns({"word": F.shiftright(code, 6), "bit": code.bitwiseAND(F.lit(63)).cast("int")})
    words = F.broadcast(coded(keys).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("said")))
    has = F.coalesce(F.getbit("said", F.col("bit")) == 1, F.lit(False))
    return coded(df).join(words, "word", "left").where(has if among else ~has).drop("word", "bit", "said")


def _verified(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar; `pairs` is a written table."""
    many = pairs.groupBy("a").count().where(F.col("count") > JUDGED)
    parted = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / JUDGED)), F.lit(0)).alias("part"))
    # where each text goes: to the parts of its own key if that has pairs to judge, and to every a that it is the b of
    asked = parted.select(F.col("a").alias("key"), "a", F.lit(None).cast("long").alias("b"), "part").distinct().union(parted.select(F.col("b").alias("key"), "a", "b", "part"))
    # few texts are asked for: most others go by a hash of their key before the shuffle
    rows = _told(docs, asked.select("key"), True).join(asked, "key").select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).select("a", "b", "text")
    return materialize(rows.mapInArrow(_alike(size), "a long, b long"))


def _prefixes(size: int, common: np.ndarray):
    """Over rows (key, text): the prefix of each text that has shingles, in order, and how many it has in all.

    Shingles of a text are in one order for all texts: `common` ones last, as they come there, others by their hash.
    """
    by = np.argsort(common)
    known = common[by]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            made = []
            for t in b.column("text").to_pylist():
                own = shingles_of(t, size)
                rank = np.zeros(len(own), np.int64)
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, by[at] + 1, 0)
                own = own[np.lexsort((own, rank))]
                made.append((own[: len(own) - -(-NUM * len(own) // DEN) + 1].view(np.int64), len(own)))
            some = pa.array([n > 0 for _, n in made], pa.bool_())
            cols = [b.column("key"), pa.array([x for x, _ in made], pa.list_(pa.int64())), pa.array([n for _, n in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in cols], names=["key", "prefix", "n"])

    return run


def _meeting(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over postings in order of shingle and group: pairs of keys of different groups that the places leave possible."""
    names = ("shingle", "group", "key", "place")

    def made(shingle, group, key, place) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        run = new | np.concatenate([[True], group[1:] != group[:-1]])
        ends = lambda first: np.append(np.flatnonzero(first), len(first))[np.cumsum(first)]
        begin = ends(run)  # of the next group
        count = ends(new) - begin
        upto = np.cumsum(count)
        size, at = place >> 32, place & 0xFFFFFFFF
        low = 0
        while low < len(key):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
            c = count[low:high]
            x = np.repeat(np.arange(low, high), c)
            y = np.repeat(begin[low:high] - (np.cumsum(c) - c), c) + np.arange(len(x))
            need = -(-NUM * (size[x] + size[y]) // (NUM + DEN))
            fits = (at[x] <= size[x] - need) & (at[y] <= size[y] - need)
            x, y = key[x[fits]], key[y[fits]]
            low = high
            if len(x):
                pair = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in parts:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(n).to_numpy() for n in names))
        if held[0][0][0] != held[-1][0][-1] and sum(len(h[0]) for h in held) >= 1 << 16:
            rows = tuple(np.concatenate(x) for x in zip(*held))
            whole = len(rows[0]) - int(np.argmax(rows[0][::-1] != rows[0][-1]))
            held = [tuple(x[whole:] for x in rows)]
            yield from made(*(x[:whole] for x in rows))
    if held:
        yield from made(*(np.concatenate(x) for x in zip(*held)))


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that many texts have, the most common last. Of a sample: any order finds the same pairs, a good one few others."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            said = np.concatenate([np.zeros(0, np.uint64), *(shingles_of(t, size) for t in b.column(0).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(said.view(np.int64))], names=["shingle"])

    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(COUNTED)) == 0).select("text").mapInArrow(run, "shingle long")
    top = some.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).select("shingle")
    return np.array([r.shingle for r in top.collect()][::-1], np.int64).view(np.uint64)


def unmet(docs: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """(a, b): all pairs of keys of different groups that can be similar, and some others. Exact: no similar pair is missing.

    `docs` has key and text, `groups` has key and group of those that count. Where two sets of m and n shingles are
    similar, they share 0.8 / 1.8 * (m + n); so, with the shingles of both in the same order, the first that they
    share has as many from there to the end of either. Only the first fifth of a set can hold it. Those fifths, not the
    texts, go to their groups, and only where the group isn't the key.
    """
    run = _prefixes(size, _common(docs, size))
    others = docs.select("key").join(groups.where("group = key"), "key", "left_anti")
    prefixes = lambda among: _told(docs.select("key", "text"), others, among).mapInArrow(run, "key long, prefix array<long>, n long")
    grouped = prefixes(False).withColumn("group", F.col("key")).unionByName(prefixes(True).join(groups, "key"))
    postings = grouped.select("group", "key", "n", F.posexplode("prefix").alias("at", "shingle"))
    postings = postings.select("shingle", "group", "key", F.shiftleft("n", 32).bitwiseOR(F.col("at")).alias("place"))
    met = postings.repartition("shingle").sortWithinPartitions("shingle", "group", "key").mapInArrow(_meeting, "a long, b long")
    return materialize(met.distinct())


def sketch_of(own: np.ndarray) -> bytes:
    """A bit for each place that a hash's low bits name: whether an odd number of a set's hashes lie there. As many places as hashes or up to twice that, 64 at least."""
    n = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def at_least_apart(x: bytes, y: bytes) -> int:
    """How many hashes at least are in one only of two sets, of their sketches: each such hash changes one place. Halves laid over each other are the sketch of half as many places."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near_enough(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (a, b, m, x, n, y): the pairs whose sets, of m and n shingles and sketches x and y, can be similar."""
    for p in parts:
        rows = zip(*(p.column(c).to_pylist() for c in ("m", "x", "n", "y")))
        keep = pa.array([at_least_apart(x, y) <= m + n - 2 * -(-NUM * (m + n) // (NUM + DEN)) for m, x, n, y in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([p.column("a").filter(keep), p.column("b").filter(keep)], names=["a", "b"])


def possible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) but those that the sketches of `marked` rule out; no similar pair is lost."""
    of = lambda key, n, sketch: marked.select(F.col("key").alias(key), F.col("n").alias(n), F.col("sketch").alias(sketch))
    both = pairs.join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b").select("a", "b", "m", "x", "n", "y")
    return materialize(both.mapInArrow(_near_enough, "a long, b long"), few_files=True)


def _marked(docs: DataFrame, size: int) -> DataFrame:
    """(key, same, fingerprint, n, sketch): 128 bits that stand for the set of shingles, and the fingerprint, number and sketch of that set."""
    import xxhash

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sets = [shingles_of(t, size) for t in b.column("text").to_pylist()]
            same = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            cols = [pa.array(same, pa.binary()), pa.array([_majority(s, WORDS) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch_of(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("key"), *cols], names=["key", "same", "fingerprint", "n", "sketch"])

    return materialize(docs.select("key", "text").mapInArrow(run, "key long, same binary, fingerprint binary, n long, sketch binary"))


def similar(df: DataFrame, key_col: str, text_col: str = "text", size: int = 5) -> DataFrame:
    """(key, group): rows of one group are joined by steps of a similarity of 0.8 or more of their shingles.

    The key is a long that differs between rows. Texts of equal sets of shingles, such as copies, are one value. All
    other links are verified by the sets. The fingerprints' trees find most at little cost; `unmet` finds all that are missing between the groups of
    those, so the links that trees and candidates lose cost time only. Texts without words are one group.
    """
    with batches_of(df.sparkSession, TEXTS_AT_ONCE):
        return _similar_groups(df.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")), size).withColumnRenamed("key", key_col)


def _similar_groups(docs: DataFrame, size: int) -> DataFrame:
    marked = _marked(docs, size)
    values = materialize(marked.groupBy("same").agg(F.min("key").alias("key"), F.first("fingerprint").alias("fingerprint")), few_files=True)
    dealt = values.select("key", "fingerprint").mapInArrow(_dealt, "shard long, key long, fingerprint binary")
    found = dealt.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(_similar, "a long, b long, bits long")
    # at most SHARDS candidates each; the others are left to `unmet`
    nearest = F.slice(F.array_sort(F.collect_set(F.struct("bits", "b"))), 1, NEAREST)
    asked = materialize(found.groupBy("a").agg(nearest.alias("n")).select("a", F.explode("n.b").alias("b")))
    links = _verified(docs, asked, size)
    discard(asked)
    found = components(links).select(F.col("node").alias("key"), "root")
    groups = materialize(values.select("same", "key").join(found, "key", "left").select("same", "key", F.coalesce("root", "key").alias("group")), few_files=True)
    met = unmet(docs, groups.select("key", "group"), size)
    pairs = possible(met, marked)
    discard(met)
    missing = _verified(docs, pairs, size)
    discard(pairs)
    # only links between groups are left to follow
    of = lambda key, group: groups.select(F.col("key").alias(key), F.col("group").alias(group))
    between = missing.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    joined = components(between, "x", "y").select(F.col("node").alias("group"), "root")
    named = groups.join(joined, "group", "left").select("same", F.coalesce("root", "group").alias("group"))
    return marked.join(named, "same").select("key", "group")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The rows less all but one of each group of similar texts: that of smallest id stays, nulls last."""
    key = "__row"
    while key in df.columns:
        key += "_"
    rows = with_row_key(df, key)
    groups = similar(rows, key, text_col, size).withColumnRenamed("group", "__group")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(key))
    stay = rows.select(id_col, key).join(groups, key).groupBy("__group").agg(F.min(order).alias("m")).select(F.col("m")[key].alias(key))
    return rows.join(stay, key, "left_semi").drop(key)
