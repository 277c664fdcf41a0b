"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie joined with itself.

Distinct fingerprints are few when copies are many, so they are made distinct first. With at most d differing bits, one
of d + 1 blocks of bits is equal; fingerprints are rotated so that this block leads, and dealt by it. In a task, the
sorted fingerprints of a block are an implicit binary trie. Pairs of its nodes go down together, adding up differing
bits, and a pair is dropped as soon as more than d differ. A task emits a spanning set of links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HUB, components, forget_others, sliced, staged, table, with_least
from .linking import members, unite

WORDS, SEED, BUDGET = 3, 42, 2
#: Fingerprints of one block beyond which the trie is taken apart DEEP bits further down before dealing.
HOT, DEEP = 100_000, 12
#: Node pairs that go down together.
FRONTIER = 200_000


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxh64_intdigest, seed=seed), shingles), "<u8")
    ones = np.zeros(64, "int64")
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view("u1"), bitorder="little").reshape(-1, 64).sum(0, dtype="u4")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): a null or wordless text has fingerprint 0; fp is the 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([fingerprint(t or "", words, seed) for t in b.column("text").to_pylist()], "u8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view("i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, fp long")


def trie_links(v: np.ndarray, pairs: np.ndarray, bit: int, budget: int, last: int = 64):
    """Yields (i, j) arrays of positions in v whose values differ in at most `budget` bits.

    v holds ascending runs; pairs has rows (begin, end, begin, end, differing bits so far) of two nodes, whose values
    agree within each node on the bits above `bit`, counted from the top. A node paired with itself stands for all
    pairs inside it.
    """
    todo = [(pairs, bit)]
    ones: dict[int, np.ndarray] = {}
    while todo:
        p, t = todo.pop()
        if len(p) > FRONTIER:
            todo += [(p[: len(p) // 2], t), (p[len(p) // 2 :], t)]
            continue
        na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        small = (na * nb <= 16) | (t == last)
        if small.any():
            q, n = p[small], (na * nb)[small]
            which = np.repeat(np.arange(len(q)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = (q[:, 3] - q[:, 2])[which]
            i, j = q[which, 0] + k // width, q[which, 2] + k % width
            near = (np.bitwise_count(v[i] ^ v[j]) <= budget) & ((q[which, 0] != q[which, 2]) | (i < j))
            yield i[near], j[near]
            p = p[~small]
        if not len(p):
            continue
        if t not in ones:
            ones[t] = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - t)) & np.uint64(1), dtype="int64")])
        c = ones[t]
        a, a2, b, b2, d = p.T
        am, bm = a2 - (c[a2] - c[a]), b2 - (c[b2] - c[b])  # values with a 1 here stand last in a node
        same = a == b
        down = np.concatenate([
            np.column_stack([a, am, b, bm, d]),
            np.column_stack([am, a2, bm, b2, d]),
            np.column_stack([a, am, bm, b2, d + 1]),
            np.column_stack([am, a2, b, bm, d + 1])[~same],
        ])
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        if len(down):
            todo.append((down, t + 1))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of budget + 1 blocks."""
    n = budget + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(a, b) from distinct fps(fp): links that join every two fingerprints that differ in at most `budget` bits,
    directly or through others."""
    blocks = _blocks(budget)
    turned = [
        F.struct(
            F.lit(k).alias("block"),
            F.shiftrightunsigned("fp", 64 - first).bitwiseOR(F.shiftleft("fp", first)).alias("v") if first else F.col("fp").alias("v"),
        )
        for k, (first, _) in enumerate(blocks)
    ]
    rows = fps.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
    rows = rows.withColumn("head", F.expr("shiftrightunsigned(v, 64 - element_at(array({}), block + 1))".format(", ".join(str(w) for _, w in blocks))))
    large = rows.groupBy("block", "head").count().where(F.col("count") > hot).select("block", "head", F.lit(True).alias("hot"))
    rows = rows.join(large, ["block", "head"], "left")
    masks = [sum(1 << i for i in c) for n in range(budget + 1) for c in combinations(range(DEEP), n)]
    below = F.expr("cast(shiftrightunsigned(v, 64 - {} - element_at(array({}), block + 1)) & {} as int)".format(DEEP, ", ".join(str(w) for _, w in blocks), (1 << DEEP) - 1))
    split = (
        rows.where("hot").withColumn("sub", below).select("block", "head", "v", "sub", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
        .select("block", "head", "v", F.least("sub", F.col("sub").bitwiseXOR(F.col("mask"))).alias("lo"), F.greatest("sub", F.col("sub").bitwiseXOR(F.col("mask"))).alias("hi"))
    )
    dealt = rows.where("hot is null").select("block", "head", "v", F.lit(-1).alias("lo"), F.lit(-1).alias("hi")).unionByName(split)
    dealt = dealt.repartition("block", "head", "lo", "hi").sortWithinPartitions("block", "head", "lo", "hi")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(t: pa.Table) -> pa.RecordBatch:
        cols = {c: t.column(c).to_numpy() for c in ("block", "head", "v", "lo", "hi")}
        v = cols["v"].view("u8")
        group = np.concatenate([[0], np.cumsum(np.any([cols[c][1:] != cols[c][:-1] for c in ("block", "head", "lo", "hi")], axis=0))]) if len(v) else np.empty(0, "int64")
        order = np.lexsort((v, group))
        v, group = v[order], group[order]
        block, lo, hi = (cols[c][order] for c in ("block", "lo", "hi"))
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(starts[1:], len(v))
        label = np.arange(len(v))
        for k, (_, w) in enumerate(blocks):
            for deep in (False, True):
                own = (block[starts] == k) & ((lo[starts] >= 0) == deep) & (ends - starts > 1)
                s, e = starts[own], ends[own]
                if not len(s):
                    continue
                if deep:
                    sub = (v >> np.uint64(64 - DEEP - w)).astype("int64") & ((1 << DEEP) - 1)
                    mid = np.array([a + np.searchsorted(sub[a:b], hi[a]) if lo[a] != hi[a] else a for a, b in zip(s, e)])
                    one = lo[s] == hi[s]
                    d = np.bitwise_count(lo[s] ^ hi[s]).astype("int64")
                    pairs = np.column_stack([s, np.where(one, e, mid), np.where(one, s, mid), e, d])
                    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
                else:
                    pairs = np.column_stack([s, e, s, e, np.zeros(len(s), "int64")])
                for i, j in trie_links(v, pairs, w + (DEEP if deep else 0), budget):
                    label = unite(label, i, j)
        m = members(label)
        first = np.array([f for f, _ in blocks], "u8")[block]
        back = np.where(first == 0, v, (v >> first) | (v << ((np.uint64(64) - first) % np.uint64(64)))).view("i8")
        return pa.RecordBatch.from_arrays([pa.array(back[m]), pa.array(back[label[m]])], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            keys = np.column_stack([t.column(c).to_numpy().astype("int64") for c in ("block", "head", "lo", "hi")])
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))  # rows before the last group, which may go on
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield solve(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield solve(held)

    return dealt.mapInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of fingerprints reach, for every row of docs.

    Null and empty texts share fingerprint 0 and are linked like any other; rows that share a doc_id are rows of
    their own; a null doc_id gets the component of its fingerprint.
    """
    own = staged(fingerprints(docs))
    fps = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(fps.select("fp"), budget))
    linked = staged(found.join(fps, found.node == fps.fp).select("fp", "component", "first"))
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    ids = fps.join(linked.join(least, "component").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return own.join(staged(ids), "fp").select("doc_id", "fp", "component_id")  # both sides are shuffled anew, so a very common fingerprint is split


#: Wide fingerprints: words of 64 bits, and words of a shingle. Bands of minimum hashes, and hashes of a band.
LANES, WIDE_WORDS, SIMILARITY, BANDS, ROWS = 8, 5, 0.8, 24, 6
BITS = 64 * LANES
#: Standard deviations of differing bits that a pair is still looked at with; shingles of one band that a task gets whole.
DEVIATIONS, WHOLE = 3, 4_000_000
_SALTS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype="u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int = WIDE_WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles in ascending order; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, "u8")
    shingles = set(map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)])
    return np.unique(np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), "u8"))


def set_key(h: np.ndarray) -> int:
    """Names a set of shingles, as a signed long."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(h.tobytes(), seed=SEED)).view("i8"))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """LANES words of a set of shingles, all bits drawn from one hash of each; of no shingles: zeros."""
    ones = np.zeros(BITS, "i8")
    salts = np.arange(1, LANES + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 2048):
        x = np.ascontiguousarray(_mixed(h[at : at + 2048, None] + salts))
        ones += np.unpackbits(x.view("u1"), axis=1).sum(0, dtype="u4")
    return np.packbits(2 * ones > len(h)).view("u8")


def bands(h: np.ndarray) -> np.ndarray:
    """BANDS numbers of a set of shingles: sets of similarity s agree in each with probability s ** ROWS."""
    least = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for at in range(0, len(h), 2048):
        least = np.minimum(least, ((h[at : at + 2048, None] ^ _SALTS[0]) * (_SALTS[1] | np.uint64(1))).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype="u8")
    for column in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def differing(similarity: float, deviations: float, bits: int = BITS) -> float:
    """Bits in which texts of that share of common shingles differ, and so many standard deviations of that number."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return bits * p + deviations * (bits * p * (1 - p)) ** 0.5


#: Texts of fewer shingles differ in more bits, for ties are common: in up to 0.1875 of them on average at a similarity
#: of 0.8 (4 against 5 shingles), by the exact binomials; so much is added to the share.
FEW_SHINGLES, TIES = 24, 0.0440


def most_differing(few, similarity: float, bits: int = BITS):
    """Bits beyond which a pair is not looked at."""
    return differing(similarity, DEVIATIONS, bits) + few * TIES * bits + 1


def _near(pairs: DataFrame, classes: DataFrame, similarity: float, deviations: float | None) -> DataFrame:
    """Those of distinct pairs(a, b) of classes whose sizes and wide fingerprints don't rule the similarity out."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    df = pairs.join(side("a"), "a").join(side("b"), "b")
    bits = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    few = F.when(F.least("na", "nb") < FEW_SHINGLES, 1).otherwise(0)
    limit = differing(similarity, deviations) if deviations is not None else most_differing(few, similarity)
    return df.where((F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9) & (bits <= limit)).select("a", "b")


def _sets(keys: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, hashes) of the classes of keys(key): their texts are read again, and made shingles once more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            hashes = [shingle_hashes(t or "") for t in b.column("text").to_pylist()]
            own = pa.array([set_key(h) == k for h, k in zip(hashes, b.column("key").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array([h.view("i8") for h in hashes], pa.list_(pa.int64()))], ["key", "id", "hashes"]).filter(own)

    texts = docs.join(keys.join(classes.select("key", "id"), "key"), F.col("doc_id") == F.col("id")).select("key", "id", "text")
    return staged(texts.mapInArrow(sets, "key long, id long, hashes array<long>").dropDuplicates(["key"]))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, first_a, first_b) of those pairs whose texts share `similarity` of their distinct shingles, row by row;
    first is the smallest doc_id of a class."""
    found = _sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, classes)
    both = pairs.join(found.select(F.col("key").alias("a"), F.col("id").alias("first_a"), F.col("hashes").alias("ha")), "a")
    both = both.join(found.select(F.col("key").alias("b"), F.col("id").alias("first_b"), F.col("hashes").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    near = (common >= 1) & (common / (F.size("ha") + F.size("hb") - common) >= similarity)
    return staged(both.where(near).select("a", "b", "first_a", "first_b"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each row's begin, with the end of the last."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0] : at[-1]].view("u8"), at - at[0]


def _across(rows: DataFrame, similarity: float, whole: int) -> DataFrame:
    """(a, b) from rows(band, key, component, n, wide, bands, hashes, total): links that join every two classes of one
    band that share `similarity` of their shingles, directly or through others or through their component.

    The classes of a band lie in a binary trie of the leading words of their fingerprints, which is joined with itself;
    what sizes and the other words don't rule out is held against each other by the exact share, unless links found
    before have brought it together, and in the first band that the two share only. So a task gives back a spanning
    set of true links. A band of more than `whole` shingles is dealt as pairs of blocks.
    """
    blocks = F.ceil(F.col("total") / whole)
    own = F.pmod(F.xxhash64("key"), blocks)
    df = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    df = df.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "component", "n", "wide", "bands", "hashes")
    df = df.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    group = ("band", "lo", "hi")

    def solve(t: pa.Table) -> pa.RecordBatch:
        cols = {c: t.column(c).to_numpy() for c in (*group, "own", "key", "component", "n")}
        w, bands_ = (_flat(t.column(c))[0].reshape(len(t), -1) for c in ("wide", "bands"))
        hashes, at = _flat(t.column("hashes"))
        new = np.concatenate([[True], np.any([cols[c][1:] != cols[c][:-1] for c in group], axis=0)])
        number = np.cumsum(new) - 1
        side = (cols["own"] == cols["hi"]) & (cols["lo"] != cols["hi"])
        order = np.lexsort((w[:, 0], side, number))
        w, bands_, n, k, number = w[order], bands_[order], cols["n"][order], cols["key"][order], number[order]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(n))
        mids = starts + np.bincount(number, ~side[order]).astype("int64")  # a pair of blocks is a pair of nodes, a whole band one node twice
        split = cols["lo"][starts] != cols["hi"][starts]
        first = np.column_stack([starts, mids, np.where(split, mids, starts), ends, np.zeros(len(starts), "int64")])
        first = first[(first[:, 0] < first[:, 1]) & (first[:, 2] < first[:, 3])]
        place = (bands_ == cols["band"].view("u8")[order][:, None]).argmax(axis=1)  # which of the bands this one is
        label = np.unique(np.column_stack([number, cols["component"][order]]), axis=0, return_inverse=True)[1].reshape(-1)
        found: list[tuple[int, int]] = []
        budget = int(most_differing(int(n.min() < FEW_SHINGLES), similarity, 64))
        for i, j in trie_links(np.ascontiguousarray(w[:, 0]), first, 0, budget):
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (label[i] != label[j]) & (low >= similarity * high - 1e-9)
            i, j, low = i[ok], j[ok], low[ok]
            ok = np.bitwise_count(w[i] ^ w[j]).sum(axis=1) <= most_differing(low < FEW_SHINGLES, similarity)
            i, j = i[ok], j[ok]
            ok = (bands_[i] == bands_[j]).argmax(axis=1) == place[i]
            i, j = i[ok], j[ok]
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            cuts = np.flatnonzero(np.diff(i, prepend=-1))
            for x, a, b in zip(i[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(i)).tolist()):
                others = j[a:b]
                others = others[label[others] != label[x]]
                while len(others):
                    some, others = others[:256], others[256:]  # links found meanwhile may settle the others
                    mine = hashes[at[order[x]] : at[order[x] + 1]]
                    theirs = np.concatenate([hashes[at[order[y]] : at[order[y] + 1]] for y in some])
                    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                    common = np.add.reduceat(hit, np.append(0, np.cumsum(n[some])[:-1]), dtype="int64")
                    near = some[(common >= 1) & (common / (n[some] + n[x] - common) >= similarity)]
                    if len(near):
                        _, one = np.unique(label[near], return_index=True)
                        found += [(x, y) for y in near[one].tolist()]
                        s, e = starts[number[x]], ends[number[x]]
                        label[s:e][np.isin(label[s:e], label[near])] = label[x]
                    others = others[label[others] != label[x]]
        pairs = np.array(found, "int64").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(k[pairs].max(axis=1)), pa.array(k[pairs].min(axis=1))], ["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one group, which may go on
        for b in batches:
            if not len(b):
                continue
            keys = np.column_stack([b.column(c).to_numpy() for c in group])
            if held and [held[-1].column(c)[-1].as_py() for c in group] != keys[0].tolist():
                yield solve(pa.Table.from_batches(held))
                held = []
            before = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield solve(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return df.mapInArrow(walk, "a long, b long").distinct()


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, whole: int = WHOLE) -> DataFrame:
    """(doc_id, component_id) of documents that share at least `similarity` of their distinct 5-word shingles, directly
    or through others. Null and wordless texts are copies of each other; null doc_ids are left out; rows that share a
    doc_id share a component.

    Texts of equal shingles are a class. Classes that agree in a band of minimum hashes meet (the README has the odds),
    and what links two of them is always the exact share. A first round tries each class against the first one of all
    its bands, by aggregates and joins alone; the second one tries all pairs of a band that the first has not
    brought together, but those that differ in so many bits of the wide SimHash fingerprint that they cannot be near.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for b in sliced(batches):
            hashes = [shingle_hashes(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([set_key(h) for h in hashes], pa.int64()), pa.array([len(h) for h in hashes], pa.int32()),
                pa.array([wide_fingerprint(h).view("i8") for h in hashes], pa.list_(pa.int64())), pa.array([bands(h).view("i8") for h in hashes], pa.list_(pa.int64())),
            ], ["doc_id", "key", "n", "wide", "bands"])

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    own = staged(docs.mapInArrow(each, "doc_id long, key long, n int, wide array<long>, bands array<long>"))
    classes = staged(own.groupBy("key").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("wide").alias("wide"), F.min("bands").alias("bands")))
    rows = classes.where("n > 0").select(F.explode("bands").alias("a"), F.col("key").alias("b"))
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).where("n > 1")
    limit = max(1, int(HUB * BANDS * classes.count()))
    met = staged(with_least(rows, least, limit))  # (band, class, first class of the band)
    stars = met.groupBy(F.col("b").alias("a")).agg(F.min("m").alias("b")).where("a <> b")  # a pair a class, at most
    first = _verified(staged(_near(stars, classes, similarity, 0.0)), docs, classes, similarity)
    joined = components(first)
    settled = met.select("a", "b").join(joined, F.col("b") == F.col("node"), "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    settled = staged(settled.join(classes.select(F.col("key").alias("b"), F.col("n").alias("size")), "b"))
    mixed = settled.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total")).where("low <> high")
    open_ = staged(with_least(settled, mixed.select("a", F.col("total").alias("m"), "n"), limit, "component"))
    open_ = open_.select(F.col("a").alias("band"), F.col("b").alias("key"), "component", F.col("m").alias("total"))
    sets = _sets(open_.select("key").distinct(), docs, classes).select("key", "hashes").join(classes.select("key", "n", "wide", "bands"), "key")
    second = staged(_across(open_.join(staged(sets), "key"), similarity, whole))
    ids = classes.select("key", "id")
    second = second.join(ids.select(F.col("key").alias("a"), F.col("id").alias("first_a")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("first_b")), "b")
    links_ = first.unionByName(second.select(first.columns)).select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    named = own.select("doc_id", "key")
    several = named.groupBy("doc_id").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 <> k1").drop("k1")  # rows that share a doc_id
    shared = named.join(several, "doc_id").join(ids, "key").join(ids.select(F.col("key").alias("k0"), F.col("id").alias("b")), "k0").select(F.col("id").alias("a"), "b")
    found = components(links_.unionByName(shared))
    known = staged(ids.join(found, F.col("id") == F.col("node"), "left").select("key", F.coalesce("component", "id").alias("component_id")))
    return named.join(known, "key").select("doc_id", "component_id").distinct()


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: its fingerprint in hexadecimal digits and the smallest doc_id that links of at most two
    differing bits reach. Null and empty texts have fingerprint zero and are linked like any other."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLES: dict[str, str] = {}
