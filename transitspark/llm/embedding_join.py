"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least t lie within epsilon = sqrt(2 - 2 t) of each other. They are laid on principal
axes, sorted by length and by the cells of a grid of width epsilon on the leading ones, and cut into blocks of that
sequence. Blocks that share no cell of three axes or a neighbour of one, or whose bounding boxes are farther apart than
epsilon, are never joined. The others meet in tasks, which halve both intervals again and again, skip intervals that are
provably distant, and compare what is left. A task gives back counts and a spanning set of links, never all pairs.

A block grows with the table up to BLOCK_BYTES, so a vector is dealt about as often at every size till then; vectors
without structure, of which every block may be near every other, are dealt in proportion to the number of blocks beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, staged, table
from .linking import members, unite

COSINE = 0.9
#: Axes that have cells, axes of boxes, and vectors that the axes are fitted on, at most (any axes give the same links).
CELLS, AXES, SAMPLE = 3, 16, 4_000
#: Blocks of a table, least vectors and most bytes of one (as doubles), blocks that meet one in a task, and vectors of
#: an interval that is not halved.
BLOCKS, LEAST, BLOCK_BYTES, MEET, LEAF = 8, 1_024, 16 << 20, 2, 512


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def box_gap(a: np.ndarray, b: np.ndarray) -> float:
    """The squared distance of two bounding boxes, rows lo and hi."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


def interval_join(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of x and y, unit vectors in grid order, with a cosine of at least `cosine`; px and py are their
    places on some principal axes.

    same: y is x, and only i < j are given.
    """
    reach = 2 - 2 * cosine + 1e-9
    x4, y4 = x.astype("f4"), y.astype("f4")
    boxes: dict[tuple[int, int, int], np.ndarray] = {}

    def box(which: int, a: int, b: int) -> np.ndarray:
        if (which, a, b) not in boxes:
            part = (px, py)[which][a:b]
            boxes[which, a, b] = np.stack([part.min(axis=0), part.max(axis=0)])
        return boxes[which, a, b]

    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, a2, b, b2 = todo.pop()
        if a == a2 or b == b2 or (same and b2 <= a) or box_gap(box(0, a, a2), box(1, b, b2)) > reach:
            continue
        if max(a2 - a, b2 - b) > LEAF:
            if a2 - a >= b2 - b:
                m = (a + a2) // 2
                todo += [(a, m, b, b2), (m, a2, b, b2)]
            else:
                m = (b + b2) // 2
                todo += [(a, a2, b, m), (a, a2, m, b2)]
            continue
        i, j = np.nonzero(x4[a:a2] @ y4[b:b2].T >= cosine - 1e-4)
        i, j = i + a, j + b
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            near = np.einsum("nd,nd->n", x[i], y[j]) >= cosine
            yield i[near], j[near]


def _axes(vectors: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """By length, the leading principal axes of a sample; lengths that it holds few vectors of lie on their own axes."""
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("dim", "v").toPandas()
    out = {}
    for dim, part in rows.groupby("dim"):
        x = _unit(list(part["v"]), kind)
        if len(x) >= 50 and dim > 1:
            out[int(dim)] = np.linalg.eigh((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))[1][:, ::-1][:, :AXES].copy()
    return out


def _places(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """AXES coordinates of unit vectors of one length."""
    dim = x.shape[1]
    p = x @ axes[dim] if dim in axes else x[:, :AXES]
    return np.pad(p, ((0, 0), (0, max(0, AXES - p.shape[1]))))


def join(vectors: DataFrame, kind: str, cosine: float = COSINE) -> DataFrame:
    """(kind, x, y) from distinct vectors(rep, copies, dim, v: bytes of `kind`): kind 0 says that vector x has y links
    to rows with other values, kind 1 is a link of a spanning set. Only vectors of equal length are compared."""
    spark = vectors.sparkSession
    n, dim = vectors.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    axes, width = spark.sparkContext.broadcast(_axes(vectors, kind)), float(np.sqrt(2 - 2 * cosine))
    size = int(min(max(-(-n // BLOCKS), LEAST), max(BLOCK_BYTES // (8 * dim), 16)))
    count = max(1, -(-n // size))
    cells = [f"c{k}" for k in range(AXES)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for _, part in p.groupby("dim"):
                c = np.floor(_places(_unit(list(part["v"]), kind), axes.value) / width).astype("int32")
                yield part.assign(**{name: c[:, k] for k, name in enumerate(cells)})

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, k = [], 0

        def cut(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, k
            p = pd.concat(held) if held else pd.DataFrame({"dim": []})
            held = []
            for d, own in p.groupby("dim", sort=True):
                for at in range(0, len(own), size):
                    part = own.iloc[at : at + size]
                    if not last and d == p["dim"].iloc[-1] and len(part) < size:
                        held = [part]  # more of it may come
                        continue
                    x = _places(_unit(list(part["v"]), kind), axes.value)
                    yield pd.DataFrame({
                        "block": (TaskContext.get().partitionId() << 24) + k, "at": np.arange(len(part)), "dim": d, "rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(),
                        "v": part["v"].to_numpy(), "lo": [x.min(axis=0)] + [None] * (len(part) - 1), "hi": [x.max(axis=0)] + [None] * (len(part) - 1),
                    })
                    k += 1

        for p in batches:
            held.append(p[["dim", "rep", "copies", "v"]])
            if sum(map(len, held)) >= 2 * size:
                yield from cut(False)
        yield from cut(True)

    placed = vectors.mapInPandas(place, "rep long, copies long, dim int, v binary, " + ", ".join(f"{c} int" for c in cells))
    ordered = placed.repartitionByRange(count, "dim", *cells, "rep").sortWithinPartitions("dim", *cells, "rep")
    rows = staged(ordered.mapInPandas(block, "block long, at int, dim int, rep long, copies long, v binary, lo array<double>, hi array<double>"))
    boxes = rows.where("at = 0").select("block", "dim", "lo", "hi")

    def met(name: str, margin: int) -> DataFrame:
        """Boxes by each cell of the first axes that they touch, or lie beside."""
        df = boxes.select(F.col("block").alias(name), "dim", F.col("lo").alias(f"{name}lo"), F.col("hi").alias(f"{name}hi"))
        for k in range(CELLS):
            edge = lambda c: F.floor(F.element_at(f"{name}{c}", k + 1) / width).cast("int")  # noqa: B023, E731
            df = df.withColumn(f"cell{k}", F.explode(F.sequence(edge("lo") - margin, edge("hi") + margin)))
        return df

    gap = F.zip_with(F.zip_with("alo", "bhi", lambda p, q: p - q), F.zip_with("blo", "ahi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    pairs = met("a", 1).join(met("b", 0), ["dim", *(f"cell{k}" for k in range(CELLS))]).where("a <= b")
    pairs = pairs.where(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= 2 - 2 * cosine + 1e-9).select("a", "b").distinct()
    pairs = staged(pairs.select("a", "b", F.expr(f"shiftright(b, 24) div {MEET} * 16777216 + (b & 16777215) div {MEET}").alias("part")))
    sides = pairs.select("a", "part", F.col("a").alias("block"), F.lit(0).alias("side")).distinct().unionByName(pairs.select("a", "part", F.col("b").alias("block"), F.lit(1).alias("side")))
    meet = sides.join(rows.select("block", "at", "rep", "copies", "v"), "block")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["side", "block", "at"])
        one, rest = p[p["side"] == 0], p[p["side"] == 1]
        x = _unit(list(one["v"]), kind)
        px = _places(x, axes.value)
        ids: list[np.ndarray] = [one["rep"].to_numpy()]
        copies, total = [one["copies"].to_numpy()], [np.zeros(len(one), "i8")]
        label = np.arange(len(one))
        for b, other in rest.groupby("block", sort=True):
            same = b == one["block"].iloc[0]
            y = x if same else _unit(list(other["v"]), kind)
            base = 0 if same else len(label)
            if not same:
                label = np.append(label, base + np.arange(len(other)))
                ids.append(other["rep"].to_numpy())
                copies.append(other["copies"].to_numpy())
                total.append(np.zeros(len(other), "i8"))
            k = 0 if same else -1
            for i, j in interval_join(x, y, px, px if same else _places(y, axes.value), same, cosine):
                np.add.at(total[0], i, copies[k][j])
                np.add.at(total[k], j, copies[0][i])
                label = unite(label, i, j + base)
        rep, n_links, m = np.concatenate(ids), np.concatenate(total), members(label)
        some = n_links > 0
        return pd.DataFrame({"kind": np.repeat([0, 1], [some.sum(), len(m)]), "x": np.concatenate([rep[some], rep[m]]), "y": np.concatenate([n_links[some], rep[label[m]]])})

    return meet.groupBy("a", "part").applyInPandas(compare, "kind int, x long, y long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings(vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors link with
    those of their own length only. Equal vectors are compared once; each row of them counts as a link of the others.
    An id is taken to name one vector, in one row or several. Rows with null vec_id count as copies of equal vectors;
    a vector that no row names is compared with no other.
    """
    double = not isinstance(getattr(embeddings.schema["embedding"].dataType, "elementType", None), FloatType)
    kind, element = ("<f8", "double") if double else ("<f4", "float")
    assert isinstance(embeddings.schema["embedding"].dataType, ArrayType)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>").alias("e"))
    usable = F.expr("coalesce(size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(e, x -> x <> 0), false)")
    good = rows.where(usable)
    classes = good.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"rep": p["rep"], "copies": p["copies"], "dim": [len(e) for e in p["e"]], "v": [np.asarray(e, kind).tobytes() for e in p["e"]]})

    vectors = staged(classes.where("rep is not null").mapInPandas(pack, "rep long, copies long, dim int, v binary"))
    found = staged(join(vectors, kind, cosine))
    counts = found.where("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("others"))
    comps = components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    per_class = classes.join(counts, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    known = staged(per_class.select("e", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = good.join(known, "e").select("vec_id", "n_links", "component_id")  # both sides are shuffled anew, so a vector of very many rows is split
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of embeddings: how many other vectors link with it, the smallest vec_id that links reach, and whether
    that is its own. Unusable vectors link with nothing; no rows give no rows."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_embedding_near_dedup": op8_embedding_near_dedup}
ORACLES: dict[str, str] = {}
