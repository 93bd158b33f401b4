"""Hard negatives by maximum inner product over R-trees packed by sort-tile-recursive.

Rows are cut into tiles by two coordinates (the most spread ones): slabs of equal size along the
first, tiles of equal size along the second inside each slab. A tile of more than ``SHARD`` rows,
such as one of copies, is split by a hash of the id. Inside a shard the rows are sorted and tiled
by further coordinates into leaves of ``LEAF`` rows, and boxes into boxes of ``FAN``. A box bounds
every inner product with an anchor from below and above by its corners, coordinate by coordinate.

An anchor's search keeps a queue of boxes, highest upper bound first. Boxes wholly outside the
score windows, or strictly below the kth best so far, are dropped; equal bounds are opened, since
a smaller id wins ties. Anchors go in blocks of ``ANCHORS`` against every shard, so no task holds
all anchors or all rows; each shard answers with at most k rows an anchor and positive. The driver
holds cut points and counts, some numbers for every ``SHARD`` rows.

Defined results: rows with a null id, label or vector, or a component that is null, not finite or
beyond doubles when multiplied by 256, take no part; missing components of a shorter vector count
as zero; rows that share an id count once, the least label and then the least vector; scores
beyond 64 bits are cut to them in results; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from genoweave.session import cut_lineage

LEAF = 128
FAN = 8
SHARD = 4_096
ANCHORS = 1_024
#: Integer sums up to this size are exact in doubles.
EXACT = 2.0**53


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of packed doubles as one matrix, shorter rows filled with zeros."""
    parts = [np.frombuffer(v.as_buffer(), np.float64) for v in column]
    width = max((len(p) for p in parts), default=0)
    if all(len(p) == width for p in parts):
        return np.array(parts).reshape(len(parts), width)
    return np.stack([np.pad(p, (0, width - len(p))) for p in parts])


def comparable(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with one width; Python integers where doubles could lose a unit."""
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(width, 1) < EXACT:
        return x, y
    return tuple(np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (x, y))


def tiled(x: np.ndarray, rows: np.ndarray, size: int, axes: list[int]) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: slabs along the first axis, slabs of slabs along the next, groups of ``size`` at last."""
    groups = -(-len(rows) // size)
    if groups <= 1:
        yield rows
        return
    order = rows[np.argsort(x[rows, axes[0]], kind="stable")]
    slabs = groups if len(axes) == 1 else int(np.ceil(groups ** (1 / len(axes))))
    per = -(-groups // slabs) * size
    for at in range(0, len(order), per):
        yield from tiled(x, order[at : at + per], size, axes[1:] or axes)


class Tree:
    """Boxes of a shard: leaves hold rows, inner boxes hold boxes; the last box is the root."""

    def __init__(self, x: np.ndarray):
        spread = np.argsort(-np.ptp(x.astype(float), axis=0), kind="stable") if len(x) else np.zeros(0, int)
        leaves = list(tiled(x, np.arange(len(x)), LEAF, list(spread[:3]))) if x.shape[1] else [np.arange(len(x))]
        #: Rows in leaf order, and where each leaf lies in it.
        self.order = np.concatenate(leaves)
        ends = np.cumsum([len(r) for r in leaves]).tolist()
        self.leaves = list(zip([0, *ends], ends, strict=False))
        self.blocks = [x[r] for r in leaves]
        low, high = [b.min(axis=0) for b in self.blocks], [b.max(axis=0) for b in self.blocks]
        self.children: list[range] = [range(0)] * len(leaves)
        level = range(len(leaves))
        while len(level) > 1:
            made = len(low)
            for at in range(level.start, level.stop, FAN):
                inner = range(at, min(at + FAN, level.stop))
                low.append(np.min(low[inner.start : inner.stop], axis=0))
                high.append(np.max(high[inner.start : inner.stop], axis=0))
                self.children.append(inner)
            level = range(made, len(low))
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with anything in each box: (anchor, box)."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


def search(tree: Tree, bounds: tuple[np.ndarray, np.ndarray], q: np.ndarray, ids: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each score window the first k allowed rows, as (-score, id) in order, by one best-first queue.

    ``ids`` and ``allowed`` follow ``tree.order``.
    """
    least, most = bounds
    best: list[list[tuple[int, int]]] = [[] for _ in windows]
    # lowest score that still matters to a window: its lower end, later its kth best
    floor = [lo for lo, _ in windows]
    lows, highs = np.array(floor)[:, None], np.array([hi for _, hi in windows])[:, None]
    meets = ((most >= lows) & (least <= highs)).any(axis=0).tolist()
    top, lowest = max(hi for _, hi in windows), min(floor)
    queue = [(-most[-1], len(most) - 1)] if meets[-1] else []
    while queue:
        bound, box = heapq.heappop(queue)
        if -bound < lowest:
            break
        if tree.children[box]:
            for child in tree.children[box]:
                if meets[child] and most[child] >= lowest:
                    heapq.heappush(queue, (-most[child], child))
            continue
        start, end = tree.leaves[box]
        score = tree.blocks[box] @ q
        hits = np.flatnonzero((score >= lowest) & (score <= top) & allowed[start:end])
        if len(hits) > 4 * k and score.dtype != object:
            # many rows alike: a window needs no more than its first k of them
            inner = [hits[(score[hits] >= f) & (score[hits] <= hi)] for f, (_, hi) in zip(floor, windows, strict=True)]
            hits = np.unique(np.concatenate([r[np.lexsort((ids[start + r], -score[r]))[:k]] for r in inner]))
        for i in hits.tolist():
            value, row = int(score[i]), int(ids[start + i])
            for w, (_, hi) in enumerate(windows):
                if floor[w] <= value <= hi:
                    insort(best[w], (-value, row))
                    if len(best[w]) > k:
                        best[w].pop()
                    if len(best[w]) == k:
                        floor[w] = max(floor[w], -best[w][-1][0])
        if len(hits):
            lowest = min(floor)
    return best


def parsed(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q): labels moved where the id is divisible by 7, components floor(256 x) as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
            sizes = np.diff(column.offsets.to_numpy())
            q = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), q], names=["vec_id", "label", "q"])

    vector = F.col("embedding").cast("array<double>")
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * 256 < float("inf")))
    used = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector")).filter("vec_id is not null and label is not null and vector is not null")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = used.filter(fit).select("vec_id", moved.alias("label"), "vector").mapInArrow(run, "vec_id long, label long, q binary")
    return out.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def spread_axes(rows: DataFrame) -> list[int]:
    """The two coordinates of greatest variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            if x.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0)), pa.array(np.full(x.shape[1], float(len(x))))], names=["axis", "s", "ss", "n"])

    sums = rows.select("q").mapInArrow(run, "axis long, s double, ss double, n double").groupBy("axis").agg(*[F.sum(c).alias(c) for c in ("s", "ss", "n")])
    variance = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    return [r["axis"] for r in sums.orderBy(variance.desc_nulls_last(), "axis").limit(2).collect()]


def sharded(rows: DataFrame, size: int = SHARD) -> tuple[DataFrame, int]:
    """Rows with a shard number from 0, and how many shards there are."""
    axes = spread_axes(rows)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2))
            at = [x[:, a] if a < x.shape[1] else np.zeros(len(b)) for a in [*axes, 0, 0][:2]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[0]), pa.array(at[1])], names=["vec_id", "label", "q", "u", "v"])

    placed = cut_lineage(rows.mapInArrow(coordinates, "vec_id long, label long, q binary, u double, v double"))
    tiles = max(1, -(-placed.count() // size))
    slabs = int(np.ceil(tiles**0.5))
    each = -(-tiles // slabs)
    steps = lambda n: [i / n for i in range(1, n)]
    first = placed.approxQuantile("u", steps(slabs), 0.25 / slabs) if slabs > 1 else []
    slab = F.size(F.filter(F.lit(first).cast("array<double>"), lambda c: c <= F.col("u"))) if first else F.lit(0)
    cuts = {}
    if each > 1:
        marks = placed.withColumn("slab", slab).groupBy("slab").agg(F.percentile_approx("v", steps(each), 100 * each).alias("cuts"))
        cuts = {r["slab"]: np.array(r["cuts"]) for r in marks.collect()}
    inner = np.array(first)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = b.column(3).to_numpy(), b.column(4).to_numpy()
            s = np.searchsorted(inner, u, side="right")
            t = np.zeros(len(b), np.int64)
            for one in np.unique(s):
                t[s == one] = one * each + np.searchsorted(cuts.get(int(one), inner[:0]), v[s == one], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(t)], names=["vec_id", "label", "q", "tile"])

    dealt = placed.mapInArrow(tile, "vec_id long, label long, q binary, tile long")
    counts = {r["tile"]: r["n"] for r in dealt.groupBy("tile").agg(F.count("*").alias("n")).collect()}
    parts = np.zeros(slabs * each, np.int64)
    for t, n in counts.items():
        parts[t] = -(-n // (2 * size))  # a tile may be somewhat over its size
    before = np.cumsum(parts) - parts

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(3).to_numpy()
            shard = before[t] + b.column(4).to_numpy() % parts[t]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(shard)], names=["vec_id", "label", "q", "shard"])

    hashed = dealt.withColumn("h", F.xxhash64("vec_id").bitwiseAND((1 << 62) - 1))
    return cut_lineage(hashed.mapInArrow(number, "vec_id long, label long, q binary, shard long")), int(parts.sum())


def meet(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, run, schema: str) -> DataFrame:
    """Every block of anchors with every shard, one group each."""
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
    right = dealt.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("tree", "part")).applyInArrow(run, schema)


def clipped(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def opened(left: pa.Table, right: pa.Table) -> tuple[Tree, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    x, q = comparable(matrix(left["q"]), matrix(right["point"]))
    tree = Tree(x)
    return tree, tree.bounds(q), q, left["vec_id"].to_numpy()[tree.order], left["label"].to_numpy()[tree.order]


def positives(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the first k other rows of an anchor's label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            tree, (least, most), q, ids, labels = opened(left, right)
            anchor, own = right["anchor_id"].to_numpy(), right["own"].to_numpy()
            for i, a in enumerate(anchor):
                allowed = (labels == own[i]) & (ids != a)
                if allowed.any():
                    (best,) = search(tree, (least[i], most[i]), q[i], ids, allowed, [(-np.inf, np.inf)], k)
                    found += [(int(a), row, clipped(-score)) for score, row in best]
        return pa.table({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(("anchor_id", "positive_id", "positive_score"))})

    met = meet(rows, anchors, shards, blocks, run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def negatives(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, rank, negative_id, negative_score) for anchors with ``given`` positives."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            tree, (least, most), q, ids, labels = opened(left, right)
            anchor, own, given = right["anchor_id"].to_numpy(), right["own"].to_numpy(), right["given"].to_pylist()
            for i, a in enumerate(anchor):
                # low p <= 100 n <= high p in whole numbers
                windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in given[i]]
                for p, best in zip(given[i], search(tree, (least[i], most[i]), q[i], ids, labels != own[i], windows, k), strict=True):
                    found += [(int(a), p["positive_id"], p["positive_score"], row, clipped(-score)) for score, row in best]
        return pa.table({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))})

    met = meet(rows, anchors, shards, blocks, run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of every anchor (id divisible by ``every``) and positive: rows of another label that score ``low`` to ``high`` hundredths of the positive."""
    rows, shards = sharded(parsed(embeddings))
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("q").alias("point"))
    blocks = max(1, -(-anchors.count() // ANCHORS))
    shards = max(1, shards)
    near = cut_lineage(positives(rows, anchors, shards, blocks, n_positives))
    given = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("given"))
    out = negatives(rows, anchors.join(given, "anchor_id"), shards, blocks, n_negatives, low, high)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
 from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id anchor_id, a.label own, b.vec_id id, b.label other, cast(list_inner_product(a.q, b.q) as bigint) score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id positive_id, score positive_score from s where own = other qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.*, id negative_id, score negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as "rank"
 from p join s on s.anchor_id = p.anchor_id and own <> other and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast("rank" as int) as "rank", negative_id, positive_score, negative_score from n where "rank" <= 3"""
