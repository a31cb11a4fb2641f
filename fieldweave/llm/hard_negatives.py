"""Hard-negative mining by dual-tree search over whole-number vectors.

Every entry x becomes floor(``scale`` * x); scores are inner products of such
vectors, so they are exact. Equal rows are searched once: anchors that share vector
and label are one point, and of the rows that share a vector only those stay
that can be among an anchor's first k, which are the k + 1 smallest ids of each label.

A tree over the rows halves a bounded sample (``sample_rows``, by hash) at the
median of the widest coordinate, level by level, to at most ``MOST_REGIONS``
regions. All rows are dealt to its regions, and a region of many rows to several
slices of about ``slice_rows``. Each node of the tree has a ball (a centre, and the largest
distance of its rows from it), so inner products between a ball of anchors and a
ball of rows lie in an interval. Anchors stand in blocks by an upper level of the same tree.

A block walks its own tree of anchors against the tree of regions; a pair of nodes is
dropped, and with it the whole group of anchors, if its interval cannot hold a
score that some anchor of the group still needs. Slices of the regions that are left
meet the block in one task, which walks the same way down to the leaves and scores pairs of leaves
exactly. Positives are looked for in the anchors' own regions first, which gives
each anchor a least score for the search of the rest; negatives need scores between
``low`` and ``high`` of a positive's. A task passes on at most k + 1 positives of an anchor and k negatives
of each of its positive scores, and only so many of each are kept between tasks. The tree decides what
is pruned and never what is found: the result is that of scoring everything.

Rows take part if id, label and vector are not null, the vector has the length that most have,
and its entries are finite and of a magnitude below 2**18 (larger ones could overflow a score).
Rows are told apart by their place in the staged table, so repeated rows are rows of their own: a copy
of an anchor is another row, and each copy of an anchor has its own results. Ties go to the smaller id,
then to the earlier row. An anchor without other rows of its label, or without a negative in
bounds, gives no rows; so do empty tables. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldweave.llm.common import lookup, scratch, stage
from fieldweave.llm.whitening import usual_length, whole

LARGEST, MOST_REGIONS, LEAF = 2.0**18, 4096, 32
#: What rounding may take from a bound, as a part of the norms it is made of.
SLACK = 1e-9


# --- trees ---------------------------------------------------------------------
class Ball:
    """A tree over the rows of a matrix; a node is a stretch of ``order`` with a centre and a radius."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(x))
        self.bounds, self.children, centres, radii = [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            lo, hi, up = todo.pop()
            mine = x[self.order[lo:hi]]
            centre = mine.mean(0)
            centres.append(centre)
            radii.append(math.sqrt(float(((mine - centre) ** 2).sum(1).max())))
            self.bounds.append((lo, hi))
            self.children.append([])
            if up >= 0:
                self.children[up].append(len(self.bounds) - 1)
            if hi - lo > leaf and radii[-1] > 0:
                axis, mid = int(np.ptp(mine, 0).argmax()), (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(mine[:, axis], mid)]
                todo += [(lo, lo + mid, len(self.bounds) - 1), (lo + mid, hi, len(self.bounds) - 1)]
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.norm = np.sqrt((self.centre**2).sum(1))


def intervals(one: Ball, a: int, two: Ball, b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between node ``a`` of one tree and each of the nodes ``b`` of another."""
    middle = two.centre[b] @ one.centre[a]
    reach = one.radius[a] * two.norm[b] + two.radius[b] * one.norm[a] + one.radius[a] * two.radius[b]
    reach = reach + SLACK * (1 + one.norm[a] * two.norm[b] + reach)
    return middle - reach, middle + reach


def walk(anchors: Ball, rows: Ball, floor: np.ndarray, ceiling: np.ndarray, at_leaves) -> None:
    """Visit the pairs of leaves whose interval may hold a score that an anchor needs, the highest bound first.

    ``floor`` and ``ceiling`` are, for each anchor in tree order, the least and the greatest score it needs;
    ``at_leaves(a, b)`` may raise floors.
    """

    def needed(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        lo, hi = anchors.bounds[a]
        return (high >= floor[lo:hi].min()) & (low <= ceiling[lo:hi].max())

    low, high = intervals(anchors, 0, rows, [0])
    heap = [(-float(high[0]), 0, 0, float(low[0]))]
    while heap:
        best, a, b, least = heapq.heappop(heap)
        lo, hi = anchors.bounds[a]
        if -best < floor[lo:hi].min() or least > ceiling[lo:hi].max():
            continue
        mine, theirs = anchors.children[a], rows.children[b]
        if not mine and not theirs:
            at_leaves(a, b)
            continue
        if theirs and (not mine or rows.radius[b] >= anchors.radius[a]):
            pairs = [(a, theirs)]
        else:
            pairs = [(x, [b]) for x in mine]
        for x, ys in pairs:
            low, high = intervals(anchors, x, rows, ys)
            for y, l, h, on in zip(ys, low.tolist(), high.tolist(), needed(x, low, high).tolist(), strict=True):
                if on:
                    heapq.heappush(heap, (-h, x, y, l))


class Regions:
    """A complete binary tree of median splits; leaf i of depth d is node 2**d + i."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.cut = np.zeros(2**depth, np.int64), np.zeros(2**depth)
        of = np.ones(len(sample), np.int64)
        for level in range(depth):
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(2**level, 2 ** (level + 1) + 1))
            for k in range(2**level):
                mine = sample[order[edges[k] : edges[k + 1]]]
                if len(mine):
                    node = 2**level + k
                    self.axis[node] = np.ptp(mine, 0).argmax()
                    self.cut[node] = np.median(mine[:, self.axis[node]])
            of = self._down(sample, of)
        self.centre = np.zeros((2**depth, sample.shape[1]))
        for region in np.unique(of):
            self.centre[region - 2**depth] = sample[of == region].mean(0)

    def _down(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return 2 * of + (x[np.arange(len(x)), self.axis[of]] > self.cut[of])

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The region of each row and its distance from that region's centre."""
        at = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            at = self._down(x, at)
        at -= 2**self.depth
        return at, np.sqrt(((x - self.centre[at]) ** 2).sum(1))

    def balls(self, rows: dict[int, tuple[int, float]]) -> Ball:
        """The tree over the regions that have rows, as balls; ``rows`` has their number and radius."""
        size = 2**self.depth
        count, radius = np.zeros(2 * size), np.zeros(2 * size)
        centre = np.zeros((2 * size, self.centre.shape[1]))
        for region, (n, r) in rows.items():
            count[size + region], radius[size + region], centre[size + region] = n, r, self.centre[region]
        for node in range(size - 1, 0, -1):
            kids = [k for k in (2 * node, 2 * node + 1) if count[k]]
            if kids:
                count[node] = count[kids].sum()
                centre[node] = (centre[kids] * count[kids, None]).sum(0) / count[node]
                radius[node] = max(radius[k] + math.sqrt(((centre[k] - centre[node]) ** 2).sum()) for k in kids)
        out = Ball.__new__(Ball)
        real = [node for node in range(1, 2 * size) if count[node]]
        place = {node: i for i, node in enumerate(real)}
        out.children = [[place[k] for k in (2 * node, 2 * node + 1) if k in place] for node in real]
        out.centre, out.radius = centre[real], radius[real] * (1 + SLACK)
        out.norm = np.sqrt((out.centre**2).sum(1))
        out.region = [node - size for node in real]
        return out


# --- what tasks do --------------------------------------------------------------
def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class Scores:
    """Exact inner products of rows of two matrices of whole numbers."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        most = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1]
        kind = np.float64 if most < 2**53 else np.int64
        self.x, self.y = x.astype(kind), y.astype(kind)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.x[i] @ self.y[j].T


def first_positives(anchors: pa.Table, rows: pa.Table, k: int) -> dict:
    """The best k rows of its label for each anchor point, as (pid, score, vec_id, rid)."""
    x, y = matrix(anchors.column("v")), matrix(rows.column("v"))
    one, two, scores = Ball(x), Ball(y), Scores(x, y)
    mine, theirs = anchors.column("label").to_numpy()[one.order], rows.column("label").to_numpy()[two.order]
    ids, rids = rows.column("vec_id").to_numpy()[two.order], rows.column("rid").to_numpy()[two.order]
    floor = anchors.column("least").to_numpy().astype(np.float64)[one.order]
    ceiling = np.full(len(x), np.inf)
    best: list[list[tuple[int, int, int]]] = [[] for _ in range(len(x))]

    def at_leaves(a: int, b: int) -> None:
        (lo, hi), (lo2, hi2) = one.bounds[a], two.bounds[b]
        s = scores.of(one.order[lo:hi], two.order[lo2:hi2])
        hits = (mine[lo:hi, None] == theirs[None, lo2:hi2]) & (s >= floor[lo:hi, None])
        for i, j in np.argwhere(hits).tolist():
            score = int(s[i, j])
            if score >= floor[lo + i]:
                top = best[lo + i]
                insort(top, (-score, int(ids[lo2 + j]), int(rids[lo2 + j])))
                if len(top) >= k:
                    del top[k:]
                    floor[lo + i] = max(floor[lo + i], -top[-1][0])

    walk(one, two, floor, ceiling, at_leaves)
    pids = anchors.column("pid").to_pylist()
    found = [(pids[one.order[i]], -s, v, r) for i, top in enumerate(best) for s, v, r in top]
    return {c: [f[i] for f in found] for i, c in enumerate(("pid", "score", "vec_id", "rid"))}


def first_negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int, whole_: int) -> dict:
    """The best k rows of other labels in the bounds of each positive score, as (pid, goal, score, vec_id, rid)."""
    x, y = matrix(anchors.column("v")), matrix(rows.column("v"))
    one, two, scores = Ball(x), Ball(y), Scores(x, y)
    mine, theirs = anchors.column("label").to_numpy()[one.order], rows.column("label").to_numpy()[two.order]
    ids, rids = rows.column("vec_id").to_numpy()[two.order], rows.column("rid").to_numpy()[two.order]
    goals_of = anchors.column("goals").to_pylist()
    # for each anchor and score: [least score needed, greatest, found]
    needs = [[[-(-low * g // whole_), high * g // whole_, [], g] for g in goals_of[i] if -(-low * g // whole_) <= high * g // whole_] for i in one.order.tolist()]
    floor = np.array([min((n[0] for n in need), default=np.inf) for need in needs], np.float64)
    ceiling = np.array([max((n[1] for n in need), default=-np.inf) for need in needs], np.float64)

    def at_leaves(a: int, b: int) -> None:
        (lo, hi), (lo2, hi2) = one.bounds[a], two.bounds[b]
        s = scores.of(one.order[lo:hi], two.order[lo2:hi2])
        hits = (mine[lo:hi, None] != theirs[None, lo2:hi2]) & (s >= floor[lo:hi, None]) & (s <= ceiling[lo:hi, None])
        for i, j in np.argwhere(hits).tolist():
            score, entry = int(s[i, j]), None
            for need in needs[lo + i]:
                if need[0] <= score <= need[1]:
                    entry = entry or (-score, int(ids[lo2 + j]), int(rids[lo2 + j]))
                    insort(need[2], entry)
                    if len(need[2]) >= k:
                        del need[2][k:]
                        need[0] = max(need[0], -need[2][-1][0])
            if entry:
                floor[lo + i] = min(need[0] for need in needs[lo + i])

    walk(one, two, floor, ceiling, at_leaves)
    pids = anchors.column("pid").to_pylist()
    found = [(pids[one.order[i]], n[3], -s, v, r) for i, need in enumerate(needs) for n in need for s, v, r in n[2]]
    return {c: [f[i] for f in found] for i, c in enumerate(("pid", "goal", "score", "vec_id", "rid"))}


# --- the search -------------------------------------------------------------------
class Index:
    """Rows in the slices of a tree's regions, and anchor points in blocks of an upper level."""

    def __init__(self, rows: DataFrame, dim: int, *, slice_rows: int, block_rows: int, sample_rows: int) -> None:
        self.spark, self.block_rows = rows.sparkSession, block_rows
        total = rows.count()
        share = min(1.0, 1.25 * sample_rows / max(1, total))
        few = rows.where(F.pmod(F.xxhash64("rid"), F.lit(2**31)) < math.ceil(share * 2**31)).select("v").limit(sample_rows)
        sample = matrix(few.toArrow().column("v")) if total else np.zeros((0, dim))
        depth = min(int(math.log2(MOST_REGIONS)), max(0, math.ceil(math.log2(max(1, total / slice_rows)))))
        self.tree = Regions(sample, depth)
        self.upper = max(0, depth - 5)  # blocks of anchors stand for 32 regions
        self.rows = self.placed(rows, "rows")
        told = self.rows.groupBy("region").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()  # at most MOST_REGIONS rows
        self.balls = self.tree.balls({r["region"]: (r["n"], r["away"]) for r in told})
        slices = [(r["region"], math.ceil(r["n"] / slice_rows)) for r in told]
        self.slices = F.broadcast(self.spark.createDataFrame(slices, "region long, parts long"))  # as many
        self.rows = self.rows.join(self.slices, "region").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")

    def placed(self, rows: DataFrame, label: str) -> DataFrame:
        """``rows`` with ``region`` and ``away``, written."""
        tree, place = self.spark.sparkContext.broadcast(self.tree), rows.columns.index("v")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    region, away = tree.value.of(matrix(pa.chunked_array([batch.column(place)])))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(away)], names=[*batch.schema.names, "region", "away"])

        kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
        return stage(rows.mapInArrow(work, f"{kinds}, region long, away double"), label)

    def blocks(self, points: DataFrame) -> DataFrame:
        """Anchor points in blocks: of a node of the upper level, in parts of about ``block_rows``."""
        wide = points.withColumn("node", F.shiftright("region", self.tree.depth - self.upper).cast("long"))
        sizes = wide.groupBy("node").agg(F.count("*").alias("n")).collect()  # at most MOST_REGIONS / 32 rows
        parts = self.spark.createDataFrame([(r["node"], math.ceil(r["n"] / self.block_rows)) for r in sizes], "node long, parts long")
        return wide.join(F.broadcast(parts), "node").withColumn("block", F.xxhash64("node", F.pmod(F.xxhash64("pid"), F.col("parts")))).drop("parts")

    def visits(self, blocks: DataFrame, floor: Column, ceiling: Column) -> DataFrame:
        """(block, region): the regions that may hold a score between an anchor's floor and ceiling."""
        held = self.spark.sparkContext.broadcast(self.balls)

        def work(table: pa.Table) -> pa.Table:
            regions, tree = held.value, Ball(matrix(table.column("v")))
            floor, ceiling = (table.column(c).to_numpy()[tree.order] for c in ("floor", "ceiling"))
            found: set[int] = set()
            walk(tree, regions, floor, ceiling, lambda a, b: found.add(regions.region[b]))
            return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(found), pa.int64()), "region": pa.array(sorted(found), pa.int64())})

        asked = blocks.select("block", "v", floor.cast("double").alias("floor"), ceiling.cast("double").alias("ceiling"))
        return asked.groupBy("block").applyInArrow(work, "block long, region long")

    def meet(self, blocks: DataFrame, visits: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
        """``work(anchors, rows)`` of each block and slice that meet."""
        pairs = visits.join(self.slices, "region").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        pairs = stage(pairs.select("block", "region", "part", F.xxhash64("block", "region", "part").alias("task")), "pairs")
        came = blocks.join(pairs.select("block", "task"), "block").select("task", *columns)
        held = self.rows.join(pairs.select("region", "part", "task"), ["region", "part"]).select(F.col("task").alias("job"), "vec_id", "rid", "label", "v")

        def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
            if not anchors.num_rows or not rows.num_rows:
                return empty
            return pa.table(work(anchors, rows), schema=empty.schema)

        empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
        return came.groupBy("task").cogroup(held.groupBy("job")).applyInArrow(run, schema)


def top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key; tasks pass on no more than that."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).drop("_at")


def mine(
    rows: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchor: Column | None = None,
    k: int = 5,
    low: int = 80,
    high: int = 100,
    of: int = 100,
    scale: int = 256,
    slice_rows: int = 1024,
    block_rows: int = 1024,
    sample_rows: int = 65_536,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says which rows are anchors (ids divisible by 100). A negative's score is
    at least ``low`` and at most ``high`` ``of``-ths of its positive's.
    """
    spark = rows.sparkSession
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with scratch(spark) as kept:
        usable = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where(
            F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole(F.col("v"), LARGEST)
        )
        dim = usual_length(usable, "v")
        if dim is None:
            return spark.createDataFrame([], result)
        exact = usable.where(F.size("v") == dim).select("vec_id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
        all_rows = stage(exact.withColumn("rid", F.monotonically_increasing_id()), "rows")
        # of equal vectors, the k + 1 smallest ids of each label
        same = Window.partitionBy("v", "label").orderBy("vec_id", "rid")
        few = stage(all_rows.withColumn("_at", F.row_number().over(same)).where(F.col("_at") <= k + 1).drop("_at"), "few")
        index = Index(few, dim, slice_rows=slice_rows, block_rows=block_rows, sample_rows=sample_rows)
        pid = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ",")), 256)
        anchors = stage(all_rows.where(anchor).select("vec_id", "rid", "label", "v", pid.alias("pid")), "anchors")
        points = anchors.groupBy("pid").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"))
        points = index.placed(stage(points, "points"), "placed")
        blocks = index.blocks(points)
        columns, never = ["pid", "label", "v"], float("inf")
        # positives: the anchors' own regions, then what those leave possible
        schema = "pid string, score long, vec_id long, rid long"
        near = index.meet(blocks.withColumn("least", F.lit(-never)), blocks.select("block", "region").distinct(), [*columns, "least"], lambda a, r: first_positives(a, r, k + 1), schema)
        near = stage(top(near, ["pid"], k + 1), "near")
        full = near.groupBy("pid").agg(F.count("*").alias("found"), F.min("score").alias("edge")).where(F.col("found") > k)
        bound = stage(blocks.join(full.select("pid", F.col("edge").cast("double").alias("edge")), "pid", "left").withColumn("least", F.coalesce("edge", F.lit(-never))), "bound")
        rest = index.visits(bound, F.col("least"), F.lit(never)).join(blocks.select("block", "region").distinct(), ["block", "region"], "left_anti")
        far = index.meet(bound, rest, [*columns, "least"], lambda a, r: first_positives(a, r, k + 1), schema)
        best = stage(top(near.unionByName(far), ["pid"], k + 1), "positives")
        # negatives in the bounds of each positive's score
        goals = best.where(F.col("score") >= 0).groupBy("pid").agg(F.sort_array(F.collect_set("score")).alias("goals"))
        aims = stage(blocks.join(goals, "pid"), "aims")
        least = F.floor(F.element_at("goals", 1) * F.lit(low) / F.lit(of)) - 1
        most = F.ceil(F.element_at("goals", -1) * F.lit(high) / F.lit(of)) + 1
        negatives = index.meet(
            aims, index.visits(aims, least, most), [*columns, "goals"], lambda a, r: first_negatives(a, r, k, low, high, of), "pid string, goal long, score long, vec_id long, rid long"
        )
        negatives = stage(top(negatives, ["pid", "goal"], k), "negatives")
        # what each point found, of bounded size, then each anchor's share of it
        ranked = F.struct((-F.col("score")).alias("far"), "vec_id", "rid")
        told = negatives.groupBy("pid", F.col("goal").alias("score")).agg(F.sort_array(F.collect_list(ranked)).alias("negatives"))
        each = best.join(told, ["pid", "score"], "left").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct(*ranked_fields(), "negatives"))).alias("positives"))
        facts = stage(points.select("pid", "n").join(each, "pid"), "facts")
        other = F.slice(F.filter("positives", lambda p: p["rid"] != F.col("rid")), 1, k)
        mined = lookup(anchors.select("vec_id", "rid", "pid"), facts, "pid").select(F.col("vec_id").alias("anchor_id"), F.explode(other).alias("p"))
        mined = mined.select("anchor_id", "p", F.posexplode("p.negatives").alias("at", "q"))
        out = mined.select(
            "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("q.vec_id").alias("negative_id"),
            (-F.col("p.far")).alias("positive_score"), (-F.col("q.far")).alias("negative_score"),
        )
        out = stage(out, "mined")
        kept.append(out)
    return out


def ranked_fields() -> list[Column]:
    return [(-F.col("score")).alias("far"), F.col("vec_id"), F.col("rid")]
