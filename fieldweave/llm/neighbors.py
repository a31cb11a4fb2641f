"""Approximate nearest neighbours by multiprobe p-stable hashing.

Equal vectors are one point, so copies cost nothing: a point keeps the ids of the ``k`` + 1
rows of smallest id, which is all that a list of k nearest can hold of them. Points are scaled to length one, where
Euclidean distance orders as cosine does. Each of ``tables`` tables hashes a
point by ``hashes`` Gaussian (2-stable) projections cut into slots of ``width``.
A query visits, in each table, its own bucket and perturbed buckets in the order
of estimated success: the perturbation sets of least total squared distance
to the slot edges crossed. The more points there are, the more hashes a bucket
has (half the logarithm of their number) and the more buckets are visited (about
the 0.44th power of it), so the share of points that a query meets falls as the
table grows. Buckets are dealt to regions of about ``chunk`` points, and a region
of more, such as a popular bucket, to several chunks, so no task holds a
popular bucket whole; a query comes once to a chunk with all its buckets there.
Each chunk ranks the points of a query's buckets by exact cosine in double
precision and passes on k for each query; the candidates of all chunks and
tables then merge. A query whose buckets hold fewer than k ids is ranked anew
against all points, in chunks of the same size, so it gets k rows, or every
candidate if there are fewer.

The chunks of a table hold every row, and queries are exact within what they
visit. Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. Ties go to the smaller id. Rows that repeat
an id are rows of their own, with the same vector or another, and a query leaves out one row only, its
own; so it may list its own id. Rows that repeat both id and vector are one query. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldweave.llm.common import lookup, per_row, runs, scratch, stage


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def projections(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables * hashes, dim)), rng.uniform(0, width, tables * hashes)


def perturbations(edges: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The ``probes`` sets of (hash, step) of least total squared edge distance, the empty set first.

    ``edges`` holds, for each hash, the distances to the lower and upper slot edge.
    A heap walks the sets by shifting or extending their last element; sets
    that move one hash both ways are passed over.
    """
    flat = [(float(d) ** 2, i, step) for i, pair in enumerate(edges) for d, step in zip(pair, (-1, 1), strict=True)]
    flat.sort()
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(flat[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({flat[i][1] for i in chosen}) == len(chosen):
            out.append([(flat[i][1], flat[i][2]) for i in chosen])
        if last + 1 < len(flat):
            heapq.heappush(heap, (cost - flat[last][0] + flat[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + flat[last + 1][0], (*chosen, last + 1)))
    return out


def _keys(slots: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of slot numbers."""
    with np.errstate(over="ignore"):
        key = np.full(len(slots), 0x9E3779B9, np.uint64)
        for column in slots.T:
            key = (key ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Chunk:
    """Points of a region, by bucket."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int) -> None:
        table = pa.Table.from_batches(batches)
        buckets = table.column(1).to_pylist()
        self.known = buckets[0] is not None
        order = np.argsort(np.array(buckets if self.known else [0] * len(buckets), np.int64), kind="stable")
        self.buckets = np.array(buckets, np.int64)[order] if self.known else None
        self.x = np.array(table.column(2).to_pylist(), np.float64).reshape(-1, dim)[order]
        self.norm = np.sqrt((self.x * self.x).sum(1))
        ids, pids = table.column(3).to_pylist(), table.column(6).to_pylist()
        self.ids, self.pids = [ids[i] for i in order.tolist()], [pids[i] for i in order.tolist()]

    def places(self, buckets: list[int] | None) -> np.ndarray:
        """Places of the points of these buckets; of all points for None."""
        if buckets is None:
            return np.arange(len(self.x))
        wanted = np.array(buckets, np.int64)
        lo, hi = np.searchsorted(self.buckets, wanted), np.searchsorted(self.buckets, wanted, side="right")
        return np.concatenate([np.arange(i, j) for i, j in zip(lo.tolist(), hi.tolist(), strict=True) if j > i] or [np.empty(0, np.int64)])

    def nearest(self, x: np.ndarray, own, buckets: list[int] | None, k: int) -> list[tuple[float, object, int, int]]:
        """(-cosine, id, point, place of the row in it) of the k nearest rows in these buckets, without the query's own row."""
        at, most = self.places(buckets), k + 1
        rough = (self.x[at] @ x) / self.norm[at] if len(at) else np.empty(0)  # in the order of cosine
        if len(at) > most:
            edge = np.partition(rough, -most)[-most]
            at = at[rough >= edge - 1e-9 * np.sqrt(x @ x)]
        cosine = (self.x[at] * x).sum(1) / (self.norm[at] * np.sqrt((x * x).sum()))
        rows = []
        for c, j in zip(cosine.tolist(), at.tolist(), strict=True):
            mine = self.ids[j].index(own) if own in self.ids[j] and np.array_equal(self.x[j], x) else None
            rows += [(-c, v, self.pids[j], i) for i, v in enumerate(self.ids[j]) if i != mine]
        return heapq.nsmallest(k, rows)


def sizes_for(points: int) -> tuple[int, int]:
    """(hashes, probes) for so many points: recall of 0.95 on isotropic vectors of 64 components, the hardest case, more on clustered ones."""
    hashes = max(4, round(math.log2(max(2, points)) / 2 + 1.2))
    return hashes, max(48, round(36 * 1.85 ** (hashes - 6)))


def search(
    rows: DataFrame,
    queries: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    tables: int = 8,
    hashes: int | None = None,
    width: float = 2.0,
    probes: int | None = None,
    chunk: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of each row of ``queries`` among ``rows``.

    ``hashes`` and ``probes`` follow from the number of points unless they are given.
    """
    some = rows.where(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()  # a row a length
    if some is None:
        return rows.select(F.col(key).alias("query_id"), F.lit(0).alias("rank"), F.col(key), F.lit(0.0).alias("score")).limit(0)
    dim = some["d"]

    def prepared(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(usable(F.col("v")) & (F.size("v") == dim))

    with scratch(rows.sparkSession) as kept:
        # copies: the k + 1 smallest ids of each vector; tasks pass on no more than that
        of_vector = Window.partitionBy("v").orderBy("id")
        few = prepared(rows).withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= k + 1)
        points = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        points = stage(points.withColumn("pid", F.xxhash64("v")), "points")
        total = points.count()
        hashes, probes = hashes or sizes_for(total)[0], probes or sizes_for(total)[1]
        a, b = projections(dim, tables, hashes, width, seed)
        regions = max(1, math.ceil(1.25 * total / chunk))  # most then hold fewer than ``chunk``

        def hash_points():
            def work(batch: pa.RecordBatch) -> dict:
                x = _unit(batch.column(1), dim)
                slots = np.floor((x @ a.T + b) / width).reshape(len(x), tables, hashes)
                keys = np.concatenate([_keys(slots[:, t]) for t in range(tables)])
                cells = np.repeat(np.arange(tables), len(x)) * regions + keys % regions
                return {"cell": cells, "bucket": keys, "pid": np.tile(batch.column(0).to_numpy(), tables)}

            return work

        def hash_queries():
            def work(batch: pa.RecordBatch) -> dict:
                x = _unit(batch.column(1), dim)
                reach = x @ a.T + b
                slots = np.floor(reach / width)
                low = reach - slots * width
                edges = np.stack([low, width - low], axis=2)
                out = {"cell": [], "buckets": [], "qid": []}
                for i, q in enumerate(batch.column(0).to_pylist()):
                    for t in range(tables):
                        part = slice(t * hashes, (t + 1) * hashes)
                        sets = perturbations(edges[i, part], probes)
                        visited = np.tile(slots[i, part], (len(sets), 1))
                        for row, moves in enumerate(sets):
                            for at, step in moves:
                                visited[row, at] += step
                        keys = _keys(visited)
                        of = keys % regions
                        order = np.argsort(of, kind="stable")
                        for lo, hi in runs(of[order]):
                            out["cell"].append(t * regions + int(of[order[lo]]))
                            out["buckets"].append(keys[order[lo:hi]])
                            out["qid"].append(q)
                return out

            return work

        count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = stage(per_row(points, ["pid", "v"], "cell long, bucket long, pid long", hash_points), "placed")
        chunks = stage(placed.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / chunk).alias("chunks")), "chunks")
        group = F.xxhash64("cell", "part").alias("group")
        cut = lookup(placed, chunks, "cell").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("chunks")))
        nobody = [F.lit(None).cast("long").alias("qid"), F.lit(None).cast("array<bigint>").alias("buckets")]
        held = cut.join(points.select("pid", "v", "ids"), "pid").select(group, "bucket", "v", "ids", *nobody, "pid")
        asked = stage(prepared(queries).dropDuplicates(["id", "v"]).withColumn("qid", F.xxhash64("id", "v")), "queries")
        visits = per_row(asked.repartition(count, "qid"), ["qid", "v"], "cell long, buckets array<long>, qid long", hash_queries).join(chunks.drop("n"), "cell")
        visits = visits.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"), "qid", "buckets")
        anywhere = F.lit(None).cast("long").alias("bucket")
        came = visits.join(asked, "qid").select(group, anywhere, "v", F.array("id").alias("ids"), "qid", "buckets", nobody[0].alias("pid"))

        id_kind = rows.schema[key].dataType.simpleString()

        def rank(batches):
            current, held, ready = None, [], None
            for batch in batches:
                groups, asks = batch.column(0).to_numpy(), ~np.asarray(batch.column(4).is_null())
                out = {"qid": [], "query_id": [], "found": [], "score": [], "pid": [], "row": []}
                for lo, hi in runs(groups):
                    if groups[lo] != current:
                        current, held, ready = groups[lo], [], None
                    split = lo + int(np.searchsorted(asks[lo:hi], True))
                    if split > lo:
                        held.append(batch.slice(lo, split - lo))
                    if split < hi and held:
                        ready = ready or Chunk(held, dim)
                        come = batch.slice(split, hi - split)
                        vectors = np.array(come.column(2).to_pylist(), np.float64).reshape(-1, dim)
                        for x, ids, q, buckets in zip(vectors, come.column(3).to_pylist(), come.column(4).to_pylist(), come.column(5).to_pylist(), strict=True):
                            for far, v, pid, row in ready.nearest(x, ids[0], buckets, k):
                                for name, value in (("qid", q), ("query_id", ids[0]), ("found", v), ("score", -far), ("pid", pid), ("row", row)):
                                    out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=result)

        ddl = f"qid long, query_id {id_kind}, found {id_kind}, score double, pid long, row int"
        result = to_arrow_schema(StructType.fromDDL(ddl))

        def nearest_of(held: DataFrame, came: DataFrame) -> DataFrame:
            """(qid, query_id, top): the k best that each query meets in the chunks it visits."""
            # the points of a chunk come before the queries that visit it
            dealt = held.unionByName(came).repartition(count, "group").sortWithinPartitions("group", F.col("qid").asc_nulls_first())
            best = dealt.mapInArrow(rank, ddl).dropDuplicates(["qid", "query_id", "pid", "row"])
            # k of each chunk at most reach a query, so its list is bounded by probes, tables and chunks
            return best.groupBy("qid", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "found", "pid", "row"))), 1, k).alias("top"))

        top = stage(nearest_of(held, came), "nearest")
        kept.append(top)
        full = top.where(F.size("top") >= k)
        # queries that found too few, those that found none among them, meet all points: each chunk passes on its k best
        short = stage(asked.join(full.select("qid"), "qid", "left_anti"), "short")
        if not short.isEmpty():
            part = F.pmod(F.xxhash64("pid"), F.lit(regions)).alias("group")
            all_held = points.select(part, anywhere, "v", "ids", *nobody, "pid")
            every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(regions - 1).cast("long"))).alias("group")
            all_came = short.select(every_part, anywhere, "v", F.array("id").alias("ids"), "qid", nobody[1], nobody[0].alias("pid"))
            rest = stage(nearest_of(all_held, all_came), "nearest")
            kept.append(rest)
            full = full.unionByName(rest)
    return full.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.found").alias(key), (-F.col("t.far")).alias("score"))
