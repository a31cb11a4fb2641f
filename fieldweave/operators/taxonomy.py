"""Relations in a taxonomy of weaknesses: a graph of children and parents without cycles.

``ancestry`` doubles the length of the paths it knows in each round, so a taxonomy of
depth d takes about log2(d) rounds. A round goes on only from the longest paths: what is news has one of them
as its first part, so a path is met about once, not once for each of its cuts. Ancestors move and are staged
packed, a row a node. A node is no ancestor of itself. Repeated edges count once, edges with a null end or from a
node to itself not at all; a cycle does not keep the rounds going, as only least lengths count.

``related`` deals pairs to cells, by their left and right ends. A pair never moves with ancestors: each cell
gets the lists of the nodes that stand in it, once, as numbers in the order of the nodes (``meeting``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fieldweave.operators import meeting
from fieldweave.staging import stage

#: Entries of packed lists that a task unpacks, that a cell holds of either end, and pairs of a cell at most.
UNPACKED, HELD, PAIRS = 2**21, 2**24, 2**22
#: Pairs that are worth a cell of their own.
LEAST_PAIRS = 50_000


def _packed(paths: DataFrame) -> DataFrame:
    """Paths (descendant, ancestor, depth) as a row a node: its ancestors in order, their depths beside them, and the greatest of these."""
    lists = paths.groupBy("descendant").agg(F.sort_array(F.collect_list(F.struct("ancestor", "depth"))).alias("a"), F.max("depth").alias("depth"))
    return lists.select("descendant", F.col("a.ancestor").alias("ancestors"), F.col("a.depth").alias("depths"), "depth").sortWithinPartitions("ancestors")


def _unpacked(lists: DataFrame, *others: str) -> DataFrame:
    return lists.select("descendant", *others, "depths", F.posexplode("ancestors").alias("_n", "ancestor")).select("descendant", *others, "ancestor", F.get("depths", F.col("_n")).alias("depth"))


def ancestry(edges: DataFrame) -> DataFrame:
    """(descendant, ancestors, depths, depth) of ``edges`` (child, parent): ``closure`` packed, a row a node that has parents."""
    spark = edges.sparkSession
    steps = edges.where("child <> parent").select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    lists, reach = stage(_packed(steps)), 1
    while True:
        entries, longest = lists.agg(F.sum(F.size("ancestors")), F.max("depth")).first()
        if (longest or 0) < reach:
            return lists
        # a least path of more than ``reach`` steps begins with a least path of just as many
        ends = _unpacked(lists.where(F.col("depth") == reach)).where(F.col("depth") == reach).select("descendant", F.col("ancestor").alias("via"))
        further = ends.join(lists.select(F.col("descendant").alias("via"), "ancestors", "depths"), "via").select("descendant", "ancestors", "depths", F.lit(reach).alias("more"))
        both = lists.select("descendant", "ancestors", "depths", F.lit(0).alias("more")).unionByName(further)
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(4 * entries / UNPACKED))
        paths = _unpacked(both.repartition(tasks, "descendant"), "more").where("descendant <> ancestor")
        met = paths.groupBy("descendant", "ancestor").agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        lists, reach = stage(_packed(met)), 2 * reach


def closure(edges: DataFrame) -> DataFrame:
    """(descendant, ancestor, depth): every pair that a path of ``edges`` (child, parent) joins, with its least length."""
    return _unpacked(ancestry(edges))


def _numbered(edges: DataFrame) -> DataFrame:
    """(node, id) of all ends of edges, numbered in the order of the nodes."""
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    # a number of the sorted part and a place in it, put together once the sizes of the parts are known
    placed = stage(nodes.repartitionByRange("node").sortWithinPartitions("node").select("node", F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(2**33 - 1)
    sizes = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    before = [0]
    for p in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(p, 0))
    return placed.select("node", (F.get(F.array(*map(F.lit, before)), part) + place).cast("int" if before[-1] < 2**31 else "bigint").alias("id"))


def _heavy(rows: DataFrame, end: str, shares: int, total: int) -> list:
    """Values of ``end`` with more than half of a share of the rows, if any bucket of values has a whole one; few by that."""
    bucket = F.pmod(F.xxhash64(end), F.lit(64 * shares))
    full = [r["b"] for r in rows.where(F.col(end).isNotNull()).groupBy(bucket.alias("b")).count().where(F.col("count") * shares > total).collect()] if shares > 1 else []
    return [r[0] for r in rows.where(bucket.isin(full)).groupBy(end).count().where(2 * shares * F.col("count") > total).collect()] if full else []


def _dealt(rows: DataFrame, edges: DataFrame, left: str, right: str) -> tuple[int, DataFrame]:
    """The number of cells, and what goes to each: rows of ``meeting.KINDS``, pairs with the columns of ``rows`` in ``row``."""
    ids = _numbered(edges)
    numbers = edges.join(ids.withColumnsRenamed({"node": "child", "id": "c"}), "child").join(ids.withColumnsRenamed({"node": "parent", "id": "p"}), "parent")
    lists = ancestry(numbers.select(F.col("c").alias("child"), F.col("p").alias("parent"))).select(F.col("descendant").alias("id"), "ancestors", "depths")
    asked = rows.select(F.col(right).alias("node")).distinct().withColumn("asked", F.lit(True))
    known = stage(ids.join(asked, "node", "left").join(lists, "id", "left").sortWithinPartitions("ancestors"))
    rights = known.where("asked")

    held = F.coalesce(F.sum(F.size(F.coalesce("ancestors", F.array())) + 1), F.lit(0))
    total, of_all, (of_rights, ends) = rows.count(), known.agg(held).first()[0], rights.agg(held, F.count("*")).first()
    down = max(1, math.ceil(of_rights / HELD))
    cells = max(math.ceil(total / PAIRS), min(3 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / LEAST_PAIRS)), 1)
    across = max(math.ceil(cells / down), math.ceil(of_all / HELD))

    def place(end: str | Column, of: int) -> Column:
        return F.pmod(F.xxhash64(end), F.lit(of)).cast("int")

    def each(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    # pairs of a left end that fills cells go to all of them, and so does its list; pairs with a null go anywhere
    heavy = _heavy(rows, left, across, total)
    anywhere = F.col(left).isNull() | F.col(right).isNull() | F.col(left).isin(heavy)
    cell = F.when(anywhere, F.pmod("_at", F.lit(across)).cast("int")).otherwise(place(left, across)) * down + F.coalesce(place(right, down), F.lit(0))
    pairs = rows.select(cell.alias("cell"), F.struct(*(c for c in rows.columns if c != "_at")).alias("row"))
    ups = known.withColumn("_j", each(down)).withColumn("_i", F.explode(F.when(F.col("node").isin(heavy), F.sequence(F.lit(0), F.lit(across - 1))).otherwise(F.array(place("node", across)))))
    ups = ups.select((F.col("_i") * down + F.col("_j")).alias("cell"), "node", "id", "ancestors", "depths")

    own = F.concat(F.array("id"), F.coalesce("ancestors", F.array()))
    if ends * across <= total:
        downs = rights.withColumn("_j", place("node", down))
        names = downs.select("_j", F.explode(own).alias("id")).distinct().join(ids, "id")
        downs, names = (x.withColumn("_i", each(across)).withColumn("cell", F.col("_i") * down + F.col("_j")) for x in (downs, names))
    else:  # most right ends stand in a few cells only
        downs = rows.select(cell.alias("cell"), F.col(right).alias("node")).distinct().join(rights, "node")
        names = downs.select("cell", F.explode(own).alias("id")).distinct().join(ids, "id")

    sent = zip(meeting.KINDS, (names.select("cell", "id", "node"), downs.select("cell", "id", "ancestors", "depths"), ups, pairs), strict=True)
    frames = [x.withColumn("kind", F.lit(i).cast("tinyint")) for i, (_, x) in enumerate(sent)]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return across * down, out


def related(pairs: DataFrame, edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``pairs`` with ``relation``, ``common`` and ``distance``.

    ``relation`` is same, ancestor (left above right), descendant, sibling (a parent is
    shared), cousin (another ancestor is shared) or unrelated. ``common`` is the lowest common
    ancestor, a node counting as its own: that of the least sum of steps, then the smallest;
    ``distance`` is that sum. Nulls are unrelated. Both ends have one type, to which those of ``edges`` are cast.
    """
    node = pairs.schema[left].dataType
    if pairs.schema[right].dataType != node:
        raise TypeError(f"{left} and {right} differ in type")
    taken = edges.select(F.col("child").cast(node).alias("child"), F.col("parent").cast(node).alias("parent")).where("child <> parent")
    cells, sent = _dealt(stage(pairs.withColumn("_at", F.monotonically_increasing_id())), taken, left, right)
    schema = StructType([*pairs.schema.fields, StructField("common", node), StructField("distance", IntegerType())])
    here = sent.repartitionById(cells, F.col("cell")).sortWithinPartitions("kind")
    # empty, not null: Arrow's writer goes over all null lists at the end of a batch again with each row
    filled = here.withColumns({c: F.coalesce(c, F.array().cast(here.schema[c].dataType)) for c in ("ancestors", "depths")})
    met = filled.mapInArrow(meeting.judge(left, right), schema)

    own = F.coalesce(F.col(left) == F.col(right), F.lit(False))  # also of a node that no edge names
    common, distance = F.when(own, F.col(left)).otherwise(F.col("common")), F.when(own, 0).otherwise(F.col("distance"))
    told = met.withColumns({"common": common, "distance": distance})
    # the least sum is two if a parent is shared and neither end is the common ancestor, and only then
    relation = (
        F.when(F.col("distance").isNull(), "unrelated").when(F.col("distance") == 0, "same").when(F.col("common") == F.col(left), "ancestor")
        .when(F.col("common") == F.col(right), "descendant").when(F.col("distance") == 2, "sibling").otherwise("cousin")
    )
    others = [c for c in pairs.columns if c not in (left, right)]
    return told.select(left, right, *others, "common", "distance", relation.alias("relation"))
