"""MinHash near-duplicate detection with sequential Bayesian verification.

A document's set holds the hashes of its distinct word shingles. Documents of
equal sets are one node. Nodes that agree on a band of their signatures are
candidates. Candidates are compared by batches of signature entries: under a
uniform prior, the posterior of the similarity after n entries with m agreeing
is Beta(m + 1, n - m + 1), and a pair is dropped once the probability of
reaching the threshold falls below ``miss``. Survivors form provisional groups,
the sets of a group meet, and pairs inside it that the posterior does not rule
out are verified exactly, unless they are linked through others already. The
links' components are the classes.

Buckets are dealt to tiles of at most ``tile`` nodes, otherwise in each band, so
that the links inside tiles tie a dense bucket together. Groups are dealt to tiles
of ``set_tile`` nodes, to each of which come the group's ``centres``: the nodes that
share their buckets with most others, such as the text that all others were copied
from. What tiles cannot see is settled by visits: nodes outside the largest class
of a bucket go to each of its tiles, so each pair of different classes meets as
signatures. Of a group's sets, only those of survivors then meet: a node's set
visits the tiles that hold a node it may be similar to. Nodes of the largest class
need no visit among themselves, as they are linked. Visitors pass a tile one by
one and are not held; a tile that many visit is there in several parts, each with
its share of them. No bucket, group or partner list is capped, and pairs are
never written out: a task passes on a forest of the links it finds.

Letters A-Z are lower-cased; words are maximal runs outside 0x20 and 0x09-0x0D.
A text of fewer words than a shingle is one shingle; one without words has an
empty set and is its own class, as are null texts. Rows without an id are not
compared, have a null class, and are kept. Repeated rows fall in one class and
are all kept or all dropped. Very long texts are read whole: a set grows with its text, and a task holds the sets of a
tile at once. Texts that share an id are told apart by a hash of the text. Empty tables give no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import WordHashes, combine, lookup, per_row, release, runs, scratch, stage, texts_of, window_hashes
from fieldweave.llm.graph import components

ROWS, BANDS, BATCH = 5, 32, 32
SIZE = ROWS * BANDS
_MEMORY = WordHashes()
_FACTORS = np.random.default_rng(20).integers(0, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(21).integers(0, 2**63, SIZE, dtype=np.uint64)
_SHORT = np.uint64(0x1B873593)
#: A task passes on its forest when it has so many nodes.
FOREST = 200_000


def shingles(raw: bytes, width: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    h = _MEMORY.of(raw.lower().split())
    if not len(h):
        return h
    if len(h) < width:
        return combine(window_hashes(h, len(h)), _SHORT + np.uint64(len(h)))
    return np.unique(window_hashes(h, width))


def node_of(values: np.ndarray) -> int:
    """Name of a set: a 63-bit hash of its content."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) >> 1


def signature(values: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, as 32 bits."""
    low = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 1024):
            part = values[at : at + 1024]
            low = np.minimum(low, (_FACTORS[:, None] * part + _SHIFTS[:, None]).min(1))
    return low >> np.uint64(32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = combine(key, parts[:, r])
    return key.view(np.int64)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch end n, the least number of agreeing entries that is not ruled out."""
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        below, m = 0.0, -1
        while below < miss and m < n:  # P(similarity >= t) = P(Binomial(n + 1, t) <= m)
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(one: np.ndarray, many: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``many`` that stay after each batch, and how many entries agree."""
    alive, agree = np.arange(len(many)), np.zeros(len(many), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (many[alive, part] == one[part]).sum(1)
        stay = agree >= need
        alive, agree = alive[stay], agree[stay]
        if not len(alive):
            break
    return alive, agree


class Links:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            further = self.up[self.up]
            if (further == self.up).all():
                return self.up
            self.up = further


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIZE)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def similar(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Whether intersection / union is at least threshold[0] / threshold[1], in whole numbers."""
    up, down = threshold
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


class Forest(dict):
    """Union-find over the nodes that a task has linked; the smaller node is the root."""

    def root(self, x: int) -> int:
        up = self.setdefault(x, x)
        while up != x:
            self[x] = up = self.setdefault(up, up)
            x, up = up, self[up]
        return x

    def link(self, left: list[int], right: list[int]) -> None:
        for a, b in zip(left, right, strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self[max(a, b)] = min(a, b)

    def rows(self) -> dict:
        pairs = [(self.root(x), x) for x in list(self)]
        self.clear()
        return {"a": [a for a, x in pairs if a != x], "b": [x for a, x in pairs if a != x]}


Work = Callable[[pa.Table], tuple[list, list]]
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _by_group(batches: Iterator[pa.RecordBatch], work: Work) -> Iterator[pa.RecordBatch]:
    """A forest of the links of each group of rows; groups come one after the other and may cross batches."""
    rest, forest = None, Forest()

    def settle(table: pa.Table, groups: np.ndarray) -> None:
        for lo, hi in runs(groups):
            if hi - lo > 1:
                forest.link(*work(table.slice(lo, hi - lo)))

    for batch in batches:
        got = pa.Table.from_batches([batch])
        got = got if rest is None else pa.concat_tables([rest, got])
        groups = got.column("group").to_numpy()
        differs = np.flatnonzero(groups != groups[-1])
        cut = int(differs[-1]) + 1 if len(differs) else 0
        settle(got.slice(0, cut), groups[:cut])
        rest = got.slice(cut)
        release()
        if len(forest) > FOREST:
            yield pa.RecordBatch.from_pydict(forest.rows(), schema=LINK)
    if rest is not None and rest.num_rows:
        settle(rest, rest.column("group").to_numpy())
    yield pa.RecordBatch.from_pydict(forest.rows(), schema=LINK)


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "group").sortWithinPartitions("group", *order)


def _linked(rows: DataFrame, work: Work, *order: str) -> DataFrame:
    """(a, b) inside all groups; the rows carry ``group`` and ``node``."""
    return _dealt(rows, *order, "node").mapInArrow(lambda batches: _by_group(batches, work), "a long, b long")


def _by_visits(batches: Iterator[pa.RecordBatch], begin: Callable[[pa.Table], Work]) -> Iterator[pa.RecordBatch]:
    """Pairs that visitors find among the residents of each group; residents come first and are held, visitors pass."""
    group, held, meet = None, [], None
    for batch in batches:
        groups, comes = batch.column("group").to_numpy(), batch.column("visits").to_numpy(zero_copy_only=False)
        found: set[tuple[int, int]] = set()
        for lo, hi in runs(groups):
            if groups[lo] != group:
                group, held, meet = groups[lo], [], None
            split = lo + int(np.searchsorted(comes[lo:hi], True))
            if split > lo:
                held.append(batch.slice(lo, split - lo))
            if split < hi and held:
                meet = meet or begin(pa.Table.from_batches(held))
                found.update(zip(*meet(pa.Table.from_batches([batch.slice(split, hi - split)])), strict=True))
        yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=LINK)
        release()


def _visited(rows: DataFrame, begin: Callable[[pa.Table], Work]) -> DataFrame:
    return _dealt(rows, "visits").mapInArrow(lambda batches: _by_visits(batches, begin), "a long, b long").distinct()


def _likely(least: list[int]) -> Work:
    """Stars over the nodes of a tile that the posterior leaves connected."""

    def work(table: pa.Table) -> tuple[list, list]:
        nodes, sig = table.column("node").to_pylist(), _signatures(table.column("sig"))
        waiting, left, right = np.arange(len(nodes)), [], []
        while len(waiting):
            star, waiting = [int(waiting[0])], waiting[1:]
            for i in star:
                if not len(waiting):
                    break
                near, _ = survivors(sig[i], sig[waiting], least)
                star += waiting[near].tolist()
                waiting = np.delete(waiting, near)
            left += [nodes[star[0]]] * (len(star) - 1)
            right += [nodes[j] for j in star[1:]]
        return left, right

    return work


def _may_be(least: list[int], mine: str, theirs: str) -> Callable[[pa.Table], Work]:
    """(visitor's ``mine``, resident's ``theirs``) of the pairs of different classes that the posterior does not rule out."""

    def begin(held: pa.Table) -> Work:
        label, told, sig = held.column("label").to_numpy(), held.column(theirs).to_numpy(), _signatures(held.column("sig"))

        def meet(come: pa.Table) -> tuple[list, list]:
            links = set()
            for own, name, x in zip(come.column("label").to_pylist(), come.column(mine).to_pylist(), _signatures(come.column("sig")), strict=True):
                other = np.flatnonzero(label != own)
                near, _ = survivors(x, sig[other], least)
                links |= {(name, y) for y in told[other[near]].tolist()}
            return [a for a, _ in links], [b for _, b in links]

        return meet

    return begin


def _exact(least: list[int], threshold: tuple[int, int]) -> Work:
    """Verified links inside a tile, as stars."""

    def work(table: pa.Table) -> tuple[list, list]:
        nodes, sig, sets = table.column("node").to_pylist(), _signatures(table.column("sig")), _sets(table.column("set"))
        links = Links(len(nodes))
        for i in range(len(nodes)):
            roots = links.roots()
            other = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1
            near, agree = survivors(sig[i], sig[other], least)
            for j in other[near][np.argsort(-agree, kind="stable")].tolist():
                if links.root(i) != links.root(j) and similar(sets[i], sets[j], threshold):
                    links.join(i, j)
        roots = links.roots()
        moved = np.flatnonzero(roots != np.arange(len(nodes))).tolist()
        return [nodes[roots[j]] for j in moved], [nodes[j] for j in moved]

    return work


def _exact_visits(least: list[int], threshold: tuple[int, int]) -> Callable[[pa.Table], Work]:
    """Verified links between the classes of visitors and of residents."""

    def begin(held: pa.Table) -> Work:
        label, sig, sets = held.column("label").to_numpy(), _signatures(held.column("sig")), _sets(held.column("set"))
        links: set[tuple[int, int]] = set()

        def meet(come: pa.Table) -> tuple[list, list]:
            before = len(links)
            fresh = []
            for own, x, values in zip(come.column("label").to_pylist(), _signatures(come.column("sig")), _sets(come.column("set")), strict=True):
                other = np.flatnonzero(label != own)
                near, agree = survivors(x, sig[other], least)
                for j in other[near][np.argsort(-agree, kind="stable")].tolist():
                    link = (own, int(label[j]))
                    if link not in links and similar(values, sets[j], threshold):
                        links.add(link)
                        fresh.append(link)
            assert len(links) == before + len(fresh)
            return [a for a, _ in fresh], [b for _, b in fresh]

        return meet

    return begin


def _stars(labels: DataFrame) -> DataFrame:
    """The links that labels stand for: one of each node to its label."""
    return labels.select(F.col("label").alias("a"), F.col("node").alias("b"))


def _tiled(rows: DataFrame, key: str, tile: int) -> DataFrame:
    """``rows`` of keys that several share, with the number ``n`` of their rows and their tiles, and as ``group`` their tile."""
    sizes = stage(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").withColumn("sharing", F.col("n")), "sizes")
    dealt = lookup(rows, sizes, key).withColumn("tiles", F.ceil(F.col("sharing") / tile))
    return dealt.withColumn("tile", F.pmod(F.xxhash64("node", key), F.col("tiles"))).withColumn("group", F.xxhash64(key, "tile"))


def _in_parts(rows: DataFrame) -> DataFrame:
    """Residents and visitors of each ``group`` dealt to its ``parts``: residents to each, a visitor to one."""
    all_parts = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    part = F.explode(F.when(F.col("visits"), F.array(F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(all_parts))
    return rows.withColumn("part", part).withColumn("group", F.xxhash64("group", "part")).drop("part", "parts")


def _visits(rows: DataFrame, key: str, labels: DataFrame, tile: int) -> DataFrame:
    """Tiles of keys with several classes, and in each of them the key's nodes outside its largest class.

    A tile meets its visitors in parts of about ``tile``, so a part has as many rows
    again as a tile, and all parts together hold about as many residents as visitors.
    """
    big = stage(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    main = big.groupBy(key, "label").count().groupBy(key).agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"), F.sum("count").alias("n"), F.max("count").alias("most"))
    several = main.where("labels > 1").withColumn("parts", F.ceil((F.col("n") - F.col("most")) / tile)).drop("labels", "most")
    marked = lookup(big, stage(several, "main"), key)
    come = marked.where("label <> main").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    come = come.withColumn("group", F.xxhash64(key, "tile")).withColumn("visits", F.lit(True))
    return _in_parts(marked.withColumn("visits", F.lit(False)).unionByName(come).drop("main"))


def _central(families: DataFrame, buckets: DataFrame, centres: int) -> DataFrame:
    """The nodes of each family, with ``central`` set on those that share their buckets with most.

    They are the best of each of ``centres`` parts of a family, so the best of all is among them.
    """
    shared = buckets.groupBy("node").agg(F.sum("sharing").alias("shared"))
    parts = families.join(shared, "node").groupBy("family", F.pmod(F.xxhash64("node"), F.lit(centres)))
    best = parts.agg(F.max_by("node", F.struct("shared", "node")).alias("node")).select("node", F.lit(True).alias("central"))
    return families.join(best, "node", "left").withColumn("central", F.coalesce("central", F.lit(False)))


def _class_of_node(rows: DataFrame, signed: DataFrame, width: int, threshold: tuple[int, int], least: list[int], tile: int, set_tile: int, centres: int) -> DataFrame:
    """(node, component, n): the smallest id of each node's class, and how many rows the node has; written."""
    per_node = signed.where("node is not null").groupBy("node")
    nodes = stage(per_node.agg(F.min(F.struct("doc_id", "told")).alias("home"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).select("node", "home.doc_id", "home.told", "n", "sig", "bands"), "nodes")
    sigs = nodes.select("node", "sig")
    banded = stage(nodes.select("node", F.explode("bands").alias("key")), "bands")
    buckets = stage(_tiled(banded, "key", tile), "buckets")
    found = stage(_linked(buckets.join(sigs, "node").select("group", "node", "sig"), _likely(least)), "likely")
    likely = components(found)
    large = buckets.where("tiles > 1")
    if not large.isEmpty():
        extra = stage(_visited(_visits(large, "key", likely, tile).join(sigs, "node"), _may_be(least, "label", "label")), "visits")
        likely = likely if extra.isEmpty() else components(_stars(likely).unionByName(extra))
    # the sets of provisional groups, from one document of each node; id and hash of the text tell it from others of its id
    homes = nodes.join(likely, "node").select("doc_id", "told", "node", "sig")

    def make_sets():
        def work(batch: pa.RecordBatch) -> dict:
            out = {"node": [], "sig": [], "set": []}
            node, sig = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at, raw in enumerate(texts_of(batch.column(0))):
                values = shingles(raw, width)
                if node_of(values) == node[at]:  # else another text of this id and hash
                    out["node"].append(node[at])
                    out["sig"].append(sig[at])
                    out["set"].append(values.tobytes())
            return out

        return work

    held = per_row(homes.join(rows, ["doc_id", "told"]), ["text", "node", "sig"], "node long, sig binary, set binary", make_sets)
    sets = stage(held, "sets").dropDuplicates(["node"])
    tiles = stage(_tiled(likely.withColumnRenamed("label", "family"), "family", set_tile), "tiles")
    several = tiles.where("tiles > 1")
    large = None if several.isEmpty() else stage(_central(several, buckets, centres), "central")
    meeting = tiles.where("tiles = 1").select("node", "group", F.lit(False).alias("late"))
    if large is not None:
        everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
        centre = large.where("central").select("node", "family", everywhere.alias("tile")).select("node", F.xxhash64("family", "tile").alias("group"), F.lit(False).alias("late"))
        meeting = meeting.unionByName(centre).unionByName(large.where("not central").select("node", "group", F.lit(True).alias("late")))
    found = stage(_linked(meeting.join(sets, "node"), _exact(least, threshold), "late"), "verified")
    verified = components(found)
    if large is not None:
        # nodes of different classes of a large group that share a bucket: which tiles of sets hold survivors
        home = large.select("node", F.col("group").alias("home"))
        asked = _visits(buckets.join(home, "node"), "key", verified, tile).join(sigs, "node")
        pairs = stage(_visited(asked, _may_be(least, "node", "home")).select(F.col("a").alias("node"), F.col("b").alias("group")), "pairs")
        parts = pairs.groupBy("group").agg(F.ceil(F.count("*") / set_tile).alias("parts"))
        residents = home.withColumnRenamed("home", "group").withColumn("visits", F.lit(False))
        come = _in_parts(residents.unionByName(pairs.withColumn("visits", F.lit(True))).join(parts, "group")).join(sets, "node").join(verified, "node", "left")
        extra = stage(_visited(come.withColumn("label", F.coalesce("label", "node")), _exact_visits(least, threshold)), "visits")
        verified = verified if extra.isEmpty() else components(_stars(verified).unionByName(extra))
    # class of each node, then of each row
    labelled = stage(nodes.select("node", "doc_id", "n").join(verified, "node", "left").withColumn("label", F.coalesce("label", "node")), "classes")
    of_label = stage(labelled.groupBy("label").agg(F.min("doc_id").alias("component"), F.count("*").alias("n")), "components")
    return stage(lookup(labelled.withColumnRenamed("n", "rows"), of_label, "label").select("node", "component", F.col("rows").alias("n")), "components")


def classes(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    threshold: tuple[int, int] = (80, 100),
    miss: float = 1e-6,
    tile: int = 512,
    set_tile: int = 256,
    centres: int = 32,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    ``component_id`` is the smallest id of the row's class; a row is kept if that
    is its own id.
    """
    least = least_matches(threshold[0] / threshold[1], miss)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            count, node, sigs, bands = [], [], [], []
            for known, raw in zip(batch.column(0).is_valid().to_pylist(), texts_of(batch.column(1)), strict=True):
                values = shingles(raw, width)
                count.append(len(values))
                if not len(values) or not known:
                    node.append(None)
                    sigs.append(None)
                    bands.append(None)
                    continue
                sig = signature(values)
                node.append(node_of(values))
                sigs.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
                bands.append(band_keys(sig))
            return {"doc_id": batch.column(0), "told": batch.column(2), "n_shingles": count, "node": node, "sig": sigs, "bands": bands}

        return work

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("told"))
    signed = stage(per_row(rows, ["doc_id", "text", "told"], "doc_id long, told long, n_shingles long, node long, sig binary, bands array<long>", make), "signatures")
    with scratch(docs.sparkSession) as kept:
        of_node = _class_of_node(rows, signed, width, threshold, least, tile, set_tile, centres)
        kept.append(of_node)
    joined = lookup(signed.select("doc_id", "n_shingles", "node"), of_node, "node", "left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The documents of the ids that stay, one for each class, with all their columns."""
    gone = classes(docs, doc_id=doc_id, text=text, **parameters).where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")
