"""Stupid-backoff language-model scores of documents under their own corpus, or under counts of another.

The counts of all n-grams form a table partitioned by hash (``count_table``). A
block of documents explodes its n-grams, adds up equal ones, and joins the table
through one exchange of distinct n-grams, packed: plain rows of a hash, a block
and a count take more disk than the text itself several times over. Each bucket of
the table adds up the counts of all blocks and answers each block. A longer
order joins only n-grams whose two shorter parts are frequent enough, since
others cannot be. Scores are summed per document. Nothing is sampled, so what is
gathered follows the corpus. A block is as long as its longest text at least.

The score of a word after its context is c(context word) / c(context) for the
longest context of at most ``order`` - 1 words inside the document whose n-gram
occurs ``min_count`` times in the corpus; each shortening multiplies by
``alpha``; a single word scores c(word) / N. Words are maximal runs outside 0x20
and 0x09-0x0D, as they stand. Log scores are rounded to millionths before they
are summed, so that sums do not depend on their order.

Given a count table, which ``count_table`` makes of any corpus, each block's distinct n-grams meet the
table's rows of their bucket instead of each other. A word that the table does not have counts as
if it had occurred once.

Null and empty texts have no words, a sum of 0 and a null mean. Every row is
scored and counted, repeated rows as often as they come; an empty table gives
none. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldweave.llm.common import Blocks, WordHashes, hashed, received, replies, window_hashes

_MEMORY = WordHashes()
#: The key under which blocks add up their numbers of words.
TOTAL = 2


def grams(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams that lie inside a text, and where each ends."""
    hashes = window_hashes(words, k)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = text[: len(hashes)] == text[k - 1 : k - 1 + len(hashes)]
    at = np.flatnonzero(inside)
    return hashes[at], at + k - 1


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all blocks, the place of each key that was asked, and the corpus count of each distinct key."""
    distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(of, weights=np.concatenate(counts).astype(np.float64)).astype(np.uint64)  # exact below 2**53
    return distinct, of, sums


def _add_up(kind: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """The corpus count of each key that was asked, for each block."""
    _, of, sums = _totals(keys, counts)
    return np.split(sums[of], np.cumsum([len(k) for k in keys])[:-1])


def _question(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, count = np.unique(keys, return_counts=True)
    return distinct, count.astype(np.uint32)


def count_table(docs: DataFrame, *, text: str = "text", order: int = 3, block_bytes: int = 2**23, bucket_bytes: int = 12 * 2**20) -> DataFrame:
    """(k, gram, n): how often each k-gram, named by its hash, occurs in the corpus, for k from 1 to ``order``; partitioned by hash."""
    blocks = Blocks(docs.select(F.col(text)), text, block_bytes=block_bytes, bucket_bytes=bucket_bytes)
    arrow = pa.schema([("k", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def ask(table: pa.Table):
        words, starts = hashed(table, text, _MEMORY)
        return [_question(grams(words, starts, k)[0]) for k in range(1, order + 1)]

    def rows(table: pa.Table) -> pa.Table:
        _, kinds, keys, counts = received(table, np.uint32)
        parts = []
        for kind in sorted(set(kinds)):
            mine = [i for i, x in enumerate(kinds) if x == kind]
            distinct, _, sums = _totals([keys[i] for i in mine], [counts[i] for i in mine])
            parts.append(pa.table({"k": np.full(len(sums), kind + 1, np.int32), "gram": distinct.view(np.int64), "n": sums.view(np.int64)}, schema=arrow))
        return pa.concat_tables(parts)

    return blocks.ask(ask).groupBy("_bucket").applyInArrow(rows, "k int, gram long, n long")


#: Bytes of a row of a count table, for the number of buckets.
ROW_BYTES = 20


def _from_table(total: int):
    """Answers blocks from the rows of a count table that lie in their bucket."""

    def settle(kind: int, keys: np.ndarray, counts: np.ndarray, known: pa.Table) -> np.ndarray:
        if kind == TOTAL:
            return np.array([total], np.uint64)
        of = known.filter(pa.compute.equal(known.column("k"), kind + 1 if kind < TOTAL else kind))
        grams_, n = of.column("gram").to_numpy().view(np.uint64), of.column("n").to_numpy().astype(np.uint64)
        order = np.argsort(grams_)
        grams_, n = np.r_[grams_[order], np.uint64(0)], np.r_[n[order], np.uint64(0)]
        at = np.searchsorted(grams_[:-1], keys)
        return np.where((at < len(of)) & (grams_[at] == keys), n[at], np.uint64(0))

    return settle


def score(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2, counts: DataFrame | None = None, block_bytes: int = 2**23, bucket_bytes: int = 12 * 2**20
) -> DataFrame:
    """(doc_id, n_words, n_backoff, score_micro, mean_log_score) of each row, under the corpus itself or a written table ``counts`` (k, gram, n).

    ``n_backoff`` counts words scored with less context than they have,
    ``score_micro`` is the sum of the natural logs in millionths.
    """
    rows = docs.select(F.col(doc_id), F.col(text))
    told_of = counts.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n"))), F.lit(0)).alias("words")).first() if counts else None  # one row
    blocks = Blocks(rows, text, block_bytes=block_bytes, bucket_bytes=bucket_bytes, least_buckets=-(-told_of["rows"] * ROW_BYTES // bucket_bytes) if told_of else 1)
    schema = rows.select(doc_id).schema.add("n_words", "long").add("n_backoff", "long").add("score_micro", "long").add("mean_log_score", "double")
    arrow = to_arrow_schema(schema)

    def kind_of(k: int) -> int:
        return k - 1 if k <= 2 else k

    def counted(words, starts, told: pa.Table | None, upto: int):
        """Corpus counts at each word of the 1- to ``upto``-grams that end there; 0 where there is none."""
        levels = []
        for k in range(1, upto + 1):
            keys, ends = pruned(words, starts, k, levels)
            distinct, of = np.unique(keys, return_inverse=True)
            sums = replies(told, kind_of(k), np.uint64)
            assert len(sums) == len(distinct), "answers and n-grams differ"
            at = np.zeros(len(words), np.uint64)
            at[ends] = sums[of]
            levels.append(at)
        return levels

    def pruned(words, starts, k: int, levels):
        keys, ends = grams(words, starts, k)
        if k > 2:
            may = (levels[k - 2][ends] >= min_count) & (levels[k - 2][ends - 1] >= min_count)
            keys, ends = keys[may], ends[may]
        return keys, ends

    def first(table: pa.Table):
        words, starts = hashed(table, text, _MEMORY)
        asked = [_question(grams(words, starts, 1)[0]), _question(grams(words, starts, 2)[0]) if order > 1 else (np.empty(0, np.uint64), None)]
        return [*asked, (np.zeros(1, np.uint64), np.array([len(words)], np.uint32))]

    def next_order(k: int):
        def ask(table: pa.Table, told: pa.Table):
            words, starts = hashed(table, text, _MEMORY)
            return [_question(pruned(words, starts, k, counted(words, starts, told, k - 1))[0])]

        return ask

    def final(table: pa.Table, told: pa.Table) -> pa.Table:
        words, starts = hashed(table, text, _MEMORY)
        levels = counted(words, starts, told, order)
        total = float(replies(told, TOTAL, np.uint64)[0])
        n = len(words)
        place = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
        most = np.minimum(place + 1, order)
        value, used = np.zeros(n), np.ones(n, np.int64)
        if n:
            value = np.maximum(levels[0], np.uint64(1)) / max(total, 1.0)
        for k in range(2, order + 1):
            has = np.flatnonzero(levels[k - 1] >= min_count)
            value[has] = levels[k - 1][has] / levels[k - 2][has - 1].astype(np.float64)
            used[has] = k
        back = most - used
        micro = np.rint((np.log(value) + back * np.log(alpha)) * 1e6).astype(np.int64) if n else np.zeros(0, np.int64)
        sums, backs = np.r_[0, np.cumsum(micro)], np.r_[0, np.cumsum(back > 0)]
        lengths = np.diff(starts)
        score_micro = sums[starts[1:]] - sums[starts[:-1]]
        mean = [s / 1e6 / w if w else None for s, w in zip(score_micro.tolist(), lengths.tolist(), strict=True)]
        return pa.table({doc_id: table.column(doc_id), "n_words": lengths, "n_backoff": backs[starts[1:]] - backs[starts[:-1]], "score_micro": score_micro, "mean_log_score": mean}, schema=arrow)

    def settled(asked: DataFrame, k: int | None = None) -> DataFrame:
        asked = asked if k is None else asked.withColumn("kind", F.lit(k))
        if counts is None:
            return Blocks.answer(asked, _add_up, np.uint32)
        return Blocks.look_up(asked, blocks.in_buckets(counts.select("k", "gram", "n")), _from_table(told_of["words"]), np.uint32)

    told = settled(blocks.ask(first))
    for k in range(3, order + 1):
        told = told.unionByName(settled(blocks.ask(next_order(k), told), k))
    return blocks.finish(told, final, schema)
