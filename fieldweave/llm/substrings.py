"""Substring deduplication by recompression.

Words of all documents are renamed in rounds, as recompression does: a round
first names maximal runs of equal symbols, then names the pairs (a, b) whose
left symbol falls in the left half of the alphabet and whose right symbol falls
in the right half, the halves being drawn anew by hash for each round. A name
is a 64-bit hash of what it stands for, so every task gives the same name
without asking the others. Apart from its ends, a repeated passage is named
alike wherever it stands.

Each symbol of the last round carries its extent: the words that had to be seen
to know it. A window of ``width`` words that covers an extent holds this symbol
in all its occurrences. So a window can repeat in another document only if all
symbols whose extents it covers, keyed with the words of their extents, occur
in two documents. A first exchange counts the documents of each keyed symbol;
only windows that pass go, as 64-bit hashes of their words, to a second exchange that
verifies them and finds the smallest document id of each. Windows that cover no
extent always go. The exchanges send distinct keys of a block of documents
once, so a passage that a third of all documents share costs a row a block.

Contract of the results: the words of a text are its maximal runs outside 0x20
and 0x09-0x0D. A word is removed if it is covered by a window whose words also
start in a document with a smaller id, judged on the input. Null and empty
texts have no words, an empty table gives no rows, and a block is as long as its longest
text at least. Rows that share an id never remove from one another. A row
without an id keeps all its words and removes none. Input columns are kept;
those named as an output column give way to it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from fieldweave.llm.common import Blocks, WordHashes, combine, hashed, replies, texts_of, window_hashes

FAR = np.int64(2**40)
_MEMORY = WordHashes()
_PAIR, _RUN = np.uint64(0x51ED270B), np.uint64(0xA24BAED4)


def recompress(words: np.ndarray, starts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, left, right) of the symbols after ``rounds`` rounds over texts laid end to end.

    Words ``left`` to ``right`` (exclusive) are the symbol's extent; ``key`` names
    the symbol together with the words of its extent. Symbols whose extent
    would reach beyond their text are left out: another text may go on there.
    """
    n = len(words)
    if not n:
        return words, np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first, end = starts[:-1][text], starts[1:][text]  # of each word's text
    name, beg = words, np.arange(n)
    fin = beg + 1
    left, right = beg.copy(), fin.copy()
    with np.errstate(over="ignore"):
        for step in range(rounds):
            # runs of equal symbols
            fresh = np.r_[True, (name[1:] != name[:-1]) | (text[beg[1:]] != text[beg[:-1]])]
            head = np.flatnonzero(fresh)
            tail = np.r_[head[1:], len(name)] - 1
            long = tail - head + 1
            before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, len(name) - 1)
            b, f = beg[head], fin[tail]
            at_start, at_end = b == first[b], f == end[b]
            # a neighbour differs for sure if its nearest word does; otherwise all that is known of it is needed
            near_l = words[np.maximum(b - 1, 0)] != words[fin[head] - 1]
            near_r = words[np.minimum(f, n - 1)] != words[beg[tail]]
            own_l, own_r = np.minimum(left[head], left[tail]), np.maximum(right[head], right[tail])
            lo = np.where(at_start, -FAR, np.where(near_l, b - 1, left[before]))
            hi = np.where(at_end, FAR, np.where(near_r, f + 1, right[after]))
            lo = np.where(near_r | at_end, lo, np.minimum(lo, left[after]))
            hi = np.where(near_l | at_start, hi, np.maximum(hi, right[before]))
            left, right = np.minimum(own_l, lo), np.maximum(own_r, hi)
            name = np.where(long > 1, combine(name[head] ^ _RUN, long.astype(np.uint64)), name[head])
            beg, fin = b, f
            # pairs of a left and a right symbol
            salt = np.uint64(0x9E37 + 2 * step + 1)
            is_left = (combine(name, salt) >> np.uint64(63)) == 0
            same = text[beg[1:]] == text[beg[:-1]]
            pair = np.r_[is_left[:-1] & ~is_left[1:] & same, False]
            second = np.r_[False, pair[:-1]]
            single = ~pair & ~second
            # a lone symbol is known to be lone once the neighbour that could take it is known
            nxt_r, nxt_l = np.r_[np.where(same, right[1:], FAR), FAR], np.r_[np.where(same, left[1:], -FAR), -FAR]
            prv_l, prv_r = np.r_[-FAR, np.where(same, left[:-1], -FAR)], np.r_[FAR, np.where(same, right[:-1], FAR)]
            asks_next, asks_previous = pair | (single & is_left), single & ~is_left
            nxt_name, nxt_fin = np.r_[name[1:], name[:1]], np.r_[fin[1:], fin[:1]]
            reach_l = np.where(asks_next, np.minimum(left, nxt_l), np.where(asks_previous, np.minimum(left, prv_l), left))
            reach_r = np.where(asks_next, np.maximum(right, nxt_r), np.where(asks_previous, np.maximum(right, prv_r), right))
            keep = ~second
            name = np.where(pair, combine(name ^ _PAIR, nxt_name), name)[keep]
            fin = np.where(pair, nxt_fin, fin)[keep]
            beg, left, right = beg[keep], reach_l[keep], reach_r[keep]
        known = (left >= first[beg]) & (right <= end[beg])
        name, left, right = name[known], left[known], right[known]
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
        sums = np.r_[np.uint64(0), np.cumsum(words * powers[:n])]
        content = (sums[right] - sums[left]) * np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)])[left]
    return combine(name, content ^ (right - left).astype(np.uint64)), left, right


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def passing(length: int, starts: np.ndarray, width: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Starts of the windows inside a text that cover none of the extents given."""
    ok = np.zeros(length + 1, np.int64)
    lens = np.diff(starts)
    whole = lens >= width
    np.add.at(ok, starts[:-1][whole], 1)
    np.add.at(ok, starts[1:][whole] - width + 1, -1)
    out = np.zeros(length + 1, np.int64)
    fits = right - left <= width
    np.add.at(out, np.maximum(right[fits] - width, 0), 1)
    np.add.at(out, left[fits] + 1, -1)
    return np.flatnonzero((np.cumsum(ok) > 0) & (np.cumsum(out) == 0))


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("_order").to_numpy()


def _per_symbol(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, whether several documents of the block have one, and each entry's key."""
    distinct, of = np.unique(key, return_inverse=True)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    high = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, of, doc)
    np.maximum.at(high, of, doc)
    return distinct, low != high, of


def _count_documents(kind: int, keys: list[np.ndarray], extra: list) -> list[np.ndarray]:
    """One byte a key: 1 if two documents have it, in one block or in several."""
    everything = np.concatenate(keys)
    several = np.concatenate(extra)
    _, of, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[of[several > 0]] = True
    return np.split(shared[of].astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])


def _smallest(kind: int, keys: list[np.ndarray], extra: list) -> list[np.ndarray]:
    """One byte a key: 1 if a smaller document id has the window too."""
    everything, ids = np.concatenate(keys), np.concatenate(extra)
    _, of = np.unique(everything, return_inverse=True)
    least = np.full(int(of.max()) + 1 if len(of) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, of, ids)
    return np.split((least[of] < ids).astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])


def dedup_map(docs: DataFrame, fn: Callable[[dict, list, list, list], pa.Table], schema, *, doc_id: str, text: str, width: int, rounds: int, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """``fn(columns, words, n_removed, kept words)`` over blocks of documents, as judged by the module's rule."""
    # input columns travel under names of their own, so that none clashes with the marks
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marks = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_order"), F.col(doc_id).isNotNull().alias("_known"), *(F.col(c).alias(n) for c, n in names.items()))
    text = names[text]
    blocks = Blocks(marks, text, block_bytes=block_bytes, bucket_bytes=bucket_bytes)

    def prepare(table: pa.Table):
        words, starts = hashed(table, text, _MEMORY)
        known = table.column("_known").to_numpy()
        if not known.all():  # texts without an id hold no window
            starts = starts.copy()
            keep = np.repeat(known, np.diff(starts))
            words = words[keep]
            starts = np.r_[0, np.cumsum(np.where(known, np.diff(starts), 0))]
        doc = np.repeat(_ids(table), np.diff(starts))
        return words, starts, doc, recompress(words, starts, rounds)

    def symbols(table: pa.Table):
        _, _, doc, (key, left, right) = prepare(table)
        fits = right - left <= width
        if not fits.any():
            return [(np.empty(0, np.uint64), None)]
        distinct, several, _ = _per_symbol(key[fits], doc[left[fits]])
        return [(distinct, several.astype(np.uint8))]

    def candidates(table: pa.Table, told: pa.Table):
        words, starts, doc, (key, left, right) = prepare(table)
        fits = right - left <= width
        key, left, right = key[fits], left[fits], right[fits]
        distinct, of = np.unique(key, return_inverse=True)
        shared = replies(told, 0, np.uint8)
        assert len(shared) == len(distinct), "answers and symbols differ"
        alone = shared[of] == 0
        at = passing(len(words), starts, width, left[alone], right[alone])
        hashes = window_hashes(words, width)[at]
        return hashes, at, doc, starts

    def windows(table: pa.Table, told: pa.Table):
        hashes, at, doc, _ = candidates(table, told)
        least, _ = _least_in_block(hashes, doc[at])
        return [least]

    def final(table: pa.Table, told: pa.Table) -> pa.Table:
        first = told.filter(pa.compute.equal(told.column("kind"), 0))
        second = told.filter(pa.compute.equal(told.column("kind"), 1))
        hashes, at, doc, starts = candidates(table, first)
        (distinct, low), of = _least_in_block(hashes, doc[at])
        smaller = replies(second, 1, np.uint8)
        assert len(smaller) == len(distinct), "answers and windows differ"
        gone = (smaller[of] > 0) | (low[of] < doc[at])
        cover = np.zeros(int(starts[-1]) + width + 1, np.int64)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + width, -1)
        removed = np.cumsum(cover) > 0
        known = table.column("_known").to_pylist()
        counts, lost, kept = [], [], []
        column = table.column(text)
        for start in range(0, table.num_rows, 512):
            for i, raw in enumerate(texts_of(column.slice(start, 512)), start):
                tokens = raw.split()
                if known[i]:
                    mark = removed[starts[i] : starts[i + 1]]
                    n = int(mark.sum())
                    if n:
                        tokens_kept = [tokens[j] for j in np.flatnonzero(~mark).tolist()]
                    else:
                        tokens_kept = tokens
                else:
                    n, tokens_kept = 0, tokens
                counts.append(len(tokens))
                lost.append(n)
                kept.append(b" ".join(tokens_kept))
        return fn({c: table.column(n) for c, n in names.items()}, counts, lost, kept)

    told = Blocks.answer(blocks.ask(symbols), _count_documents, np.uint8)
    verified = Blocks.answer(blocks.ask(windows, told), _smallest, np.int64).withColumn("kind", F.lit(1))
    return blocks.finish(told.unionByName(verified), final, schema)


def _least_in_block(hashes: np.ndarray, doc: np.ndarray):
    """Distinct window hashes with their smallest document id in the block, and each entry's place."""
    distinct, of = np.unique(hashes, return_inverse=True)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(low, of, doc)
    return (distinct, low), of


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13, rounds: int = 3, counts: bool = True, block_bytes: int = 2**22, bucket_bytes: int = 12 * 2**20) -> DataFrame:
    """The documents with repeated windows taken out of ``text``, with ``n_words`` and ``n_removed`` if ``counts``.

    A text that loses nothing stays as it is; one that loses words is its kept
    words joined by one space. Other columns are kept, and without ``counts`` all are.
    """
    told = ("n_words", "n_removed") if counts else ()
    rows = docs.select(*(c for c in docs.columns if c not in told))
    schema = StructType([*rows.schema, *(StructField(c, LongType()) for c in told)])
    arrow = to_arrow_schema(schema)

    def fn(given: dict, words: list, lost: list, kept: list) -> pa.Table:
        before = given[text].to_pylist()
        after = [b if not n else k.decode() for b, n, k in zip(before, lost, kept, strict=True)]
        columns = given | {text: after} | dict(zip(told, (words, lost), strict=False))
        return pa.table({f.name: columns[f.name] for f in arrow}, schema=arrow)

    return dedup_map(rows, fn, schema, doc_id=doc_id, text=text, width=width, rounds=rounds, block_bytes=block_bytes, bucket_bytes=bucket_bytes)


def repeat_digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13, rounds: int = 3, block_bytes: int = 2**22, bucket_bytes: int = 12 * 2**20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; the digest is of the kept words joined by one space."""
    import hashlib

    rows = docs.select(F.col(doc_id), F.col(text))
    schema = rows.select(doc_id).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    arrow = to_arrow_schema(schema)

    def fn(given: dict, counts: list, lost: list, kept: list) -> pa.Table:
        columns = {doc_id: given[doc_id], "n_words": counts, "n_removed": lost, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        return pa.table(columns, schema=arrow)

    return dedup_map(rows, fn, schema, doc_id=doc_id, text=text, width=width, rounds=rounds, block_bytes=block_bytes, bucket_bytes=bucket_bytes)
