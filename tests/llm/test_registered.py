"""Registered queries without a SQL twin against brute force on the driver's tables, and the pipeline's stages on odd rows."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldweave.llm import bpe, packing, queries
from tests.llm.test_text_operators import LONG, PATTERN, RANKS, base_statistics, classes, plain_spans, words_of

ROOT = Path("/root/testdata")
SF = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_decision_list(spark, texts):
    got = {r["doc_id"]: r for r in queries.op3_decision_list(spark, SF).collect()}
    assert set(got) == {i for i, _ in texts}
    for i, t in texts:
        r, base = got[i], base_statistics(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_length_buckets(spark, texts):
    rows = queries.op5_length_buckets(spark, SF).collect()
    lengths = {i: len(words_of(t)) for i, t in texts}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == lengths and len(rows) == len(texts)
    batches = {}
    for r in rows:
        assert 0 <= r["padding"] == r["bucket_len"] - r["n_tokens"]
        batches.setdefault((r["bucket"], r["shard"], r["batch"]), []).append(r)
    for members in batches.values():
        assert sorted(m["slot"] for m in members) == list(range(members[0]["batch_rows"])) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0]["bucket_len"] <= 65_536
    count = Counter(lengths.values())
    exact = np.array(sorted(count))
    bounds = packing.choose_bounds(exact, np.array([count[x] for x in exact.tolist()]), 16)
    least = sum(n * min(b for b in bounds if b >= x) for x, n in count.items())
    assert least <= sum(r["bucket_len"] for r in rows) <= least * 129 / 128


def test_byte_bpe(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert sorted(tuple(r) for r in queries.op6_byte_bpe(spark, SF).collect()) == sorted(want)


def test_bayes_minhash(spark, texts):
    got = queries.op7_bayes_minhash(spark, SF).collect()
    assert sorted(str(tuple(r)) for r in got) == classes(texts, 2, (80, 100))


def test_crf_secrets(spark, texts):
    got = {r["doc_id"]: r for r in queries.op8_crf_secrets(spark, SF).collect()}
    for i, t in texts:
        base = plain_spans(t or "")
        told = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        r, kinds = got[i], Counter(k for _, k, _ in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        spans = [x.split(":") for x in filter(None, r["spans"].split(","))]
        assert [x for x in spans if x[0] != "crf"] == [[k, str(s), str(e)] for s, k, e in base]
        assert sum(x[0] == "crf" for x in spans) == r["n_crf"]
        covered = {p for s, _, e in base for p in range(s, e)}
        assert all(0 <= int(s) < int(e) <= len(t) and not covered & set(range(int(s), int(e))) for k, s, e in spans if k == "crf")


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_multiprobe(spark, size):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{ROOT}/{size}/embeddings.parquet").select("vec_id", "embedding").collect()]
    usable = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in usable]), np.array([v for _, v in usable], np.float64)
    norm = np.sqrt((x * x).sum(1))
    got = {}
    for r in queries.op10_multiprobe(spark, f"{ROOT}/{size}").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0).tolist():
        cosine = (x @ x[q]) / (norm * norm[q])
        order = sorted((-c, i) for c, i in zip(cosine.tolist(), ids.tolist(), strict=True) if i != ids[q])[:5]
        mine = got[int(ids[q])]
        assert sorted(mine) == [1, 2, 3, 4, 5] and all(abs(cosine[ids == v][0] - s) < 1e-12 for v, s in mine.values())
        assert list(mine.values()) == sorted(mine.values(), key=lambda e: (-e[1], e[0]))
        hits, total = hits + len({v for v, _ in mine.values()} & {i for _, i in order}), total + 5
    assert hits >= 0.95 * total


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named as the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("length(text) > 300").orderBy("doc_id").first()["text"]
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, LONG), (None, "a text without an id " * 5), (None, None), (10**6 + 4, base), (10**6 + 4, base)]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    for c in docs.columns[2:]:
        more = more.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    extra = {c: F.lit(i) for i, c in enumerate(("_mark", "_gone", "_order", "_block", "_known", "label", "rule", "n_words", "n_removed", "row", "kept"))}
    rows = docs.select(*docs.columns).unionByName(more.select(*docs.columns)).withColumns(extra)
    kept = rows
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = corpus_pipeline.stage(step(spark, kept, SF), name.replace(" ", "-"))
        assert sorted(kept.dtypes) == sorted(rows.dtypes), name
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert set(ids) <= before and {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3, None} <= set(ids), name
        assert kept.select(*extra).distinct().collect() == [tuple(range(len(extra)))], name
    text = {r["doc_id"]: r["text"] for r in kept.where("doc_id >= 1000000").collect()}
    assert text[10**6] is None and text[10**6 + 1] == "" and 10**6 + 4 not in text
    packed = corpus_pipeline.packed(spark, kept, SF)
    assert packed.count() == kept.count()
