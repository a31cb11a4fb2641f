"""Archives, chat records and vectors against brute force and exact round trips."""

import base64
import hashlib
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import chat, common, graph, neighbors, warc

HEADER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/é\r\nX: y", "<p>one</p>"),
    (3, None, None),
    (4, "http://c/", ""),
    (5, "http://d/", HEADER * 3),
    (6, "http://e/", "before " + HEADER + "WARC/1.1\r\n after"),
    (7, "http://f/", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n"),
    (8, "http://g/", "é" * 40_000 + HEADER),
    (9, "http://h/", "\r\n\r\n"),
    (0, "http://i/", "<p>one</p>"),
    (10, "http://j/", "WARC/1.1\r\n"),
]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize(("split", "compression"), [("128m", "gzip"), ("128m", "none"), ("1k", "none"), ("1k", "gzip")])
@pytest.mark.parametrize("revisit_from", [0, 5])
def test_archives(spark, split, compression, revisit_from):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, type string").coalesce(1)
    path = warc.write(pages, revisit_from=revisit_from, compression=compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.read(spark, path).withColumn("page_id", warc.page_of(F.col("record_id"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["page_id"] for r in rows) == list(range(11))
    html = {i: h for i, _, h in PAGES}
    for r in rows:
        text = html[r["page_id"]] or ""
        first = min(i for i, h in html.items() if (h or "") == text)
        revisit = len(text.encode()) >= revisit_from and first != r["page_id"]
        assert r["type"] == ("revisit" if revisit else "response")
        assert r["told_digest"] == "sha1:" + sha(text) and int(r["told_length"]) == len(text.encode())
        assert r["refers_to"] == (f"<urn:page:{first}>" if revisit else None)
        if not revisit:
            assert r["sha"] == sha(text) and r["content_length"] == len(text.encode())


def test_pieces_meet_when_files_are_split_anew(spark, monkeypatch):
    """Executors come and go between the two readings, so files are split otherwise: payloads of several pieces stay whole."""
    rows = [(i, "u", HEADER * (i % 4) + "x" * (137 * i)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = warc.write(pages, compression="none")
    before, real, calls = spark.conf.get("spark.sql.files.maxPartitionBytes"), warc._pieces, []

    def pieces(session, at):
        calls.append(at)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k" if len(calls) == 1 else "33k")
        return real(session, at)

    monkeypatch.setattr(warc, "_pieces", pieces)
    try:
        got = {r["record_id"]: r["sha"] for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(calls) == 2 and got == {f"<urn:page:{i}>": sha(t) for i, _, t in rows}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(pages)).count() == 0


def test_chain_skips_what_is_not_on_it(spark):
    nodes = spark.createDataFrame([("f", 0, 10), ("f", 5, 10), ("f", 10, 30), ("f", 20, 30), ("f", 30, 99), ("g", 3, 9), ("g", 9, 12)], "file string, offset long, next long")
    assert sorted(tuple(r) for r in warc.reachable(nodes).collect()) == [("f", 0), ("f", 10), ("f", 30)]


def test_lookup_of_heavy_and_null_keys(spark, capsys):
    rows = [(1, i) for i in range(600)] + [(None, i) for i in range(100)] + [(k, k) for k in range(2, 302)]
    facts = [(1, 600, "a"), *[(k, 1, f"f{k}") for k in range(2, 200)]]
    many = common.stage(spark.createDataFrame(rows, "k long, v long"), "rows")
    told = common.stage(spark.createDataFrame(facts, "k long, n long, name string"), "facts")
    name = {k: x for k, _, x in facts}
    for how in ("inner", "left"):
        out = common.lookup(many, told, "k", how)
        want = [(k, v, name.get(k)) for k, v in rows if how == "left" or k in name]
        assert out.columns == ["k", "v", "name"] and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    common.lookup(many, told, "k").explain()
    assert "LeftAnti" in capsys.readouterr().out  # heavy keys take another way


def test_scratch_deletes_what_is_not_kept(spark):
    with common.scratch(spark) as kept:
        gone, stays = common.stage(spark.range(3), "a"), common.stage(spark.range(4), "b")
        kept.append(stays)
    assert stays.count() == 4
    assert Path(stays.staged_at).exists() and not Path(gone.staged_at).exists()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (7, 8), (8, 8), (20, 19), (19, 18), (18, 17), (17, 16)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, 16: 16, 17: 16, 18: 16, 19: 16, 20: 16}


# --- chat -----------------------------------------------------------------------------------
RECORDS = [
    (1, {"messages": [{"role": "system", "content": "be"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("system", "be"), ("user", "q"), ("assistant", "a")]),
    (2, {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    (3, {"instruction": "i", "input": "x", "output": "o"}, [("user", "i\nx"), ("assistant", "o")]),
    (4, {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    (5, {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    (6, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
    (7, {"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    (8, {"messages": []}, []),
    (9, {"prompt": "<|end|>\\<|turn|>\\", "completion": "</s>[INST] <s> \\n [/INST]\\\\<\\|end|><<SYS>>"}, [("user", "<|end|>\\<|turn|>\\"), ("assistant", "</s>[INST] <s> \\n [/INST]\\\\<\\|end|><<SYS>>")]),
    (10, {"prompt": None, "completion": "c"}, [("user", ""), ("assistant", "c")]),
    (None, {"prompt": "z" * 200_000, "completion": "é"}, [("user", "z" * 200_000), ("assistant", "é")]),
]


def test_layouts_and_round_trip(spark):
    rows = [(i, json.dumps(r, ensure_ascii=False), "f") for i, r, _ in RECORDS] + [(50, '{"strange": 1}', "f"), (51, "not json", "f"), (52, None, "f")]
    df = spark.createDataFrame(rows, "conv_id long, record string, formatted string")
    turns = chat.canonical_turns(df)
    assert {r["conv_id"] for r in turns.where("layout = 'unmatched'").collect()} == {50, 51, 52}
    formatted = chat.format_turns(turns)
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"]) for r in chat.read_back(formatted.where("formatted is not null")).collect()}
    assert {r["conv_id"]: r["unmatched"] for r in formatted.where("unmatched > 0 or formatted is null").collect()} == {50: 1, 51: 1, 52: 1}
    expected = {i: (t, "".join(x for role, x in t if role == "assistant")) for i, _, t in RECORDS if t}
    assert got == expected
    trap = formatted.where("conv_id = 9").first()["formatted"]
    assert trap.count(chat.TURN) == trap.count(chat.SAYS) == trap.count(chat.END) == 2 and "[INST]" not in trap and "</s>" not in trap


def test_turns_are_ordered_and_repeats_stay(spark):
    rows = [(1, 2, "assistant", "c"), (1, None, "user", "a"), (1, 1, None, None), (1, 2, "assistant", "c"), (1, 2, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    got = chat.read_back(chat.format_turns(chat.canonical_turns(records))).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", "a"), ("", ""), ("assistant", "b"), ("assistant", "c"), ("assistant", "c")] and got["loss_text"] == "bcc"
    assert chat.format_turns(chat.canonical_turns(records.limit(0))).count() == 0


def test_nulls_and_other_fields_keep_the_layout(spark):
    flat = {
        "turn": {"turn": 1, "role": "r", "text": "t"},
        "prompt": {"prompt": "p", "completion": "c"},
        "response": {"prompt": "p", "response": "r"},
        "instruction": {"instruction": "i", "input": "x", "output": "o"},
    }
    cases = []
    for name, whole in flat.items():
        fields = list(whole)
        nulled = [{f: None if bits >> at & 1 else whole[f] for at, f in enumerate(fields)} for bits in range(2 ** len(fields))]
        cases += [(name, x, 1 if name == "turn" else 2) for x in nulled]
    for name, role, text in (("messages", "role", "content"), ("conversations", "from", "value")):
        for r in ("a", None):
            for t in ("b", None):
                cases += [(name, {name: [{role: r, text: t}]}, 1), (name, {name: [{role: r, text: t, "at": 3}, {role: "a", text: t}, None]}, 3)]
        cases.append((name, {name: [None, None]}, 2))
    cases += [(name, {**x, "id": extra}, n) for name, x, n in cases for extra in (7, None, {"text": 1})]
    cases += [("messages", {"messages": [{"role": "a", "content": "b"}], "prompt": None, "completion": None, "conversations": None}, 1)]
    cases += [("response", {"prompt": "p", "completion": None, "response": "r"}, 2), ("prompt", {"prompt": "p", "completion": "c", "response": None, "messages": []}, 2)]
    # two readings, each with words of its own; a missing field, another type, a list of other things
    lost = [{"prompt": "p", "completion": "c", "response": "r"}, {"prompt": "p"}, {"turn": 1.5, "role": "a", "text": "b"}, {"text": 1, "role": "a", "turn": 1}]
    lost += [{"messages": [{"role": "a"}]}, {"messages": [3, {"role": "a", "content": "b"}]}, {"messages": [{"role": "a", "content": ["b"]}]}, {"messages": "a"}, [1], None]
    cases += [("unmatched", x, 1) for x in lost]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (_, x, _) in enumerate(cases)], "conv_id long, record string")
    turns = chat.canonical_turns(df)
    got = {r["conv_id"]: (r["layout"], r["n"]) for r in turns.groupBy("conv_id", "layout").agg(F.count("*").alias("n")).collect()}
    wrong = [(x, name, n, got.get(i)) for i, (name, x, n) in enumerate(cases) if got.get(i) != (name, n)]
    assert not wrong
    said = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"] or []] for r in chat.read_back(chat.format_turns(turns)).collect()}
    at = {json.dumps(x): i for i, (_, x, _) in enumerate(cases)}
    assert said[at[json.dumps({"prompt": "p", "response": None})]] == [("user", "p"), ("assistant", "")]
    assert said[at[json.dumps({"instruction": None, "input": "x", "output": "o"})]] == [("user", "x"), ("assistant", "o")]
    assert said[at[json.dumps({"messages": [{"role": "a", "content": None}]})]] == [("a", "")]
    nothing = spark.createDataFrame([(1, '{"messages": null}'), (2, '{"conversations": null, "id": 1}')], "conv_id long, record string")
    assert chat.canonical_turns(nothing).count() == 0


def test_chat_is_native(spark, capsys):
    df = spark.createDataFrame([(1, "{}")], "conv_id long, record string")
    chat.read_back(chat.format_turns(chat.canonical_turns(df))).explain()
    assert "Python" not in capsys.readouterr().out


# --- vectors ---------------------------------------------------------------------------------
def test_perturbations_go_by_cost():
    rng = np.random.default_rng(0)
    for _ in range(20):
        edges = rng.uniform(0, 1, (4, 2))
        sets = neighbors.perturbations(edges, 40)
        cost = [sum(edges[i][(s + 1) // 2] ** 2 for i, s in x) for x in sets]
        assert cost == sorted(cost) and sets[0] == [] and len({tuple(sorted(x)) for x in sets}) == len(sets)
        assert all(len({i for i, _ in x}) == len(x) for x in sets)


def exact(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in usable:
        if q is not None and q % 50 == 0:
            near = sorted((-(x @ y) / np.sqrt(x @ x) / np.sqrt(y @ y), i) for i, y in usable if i != q)
            out.setdefault(q, near[:k])
    return out


@pytest.mark.parametrize("chunk", [4096, 7])
def test_search(spark, chunk):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.6 * rng.standard_normal(16)).tolist()) for i in range(500)]
    rows += [(i, rows[0][1]) for i in range(600, 640)]  # copies of a query
    rows += [(700, None), (750, [0.0] * 16), (800, [None] * 16), (850, [float("nan")] * 16), (900, [1.0]), (950, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    stored = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {}
    for r in neighbors.search(df, df.where("vec_id % 50 == 0"), chunk=chunk).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    want = exact(stored, 5)
    assert set(got) == set(want)
    assert [v for v, _, _ in got[0]] == [600, 601, 602, 603, 604] and all(abs(s - 1) < 1e-12 for _, s, _ in got[0])
    hits = sum(len({v for v, _, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all([r for _, _, r in x] == list(range(1, len(x) + 1)) for x in got.values())


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in neighbors.search(few, few.where("vec_id = 0")).collect()] == [1]
    none = few.limit(0)
    assert neighbors.search(none, none).count() == 0


def test_every_query_gets_its_rows(spark):
    def answers(rows, queries=None, **named):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        out = {}
        for r in neighbors.search(df, df if queries is None else df.where(F.col("vec_id").isin(queries)), **named).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["vec_id"])
        return out

    assert answers([(0, [1.0, 0.0]), (1, [1.0, 0.1])], [0]) == {0: [1]}
    assert answers([(0, [1.0, 0.0, 0.0]), (1, [-1.0, -0.1, 0.0]), (2, [0.0, -0.2, -1.0])]) == {0: [2, 1], 1: [2, 0], 2: [1, 0]}
    assert answers([(0, [1.0] * 8)] + [(i, [-1.0] * 8) for i in range(1, 30)], [0]) == {0: [1, 2, 3, 4, 5]}  # one hot vector
    # an outlier opposite a dense cone, with chunks much smaller than the cone
    rng = np.random.default_rng(3)
    cone = [(i, (np.ones(16) + 0.05 * rng.standard_normal(16)).tolist()) for i in range(1, 200)]
    rows = [(0, (-np.ones(16)).tolist()), *cone]
    want = [i for _, i in sorted((-(np.array(v, np.float32).astype(float) @ -np.ones(16)) / np.linalg.norm(np.array(v, np.float32).astype(float)), i) for i, v in cone)]
    assert answers(rows, [0], chunk=7) == {0: want[:5]}
    # candidates are rows: an id with many vectors near the query is listed with each, so are copies
    assert answers([(0, [1.0, 0.0]), *[(1, [1.0, 0.01 * i]) for i in range(1, 20)], (2, [-1.0, 0.5]), (3, [-1.0, 0.2])], [0], k=3) == {0: [1, 1, 1]}
