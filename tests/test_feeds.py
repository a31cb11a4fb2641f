"""End to end over miniature feeds: plain and zipped documents, an advisory tree and its archive."""

import json
import random
import tarfile
import zipfile

import pytest

from fieldweave.operators import coverage
from fieldweave.operators.align import align, counted, match_counts, one_to_one, one_to_one_of
from fieldweave.operators.normalize import ghsa_records, nvd_records
from fieldweave.plans import cli
from fieldweave.sources import feeds
from fieldweave.streaming.incremental import advisory_stream, append_records


def cve(name, **more):
    return {"cve": {"id": name, "published": "2023-05-01T10:00:00.000", "lastModified": "2023-06-01", "vulnStatus": "Analyzed"} | more}


def match(**more):
    return {"criteria": "cpe:2.3:a:acme:tool:1.0:*:*:*:*:*:*:*", "vulnerable": True} | more


RICH = cve(
    "CVE-2023-0001",
    descriptions=[{"lang": "es", "value": "hola"}, {"lang": "en", "value": ""}, {"lang": "en", "value": "text"}],
    metrics={
        "cvssMetricV40": [],
        "cvssMetricV31": [
            {"source": "x", "type": "Secondary", "cvssData": {"baseScore": 1.0, "baseSeverity": "LOW", "vectorString": "a"}},
            {"source": "y", "type": "Primary", "cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL", "vectorString": "b"}},
        ],
        "cvssMetricV2": [{"source": "z", "type": "Primary", "cvssData": {"baseScore": 5.0}}],
    },
    weaknesses=[{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}, {"description": [{"lang": "en", "value": "CWE-79"}]}],
    references=[{"url": "https://User@EX.com:8/a", "source": "s", "tags": ["t"]}, {"url": ""}],
    configurations=[
        {"nodes": [{"cpeMatch": [match(versionStartExcluding="1.0")], "children": [{"cpeMatch": [match(criteria="cpe:2.3:a:b")], "children": [{"children": [{"cpeMatch": [match(criteria=None)]}]}]}]}]},
        {"nodes": []},
    ],
)


def advisory(name, aliases, **more):
    return {"id": name, "aliases": aliases, "summary": "s", "published": "2023-05-01T10:00:00Z", "modified": "2023-05-02T10:00:00Z"} | more


ADVISORIES = {
    "advisories/github-reviewed/2023/05/GHSA-1/GHSA-1.json": advisory(
        "GHSA-1",
        ["GHSA-x", "CVE-2023-0001", "CVE-2023-0009"],
        severity=[{"type": "CVSS_V3", "score": "vec"}],
        database_specific={"severity": "MODERATE", "cwe_ids": ["CWE-9", "CWE-1", "CWE-9"], "github_reviewed": True},
        references=[{"type": "WEB", "url": "https://ex.com/a"}],
        affected=[
            {"package": {"name": "p", "ecosystem": "npm"}},
            {"package": {"name": "q", "ecosystem": "npm"}, "versions": ["1", "2"]},
            {"package": {"name": "r", "ecosystem": "npm"}, "versions": ["1", "2"], "ranges": [{"events": [{"introduced": "0"}, {"fixed": "2"}, {"introduced": "3"}]}, {"events": [{"introduced": "5"}]}]},
        ],
    ),
    "advisories/github-reviewed/2023/05/GHSA-2/GHSA-2.json": advisory("GHSA-2", ["CVE-2023-0002"]),
    "advisories/github-reviewed/2024/05/GHSA-3/GHSA-3.json": advisory("GHSA-3", ["CVE-2023-0002"]),
    "advisories/github-reviewed/2024/05/GHSA-4/GHSA-4.json": advisory("GHSA-4", []),
    "advisories/unreviewed/2024/05/GHSA-5/GHSA-5.json": advisory("GHSA-5", ["CVE-2023-0003"]),
}


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "nvdcve-2.0-2023.json").write_text(json.dumps({"vulnerabilities": [RICH, cve("CVE-2023-0002"), cve("CVE-2023-0002"), cve("CVE-2023-0003")]}))
    for year, rows in (("2023", []), ("2024", [cve("CVE-2024-0001")])):
        with zipfile.ZipFile(root / f"nvdcve-2.0-{year}.json.zip", "w") as z:
            z.writestr(f"nvdcve-2.0-{year}.json", json.dumps({"vulnerabilities": rows}))
    for path, body in ADVISORIES.items():
        target = root / "tree" / path
        target.parent.mkdir(parents=True)
        target.write_text(json.dumps(body))
    with tarfile.open(root / "a.tar.gz", "w:gz") as tar:
        tar.add(root / "tree", arcname="root-1")
    return root


def test_plain_goes_before_zip(spark, raw):
    assert [f.rsplit("/", 1)[-1] for f in feeds.feed_files(spark, str(raw))] == ["nvdcve-2.0-2023.json", "nvdcve-2.0-2024.json.zip"]
    with pytest.raises(FileNotFoundError):
        feeds.feed_files(spark, str(raw), "none-*")


def test_nvd_record(spark, raw):
    rows = nvd_records(feeds.read_feed(spark, feeds.feed_files(spark, str(raw)))).orderBy("cve_id").collect()
    assert [r["cve_id"] for r in rows] == ["CVE-2023-0001", "CVE-2023-0002", "CVE-2023-0002", "CVE-2023-0003", "CVE-2024-0001"]
    r = rows[0]
    assert r["summary"] == "text" and r["cwe_ids"] == ["CWE-79"] and r["aliases"] == ["CVE-2023-0001"]
    assert tuple(r["severity"]) == ("cvssMetricV31", 9.8, "CRITICAL", "b", "y")
    assert [(x["url"], x["host"], x["tags"]) for x in r["references"]] == [("https://User@EX.com:8/a", "user@ex.com:8", ["t"]), ("", None, [])]
    assert [(a["vendor"], a["product"], a["version"], a["introduced"]) for a in r["affected"]] == [("acme", "tool", "1.0", "1.0"), ("b", None, None, None), (None, None, None, None)]
    assert rows[1]["severity"]["metric_key"] is None and rows[1]["references"] == []


def test_ghsa_record(spark, raw):
    rows = {r["source_id"]: r for r in ghsa_records(feeds.read_advisory_tree(spark, str(raw / "tree"))).collect()}
    assert set(rows) == {"GHSA-1", "GHSA-2", "GHSA-3", "GHSA-4"}
    r = rows["GHSA-1"]
    assert r["cve_id"] == "CVE-2023-0001" and r["cwe_ids"] == ["CWE-1", "CWE-9", "CWE-9"] and rows["GHSA-4"]["cve_id"] is None
    assert tuple(r["severity"]) == ("CVSS_V3", None, "MODERATE", "vec", "github-advisory-database")
    assert [(a["package_name"], a["version"], a["introduced"], a["fixed"], a["version_end_excluding"]) for a in r["affected"]] == [
        ("p", None, None, None, None),
        ("r", "2", "0", "2", "2"),
        ("r", "2", "5", None, None),
    ]
    assert r["source_specific"]["relative_path"].startswith("advisories/github-reviewed/2023/")


def test_archive_equals_tree(spark, raw):
    for flag in (False, True):
        tree = ghsa_records(feeds.read_advisory_tree(spark, str(raw / "tree"), flag))
        tar = ghsa_records(feeds.read_advisory_archive(spark, str(raw / "a.tar.gz"), flag))
        assert sorted(map(str, tree.collect())) == sorted(map(str, tar.collect()))
        assert tree.count() == 4 + flag
    assert feeds.is_valid_archive(spark, str(raw / "a.tar.gz")) and not feeds.is_valid_archive(spark, str(raw / "nvdcve-2.0-2023.json"))
    assert feeds.is_valid_tree(spark, str(raw / "tree")) and not feeds.is_valid_tree(spark, str(raw))


def test_alignment(spark, raw):
    nvd = nvd_records(feeds.read_feed(spark, feeds.feed_files(spark, str(raw))))
    aligned = align(nvd, ghsa_records(feeds.read_advisory_tree(spark, str(raw / "tree"))))
    got = sorted((r["cve_id"], [g["source_id"] for g in r["ghsa"]]) for r in aligned.collect())
    both = ["GHSA-2", "GHSA-3"]
    assert got == [("CVE-2023-0001", ["GHSA-1"]), ("CVE-2023-0002", both), ("CVE-2023-0002", both), ("CVE-2023-0003", []), ("CVE-2024-0001", [])]
    assert tuple(match_counts(aligned).first()) == (5, 3, 2)
    assert [r["cve_id"] for r in one_to_one(aligned).collect()] == ["CVE-2023-0001"]
    ghsa = ghsa_records(feeds.read_advisory_tree(spark, str(raw / "tree")))
    assert one_to_one_of(nvd, ghsa).collect() == one_to_one(aligned).collect()
    assert match_counts(counted(nvd, ghsa)).collect() == match_counts(aligned).collect()
    assert coverage.year_coverage(counted(nvd, ghsa)).collect() == coverage.year_coverage(aligned).collect()
    assert sorted(coverage.presence_of(nvd, ghsa).collect()) == sorted(coverage.presence(aligned).collect())


def test_nodes_of_any_depth(spark, tmp_path):
    def nested(depth, at=0):
        own = {"cpeMatch": [match(criteria=f"cpe:2.3:a:v:p:{at}")]}
        return own | ({"children": [nested(depth, at + 1)]} if at < depth else {})

    deep = cve("CVE-2023-0001", configurations=[{"nodes": [nested(11)]}, {"nodes": [nested(1)]}])
    (tmp_path / "nvdcve-2.0-2023.json").write_text(json.dumps({"vulnerabilities": [deep, cve("CVE-2023-0002")]}))
    with zipfile.ZipFile(tmp_path / "nvdcve-2.0-2024.json.zip", "w") as z:
        z.writestr("nvdcve-2.0-2024.json", json.dumps({"vulnerabilities": [deep]}))
    for glob in ("*2023*", "*2024*"):
        rows = nvd_records(feeds.read_feed(spark, feeds.feed_files(spark, str(tmp_path), glob))).where("cve_id = 'CVE-2023-0001'").collect()
        assert [a["version"] for r in rows for a in r["affected"]] == [*map(str, range(12)), "0", "1"]


def test_command_line(spark, raw, tmp_path):
    manifest = cli.build_corpus(spark, str(raw), str(tmp_path), "nvdcve-2.0-*.json*", "", str(raw / "tree"), False)
    assert manifest == {
        "nvd_files": ["nvdcve-2.0-2023.json", "nvdcve-2.0-2024.json.zip"],
        "nvd_records": 5,
        "nvd_year_counts": {"2023": 4, "2024": 1},
        "ghsa_records": 4,
        "ghsa_year_counts": {"2023": 2, "2024": 2},
        "aligned_rows": 5,
        "matched_rows": 3,
        "include_unreviewed": False,
    }
    stats = cli.build_discrepancies(spark, str(tmp_path / "aligned_by_cve.jsonl"), str(tmp_path / "d"))
    assert stats["processed_pairs"] == 1 and stats["fields"]["severity"]["factual_conflict"] == 1
    assert all(sum(v.values()) == 1 for v in stats["fields"].values())
    summary = cli.build_coverage(spark, str(tmp_path / "aligned_by_cve"), str(tmp_path / "d"))
    assert summary["matched_rows"] == 3 and summary["field_coverage"]["severity"]["nvd_nonempty"] == 1
    assert summary["year_summary"]["2023"] == {"total_rows": 4, "matched_rows": 3, "matched_rate": 0.75}
    assert "| 2023 | 4 | 3 | 75.0000% |" in (tmp_path / "d" / "field_coverage.md").read_text()


def test_without_advisories(spark, raw, tmp_path):
    manifest = cli.build_corpus(spark, str(raw), str(tmp_path), "nvdcve-2.0-*.json*", "", str(raw), False)
    assert manifest["nvd_records"] == 5 and manifest["aligned_rows"] == manifest["ghsa_records"] == 0


def test_empty_aligned_input(spark, raw):
    from fieldweave.operators.coverage import summary
    from fieldweave.schemas import ALIGNED

    got = summary(spark.createDataFrame([], ALIGNED))
    assert got["matched_rate"] == 0.0 and all(v == 0 for f in got["field_coverage"].values() for v in f.values())


def test_stream_appends_once(spark, raw, tmp_path):
    for _ in range(2):
        records = advisory_stream(spark, str(raw / "tree" / "advisories" / "github-reviewed"))
        append_records(records, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_archives_stream_in_batches_and_tell_what_is_broken(spark, tmp_path, monkeypatch):
    from fieldweave.sources import archive

    monkeypatch.setattr(archive, "BATCH_BYTES", 2**12)  # as if the archive were a thousand times as large
    rng = random.Random(3)
    for i in range(300):
        target = tmp_path / f"tree/advisories/github-reviewed/2024/{i % 12:02}/GHSA-{i}/GHSA-{i}.json"
        target.parent.mkdir(parents=True)
        target.write_text(json.dumps(advisory(f"GHSA-{i}", [f"CVE-2024-{i}"]) | {"summary": "".join(rng.choices("abcdefghij", k=400))}))
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "tree", arcname="root-1")
    reader = archive.Members({"path": str(tmp_path / "a.tar.gz"), "suffix": ".json"})
    sizes = [batch.num_rows for batch in reader.read(None)]
    assert sum(sizes) == 300 and max(sizes) < 20
    tree, tar = (f(spark, str(tmp_path / p)) for f, p in ((feeds.read_advisory_tree, "tree"), (feeds.read_advisory_archive, "a.tar.gz")))
    assert sorted(map(str, ghsa_records(tree).collect())) == sorted(map(str, ghsa_records(tar).collect()))
    whole = (tmp_path / "a.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(whole[: len(whole) // 2])
    assert feeds.is_valid_archive(spark, str(tmp_path / "a.tar.gz")) and not feeds.is_valid_archive(spark, str(tmp_path / "cut.tar.gz"))
    for broken in ("cut.tar.gz", "tree/advisories/github-reviewed/2024/00/GHSA-0/GHSA-0.json"):
        with pytest.raises(FileNotFoundError):
            feeds.read_advisories(spark, None, str(tmp_path / broken))
    with tarfile.open(tmp_path / "none.tar.gz", "w:gz"):
        pass
    with pytest.raises(FileNotFoundError):
        feeds.read_advisory_archive(spark, str(tmp_path / "none.tar.gz"))


def test_a_feed_is_parsed_once(spark, raw, tmp_path, monkeypatch):
    readings = []
    real = feeds._read_feed
    monkeypatch.setattr(feeds, "_read_feed", lambda spark, files, depth: readings.append(depth) or real(spark, files, depth))
    counts = feeds.write_feed_records(spark, feeds.feed_files(spark, str(raw)), str(tmp_path / "nvd"))
    assert counts == {"2023": 4, "2024": 1} and len(readings) == 1
    nested = {"cpeMatch": [match(criteria="cpe:2.3:a:v:p:1")]}
    for _ in range(9):
        nested = {"cpeMatch": [], "children": [nested]}
    (tmp_path / "nvdcve-2.0-2023.json").write_text(json.dumps({"vulnerabilities": [cve("CVE-2023-0001", configurations=[{"nodes": [nested]}])]}))
    readings.clear()
    assert feeds.write_feed_records(spark, feeds.feed_files(spark, str(tmp_path), "*2023*"), str(tmp_path / "deep")) == {"2023": 1} and len(readings) == 2
    assert [a["version"] for r in spark.read.parquet(str(tmp_path / "deep")).collect() for a in r["affected"]] == ["1"]


def test_members_are_read_piece_by_piece():
    import io

    found = [{"cve": {"id": f"CVE-{i}", "s": 'a "q" ]}, \\ é' * (i % 50), "n": [1, 2, {"vulnerabilities": [i]}]}} for i in range(40)] + [12, 1.5, None, "x"]
    document = {"format": "f", "vulnerabilities_": [0], "total": 12, "vulnerabilities": found, "after": {"vulnerabilities": [7]}}
    for chunk in (1, 7, 2**20):
        for text in (json.dumps(document), json.dumps(document, indent=2, ensure_ascii=False)):
            assert [json.loads(m) for m in feeds.members_of(io.StringIO(text), "vulnerabilities", chunk)] == found
        for empty in ("{}", " { } ", '{"vulnerabilities": []}', '{"vulnerabilities": null, "x": 1}'):
            assert list(feeds.members_of(io.StringIO(empty), "vulnerabilities", chunk)) == []
        for broken in ("", "[", '{"vulnerabilities": [{"a": 1}', '{"vulnerabilities": [{"a": 1},]}', '{"vulnerabilities": [1] "x": 2}', '{"a" 1}'):
            with pytest.raises(ValueError):
                list(feeds.members_of(io.StringIO(broken), "vulnerabilities", chunk))
