"""Registered queries over the driver tables, one for each operator family.

Arrays are joined into strings, so that results compare by value in any engine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave import constants as K
from fieldweave.functions import text, urls, versions
from fieldweave.operators import align as al
from fieldweave.operators import compare, coverage, normalize
from fieldweave.operators.once import once
from fieldweave.plans import adapter
from fieldweave.sources.feeds import advisory_year_counts, choose_files, feed_year_counts, read_records
from fieldweave.sources.sinks import write_jsonl
from fieldweave.staging import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return adapter.left_records(spark, sf_dir), adapter.right_records(spark, sf_dir)


def _told(records: DataFrame, *fields: str) -> DataFrame:
    """Records as far as a query reads them, with what alignment needs: the rest does not move."""
    return records.select("cve_id", *fields)


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


def _keyed(pairs: DataFrame, result: Column, *extra: str, keys: tuple[str, ...] = (*adapter.KEYS, "cve_id")) -> DataFrame:
    staged = pairs.select(*keys, result.alias("r"))
    return staged.select(*keys, F.col("r.status").alias("status"), F.col("r.note").alias("note"), *[F.expr(e) for e in extra])


def _compared(spark: SparkSession, sf_dir: str, field: str, raw: dict[str, tuple[str, ...]], *extra: str) -> DataFrame:
    """A comparison of all pairs that follows from scalars ``raw`` of both sides: equal values are compared once."""

    def judge(rows: DataFrame) -> DataFrame:
        return _keyed(compare.normalized(adapter.records_of(rows)), compare.discrepancies()[field], *extra, keys=tuple(rows.columns))

    rows = adapter.raw_pairs(spark, sf_dir)
    told = once(rows, [adapter.raw_values(spark, sf_dir, *names) for names in raw.values()], judge)
    return told.select(*adapter.KEYS, "cve_id", *[c for c in told.columns if c not in rows.columns])


def align_left_join(spark, sf_dir):
    """Every order with its lines in path order."""
    left, right = _sides(spark, sf_dir)
    a = al.align(_told(left), _told(right, "source_id", F.struct("severity.label").alias("severity"), F.struct("source_specific.relative_path").alias("source_specific")))
    labels = F.transform("ghsa", lambda g: F.coalesce(g["severity"]["label"], F.lit("-")))
    paths = F.transform("ghsa", lambda g: g["source_id"])
    return a.select("cve_id", F.size("ghsa").cast("long").alias("n_ghsa"), _joined(labels).alias("labels"), _joined(paths).alias("paths"))


def align_matched_counts(spark, sf_dir):
    counts = al.match_counts(al.counted(*_sides(spark, sf_dir)))
    return counts.select(
        "*",
        (F.col("total_rows") - F.col("matched_rows")).alias("unmatched_rows"),
        text.ratio(F.col("matched_rows"), F.col("total_rows")).alias("matched_rate"),
        text.ratio(F.col("multi_rows"), F.col("matched_rows")).alias("multi_rate"),
    )


def align_coverage_docs(spark, sf_dir):
    """Documents left-joined with their labels: totals by language, with partial coverage."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lists = labels.groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("n"))
    joined = docs.join(lists, docs["doc_id"] == lists["_key"], "left")
    return joined.groupBy("lang").agg(F.count("*").alias("total_rows"), F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("matched_rows"))


def one_to_one_pairs(spark, sf_dir):
    left, right = (_told(s, F.struct("severity.label").alias("severity"), "published") for s in _sides(spark, sf_dir))
    pairs = al.one_to_one_of(left, right)
    return pairs.select("cve_id", F.col("nvd.severity.label").alias("nvd_label"), F.col("ghsa.severity.label").alias("ghsa_label"), F.col("ghsa.published").alias("ghsa_published"))


def year_match_rate(spark, sf_dir):
    return coverage.year_coverage(al.counted(*_sides(spark, sf_dir)))


def field_presence(spark, sf_dir):
    return coverage.field_coverage(coverage.presence_of(*_sides(spark, sf_dir)))


def severity_canonical(spark, sf_dir):
    pairs = adapter.all_pairs(spark, sf_dir)
    nvd, ghsa = (text.canonical_severity(F.col(f"{s}.severity.label"), K.SEVERITY) for s in ("nvd", "ghsa"))
    return pairs.select(nvd.alias("nvd_canonical"), ghsa.alias("ghsa_canonical")).groupBy("nvd_canonical", "ghsa_canonical").agg(F.count("*").alias("pairs"))


def cmp_severity(spark, sf_dir):
    return _keyed(compare.normalized(adapter.all_pairs(spark, sf_dir)), compare.discrepancies()["severity"], "r.rank_distance AS rank_distance")


def cmp_published(spark, sf_dir):
    pairs = compare.normalized(adapter.all_pairs(spark, sf_dir))
    return _keyed(pairs, compare.discrepancies()["published"], "r.day_diff AS day_diff")


def cmp_cwe(spark, sf_dir):
    pairs = compare.normalized(adapter.all_pairs(spark, sf_dir))
    return _keyed(pairs, compare.discrepancies()["cwe_ids"], "array_join(r.nvd_value, '|') AS nvd_value", "array_join(r.ghsa_value, '|') AS ghsa_value", "array_join(r.shared_values, '|') AS shared_values")


def cmp_references(spark, sf_dir):
    return _compared(
        spark, sf_dir, "references", adapter.LINKS,
        "array_join(r.nvd_value, '|') AS nvd_value", "array_join(r.ghsa_hosts, '|') AS ghsa_hosts", "array_join(r.shared_values, '|') AS shared_values",
    )


def cmp_affected(spark, sf_dir):
    pairs = compare.normalized(adapter.all_pairs(spark, sf_dir))
    return _keyed(pairs, compare.discrepancies()["affected_versions"])


def discrepancy_stats(spark, sf_dir):
    """Status counts of all five fields over every pair."""
    pairs = adapter.all_pairs(spark, sf_dir).select("cve_id", "nvd", "ghsa")
    return compare.status_totals(pairs)


def discrepancy_stats_one_to_one(spark, sf_dir):
    """Status counts over the pairs that alignment leaves one to one."""
    left, right = (compare.needed(s) for s in _sides(spark, sf_dir))
    return compare.status_totals(al.one_to_one_of(left, right))


def unified_view_flat(spark, sf_dir):
    """The unified view of every pair as plain columns; equal links, spans and weaknesses of a side are normalized once."""
    v = F.col("v")
    of_side = {
        "nvd": {
            "nvd_cwe": _joined(v["cwe_ids"]["nvd"]), "nvd_urls": _joined(v["references"]["nvd_urls"]), "nvd_hosts": _joined(v["references"]["nvd_hosts"]),
            "nvd_packages": _joined(v["package_names"]["nvd"]),
        },
        "ghsa": {
            "ghsa_cwe": _joined(v["cwe_ids"]["ghsa"]), "ghsa_urls": _joined(v["references"]["ghsa_urls"]), "ghsa_packages": _joined(v["package_names"]["ghsa"]),
            "ghsa_spans": F.size(v["affected_versions"]["ghsa"]).cast("long"),
        },
    }

    def viewed(rows: DataFrame, told: dict[str, Column]) -> DataFrame:
        views = compare.normalized(adapter.records_of(rows)).select(*rows.columns, compare.unified_view().alias("v"))
        return views.select(*rows.columns, *[c.alias(k) for k, c in told.items()])

    rows = adapter.raw_pairs(spark, sf_dir)
    for side, told in of_side.items():
        names = (*adapter.WEAKNESSES[side], *adapter.LINKS[side], *adapter.SPANS[side])
        # the normalized columns that stand between have names of the result
        told = {f"told_{k}": c for k, c in told.items()}
        rows = once(rows, [adapter.raw_values(spark, sf_dir, *names)], lambda df, told=told: viewed(df, told))
    own = {
        "nvd_severity": v["severity"]["nvd"]["canonical_label"], "ghsa_severity": v["severity"]["ghsa"]["canonical_label"],
        "nvd_published": v["published"]["nvd"], "ghsa_published": v["published"]["ghsa"],
    }
    told = ("nvd_cwe", "ghsa_cwe", "nvd_urls", "ghsa_urls", "nvd_hosts", "nvd_packages", "ghsa_packages", "ghsa_spans")
    return viewed(rows, own).select(*adapter.KEYS, *own, *[F.col(f"told_{k}").alias(k) for k in told])


def url_canonical(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.host(F.col("url")).alias("host"))


def url_host_counts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def reference_set_per_host(spark, sf_dir):
    """The set of canonical URLs of each host, a row for each."""
    pages = _table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), urls.canonical_url(F.col("url")).alias("u"))
    return pages.where("u is not null").groupBy("host", F.col("u").alias("url")).agg(F.count("*").alias("pages"))


def href_extract(spark, sf_dir):
    """Links of every page as references: in order, with hosts."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    none = F.lit(None)
    refs = normalize.references(F.transform(links, lambda u: F.struct(u.alias("url"), none.cast("string").alias("source"), none.cast("array<string>").alias("tags"))))
    out = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(refs).alias("pos", "ref"))
    return out.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("ref.url").alias("url"), F.coalesce("ref.host", F.lit("")).alias("host"))


def text_normalize(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    norm = text.normalize_text(F.col("text"))
    return docs.select("doc_id", F.md5(norm.cast("binary")).alias("normalized_md5"), norm.isNotNull().alias("present"))


def prefix_filter(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    rows = parts.where(F.col("p_name").startswith("red ") | F.col("p_name").startswith("blue "))
    return rows.where(text.truthy(F.col("p_brand"))).groupBy("p_brand").agg(F.count("*").alias("parts"))


def cpe_split(spark, sf_dir):
    size = F.col("p_size").cast("string")
    head = F.concat(F.lit("cpe:2.3:a:"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("_")))
    cpe = F.when(F.col("p_size") % 5 == 0, head).otherwise(F.concat(head, F.lit(":"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("1."), size)), F.lit(":*:*")))
    c = F.col("criteria")
    return _table(spark, sf_dir, "part").select("p_partkey", cpe.alias("criteria")).select(
        "p_partkey", text.cpe_part(c, 3).alias("vendor"), text.cpe_part(c, 4).alias("product"), text.cpe_part(c, 5).alias("version")
    )


def metric_choice(spark, sf_dir):
    """Events as score entries: the preferred metric and its chosen entry for each user."""
    kind = normalize.K.METRIC_KEYS
    e = _table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    key = F.col("event_id") % 4
    primary = F.when(F.col("event_id") % 5 == 0, K.PRIMARY_TYPE).otherwise("Secondary")
    source = F.when(F.col("event_id") % 7 == 0, K.PRIMARY_SOURCE).otherwise("other")
    data = F.struct(F.col("value").alias("baseScore"), F.col("event_type").alias("baseSeverity"), F.lit(None).cast("string").alias("vectorString"))
    entry = F.struct(source.alias("source"), primary.alias("type"), data.alias("cvssData"))
    # a user's events of one day make one record, so lists stay short
    lists = e.groupBy("user_id", F.to_date("ts").alias("day"))
    agg = [F.transform(F.sort_array(F.collect_list(F.when(key == i, F.struct("event_id", entry.alias("x"))))), lambda s: s["x"]).alias(k) for i, k in enumerate(kind)]
    chosen = lists.agg(*agg).select("user_id", "day", normalize.chosen_metric(F.struct(*kind)).alias("m"))
    return chosen.select("user_id", "day", F.col("m.key").alias("metric_key"), F.col("m.entry.source").alias("source"), F.col("m.entry.type").alias("type"), F.col("m.entry.cvssData.baseSeverity").alias("label"))


def first_alias(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    aliases = F.array(F.concat(F.lit("GHSA-"), k), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("CVE-"), k)).otherwise("PYSEC-1"), F.concat(F.when(F.col("o_orderkey") % 5 != 0, "CVE-2-").otherwise("X-"), k))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.first_with_prefix(aliases, "CVE-").alias("alias"))


def cwe_extract(spark, sf_dir):
    def d(value: Column, lang: str = "en") -> Column:
        return F.struct(F.lit(lang).alias("lang"), value.alias("value"))

    k = F.col("o_orderkey")
    first = F.struct(F.array(d(F.concat(F.lit("CWE-"), (k % 9).cast("string"))), d(F.lit("NVD-CWE-noinfo"))).alias("description"))
    second = F.struct(F.array(d(F.concat(F.lit("CWE-"), (k % 4).cast("string")), "es")).alias("description"))
    described = F.array(d(F.lit("hola"), "es"), d(F.lit("")), d(F.concat(F.lit("text "), k.cast("string"))))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", _joined(normalize.weakness_ids(F.array(first, second))).alias("cwe_ids"), normalize.english_summary(described).alias("summary")
    )


def affected_explode(spark, sf_dir):
    """Advisory items from lines, exploded into affected rows."""
    p = F.col("l_partkey")

    def event(name: str, value: Column) -> Column:
        return F.create_map(F.lit(name), value)

    text_of = lambda c: c.cast("string")
    range_one = F.struct(F.array(event("introduced", F.concat(F.lit("1."), text_of(p % 4))), event("fixed", F.concat(F.lit("2."), text_of(p % 3))), event("introduced", F.lit("9"))).alias("events"))
    range_two = F.struct(F.array(event("introduced", F.lit("0"))).alias("events"))
    no_range = F.array().cast("array<struct<events: array<map<string, string>>>>")
    ranges = F.when(p % 4 == 0, no_range).when(p % 4 == 1, F.array(range_one)).otherwise(F.array(range_one, range_two))
    known = F.when(p % 3 == 0, F.array(F.lit("1.0"), F.concat(F.lit("1."), text_of(p % 5)))).otherwise(F.array().cast("array<string>"))
    package = F.struct(F.concat(F.lit("pkg"), text_of(p % 50)).alias("name"), F.lit("PyPI").alias("ecosystem"))
    item = F.struct(package.alias("package"), ranges.alias("ranges"), known.alias("versions"))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(normalize.advisory_affected(F.array(item))))
    return rows.select("l_orderkey", "l_linenumber", "package_name", "version", "introduced", "fixed", "version_end_excluding")


def _match(i: int) -> Column:
    """A configuration match of a part."""
    p = F.col("p_partkey")
    start, end, at = F.concat(F.lit("1."), (p % 4).cast("string")), F.concat(F.lit("2."), ((p + i) % 3).cast("string")), p + i
    return F.struct(
        F.concat(F.lit(f"cpe:2.3:a:v:q{i}:"), (p % 5).cast("string"), F.lit(":*")).alias("criteria"),
        (p % 2 == 0).alias("vulnerable"),
        F.when(at % 3 == 0, start).alias("versionStartIncluding"),
        F.when(at % 3 == 1, start).alias("versionStartExcluding"),
        F.when(at % 4 == 0, end).alias("versionEndIncluding"),
        F.when(at % 4 == 1, end).alias("versionEndExcluding"),
    )


def feed_affected(spark, sf_dir):
    """Configuration trees of four levels from parts, walked in pre-order into affected rows."""
    p = F.col("p_partkey")
    leaf = F.struct(F.array(_match(4)).alias("cpeMatch"))
    bare = F.struct(F.filter(F.array(_match(4)), lambda m: F.lit(False)).alias("cpeMatch"), F.array(leaf).alias("children"))
    inner = F.array(F.struct(F.array(_match(3)).alias("cpeMatch"), F.array(bare).alias("children")))
    root = F.struct(F.when(p % 2 == 0, F.array(_match(1), _match(2))).otherwise(F.array(_match(1))).alias("cpeMatch"), F.when(p % 3 == 0, inner).alias("children"))
    other = F.struct(F.array(_match(5)).alias("cpeMatch"), F.when(F.lit(False), inner).alias("children"))
    trees = F.array(F.struct(F.array(root).alias("nodes")), F.struct(F.when(p % 4 == 0, F.array(other)).alias("nodes")))
    parts = _table(spark, sf_dir, "part").select("p_partkey", trees.alias("c"))
    kind = parts.schema["c"].dataType.elementType["nodes"].dataType.elementType
    rows = parts.select("p_partkey", F.posexplode(normalize.match_affected(normalize.cpe_matches(F.col("c"), kind))).alias("pos", "a"))
    told = ("criteria", "vendor", "product", "version", "introduced", "version_start_including", "version_start_excluding", "version_end_including", "version_end_excluding", "vulnerable")
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), *[F.col(f"a.{c}").alias(c) for c in told])


def nvd_record(spark, sf_dir):
    """Feed rows from orders, as shared records."""
    k = F.col("o_orderkey")
    key = k.cast("string")

    def entry(source: str, kind: str, score: float, label: str | None) -> Column:
        data = F.struct(F.lit(score).alias("baseScore"), F.lit(label).cast("string").alias("baseSeverity"), F.concat(F.lit("v"), key).alias("vectorString"))
        return F.struct(F.lit(source).alias("source"), F.lit(kind).alias("type"), data.alias("cvssData"))

    def said(lang: str, value: Column) -> Column:
        return F.struct(F.lit(lang).alias("lang"), value.alias("value"))

    old = F.array(entry("z", "Primary", 5.0, None))
    new = F.when(k % 3 == 0, F.array(entry("x", "Secondary", 1.0, "LOW"), entry("y", K.PRIMARY_TYPE, 9.8, "CRITICAL")))
    metrics = F.struct(F.filter(old, lambda m: F.lit(False)).alias(K.METRIC_KEYS[0]), new.alias(K.METRIC_KEYS[1]), F.when(F.lit(False), old).alias(K.METRIC_KEYS[2]), F.when(k % 5 != 0, old).alias(K.METRIC_KEYS[3]))
    matched = F.struct(
        F.concat(F.lit("cpe:2.3:a:acme:p"), (k % 7).cast("string"), F.lit(":1")).alias("criteria"), F.lit(True).alias("vulnerable"),
        *[F.lit(None).cast("string").alias(c) for c in ("versionStartIncluding", "versionStartExcluding", "versionEndIncluding", "versionEndExcluding")],
    )
    day = F.to_date("o_orderdate").cast("string")
    cve = F.struct(
        F.when(k % 13 != 0, F.concat(F.lit("CVE-2024-"), key)).alias("id"),
        day.alias("published"),
        day.alias("lastModified"),
        F.col("o_orderstatus").alias("vulnStatus"),
        F.array(said("es", F.lit("hola")), said("en", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("order "), key)))).alias("descriptions"),
        metrics.alias("metrics"),
        F.array(F.struct(F.array(said("en", F.concat(F.lit("CWE-"), (k % 9).cast("string"))), said("en", F.lit("NVD-CWE-noinfo"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.concat(F.lit("https://H"), (k % 5).cast("string"), F.lit(".ex.org/a")).alias("url"), F.lit("s").alias("source"), F.array(F.lit("t")).alias("tags"))).alias("references"),
        F.array(F.struct(F.array(F.struct(F.array(matched).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    )
    records = normalize.nvd_records(_table(spark, sf_dir, "orders").select(cve.alias("cve")))
    return records.select(
        "source", "source_id", "cve_id", _joined(F.col("aliases")).alias("aliases"), "summary", "published", "last_modified", F.col("severity.metric_key").alias("metric_key"), F.col("severity.score").alias("score"),
        F.col("severity.label").alias("label"), F.col("severity.vector").alias("vector"), _joined(F.col("cwe_ids")).alias("cwe_ids"), _joined(F.transform("references", lambda r: F.concat_ws(" ", r["url"], r["host"], r["source"], F.array_join(r["tags"], ",")))).alias("refs"),
        _joined(F.transform("affected", lambda a: F.concat_ws(" ", a["vendor"], a["product"], a["version"]))).alias("affected"), F.col("source_specific.vuln_status").alias("vuln_status"),
    )


def ghsa_record(spark, sf_dir):
    """Advisory rows from lines, as shared records."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    name = F.concat(F.lit("GHSA-"), F.col("l_orderkey").cast("string"), F.lit("-"), n.cast("string"))
    alias = F.concat(F.lit("CVE-2024-"), F.col("l_orderkey").cast("string"))
    event = lambda what, value: F.create_map(F.lit(what), value)
    bounds = F.array(F.struct(F.array(event("introduced", F.lit("0")), event("fixed", F.concat(F.lit("2."), (part % 3).cast("string")))).alias("events")))
    package = F.struct(F.concat(F.lit("pkg"), (part % 50).cast("string")).alias("name"), F.lit("npm").alias("ecosystem"))
    item = F.struct(package.alias("package"), F.when(part % 4 != 0, bounds).alias("ranges"), F.when(part % 5 == 0, F.array(F.lit("1.0"))).alias("versions"))
    day = F.concat(F.to_date("l_shipdate").cast("string"), F.lit("T00:00:00Z"))
    rows = _table(spark, sf_dir, "lineitem").select(
        name.alias("id"), F.when(part % 3 == 0, F.array(F.lit("X-1"))).when(part % 3 == 1, F.array(F.lit("X-1"), alias, F.lit("CVE-9"))).alias("aliases"), F.concat(F.lit("line "), F.col("l_returnflag")).alias("summary"),
        day.alias("published"), day.alias("modified"), F.when(n % 2 == 0, F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.concat(F.lit("v"), part.cast("string")).alias("score")))).alias("severity"),
        F.array(F.struct(F.lit("WEB").alias("type"), F.lit("https://ex.com/a").alias("url"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("array<string>").alias("tags"))).alias("references"),
        F.array(item).alias("affected"),
        F.struct(F.when(n > 2, "HIGH").alias("severity"), F.array(F.lit("CWE-9"), F.concat(F.lit("CWE-"), (part % 4).cast("string"))).alias("cwe_ids"), (n % 3 == 0).alias("github_reviewed"), day.alias("github_reviewed_at"), F.lit(None).cast("string").alias("nvd_published_at")).alias("database_specific"),
        F.concat(F.lit("advisories/"), name, F.lit(".json")).alias("relative_path"),
    )
    records = normalize.ghsa_records(rows)
    return records.select(
        "source", "source_id", "cve_id", _joined(F.col("aliases")).alias("aliases"), "summary", "published", F.col("severity.metric_key").alias("metric_key"), F.col("severity.label").alias("label"), F.col("severity.vector").alias("vector"),
        _joined(F.col("cwe_ids")).alias("cwe_ids"), _joined(F.transform("references", lambda r: F.concat_ws(" ", r["url"], r["host"]))).alias("refs"),
        _joined(F.transform("affected", lambda a: F.concat_ws(" ", a["package_name"], a["ecosystem"], a["version"], a["introduced"], a["fixed"]))).alias("affected"),
        F.col("source_specific.github_reviewed").alias("github_reviewed"), F.col("source_specific.relative_path").alias("relative_path"),
    )


def version_point_in_range(spark, sf_dir):
    """Pairs whose left side is a point version inside a range on the right."""
    pairs = compare.normalized(adapter.all_pairs(spark, sf_dir))
    return pairs.select(*adapter.KEYS, versions.points_covered(F.col("nvd_spans"), F.col("ghsa_spans")).alias("covered"))


def json_props(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("parsed"), F.sum("p.k").alias("total"))


def year_file_counts(spark, sf_dir):
    """Orders as advisories of a tree by year."""
    rel = F.concat(F.lit("advisories/github-reviewed/"), F.year("o_orderdate").cast("string"), F.lit("/01/x.json"))
    return advisory_year_counts(_table(spark, sf_dir, "orders").select(F.struct(rel.alias("relative_path")).alias("source_specific")))


def feed_file_counts(spark, sf_dir):
    """Orders as rows of feed files by year."""
    name = F.concat(F.lit("nvdcve-2.0-"), F.year("o_orderdate").cast("string"), F.lit(".json"))
    return feed_year_counts(_table(spark, sf_dir, "orders").select(name.alias("file_name")))


def records_round_trip(spark, sf_dir):
    """Records of all lines written as JSON lines and read back; the lines, most of them names of fields, are packed."""
    path = f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}.jsonl"
    write_jsonl(adapter.right_records(spark, sf_dir), path, compression="gzip")
    back = read_records(spark, path)
    return back.select("cve_id", "source_id", F.col("severity.label").alias("label"), "published", _joined(F.col("cwe_ids")).alias("cwe_ids"), F.size("references").cast("long").alias("refs"), F.col("source_specific.relative_path").alias("path"))


def latest_file_per_year(spark, sf_dir):
    """A derived listing with plain and zipped files of the same year: the file that goes first."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("/raw/nvdcve-2.0-"), F.year("o_orderdate").cast("string"), F.when(k % 2 == 0, ".json").otherwise(".json.zip"))
    return choose_files(_table(spark, sf_dir, "orders").select(name.alias("path")).distinct())


def sorted_span_dedup(spark, sf_dir):
    """Canonical and effective spans of both sides."""

    def told(spans: Column, fields: tuple[str, ...]) -> Column:
        return _joined(F.array_sort(F.transform(spans, lambda s: F.concat_ws(";", *[F.coalesce(s[f], F.lit("")) for f in fields]))))

    pairs = compare.normalized(adapter.all_pairs(spark, sf_dir))
    effective = ("lower_including", "lower_excluding", "upper_including", "upper_excluding", "version")
    return pairs.select(
        *adapter.KEYS,
        told(F.col("nvd_spans"), versions.SPAN).alias("nvd_spans"),
        told(F.col("ghsa_spans"), versions.SPAN).alias("ghsa_spans"),
        told(F.col("ghsa_effective"), effective).alias("ghsa_effective"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        align_left_join, align_matched_counts, align_coverage_docs, one_to_one_pairs, year_match_rate, field_presence, severity_canonical, cmp_severity,
        cmp_published, cmp_cwe, cmp_references, cmp_affected, discrepancy_stats, discrepancy_stats_one_to_one, unified_view_flat, url_canonical,
        url_host_counts, reference_set_per_host, href_extract, text_normalize, prefix_filter, cpe_split, metric_choice, first_alias, cwe_extract,
        affected_explode, feed_affected, nvd_record, ghsa_record, version_point_in_range, json_props, year_file_counts, feed_file_counts, records_round_trip, latest_file_per_year, sorted_span_dedup,
    )
}
