"""SQL twins of the registered queries, for an engine other than Spark.

Only the adapter's scalar expressions are shared; sets, URLs, spans and statuses
are computed here on their own.
"""

from __future__ import annotations

from fieldweave.plans import adapter

_SCALARS = ", ".join(f"{v} AS {k}" for k, v in {**adapter.LEFT, **adapter.RIGHT}.items())
_KEYS = ", ".join(adapter.KEYS)

PAIRS = f"""
pairs AS (
  SELECT {_KEYS}, l_extendedprice, l_orderkey, {adapter.CVE_ID} AS cve_id, {_SCALARS}
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
"""
_LEFT = ", ".join(f"{v} AS {k}" for k, v in adapter.LEFT.items())
ORDERS = f"lefts AS (SELECT o_orderkey, {adapter.CVE_ID} AS cve_id, {_LEFT} FROM orders)"

_CANON = "CASE upper({0}) WHEN 'LOW' THEN 'LOW' WHEN 'MODERATE' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'HIGH' THEN 'HIGH' WHEN 'CRITICAL' THEN 'CRITICAL' END"
_RANK = "CASE {0} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END"


def _ladder(steps: list[tuple[str, str, str]]) -> str:
    """status and note of the first condition that holds; '' always does."""
    whens = [" ".join(f"WHEN {c} THEN '{s[i]}'" for s in steps if (c := s[0])) + f" ELSE '{steps[-1][i]}' END" for i in (1, 2)]
    return f"CASE {whens[0]} AS status, CASE {whens[1]} AS note"


_EQ, _REP, _INC, _TMP, _BAD = "equivalent", "representation_discrepancy", "incomplete", "temporal_discrepancy", "factual_conflict"
_BOTH, _ONE = "both sides missing", "value present on only one side"

SEVERITY = f"""
sev AS (SELECT *, {_CANON.format('l_label')} AS lc, {_CANON.format('r_label')} AS rc FROM pairs),
severity AS (SELECT {_KEYS}, cve_id, {_ladder([
    ("l_label IS NULL AND r_label IS NULL", _EQ, _BOTH),
    ("l_label IS NULL OR r_label IS NULL", _INC, _ONE),
    ("lc = rc AND upper(l_label) = upper(r_label)", _EQ, "same severity label"),
    ("lc = rc", _REP, "same canonical severity label"),
    ("lc IS NOT NULL AND rc IS NOT NULL", _BAD, "different canonical severity labels"),
    ("", _REP, "severity labels could not be fully canonicalized"),
])}, CASE WHEN lc <> rc THEN abs({_RANK.format('lc')} - {_RANK.format('rc')}) END AS rank_distance FROM sev)
"""

PUBLISHED = f"""
pub AS (SELECT *, try_cast(l_pub AS TIMESTAMP) AS lt, try_cast(replace(r_pub, 'Z', '') AS TIMESTAMP) AS rt FROM pairs),
published AS (SELECT {_KEYS}, cve_id, {_ladder([
    ("l_pub IS NULL AND r_pub IS NULL", _EQ, _BOTH),
    ("l_pub IS NULL OR r_pub IS NULL", _INC, _ONE),
    ("lt = rt", _EQ, "same timestamp"),
    ("lt::DATE = rt::DATE", _REP, "same calendar date but different timestamp representation"),
    ("lt IS NOT NULL AND rt IS NOT NULL", _TMP, "different publication dates"),
    ("lower(trim(l_pub)) = lower(trim(r_pub))", _REP, "same raw timestamp after normalization"),
    ("", _BAD, "unparseable and unequal publication values"),
])}, abs(date_diff('day', lt::DATE, rt::DATE))::INT AS day_diff FROM pub)
"""

_SET = "list_sort(list_distinct(list_filter([{0}], lambda x: x IS NOT NULL)))"
CWE = f"""
cw AS (SELECT *, {_SET.format('l_cwe1, l_cwe2')} AS a, {_SET.format('upper(trim(r_cwe1)), upper(trim(r_cwe2))')} AS b FROM pairs),
cwe_ids AS (SELECT {_KEYS}, cve_id, {_ladder([
    ("len(a) = 0 AND len(b) = 0", _EQ, _BOTH),
    ("len(a) = 0 OR len(b) = 0", _INC, _ONE),
    ("a = b", _EQ, "same canonical set"),
    ("list_has_all(a, b) OR list_has_all(b, a)", _INC, "one side is a strict subset of the other"),
    ("list_has_any(a, b)", _REP, "sets overlap but differ"),
    ("", _BAD, "CWE assignments are disjoint"),
])}, array_to_string(a, '|') AS nvd_value, array_to_string(b, '|') AS ghsa_value,
  CASE WHEN a <> b AND len(a) > 0 AND len(b) > 0 AND list_has_any(a, b) THEN array_to_string(list_sort(list_intersect(a, b)), '|') END AS shared_values FROM cw)
"""

_URL = "(lower(regexp_extract({0}, '^([a-z]+)://([^/]*)', 1)) || '://' || lower(regexp_extract({0}, '^([a-z]+)://([^/]*)', 2)) || rtrim(regexp_replace(regexp_extract({0}, '^[a-z]+://[^/]*(.*)$', 1), '#.*$', ''), '/'))"
_HOST = "lower(regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1))"
_L, _R = ("l_ref1", "l_ref2"), ("r_ref1", "r_ref2", "r_ref3")


def _each(template: str, columns: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {template.format(c)} END" for c in columns)


REFERENCES = f"""
rf AS (SELECT *, {_SET.format(_each(_URL, _L))} AS a, {_SET.format(_each(_URL, _R))} AS b, {_SET.format(_each(_HOST, _L))} AS ah, {_SET.format(_each(_HOST, _R))} AS bh,
  len(list_filter([{', '.join(_L)}], lambda x: x IS NOT NULL)) AS an, len(list_filter([{', '.join(_R)}], lambda x: x IS NOT NULL)) AS bn FROM pairs),
refs AS (SELECT {_KEYS}, cve_id, {_ladder([
    ("len(a) = 0 AND len(b) = 0", _EQ, _BOTH),
    ("len(a) = 0 OR len(b) = 0", _INC, _ONE),
    ("a = b AND (an <> len(a) OR bn <> len(b))", _REP, "same canonical reference URLs after deduplication"),
    ("a = b", _EQ, "same canonical reference URLs"),
    ("list_has_all(a, b) OR list_has_all(b, a)", _INC, "one side lists a strict subset of canonical references"),
    ("list_has_any(ah, bh) OR list_has_any(a, b)", _REP, "reference coverage differs but points to overlapping evidence sources"),
    ("", _BAD, "reference sets are disjoint with no overlapping hosts"),
])}, array_to_string(a, '|') AS nvd_value, array_to_string(bh, '|') AS ghsa_hosts,
  CASE WHEN a <> b AND len(a) > 0 AND len(b) > 0 AND (list_has_any(ah, bh) OR list_has_any(a, b)) THEN array_to_string(list_sort(list_intersect(a, b)), '|') END AS shared_values FROM rf)
"""

# Spans as semicolon strings in the order start_in;start_ex;end_in;end_ex;fixed;introduced;version, and effective ones.
SPANS = """
bounds AS (SELECT *, nullif(r_start, '0') AS rs, nullif(l_version, '*') AS lv FROM pairs),
spans AS (SELECT *,
  CASE WHEN coalesce(l_start, l_end_in, l_end_ex, lv) IS NULL THEN [] ELSE [concat_ws(';', coalesce(l_start, ''), '', coalesce(l_end_in, ''), coalesce(l_end_ex, ''), '', coalesce(l_start, ''), coalesce(lv, ''))] END AS a,
  list_sort(list_distinct(list_concat(
    CASE WHEN coalesce(rs, r_end, r_fixed) IS NULL THEN [] ELSE [concat_ws(';', coalesce(rs, ''), '', '', coalesce(r_end, ''), coalesce(r_fixed, ''), coalesce(rs, ''), '')] END,
    CASE WHEN r_two THEN ['3.0.0;;;3.1.0;3.1.0;3.0.0;'] ELSE [] END))) AS b FROM bounds),
eff AS (SELECT *,
  CASE WHEN len(a) = 0 THEN [] ELSE [concat_ws(';', coalesce(l_start, ''), '', coalesce(l_end_in, ''), coalesce(l_end_ex, ''), CASE WHEN coalesce(l_start, l_end_in, l_end_ex) IS NULL THEN coalesce(lv, '') ELSE '' END)] END AS ae,
  list_sort(list_distinct(list_concat(
    CASE WHEN coalesce(rs, r_end, r_fixed) IS NULL THEN [] ELSE [concat_ws(';', coalesce(rs, ''), '', '', coalesce(r_end, r_fixed, ''), '')] END,
    CASE WHEN r_two THEN ['3.0.0;;;3.1.0;'] ELSE [] END))) AS be,
  list_filter([coalesce(r_end, r_fixed), CASE WHEN r_two THEN '3.1.0' END], lambda x: x IS NOT NULL) AS outs FROM spans)
"""
_NUM = "list_transform(string_split({0}, '.'), lambda x: x::INT)"
_MM = "(split_part({0}, '.', 1) || '.' || split_part({0}, '.', 2))"
COVERED = f"""(lv IS NOT NULL AND coalesce(l_start, l_end_in, l_end_ex) IS NULL AND (
  (coalesce(rs, r_end, r_fixed) IS NOT NULL AND (rs IS NULL OR {_NUM.format('lv')} >= {_NUM.format('rs')})
    AND (coalesce(r_end, r_fixed) IS NULL OR {_NUM.format('lv')} < {_NUM.format('coalesce(r_end, r_fixed)')}))
  OR (r_two AND {_NUM.format('lv')} >= [3, 0, 0] AND {_NUM.format('lv')} < [3, 1, 0])))"""
AFFECTED = f"""
{SPANS},
affected_versions AS (SELECT {_KEYS}, cve_id, {_ladder([
    ("len(a) = 0 AND len(b) = 0", _EQ, _BOTH),
    ("len(a) = 0 OR len(b) = 0", _INC, _ONE),
    ("a = b", _EQ, "same canonical version-bound spans"),
    ("ae = be", _REP, "same effective version bounds after collapsing equivalent upper/lower markers"),
    ("list_has_all(ae, be) OR list_has_all(be, ae)", _INC, "one side lists a strict subset of effective version-bound spans"),
    ("list_has_any(list_transform(ae, lambda x: split_part(x, ';', 3) || ';' || split_part(x, ';', 4)), list_transform(be, lambda x: split_part(x, ';', 3) || ';' || split_part(x, ';', 4)))",
     _REP, "version-bound spans differ, but share at least one upper-bound endpoint"),
    (f"l_end_in IS NOT NULL AND lv IS NULL AND list_contains(list_transform(outs, lambda x: {_MM.format('x')}), {_MM.format('l_end_in')})",
     _REP, "end_including vs end_excluding boundary with shared major.minor prefix"),
    (f"coalesce({COVERED}, FALSE)", _REP, "NVD point versions are covered by GHSA version ranges"),
    ("l_end_ex IS NOT NULL AND len(list_filter(outs, lambda x: starts_with(x, l_end_ex) OR starts_with(l_end_ex, x))) > 0",
     _REP, "end_excluding version string is a prefix truncation of the other"),
    ("coalesce(regexp_matches(l_end_ex, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'), FALSE)", _REP, "NVD uses a date string as version_end_excluding"),
    ("", _BAD, "canonical version-bound spans are incompatible"),
])} FROM eff)
"""
_FIVE = {"severity": "severity", "published": "published", "cwe_ids": "cwe_ids", "references": "refs", "affected_versions": "affected_versions"}


def _stats(where: str = "TRUE") -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS field, status, cve_id FROM {t}" for f, t in _FIVE.items())
    counts = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in (_EQ, _REP, _INC, _TMP, _BAD))
    return f"WITH {PAIRS}, {SEVERITY}, {PUBLISHED}, {CWE}, {REFERENCES}, {AFFECTED}, allf AS ({parts}) SELECT field, {counts} FROM allf WHERE {where} GROUP BY field"


_PLACE = "printf('%03d/%012d/%012d/%020.4f', l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_SIZE = f"{ORDERS}, {PAIRS}, sizes AS (SELECT lefts.cve_id, count(l_orderkey) AS n FROM lefts LEFT JOIN pairs USING (cve_id) GROUP BY lefts.cve_id)"
_YEAR = "CASE WHEN starts_with(cve_id, 'CVE-') THEN split_part(cve_id, '-', 2) ELSE 'unknown' END"
_R6 = "coalesce(round_even({0} / nullif({1}, 0), 6), 0.0)"
_BLANK = "coalesce(trim({0}) <> '', FALSE)"
_PRESENT = {
    "summary": (_BLANK.format("l_summary"), _BLANK.format("r_summary")),
    "published_date": (_BLANK.format("l_pub"), _BLANK.format("r_pub")),
    "last_modified_date": (_BLANK.format("l_pub"), _BLANK.format("r_pub")),
    "severity": ("l_label IS NOT NULL", "r_label IS NOT NULL"),
    "cwe": ("l_cwe1 IS NOT NULL", "r_cwe1 IS NOT NULL"),
    "references": ("l_ref1 IS NOT NULL", "r_ref1 IS NOT NULL"),
    "affected": ("coalesce(l_start, l_end_in, l_end_ex, l_version) IS NOT NULL", "r_start IS NOT NULL"),
}
_COUNTERS = {
    "nvd_nonempty": "nvd",
    "matched_ghsa_nonempty": "m AND ghsa",
    "matched_both_nonempty": "m AND nvd AND ghsa",
    "matched_nvd_only": "m AND nvd AND NOT ghsa",
    "matched_ghsa_only": "m AND NOT nvd AND ghsa",
    "matched_both_empty": "m AND NOT nvd AND NOT ghsa",
}
_FLAGS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, bool_or({left}) AS nvd, bool_or(coalesce({right} AND l_orderkey IS NOT NULL, FALSE)) AS ghsa, count(l_orderkey) > 0 AS m "
    "FROM (SELECT lefts.*, pairs.* EXCLUDE (o_orderkey, cve_id, " + ", ".join(adapter.LEFT) + ") FROM lefts LEFT JOIN pairs USING (cve_id)) GROUP BY o_orderkey"
    for f, (left, right) in _PRESENT.items()
)
_PAGE_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PAGE = f"""parts AS (SELECT page_id, url, lower(regexp_extract(url, '{_PAGE_URL}', 1)) AS sc, lower(regexp_extract(url, '{_PAGE_URL}', 2)) AS au,
  rtrim(regexp_extract(url, '{_PAGE_URL}', 3), '/') AS pa, regexp_extract(url, '{_PAGE_URL}', 4) AS qu FROM pages),
urls AS (SELECT page_id, au AS host, sc || '://' || au || pa || CASE WHEN qu <> '' THEN '?' || qu ELSE '' END AS canonical FROM parts)"""

ORACLES = {
    "align_left_join": f"""WITH {ORDERS}, {PAIRS},
      g AS (SELECT cve_id, count(*) AS n, string_agg(coalesce(r_label, '-'), '|' ORDER BY {_ORDER}) AS labels, string_agg({_PLACE}, '|' ORDER BY {_ORDER}) AS paths FROM pairs GROUP BY cve_id)
      SELECT lefts.cve_id, coalesce(n, 0)::BIGINT AS n_ghsa, coalesce(labels, '') AS labels, coalesce(paths, '') AS paths FROM lefts LEFT JOIN g USING (cve_id)""",
    "align_matched_counts": f"""WITH {_SIZE}, c AS (SELECT count(*) AS total_rows, count(*) FILTER (n > 0) AS matched_rows, count(*) FILTER (n > 1) AS multi_rows FROM sizes)
      SELECT total_rows, matched_rows, multi_rows, total_rows - matched_rows AS unmatched_rows, {_R6.format('matched_rows', 'total_rows')} AS matched_rate, {_R6.format('multi_rows', 'matched_rows')} AS multi_rate FROM c""",
    "align_coverage_docs": """SELECT lang, count(*) AS total_rows, count(*) FILTER (n > 0) AS matched_rows
      FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY lang""",
    "one_to_one_pairs": f"""WITH {_SIZE} SELECT cve_id, l_label AS nvd_label, r_label AS ghsa_label, r_pub AS ghsa_published FROM pairs JOIN sizes USING (cve_id) WHERE n = 1""",
    "year_match_rate": f"""WITH {_SIZE}, c AS (SELECT {_YEAR} AS year, count(*) AS total_rows, count(*) FILTER (n > 0) AS matched_rows FROM sizes GROUP BY 1)
      SELECT *, {_R6.format('matched_rows', 'total_rows')} AS matched_rate FROM c""",
    "field_presence": f"""WITH {ORDERS}, {PAIRS}, flags AS ({_FLAGS}),
      c AS (SELECT field, count(*) AS t, count(*) FILTER (m) AS k, {', '.join(f'count(*) FILTER ({v}) AS {c}' for c, v in _COUNTERS.items())} FROM flags GROUP BY field)
      SELECT field, {', '.join(_COUNTERS)}, {', '.join(_R6.format(c, 't' if c == 'nvd_nonempty' else 'k') + f' AS {c}_rate' for c in _COUNTERS)} FROM c""",
    "severity_canonical": f"""WITH {PAIRS} SELECT {_CANON.format('l_label')} AS nvd_canonical, {_CANON.format('r_label')} AS ghsa_canonical, count(*) AS pairs FROM pairs GROUP BY 1, 2""",
    "cmp_severity": f"WITH {PAIRS}, {SEVERITY} SELECT * FROM severity",
    "cmp_published": f"WITH {PAIRS}, {PUBLISHED} SELECT * FROM published",
    "cmp_cwe": f"WITH {PAIRS}, {CWE} SELECT * FROM cwe_ids",
    "cmp_references": f"WITH {PAIRS}, {REFERENCES} SELECT * FROM refs",
    "cmp_affected": f"WITH {PAIRS}, {AFFECTED} SELECT * FROM affected_versions",
    "discrepancy_stats": _stats(),
    "discrepancy_stats_one_to_one": _stats("cve_id IN (SELECT cve_id FROM pairs GROUP BY cve_id HAVING count(*) = 1)"),
    "unified_view_flat": f"""WITH {PAIRS}, {SPANS},
      s AS (SELECT *, {_SET.format('l_cwe1, l_cwe2')} AS lw, {_SET.format('upper(trim(r_cwe1)), upper(trim(r_cwe2))')} AS rw,
        {_SET.format(_each(_URL, _L))} AS lu, {_SET.format(_each(_URL, _R))} AS ru, {_SET.format(_each(_HOST, _L))} AS lh FROM spans)
      SELECT {_KEYS}, {_CANON.format('l_label')} AS nvd_severity, {_CANON.format('r_label')} AS ghsa_severity, l_pub AS nvd_published, r_pub AS ghsa_published,
        array_to_string(lw, '|') AS nvd_cwe, array_to_string(rw, '|') AS ghsa_cwe, array_to_string(lu, '|') AS nvd_urls, array_to_string(ru, '|') AS ghsa_urls,
        array_to_string(lh, '|') AS nvd_hosts,
        CASE WHEN coalesce(l_start, l_end_in, l_end_ex, l_version) IS NULL THEN '' ELSE 'left' END AS nvd_packages,
        CASE WHEN r_start IS NULL THEN '' ELSE 'right' END AS ghsa_packages, len(b) AS ghsa_spans FROM s""",
    "url_canonical": f"WITH {_PAGE} SELECT page_id, canonical, host FROM urls",
    "url_host_counts": f"WITH {_PAGE} SELECT host, count(*) AS pages FROM urls GROUP BY host",
    "reference_set_per_host": f"WITH {_PAGE} SELECT host, canonical AS url, count(*) AS pages FROM urls WHERE canonical IS NOT NULL GROUP BY host, canonical",
    "href_extract": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages),
      x AS (SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) AS pos FROM l)
      SELECT page_id, pos::BIGINT AS pos, url, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host FROM x""",
    "text_normalize": r"""WITH n AS (SELECT doc_id, nullif(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '') AS t FROM documents)
      SELECT doc_id, md5(t) AS normalized_md5, t IS NOT NULL AS present FROM n""",
    "prefix_filter": """SELECT p_brand, count(*) AS parts FROM part WHERE (starts_with(p_name, 'red ') OR starts_with(p_name, 'blue ')) AND p_brand <> '' GROUP BY p_brand""",
    "cpe_split": """WITH h AS (SELECT p_partkey, p_size, 'cpe:2.3:a:' || lower(replace(p_brand, '#', '')) || ':' || replace(p_name, ' ', '_') AS head FROM part),
      c AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN head ELSE head || ':' || CASE WHEN p_size % 7 = 0 THEN '' ELSE '1.' || p_size::VARCHAR END || ':*:*' END AS x FROM h)
      SELECT p_partkey, nullif(split_part(x, ':', 4), '') AS vendor, nullif(split_part(x, ':', 5), '') AS product, nullif(split_part(x, ':', 6), '') AS version FROM c""",
    "metric_choice": """WITH e AS (SELECT user_id, ts::DATE AS day, event_id % 4 AS m, event_type, event_id,
        CASE WHEN event_id % 5 = 0 THEN 'Primary' ELSE 'Secondary' END AS ty, CASE WHEN event_id % 7 = 0 THEN 'nvd@nist.gov' ELSE 'other' END AS so FROM events WHERE value IS NOT NULL),
      k AS (SELECT *, min(m) OVER (PARTITION BY user_id, day) AS best FROM e),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY (CASE WHEN ty = 'Primary' OR so = 'nvd@nist.gov' THEN 0 ELSE 1 END), event_id) AS n FROM k WHERE m = best)
      SELECT user_id, day, ['cvssMetricV40', 'cvssMetricV31', 'cvssMetricV30', 'cvssMetricV2'][m + 1] AS metric_key, so AS source, ty AS type, event_type AS label FROM r WHERE n = 1""",
    "first_alias": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'CVE-' || o_orderkey::VARCHAR WHEN o_orderkey % 5 <> 0 THEN 'CVE-2-' || o_orderkey::VARCHAR END AS alias FROM orders""",
    "cwe_extract": """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(flatten([['CWE-' || (o_orderkey % 9)::VARCHAR, 'NVD-CWE-noinfo'], ['CWE-' || (o_orderkey % 4)::VARCHAR]]), lambda x: starts_with(x, 'CWE-')))), '|') AS cwe_ids,
      'text ' || o_orderkey::VARCHAR AS summary FROM orders""",
    "affected_explode": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS p FROM lineitem),
      r AS (SELECT *, unnest(CASE WHEN p % 4 = 0 THEN CASE WHEN p % 3 = 0 THEN [] ELSE [0] END WHEN p % 4 = 1 THEN [1] ELSE [1, 2] END) AS k FROM l)
      SELECT l_orderkey, l_linenumber, 'pkg' || (p % 50)::VARCHAR AS package_name, CASE WHEN k > 0 AND p % 3 = 0 THEN '1.' || (p % 5)::VARCHAR END AS version,
        CASE k WHEN 1 THEN '1.' || (p % 4)::VARCHAR WHEN 2 THEN '0' END AS introduced, CASE k WHEN 1 THEN '2.' || (p % 3)::VARCHAR END AS fixed, CASE k WHEN 1 THEN '2.' || (p % 3)::VARCHAR END AS version_end_excluding FROM r""",
    "feed_affected": """WITH k AS (SELECT p_partkey AS p, unnest([1, 2, 3, 4, 5]) AS i FROM part),
      kept AS (SELECT p, i, i::VARCHAR AS q, (p % 5)::VARCHAR AS v, '1.' || (p % 4)::VARCHAR AS lo, '2.' || ((p + i) % 3)::VARCHAR AS hi FROM k WHERE i = 1 OR (i = 2 AND p % 2 = 0) OR (i IN (3, 4) AND p % 3 = 0) OR (i = 5 AND p % 4 = 0))
      SELECT p AS p_partkey, (row_number() OVER (PARTITION BY p ORDER BY i) - 1)::BIGINT AS pos, 'cpe:2.3:a:v:q' || q || ':' || v || ':*' AS criteria, 'v' AS vendor, 'q' || q AS product, v AS version,
        CASE WHEN (p + i) % 3 < 2 THEN lo END AS introduced, CASE WHEN (p + i) % 3 = 0 THEN lo END AS version_start_including, CASE WHEN (p + i) % 3 = 1 THEN lo END AS version_start_excluding,
        CASE WHEN (p + i) % 4 = 0 THEN hi END AS version_end_including, CASE WHEN (p + i) % 4 = 1 THEN hi END AS version_end_excluding, p % 2 = 0 AS vulnerable FROM kept""",
    "nvd_record": """SELECT 'nvd' AS source, id AS source_id, id AS cve_id, coalesce(id, '') AS aliases, CASE WHEN k % 4 <> 0 THEN 'order ' || s END AS summary, day AS published, day AS last_modified,
        CASE WHEN k % 3 = 0 THEN 'cvssMetricV31' WHEN k % 5 <> 0 THEN 'cvssMetricV2' END AS metric_key, CASE WHEN k % 3 = 0 THEN 9.8::DOUBLE WHEN k % 5 <> 0 THEN 5.0::DOUBLE END AS score,
        CASE WHEN k % 3 = 0 THEN 'CRITICAL' END AS label, CASE WHEN k % 3 = 0 OR k % 5 <> 0 THEN 'v' || s END AS vector, 'CWE-' || (k % 9)::VARCHAR AS cwe_ids,
        'https://H' || (k % 5)::VARCHAR || '.ex.org/a h' || (k % 5)::VARCHAR || '.ex.org s t' AS refs, 'acme p' || (k % 7)::VARCHAR || ' 1' AS affected, o_orderstatus AS vuln_status
      FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS s, o_orderdate::DATE::VARCHAR AS day, CASE WHEN o_orderkey % 13 <> 0 THEN 'CVE-2024-' || o_orderkey::VARCHAR END AS id, o_orderstatus FROM orders)""",
    "ghsa_record": """WITH l AS (SELECT *, 'GHSA-' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, l_linenumber AS n, l_partkey AS p FROM lineitem)
      SELECT 'ghsa' AS source, id AS source_id, CASE WHEN p % 3 = 1 THEN 'CVE-2024-' || l_orderkey::VARCHAR END AS cve_id,
        CASE p % 3 WHEN 0 THEN 'X-1' WHEN 1 THEN 'X-1|CVE-2024-' || l_orderkey::VARCHAR || '|CVE-9' ELSE '' END AS aliases, 'line ' || l_returnflag AS summary, l_shipdate::DATE::VARCHAR || 'T00:00:00Z' AS published,
        CASE WHEN n % 2 = 0 THEN 'CVSS_V3' END AS metric_key, CASE WHEN n > 2 THEN 'HIGH' END AS label, CASE WHEN n % 2 = 0 THEN 'v' || p::VARCHAR END AS vector, 'CWE-' || (p % 4)::VARCHAR || '|CWE-9' AS cwe_ids,
        'https://ex.com/a ex.com' AS refs,
        CASE WHEN p % 4 = 0 AND p % 5 = 0 THEN '' ELSE 'pkg' || (p % 50)::VARCHAR || ' npm' || CASE WHEN p % 4 <> 0 THEN CASE WHEN p % 5 = 0 THEN ' 1.0' ELSE '' END || ' 0 2.' || (p % 3)::VARCHAR ELSE '' END END AS affected,
        n % 3 = 0 AS github_reviewed, 'advisories/' || id || '.json' AS relative_path FROM l""",
    "version_point_in_range": f"WITH {PAIRS}, {SPANS} SELECT {_KEYS}, coalesce({COVERED}, FALSE) AS covered FROM spans",
    "json_props": """SELECT event_type, count((props::JSON ->> 'k')::BIGINT) AS parsed, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type""",
    "year_file_counts": "SELECT year(o_orderdate)::VARCHAR AS year, count(*) AS records FROM orders GROUP BY 1",
    "feed_file_counts": "SELECT year(o_orderdate)::VARCHAR AS year, count(*) AS records FROM orders GROUP BY 1",
    "records_round_trip": f"""WITH {PAIRS} SELECT cve_id, {_PLACE} AS source_id, r_label AS label, r_pub AS published, concat_ws('|', r_cwe1, r_cwe2) AS cwe_ids,
        len(list_filter([r_ref1, r_ref2, r_ref3], lambda x: x IS NOT NULL))::BIGINT AS refs, {_PLACE} AS path FROM pairs""",
    "latest_file_per_year": """SELECT y::VARCHAR AS year, '/raw/nvdcve-2.0-' || y::VARCHAR || CASE WHEN plain THEN '.json' ELSE '.json.zip' END AS path
      FROM (SELECT year(o_orderdate) AS y, bool_or(o_orderkey % 2 = 0) AS plain FROM orders GROUP BY 1)""",
    "sorted_span_dedup": f"""WITH {PAIRS}, {SPANS} SELECT {_KEYS}, array_to_string(a, '|') AS nvd_spans, array_to_string(b, '|') AS ghsa_spans, array_to_string(be, '|') AS ghsa_effective FROM eff""",
}
