"""SQL twins of the study queries, for an engine other than Spark."""

from __future__ import annotations

from fieldweave.plans import adapter, study
from fieldweave.plans.oracles import CWE, ORDERS, PAIRS, PUBLISHED, REFERENCES, SEVERITY, SPANS, _stats

_KEYS = ", ".join(adapter.KEYS)
_R6 = "coalesce(round_even(({0}) / nullif(({1})::DOUBLE, 0), 6), 0.0)"
_FIVE = ("equivalent", "representation_discrepancy", "incomplete", "temporal_discrepancy", "factual_conflict")


# --- ranges -----------------------------------------------------------------------
# A version of up to four numbers as one number; twice that, and one more above it, is a cut.
def _place(v: str) -> str:
    parts = " + ".join(f"coalesce(try_cast(nullif(split_part({v}, '.', {i}), '') AS BIGINT), 0) * {1000 ** (4 - i)}" for i in range(1, 5))
    return f"(2 * ({parts}))"


_PLAIN = "coalesce(regexp_matches({0}, '^[0-9.]+$'), TRUE)"
RANGES = f"""
{SPANS},
numbered AS (SELECT *, row_number() OVER () AS rid FROM eff),
given AS (
  SELECT rid, 'a' AS side, coalesce(l_start, CASE WHEN coalesce(l_start, l_end_in, l_end_ex) IS NULL THEN lv END) AS s, 0 AS s_up,
         coalesce(l_end_in, l_end_ex, CASE WHEN coalesce(l_start, l_end_in, l_end_ex) IS NULL THEN lv END) AS e, CASE WHEN l_end_in IS NOT NULL OR coalesce(l_start, l_end_in, l_end_ex) IS NULL THEN 1 ELSE 0 END AS e_up
  FROM numbered WHERE coalesce(l_start, l_end_in, l_end_ex, lv) IS NOT NULL
  UNION ALL SELECT rid, 'b', rs, 0, coalesce(r_end, r_fixed), 0 FROM numbered WHERE coalesce(rs, r_end, r_fixed) IS NOT NULL
  UNION ALL SELECT rid, 'b', '3.0.0', 0, '3.1.0', 0 FROM numbered WHERE r_two),
odd AS (SELECT rid, count(*)::INT AS unreadable FROM given WHERE NOT ({_PLAIN.format('s')} AND {_PLAIN.format('e')}) GROUP BY rid),
placed AS (
  SELECT rid, side, CASE WHEN s IS NULL THEN -1 ELSE {_place('s')} + s_up END AS lo, s, CASE WHEN e IS NULL THEN 9000000000000000 ELSE {_place('e')} + e_up END AS hi, e
  FROM given WHERE {_PLAIN.format('s')} AND {_PLAIN.format('e')}),
fine AS (SELECT * FROM placed WHERE lo < hi),
events AS (
  SELECT rid, lo AS pos, s AS v, CASE side WHEN 'a' THEN 1 ELSE 0 END AS da, CASE side WHEN 'b' THEN 1 ELSE 0 END AS db FROM fine
  UNION ALL SELECT rid, hi, e, CASE side WHEN 'a' THEN -1 ELSE 0 END, CASE side WHEN 'b' THEN -1 ELSE 0 END FROM fine),
cuts AS (SELECT rid, pos, any_value(v) AS v, sum(da) AS da, sum(db) AS db FROM events GROUP BY rid, pos),
open AS (SELECT rid, pos, v, sum(da) OVER w AS a, sum(db) OVER w AS b, lead(pos) OVER w AS to_pos, lead(v) OVER w AS to_v FROM cuts WINDOW w AS (PARTITION BY rid ORDER BY pos)),
stretches AS (SELECT * FROM open WHERE to_pos IS NOT NULL AND a + b > 0),
sets AS (
  SELECT rid, 'shared' AS k, pos, v, to_pos, to_v FROM stretches WHERE a > 0 AND b > 0
  UNION ALL SELECT rid, 'left_only', pos, v, to_pos, to_v FROM stretches WHERE a > 0 AND b = 0
  UNION ALL SELECT rid, 'right_only', pos, v, to_pos, to_v FROM stretches WHERE a = 0 AND b > 0
  UNION ALL SELECT rid, 'union', pos, v, to_pos, to_v FROM stretches
  UNION ALL SELECT rid, 'gaps', pos, v, to_pos, to_v FROM open WHERE to_pos IS NOT NULL AND a + b = 0),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, k ORDER BY pos) AS g FROM (SELECT *, CASE WHEN lag(to_pos) OVER (PARTITION BY rid, k ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh FROM sets)),
merged AS (SELECT rid, k, min(pos) AS pos, arg_min(v, pos) AS v, max(to_pos) AS to_pos, arg_max(to_v, to_pos) AS to_v, count(*) AS n FROM islands GROUP BY rid, k, g),
ends AS (SELECT rid, k, pos, CASE WHEN pos = -1 OR pos % 2 = 1 THEN '(' ELSE '[' END || coalesce(CASE WHEN pos <> -1 THEN v END, '') || ',' || coalesce(CASE WHEN to_pos < 9000000000000000 THEN to_v END, '') || CASE WHEN to_pos < 9000000000000000 AND to_pos % 2 = 1 THEN ']' ELSE ')' END AS t FROM merged),
told AS (SELECT rid, {', '.join(f"string_agg(t, '|' ORDER BY pos) FILTER (k = '{k}') AS {k}_" for k in ('shared', 'left_only', 'right_only', 'union', 'gaps'))} FROM ends GROUP BY rid),
sides AS (SELECT rid, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM fine GROUP BY rid)
SELECT {_KEYS}, CASE WHEN coalesce(na, 0) = 0 OR coalesce(nb, 0) = 0 THEN 'empty' WHEN shared_ IS NULL THEN 'disjoint' WHEN left_only_ IS NULL AND right_only_ IS NULL THEN 'equal'
    WHEN left_only_ IS NULL THEN 'subset' WHEN right_only_ IS NULL THEN 'superset' ELSE 'overlap' END AS relation,
  coalesce(shared_, '') AS shared, coalesce(left_only_, '') AS left_only, coalesce(right_only_, '') AS right_only, coalesce(union_, '') AS covered, coalesce(gaps_, '') AS gaps, coalesce(unreadable, 0) AS unreadable
FROM numbered LEFT JOIN told USING (rid) LEFT JOIN sides USING (rid) LEFT JOIN odd USING (rid)
"""

# --- taxonomy ---------------------------------------------------------------------
TAXONOMY = """
edges AS (
  SELECT DISTINCT 'CWE-' || p_partkey AS child, 'CWE-' || unnest(CASE WHEN p_partkey % 5 = 0 THEN [p_partkey // 2, p_partkey // 3] ELSE [p_partkey // 2] END) AS parent FROM part WHERE p_partkey > 0),
up(d, a, n) AS (SELECT child, parent, 1 FROM edges UNION SELECT up.d, edges.parent, n + 1 FROM up JOIN edges ON up.a = edges.child),
pairs AS (SELECT 'CWE-' || l_partkey AS l, 'CWE-' || l_suppkey AS r, count(*) AS lines FROM lineitem GROUP BY 1, 2),
above AS (SELECT d, a, min(n) AS n FROM up GROUP BY d, a UNION ALL SELECT x, x, 0 FROM (SELECT l AS x FROM pairs UNION SELECT r FROM pairs)),
met AS (SELECT l, r, lines, x.a AS c, x.n AS u, y.n AS w FROM pairs JOIN above x ON x.d = l JOIN above y ON y.d = r AND y.a = x.a),
best AS (SELECT l, r, bool_or(u = 1 AND w = 1) AS sib, arg_min({'c': c, 'u': u, 'w': w}, (u + w, c)) AS b FROM met GROUP BY l, r)
SELECT l AS left_id, r AS right_id, lines, CASE WHEN b IS NULL THEN 'unrelated' WHEN b.u + b.w = 0 THEN 'same' WHEN b.u = 0 THEN 'ancestor' WHEN b.w = 0 THEN 'descendant' WHEN sib THEN 'sibling' ELSE 'cousin' END AS relation,
       b.c AS common, (b.u + b.w)::INT AS distance
FROM pairs LEFT JOIN best USING (l, r)
"""

# --- scores -----------------------------------------------------------------------
_W3 = {"AV": "N0.85 A0.62 L0.55 P0.2", "AC": "L0.77 H0.44", "UI": "N0.85 R0.62", "C": "H0.56 L0.22 N0.0", "I": "H0.56 L0.22 N0.0", "A": "H0.56 L0.22 N0.0"}
_W2 = {"AV": "L0.395 A0.646 N1.0", "AC": "H0.35 M0.61 L0.71", "Au": "M0.45 S0.56 N0.704", "C": "N0.0 P0.275 C0.66", "I": "N0.0 P0.275 C0.66", "A": "N0.0 P0.275 C0.66"}


def _metric(v: str, name: str) -> str:
    return f"nullif(regexp_extract({v}, '(?:^|/){name}:([A-Za-z])(?:/|$)', 1), '')"


def _weigh(v: str, name: str, table: str) -> str:
    return f"CASE {_metric(v, name)} " + " ".join(f"WHEN '{x[0]}' THEN {x[1:]}::DOUBLE" for x in table.split()) + " END"


def _base(v: str, out: str, of: str) -> str:
    """CTEs that add the base score ``out`` of the vector ``v`` to the rows of ``of``."""
    three = ", ".join(f"{_weigh(v, n, t)} AS {out}_{n}" for n, t in _W3.items())
    two = ", ".join(f"{_weigh(v, n, t)} AS {out}2_{n}" for n, t in _W2.items())
    p = f"{out}_"
    iss = f"(1.0::DOUBLE - (1.0::DOUBLE - {p}C) * (1.0::DOUBLE - {p}I) * (1.0::DOUBLE - {p}A))"
    q = f"{out}2_"
    impact2 = f"(10.41::DOUBLE * (1.0::DOUBLE - (1.0::DOUBLE - {q}C) * (1.0::DOUBLE - {q}I) * (1.0::DOUBLE - {q}A)))"
    return f"""{out}w AS (SELECT *, {three}, {two}, {_metric(v, 'S')} AS {p}S, {_metric(v, 'PR')} AS {p}P, regexp_extract({v}, '^CVSS:(3[.][01])/', 1) AS {p}ver FROM {of}),
{out}x AS (SELECT *, CASE {p}P WHEN 'N' THEN 0.85::DOUBLE WHEN 'L' THEN CASE {p}S WHEN 'C' THEN 0.68::DOUBLE WHEN 'U' THEN 0.62::DOUBLE END WHEN 'H' THEN CASE {p}S WHEN 'C' THEN 0.5::DOUBLE WHEN 'U' THEN 0.27::DOUBLE END END AS {p}PR,
  CASE {p}S WHEN 'C' THEN 7.52::DOUBLE * ({iss} - 0.029::DOUBLE) - 3.25::DOUBLE * pow({iss} - 0.02::DOUBLE, 15.0::DOUBLE) WHEN 'U' THEN 6.42::DOUBLE * {iss} END AS {p}impact, {impact2} AS {q}impact FROM {out}w),
{out}y AS (SELECT *, 8.22::DOUBLE * {p}AV * {p}AC * {p}PR * {p}UI AS {p}ease FROM {out}x),
{out}z AS (SELECT *, least(CASE {p}S WHEN 'C' THEN 1.08::DOUBLE * ({p}impact + {p}ease) WHEN 'U' THEN {p}impact + {p}ease END, 10.0::DOUBLE) AS {p}raw FROM {out}y),
{out}s AS (SELECT *, CASE WHEN {p}ver <> '' AND {p}ease IS NOT NULL AND {p}impact IS NOT NULL THEN CASE WHEN {p}impact <= 0 THEN 0.0::DOUBLE
    WHEN {p}ver = '3.1' THEN CASE WHEN round({p}raw * 100000)::BIGINT % 10000 = 0 THEN round({p}raw * 100000) / 100000 ELSE (floor(round({p}raw * 100000) / 10000) + 1) / 10 END
    ELSE ceil(round({p}raw * 10, 9)) / 10 END
  WHEN {p}ver = '' AND {v} LIKE 'AV:%' THEN CASE WHEN {q}impact = 0 THEN CASE WHEN {q}AV * {q}AC * {q}Au IS NOT NULL THEN 0.0::DOUBLE END ELSE round((0.6::DOUBLE * {q}impact + 0.4::DOUBLE * (20.0::DOUBLE * {q}AV * {q}AC * {q}Au) - 1.5::DOUBLE) * 1.176::DOUBLE, 1) END END AS {out} FROM {out}z)"""


_NAMES = ("A", "AC", "AV", "Au", "C", "I", "PR", "S", "UI")
_DIFFER = ", ".join(f"CASE WHEN {_metric('l_vector', n)} IS DISTINCT FROM {_metric('r_vector', n)} THEN '{n}:' || coalesce({_metric('l_vector', n)}, '-') || '>' || coalesce({_metric('r_vector', n)}, '-') END" for n in _NAMES)
CVSS = f"""
v AS (SELECT {_KEYS}, {', '.join(f'{x} AS {k}' for k, x in adapter.VECTORS.items())} FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
{_base('l_vector', 'left_base', 'v')},
{_base('r_vector', 'right_base', 'left_bases')}
SELECT {_KEYS}, left_base, right_base, round_even(l_score - left_base, 1) AS left_delta, round_even(left_base - right_base, 1) AS base_delta,
  CASE WHEN l_vector IS NOT NULL AND r_vector IS NOT NULL THEN array_to_string(list_filter([{_DIFFER}], lambda x: x IS NOT NULL), '|') END AS differing
FROM right_bases
"""

# --- histories --------------------------------------------------------------------
GAPS = """
c AS (SELECT user_id AS key, CASE WHEN event_type IN ('view', 'click') THEN 'left' WHEN event_type IN ('purchase', 'signup') THEN 'right' END AS side, date_trunc('second', ts) AS time,
             floor(value)::BIGINT::VARCHAR || '/' || lpad(event_id::VARCHAR, 12, '0') AS value FROM events),
k AS (SELECT * FROM c WHERE side IS NOT NULL AND key IS NOT NULL AND time IS NOT NULL),
w AS (SELECT *, last_value(CASE WHEN side = 'left' THEN {'t': time, 'v': value} END IGNORE NULLS) OVER o AS l, last_value(CASE WHEN side = 'right' THEN {'t': time, 'v': value} END IGNORE NULLS) OVER o AS r
      FROM k WINDOW o AS (PARTITION BY key ORDER BY time, side, value ROWS UNBOUNDED PRECEDING)),
x AS (SELECT key, side, time, value, CASE side WHEN 'left' THEN r ELSE l END AS q FROM w)
SELECT key, side, value, q.v AS other_value, date_diff('second', q.t, time) AS lag_seconds,
       CASE WHEN split_part(value, '/', 1) = split_part(q.v, '/', 1) THEN 'level' WHEN q.t IS NULL THEN 'first' ELSE 'behind' END AS gap FROM x
"""

# --- evidence ---------------------------------------------------------------------
_CANON = "CASE upper({0}) WHEN 'LOW' THEN 'LOW' WHEN 'MODERATE' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'HIGH' THEN 'HIGH' WHEN 'CRITICAL' THEN 'CRITICAL' END"
_SET = "nullif(array_to_string(list_sort(list_distinct(list_filter([{0}], lambda x: x IS NOT NULL))), '|'), '')"
_AUTHORITY = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in study.AUTHORITY.items()) + " ELSE 0.0::DOUBLE END"


def _refs(*columns: str) -> str:
    return " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in columns)


EVIDENCE = f"""
{PAIRS},
{ORDERS},
said AS (
  SELECT cve_id, 'nvd' AS source, try_cast(l_pub AS TIMESTAMP) AS seen, {_refs('l_ref1', 'l_ref2')} AS refs, {_CANON.format('l_label')} AS sev, {_SET.format('l_cwe1, l_cwe2')} AS cwe FROM lefts
  UNION ALL SELECT cve_id, 'feed' || (l_suppkey % 3)::VARCHAR, try_cast(replace(r_pub, 'Z', '') AS TIMESTAMP), {_refs('r_ref1', 'r_ref2', 'r_ref3')}, {_CANON.format('r_label')}, {_SET.format('upper(trim(r_cwe1)), upper(trim(r_cwe2))')} FROM pairs),
claims AS (
  SELECT cve_id, 'severity' AS field, sev AS value, source, seen, refs FROM said WHERE sev IS NOT NULL
  UNION ALL SELECT cve_id, 'published', seen::DATE::VARCHAR, source, seen, refs FROM said WHERE seen IS NOT NULL
  UNION ALL SELECT cve_id, 'cwe_ids', cwe, source, seen, refs FROM said WHERE cwe IS NOT NULL),
vals AS (SELECT cve_id, field, value, max({_AUTHORITY}) AS authority, max(seen) AS latest, sum(refs) AS refs, count(DISTINCT source) AS ns FROM claims GROUP BY cve_id, field, value),
whole AS (SELECT cve_id, field, max(seen) AS newest, count(DISTINCT source) AS n_all FROM claims GROUP BY cve_id, field),
feats AS (
  SELECT cve_id, field, value, latest, authority, coalesce(round_even(pow(0.5::DOUBLE, date_diff('day', latest::DATE, newest::DATE) / 30.0::DOUBLE), 6), 0.0) AS freshness,
         round_even(refs::DOUBLE / (refs + 1), 6) AS support, round_even(ns::DOUBLE / n_all, 6) AS agreement FROM vals JOIN whole USING (cve_id, field))"""


def _score(weights: tuple[int, int, int, int]) -> str:
    parts = zip(weights, ("authority", "freshness", "support", "agreement"), strict=True)
    return "(" + " + ".join(f"{w} * round({p} * 1000000)::BIGINT" for w, p in parts) + ") / 1e10::DOUBLE"


_FULL = (4000, 2000, 1500, 2500)


def _decided(of: str, keys: str) -> str:
    """CTEs that decide the scored candidates of ``of`` for each of ``keys``."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, value) AS nth, count(*) OVER (PARTITION BY {keys}) AS n FROM {of}),
tops AS (
  SELECT {keys}, max(n) AS n, any_value(value) FILTER (nth = 1) AS winner, any_value(score) FILTER (nth = 1) AS score, any_value(score) FILTER (nth = 2) AS next,
         any_value(threshold) AS threshold, any_value(least_margin) AS least_margin, first(value ORDER BY authority DESC, value) AS by_priority, first(value ORDER BY latest DESC NULLS LAST, value) AS by_freshness
  FROM ranked GROUP BY {keys}),
margins AS (SELECT *, CASE WHEN n > 1 THEN 'disputed' ELSE 'agreed' END AS kind, round_even(score - coalesce(next, 0), 10) AS margin FROM tops),
decided AS (
  SELECT *, score < threshold OR (n > 1 AND margin < least_margin) AS abstained,
         CASE WHEN score < threshold OR (n > 1 AND margin < least_margin) THEN 'low' WHEN margin >= 2 * least_margin THEN 'high' ELSE 'medium' END AS confidence,
         CASE WHEN regexp_extract(cve_id, '([0-9]+)$', 1)::BIGINT % 5 = 0 THEN by_freshness ELSE by_priority END AS gold FROM margins)"""


_SCORED = f"scored AS (SELECT *, {_score(_FULL)} AS score, 0.45::DOUBLE AS threshold, 0.1::DOUBLE AS least_margin FROM feats)"
_DECISIONS = f"WITH {EVIDENCE}, {_SCORED}, {_decided('scored', 'cve_id, field')}"
_ABLATED = {
    "full": (*_FULL, 0.45, 0.1), "no_authority": (0, *_FULL[1:], 0.45, 0.1), "no_freshness": (_FULL[0], 0, *_FULL[2:], 0.45, 0.1), "no_abstention": (*_FULL, 0.0, 0.0),
    "no_support": (*_FULL[:2], 0, _FULL[3], 0.45, 0.1), "no_agreement": (*_FULL[:3], 0, 0.45, 0.1),
}
_VARIANTS = " UNION ALL ".join(f"SELECT *, '{name}' AS variant, {_score(x[:4])} AS score, {x[4]}::DOUBLE AS threshold, {x[5]}::DOUBLE AS least_margin FROM feats" for name, x in _ABLATED.items())

# --- typing -----------------------------------------------------------------------
_TYPED = f"""{PAIRS}, {SEVERITY}, {PUBLISHED}, {CWE},
typed AS ({' UNION ALL '.join(f"SELECT {_KEYS}, '{f}' AS field, status FROM {f}" for f in study.TYPED)})"""
_CELL = {(g, p): f"count(*) FILTER (gold = '{a}' AND predicted = '{b}')" for g, a in enumerate(_FIVE) for p, b in enumerate(_FIVE)}
_GOLD = "CASE WHEN (o_orderkey + 3 * l_linenumber) % 11 = 0 THEN 'incomplete' WHEN (o_orderkey + l_linenumber) % 13 = 0 THEN 'factual_conflict' ELSE status END"
_I = range(5)
_G, _P = ["(" + " + ".join(f"c{g}_{p}" for p in _I) + ")" for g in _I], ["(" + " + ".join(f"c{g}_{p}" for g in _I) + ")" for p in _I]
_AGREE, _CHANCE = " + ".join(f"c{i}_{i}" for i in _I), " + ".join(f"{_G[i]} * {_P[i]}" for i in _I)
_OFF = " + ".join(f"{(g - p) ** 2} * c{g}_{p}" for g in _I for p in _I)
_OFF_CHANCE = " + ".join(f"{(g - p) ** 2} * {_G[g]} * {_P[p]}" for g in _I for p in _I)
_F1 = [f"CASE WHEN {_G[i]} + {_P[i]} > 0 THEN 2 * c{i}_{i} / ({_G[i]} + {_P[i]})::DOUBLE ELSE 0.0 END" for i in _I]
TYPING = f"""WITH {_TYPED}, g AS (SELECT field, {_GOLD} AS gold, status AS predicted FROM typed),
c AS (SELECT field, {', '.join(f'{x} AS c{g}_{p}' for (g, p), x in _CELL.items())} FROM g GROUP BY GROUPING SETS ((field), ()))
SELECT coalesce(field, 'all') AS field, n, {_R6.format(_AGREE, 'n')} AS accuracy, {_R6.format(' + '.join(_F1), ' + '.join(f'CASE WHEN {_G[i]} + {_P[i]} > 0 THEN 1 ELSE 0 END' for i in _I))} AS macro_f1,
  {_R6.format(f'n * ({_AGREE}) - ({_CHANCE})', f'n * n - ({_CHANCE})')} AS kappa, CASE WHEN {_OFF_CHANCE} > 0 THEN round_even(1 - n * ({_OFF}) / ({_OFF_CHANCE})::DOUBLE, 6) ELSE 0.0 END AS weighted_kappa,
  {', '.join(f'round_even({f}, 6) AS f1_{_FIVE[i]}' for i, f in enumerate(_F1))}
FROM (SELECT *, {' + '.join(_G)} AS n FROM c)"""

_RAW = {
    "severity": ("l_label", "r_label"), "published": ("l_pub", "r_pub"), "cwe_ids": ("concat_ws('|', l_cwe1, l_cwe2)", "concat_ws('|', r_cwe1, r_cwe2)"),
    "references": ("concat_ws('|', l_ref1, l_ref2)", "concat_ws('|', r_ref1, r_ref2, r_ref3)"),
}
_TABLE = {"severity": "severity", "published": "published", "cwe_ids": "cwe_ids", "references": "refs"}
_ABLATION = " UNION ALL ".join(
    f"SELECT 'full' AS variant, '{f}' AS field, status FROM {t} UNION ALL SELECT 'binary', '{f}', CASE status WHEN 'equivalent' THEN 'same' ELSE 'different' END FROM {t} "
    f"UNION ALL SELECT 'no_normalization', '{f}', CASE WHEN nullif({_RAW[f][0]}, '') IS NOT DISTINCT FROM nullif({_RAW[f][1]}, '') THEN 'equivalent' "
    f"WHEN nullif({_RAW[f][0]}, '') IS NULL OR nullif({_RAW[f][1]}, '') IS NULL THEN 'incomplete' ELSE 'factual_conflict' END FROM pairs"
    for f, t in _TABLE.items()
)
_GONE = {"severity": "l_label IS NULL", "published": "l_pub IS NULL", "cwe_ids": "coalesce(l_cwe1, l_cwe2) IS NULL"}
_SHARE = "(o_orderkey * 31 + l_linenumber * 17 + l_partkey) % 100"
_STRESS = " UNION ALL ".join(
    f"SELECT {level}::INT AS missing, '{f}' AS field, CASE WHEN {_SHARE} < {level} THEN CASE WHEN {g} THEN 'equivalent' ELSE 'incomplete' END ELSE status END AS status FROM {t} JOIN lefts USING (o_orderkey)"
    for level in (0, 25, 50, 75) for f, g, t in (("severity", _GONE["severity"], "severity"), ("published", _GONE["published"], "published"), ("cwe_ids", _GONE["cwe_ids"], "cwe_ids"))
)


_OFFICIAL = " OR ".join(f"h = '{o}' OR ends_with(h, '.{o}')" for o in study.OFFICIAL)

ORACLES = {
    "version_interval_relation": f"WITH {PAIRS}, {RANGES}",
    "weakness_relations": f"WITH RECURSIVE {TAXONOMY}",
    "cvss_consistency": f"WITH {CVSS}",
    "update_gaps": f"WITH {GAPS}",
    "evidence_scores": f"WITH {EVIDENCE} SELECT cve_id, field, value, authority, freshness, support, agreement, {_score(_FULL)} AS score FROM feats",
    "evidence_decisions": f"{_DECISIONS} SELECT cve_id, field, kind, winner, score, margin, confidence, abstained, by_priority, by_freshness FROM decided",
    "adjudication_metrics": f"""{_DECISIONS}, m AS (SELECT field, count(*) AS n, count(*) FILTER (NOT abstained) AS k, count(*) FILTER (winner = gold) AS r, count(*) FILTER (NOT abstained AND winner = gold) AS rk,
        count(*) FILTER (abstained AND winner <> gold) AS wa, count(*) FILTER (by_priority = gold) AS rp, count(*) FILTER (by_freshness = gold) AS rf FROM decided GROUP BY field)
      SELECT field, n, {_R6.format('r', 'n')} AS accuracy, {_R6.format('k', 'n')} AS coverage, {_R6.format('wa', 'n - k')} AS abstention_precision, {_R6.format('rk', 'k')} AS selective_accuracy,
        {_R6.format('rp', 'n')} AS priority_accuracy, {_R6.format('rf', 'n')} AS freshness_accuracy FROM m""",
    "risk_coverage": f"""{_DECISIONS}, o AS (SELECT cve_id, field, row_number() OVER w AS rank, sum(CASE WHEN winner <> gold THEN 1 ELSE 0 END) OVER w AS errors, count(*) OVER () AS n FROM decided WINDOW w AS (ORDER BY margin DESC, cve_id, field ROWS UNBOUNDED PRECEDING))
      SELECT cve_id, field, rank, errors::BIGINT AS errors, {_R6.format('rank', 'n')} AS coverage, {_R6.format('errors', 'rank')} AS risk FROM o""",
    "annotation_sample": f"""WITH {_TYPED}, h AS (SELECT *, md5(concat_ws('/', 'study', {', '.join(f'{k}::VARCHAR' for k in adapter.KEYS)}, field)) AS h FROM typed),
      r AS (SELECT *, row_number() OVER (PARTITION BY field, status ORDER BY h, {_KEYS}) AS n FROM h) SELECT {_KEYS}, field, status, n::INT AS place FROM r WHERE n <= {study.SAMPLED}""",
    "typing_metrics": TYPING,
    "discrepancy_rates": f"""SELECT field, n AS pairs, {_R6.format('n - equivalent', 'n')} AS discrepancy_rate, {_R6.format('factual_conflict', 'n - equivalent')} AS conflict_ratio, {_R6.format('incomplete', 'n')} AS incomplete_rate
      FROM (SELECT *, {' + '.join(_FIVE)} AS n FROM ({_stats()}))""",
    "ablation_typing": f"WITH {PAIRS}, {SEVERITY}, {PUBLISHED}, {CWE}, {REFERENCES}, v AS ({_ABLATION}) SELECT variant, field, status, count(*) AS pairs FROM v GROUP BY variant, field, status",
    "ablation_decisions": f"""WITH {EVIDENCE}, variants AS ({_VARIANTS}), {_decided('variants', 'variant, cve_id, field')}
      SELECT variant, field, count(*) AS decisions, count(*) FILTER (abstained) AS abstained, count(*) FILTER (NOT abstained AND winner = gold) AS right_answered FROM decided GROUP BY variant, field""",
    "stress_missing": f"""WITH {PAIRS}, {SEVERITY}, {PUBLISHED}, {CWE}, {ORDERS}, s AS ({_STRESS})
      SELECT missing, field, count(*) AS pairs, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'factual_conflict') AS conflict FROM s GROUP BY missing, field""",
    "official_references": f"""WITH {PAIRS}, {REFERENCES}, o AS (SELECT len(list_filter(ah, lambda h: {_OFFICIAL})) > 0 AS nvd, len(list_filter(bh, lambda h: {_OFFICIAL})) > 0 AS ghsa FROM rf) SELECT nvd, ghsa, count(*) AS pairs FROM o GROUP BY nvd, ghsa""",
}
