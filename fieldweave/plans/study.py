"""Registered queries of the study operators: ranges, taxonomy, scores, evidence, decisions and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.operators import compare, cvss, evaluation, evidence, history, ranges, sampling, taxonomy, variants
from fieldweave.operators.once import once
from fieldweave.plans import adapter

KEYS = adapter.KEYS
#: Authority of the sources that the adapter's records come from.
AUTHORITY = {"nvd": 0.9, "feed0": 0.7, "feed1": 0.5, "feed2": 0.3}
OFFICIAL = ("h1.example.org", "h3.example.org")
#: Fields whose statuses are sampled and evaluated.
TYPED = ("severity", "published", "cwe_ids")
SAMPLED = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.normalized(adapter.all_pairs(spark, sf_dir))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of orders and of their lines, whose source follows from the supplier."""
    left = evidence.claims(adapter.left_records(spark, sf_dir), F.lit("nvd"))
    right = evidence.claims(adapter.right_records(spark, sf_dir, "l_suppkey"), F.concat(F.lit("feed"), (F.col("l_suppkey") % 3).cast("string")))
    return left.unionByName(right)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.features(_claims(spark, sf_dir), AUTHORITY)


def _with_gold(decided: DataFrame) -> DataFrame:
    """A gold value by a fixed rule: of every fifth id what the newest claim says, of the others what the best source says."""
    number = F.regexp_extract("cve_id", r"(\d+)$", 1).cast("long")
    return decided.withColumn("gold", F.when(number % 5 == 0, F.col("by_freshness")).otherwise(F.col("by_priority")))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keys, field, status) of all pairs."""
    statuses = {f: s["status"] for f, s in compare.discrepancies().items() if f in TYPED}
    return sampling.long_statuses(statuses, [*KEYS], _normalized(spark, sf_dir))


def version_interval_relation(spark, sf_dir):
    """How both sides' version ranges of every pair lie to each other, and what they share; equal ranges are held against each other once."""

    def judge(raw: DataFrame) -> DataFrame:
        pairs = compare.normalized(adapter.records_of(raw))
        told = pairs.select(*raw.columns, ranges.compared(F.col("nvd_effective"), F.col("ghsa_effective")).alias("r"))
        spelled = [ranges.spelled(F.col(f"r.{c}")).alias(c) for c in ("shared", "left_only", "right_only")]
        return told.select(
            *raw.columns, F.col("r.relation").alias("relation"), *spelled, ranges.spelled(F.col("r.union")).alias("covered"), ranges.spelled(ranges.gaps(F.col("r.union"))).alias("gaps"),
            F.col("r.unreadable").cast("int").alias("unreadable"),
        )

    sides = [adapter.raw_values(spark, sf_dir, *names) for names in adapter.SPANS.values()]
    told = once(adapter.raw_pairs(spark, sf_dir), sides, judge)
    return told.select(*KEYS, "relation", "shared", "left_only", "right_only", "covered", "gaps", "unreadable")


def weakness_relations(spark, sf_dir):
    """Pairs of weaknesses of all lines in a taxonomy over the parts: each has one parent or two."""
    p = F.col("p_partkey")
    parents = F.array_distinct(F.when(p % 5 == 0, F.array(F.floor(p / 2), F.floor(p / 3))).otherwise(F.array(F.floor(p / 2))))
    named = lambda c: F.concat(F.lit("CWE-"), c.cast("string"))
    edges = _table(spark, sf_dir, "part").where(p > 0).select(named(p).alias("child"), F.explode(parents).alias("q")).select("child", named(F.col("q")).alias("parent"))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("lines"))
    pairs = lines.select(named(F.col("l_partkey")).alias("left_id"), named(F.col("l_suppkey")).alias("right_id"), "lines")
    return taxonomy.related(pairs, edges, "left_id", "right_id").select("left_id", "right_id", "lines", "relation", "common", "distance")


def cvss_consistency(spark, sf_dir):
    """Vectors derived from orders and lines: recomputed scores, what they are off by, and the metrics that differ."""
    pairs = adapter.joined(spark, sf_dir).selectExpr(*KEYS, f"{adapter.VECTORS['l_vector']} AS l_vector", f"{adapter.VECTORS['r_vector']} AS r_vector", f"{adapter.VECTORS['l_score']} AS l_score")
    scores = cvss.consistency(pairs, "l_vector", "r_vector")
    return scores.select(
        *KEYS, "left_base", "right_base", F.bround(F.col("l_score") - F.col("left_base"), 1).alias("left_delta"), F.bround(F.col("left_base") - F.col("right_base"), 1).alias("base_delta"),
        F.array_join("differing", "|").alias("differing"),
    )


def update_gaps(spark, sf_dir):
    """Changes that two of the event types make to a user: how far the other side is behind at each."""
    side = F.when(F.col("event_type").isin("view", "click"), "left").when(F.col("event_type").isin("purchase", "signup"), "right")
    changes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), side.alias("side"), F.date_trunc("second", "ts").alias("time"), F.format_string("%s/%012d", F.floor("value").cast("string"), "event_id").alias("value"))
    gaps = history.update_gaps(changes.where(F.col("side").isNotNull()), ("left", "right"))
    level = F.substring_index("value", "/", 1) == F.substring_index("other_value", "/", 1)
    return gaps.select("key", "side", "value", "other_value", "lag_seconds", F.when(level, "level").otherwise(F.col("gap")).alias("gap"))


def evidence_scores(spark, sf_dir):
    """Every candidate value with its evidence and score."""
    return evidence.scored(_features(spark, sf_dir)).select("cve_id", "field", "value", *evidence.FEATURES, "score")


def evidence_decisions(spark, sf_dir):
    """The decision for every id and field, with what static baselines would take."""
    return evidence.decide(evidence.scored(_features(spark, sf_dir)))


def adjudication_metrics(spark, sf_dir):
    """Accuracy, coverage and the worth of abstaining, by field, beside two baselines."""
    return evaluation.adjudication_metrics(_with_gold(evidence_decisions(spark, sf_dir)))


def risk_coverage(spark, sf_dir):
    """Coverage and risk along all decisions from the surest on."""
    decided = _with_gold(evidence_decisions(spark, sf_dir)).select("cve_id", "field", "margin", (F.col("winner") != F.col("gold")).alias("wrong"))
    curve = evaluation.risk_coverage(decided, [F.desc("margin"), F.asc("cve_id"), F.asc("field")], F.col("wrong"))
    return curve.select("cve_id", "field", "rank", "errors", "coverage", "risk")


def annotation_sample(spark, sf_dir):
    """Fifty pairs of each field and status, for annotation."""
    return sampling.bottom_k(_typed(spark, sf_dir), ["field", "status"], SAMPLED, [*KEYS, "field"], seed="study").select(*KEYS, "field", "status", "place")


def typing_metrics(spark, sf_dir):
    """Typing of all pairs against gold labels that a fixed rule moves away from it."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    gold = F.when((k + 3 * n) % 11 == 0, "incomplete").when((k + n) % 13 == 0, "factual_conflict").otherwise(F.col("status"))
    return evaluation.typing_metrics(_typed(spark, sf_dir).select("field", gold.alias("gold"), F.col("status").alias("predicted")))


def discrepancy_rates(spark, sf_dir):
    """Shares of pairs that differ, and of conflicts among them, by field."""
    return evaluation.discrepancy_rates(compare.status_totals(adapter.all_pairs(spark, sf_dir)))


def ablation_typing(spark, sf_dir):
    """Status counts of all pairs under three variants of the typing."""
    return variants.typing_ablations(adapter.all_pairs(spark, sf_dir))


def ablation_decisions(spark, sf_dir):
    """Decisions under each ablation of the evidence: how many answer, abstain, and are right."""
    decided = evidence.decide_under(_features(spark, sf_dir), evidence.ABLATIONS)
    counts = _with_gold(decided).groupBy("variant", "field")
    return counts.agg(
        F.count("*").alias("decisions"), F.count_if("abstained").alias("abstained"), F.count_if(~F.col("abstained") & (F.col("winner") == F.col("gold"))).alias("right_answered")
    )


def stress_missing(spark, sf_dir):
    """Typing as more and more right records lose their values."""
    share = F.pmod(F.col("o_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey"), F.lit(100))
    return variants.stress(adapter.all_pairs(spark, sf_dir), share)


def official_references(spark, sf_dir):
    """Whether official hosts stand among either side's references, counted over all pairs."""
    sides = [variants.official_presence(F.col(f"{s}_hosts"), OFFICIAL).alias(s) for s in ("nvd", "ghsa")]
    return _normalized(spark, sf_dir).select(*sides).groupBy("nvd", "ghsa").agg(F.count("*").alias("pairs"))


QUERIES = {
    f.__name__: f
    for f in (
        version_interval_relation, weakness_relations, cvss_consistency, update_gaps, evidence_scores, evidence_decisions, adjudication_metrics, risk_coverage,
        annotation_sample, typing_metrics, discrepancy_rates, ablation_typing, ablation_decisions, stress_missing, official_references,
    )
}
