"""Evidence for candidate values, and decisions that may abstain.

A claim says that a source gave a value for a field of an id, when it was last seen and how
many references came with it. The evidence of a candidate value is the
authority of its best source, how fresh its last claim is beside the newest claim for the same id and field,
how many references support it, and what share of the id's sources agree on it. A score is the
weighted sum. Claims move once, to the task of their id and field, which folds them as they come into a row a value;
evidence, scores and decisions under any number of policies follow there, sorted and spilled by Spark if need be.

Claims without a value are no candidates; null ids and fields are ids and fields like others. A claim
never seen at a known time is not fresh. Sources without a stated authority weigh nothing
and count as one source.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave import constants as K
from fieldweave.functions import dates, text

FEATURES = ("authority", "freshness", "support", "agreement")


@dataclass(frozen=True)
class Policy:
    """Weights of the four parts, when to abstain, and how fast evidence ages."""

    authority: float = 0.4
    freshness: float = 0.2
    support: float = 0.15
    agreement: float = 0.25
    threshold: float = 0.45
    margin: float = 0.1
    half_life_days: float = 30.0


#: What each ablation leaves out.
ABLATIONS = {
    "full": Policy(),
    "no_authority": replace(Policy(), authority=0.0),
    "no_freshness": replace(Policy(), freshness=0.0),
    "no_abstention": replace(Policy(), threshold=0.0, margin=0.0),
    "no_support": replace(Policy(), support=0.0),
    "no_agreement": replace(Policy(), agreement=0.0),
}


def claims(records: DataFrame, source: Column) -> DataFrame:
    """(cve_id, field, value, source, seen, refs) of shared records: normalized severity, publication day and weaknesses."""
    told = {
        "severity": text.canonical_severity(F.col("severity.label"), K.SEVERITY),
        "published": F.to_date("_published").cast("string"),
        "cwe_ids": F.nullif(F.array_join(text.cwe_set(F.col("cwe_ids")), "|"), F.lit("")),
    }
    timed = records.select(
        "cve_id", "severity", "cwe_ids", source.alias("source"), dates.parse_iso(F.col("published")).alias("_published"),
        dates.parse_iso(F.col("last_modified")).alias("seen"), F.coalesce(F.size("references"), F.lit(0)).alias("refs"),
    )
    entries = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in told.items()])
    return timed.select("cve_id", "source", "seen", "refs", F.inline(entries)).where(F.col("value").isNotNull()).select("cve_id", "field", "value", "source", "seen", "refs")


def features(told: DataFrame, authority: dict[str, float], half_life_days: float = Policy.half_life_days) -> DataFrame:
    """(cve_id, field, value, latest, the four parts of the evidence) of every candidate value; ``authority`` ranks at most 62 sources."""
    bit, best = F.lit(2**62), F.when(F.col("sources").bitwiseAND(F.lit(2**62)) != 0, 0.0)
    for i, (name, w) in enumerate(authority.items()):
        bit = F.when(F.col("source") == name, F.lit(2**i)).otherwise(bit)
        best = F.greatest(best, F.when(F.col("sources").bitwiseAND(F.lit(2**i)) != 0, float(w)))
    known = told.where(F.col("value").isNotNull()).select("cve_id", "field", "value", bit.cast("long").alias("bit"), "seen", "refs").repartition("cve_id", "field")
    values = known.groupBy("cve_id", "field", "value").agg(F.max("seen").alias("latest"), F.sum("refs").alias("refs"), F.bit_or("bit").alias("sources"))
    of_key = Window.partitionBy("cve_id", "field")
    whole = values.withColumns({"newest": F.max("latest").over(of_key), "all_sources": F.bit_or("sources").over(of_key)})
    age = F.datediff("newest", "latest")
    return whole.select(
        "cve_id", "field", "value", "latest", best.alias("authority"),
        F.coalesce(F.bround(F.pow(F.lit(0.5), age / half_life_days), 6), F.lit(0.0)).alias("freshness"),
        F.bround(F.col("refs") / (F.col("refs") + 1), 6).alias("support"),
        F.bround(F.bit_count("sources") / F.bit_count("all_sources"), 6).alias("agreement"),
    )


def _score(weights: dict[str, Column]) -> Column:
    """The weighted sum, of whole numbers: parts count in millionths, weights in ten-thousandths."""
    total = F.lit(0).cast("long")
    for name in FEATURES:
        total = total + F.round(weights[name] * 10_000).cast("long") * F.round(F.col(name) * 1_000_000).cast("long")
    return total / F.lit(1e10)


def scored(found: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``features`` with the score of each candidate value under a policy."""
    return found.withColumn("score", _score({n: F.lit(float(getattr(policy, n))) for n in FEATURES}))


def under_variants(found: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """``features`` with ``variant``, ``score``, ``threshold`` and ``least_margin`` of each policy: policies as rows, in one scan."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), *[F.lit(float(getattr(p, n))).alias(f"w_{n}") for n in FEATURES], F.lit(p.threshold).alias("threshold"), F.lit(p.margin).alias("least_margin"))
            for name, p in policies.items()
        ]
    )
    wide = found.select("*", F.inline(rows))
    return wide.withColumn("score", _score({n: F.col(f"w_{n}") for n in FEATURES})).drop(*[f"w_{n}" for n in FEATURES])


def decide(candidates: DataFrame, policy: Policy | None = Policy(), keys: tuple[str, ...] = ("cve_id", "field")) -> DataFrame:
    """(keys, kind, winner, score, margin, confidence, abstained, by_priority, by_freshness) of scored candidates.

    The best of a key is told to all its candidates in their task, and the next follows from the others; nothing
    is joined. ``winner`` is the value of the highest score, of equal ones the smallest, also where it is
    abstained from: below the threshold, or less than the margin ahead of the next. A key of one value
    is ``agreed`` and has its score as margin, one of several is ``disputed``. ``by_priority``
    and ``by_freshness`` are the values that the best source and the newest claim give. Without a policy
    the candidates carry ``threshold`` and ``least_margin``.
    """
    limits = {"threshold": F.lit(policy.threshold), "least_margin": F.lit(policy.margin)} if policy else {}
    rows = candidates.withColumns(limits) if policy else candidates
    place = F.struct((-F.col("score")).alias("far"), F.col("value").alias("value"))
    told = rows.withColumn("best", F.min(place).over(Window.partitionBy(*keys)))
    best = told.groupBy(*keys).agg(F.first("best").alias("best"), F.first("threshold").alias("threshold"), F.first("least_margin").alias("least_margin"), _next("score", "best").alias("next"), *_beside())
    return best.select(*keys, *_verdict(F.col("best"), F.col("next"), F.col("threshold"), F.col("least_margin")), F.col("prior.value").alias("by_priority"), F.col("fresh.value").alias("by_freshness"))


def decide_under(found: DataFrame, policies: dict[str, Policy], keys: tuple[str, ...] = ("cve_id", "field")) -> DataFrame:
    """What ``decide(under_variants(found, policies), None, ("variant", *keys))`` gives: candidates stay single rows, and decisions become rows a policy."""
    of_key = Window.partitionBy(*keys)
    weigh = {f"s_{i}": _score({n: F.lit(float(getattr(p, n))) for n in FEATURES}) for i, p in enumerate(policies.values())}
    wide = found.withColumns(weigh)
    told = wide.withColumns({f"b_{i}": F.min(F.struct((-F.col(f"s_{i}")).alias("far"), F.col("value").alias("value"))).over(of_key) for i in range(len(policies))})
    best = told.groupBy(*keys).agg(
        *[c for i in range(len(policies)) for c in (F.first(f"b_{i}").alias(f"b_{i}"), _next(f"s_{i}", f"b_{i}").alias(f"n_{i}"))], *_beside()
    )
    rows = F.array(
        *[F.struct(F.lit(name).alias("variant"), *_verdict(F.col(f"b_{i}"), F.col(f"n_{i}"), F.lit(p.threshold), F.lit(p.margin))) for i, (name, p) in enumerate(policies.items())]
    )
    decided = best.select(*keys, F.inline(rows), F.col("prior.value").alias("by_priority"), F.col("fresh.value").alias("by_freshness"))
    return decided.select("variant", *[c for c in decided.columns if c != "variant"])


def _next(score: str, best: str) -> Column:
    """The score, negated, of the best candidate but the winner."""
    return F.min(F.when(F.col("value") != F.col(f"{best}.value"), -F.col(score)))


def _beside() -> list[Column]:
    """How many candidates a key has, and the values of its best source and its newest claim."""
    return [
        F.count("*").alias("n"),
        F.min(F.struct((-F.col("authority")).alias("far"), F.col("value").alias("value"))).alias("prior"),
        F.min(F.struct((-F.unix_micros(F.coalesce("latest", F.lit("0001-01-01").cast("timestamp")))).alias("far"), F.col("value").alias("value"))).alias("fresh"),
    ]


def _verdict(best: Column, following: Column, threshold: Column, least: Column) -> list[Column]:
    """kind, winner, score, margin, confidence and abstained of a key with ``n`` candidates."""
    score, several = -best["far"], F.col("n") > 1
    margin = F.bround(score + F.coalesce(following, F.lit(0.0)), 10)
    abstained = (score < threshold) | (several & (margin < least))
    sure = F.when(abstained, "low").when(margin >= 2 * least, "high").otherwise("medium")
    return [
        F.when(several, "disputed").otherwise("agreed").alias("kind"), best["value"].alias("winner"), score.alias("score"), margin.alias("margin"),
        sure.alias("confidence"), abstained.alias("abstained"),
    ]
