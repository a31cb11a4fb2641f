"""Quality rules: learned decision lists over native text statistics.

``statistics`` computes the statistics of each text with Spark expressions.
``learn`` is sequential covering in Spark: a rule grows by the threshold of
best gain on two thirds of the labelled rows that earlier rules leave, is cut
back to the prefix that does best on the other third, and is kept while it is
precise there. A step is one aggregation of (feature, bin, label) counts over
all labelled rows; only those counts, at most bins times features of them, reach
the driver. ``verdict`` is the ordered conditional expression of the rules.

Null texts have no words. Statistics of a text without words are 0. Labels that
are null, or of documents that are not there, take no part; a document with
several labels has the smallest. Without labels there are no rules and every
document passes them; empty tables give no rows. Rows are judged one by one, so
repeated rows agree. Whole texts are read; a very long one takes time and memory
of its task in proportion to its words. Columns other than those named are not
read by ``judge`` and are kept as they are by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import GAP, WORD, scratch, stage

SYMBOLS = "[^#*$%&|<>]+"
FEATURES = ("symbol_share", "repeat_share", "upper_share", "dup_line_share", "mean_word", "mark_share", "length")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more."""

    def windows(w: Column) -> Column:
        return F.sort_array(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        )

    def twice(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(hit, lambda x: x["p"]))
        start = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(words) >= 3, let(windows(words), twice)).otherwise(0).cast("long")


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base statistics, features) of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    n, chars = F.col("n_words"), F.col("word_chars")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    counted = docs.select(
        F.col(doc_id).alias("doc_id"),
        let(
            words_of(t),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
        ).alias("w"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).alias("upper"),
        F.length(F.regexp_replace(t, "[^!?]+", "")).alias("marks"),
    )
    flat = counted.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.all").alias("lines"), "upper", "marks")
    return flat.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share(F.col("n_symbols"), n).alias("symbol_share"),
        share(F.col("n_repeat_words"), n).alias("repeat_share"),
        share(F.col("upper"), chars).alias("upper_share"),
        share(F.col("n_dup_lines"), F.col("lines")).alias("dup_line_share"),
        share(chars, n).alias("mean_word"),
        share(F.col("marks"), n).alias("mark_share"),
        n.cast("double").alias("length"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression: the number of the first rule that holds, null if none does."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(holds(rule), i) if out is None else out.when(holds(rule), i)
    return (out if out is not None else F.lit(None)).cast("int")


def _quality(p: float, n: float) -> float:
    return math.log2((p + 1) / (p + n + 2))


def learn(labelled: DataFrame, *, bad: str = "bad", features: tuple[str, ...] = FEATURES, bins: int = 48, max_rules: int = 8, max_conditions: int = 4, precision: float = 0.98, least: int = 5) -> list[Rule]:
    """Rules that mark rows whose ``bad`` is true.

    ``labelled`` holds ``bad`` and the features; thresholds are quantiles of each
    feature among the bad and among the other rows.
    """
    grid = [(i + 0.5) / bins for i in range(bins)]
    cuts_by = labelled.groupBy(bad).agg(*[F.percentile_approx(f, grid, 10_000).alias(f) for f in features]).collect()  # two rows
    if len(cuts_by) < 2:
        return []
    cuts = {f: sorted({x for row in cuts_by for x in (row[f] or [])}) for f in features}
    binned = labelled.select(bad, "grow", *features, *[_bin_of(F.col(f), cuts[f]).alias(f"_{f}") for f in features])
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = binned.where(verdict(rules).isNull())
        rule = _grow(left.where("grow"), bad, features, cuts, max_conditions)
        if not rule:
            break
        rule = _prune(left.where("not grow"), bad, rule, precision, least)
        if not rule:
            break
        rules.append(rule)
    return rules


def _bin_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < value))


def _grow(rows: DataFrame, bad: str, features: tuple[str, ...], cuts: dict, most: int) -> Rule:
    rule: Rule = ()
    entries = ", ".join(f"'{f}', `_{f}`" for f in features)
    while len(rule) < most:
        table = (
            rows.where(holds(rule))
            .selectExpr(f"`{bad}` as bad", f"stack({len(features)}, {entries}) as (feature, bin)")
            .groupBy("feature", "bin")
            .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
            .collect()
        )  # at most a row for each feature and bin
        total_p = sum(r["p"] for r in table) / len(features)
        total_n = sum(r["n"] for r in table) / len(features)
        if not total_p or not total_n:
            break
        best, chosen = 0.0, None
        for f in features:
            below_p = below_n = 0
            by_bin = {r["bin"]: r for r in table if r["feature"] == f}
            for i, cut in enumerate(cuts[f]):
                below_p += by_bin[i]["p"] if i in by_bin else 0
                below_n += by_bin[i]["n"] if i in by_bin else 0
                for above in (True, False):
                    p, n = (total_p - below_p, total_n - below_n) if above else (below_p, below_n)
                    gain = p * (_quality(p, n) - _quality(total_p, total_n)) if p else 0.0
                    if gain > best + 1e-9:
                        best, chosen = gain, Condition(f, above, float(cut))
        if chosen is None or chosen in rule:
            break
        rule = (*rule, chosen)
    return rule


def _prune(rows: DataFrame, bad: str, rule: Rule, precision: float, least: int) -> Rule:
    """The prefix of the rule that does best on rows it did not grow on, if it is precise enough."""
    sums = []
    for k in range(1, len(rule) + 1):
        sums += [F.count_if(holds(rule[:k]) & F.col(bad)).alias(f"p{k}"), F.count_if(holds(rule[:k]) & ~F.col(bad)).alias(f"n{k}")]
    row = rows.agg(*sums).first()
    worth = {k: (row[f"p{k}"] - row[f"n{k}"]) / max(1, row[f"p{k}"] + row[f"n{k}"]) for k in range(1, len(rule) + 1)}
    k = max(worth, key=lambda i: (round(worth[i], 4), row[f"p{i}"], -i))
    p, n = row[f"p{k}"], row[f"n{k}"]
    return rule[:k] if p >= least and p >= precision * (p + n) else ()


def label(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", target: str = "quality") -> DataFrame:
    """Statistics of labelled documents with ``bad`` (target 0) and ``grow`` (two thirds, by hash)."""
    told = labels.where(F.col(target).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.min(target) == 0).alias("bad"))
    return stats.join(told, stats["doc_id"] == told["_key"]).withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).drop("_key")


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base statistics, features, base_failed, rule, kept) of each document.

    ``rule`` is the number of the learned rule that rejects it, if one does.
    """
    stats = stage(statistics(docs, doc_id=doc_id, text=text), "quality")
    with scratch(docs.sparkSession):
        rules = learn(stage(label(stats, labels).where(~base_failed()), "quality-labelled"))
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no learned rule rejects, with all their columns.

    Rules are learned on all labelled documents. A row is judged by its own
    text, so rows that share an id may fare differently.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    judged = stage(statistics(whole, doc_id="row"), "quality")  # each row with its statistics, so that no row moves
    stats = judged.select(F.col(f"doc_id.`{doc_id}`").alias("doc_id"), *judged.columns[1:])
    with scratch(docs.sparkSession):
        rules = learn(stage(label(stats, labels), "quality-labelled"))
    return judged.where(verdict(rules).isNull()).select("doc_id.*")
