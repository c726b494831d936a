"""Retrieval metrics by word overlap, resolution quality, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_set

TOLERANCE = 0.02


def share(part: Column, whole: Column) -> Column:
    """The share of the set `whole` that `part` has; 0 for an empty set."""
    return F.when(F.size(whole) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(whole))


def _all_words(texts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, word_set)))


def context_precision(contexts: Column, truth: Column) -> Column:
    """Mean over contexts of the share of the truth's words that each has."""
    own = word_set(truth)
    n = F.size(contexts)
    total = F.aggregate(contexts, F.lit(0.0), lambda s, c: s + share(word_set(c), own))
    return F.when(n <= 0, F.lit(0.0)).otherwise(total / n)


def faithfulness(answer: Column, contexts: Column) -> Column:
    return share(_all_words(contexts), word_set(answer))


def answer_relevancy(question: Column, answer: Column) -> Column:
    return share(word_set(answer), word_set(question))


def context_recall(contexts: Column, truths: Column) -> Column:
    return share(_all_words(contexts), _all_words(truths))


def pass_rate(checked: DataFrame, least: float = 0.5) -> DataFrame:
    """pass_rate: the share of claims that score `least` or more; 0 without claims."""
    return checked.agg(F.coalesce(F.avg((F.col("score") >= least).cast("double")), F.lit(0.0)).alias("pass_rate"))


def resolution_quality(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """precision, recall: predicted groups inside a gold one, and gold groups inside a predicted one.

    Groups are (group_id, member) rows: a group is inside another when its members are all joined to that one.
    """

    def inside(a: DataFrame, b: DataFrame) -> DataFrame:
        sizes = a.groupBy("group_id").agg(F.countDistinct("member").alias("n"))
        met = a.distinct().join(b.select("member", F.col("group_id").alias("other")).distinct(), "member").groupBy("group_id", "other").agg(F.count("*").alias("m"))
        held = met.groupBy("group_id").agg(F.max("m").alias("m"))
        return sizes.join(held, "group_id", "left").agg(F.coalesce(F.avg((F.coalesce("m", F.lit(0)) == F.col("n")).cast("double")), F.lit(0.0)).alias("v"))

    p, r = inside(predicted, gold).withColumnRenamed("v", "precision"), inside(gold, predicted).withColumnRenamed("v", "recall")
    return p.join(F.broadcast(r))


def metrics(rows: DataFrame) -> DataFrame:
    """id, metric, value in long form of rows with question, answer, contexts, truths."""
    values = {
        "context_precision": context_precision(F.col("contexts"), F.array_join("truths", " ")),
        "faithfulness": faithfulness(F.col("answer"), F.col("contexts")),
        "answer_relevancy": answer_relevancy(F.col("question"), F.col("answer")),
        "context_recall": context_recall(F.col("contexts"), F.col("truths")),
    }
    each = F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()))
    return rows.select("id", F.explode(each).alias("m")).select("id", "m.metric", "m.value")


def means(measured: DataFrame) -> DataFrame:
    return measured.groupBy("metric").agg(F.avg("value").alias("value"))


def regression_gate(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """metric, baseline, current, delta, status: failed only below the baseline less the tolerance; new_metric where there is none."""
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "left")
    status = F.when(F.col("baseline").isNull(), "new_metric").when(F.col("current") < F.col("baseline") - tolerance, "failed").otherwise("passed")
    return both.select("metric", F.round("baseline", 4).alias("baseline"), F.round("current", 4).alias("current"), F.round(F.col("current") - F.col("baseline"), 4).alias("delta"), status.alias("status"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, winner: a metric that one side lacks is 0 there."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    rows = both.select("metric", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    return rows.withColumn("winner", F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b").otherwise("tie"))


def latency(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """count, mean, most and p99, the value at place floor(0.99 n) of the sorted ones, exact: counted by value, so a group is never gathered."""
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    placed = counts.select(*by, value, "c", F.sum("c").over(w.orderBy(value)).alias("upto"), F.sum("c").over(w).alias("n"))
    place = F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)
    return placed.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.max(value).alias("most"), F.min(F.when(F.col("upto") > place, F.col(value))).alias("p99"))


def hit_rate(lookups: DataFrame, hit: str = "hit") -> DataFrame:
    return lookups.agg(F.coalesce(F.avg(F.col(hit).cast("double")), F.lit(0.0)).alias("hit_rate"))
