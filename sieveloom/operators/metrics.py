"""Ranking, thresholds and per-label evaluation over long score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROB_EPS = 1e-6
UNSUPPORTED = -30.0


def to_logit(p: Column) -> Column:
    """Logit with the probability clamped; null is unsupported."""
    q = F.least(F.greatest(p, F.lit(PROB_EPS)), F.lit(1 - PROB_EPS))
    return F.coalesce(F.ln(q) - F.log1p(-q), F.lit(UNSUPPORTED))


def precision_recall(rows: DataFrame) -> DataFrame:
    """rows (sample, tag, pred, truth) -> tag, precision, recall, f1, support; denominators are 1 at least."""
    per = rows.groupBy("tag").agg(F.sum(F.col("pred") * F.col("truth")).alias("tp"), F.sum("pred").alias("p"), F.sum("truth").alias("support"))
    precision, recall = F.col("tp") / F.greatest(F.col("p"), F.lit(1)), F.col("tp") / F.greatest(F.col("support"), F.lit(1))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return per.select("tag", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(f1, 9).alias("f1"), "support")


def micro_f1(rows: DataFrame) -> DataFrame:
    per = rows.agg(F.sum(F.col("pred") * F.col("truth")).alias("tp"), F.sum("pred").alias("p"), F.sum("truth").alias("t"))
    return per.select(F.round(2 * F.col("tp") / F.greatest(F.col("p") + F.col("t"), F.lit(1)), 9).alias("micro_f1"))


def average_precision(scores: DataFrame, cells: int = 4096) -> DataFrame:
    """tag, ap: mean precision at the positives by descending score, ties by sample;
    null without positives. Ranks are sums over score cells plus a rank inside a
    cell, so a tag's rows spread over many tasks."""
    rows = scores.withColumn("_cell", F.floor(F.col("score") * cells))
    per = rows.groupBy("tag", "_cell").agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("pos"))
    above = Window.partitionBy("tag").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("tag", "_cell", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n"), F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("_pos"))
    order = Window.partitionBy("tag", "_cell").orderBy(F.desc("score"), "sample")
    inside = rows.select("tag", "_cell", "truth", F.row_number().over(order).alias("_r"), F.sum("truth").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_t"))
    ranked = inside.join(base, ["tag", "_cell"])
    precision = (F.col("_pos") + F.col("_t")) / (F.col("_n") + F.col("_r"))
    return ranked.groupBy("tag").agg(F.round(F.avg(F.when(F.col("truth") == 1, precision)), 9).alias("ap"))


def best_thresholds(scores: DataFrame, min_support: int = 1, default: float = 0.5) -> DataFrame:
    """tag, threshold, f1: of .05 to .95 the first with the best F1, fired strictly
    above; the default below ``min_support`` positives. Each score is put in the
    step it reaches, and steps are summed from the top: no row per threshold."""
    step = F.least(F.greatest(F.ceil(F.round(F.col("score") * 20, 9)) - 1, F.lit(0)), F.lit(19)).cast("int")  # thresholds 1..step are below the score
    bins = scores.groupBy("tag", step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("pos"))
    total = scores.groupBy("tag").agg(F.sum("truth").alias("support"))
    every = total.select("tag", "support", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("step")).join(bins, ["tag", "step"], "left").fillna(0, ["n", "pos"])
    above = Window.partitionBy("tag").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    swept = every.select("tag", "support", "step", F.sum("pos").over(above).alias("tp"), F.sum("n").over(above).alias("fired")).where("step >= 1")
    f1 = F.round(2 * F.col("tp") / F.greatest(F.col("fired") + F.col("support"), F.lit(1)), 9)
    best = swept.groupBy("tag", "support").agg(F.max(F.struct(f1.alias("f1"), (-F.col("step")).alias("neg"))).alias("best"))
    low = F.col("support") < min_support
    return best.select("tag", F.when(low | (F.col("best.f1") <= 0), F.lit(default)).otherwise(F.round(-F.col("best.neg") * 0.05, 2)).alias("threshold"), F.when(low, F.lit(None)).otherwise(F.col("best.f1")).alias("f1"))


def reliability(scores: DataFrame, bins: int = 15) -> DataFrame:
    """bin, n, confidence, accuracy; the last bin is closed."""
    index = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("confidence"), F.round(F.avg("truth"), 9).alias("accuracy"))


def expected_error(scores: DataFrame, bins: int = 15) -> DataFrame:
    per = reliability(scores, bins)
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n"), 6).alias("ece"))


def group_winner(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """scores (image, tag, score, grp) -> the best member of each group that clears
    its own threshold; ties go to the smaller tag."""
    order = Window.partitionBy("image", "grp").orderBy(F.desc("score"), "tag")
    top = scores.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return top.join(thresholds, "tag").where(F.col("score") >= F.col("threshold")).select("image", "grp", "tag", "score")


def top_capped(scores: DataFrame, cap: Column, partition: list[str]) -> DataFrame:
    """The ``cap`` best of a partition: score, then name, both descending."""
    order = Window.partitionBy(*partition).orderBy(F.desc("score"), F.desc("tag"))
    return scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")


def best_margin(scores: DataFrame, source: str, score: str, name: str) -> DataFrame:
    """(source, best, best_score, margin) to the runner-up; null without one."""
    order = Window.partitionBy(source).orderBy(F.desc(score), name)
    ranked = scores.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    return ranked.groupBy(source).agg(F.max(F.when(F.col("_r") == 1, F.col(name))).alias("best"), F.max(F.when(F.col("_r") == 1, F.col(score))).alias("best_score"), F.round(F.max(F.when(F.col("_r") == 1, F.col(score))) - F.max(F.when(F.col("_r") == 2, F.col(score))), 9).alias("margin"))


def read_back(captions: DataFrame, logits: DataFrame, recall_at: float | None = None) -> DataFrame:
    """Mean log-sigmoid of an image's logits over a caption's tags, or the share at or
    above a threshold. captions (caption, tag), logits (image, tag, logit)."""
    x = F.col("logit")
    value = F.avg(-F.log1p(F.exp(-x))) if recall_at is None else F.avg((x >= recall_at).cast("double"))
    return captions.join(logits, "tag").groupBy("caption", "image").agg(F.round(value, 9).alias("value"))


def frequency_tier(freq: Column, head: int = 1000, mid: int = 200) -> Column:
    return F.when(freq >= head, "head").when(freq >= mid, "mid").otherwise("tail")


def ratings_normalized(p: Column) -> Column:
    """Four sigmoids as shares of their sum, which is 1e-6 at least."""
    total = F.greatest(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), F.lit(PROB_EPS))
    return F.transform(p, lambda x: x / total)


def argmax_first(p: Column) -> Column:
    return F.array_position(p, F.array_max(p)) - 1
