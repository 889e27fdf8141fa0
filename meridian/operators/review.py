"""Reviewer verdicts, label building, splits and selection for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import uncertainty


def latest(verdicts: DataFrame, key: str = "source_id") -> DataFrame:
    """Newest verdict per source; the later row wins ties."""
    newest = verdicts.groupBy(key).agg(F.max(F.struct("ts", "seq", *[c for c in verdicts.columns if c not in ("ts", "seq", key)])).alias("v"))
    return newest.select(key, "v.*")


def label_reasons(verdicts: DataFrame, classes: list[str]) -> DataFrame:
    """Latest verdicts with the reason they are kept or dropped for training."""
    reason = F.when(~F.col("confident"), "unsure").when(~F.col("label").isin(classes), "out_of_class").otherwise("kept")
    return latest(verdicts).withColumn("reason", reason)


def valid_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.coalesce(F.trim("reviewer"), F.lit("")) != "")


def agreement(verdicts: DataFrame) -> DataFrame:
    """n, share of agreement and confidently wrong verdicts (> 0.9) per model label."""
    same = F.col("label") == F.col("model_label")
    return verdicts.groupBy("model_label").agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("agreement"), F.sum((~same & (F.col("model_confidence") > 0.9)).cast("long")).alias("confidently_wrong"))


def disagreements(verdicts: DataFrame, key: str = "source_id") -> DataFrame:
    labels = verdicts.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return labels.filter(F.size("labels") > 1).select(key, F.concat_ws("|", "labels").alias("labels"))


def stratified_split(rows: DataFrame, key: str, label: str, fractions=(0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """Adds ``part`` (0, 1, 2): each class is cut at the fractions in hash order."""
    w = Window.partitionBy(label)
    at = (F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), key), key)) - 0.5) / F.count("*").over(w)
    return rows.withColumn("at_", at).withColumn("part", F.when(F.col("at_") < fractions[0], 0).when(F.col("at_") < fractions[0] + fractions[1], 1).otherwise(2)).drop("at_")


def grouped_split(rows: DataFrame, group: str, fractions=(0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """Adds ``part``: whole groups go to one side by their hash."""
    at = F.pmod(F.xxhash64(F.lit(seed), group), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("part", F.when(at < fractions[0], 0).when(at < fractions[0] + fractions[1], 1).otherwise(2))


def select_for_review(rows: DataFrame, key: str, n: int, strategy: str, method: str = "margin", seed: int = 0) -> DataFrame:
    """``n`` rows (with array ``p``) to review: random, confident, uncertainty, or balanced over predicted classes."""
    if strategy == "random":
        return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    score = uncertainty(F.col("p"), method)
    if strategy in ("uncertainty", "confident"):
        ranked = F.round(score, 9)
        return rows.orderBy(ranked.desc() if strategy == "uncertainty" else ranked.asc(), key).limit(n)
    if strategy != "balanced":
        raise ValueError(f"unknown strategy {strategy}")
    rows = rows.withColumns({"class_": F.array_position("p", F.array_max("p")), "score_": F.round(score, 9)})
    turn = F.row_number().over(Window.partitionBy("class_").orderBy(F.desc("score_"), key))
    # in turns over the classes; a class that runs out leaves its places to the others
    return rows.withColumn("turn_", turn).orderBy("turn_", F.desc("score_"), key).limit(n).drop("class_", "score_", "turn_")


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """n, number of classes, imbalance (largest over smallest), majority class and its share."""
    counts = rows.groupBy(label).agg(F.count("*").alias("c"))
    top = F.max(F.struct("c", F.col(label).alias("l")))
    return counts.agg(F.sum("c").alias("n"), F.count("*").alias("classes"), (F.max("c") / F.min("c")).alias("imbalance"), top["l"].alias("majority"), (F.max("c") / F.sum("c")).alias("majority_share"))


def vetting_queue(items: DataFrame, verdicts: DataFrame, reviewer: str, key: str = "source_id") -> DataFrame:
    """Items that the reviewer has not decided, in rank order."""
    done = verdicts.filter(F.col("reviewer") == reviewer).select(key).distinct()
    return items.join(done, key, "left_anti").orderBy("rank")


def vote_labels(votes: DataFrame, key: str, columns: list[str], least: float) -> DataFrame:
    """Class with the largest vote fraction and its weight; below ``least`` the row is dropped."""
    v = F.array(*[F.greatest(F.col(c), F.lit(0.0)) for c in columns])
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    out = votes.select(key, v.alias("v"), total.alias("t")).filter("t > 0")
    at = F.array_position("v", F.array_max("v"))
    out = out.select(key, F.element_at(F.array(*map(F.lit, columns)), at.cast("int")).alias("label"), (F.array_max("v") / F.col("t")).alias("weight"))
    return out.filter(F.col("weight") >= least)
