"""Evaluation of predictions as aggregates. Ratios with an empty denominator are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def counts(truth: str, predicted: str) -> list[Column]:
    t, p = F.col(truth), F.col(predicted)
    return [F.count_if((t == a) & (p == b)).alias(name) for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def metrics(df: DataFrame) -> DataFrame:
    """df with counts tp, fp, fn, tn gets accuracy, precision, recall, f1, specificity, balanced_accuracy.

    Balanced accuracy is the mean recall of the classes that occur.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    both = (F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)).cast("double")
    return df.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn), "specificity": specificity,
        "balanced_accuracy": F.coalesce((recall + specificity) / F.nullif(both, F.lit(0.0)), F.lit(0.0)),
    })


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return metrics(df.groupBy(*(by or [])).agg(*counts(truth, predicted)))


def rollup(df: DataFrame, truth: str, predicted: str, year: str) -> DataFrame:
    """A row for each year and one for ALL, from pooled counts and not from means of means."""
    made = df.rollup(year).agg(*counts(truth, predicted))
    return metrics(made.withColumn(year, F.coalesce(F.col(year).cast("string"), F.lit("ALL"))))


def agreement(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and metrics of one labelling held against another over the rows that both label, and each one's events."""
    valid = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return confusion(valid, truth, predicted).withColumns({"valid_samples": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "events_true": F.col("tp") + F.col("fn"), "events_pred": F.col("tp") + F.col("fp")})


def report(df: DataFrame, year: str, truth: str, predicted: str, value: str, predicted_value: str, optimised: str | None = None) -> DataFrame:
    """A row for each year, one for ALL and, with predictions by an optimised threshold, one for OPT over all years.

    rmse, mae, r2 of the values; f1, recall, precision, balanced_accuracy, events_true, events_pred of the labels.
    One pass over the rows: OPT's counts are taken with those of ALL.
    """
    t, p = F.col(value).cast("double"), F.col(predicted_value).cast("double")
    square = F.avg((p - t) * (p - t))
    errors = [F.sqrt(square).alias("rmse"), F.avg(F.abs(p - t)).alias("mae"), F.when(F.var_pop(t) > 0, F.lit(1.0) - square / F.var_pop(t)).otherwise(F.lit(0.0)).alias("r2")]
    names = ["tp", "fp", "fn", "tn"]
    more = [F.struct(*counts(truth, optimised)).alias("_opt")] if optimised else []
    made = df.rollup(year).agg(*errors, F.struct(*counts(truth, predicted)).alias("_own"), *more)
    label = F.coalesce(F.col(year).cast("string"), F.lit("ALL"))
    rows = F.array(F.struct(label.alias(year), F.col("_own").alias("c")))
    if optimised:
        rows = F.when(F.col(year).isNull(), F.array(F.struct(label.alias(year), F.col("_own").alias("c")), F.struct(F.lit("OPT").alias(year), F.col("_opt").alias("c")))).otherwise(rows)
    made = metrics(made.select("rmse", "mae", "r2", F.inline(rows)).select(year, "rmse", "mae", "r2", *(F.col(f"c.{n}").alias(n) for n in names)))
    return made.select(year, "rmse", "mae", "r2", "f1", "recall", "precision", "balanced_accuracy", (F.col("tp") + F.col("fn")).alias("events_true"), (F.col("tp") + F.col("fp")).alias("events_pred"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of each class, then `macro` and `weighted` means."""
    both = df.select(F.col(truth).alias("t"), F.col(predicted).alias("p")).groupBy("t", "p").count()
    classes = both.select(F.col("t").alias("label")).union(both.select("p")).distinct()
    right = both.groupBy(F.col("t").alias("label")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0)).alias("hit"))
    named = both.groupBy(F.col("p").alias("label")).agg(F.sum("count").alias("named"))
    rows = classes.join(right, "label", "left").join(named, "label", "left").na.fill(0, ["support", "hit", "named"])
    rows = rows.select(F.col("label").cast("string").alias("label"), ratio(F.col("hit"), F.col("named")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("named") + F.col("support")).alias("f1"), "support")
    scores = ["precision", "recall", "f1"]
    macro = rows.agg(*(F.avg(s).alias(s) for s in scores), F.sum("support").alias("support")).select(F.lit("macro").alias("label"), *scores, "support")
    weighted = rows.agg(*((F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores), F.sum("support").alias("support")).select(F.lit("weighted").alias("label"), *scores, "support")
    return rows.union(macro).union(weighted)


def regression(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """rmse, mae, r2 over rows that have both; r2 from sums about the mean."""
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    rows = df.where(t.isNotNull() & p.isNotNull())
    return rows.groupBy(*(by or [])).agg(
        F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"), F.avg(F.abs(p - t)).alias("mae"),
        F.when(F.var_pop(t) > 0, F.lit(1.0) - F.avg((p - t) * (p - t)) / F.var_pop(t)).otherwise(F.lit(0.0)).alias("r2"), F.count("*").alias("n"),
    )


def sweep(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Counts and metrics at each threshold (score >= threshold).

    Each row only counts into the step between two thresholds; the steps are then summed from above, so that
    data isn't multiplied by the number of thresholds. A NULL score counts as no event.
    """
    spark, n = df.sparkSession, len(thresholds)
    ordered = sorted(thresholds)
    step = sum((F.when(F.col(score) >= x, 1).otherwise(0) for x in ordered), F.lit(0))
    seen = df.groupBy(step.alias("step")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    steps = spark.createDataFrame([(k, float(ordered[k - 1]) if k else None) for k in range(n + 1)], "step int, threshold double")
    above, every = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    made = steps.join(seen, "step", "left").na.fill(0, ["pos", "neg"])  # thresholds + 1 rows
    made = made.select("threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every).alias("P"), F.sum("neg").over(every).alias("N")).where("threshold IS NOT NULL")
    return metrics(made.select("threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn")))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row with the highest f1, the least threshold of equals."""
    return swept.orderBy(F.col("f1").desc(), F.col("threshold")).limit(1)


def offset_sweep(df: DataFrame, truth: str, predicted: str, base: float, mode: str = "heat", low: float = -5.0, high: float = 5.0, steps: int = 50) -> DataFrame:
    """Metrics of predictions over base + offset against truths over base, for evenly spaced offsets (`cold`: under -)."""
    sign = -1.0 if mode == "cold" else 1.0
    offsets = [low + (high - low) * k / (steps - 1) for k in range(steps)] if steps > 1 else [low]
    rows = df.select(F.coalesce(F.lit(sign) * F.col(truth) > base, F.lit(False)).cast("int").alias("t"), (F.lit(sign) * F.col(predicted)).alias("p"))
    spark = df.sparkSession
    # strictly over: a step is the number of offsets whose cut lies under the prediction
    step = sum((F.when(F.col("p") > base + o, 1).otherwise(0) for o in offsets), F.lit(0))
    seen = rows.groupBy(step.alias("step")).agg(F.count_if(F.col("t") == 1).alias("pos"), F.count_if(F.col("t") == 0).alias("neg"))
    table = spark.createDataFrame([(k, offsets[k - 1] if k else None) for k in range(len(offsets) + 1)], "step int, offset double")
    above, every = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    made = table.join(seen, "step", "left").na.fill(0, ["pos", "neg"])
    made = made.select("offset", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every).alias("P"), F.sum("neg").over(every).alias("N")).where("offset IS NOT NULL")
    return metrics(made.select("offset", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn")))


def curve(df: DataFrame, truth: str, score: str, slices: int = 64) -> DataFrame:
    """(score, tp, fp, P, N): running counts from the highest score down, a row for each distinct score.

    Equal scores are combined first; running sums then go by ranges of scores, each with the counts of the
    ranges above, so that no window holds all rows.
    """
    seen = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    cuts = seen.agg(F.percentile_approx("score", [k / slices for k in range(1, slices)], 1000)).first()[0] or []
    part = sum((F.when(F.col("score") > float(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    seen = seen.withColumn("part", part)
    sums = seen.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # slices rows at most
    above, every = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select("part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.sum("p").over(every).alias("P"), F.sum("n").over(every).alias("N"))
    within = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    made = seen.withColumns({"tp": F.sum("pos").over(within), "fp": F.sum("neg").over(within)}).join(F.broadcast(sums), "part")
    return made.select("score", (F.col("tp") + F.col("p0")).alias("tp"), (F.col("fp") + F.col("n0")).alias("fp"), "P", "N", "pos", "neg")


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """pr_auc: sum of each step's recall gain times its precision."""
    made = curve(df, truth, score)
    return made.agg(F.coalesce(F.sum(ratio(F.col("pos"), F.col("P")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("pr_auc"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """roc_auc by trapezoids between distinct scores; 0 where one class is absent."""
    made = curve(df, truth, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return made.agg(F.coalesce(area / F.nullif(F.max(F.col("P") * F.col("N")).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("roc_auc"))


def best_curve_threshold(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, f1): the score at which 2PR / (P + R + 1e-10) is highest, the highest score of equals."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("P"))
    made = curve(df, truth, score).select(F.col("score").alias("threshold"), (2 * p * r / (p + r + F.lit(1e-10))).alias("f1"))
    return made.orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1)


def calibrated(df: DataFrame, predicted: str, truth: str, method: str, name: str = "calibrated") -> DataFrame:
    """mean_shift, std_scale or both, by the population's mean and standard deviation."""
    stats = df.agg(F.avg(predicted).alias("_mp"), F.avg(truth).alias("_mt"), F.stddev_pop(predicted).alias("_sp"), F.stddev_pop(truth).alias("_st"))
    p, mp, mt, sp, st = (F.col(c) for c in (predicted, "_mp", "_mt", "_sp", "_st"))
    scale = F.when(sp > 0, st / sp).otherwise(F.lit(1.0))
    made = {"mean_shift": p - mp + mt, "std_scale": (p - mp) * scale + mp, "both": (p - mp) * scale + mt}[method]
    return df.crossJoin(F.broadcast(stats)).withColumn(name, made).drop("_mp", "_mt", "_sp", "_st")  # one row
