"""Exact tie-aware metrics of scored binary rows, computed on one row per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.operators.ordered import average_ranks, join_keys, neighbour, quantiles, running
from panelspark.operators.ranking import thin, top_k

EPSILON = 2.220446049250313e-16  # fixed value: float64 machine epsilon, the clip of the log loss


def score_levels(df: DataFrame, keys: list[str], y: str, p: str, n: str | None = None, *, merged: bool = False) -> DataFrame:
    """Distinct scores with row and positive counts, and both counts from the top down; `n` names a count of rows where rows stand for several, and `merged` says that each score has one row."""
    counts = df.select(*keys, p, F.col(n).alias("n"), F.col(y).cast("long").alias("pos")) if merged else df.groupBy(*keys, p).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    return running(counts, keys, p, {"n_upto": "n", "pos_upto": "pos"}, descending=True, totals=True)


def binary_metrics(df: DataFrame, keys: list[str], y: str, p: str, n: str | None = None, *, merged: bool = False) -> DataFrame:
    """Counts, prevalence, average precision, ROC AUC, Brier score and log loss per key.

    Average precision is the tie-grouped step sum, NULL without positives; AUC is
    the Mann-Whitney share with half-counted ties, NULL unless both classes exist.
    """
    c = F.col
    clipped = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), c(p)))
    neg, neg_upto, negatives = c("n") - c("pos"), c("n_upto") - c("pos_upto"), c("n_upto_total") - c("pos_upto_total")
    table = score_levels(df, keys, y, p, n, merged=merged).groupBy(*keys).agg(
        F.max("n_upto_total").alias("n_samples"), F.max("pos_upto_total").alias("n_positive"),
        F.sum(c("pos") * c("pos_upto") / c("n_upto")).alias("__ap"),
        F.sum(c("pos") * (negatives - neg_upto + neg / 2)).alias("__auc"),
        F.sum(c("pos") * F.pow(1 - c(p), F.lit(2.0)) + neg * F.pow(c(p), F.lit(2.0))).alias("__brier"),
        F.sum(c("pos") * F.log(clipped) + neg * F.log(1 - clipped)).alias("__log"),
    )
    n, pos = c("n_samples"), c("n_positive")
    ap = c("__ap") / F.nullif(pos, F.lit(0))
    return table.select(
        *keys, "n_samples", "n_positive", (n - pos).alias("n_negative"), (pos / n).alias("prevalence"), ap.alias("average_precision"),
        (ap / F.nullif(pos / n, F.lit(0.0))).alias("ap_prevalence_ratio"), (c("__auc") / F.nullif(pos * (n - pos), F.lit(0))).alias("roc_auc"),
        (c("__brier") / n).alias("brier_score"), (-c("__log") / n).alias("log_loss"),
    )


def stratified_metrics(df: DataFrame, y: str, p: str, strata: dict[str, Column]) -> DataFrame:
    """`binary_metrics` of all rows and of every value of each stratum; rows are counted by score and strata before they are repeated per stratum."""
    counts = df.groupBy(p, *[v.cast("string").alias(f"__v_{n}") for n, v in strata.items()]).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("long")).alias(y))
    labels = F.array(F.struct(F.lit("all").alias("stratum"), F.lit("all").alias("value")), *[F.struct(F.lit(n).alias("stratum"), F.col(f"__v_{n}").alias("value")) for n in strata])
    long = counts.select(y, p, "__n", F.explode(labels).alias("__l")).select(y, p, "__n", "__l.stratum", "__l.value")
    return binary_metrics(long, ["stratum", "value"], y, p, "__n")


def reliability(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """Fixed-width bins, the last one closed; empty bins are kept."""
    counted = df.groupBy(*keys, F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.col(y).cast("long")).alias("n_positive"), F.avg(p).alias("mean_probability"), F.avg(F.col(y).cast("double")).alias("observed")
    )
    spine = counted.select(*keys).distinct() if keys else counted.agg(F.lit(1).alias("__k"))
    spine = spine.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return join_keys(spine, counted, [*keys, "bin"], "left").fillna(0, ["n_samples", "n_positive"]).drop("__k")


def quantile_reliability(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """Bins by the mid-rank of each distinct score, so tied scores stay together; bins that are not empty are numbered from 1."""
    counts = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    ranked = running(counts, keys, p, {"upto": "n"}, totals=True)
    middle = (F.col("upto") - F.col("n") / 2) / F.col("upto_total")
    binned = ranked.withColumn("__cut", F.least(F.floor(middle * bins), F.lit(bins - 1)).cast("long"))
    table = binned.groupBy(*keys, "__cut").agg(
        F.min(p).alias("min_probability"), F.max(p).alias("max_probability"), F.sum("n").alias("n_samples"), F.sum("pos").alias("n_positive"),
        (F.sum(F.col(p) * F.col("n")) / F.sum("n")).alias("mean_probability"), (F.sum("pos") / F.sum("n")).alias("observed"),
    )
    numbered = F.dense_rank().over(W.partitionBy(*keys).orderBy("__cut"))  # at most `bins` rows per key
    return table.withColumn("bin", numbered.cast("long")).drop("__cut")


def threshold_table(df: DataFrame, keys: list[str], y: str, p: str, thresholds: list[float], day: str | None = None) -> DataFrame:
    """Confusion counts and rates of `p >= threshold` for a short list of thresholds, in one aggregate."""
    hit = F.col(y) == 1
    cells = []
    for t in thresholds:
        flagged = F.col(p) >= t
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when(flagged, 1)).alias("n_alerts"), F.count(F.when(flagged & hit, 1)).alias("true_positive")))
    days = df.select(*keys, day).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dates")) if day else None
    table = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.count(F.when(hit, 1)).alias("n_positive"), F.array(*cells).alias("__t"))
    table = table.withColumn("__t", F.explode("__t")).select(*keys, "n_samples", "n_positive", "__t.*")
    table = join_keys(table, days, keys, "left") if day else table.withColumn("n_dates", F.lit(None).cast("long"))
    n, pos, alerts, tp = (F.col(c) for c in ("n_samples", "n_positive", "n_alerts", "true_positive"))
    fp, fn = alerts - tp, pos - tp
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return table.withColumns({
        "false_positive": fp, "true_negative": n - pos - fp, "false_negative": fn, "precision": ratio(tp, alerts), "recall": ratio(tp, pos), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": ratio(fp, n - pos), "false_alerts_per_10000": fp * 10000 / n, "alerts_per_day": ratio(alerts, F.col("n_dates")), "false_alerts_per_day": ratio(fp, F.col("n_dates")),
    })


def score_quantile_thresholds(df: DataFrame, p: str, shares: list[float]) -> list[float]:
    """Thresholds frozen from the score quantiles of an earlier period (a handful of numbers)."""
    row = quantiles(df, [], p, {f"q{i}": s for i, s in enumerate(shares)}).first()
    return [] if row is None else [row[f"q{i}"] for i in range(len(shares))]


def pr_curve(df: DataFrame, y: str, p: str, most: int = 1001) -> DataFrame:
    """(recall, precision, threshold) by rising threshold, without points that do not change recall on either side, thinned."""
    levels = score_levels(df, [], y, p)
    levels = neighbour(levels, [], p, {"__lower": "pos"})
    first, last = F.col("n_upto") == F.col("n"), F.col("n_upto") == F.col("n_upto_total")
    kept = levels.where(first | last | (F.col("pos") > 0) | (F.col("__lower") > 0))
    recall, precision = F.col("pos_upto") / F.nullif(F.col("pos_upto_total"), F.lit(0)), F.col("pos_upto") / F.col("n_upto")
    points = kept.select(recall.alias("recall"), precision.alias("precision"), F.col(p).cast("double").alias("threshold"), (F.col("n_upto_total") - F.col("n_upto")).alias("__o"))
    points = points.where(F.col("recall").isNotNull())
    end = kept.where("pos_upto_total > 0").agg(F.max("n_upto_total").alias("__o")).where("__o is not null").select(
        F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"), "__o")
    return thin(points.unionByName(end), "__o", most).drop("__o")


def roc_curve(df: DataFrame, y: str, p: str, most: int = 1001) -> DataFrame:
    """(false positive rate, true positive rate, threshold) by falling threshold, without points inside straight runs, thinned."""
    levels = score_levels(df, [], y, p).withColumn("neg", F.col("n") - F.col("pos"))
    levels = neighbour(levels, [], p, {"__pos": "pos", "__neg": "neg"})
    first, last = F.col("n_upto") == F.col("n"), F.col("n_upto") == F.col("n_upto_total")
    kept = levels.where(first | last | (F.col("pos") != F.col("__pos")) | (F.col("neg") != F.col("__neg")))
    kept = kept.where((F.col("pos_upto_total") > 0) & (F.col("pos_upto_total") < F.col("n_upto_total")))
    negatives = F.col("n_upto_total") - F.col("pos_upto_total")
    points = kept.select(
        ((F.col("n_upto") - F.col("pos_upto")) / negatives).alias("false_positive_rate"), (F.col("pos_upto") / F.col("pos_upto_total")).alias("true_positive_rate"),
        F.col(p).cast("double").alias("threshold"), F.col("n_upto").alias("__o"),
    )
    start = points.agg(F.count(F.lit(1)).alias("__c")).where("__c > 0").select(
        F.lit(0.0).alias("false_positive_rate"), F.lit(0.0).alias("true_positive_rate"), F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("__o"))
    return thin(points.unionByName(start), "__o", most).drop("__o")


def mean_step_ap(df: DataFrame, steps: list[str], y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Average precision inside each step, averaged over the steps that have positives."""
    by = by or []
    per_step = binary_metrics(df, [*by, *steps], y, p)
    return per_step.groupBy(*by).agg(F.avg("average_precision").alias("mean_step_ap"), F.count("average_precision").alias("steps"))


def area_scale(df: DataFrame, steps: list[str], y: str, p: str, target: float = 1.3) -> DataFrame:
    """Scale that makes the median predicted-to-observed ratio of the steps equal the target."""
    totals = df.groupBy(*steps).agg(F.sum(p).alias("expected"), F.sum(y).alias("observed")).where("observed > 0")
    ratio = totals.withColumn("ratio", F.col("expected") / F.col("observed"))
    return quantiles(ratio, [], "ratio", {"median": 0.5}).select((F.lit(target) / F.col("median")).alias("area_scale"))


def matched_recall(df: DataFrame, steps: list[str], y: str, p: str, tie: str, sizes: DataFrame) -> DataFrame:
    """Hits among each step's k best candidates over all observed new cells; `sizes` = (steps, k, observed)."""
    chosen = top_k(df, steps, p, tie, sizes.select(*steps, "k"))
    hits = chosen.groupBy(*steps).agg(F.sum(F.when(F.col("selected"), F.col(y)).otherwise(0)).alias("hits"))
    return hits.join(sizes, steps).select(*steps, "hits", (F.col("hits") / F.nullif(F.col("observed"), F.lit(0))).alias("recall"))


def set_overlap(predicted: DataFrame, observed: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Hits, union, IoU, recall, precision and area ratio of two sets of items per key."""
    both = predicted.select(*keys, *item).distinct().withColumn("__p", F.lit(1)).unionByName(
        observed.select(*keys, *item).distinct().withColumn("__o", F.lit(1)), allowMissingColumns=True
    ).groupBy(*keys, *item).agg(F.count("__p").alias("__p"), F.count("__o").alias("__o"))
    table = both.groupBy(*keys).agg(
        F.sum("__p").alias("predicted"), F.sum("__o").alias("observed"), F.sum(F.col("__p") * F.col("__o")).alias("hits"), F.count(F.lit(1)).alias("union")
    )
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return table.withColumns({"iou": ratio("hits", "union"), "recall": ratio("hits", "observed"), "precision": ratio("hits", "predicted"), "area_ratio": ratio("predicted", "observed")})


def rank_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Spearman correlation on complete pairs, with average ranks."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for column, name in ((a, "__ra"), (b, "__rb")):
        pairs = join_keys(pairs, average_ranks(pairs, keys, column, name), [*keys, column])
    return pairs.groupBy(*keys).agg(F.corr("__ra", "__rb").alias("rank_correlation"))


def step_summary(scores: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Means, medians and shares over scored steps; a missing precision or baseline counts as zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ratio = zero("simulated_distance") / F.nullif(F.col("observed_distance"), F.lit(0.0))
    prepared = scores.withColumns({"__dr": ratio, "__sim": zero("simulated_distance")})
    table = prepared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.countDistinct(entity).alias("entities"), F.avg("recall").alias("mean_recall"), F.avg(zero("even_recall")).alias("mean_even_recall"),
        F.avg("iou").alias("mean_iou"), F.avg(zero("precision")).alias("mean_precision"), F.avg((F.coalesce(F.col("direction_error"), F.lit(999.0)) <= 45).cast("double")).alias("share_within_45"),
    )
    for value, name in (("area_ratio", "median_area_ratio"), ("direction_error", "median_direction_error"), ("__dr", "median_distance_ratio")):
        table = join_keys(table, quantiles(prepared, keys, value, {name: 0.5}), keys, "left")
    return join_keys(table, rank_correlation(prepared, keys, "__sim", "observed_distance"), keys, "left")


def model_report(scores: DataFrame, model: str, subsets: dict[str, Column], entity: str) -> DataFrame:
    """`step_summary` for each model and each named subset of the steps."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    return step_summary(scores.withColumn("subset", F.explode(labels)), ["subset", model], entity)


def fold_summary(folds: DataFrame, candidate: str, fold: str, metric: str, baseline: str) -> DataFrame:
    """Unweighted mean over folds per candidate, change from the baseline, folds improved and relative gain (one row per candidate and fold)."""
    base = F.max(F.when(F.col(candidate) == baseline, F.col(metric))).over(W.partitionBy(fold))  # a fold holds one row per candidate
    joined = folds.withColumn("__base", base)
    table = joined.groupBy(candidate).agg(
        F.avg(metric).alias("mean_metric"), F.avg(F.col(metric) - F.col("__base")).alias("mean_delta"), F.count(F.when(F.col(metric) > F.col("__base"), 1)).alias("folds_improved"), F.avg("__base").alias("__base"), F.count(F.lit(1)).alias("folds")
    )
    return table.withColumn("relative_gain", F.col("mean_metric") / F.col("__base") - 1).drop("__base")


def cohort_rank_report(ranked: DataFrame, cohort: list[str], models: list[str], baseline: str, budgets: dict[str, int]) -> DataFrame:
    """Mid-ranks, gains over the baseline, better/worse/tied counts and expected capture under ties, per cohort and model.

    `ranked` has `<model>_rank_min`, `_rank_max`, `_rank` and `_midrank` columns.
    """
    reports = []
    for m in models:
        gain = F.col(f"{baseline}_midrank") - F.col(f"{m}_midrank")
        low, high = F.col(f"{m}_rank_min"), F.col(f"{m}_rank_max")
        captures = []
        for name, k in budgets.items():
            expected = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(k) - low + 1) / (high - low + 1)))
            captures += [F.count(F.when(F.col(f"{m}_rank") <= k, 1)).alias(f"captured_{name}"), F.sum(expected).alias(f"expected_{name}")]
        base = ranked.groupBy(*cohort).agg(
            F.count(F.lit(1)).alias("n"), F.avg(f"{m}_midrank").alias("mean_midrank"), F.avg(gain).alias("mean_gain"),
            F.count(F.when(gain > 0, 1)).alias("better"), F.count(F.when(gain < 0, 1)).alias("worse"), F.count(F.when(gain == 0, 1)).alias("tied"), *captures,
        )
        base = join_keys(base, quantiles(ranked, cohort, f"{m}_midrank", {"median_midrank": 0.5}), cohort)
        reports.append(base.withColumn("model", F.lit(m)))
    merged = reports[0]
    for r in reports[1:]:
        merged = merged.unionByName(r)
    return merged
