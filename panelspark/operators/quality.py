"""Named checks compiled into one aggregate, completeness and consistency checks, table diffs and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.clean import MISSING_TOKENS, missing_to_null
from panelspark.operators.ordered import join_keys

FLOAT32_MAX = 3.4028234663852886e38  # fixed value


def violations(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(check, violations) for every named predicate, all counted in one scan; a NULL predicate is no violation."""
    counts = [F.struct(F.lit(n).alias("check"), F.count(F.when(c, 1)).alias("violations")) for n, c in checks]
    return df.agg(F.array(*counts).alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*")


def verdict(results: DataFrame) -> DataFrame:
    """One row: PASS or FAIL, checks and failed checks."""
    bad = F.count(F.when(F.col("violations") > 0, 1))
    return results.agg(F.when(bad == 0, "PASS").otherwise("FAIL").alias("status"), F.count(F.lit(1)).alias("checks"), bad.alias("failed"))


def require(results: DataFrame) -> DataFrame:
    """The results, but the job fails on the first check with violations (for use before publishing)."""
    message = F.concat(F.lit("check failed: "), F.col("check"))
    return results.withColumn("violations", F.when(F.col("violations") == 0, F.col("violations")).otherwise(F.raise_error(message).cast("long")))


def numeric_checks(raw: list[str], integers: set[str] = frozenset(), bounds: dict[str, tuple[float, float]] | None = None, nonnegative: set[str] = frozenset()) -> list[tuple[str, Column]]:
    """Conversion, infinity, float32, whole-number, range and sign checks of text columns."""
    found = []
    for c in raw:
        text = missing_to_null(F.col(c), MISSING_TOKENS)
        value = F.trim(text).try_cast("double")
        infinite = F.abs(value) == float("inf")
        finite = value.isNotNull() & ~infinite & ~F.isnan(value)
        found += [
            (f"not_numeric:{c}", text.isNotNull() & (value.isNull() | F.isnan(value))),
            (f"infinite:{c}", infinite), (f"float32_overflow:{c}", finite & (F.abs(value) > FLOAT32_MAX)),
        ]
        if c in integers:
            found += [(f"not_whole:{c}", finite & (value != F.floor(value))), (f"beyond_exact_float32:{c}", finite & (F.abs(value) > 2.0**24))]
        if c in (bounds or {}):
            low, high = bounds[c]
            found.append((f"outside_range:{c}", (value < low) | (value > high)))
        if c in nonnegative:
            found.append((f"negative:{c}", value < 0))
    return found


def null_matches(name: str, value: str, expected_null: Column) -> tuple[str, Column]:
    """The value is NULL exactly when the flag says so."""
    return name, F.col(value).isNull() != expected_null


def history_checks(same: dict[int, str], around: dict[int, str], days_since: str, censored: str) -> list[tuple[str, Column]]:
    """Order relations between history windows (lookback -> column) and the days-since column."""
    spans, c = sorted(same), F.col
    found = [(f"same_exceeds_around:{s}", c(same[s]) > c(around[s])) for s in spans]
    for short, long in zip(spans, spans[1:]):
        found += [(f"window_order:{w[short]}", c(w[short]) > c(w[long])) for w in (same, around)]
    found += [("days_since_not_positive", c(days_since) <= 0), null_matches("censor_flag", days_since, c(censored) == 1)]
    for s in spans:
        inside = F.coalesce(c(days_since) <= s, F.lit(False))
        found.append((f"days_since_window:{s}", (c(same[s]) > 0) != inside))
    return found


def completeness(panel: DataFrame, expected: DataFrame, keys: list[str], cell: str, day: str) -> DataFrame:
    """Duplicates, missing and unknown keys, and cells or days with an incomplete row count."""
    held = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    wanted = expected.select(*keys).distinct().withColumn("__w", F.lit(1))
    both = wanted.join(held, keys, "full").select(*keys, "__w", "__n")
    n, w = F.coalesce(F.col("__n"), F.lit(0)), F.coalesce(F.col("__w"), F.lit(0))
    uneven = lambda k: both.groupBy(k).agg(F.sum(n).alias("a"), F.sum(w).alias("b")).agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("v"))
    table = both.agg(
        F.sum(F.greatest(n - 1, F.lit(0))).alias("duplicate_excess"), F.count(F.when((w == 1) & (n == 0), 1)).alias("missing_keys"),
        F.count(F.when((w == 0) & (n > 0), 1)).alias("unknown_keys"), F.sum(n).alias("rows"), F.sum(w).alias("expected_rows"),
    )
    return table.withColumns({"uneven_cells": uneven(cell).select("v").scalar(), "uneven_days": uneven(day).select("v").scalar()})


def static_violations(df: DataFrame, key: str, columns: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Keys whose supposedly static columns vary by more than the tolerance or mix NULL with values."""
    per_key = df.groupBy(key).agg(*[
        ((F.max(c) - F.min(c) > tolerance) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))).alias(c) for c in columns
    ])
    return per_key.agg(*[F.count(F.when(F.col(c), 1)).alias(f"{c}_varies") for c in columns])


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within the tolerance; NULL equals NULL."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def table_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Changed values per column between two versions of a table, and rows found in one only."""
    a = old.select(*keys, F.struct(*columns).alias("__a"))
    b = new.select(*keys, F.struct(*columns).alias("__b"))
    both = a.join(b, keys, "full")
    paired = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    changed = [F.count(F.when(paired & ~close(F.col(f"__a.{c}"), F.col(f"__b.{c}"), tolerance), 1)).alias(f"{c}_changed") for c in columns]
    return both.agg(F.count(F.when(F.col("__b").isNull(), 1)).alias("only_old"), F.count(F.when(F.col("__a").isNull(), 1)).alias("only_new"), *changed)


def prediction_parity(a: DataFrame, b: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Rows compared, rows that differ, and the largest absolute difference of two prediction tables."""
    both = a.select(*keys, F.col(p).alias("__a")).join(b.select(*keys, F.col(p).alias("__b")), keys, "full")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("__a").eqNullSafe(F.col("__b")), 1)).alias("different"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("largest")
    )


def probability_checks(y: str, p: str) -> list[tuple[str, Column]]:
    value, label = F.col(p), F.col(y)
    return [
        ("probability_missing", value.isNull() | F.isnan(value)), ("probability_range", (value < 0) | (value > 1)),
        ("label_not_binary", label.isNull() | ~label.isin(0, 1)),
    ]


def sequence_checks(df: DataFrame, entity: str, number: str, time: str, cumulative: str, increment: str, tolerance: float) -> DataFrame:
    """Adds flags per row: numbering gap, time going back, cumulative falling, increment not equal to its change.

    Rows are joined to their predecessor by number, so no entity is sorted whole.
    """
    before = df.select(entity, (F.col(number) + 1).alias(number), F.col(time).alias("__t"), F.col(cumulative).alias("__c"))
    joined = df.join(before, [entity, number], "left")
    change = F.col(cumulative) - F.coalesce(F.col("__c"), F.lit(0))
    return joined.withColumns({
        "gap": (F.col(number) != 1) & F.col("__t").isNull(), "backward": F.coalesce(F.col(time) < F.col("__t"), F.lit(False)),
        "falling": F.coalesce(F.col(cumulative) < F.col("__c") - 1e-6, F.lit(False)), "unequal": F.abs(change - F.col(increment)) > tolerance,
    }).drop("__t", "__c")


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, missing) for every column, in one scan."""
    columns = columns or df.columns
    counts = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing")) for c in columns]
    return df.agg(F.array(*counts).alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*")


def audit(df: DataFrame, version: str, measures: dict[str, Column], leak: Column, notes: dict[str, str]) -> DataFrame:
    """One JSON row: version, measures and notes. Everything is counted first; the job then fails if the leak count is not zero."""
    row = df.agg(*[c.alias(n) for n, c in measures.items()], F.count(F.when(leak, 1)).alias("leakage_violations"))
    body = F.to_json(F.struct(
        F.lit(version).alias("version"), F.struct(*measures).alias("counts"), F.struct("leakage_violations").alias("validation"),
        F.struct(*[F.lit(v).alias(k) for k, v in notes.items()]).alias("semantics"),
    ))
    return row.select(F.when(F.col("leakage_violations") == 0, body).otherwise(F.raise_error(F.concat(F.lit("past-only boundary broken: "), body))).alias("audit"))




def validated_join(left: DataFrame, right: DataFrame, keys: list[str], relation: str, how: str = "left") -> DataFrame:
    """Join that fails the job when the declared relation (one_to_one, many_to_one, one_to_many) does not hold."""
    for side, name in ((left, "left"), (right, "right")):
        unique = relation == "one_to_one" or (name == "right" and relation == "many_to_one") or (name == "left" and relation == "one_to_many")
        if unique:
            rest = [c for c in side.columns if c not in keys]
            once = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__v") if rest else F.lit(None).alias("__v"))
            key_text = F.to_json(F.struct(*keys))
            ok = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{name} key repeats: "), key_text)).cast("boolean"))
            checked = once.where(ok).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])
            left, right = (checked, right) if name == "left" else (left, checked)
    return join_keys(left, right, keys, how)


def observation_suite(entities: DataFrame, observations: DataFrame, arrivals: DataFrame, hourly: DataFrame, entity: str, number: str) -> DataFrame:
    """Structural checks of the spread tables as (check, violations).

    Expected columns: entities - split, year, window_start, shares_total;
    observations - time, new_cells, cumulative_cells, hours_since_previous, bearing,
    direction, wind_u, wind_v, speed; arrivals - x, y; hourly - u, v, speed, temp,
    rh, rain. Each table is scanned once for its own checks.
    """
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    repeats = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    circle = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0.0, 360.0)
    keyed = entities.sparkSession.range(1)
    final = observations.groupBy(entity).agg(F.max("cumulative_cells").alias("__final"))
    reached = arrivals.groupBy(entity).agg(F.count(F.lit(1)).alias("__cells"))
    unequal = final.join(reached, entity, "full").where(~F.col("__final").eqNullSafe(F.col("__cells")))
    years = entities.where("split = 'calibration'").select("year").intersect(entities.where("split = 'holdout'").select("year"))
    keys = keyed.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), v.cast("long").alias("violations")) for n, v in {
        "entity_repeats": count(repeats(entities, [entity])), "observation_repeats": count(repeats(observations, [entity, number])),
        "arrival_repeats": count(repeats(arrivals, [entity, "x", "y"])), "entity_unknown": count(observations.select(entity).join(entities, entity, "left_anti")),
        "arrivals_match_final_count": count(unequal), "split_years_shared": count(years),
    }.items()])).alias("c")).select("c.*")
    flagged = sequence_checks(observations, entity, number, "time", "cumulative_cells", "new_cells", 1e-9).join(entities.select(entity, "window_start"), entity)
    rows = violations(flagged, [
        ("numbering", F.col("gap")), ("time_order", F.col("backward")), ("cumulative_falls", F.col("falling")), ("increment_differs", F.col("unequal")),
        ("hours_not_positive", F.col("hours_since_previous") <= 0), ("before_window", F.col("time") < F.col("window_start")), ("bearing_range", circle("bearing") | circle("direction")),
        ("vector_mean_exceeds_speed", F.hypot("wind_u", "wind_v") > F.col("speed") + 0.01),
    ])
    weather = violations(hourly, [
        ("components_differ_from_speed", F.abs(F.hypot("u", "v") - F.col("speed")) > 0.02),
        ("implausible_weather", ~(F.col("speed").between(0, 120) & F.col("rh").between(0, 100) & F.col("temp").between(-40, 45) & (F.col("rain") >= 0))),
    ])
    shares = violations(entities, [("shares_total", F.abs(F.col("shares_total") - 1) > 0.001)])
    return keys.unionByName(rows).unionByName(weather).unionByName(shares)
