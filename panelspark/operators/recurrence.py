"""Day-to-day and hour-to-hour recurrences folded inside the JVM.

A recurrence runs per entity and season (or per reset group), so the folded array
is at most one season of days or one day of hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.functions import fire


def daily_codes(daily: DataFrame, keys: list[str], day: str, temp: str = "temp", rh: str = "rh", wind: str = "wind", rain: str = "rain", month: str = "month") -> DataFrame:
    """FFMC, DMC and DC carried from day to day from the start-up values, then ISI, BUI and FWI.

    Days with a missing input are skipped. `keys` must name one season.
    """
    known = daily.dropna(subset=[temp, rh, wind, rain])
    item = F.struct(
        F.col(day).alias("day"), *[F.col(c).cast("double").alias(n) for c, n in ((temp, "temp"), (rh, "rh"), (wind, "wind"), (rain, "rain"))], F.col(month).cast("int").alias("month")
    )
    season = known.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__days"))
    day_type = daily.select(day).schema[0].dataType.simpleString()
    row_type = f"struct<day:{day_type},ffmc:double,dmc:double,dc:double,wind:double>"
    start = F.struct(*[F.lit(v).alias(n) for n, v in fire.START_CODES.items()], F.array().cast(f"array<{row_type}>").alias("rows"))

    def step(state, d):
        ffmc = fire.next_ffmc(d["temp"], d["rh"], d["wind"], d["rain"], state["ffmc"]).alias("ffmc")
        dmc = fire.next_dmc(d["temp"], d["rh"], d["rain"], d["month"], state["dmc"]).alias("dmc")
        dc = fire.next_dc(d["temp"], d["rain"], d["month"], state["dc"]).alias("dc")

        def grown(codes):
            values = [codes[n].alias(n) for n in ("ffmc", "dmc", "dc")]
            row = F.struct(d["day"].alias("day"), *values, d["wind"].alias("wind"))
            return F.struct(*values, F.concat(state["rows"], F.array(row)).alias("rows"))

        return fire.let(F.struct(ffmc, dmc, dc), grown)

    folded = season.select(*keys, F.posexplode(F.aggregate("__days", start, step, lambda s: s["rows"])).alias("__i", "__r"))
    flat = folded.select(*keys, F.col("__r.day").alias(day), "__r.ffmc", "__r.dmc", "__r.dc", (F.col("__i") + 1).cast("long").alias("days_since_startup"), F.col("__r.wind").alias("__w"))
    flat = flat.withColumns({"isi": fire.initial_spread(F.col("__w"), F.col("ffmc")), "bui": fire.buildup(F.col("dmc"), F.col("dc"))})
    return flat.withColumns({"fwi": fire.weather_index(F.col("isi"), F.col("bui")), "moisture": fire.fuel_moisture(F.col("ffmc"))}).drop("__w")


def hourly_ffmc(hourly: DataFrame, keys: list[str], time: str, hour: str, daily: str, reseed_hour: int = 16) -> DataFrame:
    """Hourly FFMC, re-seeded from the daily code at one hour of the day; hours before the first seed start from the first daily code.

    `hourly` has temp, rh, wind, rain and the day's code. Reset groups hold the
    hours between two seeds (longer only where seed hours are missing).
    """
    order = W.partitionBy(*keys).orderBy(time)
    seeded = hourly.withColumns(
        {"__g": F.count(F.when(F.col(hour) == reseed_hour, 1)).over(order), "__first": F.first(daily).over(order)}
    )
    item = F.struct(
        F.col(time).alias("time"), (F.col(hour) == reseed_hour).alias("seed"), F.col(daily).cast("double").alias("code"), F.col("__first").cast("double").alias("first"),
        *[F.col(c).cast("double").alias(c) for c in ("temp", "rh", "wind", "rain")],
    )
    groups = seeded.groupBy(*keys, "__g").agg(F.array_sort(F.collect_list(item)).alias("__h"))
    time_type = hourly.select(time).schema[0].dataType.simpleString()
    start = F.struct(F.element_at("__h", 1)["first"].alias("code"), F.array().cast(f"array<struct<time:{time_type},ffmc:double>>").alias("rows"))

    def step(state, h):
        code = F.when(h["seed"], h["code"]).otherwise(fire.next_hourly_ffmc(h["temp"], h["rh"], h["wind"], h["rain"], state["code"]))
        return fire.let(code, lambda v: F.struct(v.alias("code"), F.concat(state["rows"], F.array(F.struct(h["time"].alias("time"), v.alias("ffmc")))).alias("rows")))

    folded = groups.select(*keys, F.explode(F.aggregate("__h", start, step, lambda s: s["rows"])).alias("__r"))
    return folded.select(*keys, F.col("__r.time").alias(time), "__r.ffmc")
