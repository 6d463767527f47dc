"""Fire-weather and fuel rate-of-spread formulas as column expressions.

The coefficients are fixed values of the published Canadian systems (Van Wagner
1987; Forestry Canada Fire Danger Group 1992).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

# Effective day length by month, north of 30 degrees.
DMC_HOURS = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DC_FACTOR = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
START_CODES = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}

# Fuel map code, kind, percent conifer, then a, b, c of the spread
# equation and q, BUI0 of the build-up effect.
FUEL_SCHEMA = "code int, kind string, conifer double, a double, b double, c double, q double, bui0 double"
FUELS = (
    (1, "conifer", 100.0, 90.0, 0.0649, 4.5, 0.90, 72.0),
    (2, "conifer", 100.0, 110.0, 0.0282, 1.5, 0.70, 64.0),
    (3, "conifer", 100.0, 110.0, 0.0444, 3.0, 0.75, 62.0),
    (4, "conifer", 100.0, 110.0, 0.0293, 1.5, 0.80, 66.0),
    (5, "conifer", 100.0, 30.0, 0.0697, 4.0, 0.80, 56.0),
    (7, "conifer", 100.0, 45.0, 0.0305, 2.0, 0.85, 106.0),
    (11, "leafless_aspen", 0.0, 30.0, 0.0232, 1.6, 0.90, 32.0),
    (13, "aspen", 0.0, 30.0, 0.0232, 1.6, 0.90, 32.0),
    (31, "grass", 0.0, 190.0, 0.0310, 1.4, 1.0, 1.0),
    (415, "leafless_mixedwood", 15.0, 110.0, 0.0282, 1.5, 0.80, 50.0),
    (625, "mixedwood", 25.0, 110.0, 0.0282, 1.5, 0.80, 50.0),
    (650, "mixedwood", 50.0, 110.0, 0.0282, 1.5, 0.80, 50.0),
    (675, "mixedwood", 75.0, 110.0, 0.0282, 1.5, 0.80, 50.0),
)
ASPEN = (30.0, 0.0232, 1.6)
GREEN_DAYS = (152, 258)


def _limit(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = c if low is None else F.greatest(F.lit(low), c)
    return c if high is None else F.least(F.lit(high), c)


def _power(base: Column, exponent: float) -> Column:
    return F.pow(base, F.lit(exponent))


def let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once; used inside folds, where repeated subexpressions are not shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fuel_moisture(ffmc: Column) -> Column:
    return (F.lit(101.0) - ffmc) * 147.2 / (ffmc + 59.5)


def _moisture_code(moisture: Column) -> Column:
    return _limit((F.lit(250.0) - moisture) * 59.5 / (moisture + 147.2), 0.0, 101.0)


def _wetted(moisture: Column, rain: Column) -> Column:
    """Moisture after `rain` mm has reached the litter."""
    gain = rain * 42.5 * F.exp(F.lit(-100.0) / (F.lit(251.0) - moisture)) * (F.lit(1.0) - F.exp(F.lit(-6.93) / rain))
    heavy = F.when(moisture > 150.0, _power(moisture - 150.0, 2.0) * 0.0015 * F.sqrt(rain)).otherwise(0.0)
    return _limit(moisture + gain + heavy, high=250.0)


def _equilibrium(temp: Column, rh: Column, factor: float, exponent: float, tail: float) -> Column:
    warm = (F.lit(21.1) - temp) * 0.18 * (F.lit(1.0) - F.exp(rh * -0.115))
    return _power(rh, exponent) * factor + F.exp((rh - 100.0) / 10) * tail + warm


def _approach(temp: Column, share: Column, wind: Column, speed: float) -> Column:
    """Fraction of the gap to equilibrium that remains after one period."""
    rate = (F.lit(1.0) - _power(share, 1.7)) * 0.424 + F.sqrt(wind) * 0.0694 * (F.lit(1.0) - _power(share, 8.0))
    return F.pow(F.lit(10.0), rate * -speed * F.exp(temp * 0.0365))


def _next_moisture_code(temp, rh, wind, wet: Column, speed: float) -> Column:
    rh = _limit(rh, high=100.0)
    dry_end = _equilibrium(temp, rh, 0.942, 0.679, 11.0)
    wet_end = _equilibrium(temp, rh, 0.618, 0.753, 10.0)
    drying = dry_end + (wet - dry_end) * _approach(temp, rh / 100, wind, speed)
    wetting = wet_end - (wet_end - wet) * _approach(temp, (F.lit(100.0) - rh) / 100, wind, speed)
    return let(F.when(wet > dry_end, drying).when(wet < wet_end, wetting).otherwise(wet), _moisture_code)


def next_ffmc(temp: Column, rh: Column, wind: Column, rain: Column, previous: Column) -> Column:
    """Daily fine fuel moisture code from the previous day's code."""
    wet = let(fuel_moisture(previous), lambda m: F.when(rain > 0.5, _wetted(m, rain - 0.5)).otherwise(m))
    return let(wet, lambda m: _next_moisture_code(temp, rh, wind, m, 0.581))


def next_hourly_ffmc(temp: Column, rh: Column, wind: Column, rain: Column, previous: Column) -> Column:
    """Hourly fine fuel moisture code from the previous hour's code."""
    wet = let(fuel_moisture(previous), lambda m: F.when(rain > 0, _wetted(m, rain)).otherwise(m))
    return let(wet, lambda m: _next_moisture_code(temp, rh, wind, m, 0.0579))


def next_dmc(temp: Column, rh: Column, rain: Column, month: Column, previous: Column) -> Column:
    """Duff moisture code from the previous day's code."""
    hours = F.element_at(F.array(*[F.lit(h) for h in DMC_HOURS]), month)
    drying = (_limit(temp, -1.1) + 1.1) * (F.lit(100.0) - _limit(rh, high=100.0)) * hours * 1.894e-4
    slope = (
        F.when(previous <= 33.0, F.lit(100.0) / (previous * 0.3 + 0.5))
        .when(previous <= 65.0, F.lit(14.0) - F.log(previous) * 1.3)
        .otherwise(F.log(previous) * 6.2 - 17.2)
    )
    effective = rain * 0.92 - 1.27
    excess = F.exp(F.lit(5.6348) - previous / 43.43) + effective * 1000.0 / (slope * effective + 48.77)
    rained = _limit(F.lit(244.72) - F.log(excess) * 43.43, 0.0)
    return F.when(rain > 1.5, rained).otherwise(previous) + drying


def next_dc(temp: Column, rain: Column, month: Column, previous: Column) -> Column:
    """Drought code from the previous day's code."""
    factor = F.element_at(F.array(*[F.lit(h) for h in DC_FACTOR]), month)
    drying = _limit(((_limit(temp, -2.8) + 2.8) * 0.36 + factor) / 2, 0.0)
    store = F.exp(previous / -400.0) * 800.0 + (rain * 0.83 - 1.27) * 3.937
    rained = _limit(F.log(F.lit(800.0) / store) * 400.0, 0.0)
    return F.when(rain > 2.8, rained).otherwise(previous) + drying


def initial_spread(wind: Column, ffmc: Column) -> Column:
    return F.exp(wind * 0.05039) * _spread_fuel(ffmc) * 0.208


def _spread_fuel(ffmc: Column) -> Column:
    moisture = fuel_moisture(ffmc)
    return F.exp(moisture * -0.1386) * 91.9 * (_power(moisture, 5.31) / 4.93e7 + 1)


def buildup(dmc: Column, dc: Column) -> Column:
    share = dc * 0.4
    both = F.nullif(dmc + share, F.lit(0.0))
    low = dmc * dc * 0.8 / both
    high = dmc - (F.lit(1.0) - dc * 0.8 / both) * (_power(dmc * 0.0114, 1.7) + 0.92)
    return F.when((dmc == 0) & (dc == 0), 0.0).when(dmc <= share, _limit(low, 0.0)).otherwise(_limit(high, 0.0))


def weather_index(isi: Column, bui: Column) -> Column:
    duff = F.when(bui <= 80.0, _power(bui, 0.809) * 0.626 + 2.0).otherwise(F.lit(1000.0) / (F.exp(bui * -0.023) * 108.64 + 25.0))
    intensity = isi * duff * 0.1
    return F.when(intensity > 1.0, F.exp(_power(F.log(_limit(intensity, 1.0)) * 0.434, 0.647) * 2.72)).otherwise(intensity)


def wind_spread_index(ffmc: Column, wind: Column, backing: bool = False) -> Column:
    """Spread index of the head fire, or of the back fire against the wind."""
    strong = (F.lit(1.0) - F.exp((wind - 28.0) * -0.0818)) * 12.0
    effect = F.exp(wind * -0.05039) if backing else F.when(wind <= 40.0, F.exp(wind * 0.05039)).otherwise(strong)
    return effect * _spread_fuel(ffmc) * 0.208


def _rate(a: Column | float, b: Column | float, c: Column | float, isi: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return lit(a) * F.pow(F.lit(1.0) - F.exp(-lit(b) * isi), lit(c))


def with_spread_rate(df: DataFrame, code: str, isi: Column, bui: Column, day_of_year: Column, name: str) -> DataFrame:
    """Rate of spread (m/min) of a fuel code; codes outside the fuel table do not burn.

    The fuel table has one fixed row per code, so it is joined as a broadcast.
    """
    fuels = F.broadcast(df.sparkSession.createDataFrame([tuple(f) for f in FUELS], FUEL_SCHEMA).withColumnsRenamed(
        {c: f"__f_{c}" for c in ("code", "kind", "conifer", "a", "b", "c", "q", "bui0")}))
    joined = df.join(fuels, df[code] == F.col("__f_code"), "left")
    kind, q, bui0 = F.col("__f_kind"), F.col("__f_q"), F.col("__f_bui0")
    effect = F.when(bui > 0, F.exp(F.log(q) * 50.0 * (F.lit(1.0) / F.nullif(bui, F.lit(0.0)) - F.lit(1.0) / bui0))).otherwise(1.0)
    green = day_of_year.between(*GREEN_DAYS)
    own = _rate(F.col("__f_a"), F.col("__f_b"), F.col("__f_c"), isi)
    aspen = _rate(*ASPEN, isi)
    cured = F.when(day_of_year < GREEN_DAYS[0], 90.0).when(day_of_year <= GREEN_DAYS[1], 50.0).otherwise(75.0)
    curing = F.when(cured < 58.8, (F.exp(cured * 0.061) - 1) * 0.005).otherwise((cured - 58.8) * 0.02 + 0.176)
    share = F.col("__f_conifer") / 100
    leafy = F.when((kind == "mixedwood") & green, 0.2).otherwise(1.0)
    rate = (
        F.when(kind == "conifer", own * effect)
        .when(kind == "grass", own * curing)
        .when(kind == "leafless_aspen", own * effect)
        .when(kind == "aspen", F.when(~green, own * effect).when(bui >= 70.0, own * effect * 0.2).otherwise(0.0))
        .when(kind.isNotNull(), (share * own + leafy * (F.lit(1.0) - share) * aspen) * effect)
        .otherwise(0.0)
    )
    return joined.withColumn(name, rate).drop(*[c for c in joined.columns if c.startswith("__f_")])


def length_to_breadth(wind: Column) -> Column:
    return _power(F.lit(1.0) - F.exp(wind * -0.030), 2.155) * 8.729 + 1


def flank_rate(head: Column, back: Column, wind: Column) -> Column:
    return (head + back) / (length_to_breadth(wind) * 2)


def directional_rate(head: Column, back: Column, flank: Column, angle_deg: Column) -> Column:
    """Spread rate at an angle from the head of an ellipse with its origin on the long axis."""
    cos_t, sin_t = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    half, offset, side = (head + back) / 2, (head - back) / 2, flank * flank
    under = side * cos_t * cos_t + half * half * sin_t * sin_t
    root = side * cos_t * cos_t + (half * half - offset * offset) * sin_t * sin_t
    rate = (offset * side * cos_t + half * flank * F.sqrt(_limit(root, 0.0))) / F.nullif(under, F.lit(0.0))
    return F.when(head > 0, rate).otherwise(0.0)

