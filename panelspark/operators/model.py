"""Splits, preprocessing, Spark ML families, candidate search over folds, calibration and scoring."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.contracts import ContractError, guard
from panelspark.operators import boosting
from panelspark.operators.metrics import binary_metrics, fold_summary
from panelspark.operators.ordered import quantiles
from panelspark.operators.profile import quantile_table
from panelspark.session import checkpoint

VECTOR = "__features"
#: Most iterations of a logistic fit where its setting names none.
ITERATIONS = 25
#: Fits that run at the same time in a search, and rows that they may hold between them (two run in any case).
AT_ONCE, HELD = 8, 1 << 25


# --- splits ---------------------------------------------------------------

def partition_code(year: Column, development_until: int = 2016) -> Column:
    """0 development, 1 calibration, 2 threshold, 3 test, by year alone."""
    return F.least(F.greatest(year - development_until, F.lit(0)), F.lit(3)).cast("int")


def entity_split(year: Column, archived: Column, holdout_from: int = 2021) -> Column:
    return F.when(~archived, "no_archive").when(year >= holdout_from, "holdout").otherwise("calibration")


def expanding_folds(first: int, validations: Sequence[int]) -> list[tuple[int, Column, Column]]:
    """(validation year, train filter, validation filter): train on all earlier years from `first`."""
    year = F.col("year")
    return [(v, year.between(first, v - 1), year == v) for v in validations]


def leave_one_year_out(years: Sequence[int]) -> list[tuple[int, Column, Column]]:
    return [(y, F.col("year") != y, F.col("year") == y) for y in years]


def class_weight(df: DataFrame, y: str) -> Column:
    """Balanced weight n / (2 n_class) as an expression with the two counts folded in."""
    n, pos = df.agg(F.count(F.lit(1)), F.sum(y)).first()
    if not pos or pos == n:
        raise ContractError("both classes are needed")
    return F.when(F.col(y) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))


# --- preprocessing --------------------------------------------------------

@dataclass(frozen=True)
class Preprocessor:
    """Statistics fitted on training rows only: medians, then population mean and deviation of the imputed columns."""

    features: tuple[str, ...]
    indicators: tuple[str, ...]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], indicators: Sequence[str] = (), exempt: Sequence[str] = ()) -> Preprocessor:
        """All columns share two passes; one number per column reaches the driver. An all-missing column is filled with 0."""
        found = {r["column"]: r["median"] for r in quantile_table(train, list(features), {"median": 0.5}).collect()}  # one row per feature
        medians = {c: found.get(c, 0.0) for c in features}
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in features]
        stats = train.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(filled)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled)]).first()
        means = {c: 0.0 if c in exempt else stats[f"m{i}"] for i, c in enumerate(features)}
        scales = {c: 1.0 if c in exempt or not stats[f"s{i}"] else stats[f"s{i}"] for i, c in enumerate(features)}
        return cls(tuple(features), tuple(indicators), medians, means, scales)

    @classmethod
    def fit_folds(cls, df: DataFrame, trains: Sequence[str], features: Sequence[str], indicators: Sequence[str] = (), exempt: Sequence[str] = ()) -> list[Preprocessor]:
        """`fit` for several overlapping training sets, marked by the boolean columns `trains`: all share the two passes of one.

        Values are counted once per set of marks, and the counts are what each fold repeats.
        """
        long = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])
        counted = df.select(*trains, F.explode(long).alias("__v")).select(*trains, "__v.*").where("value is not null").groupBy(*trains, "column", "value").agg(F.count(F.lit(1)).alias("__rows"))
        own = F.filter(F.array(*[F.when(F.col(t), F.lit(k)) for k, t in enumerate(trains)]), lambda k: k.isNotNull())
        repeated = counted.select("column", "value", "__rows", F.explode(own).alias("fold"))
        found = {(r["fold"], r["column"]): r["median"] for r in quantiles(repeated, ["fold", "column"], "value", {"median": 0.5}, "__rows").collect()}  # one row per fold and feature
        medians = [[found.get((k, i), 0.0) for i in range(len(features))] for k in range(len(trains))]
        cells = []
        for k, t in enumerate(trains):
            for i, c in enumerate(features):
                v = F.when(F.col(t), F.coalesce(F.col(c).cast("double"), F.lit(medians[k][i])))
                cells += [F.avg(v).alias(f"m{k}_{i}"), F.stddev_pop(v).alias(f"s{k}_{i}")]
        stats, out = df.agg(*cells).first(), []
        for k in range(len(trains)):
            means = {c: 0.0 if c in exempt else stats[f"m{k}_{i}"] for i, c in enumerate(features)}
            scales = {c: 1.0 if c in exempt or not stats[f"s{k}_{i}"] else stats[f"s{k}_{i}"] for i, c in enumerate(features)}
            out.append(cls(tuple(features), tuple(indicators), dict(zip(features, medians[k])), means, scales))
        return out

    def of(self, features: Sequence[str]) -> Preprocessor:
        """The part for some of the features; indicators stay as they are."""
        return Preprocessor(tuple(features), self.indicators, *[{c: held[c] for c in features} for held in (self.medians, self.means, self.scales)])

    @property
    def outputs(self) -> list[str]:
        return [*self.features, *[f"{c}__missing" for c in self.indicators]]

    def transform(self, df: DataFrame) -> DataFrame:
        flags = {f"{c}__missing": F.col(c).isNull().cast("double") for c in self.indicators}
        scaled = {c: (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - self.means[c]) / self.scales[c] for c in self.features}
        return df.withColumns({**flags, **scaled})

    def table(self, df: DataFrame) -> DataFrame:
        """The fitted statistics as rows."""
        rows = [(c, self.medians[c], self.means[c], self.scales[c]) for c in self.features]
        return df.sparkSession.createDataFrame(rows, "feature string, median double, mean double, scale double")


def censor_mismatches(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Rows whose censor flag is not exactly `value is NULL`, or that hold an infinity."""
    wrong = (F.col(flag) == 1) != F.col(value).isNull()
    return df.agg(F.count(F.when(F.coalesce(wrong, F.lit(True)), 1)).alias("mismatches"), F.count(F.when(F.abs(F.col(value)) == float("inf"), 1)).alias("infinite"))


# --- families -------------------------------------------------------------

def logistic(params: dict, width: int):
    return LogisticRegression(featuresCol=VECTOR, labelCol="__y", weightCol="__w", regParam=params.get("l2", 0.01), maxIter=params.get("iterations", ITERATIONS), standardization=False)


def forest(params: dict, width: int):
    return RandomForestClassifier(
        featuresCol=VECTOR, labelCol="__y", weightCol="__w", numTrees=params.get("trees", 200), maxDepth=params.get("depth", 8), subsamplingRate=params.get("share", 0.25),
        featureSubsetStrategy="sqrt", seed=params.get("seed", 42))


def perceptron(params: dict, width: int):
    return MultilayerPerceptronClassifier(featuresCol=VECTOR, labelCol="__y", layers=[width, *params.get("hidden", (64, 32)), 2], maxIter=params.get("iterations", 60), seed=params.get("seed", 42))


FAMILIES: dict[str, Callable] = {"logistic": logistic, "forest": forest, "perceptron": perceptron}


@dataclass(frozen=True)
class Fitted:
    preprocessor: Preprocessor
    model: Model

    def vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.preprocessor.outputs, outputCol=VECTOR).transform(self.preprocessor.transform(df))

    def on_vectors(self, df: DataFrame, name: str) -> DataFrame:
        """`df`, which has this model's vectors, with the probability of class 1."""
        return self.model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def score(self, df: DataFrame, keys: list[str], name: str = "p") -> DataFrame:
        """Keys with the probability of class 1; the original columns of the keys are kept as they came."""
        kept = df.withColumns({f"__k_{k}": F.col(k) for k in keys})
        scored = self.model.transform(self.vectors(kept))
        return scored.select(*[F.col(f"__k_{k}").alias(k) for k in keys], vector_to_array("probability")[1].alias(name))


@dataclass(frozen=True)
class Prepared:
    """Training rows as they are fitted: the statistics, and the vectors, labels and weights as a written table."""

    preprocessor: Preprocessor
    vectors: DataFrame


def prepare(train: DataFrame, features: Sequence[str], y: str, *, indicators: Sequence[str] = (), exempt: Sequence[str] = (), balanced: bool = False, forbidden=()) -> Prepared:
    """Preprocess on the training rows; forbidden columns and the label are refused as features. Trainers read the written rows, however often they pass over them."""
    guard(features, {y, *forbidden})
    preprocessor = Preprocessor.fit(train, features, indicators, exempt)
    weight = class_weight(train, y) if balanced else F.lit(1.0)
    ready = train.withColumns({"__y": F.col(y).cast("double"), "__w": weight})
    vectors = VectorAssembler(inputCols=preprocessor.outputs, outputCol=VECTOR).transform(preprocessor.transform(ready)).select(VECTOR, "__y", "__w")
    return Prepared(preprocessor, checkpoint(vectors))


def estimate(family: str, params: dict, prepared: Prepared) -> Fitted:
    """Fit one family with one setting on prepared rows."""
    return Fitted(prepared.preprocessor, FAMILIES[family](params, len(prepared.preprocessor.outputs)).fit(prepared.vectors))


def fit(family: str, params: dict, train: DataFrame, features: Sequence[str], y: str, *, balanced: bool = False, forbidden=(), **options) -> Fitted | boosting.Boosted:
    """Prepare and fit one family. Boosting takes the columns as they are, unknown values included."""
    if family == "boosted":
        guard(features, {y, *forbidden})
        return boosting.fit(train, features, y, boosting.Settings(**params), class_weight(train, y) if balanced else None)
    return estimate(family, params, prepare(train, features, y, balanced=balanced, forbidden=forbidden, **options))


# --- search ---------------------------------------------------------------

def random_candidates(grid: dict[str, Sequence], n: int, seed: int) -> list[dict]:
    """Up to n distinct settings drawn with a seed, in draw order."""
    source, names, found = random.Random(seed), sorted(grid), []
    size = 1
    for values in grid.values():
        size *= len(values)
    while len(found) < min(n, size):
        setting = {k: source.choice(list(grid[k])) for k in names}
        if setting not in found:
            found.append(setting)
    return found


def out_of_fold(df: DataFrame, folds, family: str, params: dict, features, y: str, keys: list[str], **options) -> DataFrame:
    """Validation scores of every fold: (fold, keys, y, p); each fold is fitted on its own training rows only."""
    parts = None
    for name, train, valid in folds:
        scored = fit(family, params, df.where(train), features, y, **options).score(df.where(valid), [*keys, y]).withColumn("fold", F.lit(name))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def fold_models(rows: DataFrame, trains: Sequence[str], candidates: dict[str, tuple[str, dict, Sequence[str]]], y: str, *, indicators: Sequence[str] = (), exempt: Sequence[str] = (), balanced: bool = False, forbidden=()) -> dict:
    """{(fold number, candidate): fitted model}, each fitted on the rows that its fold's boolean column of `trains` marks, and no others.

    The statistics of all folds and features come from one preparation, and vectors that several candidates
    of a fold are fitted on are written once. Fits are independent and small jobs for the most part, so AT_ONCE of them
    run at a time, fewer over many rows. Of settings that differ in iterations alone the one with the most is
    fitted first; where it has converged within the iterations of another, that is the same model and the same object.
    """
    for _, _, features in candidates.values():
        guard(features, {y, *forbidden})
    plain = list(dict.fromkeys(c for family, _, features in candidates.values() if family != "boosted" for c in features))
    prepared = Preprocessor.fit_folds(rows, trains, plain, indicators, exempt) if plain else []
    weights = [class_weight(rows.where(t), y) if balanced else F.lit(1.0) for t in trains]
    alike, uses = {}, Counter(tuple(features) for family, _, features in candidates.values() if family != "boosted")
    for name, (family, params, features) in candidates.items():
        rest = {k: v for k, v in params.items() if k != "iterations"} if family == "logistic" else {"name": name}
        alike.setdefault((family, tuple(features), tuple(sorted(rest.items()))), []).append(name)
    for names in alike.values():
        names.sort(key=lambda n: -candidates[n][1].get("iterations", ITERATIONS))

    def ready(task: tuple[int, tuple[str, ...]]) -> tuple:
        fold, features = task
        found = prepared[fold].of(features)
        marked = found.transform(rows.where(trains[fold]).withColumns({"__y": F.col(y).cast("double"), "__w": weights[fold]}))
        vectors = VectorAssembler(inputCols=found.outputs, outputCol=VECTOR).transform(marked).select(VECTOR, "__y", "__w")
        return task, Prepared(found, checkpoint(vectors) if uses[features] > 1 else vectors)

    def fits(task: tuple[int, list[str]]) -> dict:
        fold, names = task
        done, last = {}, None
        for name in names:
            family, params, features = candidates[name]
            if family == "boosted":
                last = boosting.fit(rows.where(trains[fold]), features, y, boosting.Settings(**params), weights[fold] if balanced else None)
            elif last is None or last.model.summary.totalIterations > params.get("iterations", ITERATIONS):
                last = estimate(family, params, tables[fold, tuple(features)])
            done[fold, name] = last
        return done

    with ThreadPool(max(2, min(AT_ONCE, HELD // max(1, rows.count())))) as pool:
        run = lambda f, tasks: pool.map(inheritable_thread_target(rows.sparkSession)(f), tasks, chunksize=1)
        tables = dict(run(ready, [(k, features) for k in range(len(trains)) for features in uses]))
        found = run(fits, [(k, names) for k in range(len(trains)) for names in alike.values()])
    return {task: model for part in found for task, model in part.items()}


def score_all(df: DataFrame, models: dict[str, Fitted | boosting.Boosted]) -> DataFrame:
    """`df` with a score per model, {column: model}; models with the same preprocessing share its vectors."""
    columns, groups = df.columns, []
    for name, model in models.items():
        own = getattr(model, "preprocessor", None)
        group = next((g for p, g in groups if own is not None and p == own), None)
        if group is None:
            groups.append((own, group := {}))
        group[name] = model
    for own, group in groups:
        if own is None:
            for name, model in group.items():
                df = model.score(df, df.columns, name)
            continue
        before = df.columns
        df = next(iter(group.values())).vectors(df.withColumns({f"__k_{c}": F.col(c) for c in columns}))
        for name, model in group.items():
            df = model.on_vectors(df, name)
        df = df.select(*[F.col(f"__k_{c}").alias(c) if c in columns else c for c in before], *group)
    return df


def compare_candidates(df: DataFrame, folds, candidates: dict[str, tuple[str, dict, Sequence[str]]], y: str, keys: list[str], baseline: str, **options) -> DataFrame:
    """Fold metrics summary per candidate = {name: (family, params, features)}; best mean average precision first, ties in declared order.

    The columns used are written once. Each fold's validation rows are read once, made vectors once per set of features and
    scored by each of its different models; these rows are written before they are measured.
    """
    trains, names = [f"__t{k}" for k in range(len(folds))], list(candidates)
    used = list(dict.fromkeys([*options.get("indicators", ()), *(c for _, _, features in candidates.values() for c in features)]))
    marks = {f"__{kind}{k}": F.coalesce(f[at], F.lit(False)) for k, f in enumerate(folds) for kind, at in (("t", 1), ("v", 2))}
    rows = checkpoint(df.select(*dict.fromkeys([*used, y]), *[m.alias(n) for n, m in marks.items()]))
    models, parts, owners = fold_models(rows, trains, candidates, y, **options), None, []
    for k in range(len(folds)):
        first = {}  # the first candidate of each different model
        for i, name in enumerate(names):
            owners.append((k, first.setdefault(id(models[k, name]), i), i, name))
        scored = score_all(rows.where(f"__v{k}").select(*dict.fromkeys([*used, y])), {f"__p{i}": models[k, names[i]] for i in first.values()})
        each = F.array(*[F.struct(F.lit(i).alias("model"), F.col(f"__p{i}").alias("p")) for i in first.values()])
        scored = scored.select(F.lit(k).alias("fold"), y, each.alias("__s"))
        parts = scored if parts is None else parts.unionByName(scored)
    long = checkpoint(parts).select("fold", y, F.explode("__s").alias("__s")).select("fold", y, "__s.*")
    levels = checkpoint(long.groupBy("model", "fold", "p").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("long")).alias(y)))
    owned = df.sparkSession.createDataFrame(owners, "fold int, model int, position int, candidate string")
    measured = binary_metrics(levels, ["model", "fold"], y, "p", "__n", merged=True).join(F.broadcast(owned), ["fold", "model"])  # a row per fold and candidate
    metrics = checkpoint(measured.select("candidate", "position", "fold", "average_precision", "roc_auc", "brier_score", "log_loss"))
    summary = fold_summary(metrics, "candidate", "fold", "average_precision", baseline)
    others = metrics.groupBy("candidate").agg(F.min("position").alias("position"), F.avg("roc_auc").alias("mean_roc_auc"), F.avg("brier_score").alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss"))
    return summary.join(others, "candidate").orderBy(F.desc("mean_metric"), "position")


def interaction(summary: DataFrame, both: str, first: str, second: str, neither: str) -> DataFrame:
    """Main effects and interaction of a 2 x 2 ablation from the candidates' mean metrics."""
    m = {n: F.max(F.when(F.col("candidate") == c, F.col("mean_metric"))) for n, c in (("b", both), ("f", first), ("s", second), ("n", neither))}
    return summary.agg((m["f"] - m["n"]).alias("first_effect"), (m["s"] - m["n"]).alias("second_effect"), (m["b"] - m["f"] - m["s"] + m["n"]).alias("interaction"))


def prefix_scores(fitted: boosting.Boosted, df: DataFrame, keys: list[str], prefixes: Sequence[int]) -> DataFrame:
    """Scores of the first n boosting rounds of one fit, for several n, from one walk down the trees."""
    if not isinstance(fitted, boosting.Boosted):
        raise ContractError("prefix scores need a boosted model")
    margins = fitted.margins(df, keys, prefixes)
    return margins.select(*keys, *[boosting.probability(F.col(f"m_{n}")).alias(f"p_{n}") for n in prefixes])


def objective_history(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Training objective per iteration of a logistic fit."""
    history = [(i, float(v)) for i, v in enumerate(fitted.model.summary.objectiveHistory)]
    return df.sparkSession.createDataFrame(history, "iteration int, objective double")


# --- calibration, baseline, lookup ---------------------------------------

def logit(p: Column, epsilon: float = 1e-6) -> Column:
    clipped = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), p))
    return F.log(clipped / (1 - clipped))


def sigmoid_calibration(scored: DataFrame, y: str, p: str) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the log-odds of a held-out year."""
    rows = VectorAssembler(inputCols=["__l"], outputCol=VECTOR).transform(scored.select(F.col(y).cast("double").alias("__y"), logit(F.col(p)).alias("__l")))
    model = LogisticRegression(featuresCol=VECTOR, labelCol="__y", regParam=0.0, maxIter=50).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def calibrated(p: Column, slope: float, intercept: float) -> Column:
    return F.lit(1.0) / (F.exp(-(logit(p) * slope + intercept)) + 1)


def rate_baseline(train: DataFrame, df: DataFrame, y: str, name: str = "p") -> DataFrame:
    """Every row scored with the training rate (a one-row subquery)."""
    return df.withColumn(name, train.agg(F.avg(F.col(y).cast("double"))).scalar())


def day_summary(scored: DataFrame, day: str, p: str, missing: str) -> DataFrame:
    return scored.groupBy(day).agg(F.count(F.lit(1)).alias("cells"), F.sum(missing).alias("missing"), F.max(p).alias("maximum_score"), F.avg(p).alias("mean_score"))


def lookup(scored: DataFrame, inputs: DataFrame, keys: list[str], values: dict) -> DataFrame:
    """One key's inputs, score and label; both sides are filtered before they meet."""
    for k, v in values.items():
        scored, inputs = scored.where(F.col(k) == v), inputs.where(F.col(k) == v)
    return inputs.join(scored, keys)
