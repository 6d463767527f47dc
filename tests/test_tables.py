"""Contracts, parsing, scans, sinks, checks and failing jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from panelspark import contracts as C
from panelspark.functions import clean
from panelspark.operators import model as L, quality as Q, sets as S
from panelspark.sources import scan, sinks


def test_contract_rejects_leaks_repeats_and_schema_changes(spark):
    with pytest.raises(C.ContractError):
        C.Contract("v1", "label", ("a", "label"))
    with pytest.raises(C.ContractError):
        C.Contract("v1", "label", ("a", "size"), forbidden=frozenset({"size"}))
    with pytest.raises(C.ContractError):
        C.Contract("v1", "label", ("a", "a"))
    df = spark.createDataFrame([(1, 2, 3)], "k int, a int, label int")
    assert C.Contract("v1", "label", ("a",)).features(df, ["k"]).columns == ["k", "a"]
    C.assert_columns(df, ["a"], exact=False)
    with pytest.raises(C.ContractError):
        C.assert_columns(df, ["a", "k", "label"])


def test_gate_refuses_failed_or_foreign_audits(spark):
    audit = spark.createDataFrame([("PASS", "v1", "x")], "status string, version string, checksum string")
    C.gate(audit, "v1", "x")
    for bad in (("FAIL", "v1", "x"), ("PASS", "v2", "x"), ("PASS", "v1", "y")):
        with pytest.raises(C.ContractError):
            C.gate(spark.createDataFrame([bad], audit.schema), "v1", "x")


def test_parsing(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("",), ("abc",), (None,)], "v string")
    assert [r.n for r in df.select(clean.number(F.col("v")).alias("n")).collect()] == [1.5, None, None, None]
    days = spark.createDataFrame([("2019-02-28",), ("2019-02-30",)], "d string")
    assert spark.createDataFrame([("2019-02-28",)], "d string").select(clean.strict_date(F.col("d"), "label")).first()[0] == dt.date(2019, 2, 28)
    with pytest.raises(Exception, match="invalid ISO date for label"):
        days.select(clean.strict_date(F.col("d"), "label")).collect()
    r = spark.range(1).select(clean.calendar_date(F.lit(2010), F.lit(0), F.lit(0)).alias("z"), clean.banded(F.lit(200.0), [40.0, 200.0, 1000.0], ["a", "b"]).alias("b"), clean.letters(F.lit("SLK-12é")).alias("l")).first()
    assert (r.z, r.b, r.l) == (None, "b", "SLKé")


def test_csv_header_is_enforced(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("﻿b,a\n1,2\n", encoding="utf-8")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    with pytest.raises(Exception):
        scan.scan_csv(spark, path, schema).collect()
    assert tuple(scan.scan_csv(spark, path, schema, exact=False).first()) == (2, 1)
    with pytest.raises(C.ContractError):
        scan.scan_text(spark, path, ["c"])


def test_panel_write_refuses_overwrite_and_prunes_years(spark, tmp_path):
    df = spark.createDataFrame([(y, y * 10) for y in (2010, 2011, 2012)], "year int, v int")
    path = str(tmp_path / "panel")
    sinks.write_panel(df, path)
    with pytest.raises(Exception, match="exist"):
        sinks.write_panel(df, path)
    back = scan.year_slice(spark.read.parquet(path), 2011, 2011)
    assert [r.v for r in back.collect()] == [20110]
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().toString()
    with pytest.raises(C.ContractError):
        scan.year_slice(spark.read.parquet(path), 1900, 1901)


def test_stored_predictions_must_match_labels(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0.2, 2012), (2, 1, 0.7, 2013)], "id int, y int, p double, fold int")
    path = sinks.write_predictions(rows, str(tmp_path / "p"), {"a": 1, "b": 2})
    assert sinks.parameter_id({"b": 2, "a": 1}) == sinks.parameter_id({"a": 1, "b": 2})
    assert sinks.read_predictions(spark, path, {"b": 2, "a": 1}, rows, ["id"]).count() == 2
    for wrong in (rows.withColumn("y", 1 - F.col("y")), rows.union(spark.createDataFrame([(3, 0, 0.1, 2013)], rows.schema))):
        with pytest.raises(Exception, match="do not match"):
            sinks.read_predictions(spark, path, {"a": 1, "b": 2}, wrong, ["id"]).collect()


def test_fingerprint_gate(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    found = scan.fingerprint(spark, str(tmp_path / "f.bin"))
    assert found.first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    with pytest.raises(Exception, match="checksum differs"):
        scan.fingerprint_gate(found, spark.createDataFrame([("f.bin", "0")], "file string, sha256 string")).collect()


def test_geojson_polygons_and_multipolygons(spark, tmp_path):
    square = "[[0,0],[1,0],[1,1],[0,0]]"
    (tmp_path / "g.json").write_text(
        '{"features":[{"type":"Feature","properties":{"id":"a","ms":86400000},"geometry":{"type":"Polygon","coordinates":[%s]}},'
        '{"type":"Feature","properties":{"id":"b","ms":null},"geometry":{"type":"MultiPolygon","coordinates":[[%s],[%s]]}}]}' % (square, square, square))
    features = scan.scan_geojson(spark, str(tmp_path / "g.json"), "id:string,ms:bigint")
    assert {r.id: r.d for r in features.select("id", scan.epoch_day(F.col("ms")).alias("d")).collect()} == {"a": dt.date(1970, 1, 2), "b": None}
    edges = scan.ring_edges(features, "id").collect()
    assert len([e for e in edges if e.id == "a"]) == 3 and {(e.part, e.ring) for e in edges if e.id == "b"} == {(0, 0), (1, 0)}


def test_failing_checks_fail_the_job(spark):
    df = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(Exception, match="check failed: big"):
        Q.require(Q.violations(df, [("big", F.col("v") > 5)])).collect()
    with pytest.raises(Exception, match="past-only boundary broken"):
        Q.audit(df, "v1", {"rows": F.count(F.lit(1))}, F.col("v") > 5, {"n": "x"}).collect()
    with pytest.raises(Exception, match="right key repeats"):
        Q.validated_join(df, df, ["k"], "many_to_one").collect()


def test_null_and_static_checks(spark):
    df = spark.createDataFrame([("a", None, 1, 1.0), ("a", 2, 0, 1.0), ("b", 3, 1, 5.0), ("b", 4, 0, 5.1)], "k string, v int, missing int, z double")
    got = {r.check: r.violations for r in Q.violations(df, [Q.null_matches("v", "v", F.col("missing") == 1)]).collect()}
    assert got == {"v": 1}
    assert tuple(Q.static_violations(df, "k", ["z", "v"]).first()) == (1, 2)


def test_set_operations(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert tuple(S.equality(a, b, ["k"]).first()) == (2, 1)
    assert sorted(r.k for r in S.difference(a, b).collect()) == [1, 2]
    assert S.overlap_count(a, b, ["k"]).first().shared == 1
    assert (S.duplicated(a, ["k"]).count(), S.without_duplicated(a, ["k"]).count()) == (2, 1)


def test_fitted_statistics_ignore_held_out_rows(spark):
    df = spark.createDataFrame([(y, i, float(i) if i % 3 else None, None, float(i)) for y in (1, 2) for i in range(30)], "year int, id int, a double, empty double, raw double")
    mutated = df.withColumn("a", F.when(F.col("year") == 2, F.col("a") * 1000).otherwise(F.col("a")))
    fits = [L.Preprocessor.fit(d.where("year = 1"), ["a", "empty", "raw"], ["a"], ["raw"]) for d in (df, mutated)]
    assert fits[0] == fits[1] and fits[0].medians["empty"] == 0.0 and fits[0].scales["empty"] == 1.0 and fits[0].scales["raw"] == 1.0
    row = fits[0].transform(df).where("id = 0 and year = 1").first()
    assert row.a__missing == 1.0 and row.raw == 0.0


def test_folds_never_train_on_their_validation_year(spark, monkeypatch):
    df = spark.createDataFrame([(y, i, i % 2, float(i)) for y in (2010, 2011, 2012, 2013) for i in range(20)], "year int, id int, y int, a double")
    seen, real = [], L.fit

    def recording(family, params, train, *args, **options):
        seen.append(sorted(r.year for r in train.select("year").distinct().collect()))
        return real(family, params, train, *args, **options)

    monkeypatch.setattr(L, "fit", recording)
    L.out_of_fold(df, L.expanding_folds(2010, (2012, 2013)), "logistic", {}, ["a"], "y", ["id"])
    L.out_of_fold(df, L.leave_one_year_out((2010,)), "logistic", {}, ["a"], "y", ["id"])
    assert seen == [[2010, 2011], [2010, 2011, 2012], [2011, 2012, 2013]]
    with pytest.raises(C.ContractError):
        L.fit("logistic", {}, df, ["a", "y"], "y")


def test_boosting_prefix_of_all_rounds_is_the_model(spark):
    df = spark.createDataFrame([(i, int(i % 7 < 3), float(i % 7), float(i % 5)) for i in range(200)], "id int, y int, a double, b double")
    fitted = L.fit("boosted", {"rounds": 4, "min_leaf": 1}, df, ["a", "b"], "y")
    both = L.prefix_scores(fitted, df, ["id"], (2, 4)).join(fitted.score(df, ["id"]), "id").collect()
    assert all(r.p_4 == pytest.approx(r.p) for r in both) and any(abs(r.p_2 - r.p) > 1e-6 for r in both)


def test_random_candidates_are_seeded_and_distinct():
    grid = {"a": (1, 2, 3), "b": (0.1, 0.2)}
    drawn = L.random_candidates(grid, 5, 1)
    assert drawn == L.random_candidates(grid, 5, 1) and len({tuple(sorted(d.items())) for d in drawn}) == 5
    assert len(L.random_candidates(grid, 50, 1)) == 6


def test_a_search_prepares_all_folds_at_once_and_fits_like_single_folds(spark, monkeypatch):
    df = spark.createDataFrame([(y, i, int((i * y) % 7 < 3), float(i % 11) if i % 4 else None, float(i % 5)) for y in (2010, 2011, 2012, 2013) for i in range(60)], "year int, id int, y int, a double, b double")
    folds = L.expanding_folds(2010, (2012, 2013))
    marked = df.select("*", *[f[1].alias(f"t{k}") for k, f in enumerate(folds)])
    calls, real = [], L.quantiles
    monkeypatch.setattr(L, "quantiles", lambda *a, **o: calls.append(a) or real(*a, **o))
    candidates = {"one": ("logistic", {"l2": 0.1}, ["a"]), "two": ("logistic", {"l2": 0.01}, ["a", "b"])}
    models = L.fold_models(marked, ["t0", "t1"], candidates, "y", indicators=["a"])
    assert len(calls) == 1
    for (k, name), model in models.items():
        single = L.fit("logistic", candidates[name][1], df.where(folds[k][1]), candidates[name][2], "y", indicators=["a"])
        assert model.preprocessor.medians == pytest.approx(single.preprocessor.medians) and model.preprocessor.scales == pytest.approx(single.preprocessor.scales)
        assert model.model.coefficients.toArray() == pytest.approx(single.model.coefficients.toArray(), rel=1e-6, abs=1e-9)
        assert model.preprocessor.outputs == single.preprocessor.outputs


def test_settings_that_converge_within_their_iterations_are_fitted_and_scored_once(spark, monkeypatch):
    df = spark.createDataFrame([(y, i, int((i * y) % 7 < 3), float(i % 11) if i % 4 else None, float(i % 5)) for y in (2010, 2011, 2012) for i in range(60)], "year int, id int, y int, a double, b double")
    marked = df.select("*", (F.col("year") < 2012).alias("t0"))
    fits, real = [], L.estimate
    monkeypatch.setattr(L, "estimate", lambda family, params, prepared: fits.append(params) or real(family, params, prepared))
    features = ["a", "b"]
    candidates = {"short": ("logistic", {"l2": 0.1, "iterations": 1}, features), "long": ("logistic", {"l2": 0.1, "iterations": 50}, features),
                  "plain": ("logistic", {"l2": 0.1}, features), "other": ("logistic", {"l2": 1.0}, features), "less": ("logistic", {"l2": 1.0}, ["b"])}
    models = L.fold_models(marked, ["t0"], candidates, "y", indicators=["a"])
    assert len(fits) == 4 and models[0, "plain"] is models[0, "long"] and models[0, "short"] is not models[0, "long"]
    scored = L.score_all(df, {n: models[0, n] for n in candidates})
    assert scored.columns == [*df.columns, *candidates]
    got = {(r.year, r.id): r for r in scored.collect()}
    for n in candidates:
        single = L.fit("logistic", candidates[n][1], df.where("year < 2012"), candidates[n][2], "y", indicators=["a"]).score(df, ["year", "id", "a"]).collect()
        assert all(got[r.year, r.id][n] == pytest.approx(r.p, rel=1e-6) and got[r.year, r.id].a == r.a for r in single)
