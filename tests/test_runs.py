"""Runs on disk: what is whole, what is found, what is refused."""

from __future__ import annotations

from dataclasses import replace

import pytest

from tidewater.config import ORDERS, Study
from tidewater.sources import runs

SCHEMA = "series string, date string, model string, variance double"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "runs")


def _table(spark, model, days, more=()):
    return spark.createDataFrame([("s", f"2020-01-{d:02}", model, None if d in more else float(d)) for d in days], SCHEMA)


def test_settings_survive_json():
    assert Study.from_json(ORDERS.to_json()) == ORDERS
    with pytest.raises(TypeError):
        Study.from_json('{"unknown": 1}')


@pytest.mark.parametrize("fmt", runs.FORMATS)
def test_a_run_comes_back_as_it_was(spark, folder, fmt):
    table = _table(spark, "a", range(1, 6), more=(3,))
    runs.save_run(folder, "one", ORDERS, {"forecasts": table}, fmt=fmt)
    back = runs.load_run(spark, folder, "one", "forecasts")
    assert back.drop("run").schema == table.schema and sorted(back.drop("run").collect()) == sorted(table.collect()) if fmt == "parquet" else back.count() == 5
    with pytest.raises(ValueError, match="there already"):
        runs.save_run(folder, "one", ORDERS, {"forecasts": table}, fmt=fmt)
    with pytest.raises(ValueError, match="no table"):
        runs.load_run(spark, folder, "one", "refits")


def test_parts_without_a_manifest_are_no_run(spark, folder):
    table = _table(spark, "a", range(1, 4))
    assert runs.find_runs(spark, folder).count() == 0
    table.write.parquet(f"{folder}/cut-off/forecasts")
    runs.save_run(folder, "whole", ORDERS, {"forecasts": table}, partition_by=("model",))
    assert [r["run"] for r in runs.find_runs(spark, folder).collect()] == ["whole"]
    with pytest.raises(ValueError, match="no whole run"):
        runs.load_run(spark, folder, "cut-off", "forecasts")
    runs.save_run(folder, "cut-off", ORDERS, {"forecasts": table})  # what was left is written over
    assert runs.load_run(spark, folder, "cut-off", "forecasts").count() == 3


def test_a_table_that_lost_rows_is_refused(spark, folder):
    runs.save_run(folder, "one", ORDERS, {"forecasts": _table(spark, "a", range(1, 6))})
    _table(spark, "a", range(1, 3)).write.mode("overwrite").parquet(f"{folder}/one/forecasts")
    with pytest.raises(ValueError, match="manifest says 5"):
        runs.load_run(spark, folder, "one", "forecasts")


def test_runs_merge_if_their_settings_agree(spark, folder):
    runs.save_run(folder, "b", ORDERS, {"forecasts": _table(spark, "b", range(1, 6), more=(2,))})
    runs.save_run(folder, "a", ORDERS, {"forecasts": _table(spark, "a", range(2, 9))})
    merged = runs.merge_runs(spark, folder)
    assert merged.count() == 12 and {r["run"] for r in merged.select("run").distinct().collect()} == {"a", "b"}
    assert sorted(r["date"] for r in runs.dates_of_all_runs(merged).collect()) == ["2020-01-03", "2020-01-04", "2020-01-05"]
    assert runs.merge_runs(spark, folder, pattern="a").count() == 7
    runs.save_run(folder, "c", replace(ORDERS, seed=1), {"forecasts": _table(spark, "c", range(1, 3))})
    with pytest.raises(ValueError, match="differ in .*seed"):
        runs.merge_runs(spark, folder)
    assert runs.merge_runs(spark, folder, ignore=("seed",)).count() == 14


def test_the_same_forecast_in_two_runs_is_refused(spark, folder):
    for name in ("x", "y"):
        runs.save_run(folder, name, ORDERS, {"forecasts": _table(spark, "a", range(1, 3))})
    with pytest.raises(Exception, match="repeated"):
        runs.merge_runs(spark, folder).count()
    with pytest.raises(ValueError, match="no whole run"):
        runs.merge_runs(spark, folder, pattern="z*")
