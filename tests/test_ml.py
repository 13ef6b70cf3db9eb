"""Model pipeline: repeatable sample/split, metrics, save/load, scoring."""

import datetime as dt
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import ml
from millrace.operators import timeseries as ts


def _readings(spark, n=400):
    t = dt.datetime(2024, 1, 1)
    data = [(f"M-{i % 7}", t + dt.timedelta(minutes=i), 40.0 + (i % 13), 0.5 + (i % 5) / 10,
             10.0 + (i % 17), "Warning" if i % 9 == 0 else "Running") for i in range(n)]
    return spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz, Temperature double, "
                                       "Vibration double, Power_Consumption double, Running_Status string")


def test_sample_is_exact_and_repeatable(spark, monkeypatch):
    df = _readings(spark)
    a = [tuple(r) for r in ml.sample_n(df, 50, ["Machine", "Timestamp"]).collect()]
    b = [tuple(r) for r in ml.sample_n(df.repartition(3), 50, ["Machine", "Timestamp"]).collect()]
    assert len(a) == 50 and sorted(a) == sorted(b)
    from millrace.operators import timeseries as ts
    c = [tuple(r) for r in ml.sample_n(df, 50, ["Machine", "Timestamp"]).collect()]
    assert sorted(a) == sorted(c)
    assert ml.sample_n(df, 10_000, ["Machine", "Timestamp"]).count() == 400   # fewer rows: all


def _sample_by_sorting(rows, n, key_cols, seed=ml.SEED):
    """The whole order, by one sort."""
    whole = F.xxhash64(*rows.columns)
    return rows.orderBy(F.floor(ml._hash(rows, key_cols, seed) * float(1 << 32)), whole, *rows.columns).limit(n)


@pytest.mark.parametrize("n", [0, 1, 50, 199, 200, 201, 1500, 5000])
def test_sample_with_keys_and_rows_that_repeat(spark, n):
    """One key in a third of the rows, one row in another third."""
    df = spark.range(600).selectExpr(
        "CASE WHEN id % 3 = 2 THEN concat('M', id) ELSE 'HOT' END AS Machine",
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS Value", "CAST(NULL AS STRING) AS Status")
    for layout in (df, df.repartition(3), df.coalesce(1)):
        got = Counter(tuple(r) for r in ml.sample_n(layout, n, ["Machine"]).collect())
        assert got == Counter(tuple(r) for r in _sample_by_sorting(df, n, ["Machine"]).collect())
        assert sum(got.values()) == min(n, 600)


def test_sample_where_one_key_or_one_row_is_the_table(spark):
    one_key = spark.range(30_000).selectExpr("'A' AS Machine", "id")
    for seed in (1, 2, 4):
        picked = ml.sample_n(one_key, 10_000, ["Machine"], seed).select("id").collect()
        assert len(picked) == len(set(picked)) == 10_000
    one_row = spark.range(30_000).selectExpr("'A' AS Machine", "1.5 AS Value")
    assert ml.sample_n(one_row, 10_000, ["Machine"]).count() == 10_000
    assert ml.sample_n(one_row, 50_000, ["Machine"]).count() == 30_000
    assert ml.sample_n(one_row.limit(0), 10, ["Machine"]).count() == 0


def test_sample_is_the_same_on_two_and_four_cores(tmp):
    code = """
import sys
from millrace.operators import ml
from millrace.session import get_spark
s = get_spark("cores", master=f"local[{sys.argv[1]}]", shuffle_partitions=int(sys.argv[1]))
df = s.range(5000).selectExpr("concat('M', id % 7) AS Machine", "id % 900 AS Value")
print(sorted(tuple(r) for r in ml.sample_n(df, 1234, ["Machine"]).collect()))
"""
    out = [subprocess.run([sys.executable, "-c", code, cores], capture_output=True, text=True, timeout=300,
                          cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout for cores in ("2", "4")]
    assert out[0] == out[1] and out[0].count("(") == 1234


def test_train_evaluate_save_load_score(spark, tmp):
    frame = ml.training_frame(_readings(spark), ["Machine", "Timestamp"], synthetic_rows=200)
    train, test = ml.split(frame, ["_key"])
    assert train.count() + test.count() == frame.count()
    assert 0.1 < test.count() / frame.count() < 0.3
    model = ml.fit(train)
    metrics = {r["Class"]: r for r in ml.evaluate(ml.score(model, test)).collect()}
    assert set(metrics) <= {0, 1}
    for r in metrics.values():
        assert 0.0 <= r["Precision"] <= 1.0 and 0.0 <= r["Recall"] <= 1.0 and 0.0 <= r["Accuracy"] <= 1.0
    path = os.path.join(tmp, "model")
    ml.save(model, path)
    again = ml.load(path)
    latest = ts.latest_per_key(_readings(spark), "Machine", ["Timestamp"])
    s1 = {r["Machine"]: r["Risk_Pct"] for r in ml.score(model, latest).collect()}
    s2 = {r["Machine"]: r["Risk_Pct"] for r in ml.score(again, latest).collect()}
    assert s1 == s2 and all(0.0 <= v <= 100.0 for v in s1.values())
    assert ml.load(os.path.join(tmp, "missing")) is None


def test_evaluate_known_counts(spark):
    pred = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2, "label int, prediction int")
    m = {r["Class"]: r for r in ml.evaluate(pred).collect()}
    assert m[1]["Precision"] == 3 / 5 and m[1]["Recall"] == 3 / 4 and m[1]["Support"] == 4
    assert m[0]["Precision"] == 4 / 5 and m[0]["Recall"] == 4 / 6
    assert m[0]["Accuracy"] == 0.7
    assert abs(m[1]["F1"] - 2 * 0.6 * 0.75 / 1.35) < 1e-12
