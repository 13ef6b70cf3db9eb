"""Registered queries: failure-risk model."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import ml
from millrace.operators.timeseries import latest_per_key, tail_per_key
from millrace.plans.oracle import hash_unit
from millrace.plans.registry import register
from millrace.session import checkpoint_dir

_KEY = ["Machine", "Timestamp"]


@register("prediction_metrics", """
WITH pr AS (SELECT CAST(Running_Status IN ('Error', 'Warning') AS INTEGER) AS l,
                   CAST(Temperature > 100 AS INTEGER) AS p FROM fact_sensor),
c AS (SELECT l, p, count(*) AS n FROM pr GROUP BY l, p),
parts AS (SELECT l AS Class, n AS s, CASE WHEN l = p THEN n ELSE 0 END AS t, 0 AS q FROM c
          UNION ALL SELECT p AS Class, 0, 0, n FROM c),
per AS (SELECT Class, CAST(sum(s) AS BIGINT) AS Support, CAST(sum(t) AS BIGINT) AS tp,
               CAST(sum(q) AS BIGINT) AS predicted FROM parts GROUP BY Class),
m AS (SELECT Class,
             COALESCE(CAST(tp AS DOUBLE) / CAST(nullif(predicted, 0) AS DOUBLE), 0.0::DOUBLE) AS Precision,
             COALESCE(CAST(tp AS DOUBLE) / CAST(nullif(Support, 0) AS DOUBLE), 0.0::DOUBLE) AS Recall,
             Support,
             CAST(sum(tp) OVER () AS DOUBLE) / CAST(nullif(sum(Support) OVER (), 0) AS DOUBLE) AS Accuracy
      FROM per)
SELECT Class, Precision, Recall, Support, Accuracy,
       COALESCE(2.0::DOUBLE * Precision * Recall / nullif(Precision + Recall, 0.0::DOUBLE), 0.0::DOUBLE) AS F1
FROM m""", "M2 M7 (metrics of a threshold predictor)")
def _prediction_metrics(m):
    fs = m.bronze.fact_sensor
    pred = ml.label(fs).withColumn("prediction", (F.col("Temperature") > 100).cast("int"))
    return ml.evaluate(pred)


_SAMPLE_QUERY_ROWS = 500


@register("training_sample", f"""
WITH k AS (SELECT Machine, "Timestamp", Running_Status, epoch_us("Timestamp") AS us FROM fact_sensor),
s AS (SELECT *, {hash_unit('42', 'Machine', 'us')} AS h FROM k ORDER BY h, Machine, "Timestamp" LIMIT {_SAMPLE_QUERY_ROWS})
SELECT Machine, "Timestamp", CAST(Running_Status IN ('Error', 'Warning') AS INTEGER) AS label,
       CASE WHEN {hash_unit('43', 'Machine', 'us')} < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS Split
FROM s""", "M1 M2 M5: the sample, its labels and its split")
def _training_sample(m):
    fs = m.bronze.fact_sensor.select("Machine", "Timestamp", "Running_Status")
    s = ml.label(ml.sample_n(fs, _SAMPLE_QUERY_ROWS, ["Machine", "Timestamp"]))
    train, test = ml.split(s, ["Machine", "Timestamp"])
    named = [d.select("Machine", "Timestamp", "label", F.lit(n).alias("Split")) for d, n in ((train, "train"), (test, "test"))]
    return named[0].unionByName(named[1])


def _model(m):
    """Fit once per medallion (session + data folder); kept on the medallion."""
    if not hasattr(m, "_failure_model"):
        # at most SAMPLE_ROWS + SYNTHETIC_ROWS rows whatever the input size, so
        # keeping it for the fit and the hold-out scoring is bounded
        frame = ml.training_frame(m.bronze.fact_sensor, _KEY).persist()
        train, test = ml.split(frame, ["_key"])
        m._failure_model = (ml.fit(train), test)
    return m._failure_model


register("model_evaluation", None, "M1-M7 hold-out metrics of the random forest")(
    lambda m: ml.evaluate(ml.score(_model(m)[0], _model(m)[1])))


@register("failure_risk_latest", None, "M8-M11 risk of each machine's newest reading")
def _risk_latest(m):
    path = f"{checkpoint_dir(m.spark).rstrip('/')}/models/{uuid.uuid4().hex[:12]}"
    ml.save(_model(m)[0], path)
    model = ml.load(path)
    fs = m.bronze.fact_sensor.select(*_KEY, *ml.FEATURES)
    latest = latest_per_key(fs, "Machine", ["Timestamp"])
    return ml.score(model, latest).select("Machine", "Timestamp", "Risk_Pct", "Risk_Band")


@register("failure_risk_recent", None, "M9 risk over each machine's newest 100 readings")
def _risk_recent(m):
    model, _ = _model(m)
    fs = m.bronze.fact_sensor.select(*_KEY, *ml.FEATURES)
    recent = tail_per_key(fs, "Machine", ["Timestamp"], 100, pos_col="Position")
    return ml.score(model, recent).select("Machine", "Timestamp", "Position", "Risk_Pct", "Risk_Band")
