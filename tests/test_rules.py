"""Rule files, baselines, upsert, overrides, alerts, range breaches."""

import datetime as dt
import json
import os


from helpers import rows
from millrace.operators import rules as R


def write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_rules_file_semantics(spark, tmp):
    items = [{"machine": "M-1", "sensor": "Temperature", "min": 80, "max": 100},
             "not an object",
             {"sensor": "Vibration", "min": 1, "max": 2},
             {"machine": "M-2", "min": 1, "max": 2},
             {"machine": "M-1", "sensor": "Temperature", "min": 90, "max": 95},
             {"machine": "M-3", "sensor": "Unknown", "min": 0, "max": 1}]
    rules, rejected = R.read_rules_file(spark, write(tmp, "r.json", json.dumps(items)))
    assert rows(rules, "machine", "sensor", "min", "max") == [
        ("M-1", "Temperature", 90.0, 95.0), ("M-3", "Unknown", 0.0, 1.0)]
    assert rejected.count() == 1


def test_rules_lines_over_many_files(spark, tmp):
    """One entry a line: the last line of the last file wins, a broken line is rejected alone."""
    os.mkdir(f"{tmp}/rules.jsonl")
    for i in range(5):
        entries = [{"machine": f"M-{j}", "sensor": "RPM", "min": i, "max": i + j} for j in range(200)]
        lines = [json.dumps(e) for e in entries] + [json.dumps({"machine": "M-1", "sensor": "RPM", "min": 50 + i, "max": 60})]
        lines += ["", "{broken", '"text"', "7", json.dumps({"sensor": "x"}), json.dumps({"machine": "M-2", "min": 1, "max": 2}),
                  json.dumps({"machine": "M-2", "sensor": "Noise", "min": "low", "max": 2})]
        write(f"{tmp}/rules.jsonl", f"part-{i}.txt", "\n".join(lines))
    rules, rejected = R.read_rules_lines(spark, f"{tmp}/rules.jsonl")
    got = {r["machine"]: (r["min"], r["max"]) for r in rules.collect()}
    assert got == {**{f"M-{j}": (4.0, 4.0 + j) for j in range(200)}, "M-1": (54.0, 60.0)}
    assert sorted(r["reason"] for r in rejected.collect()) == ["missing sensor/min/max"] * 10 + ["unreadable line"] * 5


def test_no_task_gathers_all_rules(spark, smoke_dir):
    from millrace.plans.registry import run
    for name in ("rules_file", "baselines_file"):
        plan = run(name, spark, smoke_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [" in plan and "Aggregate [max_by" not in plan    # grouped aggregates only


def test_baselines_lines(spark, tmp):
    text = "\n".join([json.dumps({"M-1": {"RPM": 5, "Noise": "x"}}), "", "nonsense", json.dumps({"M-2": {"RPM": "7.5"}, "M-1": {"RPM": 6}})])
    got = R.read_baselines_lines(spark, write(tmp, "b.jsonl", text))
    assert rows(got, "machine", "sensor", "value") == [("M-1", "Noise", None), ("M-1", "RPM", 6.0), ("M-2", "RPM", 7.5)]


def test_unreadable_and_empty_rules(spark, tmp):
    rules, rejected = R.read_rules_file(spark, write(tmp, "bad.json", "{not json"))
    assert rules.count() == 0 and [r["reason"] for r in rejected.collect()] == ["unreadable file"]
    rules, _ = R.read_rules_file(spark, write(tmp, "empty.json", "[]"))
    assert rules.count() == 0


def test_baselines_and_merge(spark, tmp):
    b = R.read_baselines_file(spark, write(tmp, "b.json", json.dumps(
        {"M-1": {"Temperature": 70, "Vibration": 0.7}, "M-9": {"Temperature": "hot"}})))
    assert rows(b, "machine", "sensor", "value") == [
        ("M-1", "Temperature", 70.0), ("M-1", "Vibration", 0.7), ("M-9", "Temperature", None)]
    cur = b.where("value IS NOT NULL")
    upd = spark.createDataFrame([("M-1", "Temperature", "72.5"), ("M-2", "Temperature", "60"),
                                 ("M-2", "Vibration", "x")], "machine string, sensor string, text string")
    merged = rows(R.baseline_merge(cur, upd), "machine", "sensor", "value")
    assert merged == [("M-1", "Temperature", 72.5), ("M-1", "Vibration", 0.7)]   # M-2 rejected whole


def test_upsert_is_idempotent_with_defaults(spark):
    base = spark.createDataFrame([("M-1", "Temperature", 1.0, 2.0), ("M-1", "RPM", 3.0, 4.0)], R.RULES_SCHEMA)
    new = spark.createDataFrame([("M-1", "Temperature", None, None)], R.RULES_SCHEMA)
    once = R.rule_upsert(base, new)
    twice = R.rule_upsert(once, new)
    assert rows(once) == rows(twice) == [("M-1", "RPM", 3.0, 4.0), ("M-1", "Temperature", 0.0, 100.0)]


def test_label_modes_and_alerts(spark):
    readings = spark.createDataFrame(
        [(m, 50.0, "Running", "E7", "Eco") for m in ("M-1", "M-2", "M-3")],
        "Machine string, Temperature double, Running_Status string, Error_Code string, Mode string")
    rules = spark.createDataFrame([("M-1", "Temperature", 80.0, 90.0), ("M-3", "Unknown", 0.0, 1.0)], R.RULES_SCHEMA)
    out = {r["Machine"]: r for r in R.label_modes(readings, rules).collect()}
    for m in ("M-1", "M-3"):                                 # also with a rule for an unknown sensor
        assert (out[m]["Mode"], out[m]["Running_Status"]) == ("Custom Disturbance", "Warning")
    assert all((r["Temperature"], r["Error_Code"]) == (50.0, "E7") for r in out.values())   # facts stay
    assert (out["M-2"]["Mode"], out["M-2"]["Running_Status"]) == ("Eco", "Running")
    empty = R.rules_clear(spark)
    base = spark.createDataFrame([], "machine string, sensor string, value double")
    assert [r["Alert"] for r in R.active_alerts(empty, base).collect()] == [R.ALERT_NONE]
    lines = [r["Alert"] for r in R.active_alerts(rules, base).collect()]
    assert "⚠️ M-1 | Temperature forced to 80.0-90.0" in lines


def test_range_breach(spark):
    t = dt.datetime(2024, 1, 1)
    readings = spark.createDataFrame([("M-1", t, 95.0), ("M-1", t + dt.timedelta(hours=1), 85.0)],
                                     "Machine string, Timestamp timestamp_ntz, Temperature double")
    rules = spark.createDataFrame([("M-1", "Temperature", 80.0, 90.0)], R.RULES_SCHEMA)
    got = R.range_breach(readings, rules, ["Machine", "Timestamp"])
    assert [r["Value"] for r in got.collect()] == [95.0]
