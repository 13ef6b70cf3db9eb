"""CSV by-name loading, tolerant scans, routing, writers and publishing."""

import gzip
import os

import pytest

from millrace.sources import files as S

SENSOR_CSV = (
    "Timestamp,Factory,Production Line,Machine,Temperature,Vibration,Voltage,Current,Power Consumption,"
    "Pressure,RPM,Oil Level,Humidity,Noise,Running Status,Error Code\n"
    "2024-01-01 00:00:00,Plant A,Line 1,M-00001,50.5,0.512,400.1,20.2,10.5,100.0,1500,95.0,45.0,62.5,Running,None\n"
    "2024-01-01 01:00:00,Plant A,Line 1,M-00001,51.0,0.500,400.0,20.0,10.0,100.0,1500,95.0,45.0,62.5,Warning,E101\n")


def write(tmp, name, text, gz=False):
    p = os.path.join(tmp, name)
    if gz:
        with gzip.open(p, "wt") as f:
            f.write(text)
    else:
        with open(p, "w") as f:
            f.write(text)
    return p


def test_csv_loads_by_name_with_missing_column(spark, tmp):
    p = write(tmp, "fact_sensor.csv", SENSOR_CSV)
    df = S.csv_scan(spark, p, "fact_sensor")
    r = df.orderBy("Timestamp").first()
    assert r["Production_Line"] == "Line 1" and r["Power_Consumption"] == 10.5
    assert r["Mode"] is None                                 # absent column -> typed NULL (H6)
    assert df.schema["Timestamp"].dataType.simpleString() == "timestamp_ntz"


def test_quality_csv_without_inspection_id(spark, tmp):
    p = write(tmp, "fact_quality.csv", "Date,Product,Inspection,Defect Type,Pass,Fail,Inspector\n"
                                       "2024-01-01,P1,INSP-1,None,1,0,Ann\n")
    r = S.csv_scan(spark, p, "fact_quality").first()
    assert r["Inspection_ID"] == "INSP-1" and r["Defect_Type"] == "None" and r["Pass"] == 1


def test_tolerant_scan_quarantines_bad_lines(spark, tmp):
    text = SENSOR_CSV + "2024-01-01 02:00:00,Plant A,Line 1,M-00001,hot,0.5\n"
    good, bad = S.csv_scan_tolerant(spark, write(tmp, "s.csv", text), "fact_sensor")
    assert good.count() == 2
    reasons = [r["reason"] for r in bad.collect()]
    assert len(reasons) == 1 and "bad Temperature" in reasons[0]


def test_routing_and_bulk_load(spark, tmp):
    src = os.path.join(tmp, "out")
    os.makedirs(src)
    write(src, "fact_sensor.csv.gz", SENSOR_CSV, gz=True)
    write(src, "fact_sensor_live.csv", SENSOR_CSV)
    write(src, "notes.txt", "x")
    routes = S.route_files(spark, src)
    assert list(routes.values()) == ["fact_sensor"] and routes and all("live" not in p for p in routes)
    loaded = S.bulk_load(spark, src, os.path.join(tmp, "bronze"))
    assert loaded == {"fact_sensor": 2}
    again = S.bulk_load(spark, src, os.path.join(tmp, "bronze"))      # full refresh, not append
    assert again == {"fact_sensor": 2}


def test_bulk_load_skips_and_reports_bad_lines(spark, tmp):
    src = os.path.join(tmp, "out")
    os.makedirs(src)
    lines = SENSOR_CSV.rstrip("\n").split("\n")
    bad = lines[1].split(",")
    bad[lines[0].split(",").index("Temperature")] = "hot"
    write(src, "fact_sensor.csv", "\n".join([*lines, ",".join(bad)]) + "\n")
    assert S.bulk_load(spark, src, f"{tmp}/bronze") == {"fact_sensor": 2}
    q = spark.read.parquet(f"{tmp}/bronze/_quarantine/fact_sensor").collect()
    assert len(q) == 1 and "Temperature" in q[0]["reason"]


def test_replayed_version_keeps_the_one_before(spark, tmp):
    base = os.path.join(tmp, "live")
    S.publish_version(spark.createDataFrame([(1,)], "x int"), base, "b1")
    for _ in range(2):                                       # the second is a replay
        S.publish_version(spark.createDataFrame([(2,)], "x int"), base, "b2")
        assert [r["x"] for r in S.read_published_before(spark, base, "b2").collect()] == [1]
        assert [r["x"] for r in S.read_published(spark, base).collect()] == [2]
    for i in range(3, 8):
        S.publish_version(spark.createDataFrame([(i,)], "x int"), base, f"b{i}")
    assert len(S.published_versions(spark, base)) == 3       # older folders are gone


def _one(spark, x):
    return spark.createDataFrame([(x,)], "x int")


def test_twenty_replays_leave_the_versions_as_they_are(spark, tmp):
    base = os.path.join(tmp, "live")
    for v in (1, 2, 3, 4):
        S.publish_version(_one(spark, v), base, f"b{v}")
    log, files = S.commits(spark, base), sorted(os.listdir(base))
    for _ in range(20):
        assert S.publish_version(_one(spark, 99), base, "b4") == "b4"
        S.publish_version(_one(spark, 99), base, "b1")       # also of a version that is gone
    assert S.commits(spark, base) == log and sorted(os.listdir(base)) == files
    assert [c.parent for c in log] == ["b1", "b2", "b3"] and S.published_versions(spark, base) == ["b2", "b3", "b4"]
    assert [r["x"] for r in S.read_published_before(spark, base, "b4").collect()] == [3]


def test_a_writer_that_comes_second_gets_a_conflict(spark, tmp, monkeypatch):
    base = os.path.join(tmp, "live")
    S.publish_version(_one(spark, 1), base, "b1", parent=None)
    with pytest.raises(S.PublishConflict):
        S.publish_version(_one(spark, 2), base, "b2", parent="b0")
    seen = S.commits(spark, base)
    S.publish_version(_one(spark, 2), base, "b2", parent="b1")
    monkeypatch.setattr(S, "commits", lambda *_: seen)       # a writer that read the log before that
    with pytest.raises(S.PublishConflict):
        S.publish_version(_one(spark, 3), base, "b3", parent="b1")
    monkeypatch.undo()
    assert [r["x"] for r in S.read_published(spark, base).collect()] == [2]
    assert len([n for n in os.listdir(base) if n.startswith("v=")]) == 2    # the loser's folder is gone


def test_attempts_that_were_never_committed_are_removed_and_never_read(spark, tmp, monkeypatch):
    base = os.path.join(tmp, "live")
    S.publish_version(_one(spark, 1), base, "b1")

    def crash(*_):
        raise OSError("lost before the commit")

    monkeypatch.setattr(S, "put_once", crash)
    for _ in range(5):
        with pytest.raises(OSError):
            S.publish_version(_one(spark, 2), base, "b2")
    monkeypatch.undo()
    assert [r["x"] for r in S.read_published(spark, base).collect()] == [1]
    S.publish_version(_one(spark, 2), base, "b2")
    assert len([n for n in os.listdir(base) if n.startswith("v=")]) == 2
    assert [r["x"] for r in S.read_published(spark, base).collect()] == [2]


def test_small_files_are_written_once(spark, tmp):
    path = f"{tmp}/log/7"
    assert S.put_once(spark, path, "a") and not S.put_once(spark, path, "b")
    assert S.read_small(spark, path) == "a" and [n for n in os.listdir(f"{tmp}/log") if not n.startswith(".")] == ["7"]


def test_partitioned_writes_have_few_files(spark, tmp):
    df = spark.range(0, 3000, numPartitions=4).selectExpr("id", "CAST(id % 30 AS STRING) AS day")
    S.write_partitioned(df, f"{tmp}/p", "day", files_per_value=2)
    for d in range(30):
        files = [f for f in os.listdir(f"{tmp}/p/day={d}") if f.endswith(".parquet")]
        assert 1 <= len(files) <= 2
    assert spark.read.parquet(f"{tmp}/p").count() == 3000


def test_a_large_date_is_written_by_many_tasks_and_small_ones_by_one(spark, tmp):
    df = spark.range(0, 6000, numPartitions=4).selectExpr(
        "id", "repeat('x', 100) AS text", "CASE WHEN id % 3 = 0 THEN 'big' WHEN id = 7 THEN NULL ELSE CAST(id % 40 AS STRING) END AS day")
    S.write_partitioned(df, f"{tmp}/p", "day", file_bytes=20_000)
    files = {d: len([f for f in os.listdir(f"{tmp}/p/{d}") if f.endswith(".parquet")]) for d in os.listdir(f"{tmp}/p") if "=" in d}
    assert files["day=big"] >= 9 and len(files) == 42                 # 216,000 bytes
    assert max(n for d, n in files.items() if d != "day=big") == 1
    assert spark.read.parquet(f"{tmp}/p").count() == 6000
    S.write_chunks([df.where("id < 100"), df.where("id >= 100")], f"{tmp}/q", "day")
    assert spark.read.parquet(f"{tmp}/q").count() == 6000
    S.write_partitioned(df.limit(0), f"{tmp}/empty", "day")


def test_normalize_and_preview(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "`Running Status` int, `Error Code` string")
    assert S.normalize_columns(df).columns == ["RUNNING_STATUS", "ERROR_CODE"]
    assert [r[0] for r in S.csv_preview(df, 1, ["Running Status"]).collect()] == [1]


def test_chunked_writes_and_batch_idempotence(spark, tmp):
    a = spark.createDataFrame([(1, "2024-01-01")], "x int, event_date string")
    b = spark.createDataFrame([(2, "2024-01-02")], "x int, event_date string")
    path = os.path.join(tmp, "chunks")
    S.write_chunks([a, b], path, "event_date")
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [1, 2]
    hist = os.path.join(tmp, "hist")
    S.insert_batch(a, hist, 0)
    S.insert_batch(b, hist, 1)
    S.insert_batch(b, hist, 1)                               # replay: no duplicates
    assert sorted(r["x"] for r in spark.read.parquet(hist).collect()) == [1, 2]


def test_publish_versions(spark, tmp):
    base = os.path.join(tmp, "live")
    v1 = S.publish_version(spark.createDataFrame([(1,)], "x int"), base)
    reader = S.read_published(spark, base)                   # a reader holding version 1
    S.publish_version(spark.createDataFrame([(2,), (3,)], "x int"), base)
    assert reader.count() == 1                               # old version still readable
    assert S.read_published(spark, base).count() == 2
    assert S.current_version(spark, base) != v1


def test_catalog_table_and_namespaces(spark):
    cat = S.catalog_table(spark)
    fk = cat.where("Table_Name = 'fact_sensor' AND Column_Name = 'Machine'").first()
    assert fk["Key_Role"] == "FK" and fk["References"] == "dim_machine.Machine"
    assert cat.where("Key_Role = 'PK'").count() == 12
    S.create_namespaces(spark)
    assert {"bronze", "silver", "gold"} <= {d.name for d in spark.catalog.listDatabases()}


def test_jdbc_replace_requests_truncate(spark, monkeypatch):
    seen = {}

    class FakeWriter:
        def mode(self, m):
            seen["mode"] = m
            return self

        def jdbc(self, url, table, properties=None):
            seen.update(url=url, table=table, props=properties)

    class FakeDF:
        write = FakeWriter()

    S.jdbc_replace(FakeDF(), "jdbc:postgresql://db/x", "fact_sensor_live", {"user": "u"})
    assert seen["mode"] == "overwrite" and seen["props"]["truncate"] == "true"
    assert seen["props"]["batchsize"] == "10000" and seen["props"]["user"] == "u"


def test_routing_uses_the_etl_file_names(spark, tmp):
    src = os.path.join(tmp, "out")
    os.makedirs(src)
    write(src, "fact_sensor_historical.csv", SENSOR_CSV)     # name the upload dialog looked for (H5)
    write(src, "dim_factory.csv", "Factory,Type,Location\nPlant A,Motor,Tokyo\n")
    assert sorted(S.route_files(spark, src).values()) == ["dim_factory"]
