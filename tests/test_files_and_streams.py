"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from airgrid import schemas
from airgrid.operators import masking, regions, temporal
from airgrid.sources import grids, sinks, stations
from airgrid.streaming import incremental


def test_nan_is_null_past_the_reader(spark, tmp_path):
    spark.sql("SELECT 1 AS k, double('NaN') AS v UNION ALL SELECT 1, 2.0D").write.parquet(str(tmp_path / "g"))
    got = grids.scan_grid(spark, str(tmp_path / "g"))
    assert got.agg(F.avg("v")).first()[0] == 2.0 and got.filter("v IS NULL").count() == 1
    assert grids.scan_grid(spark, str(tmp_path / "g"), where=F.col("v") > 1).count() == 1  # NaN is above everything in Spark


def test_preamble_is_skipped_by_position_in_every_file(spark, tmp_path):
    titles = ",".join(c.split("`")[1] for c in schemas.PHOTOMETER_CSV.split(", "))
    row = "{site},25.5,-100.25,02:03:2021,10:00:0{n},0.{n},1.1\n"
    for site in ("A", "B"):
        lines = ["Version 3\n", f"{site}\n", row.format(site="looks-like-data", n=9), "d\n", "e\n", titles + "\n"]
        text = "".join(lines) + "".join(row.format(site=site, n=n) for n in range(1, 5))
        (tmp_path / f"site_{site}.txt").write_bytes(text.encode() + b"caf\xe9,1,2,02:03:2021,10:00:00,0.5,1.1\n")
    got = stations.scan_photometer(spark, [str(tmp_path / "site_A.txt"), str(tmp_path / "site_B.txt")]).collect()
    assert len(got) == 10
    assert sorted({r["site"] for r in got}) == ["A", "B", "caf�"]
    assert {r["t"].day for r in got} == {2}


def test_monitor_files_and_rejects(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Date Local,Latitude,Longitude,Arithmetic Mean,Local Site Name,State Name,POC\n"
                                    "2020-01-01,40.5,-96.2,7.5,Alpha,Nebraska,1\nnot-a-day,x,y,z,,,\n")
    (tmp_path / ".hidden.csv").write_text("junk\n")
    good, bad = stations.scan_csv_with_rejects(spark, str(tmp_path), schemas.MONITOR_CSV)
    assert [r["Arithmetic Mean"] for r in good.collect()] == [7.5]
    assert bad.count() == 1 and bad.first()["_bad"].startswith("not-a-day")
    named = stations.scan_monitors(spark, str(tmp_path / "m.csv")).filter("value IS NOT NULL")
    assert named.first()["site_name"] == "Alpha"


def test_regions_from_collections_and_lines(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 0]]
    feature = {"type": "Feature", "properties": {"name": "tri"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=1))
    (tmp_path / "l.geojson").write_text(json.dumps(feature) + "\n")
    both = stations.load_regions(spark, str(tmp_path / "c.geojson"))
    assert both.count() == 2
    line = regions.with_bounds(stations.load_regions(spark, str(tmp_path / "l.geojson"), lines=True)).first()
    assert (line["name"], line["minx"], line["maxy"]) == ("tri", 0.0, 2.0)


def test_payload(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"Header": [], "Data": [{"site": "a", "v": 1.5}, {"site": "b", "v": None}]}, indent=1))
    got = stations.explode_payload(spark, str(tmp_path / "p.json"), "site: string, v: double").collect()
    assert [(r["site"], r["v"]) for r in got] == [("a", 1.5), ("b", None)]


def test_only_written_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "grid")
    days = spark.sql("SELECT explode(sequence(date'2024-01-30', date'2024-02-02')) AS time, 0 AS y, 0 AS x, 1.0D AS AOD")
    sinks.write_grid(days, path)
    sinks.write_grid(days.filter("time = date'2024-02-01'").withColumn("AOD", F.lit(5.0)), path)
    back = grids.scan_grid(spark, path)
    assert back.count() == 4 and back.filter("AOD = 5").count() == 1
    pruned = grids.scan_days(spark, path, "2024-01-31", "2024-02-01")
    assert pruned.count() == 2
    assert "PartitionFilters: [" in pruned._jdf.queryExecution().executedPlan().toString()
    wanted = spark.sql("SELECT explode(sequence(date'2024-02-01', date'2024-02-04')) AS time")
    assert {r["time"].day for r in sinks.pending(wanted, back, ["time"]).collect()} == {3, 4}
    sinks.rewrite_partitions(spark.read.parquet(path).filter("doy = 32").withColumn("AOD", F.lit(7.0)), path, ["year", "doy"])
    assert sorted(r["AOD"] for r in spark.read.parquet(path).collect()) == [1.0, 1.0, 1.0, 7.0]


def test_metadata_travels(tables):
    described = masking.attach_metadata(tables.daily_grid, {"AOD": {"units": "1"}})
    onward = described.filter("AOD > 0").select("time", "AOD")
    assert onward.schema["AOD"].metadata == {"units": "1"}
    assert masking.copy_metadata(tables.daily_grid.select("AOD"), [described]).schema["AOD"].metadata == {"units": "1"}


def test_union_fills_missing_variables(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, AE1 double")
    assert [r["AE1"] for r in temporal.union_all([a, a.drop("AE1")]).collect()] == [2.0, None]


def hour_files(tables, path, hours):
    for k, (low, high) in enumerate(hours):
        (tables.snapshots.filter((F.col("t") >= low) & (F.col("t") < high)).coalesce(1)
         .write.mode("append").parquet(str(path)))


def test_stream_equals_batch_over_several_runs(spark, tables, tmp_path):
    src, out, check = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "check")
    parts = [("2024-01-01", "2024-01-06"), ("2024-01-06", "2024-01-12")]
    for part in parts:
        hour_files(tables, src, [part])
        hours = incremental.hourly_stream(incremental.snapshot_stream(spark, str(src)))
        incremental.run_to_table(hours, out, check)
    streamed = spark.read.parquet(out)
    seen = tables.snapshots.filter("t < '2024-01-12'")
    last = seen.agg(F.max("t")).first()[0]
    batch = temporal.hourly_average(masking.quality_mask(seen)).filter(
        F.col("t") + F.expr("INTERVAL 1 HOUR") <= F.lit(last) - F.expr("INTERVAL 2 HOURS"))
    a = {(str(r["t"]), r["y"], r["x"]): (r["AOD"], r["n_snapshots"]) for r in streamed.collect()}
    b = {(str(r["t"]), r["y"], r["x"]): (r["AOD"], r["n_snapshots"]) for r in batch.collect()}
    assert streamed.count() == len(a) and a.keys() == b.keys()
    for k in a:
        assert a[k][1] == b[k][1] and (a[k][0] is None or a[k][0] == pytest.approx(b[k][0]))


def test_late_and_damaged_rows_are_rejected(spark, tables, tmp_path):
    src = tmp_path / "src"
    accepted, rejects, check = str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "check")

    def run(rows):
        rows.coalesce(1).write.mode("append").parquet(str(src))
        incremental.split_late(spark, incremental.snapshot_stream(spark, str(src)), accepted, rejects, check)

    base = tables.snapshots
    run(base.filter("t >= '2024-01-05' AND t < '2024-01-06'"))
    late = base.filter("t >= '2024-01-02' AND t < '2024-01-03'")
    new = base.filter("t >= '2024-01-06' AND t < '2024-01-07'")
    damaged = base.filter("event_id = 0").withColumn("t", F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"))
    run(late.unionByName(new).unionByName(damaged))
    reasons = {r["reason"]: r["count"] for r in spark.read.parquet(rejects).groupBy("reason").count().collect()}
    assert reasons == {"late": late.count(), "bad_time": 1}
    assert spark.read.parquet(accepted).count() == base.filter("t >= '2024-01-05' AND t < '2024-01-07'").count()


def test_daily_table_follows_the_hourly_table(spark, tables, tmp_path):
    hourly_path, daily_path, check = (str(tmp_path / n) for n in ("hourly", "daily", "check"))
    schema = "t timestamp, y int, x int, AOD double, AOD470 double, n_snapshots bigint, day date"
    hours = temporal.hourly_average(masking.quality_mask(tables.snapshots)).withColumns(
        {"t": F.col("t").cast("timestamp"), "day": F.to_date("t")})
    middle = F.lit("2024-01-03 12:00:00").cast("timestamp")
    for part in (hours.filter(F.col("t") < middle), hours.filter((F.col("t") >= middle) & (F.col("day") < "2024-01-06"))):
        part.write.mode("append").partitionBy("day").parquet(hourly_path)
        incremental.daily_from_hourly(spark, hourly_path, schema, daily_path, check)
    got = {(str(r["time"]), r["y"], r["x"]): r["AOD"] for r in spark.read.parquet(daily_path).collect()}
    want = {(str(r["time"]), r["y"], r["x"]): r["AOD"]
            for r in temporal.daily_weighted_average(hours.filter("day < '2024-01-06'")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is None or got[k] == pytest.approx(want[k]) for k in got)
