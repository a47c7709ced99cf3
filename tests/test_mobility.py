"""The mobility warehouse from its published file formats, made-up releases, and the command line."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewright import __main__ as cli
from tidewright.plans import experiments, generate, mobility, ops, products
from tidewright.sources.snapshot import SnapshotTable
from tidewright.specs import Period

PERIOD = Period("2024-01-01 00:00:00", "2024-03-01 00:00:00")


def source(spark, folder):
    for d in ("trips", "zones", "weather", "air_quality"):
        (folder / d).mkdir(parents=True)
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(1, t + dt.timedelta(hours=i), t + dt.timedelta(hours=i, minutes=10), 1, 2.0 + i, 1, "N", 1 + i % 2, 3 if i == 5 else 2, 1, 10.0, *[0.0] * 5, 12.0, 0.0, 0.0) for i in range(6)]
    spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in mobility.columns(mobility.TRIPS).items())).coalesce(1).write.parquet(str(folder / "x"))
    next((folder / "x").glob("*.parquet")).rename(folder / "trips/t.parquet")
    (folder / "zones/z.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Bronx,North,Boro\n2,Queens,East,Boro\n")
    w = list(mobility.columns(mobility.WEATHER))
    (folder / "weather/w.csv").write_text(",".join(w) + "\n" + "\n".join(",".join({"year": "2024", "month": "1", "day": "1", "hour": str(h), "temp": "1.5", "coco": "1"}.get(c, "") for c in w) for h in (10, 11)) + "\n")
    a = list(mobility.columns(mobility.AIR))
    values = {"State Code": "36", "State Name": "New York", "County Name": "Kings", "County Code": "047", "Site Num": "1", "Parameter Code": "88101", "POC": "1", "Date Local": "2024-01-01", "Time Local": "0 days 10:00:00", "Sample Measurement": "4.0", "Units of Measure": "Micrograms/cubic meter (LC)"}
    (folder / "air_quality/a.csv").write_text(",".join(a) + "\n" + ",".join(values.get(c, "") for c in a) + "\n")


def test_warehouse_and_release(spark, tmp_path, capsys):
    source(spark, tmp_path / "in")
    m = mobility.warehouse(spark, str(tmp_path / "w"), str(tmp_path / "in"), [PERIOD])
    assert m.run() == 6 + 2 + 2 + 1
    fact = m.w.table("integrated", "trips").read()
    assert fact.count() == 5 and m.w.table("rejected/reference", "trips").read().count() == 1  # one dropoff zone does not exist
    assert fact.where("weather_available").count() == 2 and fact.where("air_quality_available").count() == 1

    specs = m.w.specs
    raw = spark.read.parquet(str(tmp_path / "in/trips"))
    later = raw.withColumns({c: F.col(c) + F.expr("interval 1 day") for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")}).where("DOLocationID <> 3")
    later = generate.with_fault(later, "tpep_pickup_datetime", {"trip_distance": F.lit(600.0)})
    weather = spark.read.option("header", "true").csv(str(tmp_path / "in/weather")).limit(1).withColumns({"day": F.lit("2"), "humidity": F.lit("40")})
    manifest = generate.export({"trips": (later, 1), "weather": (weather, 2)}, specs, str(tmp_path / "r2"), "r2")
    assert m.w.apply(manifest)["done"]["raw/trips"]["novel"] == 6
    now = m.w.table("integrated", "trips").read()
    assert now.count() == 5 + 5 and now.where("pickup_date = '2024-01-02' and weather_available").count() == 1
    assert m.w.table("rejected/cleaning", "trips").read().count() == 1
    daily = m.w.table("product", "daily_mobility").read()
    assert {r["pickup_date"].day: r["trip_count"] for r in daily.collect()} == {1: 5, 2: 5}
    assert set(daily.where("pickup_date = '2024-01-02'").first()["weather_schema_versions"]) == {2}

    base = ["--root", str(tmp_path / "w"), "--source", str(tmp_path / "in"), "--period", PERIOD.start, PERIOD.end]
    cli.main(["all", *base])
    cli.main(["queries", *base, "--query", "peak_hour_by_weekday"])
    cli.main(["report", *base])
    cli.main(["view", *base, "--table", "normal/zones"])
    cli.main(["storage", *base])
    out = capsys.readouterr().out
    assert "Monday" in out and "report.html" in out and "North" in out and '"integrated"' in out

    keep = [c for c in daily.columns if not c.startswith("_")]
    got = experiments.product_benchmark(spark, {"daily_mobility": lambda: products.daily_mobility(now).select(keep)}, {"daily_mobility": lambda: daily}, 1)
    assert got[0]["equal"]
    e = experiments.evaluation(lambda: None, {"x": lambda: None}, lambda: None, lambda: None, lambda: None, str(tmp_path / "w"), 1)
    assert json.dumps(e) and e["storage"]["raw"]["files"]


def test_generators(spark, tmp_path):
    df = spark.range(500).withColumn("k", F.concat(F.lit("k"), "id"))
    seq = generate.numbered(df, "k")
    assert sorted(r["sequence"] for r in seq.collect()) == list(range(500))
    assert {r["k"]: r["sequence"] for r in seq.collect()} == {r["k"]: r["sequence"] for r in generate.numbered(df.repartition(7), "k").collect()}
    a = generate.sample(df.union(df), "k", 20, 3)
    assert a.count() == 20 == a.intersect(generate.sample(df, "k", 20, 3)).count()
    assert generate.station_hours(spark, df.limit(3), "2024-01-01 00:00:00", 5).count() == 15
    aqi = spark.createDataFrame([(0.0,), (10.0,), (1e6,)], "p double").select(generate.made_up_aqi("p").alias("a"))
    assert [r["a"] for r in aqi.collect()] == [0.0, 40.0, 500.0]
    t = SnapshotTable(spark, str(tmp_path / "events"))
    c = mobility.datasets("x", [PERIOD])["weather"].contracts
    ops.record_schema_change(t, spark, "weather", c[1], c[2])
    ops.record_schema_change(t, spark, "weather", c[1], c[2])
    assert [r["change_type"] for r in t.read().collect()] == ["ADD"]
