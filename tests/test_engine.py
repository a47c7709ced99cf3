"""Operators, tables, streams and plans on hand-made rows."""

import datetime as dt
import json
import math

import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.operators import cleaners, diff, enrich, keys, rollups, rules
from tidewright.plans import analytics, experiments, medallion, ml, ops, products, release, report
from tidewright.sources import contracts, files
from tidewright.sources.snapshot import CommitConflict, SnapshotTable
from tidewright.specs import ContractError, DatasetSpec, Period, Reference, SchemaContract

NTZ = "timestamp_ntz"


def ts(text):
    return dt.datetime.fromisoformat(text)


# --- contracts and files


def test_contract_declares_accepted_types():
    with pytest.raises(ContractError):
        SchemaContract(1, "csv", {"a": "decimal(3,1)"})
    with pytest.raises(ContractError):
        SchemaContract(1, "csv", {"a": "int"}, options={"inferSchema": "true"})
    a, b = SchemaContract(1, "csv", {"a": "int"}), SchemaContract(2, "csv", {"a": "int", "b": "double"})
    assert a.diff(b) == {"added": ["b"], "removed": [], "retyped": []}
    assert ops.schema_event("d", a, b)["compatible"]
    assert ops.schema_event("d", a, b)["event_id"] == ops.schema_event("d", a, b)["event_id"]


def test_contract_checks(spark):
    c = SchemaContract(1, "parquet", {"id": "int"})
    with pytest.raises(ContractError) as e:
        contracts.check_columns(["id", "extra"], c)
    assert e.value.details == {"change_type": "UNSUPPORTED_COLUMNS", "missing": [], "unexpected": ["extra"]}
    with pytest.raises(ContractError) as e:
        contracts.check_types(spark.createDataFrame([("1",)], "id string"), c)
    assert e.value.details["change_type"] == "UNSUPPORTED_TYPE_CHANGE"


def test_strict_cast(spark):
    c = SchemaContract(1, "csv", {"id": "int", "amount": "double", "day": "date", "note": "string"})
    df = spark.createDataFrame([("1", "2.5", "2024-01-01", "a"), ("bad", "", "2024-01-02", "b"), ("3", "  ", "x", "c")], "id string, amount string, day string, note string")
    good, bad = contracts.strict_cast(df, c)
    assert [tuple(r) for r in good.collect()] == [(1, 2.5, dt.date(2024, 1, 1), "a")]
    assert {r["note"]: r["rejected_reasons"] for r in bad.collect()} == {"b": ["id: expected int"], "c": ["day: expected date"]}


def test_names_and_hashes(spark):
    assert contracts.safe_names(["VendorID", "Airport fee", "airport_fee", "_x"], {"VendorID": "vendor"}) == ["vendor", "airport_fee", "airport_fee_2", "_x"]
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(C.text_hash(["x", "y", "z"])).distinct().count() == 1
    assert df.select(C.content_hash(["x", "y", "z"])).distinct().count() == 2


def test_read_files_and_lineage(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    (tmp_path / "b.csv").write_text("v,id\n5,4\n")
    c = SchemaContract(1, "csv", {"id": "int", "v": "int"})
    df = contracts.read_files(spark, files.discover(str(tmp_path), "csv"), c)
    good, _ = contracts.strict_cast(df, c)
    out = contracts.with_lineage(good, "d", 1, "run")
    assert sorted((r["id"], r["v"], r["_source_file"][-5:]) for r in out.collect()) == [(1, 2, "a.csv"), (4, 5, "b.csv")]
    assert out.columns == ["id", "v", *contracts.LINEAGE]


def test_registry(tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("x")
    r = files.Registry(str(tmp_path / "r.json"))
    r.record(r.pending([str(f)]))
    r = files.Registry(str(tmp_path / "r.json"))
    assert not r.pending([str(f)])
    f.write_text("yy")
    assert len(r.pending([str(f)])) == 1
    with pytest.raises(FileNotFoundError):
        files.discover(str(tmp_path / "none"), "csv")
    assert files.discover(str(tmp_path / "*.csv"), "csv") == [str(f)]


def test_narrowing(spark):
    df = spark.createDataFrame([(60.0, 1)], "rhum double, id int")
    out = contracts.narrowed(df, {"rhum": "int", "id": "int"}).first()
    assert out["rhum"] == 60 and json.loads(out["_source_payload"])["rhum"] == 60.0
    with pytest.raises(ValueError, match="rhum"):
        contracts.narrowed(spark.createDataFrame([(60.5, 1)], "rhum double, id int"), {"rhum": "int"})


# --- rules and keys


def test_rules(spark):
    df = spark.createDataFrame([(None, 5.0), ("b", -1.0), ("c", None), ("d", math.nan)], "record_id string, amount double")
    good, bad = rules.classify(df, [rules.required("record_id"), rules.at_least("amount", 0), rules.between("amount", 0, 100)])
    assert [r[0] for r in good.collect()] == ["c"]
    got = {r["record_id"]: r["rejected_rules"] for r in bad.collect()}
    assert got == {None: ["required.record_id"], "b": ["minimum.amount", "range.amount"], "d": ["range.amount"]}
    assert rules.rejection_metrics(bad).first().asDict() == {"rejected_records": 3, "rule_failures": 4}
    assert {r["rule_id"]: r["failed_records"] for r in rules.rule_summary(bad, "d").collect()}["range.amount"] == 2
    assert rules.from_message("Some Text!", lambda: F.lit(True)).rule_id == "some.text"
    assert [r.rule_id for r in rules.registered("d", {"*": [rules.required("a")], "d": [rules.required("b")]})] == ["required.a", "required.b"]


def test_references(spark):
    t = spark.createDataFrame([("a", 1, 1), ("b", 1, 9), ("c", 8, 9), ("d", None, 1)], "trip string, p int, q int")
    z = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    good, bad = rules.check_references(t, [(Reference("r.p", "p", "id", "p"), z), (Reference("r.q", "q", "id", "q"), z)])
    assert sorted(r[0] for r in good.collect()) == ["a", "d"]
    assert {r["trip"]: r["rejected_rules"] for r in bad.collect()} == {"b": ["r.q"], "c": ["r.p", "r.q"]}


def test_key_check(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "id int, v string")
    assert rules.key_report(df, ["id", "v"]).first().asDict() == {"null_key_rows": 2, "duplicate_keys": 1}
    with pytest.raises(ValueError):
        rules.require_key(df, ["id"])


def weather_rows(spark, rows):
    return spark.createDataFrame(rows, "year int, month int, day int, hour int, temp double, _schema_version int, _ingestion_timestamp timestamp, _record_hash string")


def test_novelty(spark):
    old = weather_rows(spark, [(2024, 1, 1, 0, 1.0, 1, ts("2024-01-01"), "x")])
    k = ["year", "month", "day", "hour"]

    def novel(rows, stored=old):
        good, bad = keys.split_novel(weather_rows(spark, rows), stored, k)
        return [r["temp"] for r in good.collect()], sorted(x for r in bad.collect() for x in r["rejected_rules"])

    assert novel([(2024, 1, 1, 0, 1.0, 1, ts("2024-02-01"), "y")]) == ([], ["duplicate.existing_record"])
    assert novel([(2024, 1, 1, 0, 2.0, 1, ts("2024-02-01"), "y")]) == ([2.0], [])
    two = [(2024, 1, 1, 0, 2.0, 1, ts("2024-02-01"), "y"), (2024, 1, 1, 0, 3.0, 1, ts("2024-02-01"), "z")]
    assert novel(two) == ([], ["duplicate.conflicting_revision"] * 2)
    assert novel(two[:1] * 2) == ([2.0], ["duplicate.exact_record"])
    corrected = old.unionByName(weather_rows(spark, two[:1]))
    assert novel([(2024, 1, 1, 0, 1.0, 1, ts("2024-03-01"), "x")], corrected) == ([1.0], [])  # a return is novel


# --- columns


def test_columns(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Stockholm")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:10' AS t")
        assert df.select(C.hour_of("t").alias("h")).first()["h"] == ts("2024-03-31 02:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    clocks = spark.createDataFrame([(dt.date(2024, 1, 1), x) for x in ("0 days 02:00:00", "02:00", "9:05", "25:00", "noon", None)], "d date, t string")
    assert [r[0] for r in clocks.select(C.clock("d", "t")).collect()] == ["02:00:00", "02:00:00", "09:05:00", "25:00", "noon", None]
    b = spark.createDataFrame([(9.0,), (9.1,), (300.0,), (None,)], "v double").select(C.bands("v", C.PM25_BANDS, C.PM25_BEYOND))
    assert [r[0] for r in b.collect()] == ["good", "moderate", "hazardous", None]
    lab = spark.createDataFrame([(1,), (99,), (None,)], "c int").select(C.labelled("c", C.CONDITION_LABELS))
    assert [r[0] for r in lab.collect()] == ["Clear", "Unknown (99)", None]
    assert spark.range(3).where(C.in_periods(F.lit(ts("2024-01-01")).cast(NTZ), [])).count() == 0


def test_time_range_prunes_partitions(spark, tmp_path):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-06-01 00:00:00', interval 1 day)) AS t").selectExpr("t", "year(t) AS y", "month(t) AS m")
    df.write.partitionBy("y", "m").parquet(str(tmp_path / "p"))
    got = C.time_range(spark.read.parquet(str(tmp_path / "p")), "t", "2024-02-10 00:00:00", "2024-03-02 00:00:00", "y", "m")
    assert got.count() == 21
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and len(got.inputFiles()) == len(spark.read.parquet(str(tmp_path / "p")).inputFiles())


# --- differences


def test_changed_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "id int, v string")
    assert sorted((r["id"] or 0, r["v"]) for r in diff.changed_rows(new, old, ["id"]).collect()) == [(0, "n"), (2, "b"), (3, None)]


def test_table_diff(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", math.nan), ("z", None), ("w", 1.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12), ("y", math.nan), ("z", 0.0), ("v", 1.0)], "k string, v double")
    assert {r["k"]: r["difference"] for r in diff.table_diff(a, b, ["k"]).collect()} == {"z": "v", "w": "only_left", "v": "only_right"}
    assert diff.same_bag(a, a) and not diff.same_bag(a, a.union(a.limit(1)))


def test_snapshot_comparison():
    s = experiments.Snapshot.of
    assert s(["v"], [(1.0,), (1.0,), (2.0,)]).matches(s(["v"], [(2.0,), (1.0,), (1.0,)]))
    assert not s(["v"], [(1.0,), (1.0,)]).matches(s(["v"], [(1.0,), (2.0,)]))
    assert s(["v"], [(0.0,), (0.9,)]).matches(s(["v"], [(0.5,), (-0.5,)]), 0.5)  # the first fit would pair 0 with 0.5
    assert s(["v"], [(math.nan,)]).matches(s(["v"], [(math.nan,)])) and not s(["v"], [(math.inf,)]).matches(s(["v"], [(1.0,)]))


# --- tables


def test_snapshot_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, value string")
    assert t.merge(df, ["id"], txn="x") == 0
    assert t.merge(df, ["id"], txn="x") is None
    new = spark.createDataFrame([(2, "c", 1.0), (3, "d", 2.0)], "id int, value string, humidity double")
    assert t.merge(new, ["id"]) == 1
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a", None), (2, "c", 1.0), (3, "d", 2.0)]
    assert t.read(0).count() == 2 and t.info().rows == 3
    t.merge(spark.createDataFrame([(3, "z"), (4, "e")], "id int, value string"), ["id"], update=False)
    assert {r["id"]: r["value"] for r in t.read().collect()} == {1: "a", 2: "c", 3: "d", 4: "e"}
    assert [v.operation for v in t.history()] == ["merge"] * 3
    stale = t.info()
    t.append(df)
    with pytest.raises(CommitConflict):
        t._commit("append", list(stale.folders), df, None, stale)
    t.vacuum()
    assert t.read().count() == 6 and t.versions() == [3]


def test_replace_where(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ("month",))
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (2, "b", 7)], "month int, category string, n int")
    t.overwrite(rows)
    t.replace_where(spark.createDataFrame([(2, "a", 60)], rows.schema), "month = 2")
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a", 5), (2, "a", 60)]
    t.replace_where(rows.limit(0), "month = 2")
    assert [tuple(r) for r in t.read().collect()] == [(1, "a", 5)]


# --- cleaners, integration, products


def lineage(i, when="2024-05-01"):
    return (1, ts(when), str(i))


LINEAGE = "_schema_version int, _ingestion_timestamp timestamp, _record_hash string"


def test_clean_trips(spark):
    rows = [
        (ts("2024-01-01 10:00"), ts("2024-01-01 10:10"), 1, 2, 1.0, 10.0, 12.0, *lineage("ok")),
        (ts("2024-01-01 10:00"), ts("2024-01-01 10:10"), 1, 2, 1.0, -10.0, -12.0, *lineage("adjustment")),
        (ts("2024-01-01 10:00"), ts("2024-01-01 10:10"), 1, 2, 600.0, 10.0, 12.0, *lineage("far")),
        (ts("2024-01-01 10:00"), ts("2024-01-01 10:00"), 1, 2, 1.0, 10.0, 12.0, *lineage("zero")),
        (ts("2025-01-01 10:00"), ts("2025-01-01 10:10"), 1, 2, 1.0, 10.0, 12.0, *lineage("late")),
        (None, ts("2024-01-01 10:00"), 1, 2, math.nan, 10.0, 12.0, *lineage("none")),
    ]
    raw = spark.createDataFrame(rows, f"pickup_timestamp {NTZ}, dropoff_timestamp {NTZ}, pickup_location_id int, dropoff_location_id int, trip_distance double, fare_amount double, total_amount double, {LINEAGE}")
    good, bad = cleaners.trips(raw, [Period("2024-01-01 00:00:00", "2024-02-01 00:00:00")])
    assert {r["trip_id"]: r["is_financial_adjustment"] for r in good.collect()} == {"ok": False, "adjustment": True}
    assert {r["_record_hash"]: r["rejected_rules"] for r in bad.collect()} == {"far": ["range.trip_distance"], "zero": ["duration.range"], "late": ["pickup.period"], "none": ["required.pickup_timestamp", "range.trip_distance"]}


def test_clean_weather_and_air(spark):
    raw = spark.createDataFrame([(2024, 1, 1, 3, "1.5", "50", "", 5, *lineage(1)), (2024, 1, 1, 3, "2.5", "50", "", 5, 2, ts("2024-06-01"), "2"), (2024, 13, 1, 3, "1", "50", "", 5, *lineage(3)), (2024, 1, 1, 4, "1", "150", "", 5, *lineage(4))], f"year int, month int, day int, hour int, temp string, rhum string, snwd string, coco int, {LINEAGE}")
    good, bad = cleaners.weather(raw)
    r = good.first()
    assert good.count() == 1 and (r["event_hour"], r["temperature_c"], r["snow_depth_mm"]) == (ts("2024-01-01 03:00"), 2.5, None)
    assert sorted(x for r in bad.collect() for x in r["rejected_rules"]) == ["range.relative_humidity_pct", "timestamp.valid"]
    air = spark.createDataFrame([("36", "New York", c, cc, "1", "88101", 1, dt.date(2024, 1, 1), "0 days 02:00:00", v, cleaners.UNIT, ver, ts("2024-05-01"), h) for c, cc, v, ver, h in [("Kings", "047", 4.0, 1, "a"), ("Queens", "081", 8.0, 2, "b"), ("Albany", "001", 99.0, 1, "c")]], f"state_code string, state_name string, county_name string, county_code string, site_num string, parameter_code string, poc int, date_local date, time_local string, sample_measurement double, units_of_measure string, {LINEAGE}")
    good, _ = cleaners.air_quality(air)
    r = good.first()
    assert (r["event_hour"], r["pm25_avg_ug_m3"], r["air_quality_observation_count"], r["air_quality_site_count"], r["source_schema_versions"]) == (ts("2024-01-01 02:00"), 6.0, 2, 2, [1, 2])


def fact(spark):
    rows = []
    for i, (day, hour, zone, code, pm) in enumerate([(1, 10, "A", 1, 8.0), (1, 10, "A", 1, 40.0), (1, 9, "B", 2, 8.0), (33, 8, "A", None, 200.0)]):
        t = dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day - 1)
        rows.append((f"t{i}", t, t.date(), t.year, t.month, t, i % 2 + 1, 2.0 + i, 600, 10.0, 12.0, ord(zone), zone, "Bronx", code, pm, 1 + i % 2, 1, 1, 1, [1, 2] if i else [1]))
    return spark.createDataFrame(rows, f"trip_id string, pickup_timestamp {NTZ}, pickup_date date, pickup_year int, pickup_month int, pickup_hour {NTZ}, passenger_count int, trip_distance double, trip_duration_seconds int, fare_amount double, total_amount double, pickup_location_id int, pickup_zone string, pickup_borough string, weather_condition_code int, pm25_avg_ug_m3 double, taxi_schema_version int, pickup_zone_schema_version int, dropoff_zone_schema_version int, weather_schema_version int, air_quality_schema_versions array<int>")


def test_products(spark, tmp_path):
    source, catalog = SnapshotTable(spark, str(tmp_path / "fact")), SnapshotTable(spark, str(tmp_path / "catalog"))
    source.overwrite(fact(spark))
    tables = {n: SnapshotTable(spark, str(tmp_path / n)) for n in products.PRODUCTS}
    for n, spec in products.PRODUCTS.items():
        products.build(spec, source, tables[n], catalog)
    day = {r["pickup_date"].day: r for r in tables["daily_mobility"].read().collect()}[1]
    assert (day["trip_count"], day["passenger_count"], day["peak_hour"], day["peak_hour_trips"], day["taxi_schema_versions"]) == (3, 4, 10, 2, [1, 2])
    assert {(r["pickup_month"], r["pm25_category"]): r["trip_count"] for r in tables["air_quality_impact"].read().collect()} == {(1, "good"): 2, (1, "unhealthy_sensitive"): 1, (2, "very_unhealthy"): 1}
    assert catalog.read().count() == 4
    later = source.read().withColumn("fare_amount", F.when(F.col("pickup_month") == 2, 99.0).otherwise(F.col("fare_amount")))
    moved = products.affected_products(source.read(), later, "trip_id", products.PRODUCTS.values())
    assert set(moved) == set(products.PRODUCTS) and moved["daily_mobility"].count() == 2
    source.overwrite(later)
    for n, rows in moved.items():
        products.build(products.PRODUCTS[n], source, tables[n], catalog, changed=rows)
    plain = [c for c in tables["daily_mobility"].read().columns if not c.startswith("_")]
    assert diff.same_bag(tables["daily_mobility"].read().select(plain), products.daily_mobility(later).select(plain))
    assert catalog.read().where("refresh_kind = 'scoped'").count() == 4
    page = report.write({n: t.read() for n, t in tables.items()}, str(tmp_path / "r" / "report.html"))
    text = open(page).read()
    assert "Mobility report" in text and text.count("<svg") == 4
    assert "<" not in report.embedded({"a": "</script>&"})


def test_analytics(spark):
    t = fact(spark)
    hours = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), 1 + h % 2, float(h)) for h in (8, 9, 10, 11)], f"event_hour {NTZ}, weather_condition_code int, pm25_avg_ug_m3 double")
    analytics.register(t, hours, hours, [Period("2024-01-01 00:00:00", "2024-01-02 00:00:00")])
    out = {n: analytics.run(spark, n).collect() for n in analytics.QUERIES}
    assert out["air_quality_demand_relationship"][0]["hours_analyzed"] == 3  # the hour before the first trip is cut
    trend = {r["month"].month: r["change"] for r in out["monthly_demand_trend"]}
    assert trend == {1: None, 2: -2}
    assert {r["weather_condition"] for r in out["avg_distance_by_weather"]} == {"Clear", "Fair"}
    assert [r["pickup_zone"] for r in out["zone_weather_variation"]]
    analytics.register(t, hours, hours)
    v = experiments.suite(spark, {"q": analytics.text("peak_hour_by_weekday")}, experiments.VARIANTS[:2], blocks=1)
    assert len(v) == 2 and all(r["equal"] for r in v) and v[0]["metrics"]
    assert experiments.hinted("SELECT a FROM trips", "trips").startswith("SELECT /*+ BROADCAST(trips) */")
    with pytest.raises(ValueError):
        experiments.rewritten("a a", {"a": "b"})
    assert experiments.candidates([{"query": "q", "variant": n, "block": b, "median": m, "equal": True} for b in range(3) for n, m in (("baseline", 1.0), ("aqe", 0.5), ("cache", 0.99))]) == {"q": "aqe"}


def test_layouts(spark, tmp_path):
    df = spark.createDataFrame([(i, 2024, 1 + i % 2, "A", dt.date(2024, 1, 1 + i % 3)) for i in range(30)], "l_orderkey long, y int, m int, borough string, pickup_date date")
    shapes = experiments.layouts(("y", "m"), "borough", "pickup_date", "l_orderkey")
    out = experiments.layout_benchmark(spark, df, str(tmp_path), {"n": lambda d: d.groupBy("borough").count()}, shapes, runs=1)
    assert {r["layout"] for r in out} == set(shapes) == set(experiments.layouts()) and all(r["files"] for r in out)
    wide = spark.createDataFrame([tuple(range(22))], ", ".join(f"{c} int" for c in [*experiments.BENCHMARK_COLUMNS, "other"]))
    assert len(experiments.benchmark_input(wide).columns) == 21
    with pytest.raises(ValueError, match="trip_id"):
        experiments.benchmark_input(wide.drop("trip_id"))


def test_experiment(spark, tmp_path):
    t = fact(spark)
    hours = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), 1 + h % 2, float(h)) for h in (9, 10)], f"event_hour {NTZ}, weather_condition_code int, pm25_avg_ug_m3 double")
    t.write.partitionBy("pickup_year", "pickup_month").parquet(str(tmp_path / "t"))
    analytics.register(spark.read.parquet(str(tmp_path / "t")), hours, hours)
    for name, hints in experiments.HINTS.items():
        plain, changed = spark.sql(analytics.text(name)), spark.sql(experiments.rewritten(analytics.text(name), hints))
        assert experiments.Snapshot.of(plain.columns, plain.collect()).matches(experiments.Snapshot.of(changed.columns, changed.collect()))
    pairs = experiments.pruning_pairs(analytics.text("monthly_zone_demand"), 2024, 1)
    out = experiments.experiment(spark, {"q": analytics.text("peak_hour_by_weekday")}, pairs, experiments.VARIANTS[:1] + experiments.VARIANTS[3:5], blocks=1)
    assert {r["variant"] for r in out["explored"]} == {"baseline", "aqe", "aqe_32"} and set(out["holds"]) == set(out["selected"])
    for p in out["pruning"]:
        assert p["pruned"]["equal"] and "pickup_month" in p["pruned"]["scans"][0]["PartitionFilters"] and p["plain"]["scans"][0]["Location"]


def test_pairs_within_the_tolerance():
    s = experiments.Snapshot.of
    a, b = s("kxy", [("a", 1.0, 5.0), ("a", 1.0 + 9e-10, 5.0 - 9e-10), ("a", float("nan"), 2.0)]), s("kxy", [("a", 1.0 + 1e-9, 5.0 - 1e-9), ("a", float("nan"), 2.0), ("a", 1.0, 5.0)])
    assert a.matches(b) and not a.matches(s("kxy", [("a", 1.0, 5.0), ("a", 1.0, 5.1), ("a", float("nan"), 2.0)]))
    for n in range(200):
        r = random.Random(n)
        rows = [("k", round(r.random() * 4) / 4, round(r.random() * 4) / 4) for _ in range(5)]
        moved = [(k, x + r.choice([-1, 0, 1]) * 1e-10, y + r.choice([-1, 0, 1]) * 1e-10) for k, x, y in r.sample(rows, 5)]
        assert s("kxy", rows).matches(s("kxy", moved)) and s("kx", [x[:2] for x in rows]).matches(s("kx", [x[:2] for x in moved]))


def test_workflows_and_workload(spark, tmp_path):
    rows = spark.range(20).withColumn("x", F.col("id") * 2)
    out = experiments.compare_workflows({"files": lambda: rows, "table": lambda: rows.select("x", "id")}, lambda df: df.count(), lambda df: df.count(), 1)
    assert set(out) == {"files", "table"} and all(v["total"] >= v["training"] for v in out.values())
    with pytest.raises(ValueError):
        experiments.compare_workflows({"files": lambda: rows, "table": lambda: rows.limit(3)}, lambda df: None, lambda df: None, 1)
    figures = experiments.workload(spark, str(tmp_path), 200, 20, 5, 1)
    assert set(figures["refresh_s"]) == {"by_day", "by_zone", "by_zone_day", "by_amount"} and figures["storage"]["product"]["files"]


def test_snapshot_scopes_and_compaction(spark, tmp_path):
    from tidewright.sources.snapshot import SnapshotTable

    t = SnapshotTable(spark, str(tmp_path / "t"))
    for k in range(4):
        t.append(spark.createDataFrame([(k, "a"), (k, "b")], "k int, v string"))
    before = t.info().folders
    t.replace_scopes(spark.createDataFrame([(2, "new")], "k int, v string"), spark.createDataFrame([(2,), (9,)], "k int"), ["k"])
    assert {(r.k, r.v) for r in t.read().collect()} == {(k, v) for k in (0, 1, 3) for v in "ab"} | {(2, "new")}
    assert len(set(before) & set(t.info().folders)) == 3
    assert t.read()._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # one reader, however many folders
    t.compact()
    assert len(t.info().folders) == 1 and t.read().count() == 7 and t.compact() is None


# --- releases, streams, pipeline


def specs(tmp_path):
    zone = SchemaContract(1, "csv", {"LocationID": "int", "Borough": "string", "Zone": "string", "service_zone": "string"}, {"LocationID": "location_id"})
    trip = SchemaContract(1, "csv", {"pickup_timestamp": NTZ, "dropoff_timestamp": NTZ, "pickup_location_id": "int", "dropoff_location_id": "int", "passenger_count": "int", "trip_distance": "double", "fare_amount": "double", "total_amount": "double"})
    weather = SchemaContract(1, "csv", {"year": "int", "month": "int", "day": "int", "hour": "int", "temp": "double", "coco": "int"})
    sensor = SchemaContract(1, "csv", {"state_code": "string", "state_name": "string", "county_name": "string", "county_code": "string", "site_num": "string", "parameter_code": "string", "poc": "int", "date_local": "date", "time_local": "string", "sample_measurement": "double", "units_of_measure": "string"})
    periods = [Period("2024-01-01 00:00:00", "2025-01-01 00:00:00")]
    k = ("year", "month", "day", "hour")
    return {
        "trips": DatasetSpec("trips", {1: trip}, 1, str(tmp_path / "in/trips*.csv"), ("_record_hash",), clean=lambda df: cleaners.trips(df, periods), conflicts=False),
        "zones": DatasetSpec("zones", {1: zone}, 1, str(tmp_path / "in/zones.csv"), ("location_id",), clean=cleaners.zones),
        "weather": DatasetSpec("weather", {1: weather}, 1, str(tmp_path / "in/weather.csv"), k, clean=cleaners.weather),
        "air": DatasetSpec("air", {1: sensor}, 1, str(tmp_path / "in/air.csv"), ("state_code", "county_code", "site_num", "parameter_code", "poc", "date_local", "time_local"), partitions=("date_local",), clean=cleaners.air_quality),
    }


def warehouse(spark, tmp_path, root="w"):
    def integrate(t):
        return cleaners.integrated(t["trips"], t["zones"], t["weather"], t["air"])

    keys_ = {"trips": ["trip_id"], "zones": ["location_id"], "weather": ["event_hour"], "air": ["event_hour"]}
    context = {"zones": {"pickup_location_id": "location_id", "dropoff_location_id": "location_id"}, "weather": {"pickup_hour": "event_hour"}, "air": {"pickup_hour": "event_hour"}}
    return release.Warehouse(spark, str(tmp_path / root), specs(tmp_path), "trips", integrate, keys_, context)


TRIPS = "pickup_timestamp,dropoff_timestamp,pickup_location_id,dropoff_location_id,passenger_count,trip_distance,fare_amount,total_amount\n"
AIR = "state_code,state_name,county_name,county_code,site_num,parameter_code,poc,date_local,time_local,sample_measurement,units_of_measure\n36,New York,Kings,047,1,88101,1,2024-01-01,10:00,4.0,Micrograms/cubic meter (LC)\n"


def first_files(folder):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "trips1.csv").write_text(TRIPS + "2024-01-01 10:05:00,2024-01-01 10:20:00,1,2,1,2.0,10,12\n2024-01-01 11:05:00,2024-01-01 11:20:00,2,1,1,3.0,20,22\n2024-01-01 11:05:00,x,2,1,1,3.0,20,22\n")
    (folder / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Bronx,North,Boro\n2,Queens,East,Boro\n")
    (folder / "weather.csv").write_text("year,month,day,hour,temp,coco\n2024,1,1,10,1.5,1\n")
    (folder / "air.csv").write_text(AIR)


def test_medallion_and_release(spark, tmp_path):
    first_files(tmp_path / "in")
    w = warehouse(spark, tmp_path)
    m = medallion.Medallion(w, {Reference("reference.pickup", "pickup_location_id", "location_id", "no such zone"): "zones"})
    assert m.run() == 2 + 2 + 1 + 1
    assert m.run() == 0
    assert w.table("rejected/consumption", "trips").read().count() == 1
    fact_ = {r["pickup_zone"]: r for r in w.table("integrated", "trips").read().collect()}
    assert fact_["North"]["weather_available"] and not fact_["East"]["weather_available"] and fact_["North"]["air_quality_schema_versions"] == [1]
    assert w.table("product", "daily_mobility").read().first()["trip_count"] == 2
    assert w.table("monitoring", "pipeline_runs").read().count() == 4

    r = tmp_path / "r1"
    r.mkdir()
    (r / "trips.csv").write_text(TRIPS + "2024-01-01 10:05:00,2024-01-01 10:20:00,1,2,1,2.0,10,12\n2024-02-01 11:05:00,2024-02-01 11:20:00,2,1,1,3.0,20,22\n")
    (r / "weather.csv").write_text("year,month,day,hour,temp,coco\n2024,1,1,11,7.0,2\n")
    path = release.write_manifest(str(r), "r1", [{"dataset": "trips", "path": "trips.csv", "schema_version": 1, "records": 2}, {"dataset": "weather", "path": "weather.csv", "schema_version": 1, "records": 1}])
    broken, calls = w._integrate, []
    w._integrate = lambda *a: calls.append(1) or 1 / 0
    with pytest.raises(ZeroDivisionError):
        w.apply(path)
    w._integrate = broken
    assert files.load_json(w.root / "_releases/r1.json")["status"] == "failed"
    state = w.apply(path)
    assert state["status"] == "complete" and state["done"]["raw/trips"] == {"accepted": 2, "rejected": 0, "novel": 1}
    got = w.table("integrated", "trips").read()
    assert got.count() == 3 and got.where("weather_available").count() == 2  # late weather reaches the old trip
    rebuilt = cleaners.integrated(*(w.table("normal", d).read() for d in ("trips", "zones", "weather", "air")))
    assert release.verify(w.table("integrated", "trips").read(0), got, rebuilt.select(got.columns), ["trip_id"]) == {"null_key_rows": 0, "duplicate_keys": 0, "lost": 0, "differences": 0}
    daily = w.table("product", "daily_mobility")
    assert {(r["pickup_month"], r["trip_count"]) for r in daily.read().collect()} == {(1, 2), (2, 1)}
    before = {n: t.info().version for n in ("raw", "normal", "integrated") if (t := w.table(n, "trips"))}
    w.apply(path)
    assert before == {n: w.table(n, "trips").info().version for n in before}
    with release.single_writer(str(w.root / "_lock")), pytest.raises(release.ReleaseError):
        w.apply(path)
    (r / "trips.csv").write_text(TRIPS)
    with pytest.raises(release.ReleaseError):
        w.apply(path)
    assert medallion.view(spark, str(daily.path), ["trip_count"]).columns == ["trip_count"]
    with pytest.raises(ValueError):
        medallion.view(spark, daily, ["nope"])


def test_stream_ingest(spark, tmp_path):
    from tidewright.streaming import ingest

    spec = specs(tmp_path)["zones"]
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Bronx,North,Boro\nx,Queens,East,Boro\n")
    raw, rejected = SnapshotTable(spark, str(tmp_path / "raw")), SnapshotTable(spark, str(tmp_path / "rejected"))

    def go():
        return ingest.ingest(spark, spec, str(tmp_path / "z"), raw, rejected, str(tmp_path / "cp"))

    assert go() == {"accepted": 1, "rejected": 1}
    assert go() == {"accepted": 0, "rejected": 0}
    (tmp_path / "z/b.csv").write_text("LocationID,Borough,Zone,service_zone\n2,Queens,East,Boro\n")
    assert go() == {"accepted": 1, "rejected": 0}
    assert sorted(r["location_id"] for r in raw.read().collect()) == [1, 2]


def test_windows(spark, tmp_path):
    from tidewright.streaming import ingest

    e = spark.createDataFrame([(ts("2024-01-01 10:05"), "a", 1), (ts("2024-01-01 10:55"), "a", 2), (ts("2024-01-01 11:05"), "a", 4), (ts("2024-01-01 15:00"), "a", 8)], "ts timestamp, k string, v int")
    assert sorted((r["n"], r["total"]) for r in ingest.windowed(e, "ts", ["k"], "1 hour", value="v").collect()) == [(1, 4), (1, 8), (2, 3)]
    assert sorted(r["n"] for r in ingest.sessions(e, "ts", ["k"], "2 hours").collect()) == [1, 3]
    assert ingest.windowed(e, "ts", ["k"], "1 hour", "30 minutes").count() > 3
    e.write.parquet(str(tmp_path / "e"))
    out = SnapshotTable(spark, str(tmp_path / "out"))
    stream = ingest.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "ts", ["k"], "1 hour", value="v")
    ingest.drain(stream, out, str(tmp_path / "cp"), mode="append")
    assert {(r["n"], r["total"]) for r in out.read().collect()} >= {(2, 3)}  # windows that the watermark has passed


# --- learning


def test_training(spark, tmp_path):
    rows = []
    for d in range(6):
        for z in (1, 2):
            for n in range(d % 3 + z - 1):
                rows.append((dt.datetime(2024, 1, 1 + d, 8), z, f"Z{z}", "B", None if d == 0 else 10.0 + d, 0.0, 1.0, 5.0, 1, True, d % 2 == 0))
    t = spark.createDataFrame(rows, f"pickup_hour {NTZ}, pickup_location_id int, pickup_zone string, pickup_borough string, temperature_c double, precipitation_mm double, wind_speed_kmh double, pm25_avg_ug_m3 double, weather_condition_code int, weather_available boolean, air_quality_available boolean")
    grid = ml.demand_grid(t, Period("2024-01-01 00:00:00", "2024-02-01 00:00:00"), ("2024-01-04 00:00:00", "2024-01-06 00:00:00"))
    assert grid.count() == grid.select("pickup_hour").distinct().count() * 2
    assert grid.agg(F.sum("demand")).first()[0] == len(rows) and grid.where("demand = 0").count() > 0
    assert [r["split"] for r in ml.split_report(grid).collect()] == ["train", "validation", "test"]
    features = ml.fit_features(grid)
    sizes = {r["features"].size for r in features.transform(grid.unionByName(grid.limit(1).withColumn("pickup_location_id", F.lit(99)))).select("features").collect()}
    assert len(sizes) == 1
    state = ml.run_training(grid, str(tmp_path / "run"), 3, trees=2, depth=2)
    assert state["status"] == "complete" and {m["split"] for m in state["metrics"]} == {"train", "validation", "test"}
    back = ml.load(str(tmp_path / "run")).transform(grid.withColumn("demand", F.col("demand").cast("double")))
    saved = spark.read.parquet(str(tmp_path / "run" / "predictions"))
    assert sorted(r[0] for r in back.select("prediction").collect()) == pytest.approx(sorted(r[0] for r in saved.select("prediction").collect()))
    with pytest.raises(ValueError):
        ml.fit_features(grid.where("split <> 'train'"))
    with pytest.raises(ValueError):
        ml.validate(grid.unionByName(grid))
    with pytest.raises(FileExistsError):
        ml.run_training(grid, str(tmp_path / "run"))


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0, "a"), (3.0, 2.0, 2.0, "a"), (5.0, 5.0, 1.0, "b")], "y double, p double, b double, s string")
    got = {r["s"]: r for r in rollups.regression_metrics(df, "y", "p", "b", ["s"]).collect()}
    assert (got["a"]["rmse"], got["a"]["mae"], got["a"]["r2"]) == (1.0, 1.0, 0.0) and got["b"]["r2"] is None


def test_ops(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "runs"))
    rows = ops.release_rows("r1", [ops.run_row("x", "SUCCESS", "a", records_read=5), ops.run_row("x", "SKIPPED", "b", records_read=7)], "SUCCESS", dt.datetime.now(dt.UTC))
    ops.record(t, spark, rows, "once")
    assert ops.record(t, spark, rows, "once") is None
    assert t.read().count() == 3 and t.read().where("operation = 'release'").first()["records_read"] == 5
    assert ops.record(None, spark, rows) is None  # monitoring never fails the work
    with pytest.raises(ValueError):
        ops.run_row("x", "SUCCESS", nonsense=1)


def test_stage_and_bounds(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = enrich.stage_lost(ids, {"raw": ids.where("id < 3"), "clean": ids.where("id < 2")}, "id")
    assert {r["id"]: r["stage"] for r in got.collect()} == {1: "kept", 2: "clean", 3: "raw"}
    assert enrich.with_bounds(ids, ids.limit(0), "id", "id").count() == 0
