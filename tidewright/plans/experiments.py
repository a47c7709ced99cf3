"""Experiments on plans and layouts: variants of settings and hints, storage layouts, plan metrics, result comparison."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import statistics
import time
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bucket
from ..operators import rules
from ..operators.diff import bag_difference
from ..operators.keys import split_novel
from ..sources.contracts import with_lineage
from ..sources.snapshot import SnapshotTable
from . import ops
from .products import ProductSpec, build


@dataclass(frozen=True)
class Variant:
    """A way to run a query: settings, views to cache, replacements in its text."""

    name: str
    conf: Mapping[str, str] = field(default_factory=dict)
    cached: Sequence[str] = ()
    rewrites: Mapping[str, str] = field(default_factory=dict)


BASELINE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
VARIANTS = (
    Variant("baseline", BASELINE),
    Variant("cache", BASELINE, ("trips",)),
    Variant("broadcast", BASELINE | {"spark.sql.autoBroadcastJoinThreshold": "10485760"}),
    Variant("aqe", BASELINE | {"spark.sql.adaptive.enabled": "true"}),
    Variant("aqe_32", BASELINE | {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "32"}),
    Variant("combined", {"spark.sql.autoBroadcastJoinThreshold": "10485760", "spark.sql.adaptive.enabled": "true"}, ("trips",)),
)


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]):
    """Settings for a while; afterwards each is as it was, or unset if it was not set."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rewritten(sql: str, changes: Mapping[str, str]) -> str:
    """Each text must occur exactly once, so that a rewrite cannot miss or hit twice."""
    for old, new in changes.items():
        if sql.count(old) != 1:
            raise ValueError(f"{old!r} occurs {sql.count(old)} times")
        sql = sql.replace(old, new)
    return sql


def hinted(sql: str, *views: str) -> str:
    """A broadcast hint in the query's last SELECT; HINTS names places for the registered queries."""
    head, select, tail = sql.rpartition("SELECT ")
    if not select:
        raise ValueError("no SELECT")
    return f"{head}SELECT /*+ BROADCAST({', '.join(views)}) */ {tail}"


#: Broadcast hints by query: each SELECT that gets one, and the small side it names.
HINTS = {"zone_weather_variation": {"SELECT z.id, z.zone, cast(": "SELECT /*+ BROADCAST(d) */ z.id, z.zone, cast(", "SELECT pickup_location_id AS id, w.": "SELECT /*+ BROADCAST(w) */ pickup_location_id AS id, w."}, "monthly_demand_trend": {"SELECT a.month,": "SELECT /*+ BROADCAST(b) */ a.month,"}}


def pruning_pairs(sql: str, year: int, month: int, after: str = "FROM trips") -> dict[str, tuple[str, str]]:
    """A query cut to one month, without and with the predicate on the partition columns: by a function of the time, and by its range."""
    following = f"{year + month // 12}-{month % 12 + 1:02d}"
    cuts = {"function_filter": f"date_format(pickup_timestamp, 'yyyy-MM') = '{year}-{month:02d}'", "range_filter": f"pickup_timestamp >= timestamp_ntz'{year}-{month:02d}-01 00:00:00' AND pickup_timestamp < timestamp_ntz'{following}-01 00:00:00'"}
    pruned = f"pickup_year = {year} AND pickup_month = {month}"
    return {k: (rewritten(sql, {after: f"{after} WHERE {c}"}), rewritten(sql, {after: f"{after} WHERE {pruned} AND {c}"})) for k, c in cuts.items()}


def scans(plan: str) -> list[dict[str, str]]:
    """Of each scan of a formatted plan: where it reads, its partition and pushed filters, the columns it reads."""
    out = []
    for part in re.split(r"\n\n(?=\(\d+\) )", plan):
        if re.match(r"\(\d+\) (Batch)?Scan", part):
            found = dict(re.findall(r"^(Location|PartitionFilters|PushedFilters|ReadSchema): (.*)$", part, re.M))
            out.append({k: found.get(k, "") for k in ("Location", "PartitionFilters", "PushedFilters", "ReadSchema")})
    return out


def measure(spark: SparkSession, sql: str, variant: Variant, runs: int = 5, warm_up: int = 1, expected: Snapshot | None = None) -> dict:
    """Times of a query under a variant, its plan, its plan's metrics, and whether every run gave the expected rows."""
    with settings(spark, variant.conf):
        for v in variant.cached:
            spark.catalog.cacheTable(v)
            spark.table(v).count()
        try:
            text = rewritten(sql, variant.rewrites)
            plan = spark.sql(f"EXPLAIN FORMATTED {text}").first()[0]
            seconds, equal, df = [], True, None
            for i in range(warm_up + runs):
                t = time.perf_counter()
                df = spark.sql(text)
                rows = df.collect()
                if i >= warm_up:
                    seconds.append(time.perf_counter() - t)
                snap = Snapshot.of(df.columns, rows)
                expected = expected or snap
                equal &= snap.matches(expected)
            return {"variant": variant.name, "seconds": seconds, "median": statistics.median(seconds), "equal": equal, "plan": plan, "scans": scans(plan), "metrics": plan_metrics(df), "snapshot": expected}
        finally:
            for v in variant.cached:
                spark.catalog.uncacheTable(v)


def suite(spark: SparkSession, queries: Mapping[str, str], variants: Iterable[Variant] = VARIANTS, blocks: int = 3, runs: int = 1, seed: int = 1) -> list[dict]:
    """Blocks of all queries and variants in random order: what disturbs the machine hits all alike."""
    pairs, out, truth = list(itertools.product(queries, variants)), [], {}
    r = random.Random(seed)
    for block in range(blocks):
        for name, variant in r.sample(pairs, len(pairs)):
            m = measure(spark, queries[name], variant, runs, 1, truth.get(name))
            truth.setdefault(name, m.pop("snapshot"))
            m.pop("snapshot", None)
            out.append({"block": block, "query": name, **m})
    return out


def candidates(results: list[dict], least_gain: float = 0.05) -> dict[str, str]:
    """For each query the variant that beats the baseline by the least gain in the median and in most blocks, if any."""
    best = {}
    for q in {r["query"] for r in results}:
        by = {}
        for r in results:
            if r["query"] == q and r["equal"]:
                by.setdefault(r["variant"], {})[r["block"]] = r["median"]
        base = by.pop("baseline", None)
        if not base:
            continue
        b = statistics.median(base.values())
        won = {v: statistics.median(t.values()) for v, t in by.items() if sum(t[k] < base[k] for k in t if k in base) * 2 > len(t) and statistics.median(t.values()) <= b * (1 - least_gain)}
        if won:
            best[q] = min(won, key=won.get)
    return best


def experiment(spark: SparkSession, queries: Mapping[str, str], pairs: Mapping[str, tuple[str, str]] | None = None, variants: Sequence[Variant] = VARIANTS, blocks: int = 3, seed: int = 1) -> dict:
    """Exploration, a frozen selection, and its confirmation.

    explored: all variants of all queries. pruning: each pair's two queries under the baseline, which must give the same
    rows. selected: the variant of each query that exploration prefers; it is frozen before confirmation. confirmed: only
    baseline and selection, in new blocks of another order; ``holds`` says for each query whether the gain is there again.
    """
    explored = suite(spark, queries, variants, blocks, seed=seed)
    pruning = []
    for name, (plain, pruned) in (pairs or {}).items():
        a = measure(spark, plain, Variant("baseline", BASELINE), blocks)
        b = measure(spark, pruned, Variant("pruned", BASELINE), blocks, expected=a.pop("snapshot"))
        b.pop("snapshot")
        pruning.append({"pair": name, "plain": a, "pruned": b})
    selected = candidates(explored)
    by_name = {v.name: v for v in variants}
    confirmed = [r for q, v in selected.items() for r in suite(spark, {q: queries[q]}, (by_name["baseline"], by_name[v]), blocks, seed=seed + 1)]
    again = candidates(confirmed)
    return {"explored": explored, "pruning": pruning, "selected": selected, "confirmed": confirmed, "holds": {q: again.get(q) == v for q, v in selected.items()}}


def plan_metrics(df: DataFrame) -> dict[str, dict[str, int]]:
    """Metrics of the plan that ran, by operator, through adaptive stages; empty where there is no JVM session."""
    try:
        node = df._jdf.queryExecution().executedPlan()
    except AttributeError:
        return {}
    out: Counter = Counter()

    def walk(n) -> None:
        kind = n.nodeName()
        it = n.metrics().iterator()
        while it.hasNext():
            kv = it.next()
            out[kind, kv._1()] += max(0, kv._2().value())
        inner = n.executedPlan() if kind.startswith("AdaptiveSparkPlan") else n.plan() if "QueryStage" in kind else None
        if inner is not None:
            walk(inner)
        kids = n.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(node)
    by: dict[str, dict[str, int]] = {}
    for (kind, metric), v in out.items():
        by.setdefault(kind, {})[metric] = v
    return by


class Snapshot:
    """A small result to compare with: rows in any order, duplicates kept."""

    LIMIT = 100_000

    def __init__(self, columns: list[str], rows: list[tuple]):
        if len(rows) > self.LIMIT:
            raise ValueError(f"{len(rows)} rows; compare larger results with operators.diff")
        self.columns, self.rows = columns, rows

    @classmethod
    def of(cls, columns, rows) -> Snapshot:
        return cls(list(columns), [tuple(r) for r in rows])

    def digest(self) -> str:
        """SHA-256 over the sorted rows."""
        return hashlib.sha256("\n".join(sorted(map(repr, self.rows))).encode()).hexdigest()

    def matches(self, other: Snapshot, tolerance: float = 1e-9) -> bool:
        """Whether the rows can be paired so that each pair is equal up to the tolerance: a perfect matching, not the first fit."""
        if self.columns != other.columns or len(self.rows) != len(other.rows):
            return False
        if self.digest() == other.digest():
            return True

        def key(row):
            return tuple("<number>" if isinstance(v, float) else repr(v) for v in row)

        mine, yours = {}, {}
        for side, rows in ((mine, self.rows), (yours, other.rows)):
            for r in rows:
                side.setdefault(key(r), []).append(r)
        return mine.keys() == yours.keys() and all(_matched(mine[k], yours[k], tolerance) for k in mine)


def _close(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or not math.isinf(a) and not math.isinf(b) and abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    return repr(a) == repr(b)


def _matched(left: list[tuple], right: list[tuple], tolerance: float) -> bool:
    """Whether rows that agree in all but their numbers can be paired off within the tolerance."""
    if len(left) != len(right):
        return False

    def in_order(row: tuple) -> list:
        return [(v != v, 0.0 if v != v else v) for v in row if isinstance(v, float)]

    left, right = sorted(left, key=in_order), sorted(right, key=in_order)

    def fits(i: int, j: int) -> bool:
        return all(_close(x, y, tolerance) for x, y in zip(left[i], right[j]))

    if all(fits(i, i) for i in range(len(left))):
        return True
    if not left or len(in_order(left[0])) < 2:
        return False  # of one number the order is the best pairing
    held_by: dict[int, int] = {}

    def seat(i: int, asked: set[int]) -> bool:
        for j in range(len(right)):
            if j not in asked and fits(i, j):
                asked.add(j)
                if j not in held_by or seat(held_by[j], asked):
                    held_by[j] = i
                    return True
        return False

    return all(seat(i, set()) for i in range(len(left)))


#: The columns of the integrated fact that layouts are compared on.
BENCHMARK_COLUMNS = "trip_id vendor_id pickup_timestamp dropoff_timestamp passenger_count trip_distance pickup_location_id dropoff_location_id payment_type fare_amount total_amount trip_duration_seconds pickup_date pickup_year pickup_month pickup_borough taxi_schema_version pickup_zone_schema_version dropoff_zone_schema_version weather_schema_version air_quality_schema_versions".split()


def benchmark_input(integrated: DataFrame) -> DataFrame:
    """The columns that layouts are compared on; a ValueError names those that are missing."""
    if missing := [c for c in BENCHMARK_COLUMNS if c not in integrated.columns]:
        raise ValueError(f"the source lacks the columns {missing}")
    return integrated.select(*BENCHMARK_COLUMNS)


Layout = Callable[[DataFrame], tuple[DataFrame, tuple[str, ...]]]


def layouts(month: tuple[str, ...] = ("pickup_year", "pickup_month"), region: str = "pickup_borough", day: str = "pickup_date", key: str = "trip_id") -> dict[str, Layout]:
    """Ways to store a frame: how it is dealt out, and the columns it is partitioned by."""
    dealt = {f"random_{n}": lambda df, n=n: (df.withColumn("_b", bucket(key, n)).repartition(n, "_b").drop("_b"), ()) for n in (20, 128, 608)}
    return {"unpartitioned": lambda df: (df, ()), "by_month": lambda df: (df, month), "by_region": lambda df: (df, (region,)), "by_date": lambda df: (df.repartition(day), (day,)), **dealt}


def layout_benchmark(spark: SparkSession, df: DataFrame, folder: str, queries: Mapping[str, Callable[[DataFrame], DataFrame]], shapes: Mapping[str, Layout] | None = None, writes: int = 1, runs: int = 3) -> list[dict]:
    """Writes a frame in each layout and times the queries on it: seconds, megabytes, files."""
    out = []
    for name, shape in (shapes or layouts()).items():
        path, seconds = f"{folder}/{name}", []
        for _ in range(writes):
            shaped, partitions = shape(df)
            t = time.perf_counter()
            writer = shaped.write.mode("overwrite")
            (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
            seconds.append(time.perf_counter() - t)
        files = list(Path(path).rglob("*.parquet"))
        row = {"layout": name, "write_s": statistics.median(seconds), "mb": sum(f.stat().st_size for f in files) / 1e6, "files": len(files)}
        for q, fn in queries.items():
            times = []
            for _ in range(runs + 1):
                t = time.perf_counter()
                fn(spark.read.parquet(path)).collect()
                times.append(time.perf_counter() - t)
            row[q] = statistics.median(times[1:])
        out.append(row)
    return out


def timed(fn: Callable[[], object], repeats: int = 3) -> float:
    """Median seconds of an action."""
    times = []
    for _ in range(repeats):
        t = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t)
    return statistics.median(times)


def overhead(plain: Callable[[], object], watched: Callable[[], object], repeats: int = 3) -> dict[str, float]:
    """What validation or monitoring adds to an action, in seconds and per cent."""
    a, b = timed(plain, repeats), timed(watched, repeats)
    return {"plain_s": a, "watched_s": b, "added_s": b - a, "added_pct": 100 * (b - a) / a if a else math.nan}


def storage(root: str) -> dict[str, dict[str, int]]:
    """Bytes and Parquet files below each folder of a warehouse, counted in the data, not in the logs."""
    out = {}
    for layer in sorted(p for p in Path(root).iterdir() if p.is_dir()):
        files = list(layer.rglob("*.parquet"))
        out[layer.name] = {"bytes": sum(f.stat().st_size for f in files), "files": len(files)}
    return out


def product_benchmark(spark: SparkSession, on_demand: Mapping[str, Callable[[], DataFrame]], stored: Mapping[str, Callable[[], DataFrame]], runs: int = 3) -> list[dict]:
    """Seconds to compute a product anew and to read it stored, and whether both give the same rows."""
    out = []
    for name, fresh in on_demand.items():
        a, b = fresh(), stored[name]().select(*fresh().columns)
        equal = Snapshot.of(a.columns, a.collect()).matches(Snapshot.of(b.columns, b.collect()))
        out.append({"product": name, "on_demand_s": timed(lambda f=fresh: f().collect(), runs), "stored_s": timed(lambda f=stored[name]: f().collect(), runs), "equal": equal})
    return out


def evaluation(update: Callable[[], object], refresh: Mapping[str, Callable[[], object]], plain: Callable[[], object], validated: Callable[[], object], monitored: Callable[[], object], root: str, repeats: int = 3) -> dict:
    """Figures of a running system: update and refresh times, what validation and monitoring add, storage by layer."""
    each = {k: timed(f, repeats) for k, f in refresh.items()}
    return {"update_s": timed(update, repeats), "refresh_s": each, "refresh_total_s": sum(each.values()), "validation": overhead(plain, validated, repeats), "monitoring": overhead(plain, monitored, repeats), "storage": storage(root)}


def compare_workflows(paths: Mapping[str, Callable[[], DataFrame]], fit: Callable[[DataFrame], object], learn: Callable[[DataFrame], object], repeats: int = 3) -> dict[str, dict[str, float]]:
    """Median seconds of preparing, fitting features and training by each way to the training rows, in turns.

    Each way (such as from raw files, or from the integrated table) must give the same rows; that is checked first.
    """
    frames = {k: make() for k, make in paths.items()}
    columns = sorted(next(iter(frames.values())).columns)
    first = next(iter(frames.values())).select(*columns)
    for k, f in frames.items():
        if not bag_difference(first, f.select(*columns)).isEmpty():
            raise ValueError(f"{k} gives other rows")
    seconds: dict[str, dict[str, list[float]]] = {k: {"preparation": [], "features": [], "training": []} for k in paths}
    for turn in range(repeats):
        for k in sorted(paths, reverse=turn % 2 == 1):
            rows = paths[k]()
            for part, work in (("preparation", lambda: rows.write.format("noop").mode("overwrite").save()), ("features", lambda: fit(rows)), ("training", lambda: learn(rows))):
                seconds[k][part].append(timed(work, 1))
    out = {k: {part: statistics.median(v) for part, v in parts.items()} for k, parts in seconds.items()}
    return {k: v | {"total": sum(v.values())} for k, v in out.items()}


def workload(spark: SparkSession, root: str, rows: int = 10_000, new: int = 1_000, repeated: int = 100, repeats: int = 3) -> dict:
    """``evaluation`` on made-up rows in a new folder: an update of new and repeated records, products, rules, the run log."""
    stored = SnapshotTable(spark, f"{root}/raw/records")
    facts = SnapshotTable(spark, f"{root}/integrated/facts")
    log = SnapshotTable(spark, f"{root}/monitoring/runs")
    made = spark.range(rows + new).select("id", bucket("id", 50).alias("zone"), F.expr("date_add(date'2024-01-01', cast(id % 60 AS int))").alias("day"), (F.col("id") % 97).cast("double").alias("amount"))
    first, batch = made.where(F.col("id") < rows), made.where(F.col("id") >= rows - repeated)
    stored.overwrite(with_lineage(first, "records", 1, "first"))
    facts.overwrite(first.where(F.col("id") < rows // 2))
    incoming = with_lineage(batch, "records", 1, "second")
    specs = {n: ProductSpec(n, lambda df, keys=keys: df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("amount").alias("total")), keys, keys, (*keys, "amount")) for n, keys in (("by_day", ("day",)), ("by_zone", ("zone",)), ("by_zone_day", ("zone", "day")), ("by_amount", ("amount",)))}
    some = rules.required("id"), rules.at_least("amount", 0.0), rules.between("zone", 0, 49)
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    return evaluation(
        lambda: run(split_novel(incoming, stored.read(), ["id"])[0]),
        {n: lambda s=s, n=n: build(s, facts, SnapshotTable(spark, f"{root}/product/{n}")) for n, s in specs.items()},
        lambda: run(facts.read()),
        lambda: run(rules.classify(facts.read(), some)[0]),
        lambda: (run(facts.read()), ops.record(log, spark, [ops.run_row("dataset_update", "SUCCESS", "records")])),
        root,
        repeats,
    )
