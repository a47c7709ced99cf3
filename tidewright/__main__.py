"""``python -m tidewright COMMAND --root WAREHOUSE [--source FILES] ...``: the mobility warehouse from the shell."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import analytics, experiments, medallion, ml, mobility, products, report
from .specs import Period


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["all", "raw", "normal", "integrated", "derived", "updates", "queries", "report", "train", "storage", "view"])
    p.add_argument("--root", required=True, help="folder of the warehouse")
    p.add_argument("--source", default=".", help="folder of the source files")
    p.add_argument("--period", nargs=2, action="append", metavar=("START", "END"), help="half-open period of pickups; may be given again")
    p.add_argument("--manifest", help="manifest of a release, for updates")
    p.add_argument("--releases", help="folder of releases, for updates: all below it, begun ones first")
    p.add_argument("--query", help="one analytical query; all without it")
    p.add_argument("--save", action="store_true", help="store the queries' results")
    p.add_argument("--table", help="layer/name of a table, for view")
    p.add_argument("--splits", nargs=2, metavar=("VALIDATION", "TEST"), help="first times of the validation and test rows, for train")
    p.add_argument("--out", help="file or folder of a report or a training run")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidewright").getOrCreate()
    periods = [Period(*x) for x in a.period or [("1900-01-01 00:00:00", "2200-01-01 00:00:00")]]
    m = mobility.warehouse(spark, a.root, a.source, periods)
    if a.command == "all":
        print(m.run())
    elif a.command in m.steps():
        print(m.steps()[a.command]())
    elif a.command == "updates":
        print(json.dumps(m.w.apply(a.manifest) if a.manifest else m.w.apply_all(a.releases), indent=2, default=str))
    elif a.command == "queries":
        analytics.register(m.w.table("integrated", "trips").read(), m.w.table("normal", "weather").read(), m.w.table("normal", "air_quality").read(), periods)
        for name in [a.query] if a.query else analytics.QUERIES:
            analytics.run(spark, name, m.w.table("analysis", name) if a.save else None).show(50, truncate=False)
    elif a.command == "report":
        print(report.write({n: m.w.table("product", n).read() for n in products.PRODUCTS}, a.out or f"{a.root}/report.html"))
    elif a.command == "train":
        source = m.w.table("integrated", "trips")
        grid = ml.demand_grid(source.read(), Period(min(x.start for x in periods), max(x.end for x in periods)), tuple(a.splits))
        print(json.dumps(ml.run_training(grid, a.out, source.info().version), indent=2, default=str))
    elif a.command == "storage":
        print(json.dumps(experiments.storage(a.root), indent=2))
    else:
        medallion.view(spark, m.w.table(*a.table.split("/"))).show(truncate=False)


if __name__ == "__main__":
    main()
