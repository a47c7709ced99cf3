"""A report of the products as one HTML page that needs nothing else."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, BAR = 640, 180, "#3b6ea5"


def payload(products: Mapping[str, DataFrame], top: int = 10) -> dict:
    """What the page shows: totals, demand by day, the top zones, and means by weather and air, weighted by trips."""
    def weighted(df: DataFrame, key: str, value: str) -> list[dict]:
        n, v = F.sum("trip_count"), F.sum(F.col(value) * F.col("trip_count"))
        return [r.asDict() for r in df.groupBy(key).agg(n.alias("trips"), (v / n).alias("value")).orderBy(F.desc("trips"), key).collect()]

    daily = products["daily_mobility"]
    total = daily.agg(F.sum("trip_count").alias("trips"), F.sum("total_revenue").alias("revenue"), F.min("pickup_date").alias("first"), F.max("pickup_date").alias("last"), (F.sum(F.col("avg_distance") * F.col("trip_count")) / F.sum("trip_count")).alias("distance")).first().asDict()
    zones = products["zone_statistics"].groupBy("pickup_zone").agg(F.sum("trip_count").alias("trips")).orderBy(F.desc("trips"), "pickup_zone").limit(top)
    return {
        "totals": total,
        "days": [r.asDict() for r in daily.select(F.col("pickup_date").alias("day"), F.col("trip_count").alias("trips")).orderBy("day").collect()],
        "zones": [r.asDict() for r in zones.collect()],
        "weather": weighted(products["weather_impact"], "weather_condition", "avg_distance"),
        "air": weighted(products["air_quality_impact"], "pm25_category", "avg_pm25"),
    }


def embedded(value) -> str:
    """JSON that cannot end or open an element."""
    return json.dumps(value, default=str).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def bars(title: str, rows: list[dict], label: str, value: str) -> str:
    """A bar chart as SVG."""
    if not rows:
        return f"<h2>{html.escape(title)}</h2><p>No data</p>"
    most = max(float(r[value] or 0) for r in rows) or 1.0
    step = WIDTH / len(rows)
    shapes = "".join(f'<rect x="{i * step:.1f}" y="{HEIGHT * (1 - float(r[value] or 0) / most):.1f}" width="{max(1, step - 1):.1f}" height="{HEIGHT * float(r[value] or 0) / most:.1f}" fill="{BAR}"><title>{html.escape(str(r[label]))}: {float(r[value] or 0):,.2f}</title></rect>' for i, r in enumerate(rows))
    return f'<h2>{html.escape(title)}</h2><svg viewBox="0 0 {WIDTH} {HEIGHT}" role="img" aria-label="{html.escape(title)}">{shapes}</svg>'


def render(data: dict) -> str:
    t = data["totals"]
    figures = "".join(f"<li><b>{html.escape(k)}</b> {html.escape(f'{v:,.2f}' if isinstance(v, float) else str(v))}</li>" for k, v in t.items())
    charts = bars("Trips by day", data["days"], "day", "trips") + bars("Busiest zones", data["zones"], "pickup_zone", "trips") + bars("Mean distance by weather", data["weather"], "weather_condition", "value") + bars("Particles by category", data["air"], "pm25_category", "value")
    style = "body{font:16px sans-serif;margin:2rem auto;max-width:44rem}svg{width:100%}li{display:inline-block;margin-right:1.5rem}"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Mobility report</title><style>{style}</style></head><body><h1>Mobility report</h1><ul>{figures}</ul>{charts}<script type="application/json" id="data">{embedded(data)}</script></body></html>'


def write(products: Mapping[str, DataFrame], path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(render(payload(products)), encoding="utf-8")
    return path
