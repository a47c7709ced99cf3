"""The registered corpus queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from tidewright.llm import queries

D = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__

    names = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11))
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, D)
    got = df.collect()
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
        found = con.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(found.fetchall())
    elif name not in ("op1_substring_dedup", "op5_license_rules"):
        assert len(got) == spark.read.parquet(f"{D}/{'pages' if name.startswith('op10') else 'documents'}.parquet").count()


def test_pipeline(spark):
    """Each stage on what the one before kept, against the operators' own brute force on the driver."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs)
    quality, single, clean, redacted, ids = seen
    assert all(s.columns == columns for s in seen[:-1]) and ids.columns[0] == "doc_id"
    assert single.count() < quality.count() and clean.count() <= single.count() and redacted.count() == clean.count() == ids.count()
    from tests.llm.test_operators import slow_links

    from tests.llm.test_operators import slow_kept, slow_overlaps

    whole = spark.read.parquet(f"{D}/documents.parquet").collect()
    assert {r["doc_id"] for r in quality.collect()} == {r["doc_id"] for r, (_, kept) in zip(whole, slow_kept([r["text"] for r in whole])) if kept}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    leaked = {i for i, _ in slow_overlaps([(r["doc_id"], r["text"]) for r in single.collect()], items)}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaked
    rows = [(r["doc_id"], r["text"]) for r in quality.collect()]
    assert {r["doc_id"] for r in single.collect()} == {c for _, c in slow_links(rows, 80, 5).values()}  # the rule of near-duplicate stages
    from tidewright.llm import secret_scan

    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(r["text"] == secret_scan.redacted(before[r["doc_id"]], secret_scan.scan(before[r["doc_id"]])[1]) for r in redacted.collect())
    whole = corpus_pipeline.run(spark, D)
    assert sorted(map(str, whole.collect())) == sorted(map(str, ids.collect()))


def test_pipeline_on_odd_tables(spark, monkeypatch):
    """An empty table, and one of null ids, null and long texts, repeated rows and columns with the names used inside."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{D}/documents.parquet").limit(30)
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 3, None).otherwise(F.col("doc_id")))
    odd = odd.unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 200)))
    odd = odd.unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).withColumns({c: F.lit("x") for c in ("id", "digest", "row", "cell", "_cell", "token", "item", "votes", "ids")})
    for df in (odd, odd.limit(0)):
        ends, now = [], df
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, D)
            now = spark.createDataFrame(out.collect(), out.schema)
            ends.append(now.count())
        assert ends == sorted(ends, reverse=True) and (ends[-1] > 0) == (df is odd)
