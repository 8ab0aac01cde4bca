"""Every registered query against its SQL, and the streaming pipelines."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane import catalog, catalog_payloads  # noqa: F401  the second registers its queries with the first
from corvane.streaming import pipelines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return f"{x:.5g}"
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else f"{float(x):.5g}" if type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert found.count() > 0
        return
    want = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(found.columns)
    num = lambda rows: sorted([plain(float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in r] for r in rows)
    assert num([r[c] for c in cols] for r in found.collect()) == num(want.fetchall())


def test_mmr_answers_every_id_divisible_by_50(spark):
    asked = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    assert {r.qid for r in catalog.ret18_mmr(spark, SF).select("qid").distinct().collect()} == asked


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming_ingest(spark, tmp_path):
    src, target = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    for n, rows in enumerate(['{"id":"a","v":1,"line_no":1}\n{"id":"b","v":1,"line_no":2}', '{"id":"a","v":2,"line_no":3}']):
        (src / f"{n}.json").write_text(rows)
        stream = pipelines.read_json(spark, f"file://{src}", "id string, v int, line_no long")
        pipelines.ingest(stream, target, f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(target).drop("bucket").collect())) == [("a", 2), ("b", 1)]


def test_streaming_ingest_survives_a_crash_between_renames(spark, tmp_path):
    from corvane.operators import lifecycle

    target = f"file://{tmp_path}/t"
    lifecycle.swap_buckets(spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "id string, v int, bucket int"), target)
    (tmp_path / "t/_old").mkdir()
    (tmp_path / "t/bucket=1").rename(tmp_path / "t/_old/bucket=1")  # died after the first rename
    (tmp_path / "t/_new").mkdir()
    assert lifecycle.recover_buckets(spark, target)
    assert sorted((r.id, r.v) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 1)]
    lifecycle.swap_buckets(spark.createDataFrame([("b", 2, 1)], "id string, v int, bucket int"), target)
    assert sorted((r.id, r.v) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 2)]
    assert not lifecycle.recover_buckets(spark, f"file://{tmp_path}/none")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(once=True).start()  # a state with a timeout never runs out of batches
    done = q.awaitTermination(120)
    q.stop()
    assert done
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(400)
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    want = pipelines.windowed_counts(spark.read.parquet(f"{tmp_path}/e")).agg(F.sum("events")).first()[0]
    assert run(pipelines.windowed_counts(stream), "windows", "complete").agg(F.sum("events")).first()[0] == want == 400
    assert run(pipelines.distinct_events(stream), "once").count() == 400
    log = stream.select(F.col("user_id").cast("string").alias("search_id"), F.col("event_id").alias("seq"), F.lit("search.started").alias("event_type"), F.lit("s").alias("stage"))
    assert run(pipelines.fold_traces(log), "traces", "update").agg(F.sum("events")).first()[0] == 400
