"""Queries against their SQL on tables with odd rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import registry

SMALL = "/root/testdata/sf0.001"


def against_sql(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}')")
    got = registry.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the given tables")
@pytest.mark.parametrize("odd", ["part", "lineitem"])
def test_payload_of_an_anchor_outside_the_graph_and_of_ends_without_id(spark, tmp_path, odd):
    for f in os.listdir(SMALL):
        os.symlink(f"{SMALL}/{f}", tmp_path / f)
    os.remove(tmp_path / f"{odd}.parquet")
    df = spark.read.parquet(f"{SMALL}/{odd}.parquet")
    mine = F.col("p_partkey" if odd == "part" else "l_partkey") == 2
    df = df.withColumn("p_size", F.when(mine, 45).otherwise(F.col("p_size")).cast(df.schema["p_size"].dataType)) if odd == "part" else df.withColumn("l_suppkey", F.when(~mine, F.col("l_suppkey")))
    df.write.parquet(str(tmp_path / f"{odd}.parquet"))
    got, want = against_sql(spark, "subgraph_payload", str(tmp_path))
    assert got == want and len(got) == (1 if odd == "part" else len(got))


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the given tables")
def test_rows_of_a_small_file_are_dealt_over_tasks(spark, monkeypatch):
    from graphloom.operators import workflows
    from graphloom.plans import adapter
    from graphloom.sources import python_source

    assert adapter.spread(spark.range(90).coalesce(1), "id", most=10).rdd.getNumPartitions() == 9
    many = spark.sparkContext.defaultParallelism
    for name in ("node_category", "quiet_profiles", "noisy_calls", "repaired_ids"):
        assert registry.queries()[name](spark, SMALL).rdd.getNumPartitions() >= many
    seen = []
    for name in ("extract", "entry_points"):
        monkeypatch.setattr(python_source, name, lambda files, *x, f=getattr(python_source, name), **k: seen.append(files.rdd.getNumPartitions()) or f(files, *x, **k))
    registry.queries()["list_entry_points"](spark, SMALL)
    assert len(seen) == 2 and min(seen) >= many
    monkeypatch.setattr(workflows, "TASK_BYTES", 2_000)
    assert registry.queries()["workflow_contexts"](spark, SMALL).rdd.getNumPartitions() > 2 * many
    got, want = against_sql(spark, "workflow_contexts", SMALL)
    assert got == want
