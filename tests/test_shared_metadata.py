"""The derived study metadata is read as few times, and with as few rows in a task, as the queries need."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from registry import fixtures as X
from scanledger.functions import ids as I
from scanledger.operators import splits as S, worklist as L

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_spread_by_the_key_they_are_joined_on(spark):
    assert "RepartitionByExpression [l_orderkey" in plan(X.derive_volumes(spark, SF))


def test_ids_are_judged_once(spark):
    """Only the written table matches ids against their pattern."""
    assert "RLIKE" not in plan(X.the_catalog(spark, SF)) and "RLIKE" not in plan(X.volume_keys(spark, SF))


@pytest.mark.parametrize("volume_id, path", [("train_1_ab_2", "dataset/train_fixed/train_1/train_1_ab/train_1_ab_2.nii.gz"), ("train_1_ab_2x", None), ("valid_1_ab_2", None)])
def test_repo_path(spark, volume_id, path):
    row = spark.createDataFrame([(volume_id, "train")], "v string, pool string").select(I.volume_repo_path(F.col("v"), F.col("pool"))).first()
    assert row[0] == path


def test_patient_order_needs_no_kernels_and_joins_rows_once(spark):
    ordered = entry.queries()["cu6_grouped_order"](spark, SF)
    assert "class" not in plan(ordered)
    volumes = spark.range(6).select(F.lit("p").alias("patient_id"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("scan_id"),
                                    F.col("id").alias("reconstruction_id"), F.col("id").cast("string").alias("volume_id"))
    got = L.in_patient_order(volumes, 7)
    assert [r.volume_id for r in got.orderBy("position").collect()] == ["0", "2", "4", "1", "3", "5"]
    assert plan(got).count("Join") == 3  # one of them joins rows


def test_volumes_and_report_meet_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_TASK", 10)
    manifest = spark.range(200).select(F.col("id").cast("string").alias("volume_id"), (F.col("id") % 7).cast("string").alias("patient_id"), F.lit("train").alias("source_split"))
    seen = []

    def stage(df):
        seen.append(df)
        return df

    qc = manifest.select("volume_id", F.lit(True).alias("passed"))
    out = S.assign_source_splits(manifest, qc.unionByName(qc), spark.createDataFrame([], "patient_id string, split string"), n_val=1, n_test=1, seed=1, stage=stage)
    join, cut = (plan(seen[0]).index(x) for x in ("Join LeftSemi", "RepartitionByExpression [volume_id"))
    assert join < cut and ", 20" in plan(seen[0])[cut:].splitlines()[0]  # below the join, in tasks of ten
    assert sorted(r.split for r in out["mapping"].collect()) == ["test", *["train"] * 5, "val"]
    assert sum(r.volumes for r in out["counts"].collect()) == 200
