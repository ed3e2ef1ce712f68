"""Embedding tables whose means tie after rounding, and volumes of fewer than ten slices."""
import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scanledger.operators import grid as G, selection as SEL


def test_extreme_norms_settle_rounded_ties_by_id(spark, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    lengths = [1 + 1e-12 * (5 - v) for v in range(6)]  # equal to 9 digits, the order of ids reversed in the digits behind
    spark.createDataFrame([(10 * v + z, [n] + [0.0] * 63) for v, n in enumerate(lengths) for z in range(10)], "vec_id bigint, embedding array<double>").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["so2_extreme_norms"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(entry.oracle_sql()["so2_extreme_norms"]).fetchall()) and [v for v, _ in got] == ["0", "1", "4", "5"]


def test_a_short_volume_counts_its_own_slices(spark):
    rows = spark.createDataFrame([("v", z, [float(z), 1.0]) for z in range(6)], "volume_id string, slice_idx int, emb array<double>")
    scored = SEL.importance(rows, "norm")
    assert {r.n_slices for r in scored.collect()} == {6}
    assert sorted(r.slice_idx for r in SEL.select_uniform(scored, 4).collect()) == [0, 2, 3, 5]
    ends = SEL.axial_gap(scored.filter("slice_idx < 2").select("volume_id", "slice_idx"), scored.select("volume_id", "n_slices").distinct())
    assert ends.first().largest_gap == 4
    px = rows.select("volume_id", F.col("slice_idx").alias("z"), F.lit(1).alias("h"), F.lit(2).alias("w"), F.col("emb").alias("pixels"))
    spacing = spark.createDataFrame([("v", 3.0, 0.75, 0.75)], "volume_id string, spacing_z_mm double, spacing_y_mm double, spacing_x_mm double")
    plan = G.resample_plan(px, spacing).first()
    assert (plan.n_z, plan.new_z) == (6, 12)
    assert sorted(r.z for r in G.resize(px, (2, 2), "pad").collect()) == list(range(6))
