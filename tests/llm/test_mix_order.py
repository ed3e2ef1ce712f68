"""The mix sends its texts once and gives the rows, and their order, of the schedule sorted by finish time."""
import random

from pyspark.sql import functions as F

from scanledger.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"


def documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 400])), rng.choice(["a", "b", "b", "c", None])) for i in range(700)]
    rows += [(None, "x y", "a"), (7, "twice the same", "a"), (7, "twice the same", "a"), (9001, None, "b"), (9002, "w " * 30_000, "c"), (9003, "lone", "d")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def in_finish_order(docs, **options):
    copies = mixing.schedule(docs, keep=docs.columns, **options).filter("words > 0").orderBy("finish", "source_key", "cell", "no", "pass")
    return [tuple(r) for r in copies.select("kept.*", (F.col("pass") + 1).alias("copy"), "words", "finish").collect()]


def test_mix_is_the_schedule_in_finish_order(spark):
    docs = documents(spark)
    for options in ({}, {"most": 3, "budget": 2.5, "weights": (1, 5)}):
        got = [tuple(r) for r in mixing.mix(docs, keep=docs.columns, **options).collect()]
        assert got == in_finish_order(docs, **options) and len(got) > 700


def test_mix_shuffles_only_cut_cells_before_the_range_sort(spark):
    docs = documents(spark)
    plan = mixing.mix(docs, keep=docs.columns)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("hashpartitioning(source_key") == 1 and plan.count("rangepartitioning(_range") == 1 and "SortMergeJoin" not in plan
    assert "_after" in plan[plan.index("hashpartitioning(source_key"):]  # under it only cells that end in another range


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), keep=["doc_id"]).count() == 0


def test_mix_keeps_the_texts_in_place_whatever_spark_broadcasts(spark):
    docs = documents(spark)
    unset = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mix = mixing.mix(docs, keep=docs.columns)
        plan = mix._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        got = [tuple(r) for r in mix.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", unset)
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(source_key") == 1
    assert got == in_finish_order(docs)


def test_cells_of_a_source_are_one_row_of_a_fixed_size(spark):
    for n in (30, 3000):
        docs = spark.createDataFrame([(i, "w " * (i % 7), "ab"[i % 2]) for i in range(n)], SCHEMA)
        _, cells, _ = mixing._parts(docs, keep=["doc_id"])
        rows = mixing._cells_by_source(cells).collect()
        assert sorted(r.source_key for r in rows) == ["=a", "=b"] and {(len(r._befores), len(r._afters)) for r in rows} == {(4096, 4096)}


def test_mix_of_more_sources_than_are_broadcast(spark):
    docs = documents(spark)
    got = [tuple(r) for r in mixing.mix(docs, keep=docs.columns, map_sources=4).collect()]  # five sources
    assert got == in_finish_order(docs) and len(got) > 700
