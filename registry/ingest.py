"""Registered queries: ingest bookkeeping and the resumable stream (section 2.11)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scanledger.operators import experiments as X2
from scanledger.staging import shared_folder
from scanledger.streaming import ingest as IN

from . import Registry, fixtures as X
from .common import r, tidy

reg = Registry()
ONE = "(SELECT chunk, volume_id, bool_or(failed) AS f, bool_or(cached) AS c, min(error) AS error FROM chunk_log GROUP BY 1,2)"
RECORDS = f"(SELECT chunk, count(*) AS n_volumes, count(*) FILTER (NOT f AND NOT c) AS n_ok, count(*) FILTER (NOT f AND c) AS n_cached, count(*) FILTER (f) AS n_failed FROM {ONE} GROUP BY 1)"
SCHEMA = "volume_id string, chunk string, failed boolean, error string, cached boolean"


def records(spark, sf):
    return IN.chunk_records(X.chunk_log(spark, sf))


@reg.add("ing7_chunk_records", f"SELECT * FROM {RECORDS}")
def _(spark, sf):
    return records(spark, sf)


HASH32 = "('0x'||substr(md5(volume_id),1,8))::BIGINT"


def maps_sql(source, per_map):
    return (f"WITH f AS (SELECT *, count(*) OVER (PARTITION BY chunk) AS n_failed FROM {source} WHERE f) SELECT chunk, {HASH32}%ceil(n_failed/{per_map})::BIGINT AS part, n_failed, "
            f"string_agg(volume_id||'='||error, ';' ORDER BY volume_id) AS failed FROM f GROUP BY 1,2,3")


def maps_text(df):
    return df.withColumn("failed", F.array_join(F.transform(F.map_entries("failed"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))


@reg.add("ing7_failed_maps", maps_sql(ONE, 2))
def _(spark, sf):
    return maps_text(IN.failed_maps(X.chunk_log(spark, sf), 2))


@reg.add("ing7_failed_maps_large_chunk", maps_sql("(SELECT 'all' AS chunk, volume_id, bool_or(failed) AS f, min(error) AS error FROM chunk_log GROUP BY 2)", 1000))
def _(spark, sf):
    return maps_text(IN.failed_maps(X.chunk_log(spark, sf).withColumn("chunk", F.lit("all"))))


@reg.add("cu17_failure_list", f"SELECT chunk, volume_id, error FROM {ONE} WHERE f")
def _(spark, sf):
    return IN.failure_list(X.chunk_log(spark, sf))


@reg.add("ing4_failed_attempts", """WITH a AS (SELECT (event_id%400)::VARCHAR AS chunk, event_id//400 AS attempt, failed FROM chunk_log), d AS (SELECT chunk, max(attempt) FILTER (NOT failed) AS done FROM a GROUP BY 1)
  SELECT chunk, count(*) FILTER (failed) AS attempts FROM a JOIN d USING (chunk) WHERE done IS NULL OR attempt>done GROUP BY 1 HAVING count(*) FILTER (failed)>0""")
def _(spark, sf):
    e = F.col("event_id")
    return IN.failed_attempts(X.chunk_log(spark, sf).select((e % 400).cast("string").alias("chunk"), F.floor(e / 400).alias("attempt"), "failed"))


@reg.add("ing5_retry_set", f"SELECT chunk FROM {RECORDS} WHERE n_failed>0 UNION SELECT 'extra_'||n_nationkey FROM nation")
def _(spark, sf):
    planned = X.chunk_log(spark, sf).select("chunk").unionByName(X.table(spark, sf, "nation").select(F.concat(F.lit("extra_"), F.col("n_nationkey").cast("string")).alias("chunk")))
    return IN.retry_set(records(spark, sf), planned)


@reg.add("ing6_status_report", f"""SELECT chunks_done, chunks_with_failures, volumes_ok, volumes_failed, chunks_done+25 AS chunks_planned, {r('mb/volumes_ok', 'mb_per_volume')}, {r('mb/volumes_ok*(volumes/chunks_done)*(chunks_done+25)/1000', 'projected_gb')}
  FROM (SELECT count(*) AS chunks_done, count(*) FILTER (n_failed>0) AS chunks_with_failures, sum(n_ok+n_cached)::BIGINT AS volumes_ok, sum(n_failed)::BIGINT AS volumes_failed, sum(n_volumes)::DOUBLE AS volumes FROM {RECORDS}), (SELECT sum(value) AS mb FROM events)""")
def _(spark, sf):
    log = X.chunk_log(spark, sf)
    planned = log.select("chunk").unionByName(X.table(spark, sf, "nation").select(F.concat(F.lit("extra_"), F.col("n_nationkey").cast("string")).alias("chunk")))
    return tidy(IN.status_report(records(spark, sf), planned, log.select(F.col("value").alias("mb"))))


@reg.add("ing6_first_failures", f"SELECT chunk, volume_id, substr(error,1,120) AS error FROM {ONE} WHERE f ORDER BY chunk, volume_id LIMIT 5")
def _(spark, sf):
    return IN.first_failures(X.chunk_log(spark, sf))


@reg.add("ing8_all_failed", f"SELECT chunk, n_failed FROM (SELECT *, n_volumes-n_cached AS needed FROM (SELECT (event_id//2)::VARCHAR AS chunk, count(DISTINCT event_id) AS n_volumes, count(*) FILTER (event_type='click') AS n_cached, count(*) FILTER (event_type='error') AS n_failed FROM events GROUP BY 1)) WHERE n_failed>0 AND n_failed=needed")
def _(spark, sf):
    log = X.chunk_log(spark, sf).withColumn("chunk", F.floor(F.col("event_id") / 2).cast("string")).withColumn("volume_id", F.col("event_id").cast("string"))
    return IN.all_failed(IN.chunk_records(log))


@reg.add("wn8_failure_streak", """WITH c AS (SELECT chunk, bool_or(failed) AS failed, min(event_id) AS seq FROM (SELECT (event_id//3)::VARCHAR AS chunk, failed, event_id FROM chunk_log) GROUP BY 1), i AS (SELECT *, count(*) FILTER (NOT failed) OVER (ORDER BY seq) AS island FROM c)
  SELECT chunk, seq, row_number() OVER (PARTITION BY island ORDER BY seq) AS streak, row_number() OVER (PARTITION BY island ORDER BY seq)>=3 AS alert FROM i WHERE failed""")
def _(spark, sf):
    log = X.chunk_log(spark, sf).groupBy(F.floor(F.col("event_id") / 3).cast("string").alias("chunk")).agg(F.bool_or("failed").alias("failed"), F.min("event_id").alias("seq"))
    return X2.failure_streaks(log, "seq", 3)


def streamed(spark, sf, max_chunks=None, runs=1, files=5, **options):
    """The chunk log as chunk files in a scratch folder, ingested by the stream; returns the target folder."""
    root = f"{shared_folder(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    log = X.chunk_log(spark, sf).select("volume_id", "chunk", "failed", "error", "cached", "event_id")
    log.repartitionByRange(files, "event_id").drop("event_id").write.parquet(f"{root}/in")
    for _ in range(runs):
        IN.ingest(spark, f"{root}/in", SCHEMA, f"{root}/out", f"{root}/checkpoint", max_chunks=max_chunks, **options)
    return f"{root}/out"


@reg.add("ing1_resumable_ingest", "SELECT DISTINCT volume_id FROM chunk_log WHERE NOT failed")
def _(spark, sf):
    return IN.read_table(spark, streamed(spark, sf), "accepted").select("volume_id")


@reg.add("ing1_batches_of_files", """SELECT 40::BIGINT AS files, 40::BIGINT AS attempts, 1::BIGINT AS most_attempts, 4::BIGINT AS batches, count(DISTINCT volume_id) FILTER (NOT failed) AS volumes,
  count(*) AS rows FROM chunk_log""")
def _(spark, sf):
    """Forty chunk files in four batches."""
    folder = streamed(spark, sf, files=40, files_per_batch=10)
    tries = IN.attempts(spark, folder).agg(F.count_distinct("chunk").alias("files"), F.count(F.lit(1)).alias("attempts"), F.max("attempt").alias("most_attempts"))
    batches = spark.read.parquet(f"{folder}/landed").agg(F.count_distinct("batch").alias("batches"))
    volumes = IN.read_table(spark, folder, "accepted").agg(F.count(F.lit(1)).alias("volumes"))
    return tries.join(batches).join(volumes).join(IN.read_table(spark, folder, "outcomes").agg(F.count(F.lit(1)).alias("rows")))


@reg.add("ing2_bounded_runs", "SELECT 2::BIGINT AS chunks_tried, 3::BIGINT AS chunks_left, count(DISTINCT volume_id) FILTER (NOT failed) AS volumes FROM chunk_log")
def _(spark, sf):
    """Two of five chunk files in a first run; the bound shows, and a second run without one takes the rest."""
    folder = streamed(spark, sf, max_chunks=2)
    tried = IN.attempts(spark, folder).count()
    root = folder.rsplit("/", 1)[0]
    left = IN.ingest(spark, f"{root}/in", SCHEMA, folder, f"{root}/checkpoint")
    return IN.read_table(spark, folder, "accepted").agg(F.count(F.lit(1)).alias("volumes")).select(
        F.lit(tried).cast("bigint").alias("chunks_tried"), F.lit(left).cast("bigint").alias("chunks_left"), "volumes")


@reg.add("ing7_stream_events", f"SELECT * FROM {RECORDS}")
def _(spark, sf):
    return IN.chunk_events(spark, streamed(spark, sf))


@reg.add("ing3_duplicate_arrival", "SELECT count(DISTINCT volume_id) AS volumes, count(DISTINCT volume_id) AS rows FROM chunk_log WHERE NOT failed")
def _(spark, sf):
    return IN.read_table(spark, streamed(spark, sf), "accepted").agg(F.count_distinct("volume_id").alias("volumes"), F.count(F.lit(1)).alias("rows"))


@reg.add("ing4_dead_letter", "SELECT chunk, volume_id, error FROM chunk_log WHERE failed")
def _(spark, sf):
    return IN.read_table(spark, streamed(spark, sf), "failures").select("chunk", "volume_id", "error")
