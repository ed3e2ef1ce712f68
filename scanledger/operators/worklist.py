"""Worklists: which volumes to ingest, in a reproducible patient order, cut into chunks.

The patient order is the md5 order of ``seed:patient`` over *all* patients, so two kernels share it and a cap
keeps a prefix of it. Positions come from cell-wise prefix sums (``ordering``), never from one global window,
and a patient with very many volumes is ordered cell by cell too.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import order_key
from ..functions.ids import parse_number, patient_number, strip_nifti_ext, volume_repo_path
from ..functions.numeric import count_if
from ..staging import staged
from .kernels import catalog, catalog_counts
from .ordering import first_per, hash_cell, number_cell, positions, prefix_sums, text_cell

COLUMNS = ["chunk", "order", "volume_id", "patient_id", "scan_id", "reconstruction_id", "source_split", "manufacturer", "kernel",
           "kernel_class", "repo_path"]


def memory_gb(target_spacing=(1.5, 0.75, 0.75)) -> Column:
    """Peak GB of a float32 resample (original and result at once), from metadata; NULL when unusable."""
    tz, ty, tx = target_spacing
    rows, cols, n = (F.col(c).try_cast("double") for c in ("Rows", "Columns", "NumberofSlices"))
    xy, z = parse_number(F.col("XYSpacing")), F.col("ZSpacing").try_cast("double")
    original = rows * cols * n
    resampled = (rows * (xy / F.lit(ty))) * (cols * (xy / F.lit(tx))) * (n * (z / F.lit(tz)))
    return (original + resampled) * 4 / F.lit(1e9)


def passes_memory_screen(max_gb: float, target_spacing=(1.5, 0.75, 0.75)) -> Column:
    return F.coalesce(memory_gb(target_spacing) <= F.lit(float(max_gb)), F.lit(True))


def screened_out(meta: DataFrame, max_gb: float, target_spacing=(1.5, 0.75, 0.75)) -> DataFrame:
    """Train-pool volume ids over the memory budget (the first metadata row of a volume decides)."""
    usage = meta.filter("pool = 'train'").select(strip_nifti_ext(F.col("VolumeName")).alias("volume_id"), memory_gb(target_spacing).alias("gb"))
    return usage.groupBy("volume_id").agg(F.min("gb").alias("gb")).filter(F.col("gb") > F.lit(float(max_gb))).select("volume_id")


def natural_order() -> list[Column]:
    return [patient_number(F.col("patient_id")), F.col("scan_id"), F.col("reconstruction_id"), F.col("volume_id")]


def one_per_scan(volumes: DataFrame) -> DataFrame:
    """The lowest reconstruction of every (patient, scan)."""
    return first_per(volumes, ["patient_id", "scan_id"], ["reconstruction_id", "volume_id"])


def patient_order(patients: DataFrame, seed: int) -> DataFrame:
    """Distinct patients with their 0-based position in the seeded order."""
    keyed = patients.select("patient_id").distinct().withColumn("_key", order_key(seed, "patient_id"))
    return positions(keyed, [], hash_cell(F.col("_key")), ["_key", "patient_id"], "rank").drop("_key")


def cap_patients(patients: DataFrame, seed: int, limit: int | None) -> DataFrame:
    """The first ``limit`` patients of the seeded order (all of them without a limit)."""
    if limit is None:
        return patients.select("patient_id").distinct()
    return patient_order(patients, seed).filter(F.col("rank") < limit).select("patient_id")


def in_patient_order(volumes: DataFrame, key: int | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``position`` (within ``keys``): patients in seeded order, a patient's volumes together by scan and reconstruction.

    ``key`` is a seed or an order key column.
    """
    keys = list(keys)
    key = key if isinstance(key, Column) else order_key(key, "patient_id")
    rows = volumes.withColumn("_cell", F.coalesce(text_cell(F.col("scan_id")), F.lit("")))
    # counts of a patient's cells give its number of volumes and the cells' places within it: rows are read for them once and shuffled once more
    cells = rows.groupBy(*keys, "patient_id", "_cell").agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    counts = cells.groupBy(*keys, "patient_id").agg(F.sum("_n").alias("n")).withColumn("_key", key)
    starts = prefix_sums(counts, keys, hash_cell(F.col("_key")), ["_key", "patient_id"], ["n"]).select("patient_id", *keys, F.col("n_before").alias("_start"))
    earlier = Window.partitionBy(*keys, "patient_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.join(starts, ["patient_id", *keys]).select(*keys, "patient_id", "_cell", (F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_place"))
    inside = Window.partitionBy(*keys, "patient_id", "_cell").orderBy("scan_id", "reconstruction_id", "volume_id")
    return rows.join(places, [*keys, "patient_id", "_cell"]).select(*volumes.columns, (F.col("_place") + F.row_number().over(inside) - 1).cast("bigint").alias("position"))


def chunked(ordered: DataFrame, chunk_size: int, first_chunk: Column | int = 0, first_order: Column | int = 0) -> DataFrame:
    """Chunk number, overall order and repository path of ordered volumes."""
    start, order = (x if isinstance(x, Column) else F.lit(x) for x in (first_chunk, first_order))
    return ordered.select(
        (start + F.floor(F.col("position") / chunk_size)).cast("bigint").alias("chunk"), (order + F.col("position")).cast("bigint").alias("order"),
        *COLUMNS[2:-1], volume_repo_path(F.col("volume_id"), F.col("source_split")).alias("repo_path"))


def selected_train(volumes: DataFrame, kernel: str, seed: int, max_patients: int | None) -> DataFrame:
    """One volume of the wanted kernel per scan, of the first patients that have it."""
    wanted = one_per_scan(volumes.filter(F.col("kernel_class") == kernel))
    if max_patients is None:
        return wanted
    return wanted.join(cap_patients(wanted, seed, max_patients), "patient_id", "left_semi").select(*wanted.columns)


def build_worklist(meta: DataFrame, kernel_table: DataFrame, *, chunk_size: int, train_kernel: str = "sharp", seed: int = 0,
                   max_train_patients: int | None = None, max_test_patients: int | None = None, max_combined_gb: float | None = None,
                   train_patients: DataFrame | None = None, stage: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """Test-pool volumes (every reconstruction) first, then train; a chunk never mixes pools.

    ``train_patients`` (patient_id, rank) fixes the train patients and their order instead of the seeded order.
    The selected rows are read several times (caps, patient order, counts), so ``stage`` writes them once before and once after the caps.
    """
    if train_kernel not in ("sharp", "soft"):
        raise ValueError(f"train_kernel must be 'sharp' or 'soft', got {train_kernel!r}")
    volumes = catalog(meta, kernel_table)
    is_test = F.col("source_split") == "valid"
    if max_combined_gb:
        too_big = screened_out(meta, max_combined_gb).withColumn("source_split", F.lit("train"))
        volumes = volumes.join(too_big, ["volume_id", "source_split"], "left_anti").select(*volumes.columns)
    # every test volume is its own unit; of a train scan one volume of the wanted kernel is taken
    wanted = volumes.filter(is_test | (F.col("kernel_class") == train_kernel)).withColumn("_unit", F.when(is_test, F.col("volume_id")).otherwise(""))
    rows = first_per(wanted, ["source_split", "patient_id", "scan_id", "_unit"], ["reconstruction_id", "volume_id"]).drop("_unit")
    seeded = F.when(is_test, order_key(seed + 1, "patient_id")).otherwise(order_key(seed, "patient_id"))
    caps = {"valid": max_test_patients, "train": max_train_patients if train_patients is None else None}
    if any(c is not None for c in caps.values()):
        rows = stage(rows)
        people = rows.select("source_split", "patient_id").distinct().withColumn("_key", seeded)
        ranked = positions(people, ["source_split"], hash_cell(F.col("_key")), ["_key", "patient_id"], "rank")
        keep = F.lit(False)
        for pool, cap in caps.items():
            mine = F.col("source_split") == pool
            keep = keep | (mine if cap is None else mine & (F.col("rank") < cap))
        rows = rows.join(ranked.filter(keep).select("source_split", "patient_id"), ["source_split", "patient_id"], "left_semi").select(*volumes.columns)
    rows = stage(rows)
    n_test = rows.agg(F.count_if(is_test)).scalar()
    if train_patients is None:
        ordered = in_patient_order(rows, seeded, ("source_split",))
    else:
        ordered = in_patient_order(rows.filter(is_test), seed + 1).unionByName(in_given_order(rows.filter(~is_test), train_patients))
    return chunked(ordered, chunk_size, F.when(is_test, 0).otherwise(F.ceil(n_test / chunk_size)), F.when(is_test, 0).otherwise(n_test))


def in_given_order(volumes: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds ``position`` with patients in the order of their ``rank``; patients without one are left out."""
    counts = volumes.groupBy("patient_id").agg(F.count(F.lit(1)).cast("bigint").alias("n")).join(ranked.select("patient_id", "rank"), "patient_id")
    starts = prefix_sums(counts, [], number_cell(F.col("rank")), ["rank"], ["n"]).select("patient_id", F.col("n_before").alias("_start"))
    inside = positions(volumes, ["patient_id"], text_cell(F.col("scan_id")), ["scan_id", "reconstruction_id", "volume_id"], "_inside")
    return inside.join(starts, "patient_id").select(*volumes.columns, (F.col("_start") + F.col("_inside")).alias("position"))


def worklist_summary(meta: DataFrame, kernel_table: DataFrame, worklist: DataFrame, train_kernel: str = "sharp") -> DataFrame:
    """Long counters of a plan: what was available, skipped and selected."""
    volumes = catalog(meta, kernel_table)
    counts = catalog_counts(meta).agg(F.sum("unparsable").alias("skipped_unparsable"), F.sum("wrong_pool").alias("skipped_wrong_pool"))
    wanted = F.col("kernel_class") == train_kernel
    per_scan = volumes.filter("source_split = 'train'").groupBy("patient_id", "scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(wanted).alias("has"))
    per_patient = per_scan.groupBy("patient_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scans"),
                                                     F.count_if("has").alias("with_kernel"), F.bool_or("has").alias("has"))
    train = per_patient.agg(
        F.sum("n").alias("train_volumes_available"), F.count(F.lit(1)).alias("train_patients_available"), F.sum("scans").alias("train_scans_total"),
        F.sum("with_kernel").alias("train_scans_selected"), (F.sum("scans") - F.sum("with_kernel")).alias("train_scans_skipped_no_kernel"),
        count_if(~F.col("has")).alias("train_patients_without_kernel"))
    planned = worklist.groupBy("source_split", "patient_id", "kernel_class", "chunk").agg(F.count(F.lit(1)).alias("n"))
    test_row = F.col("source_split") == "valid"
    chosen = planned.agg(
        F.sum(F.when(test_row, F.col("n"))).alias("test_volumes"), F.count_distinct(F.when(test_row, F.col("patient_id"))).alias("test_patients"),
        F.count_distinct(F.when(test_row, F.col("chunk"))).alias("test_chunks"),
        *[F.coalesce(F.sum(F.when(test_row & (F.col("kernel_class") == k), F.col("n"))), F.lit(0)).alias(f"test_{k}") for k in ("sharp", "soft", "other")],
        F.sum(F.when(~test_row, F.col("n"))).alias("train_volumes"), F.count_distinct(F.when(~test_row, F.col("patient_id"))).alias("train_patients"),
        F.count_distinct(F.when(~test_row, F.col("chunk"))).alias("train_chunks"), F.sum("n").alias("total_volumes"),
        F.count_distinct("chunk").alias("total_chunks"))
    parts = [counts, train, chosen]
    return _stack(parts)


def _stack(frames: list[DataFrame]) -> DataFrame:
    """One-row frames as (name, value) rows."""
    out = None
    for f in frames:
        long = f.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("value")) for c in f.columns])))
        out = long if out is None else out.unionByName(long)
    return out


def storage_projection(worklist: DataFrame, cached: DataFrame, mb_per_volume: float) -> DataFrame:
    """Volumes already cached, still to fetch, and the projected cache size."""
    rows = worklist.select("volume_id").join(cached.select("volume_id", F.lit(True).alias("_cached")).distinct(), "volume_id", "left")
    n, done = F.count(F.lit(1)), count_if(F.col("_cached"))
    return rows.agg(n.cast("bigint").alias("volumes"), done.alias("cached"), (n - done).cast("bigint").alias("to_fetch"),
                    (n * F.lit(float(mb_per_volume)) / 1000).alias("projected_gb"), ((n - done) * F.lit(float(mb_per_volume)) / 1000).alias("to_fetch_gb"))


def patients_with_kernel(volumes: DataFrame, kernel: str) -> DataFrame:
    return volumes.filter((F.col("source_split") == "train") & (F.col("kernel_class") == kernel)).select("patient_id").distinct()


def child_patients(parent: DataFrame, available: DataFrame, quotas: dict[str, int], seed: int) -> DataFrame:
    """A seeded draw from each of the parent's splits among the available patients, mixed into one order."""
    quota = F.create_map(*[x for s, n in quotas.items() for x in (F.lit(s), F.lit(n))])
    pool = parent.filter(F.col("split").isin(*quotas)).join(available.select("patient_id").distinct(), "patient_id", "left_semi")
    drawn = positions(pool.select("patient_id", "split", order_key(seed, "patient_id").alias("_key")), ["split"],
                      hash_cell(F.col("_key")), ["_key", "patient_id"], "_pick").filter(F.col("_pick") < quota[F.col("split")])
    mixed = drawn.select("patient_id", "split", order_key(f"{seed}:mix", "patient_id").alias("_mix"))
    return positions(mixed, [], hash_cell(F.col("_mix")), ["_mix", "patient_id"], "rank").drop("_mix")


def child_shortfall(parent: DataFrame, available: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Splits that hold fewer available patients than asked for; empty when the draw is possible."""
    pool = parent.join(available.select("patient_id").distinct(), "patient_id", "left_semi").groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("available"))
    asked = parent.sparkSession.createDataFrame(list(quotas.items()), "split string, asked bigint")
    return asked.join(pool, "split", "left").select("split", "asked", F.coalesce("available", F.lit(0)).alias("available")).filter("asked > available")


def survey_sample(volumes: DataFrame, pairs_per_kernel: int, seed: int = 0, stage: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """Scans with exactly two reconstructions such that every (manufacturer, kernel) pair has up to n of them.

    Rare pairs come first, and a scan counts for both of its pairs. All pairs choose at once, each leaving out what pairs before it
    chose in the round before. A round settles at least the first pair that was not settled, in practice nearly all, and when a round changes
    nothing, every pair's choice agrees with all choices before it. A choice is a row-number limit that Spark applies before the shuffle.
    """
    sides = _survey_sides(volumes, seed)
    sizes = sides.groupBy("pair").agg(F.count(F.lit(1)).alias("size"))
    sides = stage(sides.join(sizes, "pair").select("patient_id", "scan_id", "key", "pair", F.struct("size", "pair").alias("turn")))
    chosen, before, now = sides.limit(0), None, (0, None)
    while now != before:
        chosen = stage(_survey_round(sides, chosen, pairs_per_kernel))
        before, now = now, tuple(chosen.agg(F.count(F.lit(1)), F.sum(F.xxhash64("patient_id", "scan_id", "pair").cast("decimal(38,0)"))).first())
    return chosen.select("patient_id", "scan_id", F.col("pair").alias("served"))


def _survey_round(sides: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """What every pair chooses if the pairs before it choose ``chosen``."""
    taken = chosen.groupBy("patient_id", "scan_id").agg(F.min("turn").alias("taken"))
    seen = sides.join(taken, ["patient_id", "scan_id"], "left").withColumn("mine", F.coalesce(F.col("taken") < F.col("turn"), F.lit(False)))
    have = seen.filter("mine").groupBy("pair").agg(F.count(F.lit(1)).alias("have"))
    place = F.row_number().over(Window.partitionBy("pair").orderBy("key", "patient_id", "scan_id"))
    first = seen.filter("NOT mine").withColumn("place", place).filter(F.col("place") <= n)
    return first.join(have, "pair", "left").filter(F.col("place") <= n - F.coalesce("have", F.lit(0))).select(*sides.columns)


def _survey_sides(volumes: DataFrame, seed: int) -> DataFrame:
    """Training scans with two reconstructions, once per pair they show, with their seeded order."""
    name = F.concat_ws("\t", F.coalesce("manufacturer", F.lit("")), F.coalesce("kernel", F.lit("")))
    scans = volumes.filter("source_split = 'train'").groupBy("patient_id", "scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(name).alias("a"), F.max(name).alias("b")).filter("n = 2")
    return scans.select("patient_id", "scan_id", order_key(seed, "patient_id", "scan_id").alias("key"), F.explode(F.array_distinct(F.array("a", "b"))).alias("pair"))


def survey_worklist(volumes: DataFrame, chosen: DataFrame, chunk_size: int) -> DataFrame:
    """Both reconstructions of the chosen scans in natural order, chunked."""
    rows = volumes.join(chosen.select("patient_id", "scan_id"), ["patient_id", "scan_id"], "left_semi").select(*volumes.columns)
    number = patient_number(F.col("patient_id"))
    ordered = positions(rows.withColumn("_n", number), [], number_cell(F.col("_n")), ["_n", "scan_id", "reconstruction_id", "volume_id"])
    return chunked(ordered.drop("_n"), chunk_size)
