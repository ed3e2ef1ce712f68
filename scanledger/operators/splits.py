"""Train / val / test by patient: drawn once, frozen, topped up, applied."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import order_key
from ..functions.numeric import count_if
from ..staging import staged
from .ordering import hash_cell, positions

SPLITS = ("train", "val", "test")
ROWS_PER_TASK = 500_000


def unknown_splits(existing: DataFrame) -> DataFrame:
    """Frozen rows with a split label that does not exist; empty when usable."""
    return existing.filter(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))


def _needs(existing: DataFrame, forced: DataFrame, n_val: int, n_test: int) -> DataFrame:
    kept = existing.join(forced.select("patient_id").distinct(), "patient_id", "left_anti")
    return kept.agg(F.greatest(F.lit(n_val) - F.count_if(F.col("split") == "val"), F.lit(0)).alias("need_val"),
                    F.greatest(F.lit(n_test) - F.count_if(F.col("split") == "test"), F.lit(0)).alias("need_test"))


def new_candidates(patients: DataFrame, existing: DataFrame, forced: DataFrame) -> DataFrame:
    """Patients without a frozen split, with the forced split of those that have one."""
    rules = forced.groupBy("patient_id").agg(F.min("split").alias("forced"))
    return patients.select("patient_id").distinct().join(existing, "patient_id", "left_anti").join(rules, "patient_id", "left")


def plan_split(patients: DataFrame, existing: DataFrame, forced: DataFrame, *, n_val: int, n_test: int, seed: int) -> DataFrame:
    """The whole patient -> split table: frozen rows kept, rules first, quotas filled in seeded order, rest train.

    The quotas are totals over drawn patients: frozen ones count, forced ones do not.
    """
    new = new_candidates(patients, existing, forced)
    drawn = positions(new.filter("forced IS NULL").select("patient_id", order_key(seed, "patient_id").alias("_key")), [],
                      hash_cell(F.col("_key")), ["_key", "patient_id"], "_rank")
    needs = _needs(existing, forced, n_val, n_test)
    need_test, need_val = needs.select("need_test").scalar(), needs.select("need_val").scalar()
    split = F.when(F.col("_rank") < need_test, "test").when(F.col("_rank") < need_test + need_val, "val").otherwise("train")
    return (existing.select("patient_id", "split")
            .unionByName(new.filter("forced IS NOT NULL").select("patient_id", F.col("forced").alias("split")))
            .unionByName(drawn.select("patient_id", split.alias("split"))))


def split_shortfall(patients: DataFrame, existing: DataFrame, forced: DataFrame, *, n_val: int, n_test: int) -> DataFrame:
    """One row with needs and candidates when there are too few patients; empty when the plan is possible."""
    needs = _needs(existing, forced, n_val, n_test)
    n = new_candidates(patients, existing, forced).filter("forced IS NULL").agg(F.count(F.lit(1))).scalar()
    return needs.select(F.col("need_val").cast("bigint").alias("need_val"), F.col("need_test").cast("bigint").alias("need_test"),
                        n.cast("bigint").alias("candidates")).filter("need_val + need_test > candidates")


def usable_rows(manifest: DataFrame, qc: DataFrame | None, tasks: int | None = None) -> DataFrame:
    """Manifest rows whose volume passed quality control (all of them without a report), joined in ``tasks`` tasks where given."""
    if qc is None:
        return manifest
    passed = qc.filter(F.col("passed")).select("volume_id")
    # the report's side is cut: a semi join is pushed below a repartition of the manifest
    return manifest.join(passed.repartition(tasks, "volume_id") if tasks else passed, "volume_id", "left_semi")


def split_counts(people: DataFrame, mapping: DataFrame) -> DataFrame:
    """Patients and volumes per split; ``people`` has one row per patient with its number ``n`` of usable volumes."""
    return people.join(mapping, "patient_id").groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("patients"), F.sum("n").cast("bigint").alias("volumes"))


def apply_splits(manifest: DataFrame, splits: DataFrame, qc: DataFrame | None = None) -> DataFrame:
    """Adds ``split``: excluded when quality control failed or never saw the volume, unassigned without a frozen row."""
    out = manifest.drop("split", "qc_passed") if qc is not None else manifest.drop("split")
    frozen = splits.select(F.col("source_name").alias("_source"), F.col("patient_id").alias("_patient"), F.col("split").alias("_split"))
    out = out.join(frozen, (F.col("source_name") == F.col("_source")) & (F.col("patient_id") == F.col("_patient")), "left")
    split: Column = F.coalesce("_split", F.lit("unassigned"))
    if qc is not None:
        report = qc.groupBy(F.col("volume_id").alias("_volume")).agg(F.bool_and("passed").alias("qc_passed"))
        out = out.join(report, F.col("volume_id") == F.col("_volume"), "left").drop("_volume")
        split = F.when(~F.coalesce("qc_passed", F.lit(False)), "excluded").otherwise(split)
    return out.withColumn("split", split).drop("_source", "_patient", "_split")


def overlapping_patients(manifest: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Patients with volumes in more than one split, per source; empty when there is no leak."""
    keys = [c for c in ("source_name", patient) if c in manifest.columns]
    return manifest.filter(F.col("split").isin(*SPLITS)).groupBy(*keys).agg(
        F.count_distinct("split").cast("bigint").alias("n_splits")).filter("n_splits > 1")


def assign_source_splits(manifest: DataFrame, qc: DataFrame | None, existing: DataFrame, *, n_val: int, n_test: int, seed: int,
                         official_test: bool = True, stage: Callable[[DataFrame], DataFrame] = staged) -> dict[str, DataFrame]:
    """Mapping, counts per split and number of unusable volumes of one source.

    The patients with their usable volumes feed every result, so ``stage`` writes that table once. Volumes meet their report in
    tasks of about ``ROWS_PER_TASK`` volumes, however many there are (one count of the manifest).
    """
    tasks = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // ROWS_PER_TASK))
    usable = usable_rows(manifest, qc, tasks)
    official = F.bool_or(F.col("source_split") == "valid") if official_test else F.lit(False)
    people = stage(usable.groupBy("patient_id").agg(official.alias("official"), F.count(F.lit(1)).alias("n")))
    forced = people.filter("official").select("patient_id", F.lit("test").alias("split"))
    mapping = plan_split(people, existing, forced, n_val=n_val, n_test=n_test, seed=seed)
    unusable = usable.select("volume_id", F.lit(True).alias("_ok")).distinct()
    report = manifest.select("volume_id").join(unusable, "volume_id", "left").agg(
        F.count(F.lit(1)).cast("bigint").alias("volumes"), count_if(F.col("_ok").isNull()).alias("unusable_volumes"))
    return {"mapping": mapping, "counts": split_counts(people, mapping), "report": report,
            "shortfall": split_shortfall(people, existing, forced, n_val=n_val, n_test=n_test)}
