"""Names, paths and keys: volume ids, kernels, label names, scan ids, file kinds."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# fixed values: the volume naming scheme and the file suffixes of the data sources
VOLUME_ID = r"^(?:train|valid)_\d++_[a-z]++_\d++$"  # no groups and no backtracking: every id is matched
NIFTI_SUFFIX = r"\.nii(\.gz)?$"
DICOM_SUFFIXES = ("dcm", "dicom", "ima")
ARCHIVE_SUFFIX = r"(?i)\.(tar\.gz|tgz|zip|tar)$"
KERNEL_TOKEN = r"[A-Za-z0-9_.+-]+"
NUMBER = r"[-+]?\d*\.?\d+"
# fixed values: words and letter codes that hint at a kernel's purpose
LUNG_WORDS = ("HRCT", "PARANKIM", "LUNG")
SOFT_WORDS = ("MEDIASTEN",)
SIEMENS_NAMES = ("siemens healthineers", "siemens")
SHARP_CODES = ("YA", "L", "YB", "EA", "LUNGB", "E")
SOFT_CODES = ("B", "A", "SA")


def strip_nifti_ext(name: Column) -> Column:
    """Drop one trailing ``.nii.gz`` or ``.nii``."""
    return F.when(F.endswith(name, F.lit(".nii.gz")), F.left(name, F.length(name) - 7)).when(
        F.endswith(name, F.lit(".nii")), F.left(name, F.length(name) - 4)).otherwise(name)


def is_volume_id(volume_id: Column) -> Column:
    return F.coalesce(volume_id.rlike(VOLUME_ID), F.lit(False))


def volume_id_parts(volume_id: Column) -> dict[str, Column]:
    """Columns of a well-formed id: pool, patient, scan, reconstruction. Filter by is_volume_id first."""
    def part(i: int) -> Column:
        return F.split_part(volume_id, F.lit("_"), F.lit(i))
    return {
        "patient_id": F.substring_index(volume_id, "_", 2),
        "scan_id": part(3),
        "reconstruction_id": part(4).try_cast("bigint"),
        "source_split": part(1),
    }


def patient_number(patient_id: Column) -> Column:
    return F.substring_index(patient_id, "_", -1).try_cast("bigint")


def volume_repo_path(volume_id: Column, pool: Column) -> Column:
    """Nested path of one volume below its pool's folder; NULL when the id is not from that pool."""
    patient, scan = (F.substring_index(volume_id, "_", n) for n in (2, 3))  # a folder's name holds that of the folder above
    path = F.concat(F.lit("dataset/"), pool, F.lit("_fixed/"), patient, F.lit("/"), scan, F.lit("/"), volume_id, F.lit(".nii.gz"))
    return F.when(is_volume_id(volume_id) & (F.substring_index(volume_id, "_", 1) == pool), path)


def normalize_kernel(raw: Column) -> Column:
    """First token of whatever the metadata holds; '' when there is none."""
    return F.coalesce(F.regexp_extract(raw, f"({KERNEL_TOKEN})", 1), F.lit(""))


def kernel_key(manufacturer: Column, kernel: Column) -> tuple[Column, Column]:
    return F.lower(F.trim(F.coalesce(manufacturer, F.lit("")))), F.lower(normalize_kernel(kernel))


def draft_kernel_class(manufacturer: Column, kernel: Column, description: Column) -> Column:
    """A first guess at sharp / soft / other: purpose words, then vendor naming rules, then letter codes."""
    words = F.upper(F.coalesce(description, F.lit("")))
    name = normalize_kernel(kernel)
    vendor = F.lower(F.trim(F.coalesce(manufacturer, F.lit("")))).isin(*SIEMENS_NAMES)

    def any_word(options):
        hit = F.lit(False)
        for word in options:
            hit = hit | words.contains(word)
        return hit

    smooth_number = F.regexp_extract(name, r"^(?:Br|Bv|Qr|Hc)(\d+)", 1)
    plain_number = F.regexp_extract(name, r"^B(\d+)s", 1)

    def by_number(number, sharp_from):
        return F.when(number.try_cast("int") >= sharp_from, "sharp").otherwise("soft")

    return (F.when(any_word(LUNG_WORDS), "sharp")
            .when(any_word(SOFT_WORDS), "soft")
            .when(vendor & name.rlike("^(Bl|Hr)"), "sharp")
            .when(vendor & (smooth_number != ""), by_number(smooth_number, 56))
            .when(vendor & (plain_number != ""), by_number(plain_number, 60))
            .when(F.upper(name).isin(*SHARP_CODES), "sharp")
            .when(F.upper(name).isin(*SOFT_CODES), "soft")
            .otherwise("other"))


def label_column(name: Column) -> Column:
    """``Medical material`` -> ``label_medical_material``."""
    snake = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_")
    return F.concat(F.lit("label_"), F.regexp_replace(snake, r"^_+|_+$", ""))


def label_column_name(name: str) -> str:
    """The same rule for a column name of the schema."""
    return "label_" + re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def parse_number(text: Column) -> Column:
    """First number inside a string, NULL when there is none."""
    return F.regexp_extract(text, f"({NUMBER})", 1).try_cast("double")


def clean_key(key: Column) -> Column:
    """Trim, then drop trailing path separators."""
    return F.regexp_replace(F.trim(key), r"[/\\]+$", "")


def text_is_true(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def known_number(value: Column) -> Column:
    """A number or NULL: text that is no number and NaN both mean missing."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def _safe(part: Column) -> Column:
    return F.regexp_replace(part, r"[^A-Za-z0-9._-]", "-")


def scan_id(scan_path: Column, series_uid: Column | None = None) -> Column:
    """Filesystem-safe id of a relative scan path, with the tail of the series uid when given."""
    parts = F.filter(F.split(F.regexp_replace(scan_path, r"(?i)\.nii(\.gz)?$", ""), "/"),
                     lambda p: (p != "") & (p != "."))
    joined = F.array_join(F.transform(parts, _safe), "_")
    base = F.when(joined == "", F.lit("root")).otherwise(joined)
    if series_uid is None:
        return base
    tail = F.concat(F.lit("_s"), F.right(_safe(series_uid), F.lit(8)))
    return F.when(F.coalesce(series_uid, F.lit("")) == "", base).otherwise(F.concat(base, tail))


def patient_key(scan_path: Column, depth: int = 1) -> Column:
    """First folder levels of a scan path; a scan without a folder is its own patient."""
    parts = F.filter(F.split(scan_path, "/"), lambda p: p != "")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(folders) == 0, scan_id(scan_path)).otherwise(
        F.array_join(F.transform(F.slice(folders, 1, max(1, depth)), _safe), "_"))


def archive_chunk_id(name: Column) -> Column:
    """Archive file name without its suffix; NULL for other files."""
    return F.when(name.rlike(ARCHIVE_SUFFIX), F.regexp_replace(name, ARCHIVE_SUFFIX, ""))


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_dicom_name(path: Column) -> Column:
    return file_suffix(path).isin(*DICOM_SUFFIXES)


def has_dicom_marker(content: Column) -> Column:
    """The marker at byte 129, for files whose name does not tell; False for NULL."""
    return F.coalesce(F.substring(content, 129, 4) == F.lit("DICM").cast("binary"), F.lit(False))


def is_nifti_name(path: Column) -> Column:
    return F.lower(path).rlike(NIFTI_SUFFIX)


def eval_key(name: Column, train_source: Column, train_run: Column) -> Column:
    """``source__run__split`` -> split, or ``source.run.split`` when it is not the training run."""
    parts = F.split(name, "__")
    source, run = F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    split = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    return F.when((source == train_source) & (run == train_run), split).otherwise(metric_key(source, run, split))


def metric_key(*parts: Column) -> Column:
    """Dotted key of the non-empty parts; characters a metric name may not hold become ``_``."""
    kept = F.filter(F.array(*[p.cast("string") for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.regexp_replace(F.array_join(kept, "."), r"[^\p{L}\p{N}_\-./ ]", "_")
