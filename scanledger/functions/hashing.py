"""Reproducible draws and fingerprints.

Random choices in this library are hash choices: the order of ids is the order of
``md5("<seed>:<id>")``, and a uniform number is the first 32 bits of an md5. The same
seed gives the same order on any cluster, a cap keeps a prefix of that order, and a
lost executor recomputes the same rows.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def order_key(seed: int | str, *ids: Column | str) -> Column:
    """Sort key of the seeded order of ids."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash32(text: Column) -> Column:
    """First 32 bits of md5(text) as BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash01(text: Column) -> Column:
    """Uniform double in [0, 1) from md5(text)."""
    return hash32(text).cast("double") / F.lit(4294967296.0)


def id_hash(value: Column) -> Column:
    """First 12 hex digits of sha256(id); '' when the id is absent."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(F.substring(F.sha2(value, 256), 1, 12))


def settings_fingerprint(settings: Column, *, ignore: tuple[str, ...] = (), length: int = 16) -> Column:
    """Short sha256 of a MAP<STRING,STRING> of settings: keys sorted, ignored keys left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(settings, lambda k, _: ~k.isin(*ignore)) if ignore else settings))
    text = F.array_join(F.transform(entries, lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('": "'), F.coalesce(e["value"], F.lit("null")), F.lit('"'))), ", ")
    return F.substring(F.sha2(F.concat(F.lit("{"), text, F.lit("}")), 256), 1, length)


def run_id(name: Column, config_hash: Column, seed: Column) -> Column:
    """``<name>/<first 8 of hash>/seed<seed>``."""
    return F.concat(name, F.lit("/"), F.substring(config_hash, 1, 8), F.lit("/seed"), seed.cast("string"))
