"""URL filters: a listing of canonical URLs behind a blocked Bloom filter, and rules on host and path.

The listing is hashed into blocks of 256 bits, one bit in each of four words. A URL is sent to the one block it can be in (an equi-join on
the block number, so nothing needs to be broadcast and the filter may grow with the listing); those whose four bits are all set
go on to an exact hash join on the canonical URL, which removes the false positives. URLs are made distinct first, so
a hot URL is looked up once.

Defined results: a NULL url, or one without ``://``, has an empty host and path, fits no rule, is never listed and is allowed; repeated rows
are judged each; an empty listing blocks nothing. Other columns of the input are ignored.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .words import lower_ascii


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without user, port, ``www.`` and ``m.``, and path without a closing slash or ``.html``; NULL for an empty host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"^(www|m)\.", "")
    return F.when(host != "", F.concat(name, F.regexp_replace(path, r"(\.html?|/)$", "")))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """STRUCT<rule, verdict> of the longest rule that fits the host (or a parent of it) and the path; NULL where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _shift(word: Column, by: Column) -> Column:
    return F.call_function("shiftleft", word, by)


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the canonical URLs in ``listed.url``."""
    return listed.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits_of(F.col("url")))]).groupBy("block").agg(
        *[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(4)])


def bits_of(url: Column) -> list[Column]:
    """The bit of the URL in each of the four words of its block."""
    h = F.xxhash64(url, F.lit("bits"))
    return [_shift(F.lit(1).cast("bigint"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) for i in range(4)]


def listed_urls(urls: DataFrame, listing: DataFrame, urls_per_block: int = 20) -> DataFrame:
    """The distinct URLs in ``urls.url`` that are in ``listing.url``; both canonical, NULLs are left out."""
    wanted, listed = urls.filter(F.col("url").isNotNull()).select("url").distinct(), listing.filter(F.col("url").isNotNull()).select("url").distinct()
    blocks = max(1, -(-listed.count() // urls_per_block))
    hits = wanted.select("url", F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits_of(F.col("url")))])
    hits = hits.join(bloom_blocks(listed, blocks), "block")
    for i in range(4):
        hits = hits.filter(F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0)
    return hits.select("url").join(listed, "url", "left_semi")


def judge_urls(pages: DataFrame, listing: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, canonical url, rule, ``listed`` and verdict (the rule's, else block where listed)."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("*", canonical(F.col("host"), F.col("path")).alias("url"), rule_of(F.col("host"), F.col("path"), rules).alias("_rule"))
    found = listed_urls(rows, listing).withColumn("_listed", F.lit(True))
    listed = F.coalesce(F.col("_listed"), F.lit(False))
    return rows.join(found, "url", "left").select("page_id", "host", "path", "url", F.col("_rule.rule").alias("rule"), listed.alias("listed"),
                                                  F.coalesce(F.col("_rule.verdict"), F.when(listed, "block").otherwise("allow")).alias("verdict"))
