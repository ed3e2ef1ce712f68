"""Personal data: fixed forms, and identifiers of other forms found by bootstrapped contextual extraction.

Four kinds have a fixed form (mail address, IP address, payment card, phone number) and are always reported. They are also the *seeds* of the method: a
seed and every other string that looks like an identifier (an *instance*: a number of seven digits or more, letters with four digits or more, something with an
``@``) stands in lexical *patterns*, made of the words around it and its coarse type: two words before, one before and one after, one before.

Patterns and instances are a graph of distinct pairs over the whole corpus. Spark scores it in rounds, per kind: a pattern's score is the sum of
its instances' scores divided by their number and one, if at least ``SUPPORT`` different seeds of the kind stand in it; an unseen instance has the
score of its best pattern. Seeds keep 1 for their own kind and 0 for others. After ``ROUNDS`` rounds the unseen instances whose best kind reaches ``CERTAIN`` are
reported wherever they stand, as ``like_email`` and so on. Scores are whole millionths, so that the order of adding up changes nothing.

Texts are read once; what is shuffled are positions and 64-bit hashes of instances and patterns. Pairs are joined on (pattern, slot of the instance) or the
other way round, so that a pattern or an instance that is in a third of all documents is spread over ``SLOTS`` tasks.

Defined results: a NULL or empty text has no spans; repeated rows get the same spans each; NULL ids are kept and other columns ignored. A context is at most
48 characters before and 32 after; a word cut by that edge counts as it stands. Searching takes time in proportion to a text's length, whatever it holds.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from scanledger.staging import staged

KINDS = ("email", "ip", "card", "phone")
LISTED = (*KINDS, *(f"like_{k}" for k in KINDS))
ONE, SUPPORT, CERTAIN, ROUNDS, SLOTS = 1_000_000, 3, 600_000, 3, 16
BEFORE, AFTER = 48, 32

# fixed values: the forms of the four kinds, written so that no match is tried twice at one place
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])++")
LETTERED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{1,20}+[_.-]?[0-9][A-Za-z0-9_.-]*+")
AT = re.compile(r"@[^\s@]*+")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in EMAIL_DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of everything of a fixed form, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def unseen(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of strings that look like identifiers and touch nothing of a fixed form, from left to right and apart from each other."""
    found = []
    for m in AT.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and not text[start - 1].isspace() and text[start - 1] != "@":
            start -= 1
        if start < m.start() and m.end() > m.start() + 1:
            found.append((start, m.end()))
    found += [m.span() for m in LETTERED.finditer(text) if len(NOT_DIGIT.sub("", m[0])) >= 4]
    found += [m.span() for m in NUMBER.finditer(text) if len(NOT_DIGIT.sub("", m[0])) >= 7]
    taken: list[tuple[int, int]] = []  # places of a fixed form, joined where they overlap
    for start, end in sorted((s, e) for _, s, e in base):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    out, last, firsts = [], 0, [s for s, _ in taken]
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        k = bisect_right(firsts, end - 1) - 1
        if start >= last and not (k >= 0 and taken[k][1] > start):
            out.append((start, end))
            last = end
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a place: words in lower case and the type of what stands there."""
    before = [w.lower() for w in WORD.findall(text[max(0, start - BEFORE):start])]
    if not before:
        return []
    after = WORD.search(text, end, end + AFTER)
    what = "at" if "@" in text[start:end] else "id" if WORD.search(text, start, end) else "number"
    out = [f"{before[-1]} <{what}>", f"{before[-1]} <{what}> {after[0].lower() if after else ''}"]
    return out + [f"{before[-2]} {before[-1]} <{what}>"] if len(before) > 1 else out


def hashed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


PLACES = "array<struct<kind:int,start:bigint,`end`:bigint,instance:bigint,patterns:array<bigint>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid (unique) and ``places``: everything of a fixed form (with its kind) and everything that looks like an identifier (kind -1). Staged."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("rid", F.monotonically_increasing_id())
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(f"rid bigint, places {PLACES}").fields])
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    def look(text: str | None) -> list[dict]:
        if not text:
            return []
        base = base_spans(text)
        spots = base + [(-1, s, e) for s, e in unseen(text, base)]
        return [{"kind": k, "start": s, "end": e, "instance": hashed(text[s:e].lower()), "patterns": [hashed(p) for p in patterns(text, s, e)]} for k, s, e in spots]

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                places = pa.array([look(t.as_py()) for t in some.column("text")], kind)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("rid"), places], schema.names)

    return staged(rows.mapInArrow(of_batch, schema))


def of_kinds(make) -> list[Column]:
    return [make(k).alias(f"s{k}") for k in range(len(KINDS))]


def salted_join(rows: DataFrame, few: DataFrame, key: str, other: str) -> DataFrame:
    """Inner join on ``key``; rows of one key are spread over slots of their ``other`` column."""
    left = rows.withColumn("slot", F.pmod(F.col(other), F.lit(SLOTS)).cast("int"))
    return left.join(few.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))), [key, "slot"]).drop("slot")


def discovered(places: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, certain: int = CERTAIN) -> DataFrame:
    """(instance, kind) of the unseen instances that the patterns give away. ``places`` has kind, instance and patterns, one row per place."""
    edges = places.select("instance", F.explode("patterns").alias("pattern")).distinct()
    seeds = places.filter("kind >= 0").groupBy("instance").agg(*of_kinds(lambda k: F.max((F.col("kind") == k).cast("bigint"))))
    edges = staged(edges.join(seeds.withColumnRenamed("instance", "_i"), F.col("instance") == F.col("_i"), "left")
                   .select("pattern", "instance", F.col("_i").isNotNull().alias("seed"), *of_kinds(lambda k: F.coalesce(f"s{k}", F.lit(0)))))
    live = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *of_kinds(lambda k: F.sum(f"s{k}")))
    live = staged(live.filter(F.greatest(*[f"s{k}" for k in range(len(KINDS))]) >= support))
    rest = staged(salted_join(edges.filter("NOT seed").select("pattern", "instance"), live.select("pattern"), "pattern", "instance"))
    scores, extra = None, None
    for _ in range(rounds):
        known = live if extra is None else live.join(extra, "pattern", "left")
        added = lambda k: F.lit(0) if extra is None else F.coalesce(f"x{k}", F.lit(0))
        rated = known.select("pattern", *of_kinds(lambda k: F.when(F.col(f"s{k}") >= support, F.floor((ONE * F.col(f"s{k}") + added(k)) / (F.col("n") + 1))).otherwise(0)))
        scores = staged(salted_join(rest, rated, "pattern", "instance").groupBy("instance").agg(*of_kinds(lambda k: F.max(f"s{k}"))))
        extra = salted_join(rest, scores, "instance", "pattern").groupBy("pattern").agg(*[F.sum(f"s{k}").alias(f"x{k}") for k in range(len(KINDS))])
    best = F.greatest(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("kind")) for k in range(len(KINDS))])
    return scores.select("instance", best.alias("b")).filter(F.col("b.score") >= certain).select("instance", (-F.col("b.kind")).alias("found"))


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, certain: int = CERTAIN) -> DataFrame:
    """Per row: doc_id and ``spans``, ARRAY<STRUCT<kind, start, end>> by kind (as in ``LISTED``) and start; positions are code points, ends exclusive."""
    scanned = scan(docs, id_col, text_col)
    places = scanned.select("rid", F.explode("places").alias("p")).select("rid", "p.*")
    found = discovered(places, rounds=rounds, support=support, certain=certain)
    told = salted_join(places.filter("kind < 0").drop("kind"), found, "instance", "rid")
    told = told.groupBy("rid").agg(F.collect_list(F.struct((F.col("found") + len(KINDS)).alias("kind"), "start", "end")).alias("more"))
    base = F.transform(F.filter("places", lambda p: p["kind"] >= 0), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    spans = scanned.join(told, "rid", "left").select("doc_id", F.array_sort(F.when(F.col("more").isNull(), base).otherwise(F.concat(base, F.col("more")))).alias("spans"))
    names = F.array(*[F.lit(k) for k in LISTED])
    return spans.select("doc_id", F.transform("spans", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def joined(spans: Column) -> Column:
    """'kind:start:end', comma-joined in the order of the spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
