"""Secret scans with multipart credential linking.

Certain kinds (assignments of a long value, access keys, long hex strings) are always reported. Weak candidates are not: a login, an
endpoint or a short value means little alone. Each candidate plays a role (identifier, secret or endpoint), and a weak one is
reported only if a part with a complementary role starts within the same scope, a stretch of ``scope`` characters on either side:
secrets go with identifiers and endpoints, and the other way round. The search is an interval join on (text, cell of the text).

Positions are code points, ends are exclusive. They come from the lengths of the pieces between matches, so a text of any length and
any number of matches costs one pass. Equal texts are searched once: candidates are rows of a text's md5, and only counts of
characters leave the scan, never text.

Defined results: a NULL text is empty and has no spans; repeated rows get the same spans each; NULL ids are kept; other columns of the
input are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanledger.staging import staged

from .words import whole

# fixed values: the base patterns and their least lengths (of group 2 for assign, of the match for the others)
ASSIGN_KEYS = "password|passwd|secret|token|api_?key"
ASSIGN_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_LEAST = 8

LOGIN_KEYS = "user_?name|user|login|client_?id|account_?id"
PHRASE_KEYS = "passphrase|pwd|private_?key|access_?key|credential"


def either_case(keys: str) -> str:
    """The pattern with each letter in either case, for these letters alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in keys)


#: kind -> (pattern, role, weak). Order decides between spans that start together.
KINDS = {
    "assign": (f"({either_case(ASSIGN_KEYS)}){ASSIGN_VALUE}", "secret", False),
    "access": (f"({ACCESS})()", "identifier", False),
    "hex": (f"({HEX})()", "secret", False),
    "login": (f"({either_case(LOGIN_KEYS)}){ASSIGN_VALUE}", "identifier", True),
    "phrase": (f"({either_case(PHRASE_KEYS)}){ASSIGN_VALUE}", "secret", True),
    "endpoint": (r"(https?://[A-Za-z0-9._:/-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?)()", "endpoint", True),
}
SHORT = "short"  # an assignment whose value is too short to be certain: a weak secret
ORDER = [*KINDS, SHORT]
SCOPE = 200


def _matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<gap, size, value>>: characters before the match (after the last one), in it, and in its second group."""
    lengths = lambda parts: F.transform(parts, lambda p: F.length(p))
    found = F.arrays_zip(lengths(F.slice(F.split(text, pattern), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), 0)))).alias("gap"),
                         lengths(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("size"),
                         lengths(F.regexp_extract_all(text, F.lit(pattern), 2)).alias("value"))
    found = F.transform(found, lambda m: F.struct(m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<gap:int,size:int,value:int>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_md5 and the raw matches of every kind, written to the shared folder: what follows does not touch the texts again."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return staged(rows.select("doc_id", F.md5(text).alias("text_md5"), *[_matches(text, p).alias(k) for k, (p, _, _) in KINDS.items()]))


def candidates(scanned: DataFrame) -> DataFrame:
    """(text_md5, kind, role, weak, start, end) of every candidate in the distinct texts."""
    some = scanned.filter(sum((F.size(k) for k in KINDS), F.lit(0)) > 0).dropDuplicates(["text_md5"])
    def of_kind(k: str) -> Column:
        return F.transform(F.col(k), lambda m, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value")))

    kinds = F.flatten(F.array(*[of_kind(k) for k in KINDS]))
    rows = some.select("text_md5", F.explode(kinds).alias("m")).select("text_md5", "m.*")
    so_far = W.partitionBy("text_md5", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    kind = F.when((F.col("kind") == "assign") & (F.col("value") < ASSIGN_LEAST), F.lit(SHORT)).otherwise(F.col("kind"))
    rows = rows.select("text_md5", kind.alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")
    role = F.create_map(*[F.lit(x) for k in ORDER for x in (k, KINDS[k][1] if k in KINDS else "secret")])
    return rows.select("text_md5", "kind", role[F.col("kind")].alias("role"),
                       F.col("kind").isin([k for k in ORDER if k not in KINDS or KINDS[k][2]]).alias("weak"), "start", "end")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates with a complementary part whose start is at most ``scope`` characters away."""
    cell = F.floor(F.col("start") / scope)
    weak = parts.filter("weak").withColumn("cell", cell)
    other = parts.select(F.col("text_md5").alias("p_md5"), F.col("role").alias("p_role"), F.col("start").alias("p_start"),
                         F.explode(F.array(cell - 1, cell, cell + 1)).alias("p_cell"))
    near = (weak.text_md5 == other.p_md5) & (weak.cell == other.p_cell) & (F.abs(weak.start - other.p_start) <= scope)
    complementary = (weak.role == "secret") != (other.p_role == "secret")
    return weak.join(other, near & complementary, "left_semi").drop("cell")


def joined_spans(spans: Column) -> Column:
    """'kind:start:end' by start, then kind as listed, comma-joined."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(ORDER) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per scanned row: doc_id, text_md5 and ``spans``, ARRAY<STRUCT<kind, start, end>> of everything reported, in no order."""
    parts = candidates(scanned)
    reported = parts.filter("NOT weak").unionByName(linked(parts, scope))
    texts = reported.groupBy("text_md5").agg(F.collect_list(F.struct("kind", "start", "end")).alias("spans"))
    none = F.array().cast(texts.schema["spans"].dataType)
    return scanned.select("doc_id", "text_md5").join(texts, "text_md5", "left").select("doc_id", "text_md5", F.coalesce("spans", none).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    nothing = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def add(done: Column, s: Column) -> Column:
        apart = (s["start"] >= done["at"]) & ((s["start"] > done["at"]) | (done["out"] == ""))
        piece = F.concat(F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(apart, F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"),
                        F.greatest(done["at"], s["end"].cast("bigint")).alias("at"))

    done = F.aggregate(ordered, nothing, add)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The documents with their secrets replaced by a mark; texts without one, and all other columns, stay as they are."""
    spans = secret_spans(scan(docs, id_col, text_col), scope).filter(F.size("spans") > 0).select("text_md5", "spans").dropDuplicates(["text_md5"])
    rows = docs.select(F.struct("*").alias("row"), F.md5(text_col).alias("own_md5"))
    text = F.col(f"row.`{text_col}`")
    return rows.join(spans, F.col("own_md5") == F.col("text_md5"), "left").select(
        *[F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans"))).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
