"""Registered queries of the text operators on the given tables, and their SQL forms for DuckDB where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontamination, language_id, lm_scoring, mixing, personal_data, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup,
               token_alignment, url_filter, vector_codes, words)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# ---------------------------------------------------------------------------------------------------------------- 1

MIX_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS source_key, len({WORDS_SQL})::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS k FROM documents),
sizes AS (SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sizes),
weighed AS (
  SELECT *, (CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w, source_size * 2.0::DOUBLE AS most,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM ranked),
filling AS (
  SELECT *, row_number() OVER o AS turn,
         budget - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighed WINDOW o AS (ORDER BY most / w, place)),
level AS (SELECT turn AS t0, rest AS r0, share AS s0 FROM filling WHERE most * share > w * rest ORDER BY turn LIMIT 1),
targets AS (
  SELECT source_key, source_size, CASE WHEN turn >= t0 THEN w * r0 / s0 ELSE most END AS target FROM filling LEFT JOIN level ON true),
queue AS (
  SELECT r.*, source_size, target, row_number() OVER (PARTITION BY r.source_key ORDER BY k, doc_id NULLS FIRST, size) AS no,
         sum(size) OVER (PARTITION BY r.source_key ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start
  FROM rows r JOIN targets USING (source_key)),
copies AS (
  SELECT *, start + p * source_size AS first_word, (start + p * source_size + size) / target AS finish,
         greatest(0, least(size, floor(target)::BIGINT - (start + p * source_size)))::BIGINT AS words
  FROM queue, (VALUES (0), (1)) v(p)),
stream AS (
  SELECT *, sum(words) OVER (ORDER BY finish, source_key, k[1:3], no, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - words AS ahead
  FROM copies WHERE words > 0)
SELECT any_value(c.doc_id) AS doc_id, any_value(c.source) AS source, any_value(c.size) AS size, any_value(c.source_size) AS source_size,
       any_value(c.target) AS target, sum(c.words)::BIGINT AS taken, min(s.ahead)::BIGINT AS "at"
FROM copies c LEFT JOIN stream s ON c.source_key = s.source_key AND c.no = s.no AND c.p = s.p GROUP BY c.source_key, c.no"""


@query("op1_mixing", MIX_SQL)
def op1(spark, sf_dir):
    return mixing.mixed_documents(mixing.schedule(table(spark, sf_dir, "documents"), stage=True))


# ---------------------------------------------------------------------------------------------------------------- 2

_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for s in quality_rules.STOP_WORDS for w in (s, s.capitalize()))
RULES_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, i, w[i:i + 2] AS tri FROM docs, unnest(range(1, len(w) - 1)) u(i)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, tri) > 1),
covered AS (SELECT r, count(DISTINCT i + d)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY r),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM docs LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words >= 50 AND (n_words = 0 OR word_chars::DOUBLE / n_words BETWEEN 2 AND 15) AND (n_words = 0 OR n_symbols::DOUBLE / n_words <= 0.1::DOUBLE)
         AND (n_words = 0 OR n_stop_words::DOUBLE / n_words >= 0.06::DOUBLE) AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.5::DOUBLE)
         AND (n_words = 0 OR n_repeat_words::DOUBLE / n_words <= 0.5::DOUBLE) AS ok FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed, NOT base_failed AND ok AS kept FROM judged"""


@query("op2_quality_rules", RULES_SQL)
def op2(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words",
                         base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"))


# ---------------------------------------------------------------------------------------------------------------- 5


def _secrets_sql() -> str:
    q = lambda p: p.replace("'", "''")
    kinds = "\nUNION ALL ".join(
        f"SELECT '{k}' AS kind, '{role}' AS role, r, t, string_split_regex(t, '{q(p)}') AS gaps, regexp_extract_all(t, '{q(p)}', 0) AS hits, "
        f"regexp_extract_all(t, '{q(p)}', 2) AS vals FROM docs" for k, (p, role, _) in secret_scan.KINDS.items())
    place = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secret_scan.ORDER))
    strong = ", ".join(f"'{k}'" for k, v in secret_scan.KINDS.items() if not v[2])
    agg = lambda cond: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, CASE kind {place} END) FILTER (WHERE {cond}), '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({kinds}),
hit AS (
  SELECT r, kind, role, i, length(gaps[i]) + length(hits[i]) AS step, length(hits[i]) AS size, length(vals[i]) AS value FROM raw, unnest(range(1, len(hits) + 1)) u(i)),
parts AS (
  SELECT r, CASE WHEN kind = 'assign' AND value < {secret_scan.ASSIGN_LEAST} THEN 'short' ELSE kind END AS kind, role,
         (sum(step) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT - size AS start, (sum(step) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS stop FROM hit),
told AS (
  SELECT * FROM parts a WHERE kind IN ({strong}) OR EXISTS (
    SELECT 1 FROM parts b WHERE a.r = b.r AND abs(a.start - b.start) <= {secret_scan.SCOPE} AND (a.role = 'secret') <> (b.role = 'secret')))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (WHERE kind = 'access')::BIGINT AS n_access,
       count(*) FILTER (WHERE kind = 'hex')::BIGINT AS n_hex, sha256({agg(f"kind IN ({strong})")}) AS base_sha256, {agg("kind IS NOT NULL")} AS spans
FROM docs LEFT JOIN told USING (r) GROUP BY r"""


@query("op5_secret_scan", _secrets_sql())
def op5(spark, sf_dir):
    found = secret_scan.secret_spans(secret_scan.scan(table(spark, sf_dir, "documents")))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secret_scan.joined_spans(of("assign", "access", "hex")), 256).alias("base_sha256"),
                        secret_scan.joined_spans(F.col("spans")).alias("spans"))


# ---------------------------------------------------------------------------------------------------------------- 7

# fixed values: the rules of the query
URL_RULES = tuple(url_filter.UrlRule(*r) for r in (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")))
#: Labels of hosts whose pages make up the listing of the query, as the tables have no listing of their own.
LISTED_LABELS = ("casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x")
_FIT = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{}}" for r in sorted(URL_RULES, key=lambda r: -len(r.name)))
URL_SQL = rf"""
WITH rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM rest),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '^(www|m)\.', '') || regexp_replace(path, '(\.html?|/)$', '') END AS url FROM parts),
listing AS (SELECT DISTINCT url FROM named WHERE regexp_matches(host, '(^|\.)({"|".join(LISTED_LABELS)})\.'))
SELECT page_id, host, path, CASE {_FIT.format(*[f"'{r.name}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name))])} END AS rule, coalesce(l.url IS NOT NULL, false) AS listed,
       coalesce(CASE {_FIT.format(*[f"'{r.verdict}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name))])} END, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN listing l ON named.url = l.url"""


@query("op7_url_filter", URL_SQL)
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listing = pages.filter(host.rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\.")).select(url_filter.canonical(host, path).alias("url"))
    return url_filter.judge_urls(pages, listing, URL_RULES).drop("url")

# ---------------------------------------------------------------------------------------------------------------- 6

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PASSAGES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM items, unnest(range(1, greatest(2, len(w) - 8))) u(i) WHERE len(w) > 0),
grams AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM docs, (SELECT DISTINCT n FROM phrases) s, unnest(range(1, len(w) - n + 2)) u(i)),
found AS (SELECT r, i, g.n, item_id FROM grams g JOIN phrases USING (n, p)),
hits AS (SELECT r, count(DISTINCT i + d)::BIGINT AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS d FROM found) GROUP BY r),
named AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


@query("op6_decontamination", PASSAGES_SQL)
def op6(spark, sf_dir):
    marked = decontamination.mark_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, run: n + run["last"] - run["first"])
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


# ---------------------------------------------------------------------------------------------------------------- 8


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


# ---------------------------------------------------------------------------------------------------------------- 4


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (words.crc_slot(F.col("doc_id"), quality_classifier.FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))

# --------------------------------------------------------------------------------------------------------------- 10


@query("op10_simhash")
def op10(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")

# ---------------------------------------------------------------------------------------------------------------- 3


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                       F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

# ---------------------------------------------------------------------------------------------------------------- 9


@query("op9_lm_scoring")
def op9(spark, sf_dir):
    return lm_scoring.score(lm_scoring.fit(table(spark, sf_dir, "documents")))

# --------------------------------------------------------------------------------------------------------------- 11


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT p.id, p.part, p.v, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.entry)) AS hit
  FROM pieces p JOIN book{r} b USING (part) GROUP BY p.id, p.part, p.v)""")
        if r < rounds:
            steps.append(f"""
means{r} AS (
  SELECT part, entry, list(m ORDER BY i) AS v FROM (
    SELECT part, hit.e AS entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM near{r}, unnest(range(1, len(v) + 1)) u(i) GROUP BY ALL) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id ASC NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM kept, unnest(range({parts})) u(part)),
book0 AS MATERIALIZED (SELECT part, id AS entry, v FROM pieces WHERE id < {entries}),{",".join(steps)},
coded AS (
  SELECT id, string_agg(printf('%02x', hit.e), '' ORDER BY part) AS code, sum(hit.d)::BIGINT AS error FROM near{rounds} GROUP BY id),
summed AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (id) GROUP BY label)
SELECT vec_id, code, error, label_error,
       (SELECT sha256(coalesce(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry), '')) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (id) JOIN summed s ON kept.label IS NOT DISTINCT FROM s.label"""


@query("op11_vector_codes", _codes_sql())
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.train_codebooks(vectors)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    return coded.select("vec_id", vector_codes.hex_code(F.col("code")).alias("code"), "error", "label_error",
                        F.sha2(F.lit(vector_codes.written_out(books)), 256).alias("codebooks_sha256"))


# --------------------------------------------------------------------------------------------------------------- 12


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return token_alignment.link_statistics(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------------------------------------------- 13


@query("op13_personal_data")
def op13(spark, sf_dir):
    found = personal_data.personal_spans(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in personal_data.KINDS],
                        F.sha2(personal_data.joined(of(*personal_data.KINDS)), 256).alias("base_sha256"), personal_data.joined(F.col("spans")).alias("spans"))
