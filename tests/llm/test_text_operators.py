"""Text operators against brute force, held-out accuracy and the defined results for awkward input."""
import itertools
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scanledger.llm import (components, decontamination, language_id, lm_scoring, mixing, quality_classifier, quality_rules, secret_scan,
                            simhash, suffix_dedup, url_filter)
from scanledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 4999}" for i in range(60_000))
AWKWARD = [
    (1, "The cat sat on the mat and looked at the dog near the house of the man", "en", "b"),
    (1, "The cat sat on the mat and looked at the dog near the house of the man", "en", "b"),
    (2, None, "en", "a"), (3, "", None, None), (4, " \t\n\x0b ", "en", None), (None, "nobody knows the id of this text at all", "en", "a"),
    (5, LONG, "en", "a"), (6, "Ünïcödé ﬀ 漢字 \U0001f600 ключ", None, "c"), (7, "1234 5678", "de", "c"),
    (8, "The cat sat on the mat and looked at the dog near the house of the man", "en", "c"), (None, None, None, None),
]


def documents(spark, rows=AWKWARD):
    """Rows as documents, with further columns that clash with names used inside the operators."""
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], COLUMNS)
    for name in ("size", "taken", "kept", "words", "fingerprint", "slab", "id", "ids", "h", "s", "w", "u", "v", "cell", "no", "key", "runs", "items", "spans",
                 "text_md5", "score", "lang_pred", "failed", "node", "root", "bucket", "_hash", "_range"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return documents(spark).limit(0)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


# ---------------------------------------------------------------- 1
def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 37), None, ("a", "b", "c", None)[min(i % 9, 3)]) for i in range(400)]
    got = mixing.mixed_documents(mixing.schedule(documents(spark, rows))).collect()
    assert len(got) == 400 and all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for source, mine in by.items():
        assert len({r.target for r in mine}) == 1 and mine[0].source_size == sum(r.size for r in mine)
        assert mine[0].target - 1 < sum(r.taken for r in mine) <= mine[0].target <= 2 * mine[0].source_size
    total = sum(r.size for r in got)
    assert sum(m[0].target for m in by.values()) == pytest.approx(1.5 * total)
    open_ = {s: m[0].target / w for (s, m), w in zip(sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")), (3, 1, 2, 3)) if m[0].target < 2 * m[0].source_size}
    assert len({round(x, 6) for x in open_.values()}) == 1  # sources that are not full share by weight
    again = mixing.mixed_documents(mixing.schedule(documents(spark, rows).repartition(5))).collect()
    assert sorted((r.doc_id, r.taken, r.at) for r in got if r.at is not None) == sorted((r.doc_id, r.taken, r.at) for r in again if r.at is not None)
    ahead = sorted((r.ahead, r.words) for r in mixing.stream(mixing.schedule(documents(spark, rows))).collect())
    assert [a for a, _ in ahead] == [0, *np.cumsum([w for _, w in ahead])[:-1].tolist()]


def test_mix_of_awkward_documents(spark):
    got = mixing.mixed_documents(mixing.schedule(documents(spark), stage=True)).collect()
    assert len(got) == len(AWKWARD) and all(r.taken == 0 for r in got if r.size == 0)
    assert {r.size for r in got if r.doc_id in (2, 3, 4)} == {0} and max(r.size for r in got) == 60_000
    assert mixing.mixed_documents(mixing.schedule(empty(spark))).count() == 0
    only = mixing.mixed_documents(mixing.schedule(documents(spark, [(1, None, None, None)]))).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)]


# ---------------------------------------------------------------- 2
def brute_measures(text):
    w, lines = spaced(text), [x for x in (text or "").split("\n") if spaced(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark, given):
    rows = [*AWKWARD, (9, "a b c a b c d\nx x x x\nx x x x\n\n \n", None, None), (10, "##x $ %", None, None), (11, "a b", None, None)]
    got = quality_rules.judge(documents(spark, rows)).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(brute_measures(r[1]) for r in rows)
    assert quality_rules.judge(empty(spark)).count() == 0
    assert {r.kept for r in quality_rules.judge(documents(spark), rules=[]).collect()} == {True}


def test_quality_rules_keep_clean_documents(spark):
    judged = QUERIES["op2_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("NOT base_failed")
    assert judged.filter("kept <> (quality = 1)").isEmpty() and not judged.isEmpty()


# ---------------------------------------------------------------- 3
def brute_repeats(rows):
    earliest = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            earliest[raw[p:p + 50]] = min(i, earliest.get(raw[p:p + 50], i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if earliest[raw[p:p + 50]] < i:
                gone[p:p + 50] = True
        out.append((i, len(raw), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("slab_bytes", [1 << 22, 5_000])
def test_repeats_equal_brute_force(spark, given, slab_bytes):
    rows = [(r.doc_id, r.text) for r in given]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), slab_bytes=slab_bytes).collect()
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == sorted(brute_repeats(rows))


def test_repeats_of_periodic_and_awkward_texts(spark):
    draw = random.Random(2)
    passage = "".join(draw.choice("abcdé \n") for _ in range(140))
    rows = [(i, ("ab" * draw.randrange(60)) + passage[draw.randrange(60):draw.randrange(70, 140)] + "xyz" * draw.randrange(40)) for i in range(60)]
    rows += [(7, passage), (7, passage), (61, "é" * 80), (62, "é" * 40), (63, "a" * 49), (64, "a" * 50), (65, "a" * 51), (66, None), (67, "")]
    got = suffix_dedup.remove_repeats(documents(spark, [(*r, None, None) for r in rows]), slab_bytes=700).collect()
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == sorted(brute_repeats(rows))
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    whole = suffix_dedup.remove_repeats(documents(spark)).collect()
    assert len(whole) == len(AWKWARD) and [len(r.kept) for r in whole if r.doc_id == 8] == [0]


def test_repeats_around_hot_anchors(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    phrase, tails = word(40), [word(60) for _ in range(5)]
    rows = [(i % 290, word(draw.randrange(60)) + phrase + (tails[i % 5][:draw.randrange(60)] if i % 3 else "") + word(draw.randrange(60))) for i in range(300)]
    for hot in (1, 3, 1000):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), slab_bytes=2000, hot_pieces=hot).collect()
        assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == sorted(brute_repeats(rows))


def test_no_bucket_gets_all_surroundings_of_a_hot_anchor():
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    phrase = word(49)
    ids, texts = pa.array(range(3000)), pa.array([word(40) + phrase + word(40) for _ in range(3000)])
    first = [(b, list(suffix_dedup._who_is_first([0], [body]))[0][1]) for b, body in suffix_dedup._first_question(8)(0, ids, texts, {})]
    asked = list(suffix_dedup._second_question(8)(0, ids, texts, {"first": dict(first)}))
    pieces = [len(suffix_dedup.unpack(body)[0]) for b, body in asked if b < 8]
    strings = [len(suffix_dedup.unpack(body)[0]) for b, body in asked if b >= 8]
    assert max(pieces, default=0) < 1500 and len(strings) == 8 and max(strings) < 1.5 * sum(strings) / 8


def test_previous_factors_equal_their_definition():
    draw = np.random.default_rng(3)
    text = draw.integers(0, 2, 200)
    doc = np.repeat(draw.permutation(20), 10)
    tail = lambda i: tuple(text[i:])
    order = np.array(sorted(range(200), key=tail))
    lcp = lambda i, j: next((k for k, (x, y) in enumerate(zip(tail(i), tail(j))) if x != y), min(len(tail(i)), len(tail(j))))
    common = np.array([0, *[lcp(a, b) for a, b in zip(order, order[1:])]])
    want = [max([lcp(i, j) for j in range(200) if doc[j] < doc[i]], default=0) for i in range(200)]
    assert suffix_dedup.previous_factors(order, common, doc).tolist() == want


# ---------------------------------------------------------------- 4 and 8
def test_quality_scores(spark):
    got = QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    assert got.count() > 50 and got.filter("predicted = quality").count() / got.count() > 0.95
    model = quality_classifier.train([(r[1] or "", str(i % 2)) for i, r in enumerate(AWKWARD)])
    rows = quality_classifier.score(documents(spark), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1 and len({r.score for r in rows if r.doc_id == 1}) == 1
    none = quality_classifier.fit(empty(spark), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in quality_classifier.score(documents(spark), none).collect()} == {0.5}


def plain_types(text):
    """(type, shape) of each token of a text by a loop over its bytes."""
    raw, m = (text or "").encode(), (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m
        return h ^ h >> 31

    def kind(b):
        return 0 if b == 32 or 9 <= b <= 13 else 2 if 48 <= b <= 57 else 1 if b >= 128 or chr(b).isalpha() else 3

    found = []
    for k, run in itertools.groupby(raw, kind):
        run = bytes(run)
        if k:
            lower = run.lower()
            h = mixed(sum((b + 1) * pow(0x9E3779B97F4A7C55, i, 1 << 64) for i, b in enumerate(lower)) + len(run) & m)
            upper, small = sum(65 <= b <= 90 for b in run), sum(97 <= b <= 122 for b in run)
            capitals = 0 if not upper else 2 if not small and len(run) > 1 else 1
            found.append((mixed(h) if capitals == 2 else h, ((k - 1) * 3 + capitals) * 6 + min(len(run).bit_length() - 1, 5), k))
    out = []
    for i, (h, shape, k) in enumerate(found):
        again = i and found[i - 1][0] == h or i > 1 and k == 1 and found[i - 2][0] == h
        out.append((quality_classifier.TYPES, quality_classifier.REPEAT) if again else (h >> 48, shape))
    return out


def test_word_contexts_equal_brute_force(spark, given):
    texts = [r[1] for r in AWKWARD] + [r.text for r in given][:60]
    index = quality_classifier.index_vectors(np.arange(quality_classifier.TYPES + 1)).astype(int)
    times, sums = Counter(), {}
    for text in texts:
        types = [t for t, _ in plain_types(text)]
        for i, t in enumerate(types):
            times[t] += 1
            sums[t] = sums.get(t, 0) + sum(index[types[j]] for j in range(max(0, i - 2), min(len(types), i + 3)) if j != i)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.type: (r.times, [r[f"c{k}"] for k in range(64)]) for r in quality_classifier.contexts(docs).collect()}
    assert got == {t: (n, list(sums[t]) if n and not np.isscalar(sums[t]) else [0] * 64) for t, n in times.items()}
    assert quality_classifier.contexts(empty(spark)).isEmpty()


def test_quality_scores_equal_brute_force(spark, given):
    """The network's answer to a text, token by token, from the word vectors and the layers."""
    rows = [*AWKWARD, *[(r.doc_id, r.text, None, None) for r in given][:60]]
    model = quality_classifier.train([(r.text, str(r.doc_id % 2)) for r in given])
    got = quality_classifier.score(documents(spark, rows), model).select("text", F.col("score").cast("double")).collect()
    expect = {}
    for _, text, *_ in rows:
        pairs = plain_types(text)
        hidden = [max(0.0, sum(float(model.words[t][k]) + float(model.shapes[s][k]) for t, s in pairs) / max(1, len(pairs)) + model.first_bias[k]) for k in range(24)]
        logit = (sum(h * w for h, w in zip(hidden, model.second)) + model.bias) / model.temperature
        expect[text] = 1 / (1 + math.exp(-min(50, max(-50, logit))))
    assert len(got) == len(rows) and all(abs(r.score - expect[r.text]) < 1e-5 for r in got)


def test_languages_equal_brute_force(spark, given):
    """Averages of table rows over the subwords of a text, one by one, and the softmax of their scores."""
    model = language_id.train([(t, n) for n, t in (("en", "the man and the house"), ("de", "der Mann und das Haus"), ("fr", "la maison et le jardin")) for _ in range(20)])
    texts = ["", "a", "ab", "The Man", "Haus \U0001f600 é", *[r.text for r in given][:20]]
    got = model.probabilities(*language_id.text_bytes(language_id.pa.array(texts)))
    for text, found in zip(texts, got):
        raw, total, n = text.encode().lower(), np.zeros(3), 0
        for size in (2, 3, 4):
            for i in range(len(raw) - size + 1):
                value = int.from_bytes(raw[i:i + size], "little")
                total += model.table[(value * 2654435761 + size * 40503 & 0xFFFFFFFF) >> 18]
                n += 1
        e = np.exp((total / max(1, n) + model.bias) / model.temperature)
        assert np.allclose(found, e / e.sum(), atol=1e-5)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    assert got.count() > 100 and got.filter("lang_pred = lang").count() / got.count() > 0.98 and got.filter("NOT accepted").count() <= 2
    model = language_id.train([(t, n) for n, t in (("en", "the man and the house"), ("de", "der Mann und das Haus")) for _ in range(30)])
    rows = language_id.predict(documents(spark), model).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        letters = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred in ("en", "de")) == letters and 0 <= r.score <= 1 and (letters or (r.lang_pred == "und" and r.score == 0 and not r.accepted))
    nothing = language_id.predict(documents(spark), language_id.fit(empty(spark))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_collapsed_table_gives_the_same_scores_in_any_batch():
    model = language_id.train([("the cat", "en"), ("die katze", "de")] * 20)
    texts = ["the cat", "", "é", "die katze und der hund"]
    together = language_id.text_bytes(language_id.pa.array(texts))
    alone = [model.probabilities(*language_id.text_bytes(language_id.pa.array([t])))[0] for t in texts]
    assert np.allclose(model.probabilities(*together), alone, atol=1e-9)


# ---------------------------------------------------------------- 5
def test_secrets_are_linked_within_their_scope(spark):
    key, value = "AKIA" + "B" * 16, "c" * 20
    near, far = "x " * 20, "x " * 200
    rows = [(1, f"login: bob{near}token={value}", None, None), (2, f"login: bob{far}token={value}", None, None), (3, f"{key} at https://a.example.org/x", None, None),
            (4, f"password = short{near}https://a.example.org", None, None), (5, "password = short", None, None), (6, f"é\U0001f600 {key}", None, None),
            (7, "token=a.token=b-secret: " + "d" * 40, None, None), (8, None, None, None), (8, None, None, None), (9, "10.0.0.1:80 user=me", None, None)]
    got = {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.spans) for r in secret_scan.secret_spans(secret_scan.scan(documents(spark, rows))).collect()}
    kinds = {i: [k for _, k, _ in s] for i, s in got.items()}
    assert kinds[1] == ["login", "assign"] and kinds[2] == ["assign"] and kinds[3] == ["access"] and kinds[4] == ["short", "endpoint"] and kinds[5] == []
    assert got[6] == [(3, "access", 23)] and kinds[8] == [] and kinds[9] == []
    assert secret_scan.secret_spans(secret_scan.scan(empty(spark))).count() == 0
    assert secret_scan.secret_spans(secret_scan.scan(documents(spark))).count() == len(AWKWARD)
    cut = {r.doc_id: r.text for r in secret_scan.redact(documents(spark, rows)).collect()}
    assert cut[6] == "é\U0001f600 [SECRET]" and cut[5] == "password = short" and cut[8] is None and value not in cut[1] and "bob" not in cut[1]


# ---------------------------------------------------------------- 6
def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_hits(texts, items):
    windows = {}
    for item, text in items:
        w = plain(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = plain(text), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if i + n <= len(w) and tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_passages_equal_brute_force(spark, block_bytes):
    draw = random.Random(4)
    word = lambda: draw.choice("ab cd ef gh the of é z9 Z9".split())
    items = [(str(i), " ".join(word() for _ in range(n))) for i, n in enumerate((12, 10, 3, 1, 25, 0))] + [("2", "ab ab"), (None, "cd ef cd"), ("9", None), ("1", "qq rr")]
    texts = [", ".join(word() for _ in range(draw.randrange(60))) for _ in range(80)] + [t for _, t in items] + [None, "", LONG, items[0][1] + " end"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.mark_passages(documents(spark, rows), bench, block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(r.n_words, sum(x["last"] - x["first"] for x in r.runs), tuple(sorted(r["items"]))) for r in got] == brute_hits(texts, items)


def test_passages_are_cut_and_the_rest_stays(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"before, {item.upper()}! after", None, None), (2, "clean text", None, None), (3, item, None, None), (4, None, None, None), (5, f"é {item}. é {item}", None, None)]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(documents(spark, rows), bench).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == "before, ! after" and got[2].text == "clean text" and got[4].text is None and got[5].text == "é . é "
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.values()) and got[2].runs == "clash"
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    assert decontamination.decontaminate(documents(spark), bench.limit(0)).count() == len(AWKWARD)


# ---------------------------------------------------------------- 7
def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.example.com", "https://www.listed.org/a/?q=1#x", "http://m.listed.org:80/a.html", "http://user@listed.org/b", "x://y://z/p", "http://notexample.com/en/",
            "http://www.example.com/en/1", "http://example.com/EN/", "http://example.com/en/\n2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("block", F.lit(1))
    rules = [url_filter.UrlRule("allow", "com", "/"), url_filter.UrlRule("block", "example.com", "/en/"), url_filter.UrlRule("allow", "www.example.com", "/en/")]
    listing = spark.createDataFrame([("listed.org/a",), ("listed.org/a",), (None,), ("other.org/",)], "url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, listing, rules).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 2, 3, 7)] == [("", ""), ("", ""), ("", ""), ("a.example.com", ""), ("y:", "//z/p")]
    assert [got[i].verdict for i in range(12)] == ["allow"] * 4 + ["block", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert [got[i].rule for i in (3, 8, 9, 10, 11)] == [None, "com/", "www.example.com/en/", "com/", "example.com/en/"]
    none = url_filter.judge_urls(pages, listing.limit(0), rules)
    assert none.filter("listed").isEmpty() and none.count() == 12 and url_filter.judge_urls(pages.limit(0), listing, rules).count() == 0


def test_bloom_filter_passes_everything_listed(spark):
    urls = spark.range(5000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    listed = urls.filter("pmod(xxhash64(url), 7) = 0")
    assert url_filter.listed_urls(urls, listed).exceptAll(listed).isEmpty() and listed.exceptAll(url_filter.listed_urls(urls, listed)).isEmpty()
    blocks = url_filter.bloom_blocks(listed, 40)
    bits = url_filter.bits_of(F.col("url"))
    passed = urls.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(40))).join(blocks, "block")
    for i in range(4):
        passed = passed.filter(F.col(f"w{i}").bitwiseAND(bits[i]) != 0)
    assert listed.count() <= passed.count() < listed.count() + 0.1 * urls.count()


# ---------------------------------------------------------------- 9
@pytest.mark.parametrize("slab_bytes", [1 << 22, 20_000])
def test_scores_equal_brute_force(spark, given, slab_bytes):
    rows = [(r.doc_id, r.text, None, None) for r in given] + [(r[0], r[1], None, None) for r in AWKWARD]
    model = lm_scoring.fit(documents(spark, rows), slab_bytes=slab_bytes)
    texts = [[*spaced(lowered(t)), "\0"] for _, t, _, _ in rows]
    part = [zlib.crc32(str("" if i is None else i).encode()) % 7 for i, _, _, _ in rows]
    word, pair, context = Counter(), Counter(), Counter()
    for w, p in zip(texts, part):
        if p != 2:
            word.update(w)
            pair.update(zip(["^", *w], w))
            context.update(["^", *w[:-1]])
    tokens, types = sum(word.values()), len(word)
    want = []
    for (i, _, _, _), w, p in zip(rows, texts, part):
        base, total = 0.0, 0.0
        for a, b in zip(["^", *w], w):
            k = int(math.log2(context[a])) + 1 if context[a] else 0
            x, y, z = model.weights[k]
            base += math.log10((word[b] + 1) / (tokens + types + 1))
            total += math.log10(x * pair[a, b] / max(context[a], 1) + y * word[b] / tokens + z / (types + 1))
        want.append((-1 if i is None else i, p == 2, len(w), sum(word[b] > 0 for b in w), tokens, base, total))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in lm_scoring.score(model).collect())
    for g, x in zip(got, sorted(want)):
        assert g[:5] == x[:5] and g[5:] == pytest.approx(x[5:], rel=1e-9)
    # the weights of each context add up, and the probabilities of all words and one unknown word do
    assert np.allclose(model.weights.sum(axis=1), 1)
    p = [lm_scoring.mixed_probability(np.array([word[b], 0]), np.array([pair["the", b], 0]), np.array([context["the"]] * 2), model.weights, types, tokens)[0] for b in word]
    unknown = lm_scoring.mixed_probability(np.array([0]), np.array([0]), np.array([context["the"]]), model.weights, types, tokens)[0]
    assert sum(p) + unknown == pytest.approx(1)


def test_learned_weights_beat_even_ones_and_empty_input(spark, given):
    histogram = np.array([[3, 0, 40, 50], [3, 9, 40, 150], [0, 0, 20, 30], [0, 0, 0, 10]])
    weights = lm_scoring.learn_weights(histogram, 1000)
    assert weights[3, 0] > 0.5 and weights[0, 0] == 0 and weights[0, 1] > weights[0, 2] > 0 and np.allclose(weights[5], 1 / 3)
    assert lm_scoring.score(lm_scoring.fit(empty(spark))).count() == 0


# ---------------------------------------------------------------- 10
def brute_fingerprint(text):
    w = spaced(lowered(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, radius):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(marks))]


def test_near_duplicates_equal_brute_force(spark, given):
    rows = [(r.doc_id + 100, r.text, None, None) for r in given if len(r.text) < 20_000][:120] + [(r[0], (r[1] or "")[:5000] if r[1] is not None else None, None, None) for r in AWKWARD]
    got = simhash.near_duplicates(documents(spark, rows), radius=6, tile=16).collect()
    marks = [brute_fingerprint(t) for _, t, _, _ in rows]
    roots = brute_components(marks, 6)
    least = {k: min((rows[i][0] for i in range(len(rows)) if roots[i] == k and rows[i][0] is not None), default=None) for k in roots}
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in got), key=order) == sorted(((rows[i][0], marks[i], least[roots[i]]) for i in range(len(rows))), key=order)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_tiles_find_every_link():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (900, 3)).astype(np.uint64)
    marks = np.unique(base[draw.integers(0, 40, 900)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    u, v = simhash.tile_links(marks, None, 4)
    root = {int(m): int(m) for m in marks} | dict(zip(u.tolist(), v.tolist()))
    want = brute_components([int(m) for m in marks], 4)
    groups = {}
    for m, k in zip(marks.tolist(), want):
        groups.setdefault(k, set()).add(root[m])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 500), (7, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 300)}}


def test_pipeline_keeps_one_of_edited_copies(spark):
    draw = random.Random(8)
    sets, rows = [], []
    for g in range(12):
        base = [f"w{draw.randrange(3000)}" for _ in range(200 + 10 * g)]
        rows.append((1000 * g, " ".join(base), "en", "a"))
        for k in range(1, 12):
            words = list(base)
            for _ in range(1 + k % 5):
                words[draw.randrange(len(words))] = f"new{draw.randrange(1000)}"
            rows.append((1000 * g + k, " ".join(words), "en", "a"))
    rows += [(90_000, None, "en", "a"), (90_001, "", "en", "a"), (1, rows[0][1], "en", "a"), (None, rows[12][1], "en", "a"), (None, "no id", "en", "a"), (1, "short", "en", "a")]
    for _, t, *_ in rows:
        w = spaced(lowered(t))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    similar = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = [min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if root[i] == k) for k in set(root)]
    kept = corpus_pipeline.one_of_each(spark, documents(spark, rows), SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(want) and kept[0].node == "clash"


# ---------------------------------------------------------------- pipeline
def brute_similar(texts, similarity, shingle=5):
    """The first text of the component of every text, where an exact Jaccard similarity of word shingles links."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t or ""))
        sets.append(frozenset(" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    holding, first = {}, list(range(len(texts)))
    for k, s in enumerate(sets):
        for one in s or {None}:
            holding.setdefault(one, []).append(k)

    def root(k):
        while first[k] != k:
            k = first[k]
        return k

    for k, s in enumerate(sets):
        shared = Counter(o for one in s or {None} for o in holding[one] if o < k)
        for o, n in shared.items():
            if not s and not sets[o] or s and n >= similarity * (len(s) + len(sets[o]) - n) - 1e-9:
                a, b = root(k), root(o)
                first[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(texts))]


def edited_groups(seed=3):
    """Groups of texts around a similarity of 0.8: chains of edits, many of them too far from each other to be linked at once."""
    draw, texts = random.Random(seed), []
    for _ in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(40, 300))]
        for _ in range(draw.randrange(2, 40)):
            texts.append(" ".join(words))
            for _ in range(draw.randrange(0, 1 + len(words) // 60)):
                words[draw.randrange(len(words))] = f"w{draw.randrange(5000)}"
    return texts + ["", " ", "one", "one two three four five six"] + [" ".join(f"x{draw.randrange(99999)}" for _ in range(80)) for _ in range(60)]


@pytest.mark.parametrize("tile,part_hashes", [(simhash.TILE, simhash.PART_HASHES), (64, 500)])
def test_two_passes_link_what_brute_force_links(spark, monkeypatch, tile, part_hashes):
    monkeypatch.setattr(simhash, "CENTRES", 1)  # leaves most links to the two passes
    texts = edited_groups()
    monkeypatch.setattr(simhash.similar_links, "__kwdefaults__", {**simhash.similar_links.__kwdefaults__, "part_hashes": part_hashes})
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    kept = sorted(r.doc_id for r in simhash.drop_similar(docs, shingle=5, radius=22, similarity=0.8, tile=tile).collect())
    assert kept == sorted(set(brute_similar(texts, 0.8)))


def test_near_duplicate_stage_recall_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {rows[k].doc_id for k in set(brute_similar([r.text for r in rows], 0.8))}
    assert {r.doc_id for r in simhash.drop_similar(docs, shingle=5, radius=22, similarity=0.8).collect()} == want


def test_near_duplicate_stage_of_awkward_tables(spark):
    assert simhash.drop_similar(empty(spark), shingle=5, radius=22, similarity=0.8).count() == 0
    docs = documents(spark)
    kept = simhash.drop_similar(docs, shingle=5, radius=22, similarity=0.8)
    assert kept.columns == docs.columns
    # the copies of 1 and 8 are one document, as are all blank texts
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 5, 6, 7])


def test_pipeline_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or after.columns == columns
        counts.append(after.count())
        if k == 1:
            rows = before.orderBy("doc_id").collect()
            assert sorted(r.doc_id for r in after.collect()) == [rows[k].doc_id for k in sorted(set(brute_similar([r.text for r in rows], 0.8)))]
        if k == 2:
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert all(h[1] == 0 for h in brute_hits([r.text for r in after.collect()], items))
            rows = before.collect()
            dirty = {r.doc_id for r, h in zip(rows, brute_hits([r.text for r in rows], items)) if h[1]}
            assert before.filter(~F.col("doc_id").isin(list(dirty))).exceptAll(after).isEmpty() and dirty
        if k == 3:
            assert after.filter(F.col("text").rlike("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")).isEmpty() and counts[-1] == counts[-2]
        before = after
    assert counts[1] == counts[0] and corpus_pipeline.run(spark, SF).count() == counts[-1]


