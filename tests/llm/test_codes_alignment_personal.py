"""Vector codes, token alignment and personal data against slow forms in plain Python, and the defined results for awkward input."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanledger.llm import personal_data, token_alignment, vector_codes
from scanledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------------------------------------------------------ vectors


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """rows of (id, vector): the codebooks and (code, error) of each usable row, by trying every entry."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v in kept), default=0) // parts)
    cut = [(i, [(v + [0] * (parts * width - len(v)))[p * width:(p + 1) * width] for p in range(parts)]) for i, v in kept]
    start = sorted(cut, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[list(v[p]) for _, v in start] for p in range(parts)]

    def best(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v in cut:
                groups[best(p, v[p])[1]].append(v[p])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v in cut:
        hits = [best(p, v[p]) for p in range(parts)]
        out.append((i, [k for _, k in hits], sum(d for d, _ in hits)))
    return books, out


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for name in ("vector", "id", "code", "error", "label_error", "n", "sums", "part", "entry"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_vector_codes_equal_trying_every_entry(spark):
    draw = random.Random(5)
    rows = [(k, [draw.choice([-0.5, -0.1, 0.0, 0.004, 0.3, draw.uniform(-1, 1)]) for _ in range(32)], k % 3 or None) for k in range(300)]
    rows += [(7, rows[9][1], 1)] * 40 + [(900, None, 1), (901, [None] * 32, 1), (902, [math.nan] * 32, 1), (903, [math.inf] * 32, 2), (None, rows[3][1], None)]
    df = vectors(spark, rows)
    books = vector_codes.train_codebooks(df)
    slow_books, slow = slow_codes([(i, [float(np.float32(x)) if x is not None else None for x in v] if v else v) for i, v, _ in rows])
    assert books.tolist() == slow_books
    got = vector_codes.with_label_error(vector_codes.encode(df.select("vec_id", "embedding", "label"), books)).collect()
    assert Counter((r.vec_id, tuple(r.code), r.error) for r in got) == Counter((i, tuple(c), e) for i, c, e in slow)
    totals = Counter()
    for r in got:
        totals[r.label] += r.error
    assert all(r.label_error == totals[r.label] for r in got)


def test_vector_codes_of_awkward_tables(spark):
    none = vectors(spark, [(1, None, 1)]).limit(0)
    books = vector_codes.train_codebooks(none)
    assert books.shape == (16, 0, 0) and vector_codes.encode(none, books).count() == 0 and vector_codes.written_out(books) == ""
    odd = vectors(spark, [(1, [], 1), (2, [1.0] * 5, None), (3, [3e38, -3e38], 1), (3, [3e38, -3e38], 1)])
    books = vector_codes.train_codebooks(odd)
    got = vector_codes.encode(odd, books).collect()
    assert len(got) == 4 and all(r.error == 0 for r in got) and books.shape == (16, 4, 1)
    # a repeated row starts two entries; both rows take the lower one
    assert {tuple(r.code) for r in got if r.vec_id == 3} == {(2, 2, *[0] * 14)}


def test_trie_shares_prefixes_across_many_siblings():
    draw = np.random.default_rng(3)
    parts = np.unique(draw.integers(-40, 40, (9000, 3)), axis=0)
    book = draw.integers(-40, 40, (9, 3))
    entry, error = vector_codes.nearest(parts, book)
    every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


# -------------------------------------------------------------------------------------------------------------- tokens

TEXTS = ["The quick brown fox, jumps over 12 lazy dogs.", None, "", " ", "  two  blanks\n\n\tand a tab ", "it's <|endoftext|> and </s> <unk> <0x41> as text", "a▁b has the mark itself",
         "Ünïcödé ﬀ 漢字 \U0001f600 ключ", "The quick brown fox, jumps over 12 lazy dogs.", "x" * 3000, " no-break wide", "thorreou ndwhst edhain", "9" * 700 + " end",
         " " * 700 + "far", "é combining \x00 nul"]


def slow_alignment(texts):
    """Per text: (groups, links) by comparing all ends; groups as pairs of id lists, links as id pairs."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a_side = Tokenizer.from_file(token_alignment.BYTE_LEVEL)
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_file=token_alignment.PIECES)
    byte_of, spare = {}, 256
    for b in range(256):
        if b in token_alignment.PRINTABLE:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(spare)] = b
            spare += 1
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        a = a_side.encode(" " + text, add_special_tokens=False).ids
        b = b_side.encode(text)
        a_raw = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a]
        b_raw = [bytes.fromhex(b_side.id_to_piece(i)[3:5]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            out.append(([], []))
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw))
        common = sorted(set(a_ends) & set(b_ends))
        groups = [([i for i, e in zip(a, a_ends) if low < e <= high], [i for i, e in zip(b, b_ends) if low < e <= high]) for low, high in zip([0, *common], common)]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if a_ends[i] - len(a_raw[i]) < b_ends[j] and b_ends[j] - len(b_raw[j]) < a_ends[i]]
        out.append((groups, links))
    return out


def slow_statistics(texts):
    found = slow_alignment(texts)
    held = Counter(pair for _, links in found for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for groups, links in found:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("shelf_bytes", [1, 300, 8 << 20])
def test_link_statistics_equal_comparing_all_ends(spark, shelf_bytes):
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, shelf string, pairs string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.link_statistics(docs, shelf_bytes=shelf_bytes).collect()}
    assert got == dict(enumerate(slow_statistics(TEXTS)))


def test_token_alignment_query_by_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r.text or "") < 4000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.link_statistics(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], slow_statistics([r.text for r in rows])))
    whole = QUERIES["op12_token_alignment"](spark, SF)
    assert whole.count() == 200 and whole.filter("n_links <> n_a + n_b - n_groups").count() == 0


def test_token_groups_are_the_groups_of_the_digest(spark):
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(TEXTS)], "doc_id string, text string")
    for r in token_alignment.token_groups(docs).collect():
        want = slow_alignment([TEXTS[int(r.doc_id)]])[0][0]
        cuts = list(zip([0, *r.a_cuts], [0, *r.b_cuts], r.a_cuts, r.b_cuts))
        assert [(r.a_ids[a:c], r.b_ids[b:d]) for a, b, c, d in cuts] == want
    empty = docs.limit(0)
    assert token_alignment.token_groups(empty).count() == 0 and token_alignment.link_statistics(empty).count() == 0


def test_walk_over_random_ends():
    draw = random.Random(1)
    for _ in range(300):
        total = draw.randrange(1, 60)
        a, b = (sorted({*draw.sample(range(1, total + 1), draw.randrange(0, total)), total}) for _ in range(2))
        if draw.random() < 0.5:
            b = sorted({*a, *b})
        met = token_alignment.walk(a, b)
        pairs = {(i + k, j + k) for i, j, n in zip(met.first, met.second, met.length) for k in range(n)} | set(zip(met.link_a.tolist(), met.link_b.tolist()))
        starts = lambda ends: [0, *ends]
        assert pairs == {(i, j) for i in range(len(a)) for j in range(len(b)) if starts(a)[i] < b[j] and starts(b)[j] < a[i]}
        ends = {a[i + k] for i, n in zip(met.first, met.length) for k in range(n)} | {a[g[2] - 1] for g in met.groups}
        assert ends == set(a) & set(b)


def test_the_fast_encoder_is_the_vocabulary_file(spark):
    coders, draw = token_alignment.load(token_alignment.BYTE_LEVEL, token_alignment.PIECES), random.Random(2)
    letters = "aaabbcdeehilnorst  \n\t.,'-019éüÀß#(" + "".join(map(chr, range(0xa1, 0x250)))
    for _ in range(400):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 200)))
        assert coders.a_ids(text) == coders.exact.encode(" " + text, add_special_tokens=False).ids


# ------------------------------------------------------------------------------------------------------------ personal

# fixed values: the forms of the contract
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def slow_base(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and slow_luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def slow_personal(texts, rounds=3, support=3, certain=600_000):
    """The spans of each text, by the same rounds over dictionaries of strings."""
    kinds, places = list(FORMS), []
    for n, text in enumerate(texts):
        base = slow_base(text)
        for kind, s, e in base:
            places.append((n, kind, s, e))
        for s, e in personal_data.unseen(text or "", [(0, s, e) for _, s, e in base]):
            places.append((n, None, s, e))
    edges, seeds = defaultdict(set), defaultdict(set)
    for n, kind, s, e in places:
        value = texts[n][s:e].lower()
        if kind:
            seeds[value].add(kind)
        for p in personal_data.patterns(texts[n], s, e):
            edges[p].add(value)
    rest, score = {v for vs in edges.values() for v in vs if v not in seeds}, {}
    for _ in range(rounds):
        rated = {}
        for p, values in edges.items():
            for k in kinds:
                own = sum(k in seeds.get(v, ()) for v in values)
                total = 1_000_000 * own + sum(score.get((v, k), 0) for v in values if v in rest)
                rated[p, k] = total // (len(values) + 1) if own >= support else 0
        score = {}
        for p, values in edges.items():
            for v in values & rest:
                for k in kinds:
                    score[v, k] = max(score.get((v, k), 0), rated[p, k])
    found = {v: max(kinds, key=lambda k: (score[v, k], -kinds.index(k))) for v in rest}
    out = [[] for _ in texts]
    for n, kind, s, e in places:
        value = texts[n][s:e].lower()
        if kind:
            out[n].append((kind, s, e))
        elif value in found and score[value, found[value]] >= certain:
            out[n].append((f"like_{found[value]}", s, e))
    order = [*kinds, *(f"like_{k}" for k in kinds)]
    return [sorted(x, key=lambda y: (order.index(y[0]), y[1])) for x in out]


def personal_texts():
    draw = random.Random(4)
    texts = [None, "", "no one here", "a@b.c@d.e @x.y f@g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "+1 (5) and +12345678 ((( +", "4111 1111 1111 1111 1 4111111111111111",
             "4111111111111111 4111111111111112", "pay 4111-1111 1111 1111, or 79927398713, please", "Ünï \U0001f600 me@mail.example.org ok"]
    for k in range(40):
        number = "".join(draw.choice("0123456789") for _ in range(10))
        texts.append(f"Please call me on +1 {number[:3]} {number[3:]} before noon, ticket AB-{number[:5]} is open")
        texts.append(f"Then write to user{k}@mail{k % 7}.example.com today about order {number}")
    texts += ["Please call me on 0171 2345678 before noon", "and reach 0171 2345678 later", "Then write to john.doe@localhost today", "Then write to jane@intranet today",
              "order 1234567890 was sent", "Please call me on (0171) 99-88-777 before noon"]
    return texts * 2


@pytest.mark.parametrize("parts", [1, 5])
def test_personal_spans_equal_rounds_over_strings(spark, parts):
    texts = personal_texts()
    docs = spark.createDataFrame([(k if k % 9 else None, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, kind string, rid string").repartition(parts)
    got = Counter((r.doc_id, tuple((s["kind"], s["start"], s["end"]) for s in r.spans)) for r in personal_data.personal_spans(docs).collect())
    want = Counter((k if k % 9 else None, tuple(x)) for k, x in enumerate(slow_personal(texts)))
    assert got == want
    said = {s[0] for spans in slow_personal(texts) for s in spans}
    assert {"like_phone", "like_email", "email", "ip", "card", "phone"} <= said


def test_personal_data_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, slow_personal(list(docs.values()))))
    got = QUERIES["op13_personal_data"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        written = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        base = [s for s in want[r.doc_id] if s[0] in FORMS]
        assert r.spans == written(want[r.doc_id]) and r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in FORMS]


def test_forms_equal_the_contract_on_random_text():
    draw = random.Random(6)
    for _ in range(3000):
        text = "".join(draw.choice("0011234599  --..@@ab%+()\n") for _ in range(draw.randrange(0, 60)))
        assert [(personal_data.KINDS[k], s, e) for k, s, e in personal_data.base_spans(text)] == slow_base(text)


def test_long_runs_take_linear_time():
    import time
    begun = time.time()
    for run in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 200_000, "a@" * 100_000, "+1(" * 100_000, "+" * 200_000, "A1" * 200_000, "1 " * 200_000):
        personal_data.unseen(run, personal_data.base_spans(run))
    assert time.time() - begun < 20


def test_personal_data_of_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert personal_data.personal_spans(docs).count() == 0
