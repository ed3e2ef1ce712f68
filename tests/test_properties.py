"""Properties that SQL cannot state: brute force on small fixtures, invariants, iterative and streaming operators."""
import hashlib
import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanledger.checks import CheckFailed, assert_empty
from scanledger.operators import calibration as C, embeddings as EM, grid as G, kernels as K, ordering as O, probes as PR, ranking as R, scorecard as S, selection as SEL, splits as SP, worklist as L
from scanledger.plans import evaluation as EV, preprocessing as PP
from scanledger.sources import readers as SR, writers as SW
from scanledger.streaming import ingest as IN


# ---------------------------------------------------------------- ordering
def test_prefix_sums_equal_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.choice([-1, 1]) * rng.random() ** 6 * 1e3, rng.randrange(5)) for _ in range(600)]
    rows += [("hot", 0.0, 2), ("hot", 1e-300, 1), ("hot", -1e-300, 1)]
    rows = list({(k, v): (k, v, n) for k, v, n in rows}.values())
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    got = {(r.k, r.v): (r.n_before, r.n_total) for r in O.prefix_sums(df, ["k"], O.number_cell(F.col("v")), ["v"], ["n"]).collect()}
    for k, v, _ in rows:
        assert got[k, v] == (sum(n for a, b, n in rows if a == k and b < v), sum(n for a, b, n in rows if a == k))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=101) * 1e3, "b": rng.integers(0, 4, 50).astype(float), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("b", float("nan"))], "k string, v double")
    for r in O.quantiles(df, ["k"], "v", {"lo": 0.005, "mid": 0.5, "hi": 0.95}).collect():
        assert np.allclose([r.lo, r.mid, r.hi], np.quantile(data[r.k], [0.005, 0.5, 0.95]), atol=1e-9)


def test_number_cell_is_monotone(spark):
    values = sorted([0.0, -0.0, 1e-308, -1e-308, 5e-324] + [s * 10 ** random.Random(i).uniform(-30, 30) for i in range(300) for s in (-1, 1)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r.c for r in df.select("i", O.number_cell(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells)


def test_scores_close_to_one_are_spread_over_cells(spark):
    close = spark.range(1_000_000).select((F.lit(1.0) - F.col("id") * 2e-9).alias("p"))
    sizes = [r.n for r in close.groupBy(O.number_cell(F.col("p")).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 50_000


# ---------------------------------------------------------------- metrics
def predictions(spark, n=400, missing=10, digits=2):
    """Two labels whose scores are cosine waves over the volumes, shifted up for positives; every ``missing``-th truth is unknown."""
    rows = []
    for k, label in enumerate(("a", "b")):
        for i in range(n):
            y = float((i * (k + 3)) % 10 < 3)
            p = 0.35 + 0.25 * math.cos(i * (k + 1) * 0.7) + (0.2 if k == 0 else 0.05) * y + 0.1 * math.cos(i * i)
            rows.append((str(i), str(i // 2), ("soft", "sharp")[i % 2], label, round(p, digits), None if i % missing == k else y))
    return rows, spark.createDataFrame(rows, "volume_id string, patient_id string, kernel_class string, label string, p double, y double")


def auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def average_precision(y, p):
    out, recall = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        r = (hit & (y == 1)).sum() / (y == 1).sum()
        out += (r - recall) * (hit & (y == 1)).sum() / hit.sum()
        recall = r
    return out


def test_ranking_metrics_equal_definitions(spark):
    rows, df = predictions(spark)
    got = {(r.group_by, r.group, r.label): r for r in EV.per_label_metrics(df, ["kernel_class"]).collect()}
    for (by, group, label), r in got.items():
        known = [(x[5], x[4]) for x in rows if x[3] == label and x[5] is not None and (by == "all" or x[2] == group)]
        y, p = np.array(known).T
        assert r.n == len(y) and r.n_pos == y.sum()
        assert r.auroc == pytest.approx(auroc(y, p), abs=1e-12) and r.auprc == pytest.approx(average_precision(y, p), abs=1e-12)


def test_one_class_is_null_not_dropped(spark):
    df = spark.createDataFrame([("1", "a", 0.3, 1.0), ("2", "a", 0.4, 1.0), ("3", "b", 0.2, None)], "volume_id string, label string, p double, y double")
    rows = EV.per_label_metrics(df, []).collect()
    assert [(r.label, r.n, r.auroc, r.auprc) for r in rows] == [("a", 2, None, None)]
    assert R.macro(EV.per_label_metrics(df, []), ["group_by"], ["auroc"]).first().labels_scored == 0


def test_operating_points_on_a_known_grid(spark):
    # 100 negatives at 0.00 to 0.99, 100 positives at 0.400 to 0.895
    rows = [(f"n{i}", "x", i / 100, 0.0) for i in range(100)] + [(f"p{i}", "x", 0.4 + i / 200, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "volume_id string, label string, p double, y double").withColumn("patient_id", F.col("volume_id")).withColumn("kernel_class", F.lit("sharp"))
    point = EV.operating_points(spark, df, EV.ReportSettings(calibration="none"))[1].first()
    assert point.report == np.nextafter(0.94, 1)  # 95 negatives are at 0.94 or below
    assert point.ruleout == pytest.approx(0.45)    # 90 positives are at 0.45 or above
    scores = {p: 2 * sum(q >= p and y for _, _, q, y in rows) / (sum(q >= p for _, _, q, _ in rows) + 100) for _, _, p, _ in rows}
    assert scores[point.max_f1] == max(scores.values()) and not any(f == max(scores.values()) and p < point.max_f1 for p, f in scores.items())


def test_calibration_is_the_maximum_likelihood_fit(spark):
    rows, df = predictions(spark, digits=6)
    params = {r.label: r for r in C.fit(spark, df, "platt").collect()}
    for label, r in params.items():
        y, p = np.array([(x[5], x[4]) for x in rows if x[3] == label and x[5] is not None]).T
        z = np.log(p) - np.log1p(-p)
        gap = 1 / (1 + np.exp(-(r.slope * z + r.intercept))) - y
        assert abs(gap.mean()) < 1e-6 and abs((gap * z).mean()) < 1e-6 and r.slope > 0
    assert C.fit(spark, df, "temperature").filter("intercept <> 0").isEmpty()
    flat = df.withColumn("y", F.lit(1.0))
    assert {(r.slope, r.intercept) for r in C.fit(spark, flat, "platt").collect()} == {(1.0, 0.0)}
    reversed_ = df.withColumn("p", F.lit(1.0) - F.col("p"))
    assert {(r.slope, r.intercept) for r in C.fit(spark, reversed_, "platt").collect()} == {(1.0, 0.0)}


def test_bootstrap_equals_whole_resamples(spark, monkeypatch):
    """Slices, salts and ties change nothing: every resample equals the metric of its repeated rows."""
    from scanledger.operators import bootstrap as B
    monkeypatch.setattr(B, "SLICE_ROWS", 8)
    monkeypatch.setattr(B, "CHUNK", 5)
    rows = [(f"p{i % 37}", "a", 0.5 if i % 3 == 0 else (i * 7 % 50) / 50.0, float(i * 5 % 7 < 3)) for i in range(120)]
    rows += [("p1", "a", 0.4, None), (None, "a", 0.4, 1.0), ("p2", "a", None, 1.0), ("p3", "one class", 0.2, 1.0)]
    df = spark.createDataFrame(rows, "patient_id string, label string, p double, y double")
    got = {r.b: (r.auroc, r.auprc) for r in B.draws(df, 20).collect()}
    known = [r for r in rows if None not in r and r[1] == "a"]
    h = np.array([int(hashlib.md5(r[0].encode()).hexdigest()[:8], 16) % B.PRIME for r in known])
    y, p = np.array([r[3] for r in known]), np.array([r[2] for r in known])
    a, c = B._resamples(20, 0)
    assert sorted(got) == list(range(20))
    for b in range(20):
        w = np.searchsorted(B.POISSON_CUTS, (a[b] * h + c[b]) % B.PRIME >> 15, side="right")
        ys, ps = np.repeat(y, w), np.repeat(p, w)
        order = (ps[ys == 1][:, None] > ps[ys == 0]) + 0.5 * (ps[ys == 1][:, None] == ps[ys == 0])
        precision = sum(((ps == t) & (ys == 1)).sum() * ys[ps >= t].mean() for t in np.unique(ps)) / ys.sum()
        assert got[b] == pytest.approx((order.mean(), precision), abs=1e-12)
    assert B.draws(df.filter("label = 'none'"), 3).isEmpty()


def test_bootstrap_weights_are_poisson():
    from scanledger.operators import bootstrap as B
    a, c = B._resamples(50, 3)
    h = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % B.PRIME for i in range(4000)])
    w = B._weight_table()[(h[:, None] * a + c) % B.PRIME >> 15]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


def test_gate_rules(spark):
    labels = spark.createDataFrame([("ok", 0.9, 0.7, 0.01), ("weak", 0.7, 0.9, 0.01), ("off", 0.9, 0.9, 0.2), ("flips", None, 0.9, 0.01)],
                                   "label string, auroc_ci_low double, report_sens double, ece double")
    gaps = spark.createDataFrame([("ok", -0.05)], "label string, kernel_sens_gap double")
    paired = spark.createDataFrame([("ok", 0.05), ("flips", 0.5)], "label string, flip_rate double")
    got = {r.label: r.status for r in S.gate(labels, gaps, paired).collect()}
    assert got == {"ok": "supported", "weak": "not_supported", "off": "review", "flips": "review"}


def test_paired_summary_without_pairs(spark):
    empty = spark.createDataFrame([], "scan string, label string, sharp_volume string, soft_volume string, flip bigint, maxf1_flip bigint, state_change bigint, hard bigint, dp double")
    row = S.paired_summary(S.paired_by_scan(empty)).first()
    assert row.n_pairs == 0 and row.paired_scans_with_flip is None


# ---------------------------------------------------------------- worklists and splits
def metadata(spark, n=40):
    rows = []
    for p in range(n):
        for scan in "ab":
            rows.append(("train", f"train_{p}_{scan}_1.nii.gz", "Philips", "YA"))
            if (p + ord(scan)) % 3:
                rows.append(("train", f"train_{p}_{scan}_2.nii.gz", "Philips", "['B', '3']"))
    rows += [("valid", f"valid_{p}_a_{r}.nii.gz", "Philips", k) for p in range(7) for r, k in ((1, "YA"), (2, "B"))]
    meta = spark.createDataFrame(rows, "pool string, VolumeName string, Manufacturer string, ConvolutionKernel string")
    return meta, spark.createDataFrame([("Philips", "YA", "sharp"), ("philips ", "B", "soft")], "manufacturer string, kernel string, class string")


def train_order(worklist):
    out = []
    for r in worklist.filter("source_split = 'train'").orderBy("order").collect():
        if r.patient_id not in out:
            out.append(r.patient_id)
    return out


def test_worklist_caps_are_prefixes_and_kernels_share_an_order(spark):
    meta, table = metadata(spark)
    whole = train_order(L.build_worklist(meta, table, chunk_size=4, seed=3))
    assert train_order(L.build_worklist(meta, table, chunk_size=4, seed=3, max_train_patients=11)) == whole[:11]
    soft = train_order(L.build_worklist(meta, table, chunk_size=4, seed=3, train_kernel="soft"))
    assert soft == [p for p in whole if p in set(soft)]
    assert whole != train_order(L.build_worklist(meta, table, chunk_size=4, seed=4))


def test_chunks_never_mix_pools_and_are_full(spark):
    meta, table = metadata(spark)
    w = L.build_worklist(meta, table, chunk_size=5, seed=0)
    assert_empty(w.groupBy("chunk").agg(F.count_distinct("source_split").alias("n")).filter("n > 1"), "mixed chunk")
    sizes = {r.chunk: r.n for r in w.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(sizes.values()) == 5 and sorted(sizes) == list(range(len(sizes)))
    assert w.select("order").distinct().count() == w.count() == w.agg(F.max("order")).first()[0] + 1
    with pytest.raises(ValueError):
        L.build_worklist(meta, table, chunk_size=5, train_kernel="other")


def test_survey_sample_serves_every_pair_and_no_pair_twice_over(spark):
    # scan i shows kernels a(i) and b(i); kernel k7 is on two scans only, k0 on most
    kernel = lambda i, r: f"k{7 if i in (3, 50) and r == 1 else [0, 0, 1, 0, 2, 1, 0, 3][(i * (r + 2)) % 8]}"
    rows = [(f"train_{i}_a_{r}", f"train_{i}", "a", r, "train", "M", kernel(i, r), "other") for i in range(90) for r in (1, 2)]
    rows.append(("train_0_b_1", "train_0", "b", 1, "train", "M", "k9", "other"))  # a scan with one reconstruction serves nobody
    v = spark.createDataFrame(rows, "volume_id string, patient_id string, scan_id string, reconstruction_id bigint, source_split string, manufacturer string, kernel string, kernel_class string")
    n, shows = 4, {}
    for r in rows[:-1]:
        shows.setdefault(r[1], set()).add(r[6])
    picked = L.survey_sample(v, n, 9).collect()
    assert len({r.patient_id for r in picked}) == len(picked) and {r.scan_id for r in picked} == {"a"}
    sizes = {k: sum(k in s for s in shows.values()) for s in shows.values() for k in s}
    for k, size in sizes.items():
        served = [r for r in picked if r.served == f"M\t{k}"]
        shown = sum(k in shows[r.patient_id] for r in picked)
        assert shown >= min(n, size)                                 # enough scans for every pair
        assert len(served) <= n and all(k in shows[r.patient_id] for r in served)
        rarer = {x for x in sizes if (sizes[x], x) < (sizes[k], k)}
        before = sum(k in shows[r.patient_id] for r in picked if r.served.split("\t")[1] in rarer)
        assert len(served) == max(0, min(n, size) - before)          # only what rarer pairs had not brought already
    assert {r.patient_id for r in picked} == {r.patient_id for r in L.survey_sample(v.repartition(7), n, 9).collect()}


def test_splits_are_frozen_and_topped_up(spark):
    patients = spark.createDataFrame([(f"p{i}",) for i in range(50)], "patient_id string")
    none = spark.createDataFrame([], "patient_id string, split string")
    first = SP.plan_split(patients.limit(30), none, none, n_val=4, n_test=5, seed=1)
    a = {r.patient_id: r.split for r in first.collect()}
    assert sorted(a.values()).count("val") == 4 and sorted(a.values()).count("test") == 5
    frozen = spark.createDataFrame(list(a.items()), "patient_id string, split string")
    forced = spark.createDataFrame([("p49", "test")], "patient_id string, split string")
    b = {r.patient_id: r.split for r in SP.plan_split(patients, frozen, forced, n_val=6, n_test=5, seed=1).collect()}
    assert all(b[p] == s for p, s in a.items()) and len(b) == 50 and b["p49"] == "test"
    assert list(b.values()).count("val") == 6 and list(b.values()).count("test") == 6
    with pytest.raises(CheckFailed):
        assert_empty(SP.split_shortfall(patients, none, none, n_val=40, n_test=20), "too few patients")
    assert not SP.unknown_splits(spark.createDataFrame([("x", "dev")], "patient_id string, split string")).isEmpty()


def test_bad_kernel_class_is_reported(spark):
    table = spark.createDataFrame([("m", "k", "crisp"), ("m", "j", "soft")], "manufacturer string, kernel string, class string")
    assert K.bad_kernel_rows(table).count() == 1


# ---------------------------------------------------------------- pixels
def volume(spark, arrays):
    rows = [(v, z, a.shape[1], a.shape[2], [float(x) for x in a[z].ravel()]) for v, a in arrays.items() for z in range(a.shape[0])]
    return spark.createDataFrame(rows, "volume_id string, z int, h int, w int, pixels array<double>")


def test_foreground_box_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    arrays = {str(i): np.where(rng.random((5, 6, 7)) < 0.03, 100.0, -1000.0) for i in range(8)} | {"none": np.full((3, 4, 5), -1000.0)}
    for r in G.foreground_box(volume(spark, arrays), -500.0, 1).collect():
        a = arrays[r.volume_id]
        hit = np.argwhere(a > -500)
        lo = np.maximum(hit.min(0) - 1, 0) if len(hit) else np.zeros(3)
        hi = np.minimum(hit.max(0) + 2, a.shape) if len(hit) else np.array(a.shape)
        assert [r.z0, r.y0, r.x0] == list(lo) and [r.z1, r.y1, r.x1] == list(hi)


def test_resample_keeps_corners_and_linear_ramps(spark):
    z, y, x = np.meshgrid(np.arange(4), np.arange(5), np.arange(6), indexing="ij")
    df = volume(spark, {"a": 3.0 * z + 2.0 * y - x})
    spacing = spark.createDataFrame([("a", 3.0, 1.5, 0.75)], "volume_id string, spacing_z_mm double, spacing_y_mm double, spacing_x_mm double")
    plan = G.resample_plan(df, spacing)
    out = {r.z: np.array(r.pixels).reshape(r.h, r.w) for r in G.resample(df, plan).collect()}
    assert sorted(out) == list(range(8)) and out[0].shape == (10, 6)
    for j, got in out.items():
        want = 3 * (j * 3 / 7) + 2 * (np.arange(10)[:, None] * 4 / 9) - np.arange(6)[None, :]
        assert np.allclose(got, want)


def test_preprocess_reports_every_volume(spark):
    rng = np.random.default_rng(0)
    body = np.full((6, 10, 10), -1000.0)
    body[1:5, 2:8, 2:8] = rng.integers(-50, 60, (4, 6, 6))
    bad = body.copy()
    bad[0, 0, 0] = np.nan
    df = volume(spark, {"good": body, "nan": bad, "huge": body * 60 + 30000, "padded": np.where(body == -1000, -8192, body)})
    ids = [("good", True, 0.0), ("nan", None, None), ("huge", None, None), ("padded", False, 3.0)]
    facts = spark.createDataFrame([(v, 1.5, 0.75, 0.75, None, None, u, t) for v, u, t in ids],
                                  "volume_id string, spacing_z_mm double, spacing_y_mm double, spacing_x_mm double, slope double, intercept double, z_uniform boolean, tilt_deg double")
    settings = PP.Settings(target_size=(5, 5), crop_margin=0, thresholds=PP.Q.Thresholds(min_slices=3, max_slices=9, hu_min_uncalibrated=0.0))
    parts = PP.infer(df, facts, settings)
    got = {r.volume_id: r for r in parts["report"].collect()}
    assert got["good"].status == "ready" and got["good"].crop_shape == "4x6x6"
    assert got["nan"].status == "error" and "NaN" in got["nan"].error
    assert got["huge"].status == "error" and "int16" in got["huge"].error
    assert got["padded"].status == "rejected" and got["padded"].floored and got["padded"].flags and got["padded"].hu_min_before == -8192
    kept = parts["slices"]
    assert {r.volume_id for r in kept.select("volume_id").distinct().collect()} == {"good"} and kept.schema["pixels"].dataType.elementType.typeName() == "short"
    with pytest.raises(CheckFailed):
        PP.infer(df, facts, settings, fingerprint="a", cache_fingerprint="b")


# ---------------------------------------------------------------- embeddings
def embedded(spark, sizes=(12, 7, 1), dim=5, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"v{i}", z, [float(x) for x in rng.normal(size=dim)]) for i, n in enumerate(sizes) for z in range(n)]
    return spark.createDataFrame(rows, "volume_id string, slice_idx int, emb array<double>")


@pytest.mark.parametrize("weight", [None, 0.4])
def test_greedy_selection_goes_by_rank_not_number(spark, weight):
    df = embedded(spark)
    spread = df.withColumn("slice_idx", F.col("slice_idx") * 3 + 10)
    plain, gaps = ([(r.volume_id, r.slice_idx) for r in SEL.select_greedy(x, SEL.importance(x), 4, weight).collect()] for x in (df, spread))
    assert sorted(gaps) == sorted((v, z * 3 + 10) for v, z in plain) and len(plain) == 9
    strata = [(r.volume_id, r.slice_idx) for r in SEL.select_stratified(SEL.importance(spread), 4).collect()]
    assert len(strata) == 9 and {(z - 10) // 9 for v, z in strata if v == "v0"} == {0, 1, 2, 3}


def test_greedy_selection_visits_every_direction(spark):
    # four directions, five slices each: four picks see all of them
    rows = [("v", d * 5 + j, [float(d == k) + 0.01 * j for k in range(4)]) for d in range(4) for j in range(5)]
    df = spark.createDataFrame(rows, "volume_id string, slice_idx int, emb array<double>")
    picks = [r.slice_idx for r in SEL.select_greedy(df, SEL.importance(df), 4).collect()]
    assert {z // 5 for z in picks} == {0, 1, 2, 3} and 10 in picks  # the middle slice comes first


@pytest.mark.parametrize("step", [1, 2, 150])
def test_selection_proxies_of_large_selections_equal_brute_force(spark, step):
    rng = np.random.default_rng(step)
    vectors = {"big": rng.normal(size=(300, 4)), "small": rng.normal(size=(3, 4))}
    rows = [(v, z, [float(a) for a in e]) for v, es in vectors.items() for z, e in enumerate(es)]
    df = spark.createDataFrame(rows, "volume_id string, slice_idx int, emb array<double>")
    chosen = df.filter(F.col("slice_idx") % step == 0).select("volume_id", F.col("slice_idx").cast("bigint").alias("slice_idx"))
    got = {r.volume_id: r for r in SEL.selection_proxies(df, chosen).collect()}
    for v, es in vectors.items():
        u = es / np.linalg.norm(es, axis=1, keepdims=True)
        gap = 1 - (u @ u[::step].T).max(axis=1)
        r, mean, part = got[v], es.mean(0), es[::step].mean(0)
        assert np.isclose(r.nearest_cosine_distance, gap.mean(), atol=1e-9) and np.isclose(r.p95_cosine_distance, np.quantile(gap, 0.95), atol=1e-9)
        assert np.isclose(r.mean_embedding_drift, 1 - mean @ part / np.linalg.norm(mean) / np.linalg.norm(part), atol=1e-9)
        assert np.isclose(r.fraction_encoded, len(es[::step]) / len(es)) and r.largest_gap == max(min(step - 1, len(es) - 1), (len(es) - 1) % step)


def test_slices_that_are_not_finite_are_left_out(spark):
    df = embedded(spark)
    holed = df.withColumn("emb", F.when(F.col("slice_idx") == 3, F.array(*[F.lit(float("nan"))] * 5)).otherwise(F.col("emb")))
    got = {(r.volume_id, r.slice_idx): (r.importance, r.n_slices) for r in SEL.importance(holed).collect()}
    want = {(r.volume_id, r.slice_idx): (r.importance, r.n_slices) for r in SEL.importance(df.filter("slice_idx <> 3")).collect()}
    assert got == want and all(0 <= x <= 1 for x, _ in got.values())


def test_samplers_stay_inside_and_small_volumes_keep_all(spark):
    vols = spark.createDataFrame([(f"v{n}", n) for n in range(1, 40)], "volume_id string, n_slices int")
    for mode in ("uniform_k", "random_k"):
        got = {}
        for r in SEL.sample_slices(vols, mode, k=6, seed=1).collect():
            got.setdefault(int(r.volume_id[1:]), []).append(r.slice_idx)
        assert all(sorted(set(v)) == sorted(v) and len(v) == min(6, n) and 0 <= min(v) and max(v) < n for n, v in got.items())


def test_pca_matches_svd(spark):
    df = EM.mean_embeddings(embedded(spark, sizes=(2,) * 20, dim=4))
    scores, share = PR.pca_scores(df)
    x = np.array([r.emb for r in df.orderBy("volume_id").collect()])
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    got = np.array([[r.pc1, r.pc2] for r in scores.orderBy("volume_id").collect()])
    vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])[:, None]
    assert np.allclose(got, c @ vt[:2].T, atol=1e-8) and np.allclose(share, (s[:2] ** 2) / (s ** 2).sum())


def test_probes(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i}", [float(rng.normal() + (i % 2) * 4), float(rng.normal())], "soft" if i % 2 else "sharp", float(i % 2), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "volume_id string, emb array<double>, kernel_class string, label_x double, label_flat double")
    assert PR.kernel_probe(df).first().auroc > 0.95
    assert PR.kernel_probe(df.limit(6)).first().auroc is None
    got = {r.label: r for r in PR.linear_probe(spark, df, df, ["x", "flat"], C=1.0).collect()}
    assert got["x"].auroc > 0.95 and got["flat"].auroc is None and got["x"].n_train == 60


# ---------------------------------------------------------------- files and stream
def test_write_once_leaves_one_of_two_writers(spark, tmp_path):
    path = str(tmp_path / "w")
    with ThreadPoolExecutor(4) as pool:
        runs = [pool.submit(SW.write_once, spark.range(k, k + 1), path) for k in range(4)]
    lost = [r for r in runs if r.exception() is not None]
    assert len(lost) == 3 and all(isinstance(r.exception(), CheckFailed) for r in lost)
    assert [r.id for r in spark.read.parquet(path).collect()] == [next(k for k, r in enumerate(runs) if r.exception() is None)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["w"]  # the losers' folders are gone


def test_ledger_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert SW.append_ledger(spark.range(3), path, "a b/1") and not SW.append_ledger(spark.range(9), path, "a b/1")
    assert SW.append_ledger(spark.range(5, 7).withColumn("extra", F.lit(1)), path, "a b/1", "other=%é")
    assert SW.append_ledger(spark.range(0), path, "empty")
    assert sorted((r.id, r.extra) for r in SW.read_ledger(spark, path).collect()) == [(0, None), (1, None), (2, None), (5, 1), (6, 1)]
    assert {(r._writer, r._batch) for r in SW.read_ledger(spark, path, provenance=True).collect()} == {("main", "a b/1"), ("other=%é", "a b/1")}
    assert SW.committed(spark, path) == {("main", "a b/1"), ("other=%é", "a b/1"), ("main", "empty")}
    with pytest.raises(CheckFailed):
        SW.append_ledger(spark.range(1).withColumnRenamed("id", "_batch"), path, "clash")


def test_ledger_takes_writers_at_once_and_skips_killed_ones(spark, tmp_path):
    path = str(tmp_path / "ledger")
    spark.range(100, 200).write.parquet(f"{path}/.attempt-killed")  # a writer that ended before its rename
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda k: SW.append_ledger(spark.range(k, k + 1), path, str(k % 4)), range(8)))
    assert sum(won) == 4 and SW.read_ledger(spark, path).count() == 4
    assert sorted(r.id % 4 for r in SW.read_ledger(spark, path).collect()) == [0, 1, 2, 3]


def test_failed_publication_is_an_error(spark, tmp_path):
    with pytest.raises(OSError):
        SW.publish(spark, str(tmp_path / "never written"), str(tmp_path / "t"))


def test_first_label_row_wins_in_file_order(spark, tmp_path):
    from scanledger.operators import manifest as M
    (tmp_path / "b.csv").write_text("key,Level\nv1,3\nv2,8\n")
    (tmp_path / "a.csv").write_text("key,Level\nv1,7\nv1,1\nv3,\n")
    labels = SR.read_keyed_labels(spark, str(tmp_path), order="place")
    people = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "key string")
    got = {r.key: r.label_level for r in M.attach_labels(people, labels, "key", "key", order="place").collect()}
    assert got == {"v1": 7.0, "v2": 8.0, "v3": None}


def test_combined_runs_must_agree_on_splits(spark):
    from scanledger.operators import manifest as M
    run = lambda *rows: spark.createDataFrame(rows, "volume_id string, patient_id string, split string")
    assert M.combine_runs([run(("v1", "p", "train")), run(("v2", "p", "train"), ("v1", "p", "val"))]).count() == 2
    with pytest.raises(CheckFailed):
        M.combine_runs([run(("v1", "p", "train")), run(("v2", "p", "val"))])


def test_sidecars_by_file_name(spark, tmp_path):
    (tmp_path / "v1.meta.json").write_text('{"fingerprint": "f", "stats": {"n_slices": 3}}')
    (tmp_path / "v2.meta.json").write_text('{"fingerprint": ')
    rows = SR.read_sidecars(spark, str(tmp_path)).collect()
    assert [(r.volume_id, r.stats.n_slices) for r in rows] == [("v1", 3)]


def test_file_types_without_reading_whole_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    marked = b"\0" * 128 + b"DICM"
    for name, content in {"noext": marked, "other": b"\0" * 140, "a.DCM": b"x", "empty": b"", "short": marked[:131], "v.nii.gz": marked, "odd #1 %41 name": marked}.items():
        (tmp_path / "sub" / name).write_bytes(content)
    with open(tmp_path / "huge", "wb") as f:  # more than a row could hold, so it cannot have been read
        f.write(marked)
        f.truncate(3 << 30)
    files = SR.read_inventory(spark, str(tmp_path), uri=True)
    got = {r.path: r.kind for r in SR.sniff_types(files).collect()}
    assert got == {"sub/noext": "dicom", "sub/other": "other", "sub/a.DCM": "dicom", "sub/short": "other", "sub/v.nii.gz": "nifti",
                   "sub/odd #1 %41 name": "dicom", "huge": "dicom"}


def test_only_heads_of_files_without_a_suffix_are_opened(spark, tmp_path):
    """Bytes read are counted where the files are opened; a file that is gone since the listing is no error."""
    import pyarrow as pa

    from scanledger.sources.raw import heads
    (tmp_path / "big").write_bytes(b"a" * 1_000_000)
    batch = pa.RecordBatch.from_pydict({"uri": [f"file:{tmp_path}/big", f"file:{tmp_path}/gone"]})
    out = next(heads(SR.HEAD_BYTES)(iter([batch])))
    assert [None if h is None else len(h) for h in out.column("head").to_pylist()] == [132, None]
    gone = spark.createDataFrame([("x.dcm", "file:/nowhere/x.dcm"), ("x", "file:/nowhere/x"), (None, None)], "path string, uri string")
    assert {r.path: r.kind for r in SR.sniff_types(gone).collect()} == {"x.dcm": "dicom", "x": "other", None: "other"}


def test_pixel_quantiles_equal_numpy(spark, monkeypatch):
    """Resampled floats, whole numbers, one value, signs, infinities, missing pixels, and more counts than a task keeps."""
    from scanledger.operators import pixel_quantiles as Q
    monkeypatch.setattr(Q, "KEPT", 50)
    rng = np.random.default_rng(5)
    volumes = {"floats": rng.normal(size=(6, 50)) * 700 - 300, "close": 1 + rng.random((4, 60)) * 1e-12, "whole": rng.integers(-1024, 3071, (5, 80)).astype(float),
               "one": np.full((3, 7), -1024.0), "zeros": np.array([[0.0, -0.0, 5e-324, -5e-324]]), "two": np.array([[3.0], [9.0]]), "ends": np.array([[-np.inf, -1.0, 2.0, np.inf, 5.0]] * 3)}
    rows = [(name, z, [float(v) for v in px] + [None, float("nan")]) for name, v in volumes.items() for z, px in enumerate(v)]
    df = spark.createDataFrame(rows + [("none", 0, [None]), ("none", 1, None), (None, 0, [1.0])], "volume_id string, z int, pixels array<double>").repartition(5, "z")
    probs = {"low": 0.005, "quarter": 0.25, "mid": 0.5, "high": 0.99}
    got = {r.volume_id: [r[p] for p in probs] for r in Q.value_quantiles(df, probs).collect()}
    assert set(got) == set(volumes)
    for name, v in volumes.items():
        at = np.sort(v.ravel())
        for q, value in zip(probs.values(), got[name]):
            spot = q * (len(at) - 1)
            lo, hi = at[int(np.floor(spot))], at[int(np.ceil(spot))]
            with np.errstate(invalid="ignore"):
                assert np.array_equal(value, lo + (hi - lo) * (spot - np.floor(spot)), equal_nan=True), (name, q)
    assert Q.value_quantiles(df.limit(0), probs).count() == 0


def test_pixel_quantiles_keep_pixels_in_arrays(spark):
    from scanledger.operators import pixel_quantiles as Q
    out = Q.value_quantiles(spark.createDataFrame([(1, [1, 2, 3])], "volume_id bigint, pixels array<smallint>"), {"m": 0.5})
    assert out.collect()[0].m == 2.0 and "Generate" not in out._jdf.queryExecution().toString()


def test_stream_resumes_and_never_repeats(spark, tmp_path):
    source, target, mark = (str(tmp_path / d) for d in ("in", "out", "ck"))

    def chunk(name, rows):
        spark.createDataFrame(rows, "volume_id string, chunk string, failed boolean, error string, cached boolean").coalesce(1).write.mode("append").parquet(source)
    schema = "volume_id string, chunk string, failed boolean, error string, cached boolean"
    chunk("a", [("v1", "a", False, None, False), ("v2", "a", True, "boom", False)])
    assert IN.ingest(spark, source, schema, target, mark) == 1
    assert IN.ingest(spark, source, schema, target, mark) == 0
    chunk("b", [("v1", "b", False, None, False), ("v3", "b", False, None, True)])
    chunk("c", [("v4", "c", False, None, False)])
    assert IN.ingest(spark, source, schema, target, mark, max_chunks=1) == 1
    assert IN.ingest(spark, source, schema, target, mark) == 1
    accepted = [r.volume_id for r in IN.read_table(spark, target, "accepted").collect()]
    assert sorted(accepted) == ["v1", "v3", "v4"]
    assert [r.volume_id for r in IN.read_table(spark, target, "failures").collect()] == ["v2"]
    events = {r.chunk: (r.n_volumes, r.n_ok, r.n_cached, r.n_failed) for r in IN.chunk_events(spark, target).collect()}
    assert events == {"a": (2, 1, 0, 1), "b": (2, 1, 1, 0), "c": (1, 1, 0, 0)}


def test_stream_survives_unreadable_chunks(spark, tmp_path):
    source, target, mark = (tmp_path / d for d in ("in", "out", "ck"))
    schema = "volume_id string, chunk string, failed boolean, error string, cached boolean"
    source.mkdir()

    def good(name, volume):
        spark.createDataFrame([(volume, name, False, "none", False)], schema).toPandas().to_parquet(source / f"{name}.parquet")

    def run(**limits):
        return IN.ingest(spark, str(source), schema, str(target), str(mark), **limits)

    def volumes():
        return sorted(r.volume_id for r in IN.read_table(spark, str(target), "accepted").collect())

    def failing():
        return {r.chunk.rsplit("/", 1)[1]: r.attempts for r in IN.failed_chunks(spark, str(target)).collect()}
    good("a", "v1")
    (source / "b.parquet").write_bytes(b"not a table")
    assert run() == 2 and volumes() == ["v1"] and failing() == {"b.parquet": 1}
    assert run() == 1 and failing() == {"b.parquet": 2}
    good("b", "v2")
    assert run() == 1 and volumes() == ["v1", "v2"] and failing() == {}
    assert run() == 0
    for name in "cdefg":
        (source / f"{name}.parquet").write_bytes(b"not a table")
    assert run(max_streak=3) == 3 and len(failing()) == 3


def test_files_of_a_batch_are_read_together_and_nothing_earlier_again(spark, tmp_path, monkeypatch):
    source, target, mark = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "volume_id string, chunk string, failed boolean, error string, cached boolean"
    (tmp_path / "in").mkdir()
    for k in range(40):
        if k == 17:
            (tmp_path / "in" / f"c{k:02}.parquet").write_bytes(b"not a table")
        else:
            spark.createDataFrame([(f"v{k}", f"c{k}", False, None, False), (f"v{k // 2}", f"c{k}", False, None, False)], schema).toPandas().to_parquet(tmp_path / "in" / f"c{k:02}.parquet")
    batches, read = [], IN.read_files
    monkeypatch.setattr(IN, "read_files", lambda s, paths, t: batches.append(paths) or read(s, paths, t))
    assert IN.ingest(spark, source, schema, target, mark, files_per_batch=10) == 40
    assert [len(b) for b in batches] == [10, 10, 10, 10] and len({p for b in batches for p in b}) == 40  # every file once, ten at a time
    tries = IN.attempts(spark, target).collect()
    assert len(tries) == 40 and [r.chunk.rsplit("/", 1)[1] for r in tries if r.failed] == ["c17.parquet"]
    accepted = IN.read_table(spark, target, "accepted").collect()
    assert sorted(r.volume_id for r in accepted) == sorted({v for k in range(40) if k != 17 for v in (f"v{k}", f"v{k // 2}")})
    assert IN.ingest(spark, source, schema, target, mark) == 1 and batches[-1] == [r.chunk for r in tries if r.failed]


def test_a_killed_run_leads_to_the_same_tables(spark, tmp_path, monkeypatch):
    schema = "volume_id string, chunk string, failed boolean, error string, cached boolean"
    (tmp_path / "in").mkdir()
    for k in range(6):
        spark.createDataFrame([(f"v{k % 4}", f"c{k}", k == 5, "bad", False)], schema).toPandas().to_parquet(tmp_path / "in" / f"c{k}.parquet")
    run = lambda name: IN.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / name), str(tmp_path / f"{name}-mark"), files_per_batch=2)
    assert run("whole") == 6
    accept, calls = IN.accept, []

    def killed(*args):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        accept(*args)
    monkeypatch.setattr(IN, "accept", killed)  # killed after the second batch was landed and before it was accepted
    with pytest.raises(KeyboardInterrupt):
        run("cut")
    monkeypatch.setattr(IN, "accept", accept)
    assert run("cut") == 2
    for name in ("accepted", "failures", "outcomes", "attempts"):
        one, two = (sorted(map(repr, IN.read_table(spark, str(tmp_path / d), name).collect())) for d in ("whole", "cut"))
        assert one == two, name


def test_attempts_start_again_after_a_success(spark):
    rows = [("x", 1, True), ("x", 2, True), ("x", 3, False), ("y", 1, False), ("y", 2, True), ("z", 1, True), ("z", 2, True)]
    got = {r.chunk: r.attempts for r in IN.failed_attempts(spark.createDataFrame(rows, "chunk string, attempt int, failed boolean")).collect()}
    assert got == {"y": 1, "z": 2}


def test_no_failure_is_left_out_of_the_maps(spark):
    log = spark.range(1001).select(F.lit("c").alias("chunk"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("volume_id"), F.lit(True).alias("failed"), F.lit("e").alias("error"))
    maps = IN.failed_maps(log, 100).collect()
    assert len({k for r in maps for k in r.failed}) == 1001 and {r.n_failed for r in maps} == {1001} and max(len(r.failed) for r in maps) < 200


def _fit_rows(spark, rows):
    return spark.createDataFrame([(str(k), "v", p, float(y), "soft") for k, (p, y) in enumerate(rows)], "volume_id string, label string, p double, y double, kernel_class string")


@pytest.mark.parametrize("method", ["platt", "temperature"])
def test_separated_labels_have_one_calibration(spark, method):
    from scanledger.operators import calibration
    rows = [(0.1, 0), (0.2, 0), (0.3, 0), (0.4, 0), (0.55, 1), (0.6, 1), (0.9, 1)]
    fits = [calibration.fit(spark, _fit_rows(spark, rows), method, max_passes=n).first() for n in (30, 60)]
    assert fits[0] == fits[1] and fits[0].slope > 1
    z = [math.log(p / (1 - p)) for p, _ in rows]
    t = [4 / 5 if y else 1 / 6 for _, y in rows]
    off = [1 / (1 + math.exp(-(fits[0].slope * s + fits[0].intercept))) - want for s, want in zip(z, t)]
    assert abs(sum(o * s for o, s in zip(off, z))) < 1e-9 and (method == "temperature" or abs(sum(off)) < 1e-9)


@pytest.mark.parametrize("rows,why", [([(0.9, 0), (0.8, 0), (0.2, 1)], "reversed"), ([(0.4, 0), (0.4, 1)], "one score"), ([(0.1, 1), (0.9, 1)], "one class"),
                                      ([(0.5, 0), (0.5, 1), (0.9, 0), (0.1, 1)], "reversed with a tie")])
def test_nothing_to_calibrate_is_the_identity(spark, rows, why):
    from scanledger.operators import calibration
    got = calibration.fit(spark, _fit_rows(spark, rows)).first()
    assert (got.slope, got.intercept) == (1.0, 0.0), why


def test_quasi_separated_label_is_smoothed(spark):
    from scanledger.operators import calibration
    rows = _fit_rows(spark, [(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)])
    told = calibration.residuals(rows, calibration.fit(spark, rows), "platt").first()
    assert told.targets == "smoothed" and abs(told.slope_residual) < 1e-9 and abs(told.intercept_residual) < 1e-9


def test_chi_square_tail_equals_closed_forms(spark):
    """Even degrees by the Poisson sum, odd ones by erfc and its recurrence."""

    from scanledger.functions.numeric import chi_square_tail

    def tail(chi2, dof):
        x = chi2 / 2
        if dof % 2 == 0:
            return sum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(dof // 2))
        return math.erfc(math.sqrt(x)) + sum(math.exp((k - 0.5) * math.log(x) - x - math.lgamma(k + 0.5)) for k in range(1, (dof + 1) // 2))

    cases = [(float(c), d) for d in (1, 2, 3, 4, 7, 30, 101, 400) for c in (1e-6, 0.3, 1, d - 0.5, d + 1, d + 2.5, 2 * d + 3, 5 * d + 20)]
    got = spark.createDataFrame(cases, "chi2 double, dof bigint").select("chi2", "dof", chi_square_tail(F.col("chi2"), F.col("dof")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(tail(r.chi2, r.dof), rel=1e-8, abs=1e-11), r
    edge = spark.createDataFrame([(0.0, 3), (2.0, 0), (None, 2)], "chi2 double, dof bigint").select(chi_square_tail(F.col("chi2"), F.col("dof")).alias("p")).collect()
    assert [r.p for r in edge] == [1.0, None, None]


def test_probes_of_all_targets_equal_single_ones(spark):
    """Fitted together, with gaps in the labels, every target is the minimum that a fit of its own has; jobs do not grow with targets."""
    draw = random.Random(5)
    rows = []
    for _ in range(300):
        x = [draw.gauss(0, 1 + k) for k in range(4)]
        ys = [float(x[0] + draw.gauss(0, 1) > 0), None if draw.random() < 0.2 else float(x[1] - x[2] > draw.gauss(0, 3)), 1.0, None]
        rows.append((x + [7.0], ys))
    df = spark.createDataFrame(rows, "emb array<double>, ys array<double>").repartition(3)
    together = PR.fit_probes(df, 0.5, weighted=True)
    assert together[2].beta is None and (together[3].n, together[3].beta) == (0, None)
    for t in (0, 1):
        alone = PR.fit_probes(df.select("emb", F.array(F.col("ys")[t]).alias("ys")), 0.5, weighted=True)[0]
        assert together[t].beta == pytest.approx(alone.beta, abs=1e-8) and together[t].beta[5] == 0
    named = df.select("emb", F.col("ys")[0].alias("label_a"), F.col("ys")[1].alias("label_b"))
    assert all(abs(r.slope) < 1e-6 for r in PR.score_equations(named, ["a", "b"], C=0.5, weighted=True).collect())
    assert PR.fit_probes(df.limit(0), 0.5) == {}
