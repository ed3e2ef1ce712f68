"""Registered queries: embedding analytics, attention, evidence and slice selection (section 2.10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from scanledger.operators import embeddings as E, predictions as P, probes as PR, selection as S

from . import Registry, fixtures as X
from .common import r, rs, tidy

reg = Registry()
DOT = "list_inner_product"
NORM = "sqrt(list_inner_product(emb,emb))"
UNITS = f"(SELECT volume_id, slice_idx, list_transform(emb, lambda e: e/greatest({NORM},1e-8)) AS u, emb FROM slices)"
LONG = "(SELECT volume_id, slice_idx, i, emb[i+1] AS v FROM slices, (SELECT unnest(range(64)) AS i))"


def sl(spark, sf):
    return X.slices(spark, sf)


def idx(df):
    return df.withColumn("slice_idx", F.col("slice_idx").cast("bigint"))


@reg.add("em1_mean_embedding", f"SELECT volume_id, i, {r('avg(v)', 'v')} FROM {LONG} GROUP BY 1,2")
def _(spark, sf):
    return tidy(E.mean_embeddings(sl(spark, sf)).select("volume_id", F.posexplode("emb").alias("i", "v")))


STATS = f"(SELECT i, avg(v) AS m, greatest(stddev_pop(v),1e-6) AS s FROM {LONG} WHERE volume_id::INT%3=0 GROUP BY 1)"


def train_norm(spark, sf):
    return E.feature_norm(sl(spark, sf).filter(F.col("volume_id").cast("int") % 3 == 0))


@reg.add("em2_feature_norm", f"SELECT i, {r('m', 'mean')}, {r('s', 'std')} FROM {STATS}")
def _(spark, sf):
    n = train_norm(spark, sf).select(F.posexplode(F.arrays_zip("mean", "std")).alias("i", "x"))
    return tidy(n.select("i", "x.mean", "x.std"))


@reg.add("em2_standardised", f"SELECT volume_id, slice_idx::BIGINT AS slice_idx, l.i, {r('(v-m)/s', 'v')} FROM {LONG} l JOIN {STATS} t ON l.i=t.i")
def _(spark, sf):
    return tidy(E.apply_norm(sl(spark, sf), train_norm(spark, sf)).select("volume_id", "slice_idx", F.posexplode("emb").alias("i", "v")))


DIAG = f"(SELECT volume_id, count(*) AS n_slices, avg({NORM}) AS norm_mean, stddev_pop({NORM}) AS norm_std, max(list_max(list_transform(emb,lambda e: abs(e)))) AS abs_max FROM slices GROUP BY 1)"


@reg.add("em3_norm_diagnostics", f"SELECT volume_id, n_slices, true AS finite, {rs('norm_mean', 'norm_std', 'abs_max')} FROM {DIAG}")
def _(spark, sf):
    return tidy(E.norm_diagnostics(sl(spark, sf)))


@reg.add("so2_extreme_norms", f"SELECT * FROM (SELECT volume_id, {rs('norm_mean')} FROM {DIAG} ORDER BY norm_mean, volume_id LIMIT 2) UNION SELECT * FROM (SELECT volume_id, {rs('norm_mean')} FROM {DIAG} ORDER BY norm_mean DESC, volume_id DESC LIMIT 2)")
def _(spark, sf):
    # rounded before they are ranked: means that differ in later digits are ties, which the id settles
    return E.extreme_rows(tidy(E.norm_diagnostics(sl(spark, sf)).select("volume_id", "norm_mean")), "norm_mean")


@reg.add("em4_slice_cosine_band", f"SELECT a.volume_id, a.slice_idx::BIGINT AS i, b.slice_idx::BIGINT AS j, {r(f'{DOT}(a.u,b.u)', 'cosine')} FROM {UNITS} a JOIN {UNITS} b ON a.volume_id=b.volume_id AND b.slice_idx-a.slice_idx BETWEEN 1 AND 3")
def _(spark, sf):
    return tidy(E.slice_cosine_band(sl(spark, sf), 3))


@reg.add("em4_mean_similarity", f"SELECT a.volume_id, a.slice_idx::BIGINT AS slice_idx, {r(f'avg({DOT}(a.u,b.u))', 'mean_cosine')} FROM {UNITS} a JOIN {UNITS} b ON a.volume_id=b.volume_id GROUP BY 1,2")
def _(spark, sf):
    return tidy(E.mean_similarity(sl(spark, sf)))


@reg.add("wn4_neighbour_cosine", f"SELECT a.volume_id, a.slice_idx::BIGINT AS slice_idx, {r(f'{DOT}(a.u,b.u)', 'cosine')} FROM {UNITS} a JOIN {UNITS} b ON a.volume_id=b.volume_id AND b.slice_idx=a.slice_idx+1")
def _(spark, sf):
    return tidy(E.neighbour_cosine(sl(spark, sf)))


def pca_sql(squarings: int = 14) -> str:
    """Scores on the two leading components, by squaring the covariance matrix until one direction is left. The greatest diagonal entry of that
    matrix belongs to the greatest loading, whose column has it positive."""
    def leading(name: str, matrix: str) -> str:
        steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, c/sum(c) FILTER (i=j) OVER () AS c FROM {matrix})"]
        for k in range(squarings):
            steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT i, j, c/sum(c) FILTER (i=j) OVER () AS c FROM (SELECT a.i, b.j, sum(a.c*b.c) AS c FROM {name}_{k} a JOIN {name}_{k} b ON a.j=b.i GROUP BY 1,2))")
        last = f"{name}_{squarings}"
        steps.append(f"{name} AS MATERIALIZED (SELECT i, c/sqrt(sum(c*c) OVER ()) AS v FROM {last} WHERE j=(SELECT arg_max(i,c) FROM {last} WHERE i=j))")
        return ", ".join(steps)
    return f"""WITH means AS (SELECT volume_id, i, avg(v) AS v FROM {LONG} GROUP BY 1,2), centred AS MATERIALIZED (SELECT volume_id, i, v-avg(v) OVER (PARTITION BY i) AS x FROM means),
      cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x*b.x) AS c FROM centred a JOIN centred b ON a.volume_id=b.volume_id GROUP BY 1,2), {leading("first_axis", "cov")},
      rest AS MATERIALIZED (SELECT c.i, c.j, c.c-size*a.v*b.v AS c FROM cov c JOIN first_axis a ON a.i=c.i JOIN first_axis b ON b.i=c.j,
        (SELECT sum(c.c*a.v*b.v) AS size FROM cov c JOIN first_axis a ON a.i=c.i JOIN first_axis b ON b.i=c.j)), {leading("second_axis", "rest")}
      SELECT volume_id, {r("sum(x*a.v)", "pc1")}, {r("sum(x*b.v)", "pc2")} FROM centred c JOIN first_axis a ON a.i=c.i JOIN second_axis b ON b.i=c.i GROUP BY 1"""


@reg.add("em5_pca_scores", pca_sql())
def _(spark, sf):
    return tidy(PR.pca_scores(E.mean_embeddings(sl(spark, sf)))[0])


def labelled(spark, sf):
    """Slice rows as small volumes of one embedding each, with a kernel class and labels from the stored label."""
    e = X.table(spark, sf, "embeddings")
    label = F.col("label")
    return e.select(F.col("vec_id").cast("string").alias("volume_id"), F.col("embedding").cast("array<double>").alias("emb"), F.when(label % 2 == 0, "sharp").otherwise("soft").alias("kernel_class"),
                    F.when(F.col("vec_id") % 11 > 0, (label % 3 == 0).cast("double")).alias("label_third"), (label < 3).cast("double").alias("label_low"), (F.col("vec_id") % 4 == 0).alias("test"))


@reg.add("em6_kernel_probe")
def _(spark, sf):
    return PR.kernel_probe(labelled(spark, sf))


@reg.add("em7_linear_probe")
def _(spark, sf):
    d = labelled(spark, sf)
    return PR.linear_probe(spark, d.filter("NOT test"), d.filter("test"), ["third", "low"])


@reg.add("em8_weighted_classifier")
def _(spark, sf):
    d = labelled(spark, sf)
    return PR.linear_probe(spark, d.filter("NOT test"), d.filter("test"), ["third", "low"], C=0.1, weighted=True)


@reg.add("em7_score_equations", """SELECT label, place::BIGINT AS place, 0.0::DOUBLE AS slope FROM (VALUES ('third'), ('low')) l(label), range((SELECT len(any_value(embedding))+1 FROM embeddings)) p(place)""")
def _(spark, sf):
    return tidy(PR.score_equations(labelled(spark, sf).filter("NOT test"), ["third", "low"]))


@reg.add("em8_score_equations", """SELECT label, place::BIGINT AS place, 0.0::DOUBLE AS slope FROM (VALUES ('third'), ('low')) l(label), range((SELECT len(any_value(embedding))+1 FROM embeddings)) p(place)""")
def _(spark, sf):
    return tidy(PR.score_equations(labelled(spark, sf).filter("NOT test"), ["third", "low"], C=0.1, weighted=True))


# a fixed small attention model: weights follow a rule so that both engines can state them
def wave(i, j, scale):
    return ((i * 7 + j * 3) % 11 - 5) * scale


LABELS = ["quality", "toxic"]


def model(spark):
    v = [[wave(i, j, 0.05) for j in range(64)] for i in range(3)]
    u = [[wave(i + 2, j + 1, 0.04) for j in range(64)] for i in range(3)]
    w = [[0.7, -0.4, 0.5], [-0.3, 0.6, 0.2]]
    att = spark.createDataFrame([(v, u, [0.1, 0.0, -0.1], [0.0, 0.2, 0.1], w, [0.05, -0.05], LABELS)],
                                "V array<array<double>>, U array<array<double>>, bv array<double>, bu array<double>, w array<array<double>>, bw array<double>, branches array<string>")
    head = spark.createDataFrame([(n, n, [wave(k, j, 0.3) for j in range(64)], 0.1 - 0.2 * k) for k, n in enumerate(LABELS)], "label string, branch string, w array<double>, b double")
    return att, head


def vec(i, j0, scale):
    return f"list_transform(range(64), lambda j: (((({i})*7 + (j+{j0})*3) % 11) - 5)*{scale}::DOUBLE)"


UNIT_ACT = "(tanh({a}+{ba})*(1/(1+exp(-({b}+{bb})))))"
ACT = [UNIT_ACT.format(a=f"{DOT}(emb,{vec(i, 0, 0.05)})", ba=ba, b=f"{DOT}(emb,{vec(i + 2, 1, 0.04)})", bb=bb) for i, (ba, bb) in enumerate([(0.1, 0.0), (0.0, 0.2), (-0.1, 0.1)])]
SCORES = f"""(SELECT volume_id, slice_idx, emb, 'quality' AS branch, 0.7::DOUBLE*g0-0.4::DOUBLE*g1+0.5::DOUBLE*g2+0.05::DOUBLE AS score FROM (SELECT *, {', '.join(f'{a} AS g{i}' for i, a in enumerate(ACT))} FROM slices)
  UNION ALL SELECT volume_id, slice_idx, emb, 'toxic', -0.3::DOUBLE*g0+0.6::DOUBLE*g1+0.2::DOUBLE*g2-0.05::DOUBLE FROM (SELECT *, {', '.join(f'{a} AS g{i}' for i, a in enumerate(ACT))} FROM slices))"""
ATT = f"(SELECT *, exp(score)/sum(exp(score)) OVER (PARTITION BY volume_id, branch) AS attention FROM {SCORES})"
HEAD_W = f"CASE branch WHEN 'quality' THEN {vec(0, 0, 0.3)} ELSE {vec(1, 0, 0.3)} END"
HEAD_B = "CASE {} WHEN 'quality' THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END"
CONTRIB = f"(SELECT volume_id, branch AS label, slice_idx, attention*{DOT}(emb,{HEAD_W}) AS contribution FROM {ATT})"
LOGITS = f"(SELECT volume_id, label, sum(contribution)+any_value({HEAD_B.format('label')}) AS logit FROM {CONTRIB} GROUP BY 1,2)"


def attended(spark, sf):
    att, _ = model(spark)
    return E.group_softmax(E.attention_scores(sl(spark, sf), att), ["volume_id", "branch"])


def logits(spark, sf):
    return E.linear_head(E.softmax_pool(E.attention_scores(sl(spark, sf), model(spark)[0])), model(spark)[1])


@reg.add("em9_attention_scores", f"SELECT volume_id, slice_idx::BIGINT AS slice_idx, branch, {r('score', 'score')} FROM {SCORES}")
def _(spark, sf):
    return tidy(E.attention_scores(sl(spark, sf), model(spark)[0]).select("volume_id", "slice_idx", "branch", "score"))


@reg.add("wn10_group_softmax", f"SELECT volume_id, slice_idx::BIGINT AS slice_idx, branch, {r('attention', 'attention')} FROM {ATT}")
def _(spark, sf):
    return tidy(attended(spark, sf).select("volume_id", "slice_idx", "branch", "attention"))


@reg.add("em9_attention_pool", f"SELECT volume_id, branch, i, {r('sum(attention*emb[i+1])', 'v')} FROM {ATT}, (SELECT unnest(range(64)) AS i) GROUP BY 1,2,3")
def _(spark, sf):
    return tidy(E.softmax_pool(E.attention_scores(sl(spark, sf), model(spark)[0])).select("volume_id", "branch", F.posexplode("pooled").alias("i", "v")))


@reg.add("em10_linear_head", f"SELECT volume_id, label, {r('logit', 'logit')}, {r('1/(1+exp(-logit))', 'p')} FROM {LOGITS}")
def _(spark, sf):
    return tidy(logits(spark, sf))


@reg.add("em11_slice_contributions", f"SELECT volume_id, label, slice_idx::BIGINT AS slice_idx, {r('contribution', 'contribution')} FROM {CONTRIB}")
def _(spark, sf):
    return tidy(E.slice_contributions(attended(spark, sf), model(spark)[1]))


@reg.add("em11_contribution_check", f"SELECT c.volume_id, c.label, {r('abs(any_value(l.logit)-1.0-any_value(l.logit))', 'error')} FROM {CONTRIB} c JOIN {LOGITS} l USING (volume_id, label) WHERE label='toxic' GROUP BY 1,2")
def _(spark, sf):
    """Contributions of one label are checked against logits moved by one, so its rows come out and the exact ones do not."""
    head = model(spark)[1]
    a = attended(spark, sf)
    moved = E.linear_head(E.attention_pool(a), head).withColumn("logit", F.col("logit") - F.when(F.col("label") == "toxic", 1.0).otherwise(0.0))
    return tidy(E.contribution_errors(E.slice_contributions(a, head), moved, head))


TOP = f"(SELECT *, row_number() OVER (PARTITION BY volume_id, label ORDER BY contribution DESC, slice_idx) AS rank FROM {CONTRIB})"


@reg.add("so1_top_slices", f"SELECT volume_id, label, rank, slice_idx::BIGINT AS slice_idx, {r('contribution', 'contribution')} FROM {TOP} WHERE rank<=3")
def _(spark, sf):
    return tidy(E.top_slices(E.slice_contributions(attended(spark, sf), model(spark)[1]), 3).select("volume_id", "label", "rank", "slice_idx", "contribution"))


@reg.add("em12_evidence", f"""SELECT l.volume_id, l.label, {r('1/(1+exp(-logit))', 'p')}, 0.5::DOUBLE AS threshold, CASE l.label WHEN 'quality' THEN f.label_quality ELSE f.label_toxic END AS true_label, t.s AS top_slices FROM {LOGITS} l
  JOIN (SELECT volume_id, label, string_agg(slice_idx, ',' ORDER BY rank) AS s FROM {TOP} WHERE rank<=3 GROUP BY 1,2) t USING (volume_id, label) LEFT JOIN findings f ON f.volume_id=l.volume_id WHERE 1/(1+exp(-logit))>=0.5""")
def _(spark, sf):
    from scanledger.operators.manifest import labels_long
    head = model(spark)[1]
    a = attended(spark, sf)
    thresholds = head.select("label", F.lit(0.5).alias("threshold"))
    out = E.evidence(E.slice_contributions(a, head), E.linear_head(E.attention_pool(a), head), thresholds, labels_long(X.findings(spark, sf), ["volume_id"]), 3)
    return tidy(out.withColumn("top_slices", F.array_join(F.transform("top_slices", lambda s: s["slice_idx"].cast("string")), ",")))


# ---------------------------------------------------------------- selection
COUNTED = "(SELECT volume_id, 1+n_slices%60 AS n FROM findings)"


def counted(spark, sf):
    return X.findings(spark, sf).select("volume_id", (F.lit(1) + F.col("n_slices") % 60).alias("n_slices"))


@reg.add("em13_sample_stride", f"SELECT volume_id, unnest(range(0,n,7)) AS slice_idx FROM {COUNTED}")
def _(spark, sf):
    return S.sample_slices(counted(spark, sf), "stride", stride=7)


@reg.add("em13_sample_all", f"SELECT volume_id, unnest(range(n)) AS slice_idx FROM {COUNTED}")
def _(spark, sf):
    return S.sample_slices(counted(spark, sf), "all")


@reg.add("em13_sample_uniform", f"SELECT volume_id, i AS slice_idx FROM (SELECT volume_id, unnest(range(n)) AS i FROM {COUNTED} WHERE n<=8) UNION ALL SELECT volume_id, (n*(2*i+1))//16 FROM (SELECT *, unnest(range(8)) AS i FROM {COUNTED} WHERE n>8)")
def _(spark, sf):
    return S.sample_slices(counted(spark, sf), "uniform_k", k=8)


RU = "(('0x'||substr(md5('9:'||volume_id||':'||i),1,8))::BIGINT::DOUBLE/4294967296.0::DOUBLE)"


@reg.add("em13_sample_random", f"SELECT volume_id, i AS slice_idx FROM (SELECT volume_id, unnest(range(n)) AS i FROM {COUNTED} WHERE n<=8) UNION ALL SELECT volume_id, lo+floor({RU}*(hi-lo))::BIGINT FROM (SELECT volume_id, i, (n*i+7)//8 AS lo, (n*(i+1)+7)//8 AS hi FROM (SELECT *, unnest(range(8)) AS i FROM {COUNTED} WHERE n>8))")
def _(spark, sf):
    return S.sample_slices(counted(spark, sf), "random_k", k=8, seed=9)


DEV = f"(SELECT volume_id, slice_idx, sqrt(sum((v-m)*(v-m))) AS raw FROM (SELECT *, median(v) OVER (PARTITION BY volume_id, i) AS m FROM {LONG}) GROUP BY 1,2)"
IMP = f"(SELECT volume_id, slice_idx, count(*) OVER w AS n_slices, (raw-min(raw) OVER w)/greatest(max(raw) OVER w-min(raw) OVER w,1e-8) AS importance FROM {DEV} WINDOW w AS (PARTITION BY volume_id))"


def scored(spark, sf):
    return S.importance(sl(spark, sf))


@reg.add("em14_importance_deviation", f"SELECT volume_id, slice_idx::BIGINT AS slice_idx, n_slices, {r('importance', 'importance')} FROM {IMP}")
def _(spark, sf):
    return tidy(scored(spark, sf))


@reg.add("em14_importance_norm", f"SELECT volume_id, slice_idx::BIGINT AS slice_idx, 10::BIGINT AS n_slices, {r('(n-min(n) OVER w)/greatest(max(n) OVER w-min(n) OVER w,1e-8)', 'importance')} FROM (SELECT volume_id, slice_idx, {NORM} AS n FROM slices) WINDOW w AS (PARTITION BY volume_id)")
def _(spark, sf):
    return tidy(S.importance(sl(spark, sf), "norm"))


@reg.add("em15_select_uniform", "SELECT DISTINCT volume_id, round_even(i*9/3.0::DOUBLE,0)::BIGINT AS slice_idx FROM slices, (SELECT unnest(range(4)) AS i)")
def _(spark, sf):
    return S.select_uniform(scored(spark, sf), 4)


@reg.add("em15_select_random", "SELECT volume_id, slice_idx::BIGINT AS slice_idx FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY md5('5:'||volume_id||':'||slice_idx), slice_idx) AS r FROM slices) WHERE r<=4")
def _(spark, sf):
    return S.select_random(scored(spark, sf), 4, 5)


IMPORTANT = f"(SELECT volume_id, slice_idx::BIGINT AS slice_idx FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY importance DESC, slice_idx) AS r FROM {IMP}) WHERE r<=4)"


@reg.add("em15_select_important", f"SELECT * FROM {IMPORTANT}")
def _(spark, sf):
    return S.select_important(scored(spark, sf), 4)


@reg.add("em15_select_stratified", f"SELECT volume_id, slice_idx::BIGINT AS slice_idx FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, part ORDER BY importance DESC, slice_idx) AS r FROM (SELECT *, ntile(4) OVER (PARTITION BY volume_id ORDER BY slice_idx) AS part FROM {IMP})) WHERE r=1")
def _(spark, sf):
    return S.select_stratified(scored(spark, sf), 4)


GAPPED = "(SELECT volume_id, slice_idx*2+10 AS slice_idx, n_slices, importance FROM %s)" % IMP


def gapped(df):
    return df.withColumn("slice_idx", F.col("slice_idx") * 2 + 10)


@reg.add("em15_select_stratified_gaps", f"SELECT volume_id, slice_idx::BIGINT AS slice_idx FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, part ORDER BY importance DESC, slice_idx) AS r FROM (SELECT *, ntile(4) OVER (PARTITION BY volume_id ORDER BY slice_idx) AS part FROM {GAPPED})) WHERE r=1")
def _(spark, sf):
    return S.select_stratified(gapped(scored(spark, sf)), 4)


HOLED = "(SELECT volume_id, slice_idx, i, v FROM %s WHERE slice_idx<>volume_id::INT%%10)" % LONG


@reg.add("em14_importance_with_nan", f"SELECT volume_id, slice_idx::BIGINT AS slice_idx, count(*) OVER w AS n_slices, {r('(raw-min(raw) OVER w)/greatest(max(raw) OVER w-min(raw) OVER w,1e-8)', 'importance')} FROM (SELECT volume_id, slice_idx, sqrt(sum((v-m)*(v-m))) AS raw FROM (SELECT *, median(v) OVER (PARTITION BY volume_id, i) AS m FROM {HOLED}) GROUP BY 1,2) WINDOW w AS (PARTITION BY volume_id)")
def _(spark, sf):
    hole = F.col("slice_idx") == F.col("volume_id").cast("int") % 10
    return tidy(S.importance(sl(spark, sf).withColumn("emb", F.transform("emb", lambda v: F.when(hole, F.lit(float("nan"))).otherwise(v)))))


def greedy_sql(k, weight=None, shift="slice_idx"):
    """Farthest-first as one CTE per round."""
    w = "OVER (PARTITION BY volume_id)"
    og = "CASE WHEN chosen THEN 0.0::DOUBLE ELSE near END"
    spread = f"(({og})-min({og}) {w})/greatest(max({og}) {w}-min({og}) {w},1e-8)"
    score = spread if weight is None else f"{weight}::DOUBLE*importance+{1 - weight}::DOUBLE*{spread}"
    start = "(row_number() OVER (PARTITION BY volume_id ORDER BY slice_idx)-1=n_slices//2)::INT::DOUBLE" if weight is None else "importance"
    ctes = [f"s0 AS (SELECT u.volume_id, u.slice_idx, u.u, importance, {start} AS score, false AS chosen, NULL::DOUBLE AS near FROM {UNITS} u JOIN {IMP} i ON u.volume_id=i.volume_id AND u.slice_idx=i.slice_idx)".replace("ORDER BY slice_idx", "ORDER BY u.slice_idx").replace("PARTITION BY volume_id ORDER BY u", "PARTITION BY u.volume_id ORDER BY u")]
    for i in range(k):
        ctes += [f"p{i} AS (SELECT volume_id, slice_idx, u FROM s{i} WHERE NOT chosen QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY score DESC, slice_idx)=1)",
                 f"c{i} AS (SELECT s.volume_id, s.slice_idx, s.u, importance, chosen OR s.slice_idx=p.slice_idx AS chosen, least(near, 1-{DOT}(s.u,p.u)) AS near FROM s{i} s JOIN p{i} p ON s.volume_id=p.volume_id)",
                 f"s{i + 1} AS (SELECT volume_id, slice_idx, u, importance, {score} AS score, chosen, near FROM c{i})"]
    return f"WITH {', '.join(ctes)} SELECT volume_id, ({shift})::BIGINT AS slice_idx FROM c{k - 1} WHERE chosen"


@reg.add("em16_select_diverse", greedy_sql(4))
def _(spark, sf):
    return S.select_greedy(sl(spark, sf), scored(spark, sf), 4)


@reg.add("em16_select_combined", greedy_sql(4, 0.5))
def _(spark, sf):
    return S.select_greedy(sl(spark, sf), scored(spark, sf), 4, 0.5)


@reg.add("em16_select_diverse_gaps", greedy_sql(4, None, "slice_idx*2+10"))
def _(spark, sf):
    return S.select_greedy(gapped(sl(spark, sf)), gapped(scored(spark, sf)), 4)


@reg.add("em17_selection_proxies", f"""WITH sel AS (SELECT u.* FROM {UNITS} u JOIN {IMPORTANT} i ON u.volume_id=i.volume_id AND u.slice_idx=i.slice_idx),
  near AS (SELECT a.volume_id, a.slice_idx, 1-max({DOT}(a.u,s.u)) AS gap FROM {UNITS} a JOIN sel s ON a.volume_id=s.volume_id GROUP BY 1,2),
  drift AS (SELECT volume_id, 1-sum(a*b)/greatest(sqrt(sum(a*a))*sqrt(sum(b*b)),1e-8) AS d FROM (SELECT l.volume_id, i, avg(v) AS a, avg(CASE WHEN s.slice_idx IS NOT NULL THEN v END) AS b FROM {LONG} l LEFT JOIN sel s ON s.volume_id=l.volume_id AND s.slice_idx=l.slice_idx GROUP BY 1,2) GROUP BY 1),
  red AS (SELECT a.volume_id, avg({DOT}(a.u,b.u)) AS r FROM sel a JOIN sel b ON a.volume_id=b.volume_id AND a.slice_idx<b.slice_idx GROUP BY 1),
  gaps AS (SELECT volume_id, max(g) AS g FROM (SELECT volume_id, slice_idx-coalesce(lag(slice_idx) OVER (PARTITION BY volume_id ORDER BY slice_idx),-1)-1 AS g FROM sel UNION ALL SELECT volume_id, 9-max(slice_idx) FROM sel GROUP BY 1) GROUP BY 1)
  SELECT n.volume_id, {r('avg(gap)', 'nearest_cosine_distance')}, {r('quantile_cont(gap,0.95)', 'p95_cosine_distance')}, {r('any_value(d)', 'mean_embedding_drift')}, {r('any_value(red.r)', 'redundancy')}, any_value(g)::BIGINT AS largest_gap, 0.4::DOUBLE AS fraction_encoded
  FROM near n JOIN drift USING (volume_id) JOIN red USING (volume_id) JOIN gaps USING (volume_id) GROUP BY 1""")
def _(spark, sf):
    return tidy(S.selection_proxies(sl(spark, sf), S.select_important(scored(spark, sf), 4)))


@reg.add("wn9_axial_gap", f"SELECT volume_id, max(g)::BIGINT AS largest_gap FROM (SELECT volume_id, slice_idx-coalesce(lag(slice_idx) OVER (PARTITION BY volume_id ORDER BY slice_idx),-1)-1 AS g FROM {IMPORTANT} UNION ALL SELECT volume_id, 9-max(slice_idx) FROM {IMPORTANT} GROUP BY 1) GROUP BY 1")
def _(spark, sf):
    s = scored(spark, sf)
    return S.axial_gap(S.select_important(s, 4), s.select("volume_id", "n_slices").distinct())


PAIRS = "(SELECT DISTINCT volume_id::INT//2 AS pair, (volume_id::INT//2*2)::VARCHAR AS va, (volume_id::INT//2*2+1)::VARCHAR AS vb, volume_id::INT//2%5-2 AS o FROM slices)"


def _pairs(spark, sf):
    v = F.floor(F.col("volume_id").cast("int") / 2)
    return sl(spark, sf).select(v.alias("pair")).distinct().select("pair", (F.col("pair") * 2).cast("string").alias("volume_a"), (F.col("pair") * 2 + 1).cast("string").alias("volume_b"),
                                                                   (F.col("pair") % 5 - 2).cast("int").alias("offset"))


@reg.add("em18_pair_cosine", f"""WITH z AS (SELECT volume_id, slice_idx, list((v-m)/s ORDER BY l.i) AS e FROM {LONG} l JOIN {STATS} t ON l.i=t.i GROUP BY 1,2)
  SELECT pair, {r(f'avg({DOT}(a.e,b.e)/greatest(sqrt({DOT}(a.e,a.e))*sqrt({DOT}(b.e,b.e)),1e-8))', 'mean_cosine')}, count(*) AS n_slices FROM {PAIRS} p JOIN z a ON a.volume_id=va JOIN z b ON b.volume_id=vb AND b.slice_idx=least(greatest(a.slice_idx+o,0),9) GROUP BY 1""")
def _(spark, sf):
    return tidy(E.pair_cosine(E.apply_norm(sl(spark, sf), train_norm(spark, sf)), _pairs(spark, sf)))


@reg.add("em18_pair_decisions", f"SELECT pair, {r('avg(abs(a.p-b.p))', 'mean_abs_dp')}, {r('avg(((a.p>=0.5)<>(b.p>=0.5))::INT)', 'flip_rate')} FROM {PAIRS} JOIN preds_long a ON a.volume_id=va JOIN preds_long b ON b.volume_id=vb AND a.label=b.label GROUP BY 1")
def _(spark, sf):
    return tidy(E.pair_decisions(P.to_long(X.predictions(spark, sf)), _pairs(spark, sf)))


@reg.add("em20_store_compatibility", """SELECT user_id, event_id, array_to_string(list_filter([CASE WHEN event_type<>'click' THEN 'encoder fingerprint' END, CASE WHEN event_id%3=1 THEN 'HU cache fingerprint' END, CASE WHEN event_id%4=2 THEN 'embed_dim' END],lambda x: x IS NOT NULL),',') AS problems FROM events""")
def _(spark, sf):
    e = F.col("event_id")
    rec = X.table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("encoder_fingerprint"), F.when(e % 3 == 0, "fp").when(e % 3 == 1, "old").alias("cache_fingerprint"),
                                              F.when(e % 4 == 2, 32).when(e % 4 == 3, 64).alias("embed_dim"), F.lit(None).cast("string").alias("weights"))
    out = E.store_problems(rec, encoder_fingerprint="click", cache_fingerprint="fp", embed_dim=64, weights="abc")
    return out.select("user_id", "event_id", F.array_join("problems", ",").alias("problems"))


@reg.add("em21_cache_compatibility", "SELECT count(DISTINCT event_type) AS fingerprints, 'refuse' AS decision FROM events")
def _(spark, sf):
    return E.cache_decision(X.table(spark, sf, "events").select(F.col("event_type").alias("fingerprint")), "click")
