"""Registered queries: multi-label metrics, operating points, scorecard (sections 2.12 and 2.13)."""
from __future__ import annotations

from pyspark.sql import functions as F

from scanledger.functions import numeric as N
from scanledger.operators import bootstrap as B, calibration as C, predictions as P, ranking as R, scorecard as S
from scanledger.plans import evaluation as E

from . import Registry, VIEWS_SQL, fixtures as X
from .common import r, rs, tidy

reg = Registry()
GROUPS = ["kernel_class", "manufacturer"]
KEYS = ["group_by", "group", "label"]
IDS = ["volume_id", "patient_id", "scan_id", "kernel_class", "manufacturer"]
PLAIN = E.ReportSettings(calibration="none")
REPORT = E.ReportSettings()
BOOT = 1000


def newton_sql(rows: str, whole: bool, steps: int = 20) -> str:
    """Slope and intercept at the minimum of the log loss on rows (label, kernel, z, t); ``whole``: both numbers, else the slope alone. Rows whose t is NULL have nothing to
    fit. The minimum is unique, so only the number of digits depends on the number of steps."""
    now = f"SELECT DISTINCT label, kernel, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {rows}"
    d1, d2 = ("(h11*g0-h01*g1)/(h00*h11-h01*h01)", "(h00*g1-h01*g0)/(h00*h11-h01*h01)") if whole else ("g0/h00", "0.0::DOUBLE")
    for _ in range(steps):
        now = f"""SELECT label, kernel, CASE WHEN isfinite(size) THEN a-least(1.0,3.0/size)*d1 ELSE a END AS a, CASE WHEN isfinite(size) THEN b-least(1.0,3.0/size)*d2 ELSE b END AS b
          FROM (SELECT *, coalesce(greatest(abs(d1),abs(d2),1e-300::DOUBLE),'nan'::DOUBLE) AS size FROM (SELECT *, {d1} AS d1, {d2} AS d2 FROM (
            SELECT label, kernel, any_value(a) AS a, any_value(b) AS b, sum((q-t)*z) AS g0, sum(q-t) AS g1,
            sum(q*(1-q)*z*z) AS h00, sum(q*(1-q)*z) AS h01, sum(q*(1-q)) AS h11
            FROM (SELECT *, 1/(1+exp(-(a*z+b))) AS q FROM {rows} JOIN ({now}) USING (label, kernel)) GROUP BY 1,2)))"""
    return f"SELECT label, kernel, CASE WHEN a>0 THEN a ELSE 1.0 END AS a, CASE WHEN a>0 THEN b ELSE 0.0 END AS b FROM ({now})"


def targets_sql(rows: str, apart: str = "p0>=n1", flat: str = "z0=z1", reverse: str = "p1<=n0") -> str:
    """Rows (label, kernel, z, y) with the target t of the fit: y, smoothed where the classes are apart, NULL where there is nothing to fit."""
    return f"""SELECT label, kernel, z, y, CASE WHEN n_pos=0 OR n_pos=n OR {flat} OR {reverse} THEN NULL WHEN NOT ({apart}) THEN y::DOUBLE
        WHEN y=1 THEN (n_pos+1.0::DOUBLE)/(n_pos+2) ELSE 1.0::DOUBLE/(n-n_pos+2) END AS t
      FROM ({rows}) JOIN (SELECT label, kernel, count(*) AS n, sum(y)::BIGINT AS n_pos, min(z) AS z0, max(z) AS z1, min(z) FILTER (WHERE y=1) AS p0, max(z) FILTER (WHERE y=1) AS p1,
        min(z) FILTER (WHERE y=0) AS n0, max(z) FILTER (WHERE y=0) AS n1 FROM ({rows}) GROUP BY 1,2) USING (label, kernel)"""


LOGIT_ROWS = "SELECT label, {kernel} AS kernel, ln(q)-ln(1-q) AS z, y FROM (SELECT *, least(greatest(p,1e-6),1-1e-6) AS q FROM {source} WHERE split='val' AND y IS NOT NULL)"
# predictions as the report sees them: ``p`` calibrated on the validation rows, ``p_raw`` as predicted
PLATT = {
    "preds_raw": VIEWS_SQL["preds_long"],
    "logit_rows": targets_sql(LOGIT_ROWS.format(kernel="'*'", source="preds_raw")),
    "platt": newton_sql("logit_rows", True),
    "preds_long": """SELECT r.* EXCLUDE (p), 1/(1+exp(-(a*(ln(q)-ln(1-q))+b))) AS p, p AS p_raw
      FROM (SELECT *, least(greatest(p,1e-6),1-1e-6) AS q FROM preds_raw) r JOIN platt USING (label)""",
}
# the ensemble's mean prediction in the place of the predictions
ENSEMBLE = {
    "predictions_raw": VIEWS_SQL["predictions"],
    "members": VIEWS_SQL["ensemble"].replace("FROM predictions", "FROM predictions_raw"),
    "predictions": """SELECT volume_id, any_value(patient_id) AS patient_id, any_value(scan_id) AS scan_id, any_value(split) AS split, any_value(kernel_class) AS kernel_class,
      any_value(manufacturer) AS manufacturer, round(avg(prob_quality),12) AS prob_quality, round(avg(prob_toxic),12) AS prob_toxic, max(true_quality) AS true_quality, max(true_toxic) AS true_toxic FROM members GROUP BY 1""",
}


def val(spark, sf):
    return P.to_long(X.predictions(spark, sf).filter("split = 'val'"))


def test(spark, sf):
    return P.to_long(X.predictions(spark, sf).filter("split = 'test'"))


def points(spark, sf):
    return E.operating_points(spark, val(spark, sf), PLAIN)[1]


def blocks(spark, sf, groups=GROUPS):
    return S.spread(S.label_blocks(test(spark, sf), groups), groups)


def decided(spark, sf):
    return S.decide(test(spark, sf), points(spark, sf))


def scans(spark, sf):
    return S.per_scan(decided(spark, sf), IDS)


def changes(spark, sf):
    return S.paired_decisions(decided(spark, sf), P.kernel_pairs(X.predictions(spark, sf).filter("split = 'test'")))


# ---------------------------------------------------------------- metrics
@reg.add("me1_auroc_per_label", f'SELECT group_by, "group", label, n, n_pos, {rs("auroc")} FROM label_auc')
def _(spark, sf):
    return tidy(E.per_label_metrics(test(spark, sf), GROUPS).drop("auprc"))


@reg.add("me2_auprc_per_label", f'SELECT group_by, "group", label, {rs("auprc")} FROM label_ap')
def _(spark, sf):
    return tidy(E.per_label_metrics(test(spark, sf), GROUPS).select(*KEYS, "auprc"))


MICRO = """SELECT group_by, "group", (sum(rk*y)-sum(y)*(sum(y)+1)/2)/nullif(sum(y)*(count(*)-sum(y)),0) AS micro_auroc FROM (
  SELECT group_by, "group", y, (rank() OVER (PARTITION BY group_by,"group" ORDER BY p)) + (count(*) OVER (PARTITION BY group_by,"group",p)-1)/2.0::DOUBLE AS rk
  FROM test_grouped WHERE y IS NOT NULL) GROUP BY ALL"""


@reg.add("me3_micro_auroc", f'SELECT group_by, "group", {rs("micro_auroc")} FROM ({MICRO})')
def _(spark, sf):
    return tidy(E.micro_auroc(test(spark, sf), GROUPS))


@reg.add("me4_macro_means", f"""SELECT a.group_by, a."group", count(auroc) AS labels_scored, {r('avg(auroc)', 'macro_auroc')}, {r('avg(auprc)', 'macro_auprc')}
  FROM label_auc a JOIN label_ap b ON a.group_by=b.group_by AND a."group"=b."group" AND a.label=b.label GROUP BY 1,2""")
def _(spark, sf):
    return tidy(R.macro(E.per_label_metrics(test(spark, sf), GROUPS), KEYS[:2], ["auroc", "auprc"]))


PER_LABEL_RATES = """SELECT group_by, "group", label, any_value(max_f1) AS threshold, count(*) AS n, sum(y)::BIGINT AS n_pos,
    count(*) FILTER (flag_f1 AND y=1)::DOUBLE AS tp, count(*) FILTER (flag_f1 AND y=0)::DOUBLE AS fp,
    count(*) FILTER (NOT flag_f1 AND y=1)::DOUBLE AS fn, count(*) FILTER (NOT flag_f1 AND y=0)::DOUBLE AS tn
  FROM scored_grouped WHERE y IS NOT NULL GROUP BY 1,2,3"""


@reg.add("me5_per_label_table", f"""SELECT t.group_by, t."group", t.label, t.n, t.n_pos, {r('auroc', 'auroc')}, {r('auprc', 'auprc')}, {rs('threshold')},
    {r('2*tp/nullif(2*tp+fp+fn,0)', 'f1')}, {r('tp/nullif(tp+fn,0)', 'sensitivity')}, {r('tn/nullif(tn+fp,0)', 'specificity')}, {r('tp/nullif(tp+fp,0)', 'ppv')}
  FROM ({PER_LABEL_RATES}) t JOIN label_auc a USING (group_by,"group",label) JOIN label_ap b USING (group_by,"group",label)""")
def _(spark, sf):
    wide = X.predictions(spark, sf)
    return tidy(E.evaluate(wide.filter("split = 'test'"), E.max_f1_thresholds(val(spark, sf)), GROUPS, n_boot=0)["per_label"])


@reg.add("me6_max_f1_threshold", f"SELECT label, {r('max_f1', 'threshold')} FROM op_points")
def _(spark, sf):
    return tidy(E.max_f1_thresholds(val(spark, sf)))


@reg.add("me7_thresholded_rates", f"""SELECT label, {rs('threshold')}, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
    {r('2*tp/nullif(2*tp+fp+fn,0)', 'f1')}, {r('tp/nullif(tp+fn,0)', 'sensitivity')}, {r('tn/nullif(tn+fp,0)', 'specificity')}, {r('tp/nullif(tp+fp,0)', 'ppv')}
  FROM ({PER_LABEL_RATES}) WHERE group_by='all'""")
def _(spark, sf):
    return tidy(S.thresholded(S.label_blocks(test(spark, sf), []), E.max_f1_thresholds(val(spark, sf)), ["label"]))


def boot_sql(n_boot: int, macro: bool, by=("all", "kernel_class")) -> str:
    """Poisson resamples of patients, drawn by hash, and the intervals of both metrics."""
    weight = "+".join(f"(u>={cut})::INT" for cut in B.POISSON_CUTS)
    keys = 'group_by, "group"' + ("" if macro else ", label")
    last = 'SELECT group_by,"group",b,avg(auroc) AS auroc,avg(auprc) AS auprc FROM per_draw GROUP BY ALL' if macro else "SELECT * FROM per_draw"
    ends = ", ".join(r(f"quantile_cont({m},{q})", f"{m}_{end}") for m in B.METRICS for end, q in (("ci_low", 0.025), ("ci_high", 0.975)))
    return f"""WITH res AS (SELECT b, ('0x'||substr(md5('0:'||b),1,8))::BIGINT%{B.PRIME - 1}+1 AS a, ('0x'||substr(md5('0:'||b),9,8))::BIGINT%{B.PRIME} AS c FROM (SELECT unnest(range({n_boot})) AS b)),
      pats AS (SELECT patient_id, ('0x'||substr(md5(patient_id),1,8))::BIGINT%{B.PRIME} AS h FROM (SELECT DISTINCT patient_id FROM test_long)),
      weighted AS (SELECT patient_id, b, {weight} AS w FROM (SELECT patient_id, b, (a*h+c)%{B.PRIME}//32768 AS u FROM pats, res)),
      blocks AS (SELECT group_by,"group",label,b,p,sum(w)::DOUBLE AS n,sum(w*y)::DOUBLE AS pos FROM test_grouped JOIN weighted USING (patient_id)
        WHERE y IS NOT NULL AND w>0 AND group_by IN ({','.join(f"'{g}'" for g in by)}) GROUP BY ALL),
      ordered AS (SELECT *, sum(pos) OVER w AS pos_to, sum(n) OVER w AS n_to, sum(pos) OVER g AS tp, sum(n) OVER g AS tn FROM blocks
        WINDOW w AS (PARTITION BY group_by,"group",label,b ORDER BY p DESC), g AS (PARTITION BY group_by,"group",label,b)),
      per_draw AS (SELECT group_by,"group",label,b,sum((n-pos)*(pos_to-0.5::DOUBLE*pos))/(any_value(tp)*(any_value(tn)-any_value(tp))) AS auroc, sum(pos/tp*(pos_to/n_to)) AS auprc
        FROM ordered WHERE tp>0 AND tn>tp GROUP BY 1,2,3,4)
      SELECT {keys}, {ends} FROM ({last}) GROUP BY ALL"""


@reg.add("me8_macro_bootstrap_ci", boot_sql(BOOT, True))
def _(spark, sf):
    return tidy(B.macro_intervals(test(spark, sf), BOOT, group_columns=["kernel_class"]))


@reg.add("me9_label_bootstrap_ci", boot_sql(BOOT, False))
def _(spark, sf):
    return tidy(B.label_intervals(test(spark, sf), BOOT, group_columns=["kernel_class"]))


LOSSES = """SELECT label, avg(-(y*ln(q)+(1-y)*ln(u))) AS bce, avg(-(w*y*ln(q)+(1-y)*ln(u))) AS weighted_bce,
    avg(-((y*ln(greatest(p,1e-8))+(1-y)*ln(greatest(m,1e-8)))*pow(1-(p*y+m*(1-y)),1.0*y+4.0*(1-y)))) AS asl
  FROM (SELECT *, least(greatest(p,1e-12),1.0) AS q, least(greatest(1-p,1e-12),1.0) AS u, least(1-p+0.05::DOUBLE,1.0) AS m,
          (count(*) OVER (PARTITION BY label)-sum(y) OVER (PARTITION BY label))/sum(y) OVER (PARTITION BY label) AS w FROM preds_long WHERE y IS NOT NULL) GROUP BY label"""


@reg.add("me10_masked_losses", f"SELECT label, {rs('bce', 'weighted_bce', 'asl')} FROM ({LOSSES})")
def _(spark, sf):
    long = P.to_long(X.predictions(spark, sf)).filter(F.col("y").isNotNull())
    weight = long.groupBy("label").agg(N.ratio(F.count(F.lit(1)) - F.sum("y"), F.sum("y")).alias("w"))
    p, y = F.col("p"), F.col("y")
    return tidy(long.join(weight, "label").groupBy("label").agg(
        F.avg(N.bce(p, y)).alias("bce"), F.avg(N.bce(p, y, F.col("w"))).alias("weighted_bce"), F.avg(N.asymmetric_loss(p, y)).alias("asl")))


@reg.add("me11_long_predictions", "SELECT volume_id, label, p, y, kernel_class FROM preds_long")
def _(spark, sf):
    return P.to_long(X.predictions(spark, sf)).select("volume_id", "label", "p", "y", "kernel_class")


@reg.add("me11_wide_again", "SELECT volume_id, prob_quality, prob_toxic, true_quality, true_toxic FROM predictions")
def _(spark, sf):
    long = P.to_long(X.predictions(spark, sf))
    return P.to_wide(long, ["volume_id"], {"prob_": "p", "true_": "y"}, ["quality", "toxic"])


MACRO_CI = ", ".join(f"{m}_{end} AS macro_{m}_{end}" for m in B.METRICS for end in ("ci_low", "ci_high"))


@reg.add("me12_evaluate", f"""SELECT s.*, labels_scored, macro_auroc, macro_auprc, macro_f1, macro_sensitivity, macro_specificity, macro_ppv, {rs('micro_auroc')}, {MACRO_CI}
  FROM (SELECT group_by,"group",count(DISTINCT volume_id) AS n_volumes,count(DISTINCT patient_id) AS n_patients,count(DISTINCT volume_id)<100 AS too_small FROM test_grouped GROUP BY ALL) s
  LEFT JOIN (SELECT t.group_by, t."group", count(auroc) AS labels_scored, {r('avg(auroc)', 'macro_auroc')}, {r('avg(auprc)', 'macro_auprc')}, {r('avg(2*tp/nullif(2*tp+fp+fn,0))', 'macro_f1')},
    {r('avg(tp/nullif(tp+fn,0))', 'macro_sensitivity')}, {r('avg(tn/nullif(tn+fp,0))', 'macro_specificity')}, {r('avg(tp/nullif(tp+fp,0))', 'macro_ppv')}
    FROM ({PER_LABEL_RATES}) t JOIN label_auc a USING (group_by,"group",label) JOIN label_ap b USING (group_by,"group",label) GROUP BY 1,2) USING (group_by,"group")
  LEFT JOIN ({MICRO}) USING (group_by,"group") LEFT JOIN ({boot_sql(BOOT, True, ('all', *GROUPS))}) c ON s.group_by=c.group_by AND s."group"=c."group" AND NOT too_small""")
def _(spark, sf):
    wide = X.predictions(spark, sf)
    return tidy(E.evaluate(wide.filter("split = 'test'"), E.max_f1_thresholds(val(spark, sf)), GROUPS, n_boot=BOOT)["summary"])


# ---------------------------------------------------------------- scorecard
@reg.add("fn19_logit_sigmoid", f"""SELECT volume_id, label, {r('ln(q)-ln(1-q)', 'logit')}, {r('1/(1+exp(-(1.3::DOUBLE*(ln(q)-ln(1-q))-0.2::DOUBLE)))', 'shifted')}
  FROM (SELECT *, least(greatest(p,1e-6),1-1e-6) AS q FROM preds_long)""")
def _(spark, sf):
    z = N.logit(F.col("p"))
    return tidy(P.to_long(X.predictions(spark, sf)).select("volume_id", "label", z.alias("logit"), N.sigmoid(F.lit(1.3) * z - F.lit(0.2)).alias("shifted")))


BY_KERNEL = {"logit_rows": targets_sql(f"""{LOGIT_ROWS.format(kernel="'*'", source="preds_long")} UNION ALL {LOGIT_ROWS.format(kernel="kernel_class", source="preds_long")}
  WHERE kernel_class IN (SELECT kernel_class FROM val_long GROUP BY 1 HAVING count(DISTINCT volume_id)>=20)""")}


@reg.add("cl1_platt_fit", f"SELECT label, kernel, {r('a', 'slope', 6)}, {r('b', 'intercept', 6)} FROM ({newton_sql('logit_rows', True)})", BY_KERNEL)
def _(spark, sf):
    return tidy(C.fit(spark, val(spark, sf), "platt", by_kernel=True, min_volumes=20), 6)


@reg.add("cl1_temperature_fit", f"SELECT label, kernel, {r('a', 'slope', 6)}, 0.0::DOUBLE AS intercept FROM ({newton_sql('logit_rows', False)})",
         {"logit_rows": targets_sql(LOGIT_ROWS.format(kernel="'*'", source="preds_long"), "p0>=0 AND n1<=0", "z0=0 AND z1=0", "p1<=0 AND n0>=0")})
def _(spark, sf):
    return tidy(C.fit(spark, val(spark, sf), "temperature"), 6)


@reg.add("cl1_platt_optimality", """SELECT label, kernel, CASE WHEN n_pos=0 OR n_pos=n OR z0=z1 OR p1<=n0 THEN 'identity' WHEN p0>=n1 THEN 'smoothed' ELSE 'exact' END AS targets,
  0.0::DOUBLE AS slope_residual, 0.0::DOUBLE AS intercept_residual
  FROM (SELECT label, kernel, count(*) AS n, sum(y) AS n_pos, min(z) AS z0, max(z) AS z1, min(z) FILTER (WHERE y=1) AS p0, max(z) FILTER (WHERE y=1) AS p1,
    min(z) FILTER (WHERE y=0) AS n0, max(z) FILTER (WHERE y=0) AS n1 FROM logit_rows GROUP BY 1,2)""", BY_KERNEL)
def _(spark, sf):
    rows = val(spark, sf)
    return tidy(C.residuals(rows, C.fit(spark, rows, "platt", by_kernel=True, min_volumes=20), "platt", by_kernel=True))


@reg.add("cl1_no_calibration", "SELECT DISTINCT label, '*' AS kernel, 1.0::DOUBLE AS slope, 0.0::DOUBLE AS intercept FROM val_long")
def _(spark, sf):
    return C.identity(val(spark, sf))


FIXED_PARAMS = [("quality", "*", 1.2, -0.1), ("toxic", "*", 0.8, 0.3), ("toxic", "soft", 1.1, 0.05)]


@reg.add("cl2_apply_calibration", f"""SELECT volume_id, label, {r("1/(1+exp(-(a*(ln(q)-ln(1-q))+b)))", 'p_cal')} FROM (
  SELECT *, least(greatest(p,1e-6),1-1e-6) AS q, CASE WHEN label='quality' THEN 1.2::DOUBLE WHEN kernel_class='soft' THEN 1.1 ELSE 0.8 END AS a,
    CASE WHEN label='quality' THEN -0.1::DOUBLE WHEN kernel_class='soft' THEN 0.05 ELSE 0.3 END AS b FROM test_long)""")
def _(spark, sf):
    params = spark.createDataFrame(FIXED_PARAMS, C.PARAM_SCHEMA)
    return tidy(C.apply(test(spark, sf), params).select("volume_id", "label", "p_cal"))


@reg.add("cl3_threshold_at_specificity", "SELECT label, report AS threshold FROM op_points")
def _(spark, sf):
    ranked = R.rank_blocks(R.score_blocks(val(spark, sf), ["label"]), ["label"])
    return ranked.groupBy("label").agg(R.at_specificity_expr(0.95).alias("threshold"))


@reg.add("cl4_threshold_at_sensitivity", "SELECT l.label, sens_p AS threshold FROM op_points l LEFT JOIN val_points v ON l.label=v.label")
def _(spark, sf):
    ranked = R.rank_blocks(R.score_blocks(val(spark, sf), ["label"]), ["label"])
    return ranked.groupBy("label").agg(R.at_sensitivity_expr(0.9).alias("threshold"))


@reg.add("cl5_operating_points", "SELECT label, report, ruleout, max_f1, spec90, spec95 FROM op_points")
def _(spark, sf):
    return points(spark, sf)


@reg.add("cl6_three_states", "SELECT volume_id, label, state, flag_f1 FROM scored")
def _(spark, sf):
    return decided(spark, sf).select("volume_id", "label", "state", "flag_f1")


def rate_sql(flag: str, prefix: str, kinds=("sens", "spec", "ppv", "npv"), digits=9) -> str:
    tp, fp = f"count(*) FILTER (({flag}) AND y=1)::DOUBLE", f"count(*) FILTER (({flag}) AND y=0)::DOUBLE"
    fn, tn = f"count(*) FILTER (NOT ({flag}) AND y=1)::DOUBLE", f"count(*) FILTER (NOT ({flag}) AND y=0)::DOUBLE"
    forms = {"sens": f"{tp}/nullif({tp}+{fn},0)", "spec": f"{tn}/nullif({tn}+{fp},0)", "ppv": f"{tp}/nullif({tp}+{fp},0)", "npv": f"{tn}/nullif({tn}+{fn},0)"}
    return ", ".join(r(forms[k], f"{prefix}_{k}", digits) for k in kinds)


def rates_sql(d) -> str:
    return f"""SELECT group_by,"group",label,count(*) AS n,sum(y)::BIGINT AS n_pos,{r('avg(y)', 'prevalence', d)},
    {r("count(*) FILTER (state='uncertain')/count(*)", 'uncertain_rate', d)}, {rate_sql("state='present'", 'report', digits=d)}, {rate_sql("state<>'absent'", 'ruleout', digits=d)},
    {rate_sql('flag_f1', 'maxf1', digits=d)}, {rate_sql('coalesce(p>=spec90,false)', 'spec90', digits=d)}, {rate_sql('coalesce(p>=spec95,false)', 'spec95', digits=d)}
  FROM scored_grouped WHERE y IS NOT NULL GROUP BY 1,2,3"""


RATES_SQL, RATES_RAW = rates_sql(9), rates_sql(None)


@reg.add("cl7_confusion_rates", RATES_SQL)
def _(spark, sf):
    return tidy(S.grouped_rates(S.decide(blocks(spark, sf), points(spark, sf)), S.decision_rules(["spec90", "spec95"])))


ECE_SQL = """SELECT group_by,"group",label,sum(abs(sy-sp))/sum(n) AS ece FROM (SELECT group_by,"group",label,least(floor(p*10),9) AS bin,count(*) AS n,sum(y) AS sy,sum(p) AS sp
  FROM test_grouped WHERE y IS NOT NULL GROUP BY ALL) GROUP BY 1,2,3"""


RAW_ECE_SQL = ECE_SQL.replace("p*10", "p_raw*10").replace("sum(p)", "sum(p_raw)")
LARGE_SQL = """SELECT group_by,"group" FROM test_grouped GROUP BY ALL HAVING count(DISTINCT volume_id)>=100"""
CI_SQL = f"""SELECT group_by,"group",label,auroc_ci_low,auroc_ci_high FROM ({boot_sql(BOOT, False)}) JOIN ({LARGE_SQL}) USING (group_by,"group")"""


def report(spark, sf, settings=REPORT, wide=None):
    wide = X.predictions(spark, sf) if wide is None else wide
    return E.score(spark, wide.filter("split='val'"), wide.filter("split='test'"), settings)


@reg.add("cl8_calibration_error", f'SELECT group_by,"group",label,{rs("ece")} FROM ({ECE_SQL})')
def _(spark, sf):
    return tidy(S.calibration_error(blocks(spark, sf)))


@reg.add("cl9_brier", f'SELECT group_by,"group",label,{r("avg((p-y)*(p-y))", "brier")} FROM test_grouped WHERE y IS NOT NULL GROUP BY 1,2,3')
def _(spark, sf):
    return tidy(S.brier(blocks(spark, sf)))


def benefit_sql(cuts: str, source: str) -> str:
    return f"""SELECT group_by,"group",label,pt,{r('(count(*) FILTER (p>=pt AND y=1) - pt/(1-pt)*count(*) FILTER (p>=pt AND y=0))/count(*)', 'net_benefit')},
      {r('avg(y)-pt/(1-pt)*(1-avg(y))', 'net_benefit_all')} FROM {source}, (SELECT unnest({cuts}) AS pt) WHERE y IS NOT NULL GROUP BY 1,2,3,4"""


@reg.add("cl10_net_benefit", benefit_sql("[0.05::DOUBLE,0.1::DOUBLE,0.2::DOUBLE]", "test_grouped"))
def _(spark, sf):
    return tidy(S.net_benefit(blocks(spark, sf), (0.05, 0.1, 0.2)))


@reg.add("cl11_per_label_scorecard", f"""SELECT t.*, {r('auroc', 'auroc')}, {r('auprc', 'auprc')}, {rs('report', 'ruleout', 'max_f1', 'spec90', 'spec95')}, {r('e0.ece', 'ece_raw')}, {r('e.ece', 'ece')}, brier, auroc_ci_low, auroc_ci_high,
    b1.net_benefit AS "net_benefit@0.05", b1.net_benefit_all AS "net_benefit_all@0.05", b2.net_benefit AS "net_benefit@0.1", b2.net_benefit_all AS "net_benefit_all@0.1",
    b3.net_benefit AS "net_benefit@0.2", b3.net_benefit_all AS "net_benefit_all@0.2"
  FROM ({RATES_SQL}) t JOIN label_auc a USING (group_by,"group",label) JOIN label_ap b USING (group_by,"group",label) LEFT JOIN op_points o USING (label)
  JOIN ({ECE_SQL}) e USING (group_by,"group",label) JOIN (SELECT group_by,"group",label,{r('avg((p-y)*(p-y))', 'brier')} FROM test_grouped WHERE y IS NOT NULL GROUP BY 1,2,3) br USING (group_by,"group",label)
  JOIN ({benefit_sql('[0.05::DOUBLE]', 'test_grouped')}) b1 USING (group_by,"group",label) JOIN ({benefit_sql('[0.1::DOUBLE]', 'test_grouped')}) b2 USING (group_by,"group",label)
  JOIN ({benefit_sql('[0.2::DOUBLE]', 'test_grouped')}) b3 USING (group_by,"group",label)
  JOIN ({RAW_ECE_SQL}) e0 USING (group_by,"group",label) LEFT JOIN ({CI_SQL}) ci USING (group_by,"group",label)""", PLATT)
def _(spark, sf):
    return tidy(report(spark, sf)["per_label"])


@reg.add("cl12_per_scan", "SELECT * FROM scans")
def _(spark, sf):
    return scans(spark, sf)


SCANS_GROUPED = """(SELECT 'all' AS group_by,'all' AS "group",* FROM scans UNION ALL SELECT 'kernel_class',coalesce(kernel_class,'unknown'),* FROM scans
  UNION ALL SELECT 'manufacturer',coalesce(manufacturer,'unknown'),* FROM scans)"""
SUMMARY_SQL = f"""SELECT group_by,"group",count(*)<100 AS too_small,count(DISTINCT patient_id) AS n_patients,count(*) AS n_volumes,count(*) FILTER (n_true=0) AS n_normal,{r('avg(n_true)', 'true_per_scan')},
  {', '.join(f"{r(f'avg({k}_pred)', f'{k}_pred_per_scan')}, {r(f'avg({k}_tp)', f'{k}_tp_per_scan')}, {r(f'avg({k}_fp)', f'{k}_fp_per_scan')}, {r(f'avg({k}_fn)', f'{k}_fn_per_scan')}, {r(f'count(*) FILTER ({k}_fp>0)/count(*)', f'{k}_scans_with_fp')}, {r(f'count(*) FILTER ({k}_exact)/count(*)', f'{k}_exact_match')}, {r(f'count(*) FILTER (n_true=0 AND {k}_pred>0)/nullif(count(*) FILTER (n_true=0),0)', f'{k}_normal_flag_rate')}" for k in ('report', 'maxf1'))},
  {r('avg(n_uncertain)', 'uncertain_per_scan')}, {r('count(*) FILTER (n_uncertain>0)/count(*)', 'scans_with_uncertain')} FROM {SCANS_GROUPED} GROUP BY 1,2"""


@reg.add("cl13_scan_summary", SUMMARY_SQL)
def _(spark, sf):
    return tidy(S.scan_summary(scans(spark, sf), GROUPS))


CHANGES_SQL = """(SELECT *, ((s_sharp='present')<>(s_soft='present'))::BIGINT AS flip, (f_sharp<>f_soft)::BIGINT AS mflip, (s_sharp<>s_soft)::BIGINT AS change,
  ((s_sharp='present' AND s_soft='absent') OR (s_sharp='absent' AND s_soft='present'))::BIGINT AS hard, p_soft-p_sharp AS dp FROM pair_scored)"""
PAIRED_SQL = f"""SELECT label,count(*) AS n_pairs,{r('avg(flip)', 'flip_rate')},{r('avg(mflip)', 'maxf1_flip_rate')},{r('avg(change)', 'state_change_rate')},{r('avg(hard)', 'hard_contradiction_rate')},
  {r('avg(abs(dp))', 'mean_abs_dp')},{r('avg(dp)', 'mean_dp_soft_minus_sharp')} FROM {CHANGES_SQL} GROUP BY label"""
PAIR_SCANS_SQL = f"SELECT scan,sharp_volume,soft_volume,sum(flip)::BIGINT AS flips,sum(mflip)::BIGINT AS maxf1_flips,sum(change)::BIGINT AS state_changes,sum(hard)::BIGINT AS hard_contradictions FROM {CHANGES_SQL} GROUP BY 1,2,3"


@reg.add("cl14_paired_by_label", PAIRED_SQL)
def _(spark, sf):
    return tidy(S.paired_by_label(changes(spark, sf)))


@reg.add("cl14_paired_by_scan", PAIR_SCANS_SQL)
def _(spark, sf):
    return S.paired_by_scan(changes(spark, sf))


PAIRED_SUMMARY_SQL = f"""SELECT count(*) AS n_pairs,{r('count(*) FILTER (flips>0)/count(*)', 'paired_scans_with_flip')},{r('avg(flips)', 'paired_flips_per_scan')},
  {r('count(*) FILTER (maxf1_flips>0)/count(*)', 'paired_maxf1_scans_with_flip')},{r('avg(maxf1_flips)', 'paired_maxf1_flips_per_scan')},{r('avg(state_changes)', 'paired_state_changes_per_scan')},
  {r('count(*) FILTER (hard_contradictions>0)/count(*)', 'paired_scans_with_hard_contradiction')},{r('avg(hard_contradictions)', 'paired_hard_contradictions_per_scan')} FROM ({PAIR_SCANS_SQL})"""


@reg.add("cl14_paired_summary", PAIRED_SUMMARY_SQL)
def _(spark, sf):
    return tidy(S.paired_summary(S.paired_by_scan(changes(spark, sf))))


GAP_SQL = f"""SELECT label, max(CASE WHEN "group"='soft' THEN report_sens END)-max(CASE WHEN "group"='sharp' THEN report_sens END) AS gap FROM ({RATES_RAW}) WHERE group_by='kernel_class' GROUP BY label"""


@reg.add("cl15_kernel_gap", f"SELECT label, {r('gap', 'kernel_sens_gap')} FROM ({GAP_SQL})")
def _(spark, sf):
    rates = S.grouped_rates(S.decide(blocks(spark, sf, ["kernel_class"]), points(spark, sf)), {"report": S.decision_rules()["report"]})
    return tidy(S.kernel_gap(rates))


GATE_SQL = f"""SELECT *, CASE WHEN NOT coalesce(pass_auroc,true) OR NOT coalesce(pass_sens,true) THEN 'not_supported'
    WHEN NOT coalesce(pass_ece,true) OR NOT coalesce(pass_flip,true) OR NOT coalesce(pass_kernel_gap,true) THEN 'review' ELSE 'supported' END AS status
  FROM (SELECT t.label, auroc_ci_low, {rs('report_sens')}, {r('ece', 'ece')}, {r('flip_rate', 'paired_flip_rate')}, {r('gap', 'kernel_sens_gap')}, auroc_ci_low>=0.8 AS pass_auroc, report_sens>=0.6 AS pass_sens,
    ece<=0.05 AS pass_ece, flip_rate<=0.1 AS pass_flip, abs(gap)<=0.1 AS pass_kernel_gap
  FROM ({RATES_RAW}) t JOIN ({ECE_SQL}) e USING (group_by,"group",label) LEFT JOIN ({PAIRED_SQL}) p ON p.label=t.label LEFT JOIN ({GAP_SQL}) g ON g.label=t.label
    LEFT JOIN ({CI_SQL}) c ON c.group_by='all' AND c.label=t.label WHERE t.group_by='all')"""


@reg.add("cl16_gate", GATE_SQL)
def _(spark, sf):
    return tidy(report(spark, sf, PLAIN)["gate"])


@reg.add("cl18_score_platt_gate", GATE_SQL, PLATT)
def _(spark, sf):
    return tidy(report(spark, sf)["gate"])


def score_summary_sql(raw_ece: str) -> str:
    return f"""SELECT s.*, {', '.join(r(f'm.{c}', c) for c in ('macro_auroc', 'macro_auprc', 'report_macro_sens', 'report_macro_spec', 'report_macro_ppv', 'maxf1_macro_sens', 'maxf1_macro_spec', 'macro_ece_raw', 'macro_ece'))}
  FROM ({SUMMARY_SQL}) s LEFT JOIN (SELECT t.group_by,t."group",avg(auroc) AS macro_auroc,avg(auprc) AS macro_auprc,avg(report_sens) AS report_macro_sens,avg(report_spec) AS report_macro_spec,avg(report_ppv) AS report_macro_ppv,
    avg(maxf1_sens) AS maxf1_macro_sens,avg(maxf1_spec) AS maxf1_macro_spec,avg(e0.ece) AS macro_ece_raw,avg(e.ece) AS macro_ece
    FROM ({RATES_RAW}) t JOIN label_auc a USING (group_by,"group",label) JOIN label_ap b USING (group_by,"group",label) JOIN ({ECE_SQL}) e USING (group_by,"group",label)
      JOIN ({raw_ece}) e0 USING (group_by,"group",label) GROUP BY 1,2) m
  ON s.group_by=m.group_by AND s."group"=m."group" """


def headline_sql() -> str:
    by_kernel = ", ".join(f"""(SELECT {c} FROM summary WHERE group_by='kernel_class' AND "group"='{k}') AS "{c}[{k}]\"""" for k in ("sharp", "soft")
                          for c in ("report_macro_sens", "report_fp_per_scan", "macro_ece_raw", "macro_ece", "macro_auroc"))
    return f"""WITH summary AS ({score_summary_sql(RAW_ECE_SQL)}), gates AS ({GATE_SQL})
      SELECT s.* EXCLUDE (group_by, "group", too_small), {by_kernel}, {", ".join(f"(SELECT count(*) FROM gates WHERE status='{g}') AS labels_{g}" for g in ("supported", "review", "not_supported"))},
        (SELECT {r('avg(abs(gap))')} FROM ({GAP_SQL})) AS kernel_sens_gap_mean_abs, p.* FROM summary s, ({PAIRED_SUMMARY_SQL}) p WHERE s.group_by='all'"""


@reg.add("cl17_headline", headline_sql(), PLATT)
def _(spark, sf):
    return tidy(E.headline(report(spark, sf)))


@reg.add("cl18_score_summary", score_summary_sql(RAW_ECE_SQL), PLATT)
def _(spark, sf):
    return tidy(report(spark, sf)["summary"])


def members(spark, sf):
    """Three finished members, one whose run failed and one with another evaluation."""
    good = X.ensemble(spark, sf).withColumn("eval", F.lit("test"))
    wrong = good.filter("member = 0").withColumn("prob_quality", F.lit(0.5))
    stacked = good.unionByName(wrong.withColumn("member", F.lit(3))).unionByName(wrong.withColumns({"member": F.lit(4), "eval": F.lit("other")}))
    state = stacked.select("member").distinct().withColumn("status", F.when(F.col("member") == 3, "failed").otherwise("finished"))
    return stacked, state


@reg.add("cl19_ensemble_report", score_summary_sql(ECE_SQL), ENSEMBLE)
def _(spark, sf):
    return tidy(E.ensemble_report(spark, *members(spark, sf), "test", PLAIN)["ensemble"]["summary"])


@reg.add("cl19_per_seed_report", score_summary_sql(ECE_SQL), {**ENSEMBLE, "predictions": "SELECT * EXCLUDE (member) FROM members WHERE member=1"})
def _(spark, sf):
    return tidy(E.ensemble_report(spark, *members(spark, sf), "test", PLAIN, per_seed=True)["1"]["summary"])


@reg.add("cl20_calibrated_predictions", """SELECT volume_id, max(CASE WHEN label='quality' THEN p END) AS cal_quality, max(CASE WHEN label='quality' THEN state END) AS state_quality, max(CASE WHEN label='quality' THEN y END) AS true_quality,
  max(CASE WHEN label='toxic' THEN p END) AS cal_toxic, max(CASE WHEN label='toxic' THEN state END) AS state_toxic, max(CASE WHEN label='toxic' THEN y END) AS true_toxic FROM scored GROUP BY 1""")
def _(spark, sf):
    return S.calibrated_wide(decided(spark, sf), ["volume_id"], ["quality", "toxic"])


@reg.add("cl21_reliability_curve", f"""SELECT kernel_class, least(floor(p*10),9)::BIGINT AS bin, count(*) AS n, {r('avg(p)', 'mean_p')}, {r('avg(y)', 'mean_y')} FROM test_long
  WHERE y IS NOT NULL AND kernel_class IN ('sharp','soft') GROUP BY 1,2 HAVING count(*)>20""")
def _(spark, sf):
    return tidy(S.reliability_curve(test(spark, sf)))


@reg.add("cl22_decision_curve", f"""SELECT label, round(pt,9) AS pt, net_benefit, net_benefit_all FROM ({benefit_sql("list_transform(range(40), lambda i: 0.02::DOUBLE+i*((0.5::DOUBLE-0.02::DOUBLE)/39))", "test_grouped")})
  WHERE group_by='all' AND label IN (SELECT label FROM label_auc WHERE group_by='all' ORDER BY auroc DESC NULLS LAST, label LIMIT 6)""")
def _(spark, sf):
    long = test(spark, sf)
    best = E.per_label_metrics(long, []).orderBy(F.col("auroc").desc_nulls_last(), "label").limit(6).select("label")
    grid = [0.02 + i * ((0.5 - 0.02) / 39) for i in range(40)]
    return tidy(S.net_benefit(S.spread(S.label_blocks(long.join(best, "label", "left_semi"), []), []), grid).select("label", "pt", "net_benefit", "net_benefit_all"))


@reg.add("cl23_false_label_distribution", f"SELECT report_fp AS false_labels, count(*) AS n, {r('count(*)/(SELECT count(*) FROM scans)', 'share')} FROM scans GROUP BY 1")
def _(spark, sf):
    return tidy(S.false_label_distribution(scans(spark, sf)))


@reg.add("cl23_false_labels_by_kernel", f"SELECT kernel_class, {', '.join(r(f'avg({c})', c) for c in ('report_fp', 'report_fn', 'n_uncertain', 'maxf1_fp', 'maxf1_fn'))} FROM scans GROUP BY 1")
def _(spark, sf):
    return tidy(scans(spark, sf).groupBy("kernel_class").agg(*[F.avg(c).alias(c) for c in ("report_fp", "report_fn", "n_uncertain", "maxf1_fp", "maxf1_fn")]))


@reg.add("cl24_newest_reports", """SELECT run_id, eval, reported, value FROM (SELECT 'run_'||user_id AS run_id, event_type AS eval, ts AS reported, value,
  row_number() OVER (PARTITION BY user_id,event_type ORDER BY ts DESC, value DESC) AS rn FROM events) WHERE rn=1""")
def _(spark, sf):
    ev = X.table(spark, sf, "events").select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
                                             F.col("event_type").alias("eval"), F.col("ts").alias("reported"), "value")
    return S.newest_reports(ev).select("run_id", "eval", "reported", "value")


@reg.add("cl25_parameter_table", f"SELECT label, {r('a', 'slope', 6)}, {r('b', 'intercept', 6)}, '[]' AS per_kernel, {', '.join(r(c, c, 6) for c in ('report', 'ruleout', 'max_f1', 'spec90', 'spec95'))} FROM op_points JOIN platt USING (label)", PLATT)
def _(spark, sf):
    params, pts = E.operating_points(spark, val(spark, sf), REPORT)
    return tidy(C.parameter_table(params, pts, ["report", "ruleout", "max_f1", "spec90", "spec95"]), 6)


@reg.add("j11_kernel_pairs", "SELECT * FROM pair_rows")
def _(spark, sf):
    return P.kernel_pairs(X.predictions(spark, sf).filter("split='test'"))


@reg.add("j12_scan_items", """WITH g AS (SELECT *, patient_id||'/'||scan_id AS scan, max(CASE WHEN kernel_class='sharp' THEN volume_id END) OVER (PARTITION BY patient_id,scan_id) AS a,
    max(CASE WHEN kernel_class='soft' THEN volume_id END) OVER (PARTITION BY patient_id,scan_id) AS b FROM (SELECT volume_id,patient_id,scan_id,CASE WHEN volume_id::INT % 9 = 0 THEN 'other' ELSE kernel_class END AS kernel_class FROM predictions))
  SELECT DISTINCT scan AS item, 2::BIGINT AS n_views, a AS first_view, b AS second_view FROM g WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT scan||'#'||volume_id, 1, volume_id, NULL FROM g WHERE a IS NULL OR b IS NULL OR volume_id NOT IN (a,b)""")
def _(spark, sf):
    v = X.predictions(spark, sf).withColumn("kernel_class", F.when(F.col("volume_id").cast("int") % 9 == 0, "other").otherwise(F.col("kernel_class")))
    return P.scan_items(v)


@reg.add("j13_ensemble_mean", f"SELECT volume_id, any_value(kernel_class) AS kernel_class, {r('avg(prob_quality)', 'prob_quality')}, {r('avg(prob_toxic)', 'prob_toxic')}, max(true_quality) AS true_quality, max(true_toxic) AS true_toxic FROM ensemble GROUP BY 1")
def _(spark, sf):
    return tidy(P.average_members(X.ensemble(spark, sf), ["quality", "toxic"], ["kernel_class"]))


@reg.add("j13_misaligned_members", """WITH e AS (SELECT * FROM ensemble WHERE NOT (member=1 AND volume_id::INT % 50=0)) SELECT volume_id, count(*) AS rows, count(DISTINCT member) AS members FROM e GROUP BY 1
  HAVING count(DISTINCT member)<>(SELECT count(DISTINCT member) FROM e) OR count(*)<>(SELECT count(DISTINCT member) FROM e)""")
def _(spark, sf):
    return P.misaligned_members(X.ensemble(spark, sf).filter("NOT (member = 1 AND cast(volume_id as int) % 50 = 0)"))


@reg.add("j14_attach_columns", "SELECT p.volume_id, p.patient_id, f.manufacturer, f.n_slices FROM predictions p LEFT JOIN findings f ON p.volume_id=f.volume_id")
def _(spark, sf):
    preds = X.predictions(spark, sf).select("volume_id", "patient_id")
    return P.attach_columns(preds, X.findings(spark, sf), ["patient_id", "manufacturer", "n_slices"])


@reg.add("j16_status_join", f"""SELECT a.label, a."group", {r('a.auroc', 'auroc')}, CASE WHEN b.auroc >= 0.7 THEN 'supported' WHEN b.auroc IS NOT NULL THEN 'review' END AS status
  FROM label_auc a LEFT JOIN (SELECT label, auroc FROM label_auc WHERE group_by='all') b ON a.label=b.label""")
def _(spark, sf):
    from scanledger.operators.experiments import attach_status
    table = E.per_label_metrics(test(spark, sf), GROUPS)
    status = table.filter("group_by='all'").select("label", F.when(F.col("auroc") >= 0.7, "supported").when(F.col("auroc").isNotNull(), "review").alias("status"))
    return tidy(attach_status(table.select("label", "group", "auroc"), status))


@reg.add("ag14_group_sizes", """SELECT group_by,"group",count(DISTINCT volume_id) AS n_volumes,count(DISTINCT patient_id) AS n_patients,count(DISTINCT volume_id)<100 AS too_small FROM test_grouped GROUP BY ALL""")
def _(spark, sf):
    return P.group_sizes(X.predictions(spark, sf).filter("split='test'"), GROUPS, 100)


@reg.add("wn2_average_rank", "SELECT DISTINCT label, p, r AS rank FROM auc_rows WHERE group_by='all'")
def _(spark, sf):
    blocks = R.score_blocks(test(spark, sf), ["label"])
    return R.average_ranks(blocks, ["label"]).select("label", "p", "rank")


@reg.add("ag10_prior_log_odds", f"SELECT label, {r('ln(q/(1-q))', 'log_odds')} FROM (SELECT label, least(greatest(avg(y),1e-4),1-1e-4) AS q FROM preds_long WHERE y IS NOT NULL GROUP BY 1)")
def _(spark, sf):
    return tidy(P.to_long(X.predictions(spark, sf)).groupBy("label").agg(N.prior_log_odds(F.avg("y")).alias("log_odds")))


@reg.add("em19_symmetric_kl", f"""SELECT scan, {r('avg((a-b)*(ln(a)-ln(b))+(b-a)*(ln(1-a)-ln(1-b)))', 'symmetric_kl')} FROM (SELECT scan, least(greatest(p_sharp,1e-12),1-1e-12) AS a, least(greatest(p_soft,1e-12),1-1e-12) AS b FROM pair_scored) GROUP BY 1""")
def _(spark, sf):
    pairs = P.kernel_pairs(X.predictions(spark, sf).filter("split='test'"))
    long = test(spark, sf).select("volume_id", "label", "p")
    sides = pairs.select("scan", F.explode(F.array(F.struct(F.col("sharp_volume").alias("volume_id"), F.lit(True).alias("sharp")),
                                                   F.struct(F.col("soft_volume").alias("volume_id"), F.lit(False).alias("sharp")))).alias("v")).select("scan", "v.*")
    both = long.join(sides, "volume_id").groupBy("scan", "label").agg(F.max(F.when(F.col("sharp"), F.col("p"))).alias("a"),
                                                                      F.max(F.when(~F.col("sharp"), F.col("p"))).alias("b"))
    return tidy(both.groupBy("scan").agg(F.avg(N.symmetric_kl(F.col("a"), F.col("b"))).alias("symmetric_kl")))
