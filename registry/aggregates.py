"""Registered queries: class balance and prevalence (section 2.5, data side)."""
from __future__ import annotations

from pyspark.sql import functions as F

from scanledger.operators import balance as B, kernels as K, manifest as M

from . import Registry, fixtures as X
from .common import r, rs, tidy

reg = Registry()
IDS = ["volume_id", "patient_id", "scan_id", "manufacturer", "kernel_class", "split"]


def long(spark, sf):
    return M.labels_long(X.findings(spark, sf), IDS)


@reg.add("ag1_class_histogram", "SELECT kernel_class, count(*) AS n FROM catalog GROUP BY 1")
def _(spark, sf):
    return B.class_histogram(X.the_catalog(spark, sf), "kernel_class")


@reg.add("ag2_crosstab_margins", """SELECT coalesce(manufacturer,'All') AS manufacturer, count(*) FILTER (kernel_class='sharp') AS sharp, count(*) FILTER (kernel_class='soft') AS soft,
  count(*) FILTER (kernel_class='other') AS other, count(*) AS "All" FROM catalog GROUP BY ROLLUP (manufacturer)""")
def _(spark, sf):
    return B.crosstab(X.the_catalog(spark, sf), "manufacturer", "kernel_class", K.KERNEL_CLASSES)


@reg.add("ag3_percent_of_group", f"SELECT split, kernel_class, count(*) AS n, {r('100.0::DOUBLE*count(*)/sum(count(*)) OVER (PARTITION BY split)', 'percent')} FROM findings GROUP BY 1,2")
def _(spark, sf):
    return tidy(B.percent_of_group(X.findings(spark, sf), "split", "kernel_class"))


@reg.add("ag4_prevalence_by_group", f"SELECT manufacturer, label, count(*) AS rows, count(y) AS n, sum(y) AS n_pos, {r('avg(y)', 'prevalence')} FROM findings_long GROUP BY 1,2 HAVING count(*)>=40")
def _(spark, sf):
    return tidy(B.prevalence(long(spark, sf), ["manufacturer"], 40))


SPREAD = """SELECT label, sum(p)/sum(n) AS overall, min(CASE WHEN c>=40 THEN m END) AS lowest, max(CASE WHEN c>=40 THEN m END) AS highest, max(CASE WHEN c>=40 THEN m END)-min(CASE WHEN c>=40 THEN m END) AS spread
  FROM (SELECT manufacturer, label, count(*) AS c, count(y) AS n, sum(y) AS p, avg(y) AS m FROM findings_long GROUP BY 1,2) GROUP BY 1"""


@reg.add("ag5_prevalence_spread", f"SELECT label, {rs('overall', 'lowest', 'highest', 'spread')} FROM ({SPREAD})")
def _(spark, sf):
    return tidy(B.prevalence_spread(long(spark, sf), "manufacturer", 40))


CHI = """WITH c AS (SELECT label, manufacturer, count(*)::DOUBLE AS n, sum(y) AS pos FROM findings_long WHERE y IS NOT NULL GROUP BY 1,2 HAVING count(*)>=5),
  t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS tn, sum(pos) OVER (PARTITION BY label) AS tp, count(*) OVER (PARTITION BY label) AS k FROM c)"""


@reg.add("ag6_scanner_chi_square", f"{CHI} SELECT label, {r('sum(power(pos-n*tp/tn,2)/nullif(n*tp/tn,0)+power((n-pos)-n*(tn-tp)/tn,2)/nullif(n*(tn-tp)/tn,0))', 'chi2')}, (max(k)-1)::BIGINT AS dof FROM t GROUP BY 1")
def _(spark, sf):
    return tidy(B.scanner_dependence(long(spark, sf), "manufacturer", 5))


# the tail probability by Simpson's rule over the density of the root, u^(dof - 1) e^(-u^2)
TAIL = f"""{CHI}, s AS (SELECT label, sum(power(pos-n*tp/tn,2)/nullif(n*tp/tn,0)+power((n-pos)-n*(tn-tp)/tn,2)/nullif(n*(tn-tp)/tn,0)) AS chi2, (max(k)-1)::BIGINT AS dof FROM t GROUP BY 1),
  q AS (SELECT label, 1-2/gamma(any_value(dof)/2.0::DOUBLE)*sum((CASE WHEN i IN (0,4000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*power(sqrt(chi2/2)*i/4000,dof-1)*exp(-power(sqrt(chi2/2)*i/4000,2)))
    *sqrt(any_value(chi2)/2)/12000 AS p_value FROM s, range(4001) x(i) WHERE dof>0 GROUP BY 1)"""


@reg.add("ag6_scanner_p_value", f"""{TAIL} SELECT label, {r('chi2', 'chi2')}, dof, {r('p_value', 'p_value')}, {r('spread', 'spread')}, CASE WHEN p_value<0.001 AND spread>=0.05 THEN 'depends on scanner' ELSE '' END AS flag
  FROM s LEFT JOIN q USING (label) JOIN ({SPREAD.replace('40', '5')}) USING (label)""")
def _(spark, sf):
    data = long(spark, sf)
    return tidy(B.flag_dependence(B.with_p_value(B.scanner_dependence(data, "manufacturer", 5)), B.prevalence_spread(data, "manufacturer", 5)))


@reg.add("ag7_skipped_by_scanner", f"""SELECT manufacturer, count(*) FILTER (NOT has) AS skipped, count(*) AS of_scans, {r('100.0::DOUBLE*count(*) FILTER (NOT has)/count(*)', 'percent')} FROM
  (SELECT patient_id, scan_id, bool_or(kernel_class='sharp') AS has, arg_min(manufacturer, volume_id) AS manufacturer FROM catalog WHERE source_split='train' GROUP BY 1,2) GROUP BY 1 HAVING count(*) FILTER (NOT has)>0""")
def _(spark, sf):
    train = X.the_catalog(spark, sf).filter("source_split = 'train'")
    return tidy(B.skipped_by_scanner(B.scans_with_kernel(train, "sharp")))


@reg.add("ag7_skip_label_difference", f"""WITH s AS (SELECT patient_id, scan_id, bool_or(kernel_class='en') AS has, min(volume_id) AS volume_id FROM findings GROUP BY 1,2)
  SELECT label, {r('100*avg(CASE WHEN NOT has THEN y END)', 'skipped')}, {r('100*avg(CASE WHEN has THEN y END)', 'kept')}, {r('100*avg(CASE WHEN NOT has THEN y END)-100*avg(CASE WHEN has THEN y END)', 'difference')}
  FROM findings_long l JOIN s ON l.volume_id=s.volume_id GROUP BY 1""")
def _(spark, sf):
    f = X.findings(spark, sf)
    return tidy(B.skip_label_difference(f, long(spark, sf), B.scans_with_kernel(f, "en")))


@reg.add("ag8_split_overview", f"SELECT split, count(*) AS volumes, count(DISTINCT scan_id) AS scans, count(DISTINCT patient_id) AS patients, {r('100.0::DOUBLE*count(*)/(SELECT count(*) FROM findings)', 'percent')} FROM findings GROUP BY 1")
def _(spark, sf):
    return tidy(B.split_overview(X.findings(spark, sf)))


GAP = """SELECT label, 100*avg(CASE WHEN split='train' THEN y END) AS train, 100*avg(CASE WHEN split='val' THEN y END) AS val, 100*avg(CASE WHEN split='test' THEN y END) AS test, 100*avg(y) AS "all",
  (count(CASE WHEN split='train' THEN y END)-sum(CASE WHEN split='train' THEN y END))/nullif(sum(CASE WHEN split='train' THEN y END),0) AS pos_weight FROM findings_long GROUP BY 1"""


@reg.add("ag9_prevalence_gap", f"SELECT label, {rs('train', 'val', 'test', 'all', 'pos_weight')}, {r('val-train', 'val_minus_train')}, {r('test-train', 'test_minus_train')} FROM ({GAP})")
def _(spark, sf):
    return tidy(B.prevalence_gap(long(spark, sf)))


@reg.add("ag9_labels_without_positives", """SELECT label||'_'||manufacturer AS label, sum(coalesce(y,0)) AS n_pos FROM findings_long WHERE split='train' GROUP BY 1 HAVING sum(coalesce(y,0))=0""")
def _(spark, sf):
    split_up = long(spark, sf).withColumn("label", F.concat_ws("_", "label", "manufacturer"))
    return B.labels_without_positives(split_up)


PER_VOLUME = "(SELECT split, volume_id, coalesce(sum(y),0) AS n FROM findings_long GROUP BY 1,2)"


@reg.add("ag11_findings_per_volume", f"SELECT split, CASE WHEN n>=1 THEN '1+' ELSE n::BIGINT::VARCHAR END AS findings, count(*) AS volumes, {r('100.0::DOUBLE*count(*)/sum(count(*)) OVER (PARTITION BY split)', 'percent')} FROM {PER_VOLUME} GROUP BY 1,2")
def _(spark, sf):
    return tidy(B.findings_per_volume(long(spark, sf), 1))


@reg.add("ag11_findings_stats", f"SELECT split, {r('avg(n)', 'mean')}, max(n) AS max, median(n) AS median FROM {PER_VOLUME} GROUP BY 1")
def _(spark, sf):
    return tidy(B.findings_stats(long(spark, sf)))
