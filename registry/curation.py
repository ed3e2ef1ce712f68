"""Registered queries: ids, sources, worklists, labels, splits, merging (sections 2.1 to 2.4)."""
from __future__ import annotations

from pyspark.sql import functions as F

from scanledger.functions import hashing as H, ids as I
from scanledger.operators import kernels as K, manifest as M, splits as S, worklist as L
from scanledger.operators.ordering import first_per
from scanledger.sources import readers as SR, writers as SW
from scanledger.staging import staged

from . import Registry, fixtures as X
from .common import r, tidy
from .fixtures_sql import h

reg = Registry()
VID = r"'^(train|valid)_(\d+)_([a-z]+)_(\d+)$'"
V_CLEAN = """(SELECT *, regexp_replace("VolumeName",'\\.nii(\\.gz)?$','') AS volume_id FROM volumes)"""
CATALOG_COLUMNS = "volume_id, patient_id, scan_id, reconstruction_id, source_split, manufacturer, kernel, kernel_class"


def cat(spark, sf):
    return X.the_catalog(spark, sf)


# ---------------------------------------------------------------- functions
@reg.add("fn1_strip_nifti_ext", """SELECT "VolumeName" AS name, regexp_replace("VolumeName",'\\.nii(\\.gz)?$','') AS volume_id FROM volumes""")
def _(spark, sf):
    return X.volumes(spark, sf).select(F.col("VolumeName").alias("name"), I.strip_nifti_ext(F.col("VolumeName")).alias("volume_id"))


@reg.add("fn2_parse_volume_id", f"""SELECT volume_id, regexp_extract(volume_id,{VID},1)||'_'||regexp_extract(volume_id,{VID},2) AS patient_id, regexp_extract(volume_id,{VID},3) AS scan_id,
  regexp_extract(volume_id,{VID},4)::BIGINT AS reconstruction_id, regexp_extract(volume_id,{VID},1) AS source_split FROM {V_CLEAN} WHERE regexp_matches(volume_id,{VID})""")
def _(spark, sf):
    v = X.volumes(spark, sf).select(I.strip_nifti_ext(F.col("VolumeName")).alias("volume_id"))
    return v.filter(I.is_volume_id(F.col("volume_id"))).select("volume_id", *[c.alias(n) for n, c in I.volume_id_parts(F.col("volume_id")).items()])


@reg.add("fn3_normalize_kernel", """SELECT "ConvolutionKernel" AS raw, regexp_extract("ConvolutionKernel",'([A-Za-z0-9_.+-]+)',1) AS kernel, count(*) AS n FROM volumes GROUP BY 1,2""")
def _(spark, sf):
    return X.volumes(spark, sf).groupBy(F.col("ConvolutionKernel").alias("raw"), I.normalize_kernel(F.col("ConvolutionKernel")).alias("kernel")).agg(
        F.count(F.lit(1)).alias("n"))


@reg.add("fn4_kernel_key", """SELECT lower(trim("Manufacturer")) AS m, lower(regexp_extract("ConvolutionKernel",'([A-Za-z0-9_.+-]+)',1)) AS k, count(*) AS n FROM volumes GROUP BY 1,2""")
def _(spark, sf):
    m, k = I.kernel_key(F.col("Manufacturer"), F.col("ConvolutionKernel"))
    return X.volumes(spark, sf).groupBy(m.alias("m"), k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


DRAFT = """SELECT p_partkey, maker, kernel, descr, CASE WHEN contains(upper(descr),'HRCT') OR contains(upper(descr),'PARANKIM') OR contains(upper(descr),'LUNG') THEN 'sharp'
  WHEN contains(upper(descr),'MEDIASTEN') THEN 'soft' WHEN lower(maker)='siemens' AND (starts_with(kernel,'Bl') OR starts_with(kernel,'Hr')) THEN 'sharp'
  WHEN lower(maker)='siemens' AND regexp_extract(kernel,'^(?:Br|Bv|Qr|Hc)(\\d+)',1)<>'' THEN CASE WHEN regexp_extract(kernel,'^(?:Br|Bv|Qr|Hc)(\\d+)',1)::INT>=56 THEN 'sharp' ELSE 'soft' END
  WHEN lower(maker)='siemens' AND regexp_extract(kernel,'^B(\\d+)s',1)<>'' THEN CASE WHEN regexp_extract(kernel,'^B(\\d+)s',1)::INT>=60 THEN 'sharp' ELSE 'soft' END
  WHEN upper(kernel) IN ('YA','L','YB','EA','LUNGB','E') THEN 'sharp' WHEN upper(kernel) IN ('B','A','SA') THEN 'soft' ELSE 'other' END AS draft
  FROM (SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN 'Siemens' ELSE 'Philips' END AS maker,
    (['Br','Bl','B','Hc','YA','b'])[1+(p_partkey%6)::INT] || CASE WHEN p_partkey%6 IN (0,3) THEN (30+p_size)::VARCHAR||'f' WHEN p_partkey%6=2 THEN (30+p_size)::VARCHAR||'s' ELSE '' END AS kernel,
    CASE WHEN p_partkey%11=0 THEN 'thin lung '||p_name WHEN p_partkey%13=0 THEN 'mediasten '||p_name ELSE p_name END AS descr FROM part)"""


@reg.add("fn5_draft_class", DRAFT)
def _(spark, sf):
    k, size = F.col("p_partkey") % 6, (F.col("p_size") + 30).cast("string")
    base = F.element_at(F.array(*[F.lit(x) for x in ("Br", "Bl", "B", "Hc", "YA", "b")]), (k + 1).cast("int"))
    parts = X.table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "Siemens").otherwise("Philips").alias("maker"),
        F.concat(base, F.when(k.isin(0, 3), F.concat(size, F.lit("f"))).when(k == 2, F.concat(size, F.lit("s"))).otherwise("")).alias("kernel"),
        F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("thin lung "), F.col("p_name"))).when(
            F.col("p_partkey") % 13 == 0, F.concat(F.lit("mediasten "), F.col("p_name"))).otherwise(F.col("p_name")).alias("descr"))
    return parts.withColumn("draft", I.draft_kernel_class(F.col("maker"), F.col("kernel"), F.col("descr")))


@reg.add("fn6_label_column", "SELECT DISTINCT p_name||' #'||p_type AS name, 'label_'||trim(regexp_replace(lower(trim(p_name||' #'||p_type)),'[^a-z0-9]+','_','g'),'_') AS label FROM part")
def _(spark, sf):
    name = F.concat(F.col("p_name"), F.lit(" #"), F.col("p_type"))
    return X.table(spark, sf, "part").select(name.alias("name"), I.label_column(name).alias("label")).distinct()


@reg.add("fn7_parse_number", """SELECT event_id, try_cast(regexp_extract(props,'([-+]?\\d*\\.?\\d+)',1) AS DOUBLE) AS k, try_cast(regexp_extract('['||value||', 2]','([-+]?\\d*\\.?\\d+)',1) AS DOUBLE) AS v,
  try_cast(regexp_extract(event_type,'([-+]?\\d*\\.?\\d+)',1) AS DOUBLE) AS none FROM events""")
def _(spark, sf):
    return X.table(spark, sf, "events").select("event_id", I.parse_number(F.col("props")).alias("k"), I.parse_number(
        F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", 2]"))).alias("v"), I.parse_number(F.col("event_type")).alias("none"))


@reg.add("fn8_volume_repo_path", f"""SELECT volume_id, pool, CASE WHEN regexp_matches(volume_id,{VID}) AND regexp_extract(volume_id,{VID},1)=pool THEN 'dataset/'||pool||'_fixed/'||pool||'_'||regexp_extract(volume_id,{VID},2)
  ||'/'||pool||'_'||regexp_extract(volume_id,{VID},2)||'_'||regexp_extract(volume_id,{VID},3)||'/'||volume_id||'.nii.gz' END AS path FROM {V_CLEAN}""")
def _(spark, sf):
    return X.volumes(spark, sf).select(I.strip_nifti_ext(F.col("VolumeName")).alias("volume_id"), "pool").select(
        "volume_id", "pool", I.volume_repo_path(F.col("volume_id"), F.col("pool")).alias("path"))


SAFE = "regexp_replace({},'[^A-Za-z0-9._-]','-','g')"
SCAN_ID = f"""coalesce(nullif(array_to_string(list_transform(list_filter(string_split(regexp_replace(path,'\\.nii(\\.gz)?$','','i'),'/'),lambda p: p<>'' AND p<>'.'),lambda p: {SAFE.format('p')}),'_'),''),'root')"""


@reg.add("fn9_make_scan_id", f"SELECT path, series_uid, {SCAN_ID}||'_s'||right({SAFE.format('series_uid')},8) AS scan_id, {SCAN_ID} AS plain_id FROM files")
def _(spark, sf):
    return X.files(spark, sf).select("path", "series_uid", I.scan_id(F.col("path"), F.col("series_uid")).alias("scan_id"), I.scan_id(F.col("path")).alias("plain_id"))


@reg.add("fn10_patient_key", f"""SELECT path, {SAFE.format("string_split(path,'/')[1]")} AS one, array_to_string(list_transform(string_split(path,'/')[1:least(2,len(string_split(path,'/'))-1)],lambda p: {SAFE.format('p')}),'_') AS two,
  {SCAN_ID.replace('path,', "replace(path,'/','-'),")} AS own FROM files""")
def _(spark, sf):
    return X.files(spark, sf).select("path", I.patient_key(F.col("path"), 1).alias("one"), I.patient_key(F.col("path"), 2).alias("two"),
                                     I.patient_key(F.replace(F.col("path"), F.lit("/"), F.lit("-"))).alias("own"))


@reg.add("fn11_id_hash", "SELECT volume_id, any_value(CASE WHEN patient_tag='' THEN '' ELSE substr(sha256(patient_tag),1,12) END) AS patient_hash FROM (SELECT series_uid AS volume_id, patient_tag FROM headers) GROUP BY 1")
def _(spark, sf):
    return X.headers(spark, sf).groupBy(F.col("series_uid").alias("volume_id")).agg(F.max(H.id_hash(F.col("patient_tag"))).alias("patient_hash"))


@reg.add("fn12_clean_key", """SELECT page_id, regexp_replace(trim(raw),'[/\\\\]+$','') AS key FROM (SELECT page_id, ' '||url||(CASE WHEN page_id%3=0 THEN '//' WHEN page_id%3=1 THEN '\\' ELSE '' END) AS raw FROM pages)""")
def _(spark, sf):
    k = F.col("page_id") % 3
    raw = F.concat(F.lit(" "), F.col("url"), F.when(k == 0, "//").when(k == 1, "\\").otherwise(""))
    return X.table(spark, sf, "pages").select("page_id", I.clean_key(raw).alias("key"))


@reg.add("fn13_text_is_true", """SELECT event_id, lower(trim(t)) IN ('true','1','yes') AS flag FROM (SELECT event_id, ([' TRUE','1','yes ','no','t','0'])[1+(event_id%6)::INT] AS t FROM events)""")
def _(spark, sf):
    words = F.array(*[F.lit(x) for x in (" TRUE", "1", "yes ", "no", "t", "0")])
    return X.table(spark, sf, "events").select("event_id", I.text_is_true(F.element_at(words, (F.col("event_id") % 6 + 1).cast("int"))).alias("flag"))


@reg.add("fn14_numeric_coercion", "SELECT event_id, CASE WHEN event_id%4=0 THEN NULL WHEN event_id%4=1 THEN NULL ELSE value END AS number FROM events")
def _(spark, sf):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("event_type")).when(k == 1, "nan").otherwise(F.col("value").cast("string"))
    return X.table(spark, sf, "events").select("event_id", I.known_number(text).alias("number"))


SETTINGS = """'{"kind": "'||event_type||'", "value": "'||(event_id%50)||'"}'"""


@reg.add("fn15_settings_fingerprint", f"SELECT event_id, substr(sha256({SETTINGS}),1,16) AS fingerprint, substr(sha256({SETTINGS}),1,12) AS short FROM events")
def _(spark, sf):
    settings = F.create_map(F.lit("value"), (F.col("event_id") % 50).cast("string"), F.lit("device"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return X.table(spark, sf, "events").select("event_id", H.settings_fingerprint(settings, ignore=("device",)).alias("fingerprint"),
                                               H.settings_fingerprint(settings, ignore=("device",), length=12).alias("short"))


@reg.add("fn16_run_id", f"SELECT event_id, event_type||'/'||substr(sha256({SETTINGS}),1,8)||'/seed'||(event_id%3) AS run_id FROM events")
def _(spark, sf):
    settings = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("value"), (F.col("event_id") % 50).cast("string"))
    return X.table(spark, sf, "events").select("event_id", H.run_id(F.col("event_type"), H.settings_fingerprint(settings), F.col("event_id") % 3).alias("run_id"))


@reg.add("fn17_combined_hash", "SELECT o_custkey AS run, sha256(string_agg('run'||o_orderkey||':'||sha256(o_orderpriority), chr(10) ORDER BY o_orderkey)) AS combined FROM orders GROUP BY 1")
def _(spark, sf):
    from scanledger.operators.experiments import combined_hash
    parts = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("position"), F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("name"),
                                                F.sha2("o_orderpriority", 256).alias("hash"))
    return combined_hash(parts, "run")


# ---------------------------------------------------------------- predicates
@reg.add("pr1_pool_counts", f"""SELECT pool, count(*) AS rows, count(*) FILTER (NOT regexp_matches(volume_id,{VID})) AS unparsable, count(*) FILTER (regexp_matches(volume_id,{VID}) AND split_part(volume_id,'_',1)<>pool) AS wrong_pool
  FROM {V_CLEAN} GROUP BY 1""")
def _(spark, sf):
    return K.catalog_counts(X.volumes(spark, sf))


MEM = "(512.0::DOUBLE*512*\"NumberofSlices\" + (512*(0.9::DOUBLE/0.75))*(512*(0.9::DOUBLE/0.75))*(\"NumberofSlices\"*(\"ZSpacing\"/1.5::DOUBLE)))*4/1e9"
SCREEN = f"(SELECT regexp_replace(\"VolumeName\",'\\.nii(\\.gz)?$','') AS volume_id FROM volumes WHERE pool='train' GROUP BY 1 HAVING min({MEM})>0.06)"


@reg.add("pr2_memory_screen", f'SELECT "VolumeName" AS name, "NumberofSlices" AS n, {r(MEM, "gb")}, {MEM}<=0.06 AS passes FROM volumes')
def _(spark, sf):
    return tidy(X.volumes(spark, sf).select(F.col("VolumeName").alias("name"), F.col("NumberofSlices").alias("n"), L.memory_gb().alias("gb"),
                                            L.passes_memory_screen(0.06).alias("passes")))


@reg.add("pr3_select_volumes", f"""SELECT volume_id, patient_id, split, kernel_class, n_slices, label_quality, label_toxic FROM findings WHERE split IN ('train','val') AND kernel_class IN ('en','fr')
  AND {h("'qc:'||volume_id")}<0.9""")
def _(spark, sf):
    rows = X.findings(spark, sf).withColumn("qc_passed", F.when(H.hash01(F.concat(F.lit("qc:"), F.col("volume_id"))) < 0.9, " True").otherwise("no"))
    return M.select_volumes(rows, ("train", "val"), kernel_classes=("en", "fr"))


@reg.add("pr4_label_subset", "SELECT volume_id, 'toxic' AS label, label_toxic AS y FROM findings")
def _(spark, sf):
    return M.labels_long(X.findings(spark, sf), ["volume_id"], ["toxic"])


# ---------------------------------------------------------------- joins and kernels
@reg.add("j1_kernel_classification", "SELECT volume_id, manufacturer, kernel, kernel_class FROM catalog")
def _(spark, sf):
    return cat(spark, sf).select("volume_id", "manufacturer", "kernel", "kernel_class")


META_ONE = """(SELECT "VolumeName", min("Manufacturer") AS manufacturer, max("NumberofSlices") AS n_slices, min("ZSpacing") AS "ZSpacing" FROM volumes GROUP BY 1)"""


@reg.add("j2_metadata_enrichment", f"""SELECT c.volume_id, c.manufacturer, m.manufacturer AS manufacturer_meta, m.n_slices, m."ZSpacing" FROM catalog c LEFT JOIN {META_ONE} m ON regexp_replace(m."VolumeName",'\\.nii(\\.gz)?$','')=c.volume_id""")
def _(spark, sf):
    meta = X.volumes(spark, sf).groupBy("VolumeName").agg(F.min("Manufacturer").alias("manufacturer"), F.max("NumberofSlices").alias("n_slices"), F.min("ZSpacing").alias("ZSpacing"))
    return M.enrich(cat(spark, sf).select("volume_id", "manufacturer"), meta)


@reg.add("j3_stats_attach", "SELECT f.volume_id, f.split, q.passed FROM findings f LEFT JOIN (SELECT volume_id::INT AS v, true AS passed FROM findings WHERE volume_id::INT%3=0) q ON f.volume_id::INT=q.v")
def _(spark, sf):
    rows = X.findings(spark, sf).select("volume_id", "split")
    stats = rows.filter(F.col("volume_id").cast("int") % 3 == 0).select("volume_id", F.lit(True).alias("passed"))
    return M.attach_stats(rows, stats)


LABEL_ROWS = """(SELECT o_custkey::VARCHAR AS k, o_totalprice AS a, o_orderkey AS b FROM orders UNION ALL SELECT 'none_'||s_suppkey||'/', s_acctbal, s_suppkey FROM supplier)"""


def _label_rows(spark, sf):
    o = X.table(spark, sf, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("/")).alias("patient"), F.col("o_totalprice").alias("Total price"), F.col("o_orderkey").alias("Order-key"))
    s = X.table(spark, sf, "supplier").select(F.concat(F.lit("none_"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("patient"), F.col("s_acctbal").alias("Total price"), F.col("s_suppkey").alias("Order-key"))
    return o.unionByName(s)


def _people(spark, sf):
    return X.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("patient"), F.col("c_nationkey").alias("nation"), F.lit(0.0).alias("label_total_price"))


@reg.add("j4_attach_labels", f"SELECT c_custkey::VARCHAR AS patient, c_nationkey AS nation, l.r.a AS label_total_price, l.r.b AS label_order_key FROM customer LEFT JOIN (SELECT k, min({{'a': a, 'b': b}}) AS r FROM {LABEL_ROWS} GROUP BY 1) l ON l.k=c_custkey::VARCHAR")
def _(spark, sf):
    return M.attach_labels(_people(spark, sf), _label_rows(spark, sf), "patient", "patient")


@reg.add("j4_first_label_wins", f"SELECT c_custkey::VARCHAR AS patient, c_nationkey AS nation, l.a AS label_total_price FROM customer LEFT JOIN (SELECT k, arg_max(a, b) AS a FROM {LABEL_ROWS} GROUP BY 1) l ON l.k=c_custkey::VARCHAR")
def _(spark, sf):
    rows = _label_rows(spark, sf).withColumn("Order-key", -F.col("Order-key"))  # the last order comes first
    return M.attach_labels(_people(spark, sf), rows, "patient", "patient", order="Order-key")


@reg.add("j4_label_report", f"""SELECT (SELECT count(*) FROM customer) AS rows, (SELECT count(*) FROM customer WHERE c_custkey::VARCHAR IN (SELECT k FROM {LABEL_ROWS})) AS rows_with_labels,
  (SELECT count(DISTINCT k) FROM {LABEL_ROWS} WHERE k NOT IN (SELECT c_custkey::VARCHAR FROM customer)) AS unmatched_label_keys, (SELECT count(*)-count(DISTINCT k) FROM {LABEL_ROWS}) AS duplicate_label_keys""")
def _(spark, sf):
    return M.label_report(_people(spark, sf), _label_rows(spark, sf), "patient", "patient")


@reg.add("j5_unmatched_labels", "SELECT DISTINCT o_custkey AS volume_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey<20)")
def _(spark, sf):
    people = X.table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("volume_id"))
    return M.unmatched_labels(people, X.table(spark, sf, "orders").select(F.col("o_custkey").alias("volume_id")))


@reg.add("j6_qc_gate", "SELECT volume_id, patient_id, kernel_class FROM catalog WHERE volume_id IN (SELECT volume_id FROM qc_rows WHERE passed)")
def _(spark, sf):
    return S.usable_rows(cat(spark, sf), X.qc_rows(spark, sf)).select("volume_id", "patient_id", "kernel_class")


APPLIED = """SELECT c.volume_id, q.passed AS qc_passed, CASE WHEN NOT coalesce(q.passed,false) THEN 'excluded' ELSE coalesce(e.split,'unassigned') END AS split
  FROM catalog c LEFT JOIN qc_rows q ON c.volume_id=q.volume_id LEFT JOIN existing_splits e ON e.patient_id=c.patient_id"""


@reg.add("j7_apply_splits", APPLIED)
def _(spark, sf):
    manifest = _manifest(spark, sf).select("volume_id", "patient_id", F.lit("study").alias("source_name"))
    frozen = X.existing_splits(spark, sf).withColumn("source_name", F.lit("study"))
    return S.apply_splits(manifest, frozen, X.qc_rows(spark, sf)).select("volume_id", "qc_passed", "split")


@reg.add("j8_reconcile", """WITH found AS (SELECT DISTINCT split_part(path,'/',1) AS name FROM files), listed AS (SELECT DISTINCT split_part(path,'/',1) AS name FROM files WHERE length(path)%3>0 UNION SELECT 'extra_'||n_name FROM nation)
  SELECT name,'missing' AS side FROM listed WHERE name NOT IN (SELECT name FROM found) UNION ALL SELECT name,'unexpected' FROM found WHERE name NOT IN (SELECT name FROM listed)""")
def _(spark, sf):
    files = X.files(spark, sf)
    listed = files.filter(F.length("path") % 3 > 0).select(F.substring_index("path", "/", 1).alias("name")).unionByName(
        X.table(spark, sf, "nation").select(F.concat(F.lit("extra_"), F.col("n_name")).alias("name")))
    return M.reconcile(files.select(F.col("path").alias("scan_path")), listed)


@reg.add("j9_pending", """SELECT volume_id FROM (SELECT l_orderkey||'_'||l_linenumber AS volume_id, CASE WHEN l_partkey%2=0 THEN 's'||(l_suppkey%3) END AS signature FROM lineitem) w WHERE NOT EXISTS (SELECT 1 FROM
  (SELECT o_orderkey||'_1' AS volume_id, CASE WHEN o_custkey%2=0 THEN 'fp' ELSE 'old' END AS fingerprint, 's'||(o_custkey%3) AS signature FROM orders) c WHERE c.volume_id=w.volume_id AND c.fingerprint='fp' AND (w.signature IS NULL OR w.signature=c.signature))""")
def _(spark, sf):
    work = X.table(spark, sf, "lineitem").select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("volume_id"),
                                                 F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string"))).alias("signature"))
    cache = X.table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("_1")).alias("volume_id"), F.when(F.col("o_custkey") % 2 == 0, "fp").otherwise("old").alias("fingerprint"),
                                                F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("signature"))
    return M.pending(work, cache, "fp").select("volume_id")


@reg.add("j10_missing_artifacts", "SELECT volume_id, split FROM findings WHERE volume_id NOT IN (SELECT volume_id FROM slices)")
def _(spark, sf):
    return M.missing_artifacts(X.findings(spark, sf).select("volume_id", "split"), X.slices(spark, sf).select("volume_id").distinct())


# ---------------------------------------------------------------- worklists
@reg.add("cu1_catalog", f"SELECT {CATALOG_COLUMNS} FROM catalog")
def _(spark, sf):
    return cat(spark, sf)


PNUM = "split_part(patient_id,'_',2)::BIGINT"


@reg.add("cu2_natural_order", f"SELECT volume_id, row_number() OVER (ORDER BY {PNUM}, scan_id, reconstruction_id, volume_id)-1 AS position FROM catalog")
def _(spark, sf):
    from scanledger.operators.ordering import number_cell, positions
    rows = cat(spark, sf).select("volume_id", "scan_id", "reconstruction_id", I.patient_number(F.col("patient_id")).alias("n"))
    return positions(rows, [], number_cell(F.col("n")), ["n", "scan_id", "reconstruction_id", "volume_id"]).select("volume_id", "position")


@reg.add("cu3_one_per_scan", "SELECT volume_id FROM (SELECT volume_id, row_number() OVER (PARTITION BY patient_id, scan_id ORDER BY reconstruction_id, volume_id) AS rn FROM catalog) WHERE rn=1")
def _(spark, sf):
    return L.one_per_scan(cat(spark, sf)).select("volume_id")


def order_sql(seed, source, where="true"):
    return f"(SELECT patient_id, row_number() OVER (ORDER BY md5('{seed}:'||patient_id), patient_id)-1 AS rank FROM (SELECT DISTINCT patient_id FROM {source} WHERE {where}))"


@reg.add("cu4_patient_order", f"SELECT * FROM {order_sql(7, 'catalog')}")
def _(spark, sf):
    return L.patient_order(cat(spark, sf), 7)


WANTED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, scan_id ORDER BY reconstruction_id, volume_id) AS rn FROM catalog WHERE source_split='train' AND kernel_class='sharp') WHERE rn=1)"


@reg.add("cu5_capped_cohort", f"SELECT volume_id, patient_id FROM {WANTED} WHERE patient_id IN (SELECT patient_id FROM {order_sql(7, WANTED)} WHERE rank<100)")
def _(spark, sf):
    train = cat(spark, sf).filter("source_split='train'")
    return L.selected_train(train, "sharp", 7, 100).select("volume_id", "patient_id")


@reg.add("cu6_grouped_order", f"SELECT volume_id, row_number() OVER (ORDER BY md5('7:'||patient_id), patient_id, scan_id, reconstruction_id, volume_id)-1 AS position FROM catalog")
def _(spark, sf):
    return L.in_patient_order(_manifest(spark, sf), 7).select("volume_id", "position")


@reg.add("cu7_chunks", "SELECT chunk, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY md5('7:'||patient_id), patient_id, scan_id, reconstruction_id, volume_id)-1)//40 AS chunk FROM catalog) GROUP BY 1")
def _(spark, sf):
    return L.chunked(L.in_patient_order(cat(spark, sf), 7), 40).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def worklist_sql(train, test, size=40):
    path = "'dataset/'||source_split||'_fixed/'||patient_id||'/'||patient_id||'_'||scan_id||'/'||volume_id||'.nii.gz'"
    cols = "volume_id, patient_id, scan_id, reconstruction_id, source_split, manufacturer, kernel, kernel_class"
    o = "row_number() OVER (ORDER BY md5('{}:'||patient_id), patient_id, scan_id, reconstruction_id, volume_id)-1"
    return f"""WITH te AS (SELECT {o.format(8)} AS pos, {cols} FROM {test}), tr AS (SELECT {o.format(7)} AS pos, {cols} FROM {train}), n AS (SELECT count(*) AS n FROM te)
      SELECT pos//{size} AS chunk, pos AS "order", {cols}, {path} AS repo_path FROM te UNION ALL SELECT ceil(n/{size})::BIGINT+pos//{size}, n+pos, {cols}, {path} FROM tr, n"""


TRAIN_SCREENED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, scan_id ORDER BY reconstruction_id, volume_id) AS rn FROM catalog WHERE source_split='train' AND kernel_class='sharp' AND volume_id NOT IN {SCREEN}) WHERE rn=1)"
CAPPED = worklist_sql(f"(SELECT * FROM {TRAIN_SCREENED} WHERE patient_id IN (SELECT patient_id FROM {order_sql(7, TRAIN_SCREENED)} WHERE rank<200))", "(SELECT * FROM catalog WHERE source_split='valid')")


@reg.add("cu8_build_worklist", CAPPED)
def _(spark, sf):
    return L.build_worklist(X.parsed_volumes(spark, sf), X.kernel_table(spark, sf), chunk_size=40, seed=7, max_train_patients=200, max_combined_gb=0.06)


PLAIN_LIST = worklist_sql(WANTED, "(SELECT * FROM catalog WHERE source_split='valid')")


@reg.add("cu9_worklist_summary", f"""WITH w AS ({PLAIN_LIST}), t AS (SELECT patient_id, scan_id, count(*) AS n, bool_or(kernel_class='sharp') AS has FROM catalog WHERE source_split='train' GROUP BY 1,2),
    p AS (SELECT patient_id, bool_or(has) AS has FROM t GROUP BY 1), m AS (SELECT * FROM {V_CLEAN})
  SELECT name, value::BIGINT AS value FROM (
    SELECT 'skipped_unparsable' AS name, (SELECT count(*) FROM m WHERE NOT regexp_matches(volume_id,{VID})) AS value
    UNION ALL SELECT 'skipped_wrong_pool', (SELECT count(*) FROM m WHERE regexp_matches(volume_id,{VID}) AND split_part(volume_id,'_',1)<>pool)
    UNION ALL SELECT 'train_volumes_available', (SELECT sum(n) FROM t) UNION ALL SELECT 'train_patients_available', (SELECT count(*) FROM p)
    UNION ALL SELECT 'train_scans_total', (SELECT count(*) FROM t) UNION ALL SELECT 'train_scans_selected', (SELECT count(*) FROM t WHERE has)
    UNION ALL SELECT 'train_scans_skipped_no_kernel', (SELECT count(*) FROM t WHERE NOT has) UNION ALL SELECT 'train_patients_without_kernel', (SELECT count(*) FROM p WHERE NOT has)
    UNION ALL SELECT 'test_volumes', (SELECT count(*) FROM w WHERE source_split='valid') UNION ALL SELECT 'test_patients', (SELECT count(DISTINCT patient_id) FROM w WHERE source_split='valid')
    UNION ALL SELECT 'test_chunks', (SELECT count(DISTINCT chunk) FROM w WHERE source_split='valid')
    UNION ALL SELECT 'test_'||k, (SELECT count(*) FROM w WHERE source_split='valid' AND kernel_class=k) FROM (SELECT unnest(['sharp','soft','other']) AS k)
    UNION ALL SELECT 'train_volumes', (SELECT count(*) FROM w WHERE source_split='train') UNION ALL SELECT 'train_patients', (SELECT count(DISTINCT patient_id) FROM w WHERE source_split='train')
    UNION ALL SELECT 'train_chunks', (SELECT count(DISTINCT chunk) FROM w WHERE source_split='train') UNION ALL SELECT 'total_volumes', (SELECT count(*) FROM w) UNION ALL SELECT 'total_chunks', (SELECT count(DISTINCT chunk) FROM w))""")
def _(spark, sf):
    meta, table = X.parsed_volumes(spark, sf), X.kernel_table(spark, sf)
    return L.worklist_summary(meta, table, L.build_worklist(meta, table, chunk_size=40, seed=7))


@reg.add("cu10_storage_projection", f"""SELECT count(*) AS volumes, count(*) FILTER (q.volume_id IS NOT NULL) AS cached, count(*) FILTER (q.volume_id IS NULL) AS to_fetch, {r('count(*)*22.5::DOUBLE/1000', 'projected_gb')},
  {r('count(*) FILTER (q.volume_id IS NULL)*22.5::DOUBLE/1000', 'to_fetch_gb')} FROM catalog c LEFT JOIN (SELECT volume_id FROM qc_rows WHERE passed) q ON c.volume_id=q.volume_id""")
def _(spark, sf):
    return tidy(L.storage_projection(cat(spark, sf), X.qc_rows(spark, sf).filter("passed"), 22.5))


@reg.add("cu11_patients_with_kernel", "SELECT DISTINCT patient_id FROM catalog WHERE source_split='train' AND kernel_class='soft'")
def _(spark, sf):
    return L.patients_with_kernel(cat(spark, sf), "soft")


PARENT = "(SELECT 'train_'||c_custkey AS patient_id, CASE c_custkey%4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM customer)"


def _parent(spark, sf):
    k = F.col("c_custkey") % 4
    return X.table(spark, sf, "customer").select(F.concat(F.lit("train_"), F.col("c_custkey").cast("string")).alias("patient_id"),
                                                 F.when(k == 0, "val").when(k == 1, "test").otherwise("train").alias("split"))


@reg.add("cu12_child_cohort", f"""SELECT patient_id, split, row_number() OVER (ORDER BY md5('3:mix:'||patient_id), patient_id)-1 AS rank FROM (SELECT patient_id, split, row_number() OVER (PARTITION BY split ORDER BY md5('3:'||patient_id), patient_id) AS pick
  FROM {PARENT} WHERE split IN ('train','val') AND patient_id IN (SELECT patient_id FROM catalog WHERE source_split='train' AND kernel_class='soft')) WHERE pick <= CASE split WHEN 'train' THEN 40 ELSE 5 END""")
def _(spark, sf):
    return L.child_patients(_parent(spark, sf), L.patients_with_kernel(cat(spark, sf), "soft"), {"train": 40, "val": 5}, 3)


@reg.add("cu12_child_shortfall", f"""SELECT 'train' AS split, 1000000::BIGINT AS asked, count(*) AS available FROM {PARENT} WHERE split='train' AND patient_id IN (SELECT patient_id FROM catalog WHERE source_split='train' AND kernel_class='soft')""")
def _(spark, sf):
    return L.child_shortfall(_parent(spark, sf), L.patients_with_kernel(cat(spark, sf), "soft"), {"train": 1_000_000, "val": 1})


NAMED = "SELECT *, manufacturer||chr(9)||kernel AS pair FROM catalog WHERE source_split='train'"
SURVEY_SQL = f"""WITH RECURSIVE named AS ({NAMED}),
  two AS (SELECT patient_id, scan_id, patient_id||'/'||scan_id AS scan, md5('11:'||patient_id||':'||scan_id) AS k, min(pair) AS a, max(pair) AS b FROM named GROUP BY patient_id, scan_id HAVING count(*)=2),
  sides AS (SELECT scan, k, a AS pair FROM two UNION SELECT scan, k, b FROM two),
  cands AS (SELECT pair, list(scan ORDER BY k, scan) AS scans, row_number() OVER (ORDER BY count(*), pair) AS turn FROM sides GROUP BY pair),
  g AS (SELECT 0::BIGINT AS turn, []::VARCHAR[] AS chosen UNION ALL SELECT c.turn, list_concat(g.chosen, list_filter(c.scans, lambda x: NOT list_contains(g.chosen, x))[1:greatest(0, 3-len(list_intersect(c.scans, g.chosen)))])
        FROM g JOIN cands c ON c.turn=g.turn+1),
  picked AS (SELECT unnest(chosen) AS scan FROM (SELECT chosen FROM g ORDER BY turn DESC LIMIT 1)),
  rows AS (SELECT *, row_number() OVER (ORDER BY {PNUM}, scan_id, reconstruction_id, volume_id)-1 AS pos FROM catalog WHERE source_split='train' AND patient_id||'/'||scan_id IN (SELECT scan FROM picked))
  SELECT pos//40 AS chunk, pos AS "order", volume_id, patient_id, scan_id, reconstruction_id, source_split, manufacturer, kernel, kernel_class,
    'dataset/'||source_split||'_fixed/'||patient_id||'/'||patient_id||'_'||scan_id||'/'||volume_id||'.nii.gz' AS repo_path FROM rows"""


@reg.add("cu13_survey_worklist", SURVEY_SQL)
def _(spark, sf):
    volumes = staged(cat(spark, sf))  # the sample and the list both read it
    return L.survey_worklist(volumes, L.survey_sample(volumes, 3, 11), 40)


@reg.add("cu14_dedupe", """SELECT volume_id, event_id, value FROM (SELECT 'vol_'||(event_id%5000) AS volume_id, event_id, value, row_number() OVER (PARTITION BY event_id%5000 ORDER BY event_id, value) AS rn FROM events) WHERE rn=1""")
def _(spark, sf):
    return M.dedupe(X.chunk_log(spark, sf).select("volume_id", "event_id", "value"), ["event_id"])


@reg.add("cu14_duplicates_dropped", "SELECT count(*) AS rows, count(*)-count(DISTINCT event_id%5000) AS duplicates_dropped FROM events")
def _(spark, sf):
    return M.duplicates_dropped(X.chunk_log(spark, sf))


UNIFIED = """SELECT "VolumeName" AS name, v."Manufacturer" AS manufacturer, regexp_extract("ConvolutionKernel",'([A-Za-z0-9_.+-]+)',1) AS kernel, coalesce(k.class,'other') AS kernel_class
  FROM volumes v LEFT JOIN kernel_table k ON lower(trim(v."Manufacturer"))=lower(trim(k.manufacturer)) AND lower(regexp_extract("ConvolutionKernel",'([A-Za-z0-9_.+-]+)',1))=lower(k.kernel)"""


@reg.add("cu15_kernel_columns", UNIFIED)
def _(spark, sf):
    out = M.with_kernel_columns(X.volumes(spark, sf), X.kernel_table(spark, sf))
    return out.select(F.col("VolumeName").alias("name"), "manufacturer", "kernel", "kernel_class")


@reg.add("cu15_missing_columns", "SELECT volume_id, '' AS kernel, 'other' AS kernel_class FROM findings")
def _(spark, sf):
    return M.with_kernel_columns(X.findings(spark, sf).select("volume_id"), X.kernel_table(spark, sf))


MERGED = """WITH d AS (SELECT volume_id, manufacturer, kernel_raw, ingest_chunk FROM (SELECT c.volume_id, v.m AS manufacturer, v.k AS kernel_raw, v.ingest_chunk, row_number() OVER (PARTITION BY c.volume_id ORDER BY v.ingest_chunk, v.m, v.k) AS rn
    FROM (SELECT DISTINCT volume_id FROM catalog) c JOIN (SELECT regexp_replace("VolumeName",'\\.nii(\\.gz)?$','') AS volume_id, "Manufacturer" AS m, "ConvolutionKernel" AS k, ("NumberofSlices"%7)::VARCHAR AS ingest_chunk FROM volumes) v ON c.volume_id=v.volume_id) WHERE rn=1)
  SELECT d.volume_id, d.manufacturer, regexp_extract(kernel_raw,'([A-Za-z0-9_.+-]+)',1) AS kernel, coalesce(k.class,'other') AS kernel_class, p.patient_id, ingest_chunk, q.label_passed, coalesce(e.split,'unassigned') AS split
  FROM d JOIN (SELECT DISTINCT volume_id, patient_id FROM catalog) p ON p.volume_id=d.volume_id LEFT JOIN kernel_table k ON lower(k.manufacturer)=lower(d.manufacturer) AND lower(k.kernel)=lower(regexp_extract(kernel_raw,'([A-Za-z0-9_.+-]+)',1))
  LEFT JOIN (SELECT volume_id, passed::DOUBLE AS label_passed FROM qc_rows) q ON q.volume_id=d.volume_id LEFT JOIN existing_splits e ON e.patient_id=p.patient_id"""


def _merged(spark, sf):
    rows = X.parsed_volumes(spark, sf).select("pool", "volume_id", F.col("Manufacturer"), "ConvolutionKernel", (F.col("NumberofSlices") % 7).cast("string").alias("ingest_chunk"))
    keep = X.volume_keys(spark, sf)
    parts = I.volume_id_parts(F.col("volume_id"))
    rows = rows.drop("pool").join(keep, "volume_id", "left_semi").withColumn("patient_id", parts["patient_id"]).withColumn("source_name", F.lit("study"))
    labels = X.qc_rows(spark, sf).select("volume_id", F.col("passed").cast("double").alias("Passed"))
    return M.merge_run(rows, X.kernel_table(spark, sf), X.existing_splits(spark, sf).withColumn("source_name", F.lit("study")), labels)


@reg.add("cu16_merge_run", MERGED)
def _(spark, sf):
    return _merged(spark, sf).select("volume_id", "manufacturer", "kernel", "kernel_class", "patient_id", "ingest_chunk", "label_passed", "split")


@reg.add("cu18_suspicious_patients", """WITH c AS (SELECT split_part(path,'/',1) AS patient_id, count(*) AS n_scans FROM files GROUP BY 1) SELECT * FROM c WHERE n_scans > greatest(2.0::DOUBLE, 1.3::DOUBLE*(SELECT median(n_scans) FROM c))""")
def _(spark, sf):
    rows = X.files(spark, sf).select(F.substring_index("path", "/", 1).alias("patient_id"))
    return M.suspicious_patients(rows, 2, 1.3)


@reg.add("cu19_run_record", f"""SELECT 'abc' AS fingerprint, count(*) AS n_volumes, count(*) FILTER (kernel_class='sharp') AS n_sharp, count(*) FILTER (kernel_class='soft') AS n_soft, count(*) FILTER (kernel_class='other') AS n_other,
  (SELECT count(*) FROM qc_rows WHERE NOT passed) AS n_failed_volumes FROM catalog""")
def _(spark, sf):
    return M.run_record(cat(spark, sf), X.qc_rows(spark, sf).filter("NOT passed"), "abc")


PLAN = """WITH usable AS (SELECT * FROM catalog WHERE volume_id IN (SELECT volume_id FROM qc_rows WHERE passed)), forced AS (SELECT DISTINCT patient_id FROM usable WHERE source_split='valid'),
  new AS (SELECT DISTINCT patient_id FROM usable WHERE patient_id NOT IN (SELECT patient_id FROM existing_splits)),
  need AS (SELECT greatest(200-count(*) FILTER (split='val'),0) AS nv, greatest(250-count(*) FILTER (split='test'),0) AS nt FROM existing_splits WHERE patient_id NOT IN (SELECT patient_id FROM forced)),
  drawn AS (SELECT patient_id, row_number() OVER (ORDER BY md5('5:'||patient_id), patient_id) AS rn FROM new WHERE patient_id NOT IN (SELECT patient_id FROM forced)),
  mapping AS (SELECT patient_id, split FROM existing_splits UNION ALL SELECT patient_id, 'test' FROM new WHERE patient_id IN (SELECT patient_id FROM forced)
  UNION ALL SELECT patient_id, CASE WHEN rn<=nt THEN 'test' WHEN rn<=nt+nv THEN 'val' ELSE 'train' END FROM drawn, need)"""


def _manifest(spark, sf):
    """Volumes of the catalog with their ids only."""
    keys = X.volume_keys(spark, sf)
    return keys.select("volume_id", *[c.alias(n) for n, c in I.volume_id_parts(F.col("volume_id")).items()])


def _assigned(spark, sf, n_val=200, n_test=250):
    return S.assign_source_splits(_manifest(spark, sf), X.qc_rows(spark, sf), X.existing_splits(spark, sf), n_val=n_val, n_test=n_test, seed=5)


@reg.add("cu22_plan_split", f"{PLAN} SELECT patient_id, split FROM mapping")
def _(spark, sf):
    return _assigned(spark, sf)["mapping"]


@reg.add("cu22_split_shortfall", f"{PLAN} SELECT greatest(1000000-count(*) FILTER (split='val'),0) AS need_val, greatest(250-count(*) FILTER (split='test'),0) AS need_test, (SELECT count(*) FROM drawn) AS candidates FROM existing_splits WHERE patient_id NOT IN (SELECT patient_id FROM forced)")
def _(spark, sf):
    return _assigned(spark, sf, n_val=1_000_000)["shortfall"]


@reg.add("cu23_split_counts", f"{PLAN} SELECT split, count(DISTINCT u.patient_id) AS patients, count(*) AS volumes FROM usable u JOIN mapping m ON u.patient_id=m.patient_id GROUP BY 1")
def _(spark, sf):
    return _assigned(spark, sf)["counts"]


@reg.add("cu24_overlap_check", """SELECT patient_id, count(DISTINCT split) AS n_splits FROM (SELECT patient_id, CASE reconstruction_id%3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'unassigned' END AS split FROM catalog) WHERE split IN ('train','val','test') GROUP BY 1 HAVING count(DISTINCT split)>1""")
def _(spark, sf):
    k = F.col("reconstruction_id") % 3
    return S.overlapping_patients(cat(spark, sf).select("patient_id", F.when(k == 0, "train").when(k == 1, "val").otherwise("unassigned").alias("split")))


@reg.add("cu25_combine_runs", "SELECT volume_id, split, label_quality, CASE WHEN volume_id::INT%3<2 THEN 'a' ELSE 'b' END AS run FROM findings WHERE volume_id::INT%3>0 OR volume_id::INT%3<2")
def _(spark, sf):
    f = X.findings(spark, sf).select("volume_id", "split", "label_quality")
    a, b = f.filter(F.col("volume_id").cast("int") % 3 < 2), f.filter(F.col("volume_id").cast("int") % 3 > 0)
    return M.combine_runs([a.withColumn("run", F.lit("a")), b.withColumn("run", F.lit("b"))])


@reg.add("cu25_split_clashes", """SELECT patient_id, count(DISTINCT split) AS n_splits FROM (SELECT patient_id, CASE WHEN volume_id::INT%3=2 AND volume_id::INT%5=0 THEN 'val' ELSE split END AS split FROM findings)
  WHERE split IN ('train','val','test') GROUP BY 1 HAVING count(DISTINCT split)>1""")
def _(spark, sf):
    f, v = X.findings(spark, sf).select("volume_id", "patient_id", "split", "label_quality"), F.col("volume_id").cast("int")
    second = f.filter(v % 3 > 0).withColumn("split", F.when((v % 3 == 2) & (v % 5 == 0), "val").otherwise(F.col("split")))
    return M.split_clashes(M.combine_runs([f.filter(v % 3 < 2), second], check=False))


DRAFT_ROWS = """(SELECT "Manufacturer" AS manufacturer, regexp_extract("ConvolutionKernel",'([A-Za-z0-9_.+-]+)',1) AS kernel, coalesce("SeriesDescription",'(empty)') AS d,
  CASE WHEN contains(upper("SeriesDescription"),'LUNG') THEN 'sharp' ELSE 'other' END AS draft FROM volumes)"""


@reg.add("cu26_draft_kernel_table", f"""SELECT manufacturer, kernel, n.class, n.n_volumes, {r('n.agreement', 'agreement')}, c.common_description, 'draft' AS status FROM
  (SELECT manufacturer, kernel, min({{'n': -n, 'v': draft}}).v AS class, sum(n)::BIGINT AS n_volumes, round(max(n)/sum(n),3) AS agreement FROM (SELECT manufacturer, kernel, draft, count(*) AS n FROM {DRAFT_ROWS} GROUP BY 1,2,3) GROUP BY 1,2) n
  JOIN (SELECT manufacturer, kernel, min({{'n': -n, 'v': d}}).v AS common_description FROM (SELECT manufacturer, kernel, d, count(*) AS n FROM {DRAFT_ROWS} GROUP BY 1,2,3) GROUP BY 1,2) c USING (manufacturer, kernel)""")
def _(spark, sf):
    return tidy(K.draft_table(X.volumes(spark, sf)))


@reg.add("cu27_work_status", f"""WITH log AS (SELECT chunk, count(*) FILTER (failed)=0 AS done FROM chunk_log GROUP BY 1), m AS ({APPLIED})
  SELECT stage, done, total, CASE WHEN done>=total THEN 'done' WHEN done>0 THEN 'partial' ELSE 'todo' END AS state FROM (SELECT 'ingest' AS stage, count(*) FILTER (done) AS done, count(*) AS total FROM log
  UNION ALL SELECT 'qc', count(*) FILTER (qc_passed IS NOT NULL), count(*) FROM m UNION ALL SELECT 'splits', count(*) FILTER (split<>'unassigned'), count(*) FROM m)""")
def _(spark, sf):
    log = X.chunk_log(spark, sf)
    state = log.groupBy("chunk").agg((F.count_if("failed") == 0).alias("done"))
    manifest = S.apply_splits(cat(spark, sf).select("volume_id", "patient_id", F.lit("s").alias("source_name")),
                              X.existing_splits(spark, sf).withColumn("source_name", F.lit("s")), X.qc_rows(spark, sf))
    return M.work_status(log.select("chunk"), state, manifest, X.qc_rows(spark, sf))


@reg.add("cu28_cohort_coverage", """SELECT split, count(*) FILTER (kernel_class='en' AND s.v IS NOT NULL) AS encoded_en, count(*) FILTER (kernel_class='en') AS total_en, count(*) FILTER (kernel_class='fr' AND s.v IS NOT NULL) AS encoded_fr, count(*) FILTER (kernel_class='fr') AS total_fr
  FROM findings f LEFT JOIN (SELECT DISTINCT volume_id AS v FROM slices) s ON f.volume_id=s.v GROUP BY 1""")
def _(spark, sf):
    return M.coverage(X.findings(spark, sf), X.slices(spark, sf), ["en", "fr"])


@reg.add("cu29_encode_plan", """SELECT split, count(*) AS volumes, sum(n_slices)::BIGINT AS slices, (sum(n_slices)*64*2)::BIGINT AS bytes, count(*) FILTER (n_slices%2=0) AS done, count(*) FILTER (n_slices%2<>0) AS to_do FROM findings GROUP BY 1""")
def _(spark, sf):
    f = X.findings(spark, sf)
    return M.encode_plan(M.select_volumes(f), f.filter("n_slices % 2 = 0").select("volume_id", "n_slices"), 64, 2)


# ---------------------------------------------------------------- sources
@reg.add("src6_source_signature", """SELECT folder, count(*)||':'||sum(length) AS signature FROM (SELECT regexp_extract(path,'^(.*)/[^/]*$',1) AS folder, length FROM files) GROUP BY 1""")
def _(spark, sf):
    return SR.source_signature(X.files(spark, sf))


DISCOVER = """SELECT regexp_extract(path,'^(.*)/[^/]*$',1) AS scan_path, 'dicom' AS format, count(*) AS n_files, series_uid FROM files WHERE path LIKE '%.dcm' AND NOT regexp_matches(path,'(^|/)\\.[^/]+/') GROUP BY 1,4
  UNION ALL SELECT DISTINCT path, 'nifti', 1, NULL FROM files WHERE regexp_matches(lower(path),'\\.nii(\\.gz)?$')"""


@reg.add("src7_discover_scans", DISCOVER)
def _(spark, sf):
    return SR.discover_scans(X.files(spark, sf))


@reg.add("src7_discover_limited", f"SELECT * FROM ({DISCOVER}) ORDER BY scan_path, coalesce(series_uid,'') LIMIT 25")
def _(spark, sf):
    return SR.discover_scans(X.files(spark, sf), max_scans=25)


@reg.add("src12_archive_listing", """SELECT regexp_replace(n,'\\.(tar\\.gz|tgz|zip|tar)$','','i') AS chunk_id, n AS name FROM (SELECT regexp_extract(path,'([^/]+)$',1) AS n FROM files WHERE regexp_matches(path,'(?i)\\.(tar\\.gz|tgz|zip|tar)$'))""")
def _(spark, sf):
    return SR.archive_chunks(X.files(spark, sf))


CHECKLIST = """(SELECT page_id, CASE page_id%5 WHEN 0 THEN '# '||url WHEN 1 THEN '   ' WHEN 2 THEN '  '||url||'//' ELSE url END AS v FROM pages)"""


@reg.add("src13_checklist", f"SELECT name FROM (SELECT regexp_replace(trim(v),'[/\\\\]+$','') AS name FROM {CHECKLIST}) WHERE name<>'' AND NOT starts_with(name,'#')")
def _(spark, sf):
    k = F.col("page_id") % 5
    value = F.when(k == 0, F.concat(F.lit("# "), F.col("url"))).when(k == 1, "   ").when(k == 2, F.concat(F.lit("  "), F.col("url"), F.lit("//"))).otherwise(F.col("url"))
    return SR.checklist(X.table(spark, sf, "pages").select(value.alias("value")))


@reg.add("src11_embedding_scan", "SELECT volume_id, slice_idx::BIGINT AS slice_idx, emb FROM slices")
def _(spark, sf):
    return X.slices(spark, sf).select("volume_id", F.col("slice_idx").cast("bigint").alias("slice_idx"), "emb")


@reg.add("snk3_validate_embeddings", """SELECT volume_id, slice_idx::BIGINT AS slice_idx, CASE WHEN v%7=0 THEN 'expected 64 dimensions, got 60' WHEN v%11=0 AND slice_idx=3 THEN 'contains NaN or inf' WHEN v%13=0 AND slice_idx=2 THEN 'exceeds the half precision range' END AS reason
  FROM (SELECT *, volume_id::INT AS v FROM slices)""")
def _(spark, sf):
    v, z = F.col("volume_id").cast("int"), F.col("slice_idx")
    broken = F.when(v % 7 == 0, F.slice("emb", 1, 60)).when((v % 11 == 0) & (z == 3), F.transform("emb", lambda x: x + F.lit(float("nan")))).when(
        (v % 13 == 0) & (z == 2), F.transform("emb", lambda x: x + 70000.0)).otherwise(F.col("emb"))
    out = SW.validate_embeddings(X.slices(spark, sf).withColumn("emb", broken), 64)
    return out.select("volume_id", F.col("slice_idx").cast("bigint").alias("slice_idx"), "reason")


@reg.add("snk4_store_index", "SELECT volume_id, count(*) AS n_slices, max(len(emb))::BIGINT AS embed_dim FROM slices GROUP BY 1")
def _(spark, sf):
    return SW.store_index(X.slices(spark, sf))


# ---------------------------------------------------------------- windows, limits and sets
@reg.add("wn1_first_per_group", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn=1")
def _(spark, sf):
    ev = X.table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return first_per(ev, ["user_id"], ["ts", "event_id"]).drop("ts")


@reg.add("so4_limited_run", "SELECT DISTINCT chunk::BIGINT AS chunk FROM chunk_log WHERE chunk::BIGINT%3>0 ORDER BY 1 LIMIT 10")
def _(spark, sf):
    chunks = X.chunk_log(spark, sf).select(F.col("chunk").cast("bigint").alias("chunk")).distinct()
    return chunks.filter("chunk % 3 > 0").orderBy("chunk").limit(10)


@reg.add("se1_union_runs", "SELECT volume_id, split, label_quality, NULL::DOUBLE AS label_toxic FROM findings UNION ALL SELECT volume_id, split, NULL, label_toxic FROM findings")
def _(spark, sf):
    f = X.findings(spark, sf)
    return f.select("volume_id", "split", "label_quality").unionByName(f.select("volume_id", "split", "label_toxic"), allowMissingColumns=True)


@reg.add("se2_set_difference", "SELECT DISTINCT patient_id FROM catalog EXCEPT SELECT patient_id FROM existing_splits")
def _(spark, sf):
    return cat(spark, sf).select("patient_id").subtract(X.existing_splits(spark, sf).select("patient_id"))


@reg.add("se3_set_intersection", "SELECT patient_id FROM catalog WHERE kernel_class='soft' INTERSECT SELECT patient_id FROM existing_splits")
def _(spark, sf):
    return cat(spark, sf).filter("kernel_class = 'soft'").select("patient_id").intersect(X.existing_splits(spark, sf).select("patient_id"))
