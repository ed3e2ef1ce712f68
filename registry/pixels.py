"""Registered queries: pixel grids, headers and quality control (sections 2.9 and parts of 2.2, 2.6)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanledger.functions import numeric as N, pixels as P
from scanledger.operators import grid as G, headers as Hd, kernels as K, quality as Q
from scanledger.plans import preprocessing as PP
from scanledger.sources import readers as SR
from scanledger.staging import staged

from . import Registry, fixtures as X
from .common import r, rs, tidy

reg = Registry()
SMALL = Q.Thresholds(min_slices=5, max_slices=12)
V = "volume_id::INT"


def px(spark, sf) -> DataFrame:
    return X.pixel_slices(spark, sf)


def voxels(df: DataFrame) -> DataFrame:
    """Pixels as rows, for comparison with the SQL form."""
    out = df.select("volume_id", F.col("z").cast("bigint").alias("z"), "w", F.posexplode("pixels").alias("i", "hu"))
    return out.select("volume_id", "z", F.floor(F.col("i") / F.col("w")).alias("y"), (F.col("i") % F.col("w")).cast("bigint").alias("x"), F.col("hu").cast("double").alias("hu"))


def damaged(spark, sf) -> DataFrame:
    """Some volumes with NaN pixels, some out of the int16 range."""
    v = F.col("volume_id").cast("int")
    return px(spark, sf).withColumn("pixels", F.when((v % 7 == 0) & (F.col("z") == 2), F.transform("pixels", lambda p, i: F.when(i == 3, float("nan")).otherwise(p)))
                                    .when(v % 5 == 0, F.transform("pixels", lambda p: p * 50.0)).otherwise(F.col("pixels")))


DAMAGED = f"(SELECT volume_id, z, y, x, CASE WHEN {V}%7=0 AND z=2 AND y=0 AND x=3 THEN 'nan'::DOUBLE WHEN {V}%7=0 AND z=2 THEN hu WHEN {V}%5=0 THEN hu*50 ELSE hu END AS hu FROM voxels)"
STATS = """SELECT volume_id, count(DISTINCT z) AS n_slices, count(*) AS n_pixels, count(*) FILTER (NOT isfinite(hu)) AS n_nonfinite, min(CASE WHEN isfinite(hu) THEN hu END) AS hu_min,
  max(CASE WHEN isfinite(hu) THEN hu END) AS hu_max, avg(CASE WHEN isfinite(hu) THEN hu END) AS hu_mean, stddev_pop(CASE WHEN isfinite(hu) THEN hu END) AS hu_std FROM {} GROUP BY 1"""


@reg.add("px1_nonfinite_check", f"SELECT volume_id, n_slices, n_pixels, n_nonfinite, {r('hu_min', 'hu_min')}, {r('hu_max', 'hu_max')}, {r('hu_mean', 'hu_mean', 8)}, {r('hu_std', 'hu_std', 7)}, CASE WHEN n_nonfinite>0 THEN 'contains NaN or infinite values' END AS problem FROM ({STATS.format(DAMAGED)})")
def _(spark, sf):
    return Q.volume_stats(damaged(spark, sf)).withColumn("problem", Q.nonfinite_problem()).withColumn("hu_mean", F.round("hu_mean", 8) + 0.0).withColumn("hu_std", F.round("hu_std", 7))


@reg.add("px2_int16_check", f"""SELECT volume_id, CASE WHEN n_nonfinite>0 THEN 'contains NaN or infinite values' WHEN hu_min < -32768 OR hu_max > 32767 THEN
  'HU values '||hu_min::BIGINT||'..'||hu_max::BIGINT||' do not fit in int16 (-32768..32767) -- corrupt or mis-scaled data' END AS problem FROM ({STATS.format(DAMAGED)})""")
def _(spark, sf):
    return Q.volume_stats(damaged(spark, sf)).select("volume_id", Q.int16_problem().alias("problem"))


def rescale(spark, sf):
    v = F.col("volume_id").cast("int")
    return px(spark, sf).select("volume_id").distinct().select("volume_id", F.when(v % 4 > 0, F.lit(2.0)).alias("slope"), F.when(v % 4 > 0, F.lit(-500.0)).alias("intercept"))


CAL = f"""(SELECT *, low<=-600 AS done, {V}%4>0 AS known FROM (SELECT volume_id, quantile_cont(hu,0.005) AS low FROM voxels GROUP BY 1))"""


@reg.add("px3_calibration_info", f"""SELECT volume_id, NOT done AND known AS applied, done AS already_calibrated, {r('low', 'p_low_before')}, {r('CASE WHEN NOT done AND known THEN low*2-500 END', 'p_low_after')},
  CASE WHEN NOT done AND NOT known THEN 'looks uncalibrated but no RescaleSlope/RescaleIntercept was provided' END AS reason FROM {CAL}""")
def _(spark, sf):
    return tidy(Q.calibration_info(px(spark, sf), rescale(spark, sf), -600.0).drop("slope", "intercept"))


@reg.add("px3_negative_slope", f"""SELECT volume_id, {r('low', 'p_low_before')}, {r('CASE WHEN NOT done AND known THEN high*-2-500 END', 'p_low_after')}
  FROM (SELECT *, low<=-600 AS done, {V}%4>0 AS known FROM (SELECT volume_id, quantile_cont(hu,0.005) AS low, quantile_cont(hu,0.995) AS high FROM voxels GROUP BY 1))""")
def _(spark, sf):
    down = rescale(spark, sf).withColumn("slope", -F.col("slope"))
    return tidy(Q.calibration_info(px(spark, sf), down, -600.0).select("volume_id", "p_low_before", "p_low_after"))


@reg.add("px3_calibrated_pixels", f"SELECT v.volume_id, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, CASE WHEN NOT done AND known THEN hu*2-500 ELSE hu END AS hu FROM voxels v JOIN {CAL} c ON v.volume_id=c.volume_id")
def _(spark, sf):
    s = px(spark, sf)
    return voxels(Q.calibrate(s, Q.calibration_info(s, rescale(spark, sf), -600.0)))


@reg.add("px4_plausibility", f"SELECT volume_id, min(hu) AS min, max(hu) AS max, {r('avg(hu)', 'mean')}, {r('quantile_cont(hu,0.01)', 'p01')}, {r('quantile_cont(hu,0.99)', 'p99')}, min(hu)<-500 AS looks_like_hu FROM voxels GROUP BY 1")
def _(spark, sf):
    return tidy(Q.plausibility(px(spark, sf)))


@reg.add("px5_floor_audit", "SELECT volume_id, min(hu) AS hu_min_before, max(hu) AS hu_max_before, -700.0::DOUBLE AS hu_floor, min(hu)<-700 AS floored FROM voxels GROUP BY 1")
def _(spark, sf):
    return Q.floor_audit(px(spark, sf), -700.0)


@reg.add("fn21_pixel_floor", "SELECT volume_id, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, greatest(hu,-200) AS hu FROM voxels")
def _(spark, sf):
    return voxels(Q.floor_pixels(px(spark, sf), -200.0))


@reg.add("fn20_hu_window", f"SELECT volume_id, slice_idx::BIGINT AS z, i, {r('(least(greatest(hu,-400),300)-12.5)/180.25', 'z_score')}, {r('((least(greatest(hu,-500),100)+500)/600-0.5)/0.25', 'w1')}, {r('(least(greatest(hu,0),80)-0)/80', 'w2')} FROM (SELECT volume_id, slice_idx, i, round(2000.0::DOUBLE*emb[i+1]) AS hu FROM slices, (SELECT unnest(range(64)) AS i))")
def _(spark, sf):
    v = px(spark, sf).select("volume_id", F.col("z").cast("bigint").alias("z"), F.posexplode("pixels").alias("i", "hu"))
    hu = F.col("hu")
    return tidy(v.select("volume_id", "z", "i", N.clip_zscore(hu, -400, 300, 12.5, 180.25).alias("z_score"), N.hu_window(hu, -500, 100, 0.5, 0.25).alias("w1"), N.hu_window(hu, 0, 80).alias("w2")))


def spaced(spark, sf):
    """Damaged volumes with too few slices, odd spacings and two sources."""
    v = F.col("volume_id").cast("int")
    s = damaged(spark, sf).filter(~((v % 9 == 0) & (F.col("z") > 3)))
    stats = Q.volume_stats(s)
    return stats.withColumn("spacing_z_mm", F.when(v % 6 == 0, F.lit(4.5)).when(v % 8 == 3, F.lit(None)).otherwise(F.lit(1.5))).withColumn("spacing_y_mm", F.lit(0.7)).withColumn(
        "spacing_x_mm", F.lit(0.7)).withColumn("source_name", F.when(v % 2 == 0, "a").otherwise("b"))


def checked(spark, sf):
    return Q.check_volumes(spaced(spark, sf), SMALL, {"b": Q.Thresholds(min_slices=3, max_slices=9, hu_min_uncalibrated=-800.0, min_std=300.0)})


SPACED = f"(SELECT *, {V} AS v, CASE WHEN {V}%6=0 THEN 4.5::DOUBLE WHEN {V}%8=3 THEN NULL ELSE 1.5::DOUBLE END AS sz FROM ({STATS.format('(SELECT * FROM ' + DAMAGED + f' WHERE NOT ({V}%9=0 AND z>3))')}))"
CHECKED = f"""(SELECT volume_id, v, n_slices, hu_min, hu_max, hu_std, list_filter([CASE WHEN n_slices<lo OR n_slices>hi THEN 'slice count '||n_slices||' outside ['||lo||', '||hi||']' END, CASE WHEN n_nonfinite>0 THEN 'contains NaN or infinite values' END,
  CASE WHEN hu_min>unc THEN 'HU minimum too high ('||hu_min::BIGINT||') -- looks uncalibrated (raw values, not true HU)' END, CASE WHEN hu_std<ms THEN 'near-constant volume (std='||printf('%.3f',hu_std)||')' END,
  CASE WHEN sz IS NULL THEN 'missing/invalid spacing' END],lambda x: x IS NOT NULL) AS reasons, CASE WHEN sz>3 THEN ['unusual z-spacing: 4.50 mm'] ELSE [] END AS flags
  FROM (SELECT *, CASE WHEN v%2=0 THEN 5 ELSE 3 END AS lo, CASE WHEN v%2=0 THEN 12 ELSE 9 END AS hi, CASE WHEN v%2=0 THEN -500 ELSE -800 END AS unc, CASE WHEN v%2=0 THEN 1.0 ELSE 300.0 END AS ms FROM {SPACED}))"""


@reg.add("px6_volume_qc", f"SELECT volume_id, array_to_string(reasons,'; ') AS reasons, array_to_string(flags,'; ') AS flags, len(reasons)=0 AS passed, n_slices, {r('hu_min', 'hu_min', 6)}, {r('hu_max', 'hu_max', 6)}, {r('hu_std', 'hu_std', 6)} FROM {CHECKED}")
def _(spark, sf):
    return tidy(checked(spark, sf).select("volume_id", F.array_join("reasons", "; ").alias("reasons"), F.array_join("flags", "; ").alias("flags"), "passed", "n_slices", "hu_min", "hu_max", "hu_std"), 6)


LOADER = f"""(SELECT volume_id, list_concat(reasons, CASE WHEN v%10=0 THEN ['non-uniform slice spacing (missing or duplicated slices?) -- resampling would distort it'] ELSE [] END) AS reasons,
  list_concat(flags, CASE WHEN v%12=0 THEN ['slice axis tilted 2.5 deg from the slice normal (gantry tilt?)'] ELSE [] END) AS flags FROM {CHECKED})"""


@reg.add("px7_loader_checks", f"SELECT volume_id, array_to_string(reasons,'; ') AS reasons, array_to_string(flags,'; ') AS flags, len(reasons)=0 AS passed FROM {LOADER}")
def _(spark, sf):
    v = F.col("volume_id").cast("int")
    c = checked(spark, sf).withColumn("z_uniform", F.when(v % 10 == 0, False).when(v % 10 == 1, True)).withColumn("tilt_deg", F.when(v % 12 == 0, 2.5).when(v % 12 == 1, 0.5))
    return Q.loader_checks(c).select("volume_id", F.array_join("reasons", "; ").alias("reasons"), F.array_join("flags", "; ").alias("flags"), "passed")


@reg.add("px8_qc_report", f"""SELECT m.volume_id, coalesce(n_pixels IS NOT NULL AND n_slices BETWEEN 5 AND 12 AND n_nonfinite=0 AND hu_min<=-500 AND hu_std>=1, false) AS passed,
  CASE WHEN n_pixels IS NULL THEN 'not preprocessed' ELSE array_to_string(list_filter([CASE WHEN n_nonfinite>0 THEN 'contains NaN or infinite values' END, CASE WHEN hu_min>-500 THEN 'HU minimum too high ('||hu_min::BIGINT||') -- looks uncalibrated (raw values, not true HU)' END],lambda x: x IS NOT NULL),'; ') END AS reasons,
  '' AS flags, n_slices, {r('hu_min', 'hu_min', 6)}, {r('hu_max', 'hu_max', 6)}, {r('hu_std', 'hu_std', 6)} FROM (SELECT volume_id FROM findings) m LEFT JOIN ({STATS.format(DAMAGED)}) s ON m.volume_id=s.volume_id""")
def _(spark, sf):
    manifest = X.findings(spark, sf).select(
        "volume_id", F.lit(1.5).alias("spacing_z_mm"), F.lit(0.7).alias("spacing_y_mm"), F.lit(0.7).alias("spacing_x_mm"), F.lit(True).alias("z_uniform"), F.lit(0.0).alias("tilt_deg"))
    return tidy(Q.qc_report(manifest, Q.volume_stats(damaged(spark, sf)), SMALL), 6)


# ---------------------------------------------------------------- headers
GEOM = """(SELECT folder, series_uid, count(*) AS n_files, count(DISTINCT (n_rows,n_cols))>1 AS mixed, min(gap) AS lo, max(gap) AS hi, median(gap) AS med, first(n_rows ORDER BY file) AS n_rows, first(n_cols ORDER BY file) AS n_cols,
   abs(max(pz)-min(pz))/(count(*)-1) AS dz, (max(shear)-min(shear))/(count(*)-1) AS dy, first(manufacturer ORDER BY file) AS manufacturer, first(kernel ORDER BY file) AS kernel, first(patient_tag ORDER BY file) AS patient_tag
  FROM (SELECT *, pz - lag(pz) OVER (PARTITION BY folder, series_uid ORDER BY pz, file) AS gap FROM headers) GROUP BY 1,2)"""
PROBLEM = "CASE WHEN mixed THEN 'slices in one series have different Rows/Columns' WHEN lo<1e-3 THEN 'duplicate slice positions in this series' END"
GEOM_COLS = f"folder, series_uid, n_files, n_rows::BIGINT AS n_rows, n_cols::BIGINT AS n_cols, {r(f'CASE WHEN {PROBLEM} IS NULL THEN med END', 'z_spacing')}, CASE WHEN {PROBLEM} IS NULL THEN hi-lo<0.1::DOUBLE*med END AS z_uniform, {r(f'CASE WHEN {PROBLEM} IS NULL THEN degrees(acos(least(dz/sqrt(dz*dz+dy*dy),1.0))) END', 'tilt_deg', 5)}, {PROBLEM} AS geometry_problem"


@reg.add("px9_slice_geometry", f"SELECT {GEOM_COLS} FROM {GEOM}")
def _(spark, sf):
    g = tidy(Hd.slice_geometry(X.headers(spark, sf)).drop("row_spacing", "col_spacing"))
    return g.withColumn("tilt_deg", F.round("tilt_deg", 5))


SUMMARY = f"SELECT {GEOM_COLS}, count(*) OVER (PARTITION BY folder) AS n_series, manufacturer, kernel, patient_tag<>'' AS patient_id_present, CASE WHEN patient_tag='' THEN '' ELSE substr(sha256(patient_tag),1,12) END AS patient_id_hash FROM {GEOM}"


@reg.add("px10_header_summary", SUMMARY)
def _(spark, sf):
    g = tidy(Hd.header_summary(X.headers(spark, sf)).drop("row_spacing", "col_spacing"))
    return g.withColumn("tilt_deg", F.round("tilt_deg", 5))


@reg.add("px11_slice_rescale", "SELECT v.volume_id, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, hu*slope+intercept AS hu FROM voxels v JOIN (SELECT DISTINCT series_uid, (9-replace(replace(file,'img',''),'.dcm','')::INT) AS s, slope, intercept FROM headers) h ON h.series_uid=v.volume_id AND h.s=v.z")
def _(spark, sf):
    h = X.headers(spark, sf).select(F.col("series_uid").alias("volume_id"), (9 - F.regexp_extract("file", r"(\d+)", 1).cast("int")).alias("z"), "slope", "intercept")
    return voxels(G.rescale_slices(px(spark, sf).join(h, ["volume_id", "z"])))


@reg.add("px11_rescale_varies", "SELECT series_uid AS volume_id, count(DISTINCT (slope,intercept))>1 AS rescale_varies FROM headers GROUP BY 1")
def _(spark, sf):
    return G.rescale_varies(X.headers(spark, sf).withColumnRenamed("series_uid", "volume_id"))


def _scans(spark, sf):
    series = X.headers(spark, sf).select(F.concat_ws("/", "folder", "file").alias("path"), "series_uid", F.lit(1).cast("bigint").alias("length"))
    return SR.discover_scans(series.unionByName(X.files(spark, sf).select("path", F.lit(None).cast("string").alias("series_uid"), "length")))


@reg.add("px12_folder_manifest", f"""WITH s AS ({SUMMARY}) SELECT folder||'_s'||right(series_uid,8) AS volume_id, folder AS patient_id, folder AS scan_path, 'dicom' AS format, n_files, series_uid, manufacturer, kernel, geometry_problem AS manifest_problem FROM s
  UNION ALL SELECT DISTINCT array_to_string(list_transform(list_filter(string_split(regexp_replace(path,'\\.nii(\\.gz)?$','','i'),'/'),lambda p: p<>''),lambda p: regexp_replace(p,'[^A-Za-z0-9._-]','-','g')),'_'), string_split(path,'/')[1], path, 'nifti', 1, NULL, NULL, NULL, NULL FROM files WHERE path LIKE '%.nii.gz'""")
def _(spark, sf):
    return Hd.folder_manifest(_scans(spark, sf), Hd.header_summary(X.headers(spark, sf))).drop("n_rows", "n_cols")


@reg.add("cu20_patient_id_source", "SELECT count(*) FILTER (t<>'') AS present, count(DISTINCT CASE WHEN t<>'' THEN t END) AS distinct_ids, count(*) AS scans, CASE WHEN count(*) FILTER (t<>'')=count(*) AND count(DISTINCT t)=count(*) THEN 'dicom_tag' ELSE 'path' END AS patient_id_source FROM (SELECT series_uid, first(patient_tag ORDER BY file) AS t FROM headers GROUP BY 1)")
def _(spark, sf):
    return Hd.patient_id_source(Hd.header_summary(X.headers(spark, sf)))


@reg.add("cu20_patient_id_source_tagged", "SELECT count(*) AS present, count(DISTINCT series_uid) AS distinct_ids, count(*) AS scans, 'dicom_tag' AS patient_id_source FROM (SELECT DISTINCT series_uid FROM headers WHERE patient_tag<>'')")
def _(spark, sf):
    return Hd.patient_id_source(Hd.header_summary(X.headers(spark, sf).filter("patient_tag <> ''")))


@reg.add("cu21_duplicate_ids", "SELECT folder AS volume_id, count(DISTINCT series_uid) AS n FROM headers GROUP BY 1 HAVING count(DISTINCT series_uid)>1")
def _(spark, sf):
    return Hd.duplicate_ids(X.headers(spark, sf).select(F.col("folder").alias("volume_id"), "series_uid").distinct())


@reg.add("wn3_slice_gaps", f"SELECT series_uid, file, {r('pz', 'proj')}, {r('pz - lag(pz) OVER (PARTITION BY folder, series_uid ORDER BY pz, file)', 'gap')} FROM headers")
def _(spark, sf):
    return tidy(Hd.slice_gaps(X.headers(spark, sf)).select("series_uid", "file", "proj", "gap"))


# ---------------------------------------------------------------- grid
def box_sql(thr, margin, source="voxels"):
    parts = ", ".join(f"coalesce(greatest(min({a}) FILTER (hu>{thr})-{margin},0),0)::BIGINT AS {a}0, coalesce(least(max({a}) FILTER (hu>{thr})+1+{margin},max({a})+1),max({a})+1)::BIGINT AS {a}1" for a in "zyx")
    return f"(SELECT volume_id, {parts} FROM {source} GROUP BY 1)"


@reg.add("px13_foreground_box", f"SELECT * FROM {box_sql(600, 1)}")
def _(spark, sf):
    return tidy(G.foreground_box(px(spark, sf), 600.0, 1))


@reg.add("px14_crop", f"SELECT v.volume_id, z-z0 AS z, y-y0 AS y, x-x0 AS x, hu FROM voxels v JOIN {box_sql(600, 0)} b ON v.volume_id=b.volume_id AND z>=z0 AND z<z1 AND y>=y0 AND y<y1 AND x>=x0 AND x<x1")
def _(spark, sf):
    s = px(spark, sf)
    return voxels(G.crop(s, G.foreground_box(s, 600.0, 0)))


@reg.add("px14_crop_shape", f"SELECT volume_id, (z1-z0)||'x'||(y1-y0)||'x'||(x1-x0) AS crop_shape FROM {box_sql(600, 1)}")
def _(spark, sf):
    return G.crop_shape(G.foreground_box(px(spark, sf), 600.0, 1))


def axis_sql(source: str, axis: str, n_out: str, n_in: str, sizes: str = "sizes") -> str:
    """One corner-aligned linear pass along an axis of a voxel table."""
    others = [a for a in "zyx" if a != axis]
    return f"""(SELECT a.volume_id, {', '.join('a.' + o for o in others)}, t.j AS {axis}, CASE WHEN t.f=0 THEN a.hu ELSE (1-t.f)*a.hu+t.f*b.hu END AS hu
      FROM (SELECT volume_id, j, floor(pos)::INT AS lo, pos-floor(pos) AS f FROM (SELECT volume_id, j, j*({n_in}-1)::DOUBLE/greatest({n_out}-1,1) AS pos FROM (SELECT *, unnest(range({n_out})) AS j FROM {sizes}))) t
      JOIN {source} a ON a.volume_id=t.volume_id AND a.{axis}=t.lo LEFT JOIN {source} b ON b.volume_id=t.volume_id AND b.{axis}=t.lo+1 AND {' AND '.join(f'b.{o}=a.{o}' for o in others)})"""


def spacing(spark, sf):
    v = F.col("volume_id").cast("int")
    return px(spark, sf).select("volume_id").distinct().select("volume_id", F.when(v % 4 == 0, 1.5).when(v % 4 == 1, 2.0).when(v % 4 == 2, 1.52).otherwise(0.9).alias("spacing_z_mm"),
                                                               F.when(v % 4 == 0, 0.74).otherwise(0.6).alias("spacing_y_mm"), F.when(v % 4 == 0, 0.75).otherwise(0.9).alias("spacing_x_mm"))


SIZES = f"""SELECT volume_id, sz/(oz/10.0::DOUBLE) AS spz, sy/(oy/8.0::DOUBLE) AS spy, sx/(ox/8.0::DOUBLE) AS spx, oz, oy, ox FROM (SELECT *, CASE WHEN close THEN 10 ELSE greatest(round_even(10*(sz/1.5::DOUBLE),0),1)::INT END AS oz,
   CASE WHEN close THEN 8 ELSE greatest(round_even(8*(sy/0.75::DOUBLE),0),1)::INT END AS oy, CASE WHEN close THEN 8 ELSE greatest(round_even(8*(sx/0.75::DOUBLE),0),1)::INT END AS ox
  FROM (SELECT *, abs(sz/1.5::DOUBLE-1)<0.05 AND abs(sy/0.75::DOUBLE-1)<0.05 AND abs(sx/0.75::DOUBLE-1)<0.05 AS close FROM (SELECT volume_id, CASE {V}%4 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 2.0 WHEN 2 THEN 1.52 ELSE 0.9 END AS sz,
    CASE {V}%4 WHEN 0 THEN 0.74::DOUBLE ELSE 0.6 END AS sy, CASE {V}%4 WHEN 0 THEN 0.75::DOUBLE ELSE 0.9 END AS sx FROM (SELECT DISTINCT volume_id FROM voxels))))"""


@reg.add("px15_resample_plan", f"WITH sizes AS ({SIZES}) SELECT volume_id, 10::BIGINT AS n_z, 8::BIGINT AS n_y, 8::BIGINT AS n_x, oz::BIGINT AS new_z, oy::BIGINT AS new_y, ox::BIGINT AS new_x, {r('spz', 'spacing_z_mm')}, {r('spy', 'spacing_y_mm')}, {r('spx', 'spacing_x_mm')} FROM sizes")
def _(spark, sf):
    return tidy(G.resample_plan(px(spark, sf), spacing(spark, sf)))


@reg.add("px15_resample", f"WITH sizes AS ({SIZES}) SELECT volume_id, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, {r('hu', 'hu', 6)} FROM {axis_sql(axis_sql(axis_sql('voxels', 'y', 'oy', '8'), 'x', 'ox', '8'), 'z', 'oz', '10')}")
def _(spark, sf):
    s = px(spark, sf)
    return tidy(voxels(G.resample(s, G.resample_plan(s, spacing(spark, sf)))), 6)


@reg.add("px16_resize_stretch", f"WITH sizes AS (SELECT DISTINCT volume_id FROM voxels) SELECT volume_id, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, {r('hu', 'hu', 6)} FROM {axis_sql(axis_sql('voxels', 'y', '5', '8'), 'x', '11', '8')}")
def _(spark, sf):
    return tidy(voxels(G.resize(px(spark, sf), (5, 11))), 6)


@reg.add("px16_resize_pad", f"""WITH sizes AS (SELECT volume_id, min(hu) AS fill FROM voxels GROUP BY 1), inner_px AS {axis_sql(axis_sql('voxels', 'y', '6', '8'), 'x', '6', '8')}
  SELECT g.volume_id, g.z::BIGINT AS z, g.y::BIGINT AS y, g.x::BIGINT AS x, {r('coalesce(i.hu,g.fill)', 'hu', 6)} FROM (SELECT volume_id, fill, z, y, x FROM sizes, (SELECT unnest(range(10)) AS z), (SELECT unnest(range(6)) AS y), (SELECT unnest(range(9)) AS x)) g
  LEFT JOIN inner_px i ON i.volume_id=g.volume_id AND i.z=g.z AND i.y=g.y AND i.x+1=g.x""")
def _(spark, sf):
    return tidy(voxels(G.resize(px(spark, sf), (6, 9), "pad")), 6)


@reg.add("px17_round_half_even", "SELECT volume_id, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, round_even(hu/4.0::DOUBLE,0)::DOUBLE AS hu FROM voxels")
def _(spark, sf):
    quarter = px(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: v / 4.0))
    return tidy(voxels(G.to_int16(G.round_half_even(quarter))))


CHAIN = PP.Settings(target_spacing=(1.5, 0.75, 0.75), floor=-900.0, crop_threshold=400.0, crop_margin=1, target_size=(6, 6), uncalibrated_threshold=-600.0, thresholds=SMALL)


def chain_volumes(spark, sf):
    return spacing(spark, sf).join(rescale(spark, sf), "volume_id").withColumn("z_uniform", F.lit(True)).withColumn("tilt_deg", F.lit(0.0))


def chain_sql(source: str, columns: str) -> str:
    """The chain on a voxel table, stage by stage, and columns of its report."""
    return f"""WITH sizes AS MATERIALIZED ({SIZES}), source_px AS MATERIALIZED (SELECT volume_id, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, hu FROM {source}),
    raw_stats AS MATERIALIZED ({STATS.format("source_px")}),
    usable AS MATERIALIZED (SELECT p.* FROM source_px p JOIN raw_stats USING (volume_id) WHERE n_nonfinite=0),
    cal AS MATERIALIZED (SELECT *, NOT low<=-600 AND {V}%4>0 AS applied FROM (SELECT volume_id, quantile_cont(hu,0.005) AS low FROM usable GROUP BY 1)),
    level AS MATERIALIZED (SELECT volume_id, z, y, x, CASE WHEN applied THEN hu*2-500 ELSE hu END AS hu FROM usable JOIN cal USING (volume_id)),
    audit AS (SELECT volume_id, min(hu) AS hu_min_before, min(hu)<-900 AS floored FROM level GROUP BY 1),
    floor_px AS MATERIALIZED (SELECT volume_id, z, y, x, greatest(hu,-900) AS hu FROM level),
    even_y AS MATERIALIZED {axis_sql("floor_px", "y", "oy", "8")}, even_x AS MATERIALIZED {axis_sql("even_y", "x", "ox", "8")}, even AS MATERIALIZED {axis_sql("even_x", "z", "oz", "10")},
    box AS MATERIALIZED {box_sql(400, 1, "even")},
    inside AS MATERIALIZED (SELECT e.volume_id, z-z0 AS z, y-y0 AS y, x-x0 AS x, hu FROM even e JOIN box b ON e.volume_id=b.volume_id AND z>=z0 AND z<z1 AND y>=y0 AND y<y1 AND x>=x0 AND x<x1),
    sized_y AS MATERIALIZED {axis_sql("inside", "y", "6", "(y1-y0)", "box")}, sized AS MATERIALIZED {axis_sql("sized_y", "x", "6", "(x1-x0)", "box")},
    late AS MATERIALIZED (SELECT *, CASE WHEN hu_min < -32768 OR hu_max > 32767 THEN 'HU values '||hu_min::BIGINT||'..'||hu_max::BIGINT||' do not fit in int16 (-32768..32767) -- corrupt or mis-scaled data' END AS late_error
      FROM ({STATS.format("(SELECT volume_id, z, y, x, round_even(hu,0) AS hu FROM sized)")})),
    checked AS (SELECT l.*, spz, spy, spx, list_filter([CASE WHEN n_slices<5 OR n_slices>12 THEN 'slice count '||n_slices||' outside [5, 12]' END,
        CASE WHEN hu_min>-500 THEN 'HU minimum too high ('||hu_min::BIGINT||') -- looks uncalibrated (raw values, not true HU)' END, CASE WHEN hu_std<1 THEN 'near-constant volume (std='||printf('%.3f',hu_std)||')' END], lambda t: t IS NOT NULL) AS reasons,
        CASE WHEN spz>3 OR spz<0.3 THEN 'unusual z-spacing: '||printf('%.2f',spz)||' mm' ELSE '' END AS flags FROM late l JOIN sizes USING (volume_id) WHERE late_error IS NULL),
    report AS (SELECT w.volume_id, coalesce(CASE WHEN w.n_nonfinite>0 THEN 'contains NaN or infinite values' END, l.late_error) AS error, c.n_slices, c.hu_min, c.hu_max, c.hu_mean, c.hu_std, spz AS spacing_z_mm, spy AS spacing_y_mm,
        spx AS spacing_x_mm, array_to_string(reasons,'; ') AS reasons, flags, len(reasons)=0 AS passed, (z1-z0)||'x'||(y1-y0)||'x'||(x1-x0) AS crop_shape, applied, low AS p_low_before, hu_min_before, floored
      FROM raw_stats w LEFT JOIN late l ON l.volume_id=w.volume_id LEFT JOIN checked c ON c.volume_id=w.volume_id LEFT JOIN box b ON b.volume_id=w.volume_id
        LEFT JOIN cal k ON k.volume_id=w.volume_id LEFT JOIN audit a ON a.volume_id=w.volume_id)
    SELECT {columns} FROM report"""


@reg.add("px18_preprocess_chain", chain_sql(DAMAGED, "volume_id, error, n_slices, reasons, flags, passed, crop_shape, applied, floored, " + ", ".join(
    r(c, c, 6) for c in ("hu_min", "hu_max", "hu_mean", "hu_std", "spacing_z_mm", "spacing_y_mm", "spacing_x_mm", "p_low_before", "hu_min_before"))))
def _(spark, sf):
    report = PP.preprocess(damaged(spark, sf), chain_volumes(spark, sf), CHAIN, staged)["report"]
    return tidy(report.withColumn("reasons", F.array_join("reasons", "; ")).withColumn("flags", F.array_join("flags", "; ")), 6)


@reg.add("px19_inference_batch", chain_sql("voxels", "volume_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN passed THEN 'ready' ELSE 'rejected' END AS status, crop_shape, CASE WHEN error IS NULL AND passed THEN n_slices END AS ready_slices"))
def _(spark, sf):
    parts = PP.infer(px(spark, sf), chain_volumes(spark, sf), CHAIN, fingerprint="abc", cache_fingerprint="abc", stage=staged)
    n = parts["slices"].groupBy("volume_id").agg(F.count(F.lit(1)).alias("ready_slices"))
    return parts["report"].join(n, "volume_id", "left").select("volume_id", "status", "crop_shape", "ready_slices")


LAP = """(SELECT volume_id, z, y, x, hu, 4*hu - lag(hu) OVER wx - lead(hu) OVER wx - lag(hu) OVER wy - lead(hu) OVER wy AS lap FROM voxels WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y))"""


@reg.add("wn11_laplacian", f"SELECT volume_id, z::BIGINT AS z, (y-1)*6+x-1 AS k, hu AS center, lap FROM {LAP} WHERE lap IS NOT NULL")
def _(spark, sf):
    s = px(spark, sf).select("volume_id", F.col("z").cast("bigint").alias("z"), F.posexplode(P.inner_laplacian(F.col("pixels"), F.col("h"), F.col("w"))).alias("k", "c"))
    return s.select("volume_id", "z", F.col("k").cast("bigint").alias("k"), "c.center", "c.lap")


SHARP = f"(SELECT volume_id, coalesce(avg(CASE WHEN hu>-200 AND hu<300 THEN abs(lap) END),0) AS score FROM {LAP} WHERE lap IS NOT NULL AND z>=2 AND z<8 GROUP BY 1)"


@reg.add("px20_sharpness", f"SELECT volume_id, {rs('score')} FROM {SHARP}")
def _(spark, sf):
    return tidy(G.sharpness(px(spark, sf), -200, 300))


PAIRS = f"""(SELECT a.volume_id::INT//2 AS pair, 'm'||(a.volume_id::INT//2%2) AS manufacturer, 'Brand'||(a.volume_id::INT%7+1) AS ka, 'Brand'||(b.volume_id::INT%7+1) AS kb, a.score AS sa, b.score AS sb FROM {SHARP} a JOIN {SHARP} b ON a.volume_id::INT%2=0 AND b.volume_id::INT=a.volume_id::INT+1)"""


@reg.add("ag17_survey_verdict", f"""WITH w AS (SELECT manufacturer, kernel, count(*) AS pairs, sum(win)::BIGINT AS sharper, round(sum(win)/count(*),2) AS share FROM (SELECT manufacturer, ka AS kernel, (sa>sb)::BIGINT AS win FROM {PAIRS} WHERE ka<>kb UNION ALL SELECT manufacturer, kb, (sa<=sb)::BIGINT FROM {PAIRS} WHERE ka<>kb) GROUP BY 1,2)
  SELECT manufacturer, kernel, pairs, sharper, share AS share_sharper, tc AS table_class, CASE WHEN tc='other' OR me='unclear' THEN 'check ('||me||')' WHEN me=tc THEN 'ok' ELSE 'DISAGREES (measured '||me||')' END AS verdict FROM
  (SELECT *, CASE WHEN share>=0.8 THEN 'sharp' WHEN share<=0.2 THEN 'soft' ELSE 'unclear' END AS me, CASE kernel WHEN 'Brand1' THEN 'sharp' WHEN 'Brand2' THEN 'soft' WHEN 'Brand3' THEN 'sharp' ELSE 'other' END AS tc FROM w)""")
def _(spark, sf):
    v = F.col("volume_id").cast("int")
    scores = G.sharpness(px(spark, sf), -200, 300)
    worklist = scores.select("volume_id", F.floor(v / 2).cast("string").alias("patient_id"), F.lit("a").alias("scan_id"), (v % 2 + 1).cast("bigint").alias("reconstruction_id"),
                             F.concat(F.lit("m"), (F.floor(v / 2) % 2).cast("string")).alias("manufacturer"), F.concat(F.lit("Brand"), (v % 7 + 1).cast("string")).alias("kernel"))
    table = worklist.select("manufacturer", "kernel").distinct().select("manufacturer", "kernel", F.when(F.col("kernel").isin("Brand1", "Brand3"), "sharp").when(F.col("kernel") == "Brand2", "soft").otherwise("other").alias("class"))
    return tidy(K.survey_verdict(K.survey_pairs(worklist, scores), table))


@reg.add("px21_slice_profile", f"SELECT volume_id, z::BIGINT AS z, {r('avg(hu)', 'mean_hu')} FROM voxels GROUP BY 1,2")
def _(spark, sf):
    return tidy(G.slice_profile(px(spark, sf)))


def blur_sql(sigma: str, final: str) -> str:
    """Two weighted passes over reflected neighbours; ``sigma`` may depend on the volume."""
    refl = "CASE WHEN abs({0})>7 THEN 14-abs({0}) ELSE abs({0}) END"
    return f"""WITH s AS (SELECT DISTINCT volume_id, {sigma} AS sigma FROM voxels), t0 AS (SELECT *, unnest(range(-greatest(ceil(sigma*3),1)::INT, greatest(ceil(sigma*3),1)::INT+1)) AS k FROM s),
      taps AS (SELECT volume_id, k, exp(-0.5*(k/sigma)*(k/sigma))/sum(exp(-0.5*(k/sigma)*(k/sigma))) OVER (PARTITION BY volume_id) AS g FROM t0),
      py AS (SELECT v.volume_id, z, q.y, v.x, sum(g*hu) AS hu FROM (SELECT unnest(range(8)) AS y) q JOIN taps t ON true JOIN voxels v ON v.volume_id=t.volume_id AND v.y={refl.format('(q.y+t.k)')} GROUP BY 1,2,3,4),
      pxx AS (SELECT v.volume_id, z, v.y, q.x, sum(g*hu) AS hu FROM (SELECT unnest(range(8)) AS x) q JOIN taps t ON true JOIN py v ON v.volume_id=t.volume_id AND v.x={refl.format('(q.x+t.k)')} GROUP BY 1,2,3,4)
      {final}"""


U = "(('0x'||substr(md5('4:'||volume_id),1,8))::BIGINT::DOUBLE/4294967296.0::DOUBLE)"


@reg.add("px23_blur", blur_sql(f"0.5::DOUBLE+{U}*0.8::DOUBLE", f"SELECT volume_id, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, {r('hu', 'hu', 6)} FROM pxx"))
def _(spark, sf):
    return tidy(voxels(G.kernel_augment(px(spark, sf), "blur", 0.5, 1.3, 4)), 6)


@reg.add("px23_sharpen", blur_sql("1.0::DOUBLE", f"SELECT v.volume_id, v.z::BIGINT AS z, v.y::BIGINT AS y, v.x::BIGINT AS x, {r(f'v.hu+(0.5::DOUBLE+{U}*0.5::DOUBLE)*(v.hu-b.hu)'.replace('volume_id', 'v.volume_id'), 'hu', 6)} FROM voxels v JOIN pxx b ON b.volume_id=v.volume_id AND b.z=v.z AND b.y=v.y AND b.x=v.x"))
def _(spark, sf):
    return tidy(voxels(G.kernel_augment(px(spark, sf), "sharpen", 0.5, 1.0, 4)), 6)


@reg.add("j17_align_offset", """WITH a AS (SELECT volume_id, z, avg(hu) AS v FROM voxels GROUP BY 1,2), b AS (SELECT volume_id, z-volume_id::INT%3 AS z, v FROM a WHERE z>=volume_id::INT%3),
  na AS (SELECT volume_id, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT volume_id, count(*) AS nb FROM b GROUP BY 1),
  e AS (SELECT a.volume_id, o, count(*) AS n, avg(abs(a.v-b.v)) AS err FROM a, (SELECT unnest([-2,-1,0,1,2]) AS o) q, b WHERE b.volume_id=a.volume_id AND b.z=a.z+o GROUP BY 1,2),
  best AS (SELECT e.volume_id, arg_min(o,(round(err,9),o)) AS o FROM e JOIN na USING (volume_id) JOIN nb USING (volume_id) WHERE abs(na-nb)<=2 AND n>=greatest(8,least(na,nb)//2) GROUP BY 1)
  SELECT na.volume_id AS pair, coalesce(o,0)::BIGINT AS offset, o IS NOT NULL AS aligned FROM na LEFT JOIN best USING (volume_id)""")
def _(spark, sf):
    a = G.slice_profile(px(spark, sf)).select(F.col("volume_id").alias("pair"), F.col("z").alias("i"), F.col("mean_hu").alias("v"))
    shift = F.col("pair").cast("int") % 3
    return G.align_offset(a, a.filter(F.col("i") >= shift).withColumn("i", F.col("i") - shift), 2)
