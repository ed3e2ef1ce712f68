"""The fixture views as SQL over the given tables (same rows as ``fixtures.py``)."""


def h(text: str) -> str:
    """Uniform number in [0, 1) from md5 of a text expression."""
    return f"(('0x'||substr(md5({text}),1,8))::BIGINT::DOUBLE/4294967296.0::DOUBLE)"


def _prob(label: str, tag: str) -> str:
    return (f"round(0.35::DOUBLE*coalesce(l.{label}::DOUBLE,0.5::DOUBLE)"
            f"+0.65::DOUBLE*{h(f'{tag!r}||d.doc_id')},3)")


VIEWS_SQL = {
    "volumes": """
      SELECT CASE WHEN (o.o_custkey % 8 = 0) <> (l.l_orderkey % 89 = 0) THEN 'valid' ELSE 'train' END AS pool,
        (CASE WHEN o.o_custkey % 8 = 0 THEN 'valid' ELSE 'train' END) || '_' || o.o_custkey || '_' ||
          translate(l.l_orderkey::VARCHAR,'0123456789','abcdefghij') || '_' || l.l_linenumber ||
          (CASE WHEN l.l_orderkey % 97 = 0 THEN 'x' ELSE '' END) || '.nii.gz' AS "VolumeName",
        p.p_type AS "Manufacturer", '[''' || replace(p.p_brand,'#','') || ''', ''3'']' AS "ConvolutionKernel",
        p.p_name AS "SeriesDescription", l.l_quantity::BIGINT AS "NumberofSlices", 512 AS "Rows", 512 AS "Columns",
        '[0.9, 0.9]' AS "XYSpacing", 0.5::DOUBLE + 10.0::DOUBLE*l.l_discount AS "ZSpacing"
      FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON l.l_partkey=p.p_partkey""",
    "kernel_table": """
      SELECT p_type AS manufacturer, replace(p_brand,'#','') AS kernel,
        CASE WHEN regexp_extract(p_brand,'(\\d+)',1)::INT % 3 = 0 THEN 'sharp' ELSE 'soft' END AS class
      FROM part WHERE regexp_extract(p_brand,'(\\d+)',1)::INT % 3 < 2 GROUP BY ALL""",
    "catalog": """
      SELECT volume_id, pool, min(m) AS m, regexp_extract(volume_id,'^(train|valid)_(\\d+)_([a-z]+)_(\\d+)$',1) || '_' ||
          regexp_extract(volume_id,'^(train|valid)_(\\d+)_([a-z]+)_(\\d+)$',2) AS patient_id,
        regexp_extract(volume_id,'^(train|valid)_(\\d+)_([a-z]+)_(\\d+)$',3) AS scan_id,
        regexp_extract(volume_id,'^(train|valid)_(\\d+)_([a-z]+)_(\\d+)$',4)::BIGINT AS reconstruction_id,
        pool AS source_split, min(m).manufacturer AS manufacturer, min(m).kernel AS kernel,
        coalesce(any_value(k.class),'other') AS kernel_class
      FROM (SELECT volume_id, pool, min({'manufacturer': "Manufacturer", 'kernel': regexp_extract("ConvolutionKernel",'([A-Za-z0-9_.+-]+)',1)}) AS m
            FROM (SELECT *, regexp_replace("VolumeName",'\\.nii(\\.gz)?$','') AS volume_id FROM volumes)
            WHERE regexp_matches(volume_id,'^(train|valid)_(\\d+)_([a-z]+)_(\\d+)$') AND split_part(volume_id,'_',1)=pool
            GROUP BY 1,2) v
      LEFT JOIN kernel_table k ON lower(trim(v.m.manufacturer))=lower(trim(k.manufacturer)) AND lower(v.m.kernel)=lower(k.kernel)
      GROUP BY 1,2""",
    "qc_rows": f"""
      SELECT volume_id, {h("'qc:'||volume_id")} >= 0.05 AS passed FROM (SELECT DISTINCT volume_id FROM catalog)
      WHERE {h("'qc:'||volume_id")} < 0.98""",
    "existing_splits": """
      SELECT 'train_' || c_custkey AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'val' ELSE 'test' END AS split
      FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 8 <> 0""",
    "findings": """
      SELECT d.doc_id::VARCHAR AS volume_id, d.source AS manufacturer, d.lang AS kernel_class, d.n_chars AS n_slices,
        (d.doc_id // 4)::VARCHAR AS patient_id, (d.doc_id // 2)::VARCHAR AS scan_id,
        CASE d.doc_id // 4 % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split,
        l.quality::DOUBLE AS label_quality, l.toxic::DOUBLE AS label_toxic
      FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""",
    "findings_long": """
      SELECT volume_id, manufacturer, kernel_class, split, 'quality' AS label, label_quality AS y FROM findings
      UNION ALL SELECT volume_id, manufacturer, kernel_class, split, 'toxic', label_toxic FROM findings""",
    "predictions": f"""
      SELECT d.doc_id::VARCHAR AS volume_id, (d.doc_id // 4)::VARCHAR AS patient_id, (d.doc_id // 2)::VARCHAR AS scan_id,
        CASE WHEN d.doc_id // 4 % 3 = 0 THEN 'val' ELSE 'test' END AS split,
        CASE WHEN d.doc_id % 2 = 0 THEN 'sharp' ELSE 'soft' END AS kernel_class, d.source AS manufacturer,
        {_prob('quality', 'q:')} AS prob_quality, {_prob('toxic', 't:')} AS prob_toxic,
        l.quality::DOUBLE AS true_quality, l.toxic::DOUBLE AS true_toxic
      FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""",
    "preds_long": """
      SELECT volume_id, patient_id, scan_id, split, kernel_class, manufacturer, 'quality' AS label, prob_quality AS p, true_quality AS y FROM predictions
      UNION ALL SELECT volume_id, patient_id, scan_id, split, kernel_class, manufacturer, 'toxic', prob_toxic, true_toxic FROM predictions""",
    "val_long": "SELECT * FROM preds_long WHERE split='val'",
    "test_long": "SELECT * FROM preds_long WHERE split='test'",
    "test_grouped": """
      SELECT 'all' AS group_by, 'all' AS "group", * FROM test_long
      UNION ALL SELECT 'kernel_class', coalesce(kernel_class,'unknown'), * FROM test_long
      UNION ALL SELECT 'manufacturer', coalesce(manufacturer,'unknown'), * FROM test_long""",
    "val_known": """
      SELECT *, sum(y) OVER (PARTITION BY label) AS n_pos, count(*) OVER (PARTITION BY label) AS n FROM val_long WHERE y IS NOT NULL""",
    "val_points": """
      SELECT label,
        min(CASE WHEN y=0 AND neg_le >= greatest(ceil(0.95::DOUBLE*(n-n_pos)-1e-9),1) THEN p END) AS spec_p,
        max(CASE WHEN y=1 AND pos_ge >= greatest(ceil(0.9::DOUBLE*n_pos-1e-9),1) THEN p END) AS sens_p,
        min(CASE WHEN y=0 AND neg_le >= greatest(ceil(0.9::DOUBLE*(n-n_pos)-1e-9),1) THEN p END) AS spec90_p,
        max({'f1': 2*pos_ge/(n_ge+n_pos), 'm': -p}).m * -1 AS f1_p
      FROM (SELECT *, sum(CASE WHEN y=0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY p RANGE UNBOUNDED PRECEDING) AS neg_le,
              sum(y) OVER (PARTITION BY label ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS pos_ge,
              count(*) OVER (PARTITION BY label ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS n_ge FROM val_known)
      WHERE n_pos > 0 AND n_pos < n GROUP BY label""",
    "op_points": """
      SELECT l.label, CASE WHEN spec_p IS NOT NULL THEN nextafter(spec_p,'inf'::DOUBLE) END AS report,
        CASE WHEN sens_p IS NOT NULL THEN least(sens_p, nextafter(spec_p,'inf'::DOUBLE)) END AS ruleout, f1_p AS max_f1,
        CASE WHEN spec90_p IS NOT NULL THEN nextafter(spec90_p,'inf'::DOUBLE) END AS spec90,
        CASE WHEN spec_p IS NOT NULL THEN nextafter(spec_p,'inf'::DOUBLE) END AS spec95
      FROM (SELECT DISTINCT label FROM val_known) l LEFT JOIN val_points v ON l.label=v.label""",
    "scored": """
      SELECT t.*, o.report, o.ruleout, o.max_f1, o.spec90, o.spec95,
        CASE WHEN p < o.ruleout THEN 'absent' WHEN p >= o.report THEN 'present' ELSE 'uncertain' END AS state,
        coalesce(p >= o.max_f1, false) AS flag_f1
      FROM test_long t JOIN op_points o ON t.label=o.label""",
    "scored_grouped": """
      SELECT 'all' AS group_by, 'all' AS "group", * FROM scored
      UNION ALL SELECT 'kernel_class', coalesce(kernel_class,'unknown'), * FROM scored
      UNION ALL SELECT 'manufacturer', coalesce(manufacturer,'unknown'), * FROM scored""",
    "scans": """
      SELECT volume_id, patient_id, scan_id, kernel_class, manufacturer, count(y) AS n_known, count(*) FILTER (y=1) AS n_true,
        count(*) FILTER (y IS NOT NULL AND state='present') AS report_pred, count(*) FILTER (y=1 AND state='present') AS report_tp,
        count(*) FILTER (y=0 AND state='present') AS report_fp, count(*) FILTER (y=1 AND state<>'present') AS report_fn,
        bool_and(y IS NULL OR (state='present')=(y=1)) AS report_exact,
        count(*) FILTER (y IS NOT NULL AND flag_f1) AS maxf1_pred, count(*) FILTER (y=1 AND flag_f1) AS maxf1_tp,
        count(*) FILTER (y=0 AND flag_f1) AS maxf1_fp, count(*) FILTER (y=1 AND NOT flag_f1) AS maxf1_fn,
        bool_and(y IS NULL OR flag_f1=(y=1)) AS maxf1_exact,
        count(*) FILTER (y IS NOT NULL AND state='uncertain') AS n_uncertain
      FROM scored GROUP BY ALL""",
    "pair_rows": """
      SELECT s.patient_id||'/'||s.scan_id AS scan, min(CASE WHEN kernel_class='sharp' THEN volume_id END) AS sharp_volume,
        min(CASE WHEN kernel_class='soft' THEN volume_id END) AS soft_volume
      FROM predictions s WHERE split='test' AND scan_id IS NOT NULL GROUP BY 1
      HAVING sharp_volume IS NOT NULL AND soft_volume IS NOT NULL""",
    "pair_scored": """
      SELECT r.scan, r.sharp_volume, r.soft_volume, a.label, a.p AS p_sharp, b.p AS p_soft, a.state AS s_sharp, b.state AS s_soft,
        a.flag_f1 AS f_sharp, b.flag_f1 AS f_soft
      FROM pair_rows r JOIN scored a ON a.volume_id=r.sharp_volume JOIN scored b ON b.volume_id=r.soft_volume AND a.label=b.label""",
    "auc_rows": """
      SELECT group_by, "group", label, y, p, (rank() OVER w) + (count(*) OVER (PARTITION BY group_by,"group",label,p) - 1)/2.0::DOUBLE AS r
      FROM test_grouped WHERE y IS NOT NULL WINDOW w AS (PARTITION BY group_by,"group",label ORDER BY p)""",
    "label_auc": """
      SELECT group_by, "group", label, count(*) AS n, sum(y)::BIGINT AS n_pos,
        (sum(r*y)-sum(y)*(sum(y)+1)/2)/nullif(sum(y)*(count(*)-sum(y)),0) AS auroc FROM auc_rows GROUP BY ALL""",
    "label_ap": """
      SELECT group_by, "group", label, CASE WHEN any_value(tp) > 0 AND any_value(tp) < any_value(tn) THEN sum(pos/tp * (pos_ge/n_ge)) END AS auprc
      FROM (SELECT *, sum(pos) OVER w AS pos_ge, sum(k) OVER w AS n_ge, sum(pos) OVER g AS tp, sum(k) OVER g AS tn
            FROM (SELECT group_by, "group", label, p, count(*)::DOUBLE AS k, sum(y) AS pos FROM test_grouped WHERE y IS NOT NULL GROUP BY ALL)
            WINDOW w AS (PARTITION BY group_by,"group",label ORDER BY p DESC), g AS (PARTITION BY group_by,"group",label))
      GROUP BY ALL""",
    "ensemble": f"""
      SELECT m.member, volume_id, patient_id, scan_id, split, kernel_class, manufacturer,
        round(0.35::DOUBLE*coalesce(true_quality,0.5::DOUBLE)+0.65::DOUBLE*{h("'q'||m.member||':'||volume_id")},3) AS prob_quality,
        round(0.35::DOUBLE*coalesce(true_toxic,0.5::DOUBLE)+0.65::DOUBLE*{h("'t'||m.member||':'||volume_id")},3) AS prob_toxic,
        true_quality, true_toxic FROM predictions, (SELECT unnest([0,1,2]) AS member) m""",
    "slices": """
      SELECT (vec_id // 10)::VARCHAR AS volume_id, (vec_id % 10)::INT AS slice_idx, embedding::DOUBLE[] AS emb FROM embeddings""",
    "voxels": """
      SELECT volume_id, slice_idx AS z, (i // 8)::INT AS y, (i % 8)::INT AS x, round(2000.0::DOUBLE*emb[i+1]) AS hu
      FROM slices, (SELECT unnest(range(64)) AS i)""",
    "headers": """
      SELECT 'folder_' || (volume_id::INT // 2) AS folder, volume_id AS series_uid, 'img' || (9-slice_idx) || '.dcm' AS file,
        8 AS n_rows, CASE WHEN volume_id::INT % 13 = 0 AND slice_idx = 4 THEN 9 ELSE 8 END AS n_cols,
        0.0::DOUBLE AS px, 0.0::DOUBLE AS py,
        CASE WHEN volume_id::INT % 11 = 0 AND slice_idx = 5 THEN 1.5::DOUBLE*4 WHEN volume_id::INT % 7 = 0 AND slice_idx > 6 THEN 1.5::DOUBLE*(slice_idx+2)
          ELSE 1.5::DOUBLE*slice_idx END AS pz, CASE WHEN volume_id::INT % 17 = 0 THEN 0.2::DOUBLE*slice_idx ELSE 0.0 END AS shear,
        'maker_' || (volume_id::INT % 3) AS manufacturer, 'K' || (volume_id::INT % 5) AS kernel,
        CASE WHEN volume_id::INT % 19 = 0 THEN '' ELSE 'P' || volume_id END AS patient_tag,
        1.0::DOUBLE + (CASE WHEN volume_id::INT % 5 = 0 AND slice_idx = 3 THEN 1.0 ELSE 0.0 END) AS slope, -1024.0::DOUBLE AS intercept
      FROM slices""",
    "files": """
      SELECT regexp_replace(split_part(url,'?',1),'^[a-z]+://','') ||
          CASE WHEN page_id % 5 = 0 THEN '.nii.gz' WHEN page_id % 5 = 1 THEN '/s1.dcm' WHEN page_id % 5 = 2 THEN '/s2' WHEN page_id % 5 = 3 THEN '.tar.gz' ELSE '/.hidden/s3.dcm' END AS path,
        length(html) AS length, '1.2.' || (page_id % 7) AS series_uid FROM pages""",
    "chunk_log": """
      SELECT event_id, (event_id // 20)::VARCHAR AS chunk, 'vol_' || (event_id % 5000) AS volume_id, event_type='error' AS failed,
        CASE WHEN event_type='error' THEN 'RuntimeError: ' || props END AS error, event_type='click' AS cached, ts, value FROM events""",
    "curves": """
      SELECT 'run_' || user_id AS run_id, user_id % 10 AS config, user_id AS seed,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS val_loss,
        value + event_id % 7 AS train_loss, 1.0::DOUBLE/(1+event_id % 50) AS lr, 0.1::DOUBLE*(event_id % 30) AS seconds FROM events""",
}
