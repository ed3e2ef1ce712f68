"""Registered queries: experiment tables (experiment side of sections 2.1, 2.2, 2.5 to 2.7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from scanledger.functions import ids as I
from scanledger.operators import experiments as X2

from . import Registry, fixtures as X
from .common import r, rs, tidy

reg = Registry()
RUNS = "(SELECT run_id, config, seed, min(val_loss) AS best, avg(train_loss) AS avg_train, CASE WHEN seed%7=0 THEN NULL ELSE 'g'||(seed%3) END AS grp FROM curves GROUP BY 1,2,3)"


def curves(spark, sf):
    return X.curves(spark, sf)


def runs(spark, sf):
    return curves(spark, sf).groupBy("run_id", "config", "seed").agg(F.min("val_loss").alias("best"), F.avg("train_loss").alias("avg_train")).withColumn(
        "grp", F.when(F.col("seed") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("seed") % 3).cast("string"))))


@reg.add("ag12_mean_std", f"SELECT grp, config, count(*) AS seeds, {r('avg(best)', 'best')}, {r('stddev_samp(best)', 'best_std')}, {r('avg(avg_train)', 'avg_train')}, {r('stddev_samp(avg_train)', 'avg_train_std')} FROM {RUNS} GROUP BY 1,2")
def _(spark, sf):
    return tidy(X2.mean_std(runs(spark, sf), ["grp", "config"], ["best", "avg_train"]))


@reg.add("fn24_mean_std_text", f"SELECT config, seeds, CASE WHEN s IS NULL THEN printf('%.4f',m) ELSE printf('%.4f',m)||' ± '||printf('%.4f',s) END AS avg_train FROM (SELECT config, count(*) AS seeds, avg(avg_train) AS m, stddev_samp(avg_train) AS s FROM {RUNS} GROUP BY 1)")
def _(spark, sf):
    t = X2.mean_std(runs(spark, sf), ["config"], ["avg_train"])
    return X2.mean_std_texts(t, ["config"], ["avg_train"])


def settings(spark, sf):
    u = F.col("user_id")
    cfg = X.table(spark, sf, "events").select(u.alias("config")).distinct().withColumn("json", F.concat(
        F.lit('{"loss": "'), F.when(F.col("config") % 3 == 0, "asl").otherwise("bce"), F.lit('", "seed": '), F.col("config").cast("string"), F.lit(', "optim": {"lr": '),
        F.when(F.col("config") % 4 == 0, "0.01").otherwise("0.001"), F.lit(', "betas": [0.9, 0.99], "sched": {"warm": '), (F.col("config") % 2).cast("string"), F.lit('}}, "data_config": "/d/'), F.col("config").cast("string"), F.lit('", "encode_config": "/e/'), F.col("config").cast("string"), F.lit('", "fixed": true}')))
    return X2.flatten_settings(cfg, "config", "json")


CFG = "(SELECT DISTINCT user_id AS config FROM events)"
FLAT = f"""(SELECT config, 'loss' AS setting, CASE WHEN config%3=0 THEN 'asl' ELSE 'bce' END AS value FROM {CFG} UNION ALL SELECT config,'seed',config::VARCHAR FROM {CFG} UNION ALL SELECT config,'optim.lr',CASE WHEN config%4=0 THEN '0.01' ELSE '0.001' END FROM {CFG}
  UNION ALL SELECT config,'optim.betas','[0.9,0.99]' FROM {CFG} UNION ALL SELECT config,'optim.sched.warm',(config%2)::VARCHAR FROM {CFG} UNION ALL SELECT config,'fixed','true' FROM {CFG}
  UNION ALL SELECT config,'data_config','/d/'||config FROM {CFG} UNION ALL SELECT config,'encode_config','/e/'||config FROM {CFG})"""
VARY = f"(SELECT setting, count(*) AS n_values, arg_min(value, (-n, value)) AS common FROM (SELECT setting, value, count(*) AS n FROM {FLAT} WHERE setting NOT IN ('seed','data_config','encode_config') GROUP BY 1,2) GROUP BY 1 HAVING count(*)>1)"


@reg.add("fn18_flatten_settings", f"SELECT * FROM {FLAT}")
def _(spark, sf):
    return settings(spark, sf)


@reg.add("ag13_varying_settings", f"SELECT * FROM {VARY}")
def _(spark, sf):
    return X2.varying_settings(settings(spark, sf))


@reg.add("fn23_setup_labels", f"SELECT c.config, coalesce(s.setup,'reference') AS setup FROM {CFG} c LEFT JOIN (SELECT config, string_agg(regexp_extract(f.setting,'([^.]+)$',1)||'='||value, ', ' ORDER BY f.setting) AS setup FROM {FLAT} f JOIN {VARY} v ON f.setting=v.setting WHERE value<>common GROUP BY 1) s ON s.config=c.config")
def _(spark, sf):
    return X2.setup_labels(settings(spark, sf))


EVALS = "(SELECT event_id, 'run_'||user_id AS run_id, (['cohort','other'])[1+(event_id%2)::INT]||'__'||(['a','b'])[1+(event_id//2%2)::INT]||'__test' AS eval, (['all','kernel_class','kernel_class','manufacturer'])[1+(event_id//4%4)::INT] AS group_by, (['all','sharp','soft','maker 1'])[1+(event_id//4%4)::INT] AS \"group\", value AS macro_auroc, CASE WHEN event_id%9=0 THEN 'nan'::DOUBLE ELSE value/2 END AS macro_f1 FROM events)"


def evals(spark, sf):
    e = F.col("event_id")

    def pick(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    q = F.floor(e / 4) % 4
    return X.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.concat(pick(["cohort", "other"], e % 2), F.lit("__"), pick(["a", "b"], F.floor(e / 2) % 2), F.lit("__test")).alias("eval"),
        pick(["all", "kernel_class", "kernel_class", "manufacturer"], q).alias("group_by"), pick(["all", "sharp", "soft", "maker 1"], q).alias("group"), F.col("value").alias("macro_auroc"),
        F.when(e % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 2).alias("macro_f1"), F.lit("cohort").alias("source"), F.lit("a").alias("run"))


KEYED = "CASE WHEN eval='cohort__a__test' THEN 'test' ELSE split_part(eval,'__',1)||'.'||split_part(eval,'__',2)||'.test' END"


@reg.add("fn22_eval_key", f"SELECT event_id, {KEYED} AS key FROM {EVALS}")
def _(spark, sf):
    return evals(spark, sf).select("event_id", I.eval_key(F.col("eval"), F.col("source"), F.col("run")).alias("key"))


@reg.add("snk6_export_summary", f"SELECT run_id, {KEYED}||'.'||m||CASE WHEN group_by='all' THEN '' ELSE '.'||\"group\" END AS key, v AS value, 0::BIGINT AS step FROM (SELECT *, 'macro_auroc' AS m, macro_auroc AS v FROM {EVALS} UNION ALL SELECT *, 'macro_f1', macro_f1 FROM {EVALS}) WHERE isfinite(v)")
def _(spark, sf):
    return X2.export_summary(evals(spark, sf), ["macro_auroc", "macro_f1"])


@reg.add("snk6_export_curves", "SELECT run_id, 'val_loss' AS key, val_loss AS value, epoch AS step FROM curves UNION ALL SELECT run_id, 'lr', lr, epoch FROM curves")
def _(spark, sf):
    return X2.export_curves(curves(spark, sf), ["val_loss", "lr"])


@reg.add("snk6_export_params", f"SELECT config, regexp_replace(setting,'[^A-Za-z0-9_./ -]','_','g') AS key, substr(value,1,500) AS value FROM {FLAT}")
def _(spark, sf):
    return X2.export_params(settings(spark, sf), "config")


@reg.add("snk6_export_labels", f"SELECT run_id, {KEYED}||'.label.'||('l'||event_id%5)||'.auroc' AS key, macro_auroc AS value, 0::BIGINT AS step FROM {EVALS} WHERE group_by='all' AND isfinite(macro_auroc)")
def _(spark, sf):
    per_label = evals(spark, sf).select("run_id", "eval", "group_by", "source", "run", F.concat(F.lit("l"), (F.col("event_id") % 5).cast("string")).alias("label"),
                                        F.col("macro_auroc").alias("auroc"))
    return X2.export_labels(per_label, ["auroc"])


PIVOT = f"(SELECT run_id, eval, max(macro_auroc) FILTER (group_by='all') AS overall, max(macro_auroc) FILTER (\"group\"='sharp') AS sharp, max(macro_auroc) FILTER (\"group\"='soft') AS soft FROM {EVALS} GROUP BY 1,2)"


@reg.add("ag15_metric_pivot", f"SELECT run_id, eval, overall, sharp, soft, {r('soft-sharp', 'soft_minus_sharp')} FROM {PIVOT}")
def _(spark, sf):
    return tidy(X2.metric_pivot(evals(spark, sf), ["run_id", "eval"]))


def spread_sql(*columns):
    return ", ".join(f"{r(f'avg({c})', c)}, {r(f'stddev_samp({c})', f'{c}_std')}" for c in columns)


@reg.add("ag15_pivot_over_seeds", f"SELECT eval, count(*) AS seeds, {spread_sql('overall', 'sharp', 'soft', 'soft_minus_sharp')} FROM (SELECT *, soft-sharp AS soft_minus_sharp FROM {PIVOT}) GROUP BY 1")
def _(spark, sf):
    return tidy(X2.pivot_over_seeds(X2.metric_pivot(evals(spark, sf), ["run_id", "eval"]), ["eval"]))


@reg.add("ag15_metric_by_scanner", f"SELECT eval, \"group\" AS manufacturer, count(*) AS seeds, {spread_sql('macro_auroc')} FROM {EVALS} WHERE group_by='manufacturer' GROUP BY 1,2")
def _(spark, sf):
    return tidy(X2.metric_by_scanner(evals(spark, sf), ["eval"]))


@reg.add("ag16_delta_to_reference", f"WITH m AS (SELECT config, avg(best) AS best, avg(avg_train) AS avg_train FROM {RUNS} GROUP BY 1) SELECT config, {r('(best-(SELECT best FROM m WHERE config=3))*100', 'delta_best', 7)}, {r('(avg_train-(SELECT avg_train FROM m WHERE config=3))*100', 'delta_avg_train', 7)} FROM m")
def _(spark, sf):
    table = X2.mean_std(runs(spark, sf), ["config"], ["best", "avg_train"])
    return tidy(X2.delta_to_reference(table, "config", 3, ["best", "avg_train"]), 7)


LABELS = "(SELECT user_id%10 AS config, event_type AS label, avg(value) AS auroc FROM events GROUP BY 1,2)"


@reg.add("ag16_findings_beating_reference", f"SELECT a.config, count(*) FILTER (a.auroc>b.auroc) AS better, count(*) AS compared FROM {LABELS} a JOIN {LABELS} b ON a.label=b.label AND b.config=3 WHERE a.config<>3 GROUP BY 1")
def _(spark, sf):
    t = X.table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("config"), F.col("event_type").alias("label")).agg(F.avg("value").alias("auroc"))
    return X2.findings_beating_reference(t, "config", 3)


REPORTS = "(SELECT user_id AS config, avg(value)/100 AS paired_flip, avg(value) FILTER (event_type='click')/100 AS sens_soft, avg(value) FILTER (event_type='view')/100 AS sens_sharp, stddev_pop(value) AS fp_per_scan, count(*) AS supported FROM events GROUP BY 1)"


@reg.add("ag18_phase_gate", f"WITH b AS (SELECT * FROM {REPORTS}) SELECT config, paired_flip<=(SELECT paired_flip FROM b WHERE config=4)/2 AS flip_halved, abs(sens_soft-sens_sharp)<=0.05 AS gap_small, fp_per_scan<=(SELECT fp_per_scan FROM b WHERE config=4)+1e-9 AS fp_not_worse, supported>(SELECT supported FROM b WHERE config=4) AS more_supported, {r('sens_soft-sens_sharp', 'sens_gap')} FROM b")
def _(spark, sf):
    def mean(kind):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value"))) / 100
    t = X.table(spark, sf, "events").groupBy(F.col("user_id").alias("config")).agg((F.avg("value") / 100).alias("paired_flip"), mean("click").alias("sens_soft"), mean("view").alias("sens_sharp"),
                                                                                 F.stddev_pop("value").alias("fp_per_scan"), F.count(F.lit(1)).alias("supported"))
    return tidy(X2.phase_gate(t, "config", 4))


@reg.add("wn5_relative_curves", f"SELECT run_id, epoch, {r('val_loss/nullif(min(val_loss) OVER (PARTITION BY run_id),0)', 'val_loss_rel')}, {r('train_loss/nullif(first_value(train_loss) OVER (PARTITION BY run_id ORDER BY epoch),0)', 'train_loss_rel')} FROM curves")
def _(spark, sf):
    return tidy(X2.relative_curves(curves(spark, sf)))


@reg.add("wn6_run_ends", f"SELECT run_id, max(epoch) AS epochs_run, arg_min(epoch,(val_loss,epoch)) AS best_epoch, {r('100*arg_max(lr,epoch)/max(lr)', 'lr_left')}, {r('avg(seconds)', 'seconds_per_epoch')}, arg_min(epoch,(val_loss,epoch))>54 AS late_best FROM curves GROUP BY 1")
def _(spark, sf):
    return tidy(X2.run_ends(curves(spark, sf), 60))


REPLAY = """(SELECT *, max(CASE WHEN bad>=9 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM (SELECT *, epoch-coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch),0) AS bad
  FROM (SELECT *, CASE WHEN value IS NULL THEN false ELSE coalesce(value>best_before,true) END AS improved FROM (SELECT *, max(value) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
  FROM (SELECT run_id, epoch, CASE WHEN seed%5=1 AND epoch%4=0 THEN NULL ELSE val_loss END AS value FROM curves)))))"""


def replay(spark, sf):
    c = curves(spark, sf).withColumn("metric", F.when((F.col("seed") % 5 == 1) & (F.col("epoch") % 4 == 0), F.lit(float("nan"))).otherwise(F.col("val_loss")))
    return X2.replay_early_stopping(c, "metric", 9)


@reg.add("wn7_early_stopping_replay", f"SELECT run_id, epoch, value, best_before, improved, bad AS bad_epochs FROM {REPLAY} WHERE coalesce(over,0)=0")
def _(spark, sf):
    return replay(spark, sf)


@reg.add("wn7_early_stops", f"SELECT run_id, max(epoch) AS epochs_run, max(epoch) FILTER (improved) AS best_epoch, arg_max(value,epoch) FILTER (improved) AS best_value, CASE WHEN max(bad)>=9 THEN 'early_stopping' ELSE 'max_epochs' END AS stopped FROM {REPLAY} WHERE coalesce(over,0)=0 GROUP BY 1")
def _(spark, sf):
    return X2.early_stops(replay(spark, sf), 9)


@reg.add("so3_typical_run", f"WITH m AS (SELECT config, avg(best) AS mean FROM {RUNS} GROUP BY 1) SELECT config, arg_min(run_id,(round(abs(best-mean),12),run_id)) AS run_id, {r('any_value(mean)', 'mean')} FROM {RUNS} JOIN m USING (config) GROUP BY 1")
def _(spark, sf):
    return tidy(X2.typical_run(runs(spark, sf), "config", "best"))


@reg.add("so3_config_ranking", f"SELECT config, {r('avg(best)', 'mean')}, count(*) AS runs FROM {RUNS} GROUP BY 1")
def _(spark, sf):
    return tidy(X2.ranked_configs(runs(spark, sf), "config", "best"))


@reg.add("j15_ledger_join", f"SELECT e.event_id, e.eval, e.macro_auroc, n.config, n.best FROM {EVALS} e LEFT JOIN (SELECT * FROM {RUNS} WHERE seed%6>0) n ON n.run_id=e.run_id")
def _(spark, sf):
    ledger = runs(spark, sf).filter("seed % 6 > 0")
    return X2.join_ledgers(evals(spark, sf).select("event_id", "run_id", "eval", "macro_auroc"), ledger, ["config", "best"]).drop("run_id")


@reg.add("me13_ledger_summary", f"SELECT 'm' AS name, config AS config_hash, grp AS loss, count(*) AS seeds, {r('avg(best)', 'best')}, {r('stddev_samp(best)', 'best_std')} FROM {RUNS} GROUP BY 1,2,3")
def _(spark, sf):
    ledger = runs(spark, sf).select(F.lit("m").alias("name"), F.col("config").alias("config_hash"), F.col("grp").alias("loss"), "best")
    return tidy(X2.ledger_summary(ledger, ["best"], name="m"))
