"""Trees of many small files: listed and opened by tasks, parsed as Spark's own readers did."""
import json

from scanledger.sources import experiments as SE, raw as SX


def tree(root):
    runs = {"a": {"run_id": "ra", "config_hash": "h", "status": "finished"}, "b c%20": {"config_hash": "h2"}, "broken": None, "list": [{"run_id": "l1"}, {"run_id": "l2"}]}
    for name, info in runs.items():
        folder = root / "exp" / "h" / name
        folder.mkdir(parents=True)
        (folder / "run_info.json").write_text('{"run_id": ' if info is None else json.dumps(info, indent=2))
        (folder / "metrics.csv").write_text("note,val_loss,epoch\n\"two\nlines\",0.5,1\n,,2\nx,bad,3\n\n")
        (folder / "_hidden.json").write_text("{}")
        (folder / "empty.csv").write_text("")
    (root / ".git").mkdir()
    (root / ".git" / "run_info.json").write_text('{"run_id": "hidden"}')


def test_list_files_by_levels(spark, tmp_path):
    tree(tmp_path)
    rows = SX.list_files(spark, str(tmp_path)).collect()
    assert sorted((r.dir, r.name) for r in rows) == sorted((f"file://{tmp_path}/exp/h/{n}", f) for n in ("a", "b c%20", "broken", "list") for f in ("metrics.csv", "run_info.json"))
    (tmp_path / "none").mkdir()
    assert SX.list_files(spark, str(tmp_path / "none")).count() == 0


def test_tree_readers_keep_file_names_out_of_the_driver(spark, tmp_path):
    tree(tmp_path)
    info = SE.read_json_files(spark, str(tmp_path), "run_info.json", SE.RUN_INFO)
    curves = SE.load_curves(spark, str(tmp_path), "epoch bigint, val_loss double")
    for df in (info, curves):  # a file index of the tree would list its files here
        assert not [f for f in df.inputFiles() if str(tmp_path) + "/exp" in f]
    assert sorted((r.dir.rsplit("/", 1)[1], r.run_id) for r in info.collect() if r.run_id) == [("a", "ra"), ("list", "l1"), ("list", "l2")]
    assert info.filter("run_id IS NULL").count() == 2
    one = sorted(((r.epoch, r.val_loss) for r in curves.filter("run_id = 'ra'").collect()))
    assert one == [(1, 0.5), (2, None), (3, None)]
    assert curves.filter("run_id LIKE '%/b c%'").count() == 3


def test_rows_of_opened_files_are_not_broadcast(spark, tmp_path):
    """The list of names is small to Spark, whatever the files hold: a table of their rows is never a small one."""
    tree(tmp_path)
    (tmp_path / "exp" / "h" / "a" / "metrics.csv").write_text("epoch,val_loss\n" + "".join(f"{i},{i / 8}\n" for i in range(20_000)))
    (tmp_path / "exp" / "h" / "a" / "config.yaml").write_text("name: n\nseed: 3\n")
    for at, name, text in (("eval/s__r__test", "summary.csv", "label,auroc\nx,0.5\n"), ("clinical/s__r__test", "per_label.csv", "label,auroc\nx,0.5\ny,0.25\n"),
                           ("clinical/s__r__test", "gate.csv", "label,status\nx,supported\n"), ("clinical/s__r__test", "scorecard.json", '{"run_id": "ra", "eval": "s__r__test"}')):
        folder = tmp_path / "exp" / "h" / "a" / at
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    curves = SE.load_curves(spark, str(tmp_path), "epoch bigint, val_loss double").select("run_id", "epoch", "val_loss")
    runs = SE.load_runs(spark, str(tmp_path)).select("run_id", "seed")
    evaluations = SE.load_evaluations(spark, str(tmp_path), "summary.csv", "label string, auroc double").select("run_id", "eval_split", "auroc")
    labels = SE.load_clinical(spark, str(tmp_path), "label string, auroc double")[1].select("run_id", "label", "status")
    got = {}
    for name, df in (("curves", curves), ("runs", runs), ("evaluations", evaluations), ("labels", labels)):
        got[name] = sorted((tuple(r) for r in df.collect() if r.run_id == "ra"), key=str)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan, name
    assert sorted(got["curves"], key=lambda r: r[1]) == [("ra", i, i / 8) for i in range(20_000)]
    assert got["runs"] == [("ra", 3)] and got["evaluations"] == [("ra", "test", 0.5)]
    assert got["labels"] == [("ra", "x", "supported"), ("ra", "y", None)]
