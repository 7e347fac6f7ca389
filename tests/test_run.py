import json
import random

import pytest
from pyspark.sql import functions as F

from slipscope.operators import probes
from slipscope.plans.run import Config, Run, main
from slipscope.sources import store, tasks
from slipscope.streaming import live


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    qa = spark.createDataFrame([(i, f"q{i}", (f"Town {i}", ["alias"])) for i in range(30)], "id int, question string, answer struct<value:string, aliases:array<string>>")
    maths = spark.createDataFrame([(i, f"m{i}", f"work #### {i * 3}") for i in range(30)], "id int, question string, answer string")
    choice = spark.createDataFrame([(i, "ctx", ["w", "x", "y", "z"], i % 4) for i in range(30)], "id int, ctx string, endings array<string>, label int")
    config = Config.from_dict({"tasks": {"factual_qa": {"n_samples": 20}, "reasoning": {"n_samples": 20}, "commonsense": {"n_samples": 20}, "other": {"n_samples": 1}}, "output": {"results_dir": str(tmp_path_factory.mktemp("run"))}})
    r = Run(spark, config)
    r.generate({"factual_qa": qa, "reasoning": maths, "commonsense": choice})
    return r


def test_stages_end_to_end(spark, run):
    counts = run.judge().where("overall").first()
    assert counts.total == 60 and 0 < counts.correct < 60
    judged = store.read_jsonl(spark, f"{run.dir}/judged.jsonl", store.JUDGED)
    rng = random.Random(0)
    acts = [(r.task_id, layer, [rng.gauss(2.0 * r.is_correct, 1) for _ in range(3)]) for r in judged.collect() for layer in (0, 3)]
    store.write_activations(spark.createDataFrame(acts, store.ACTIVATIONS), f"{run.dir}/activations")
    fitted = run.probe()
    assert [p.layer for p in fitted] == [0, 3] and all(p.auc > 0.7 and (p.n_train, p.n_test) == (48, 12) for p in fitted)
    run.linguistic()
    run.pei()
    out = run.analyse()
    assert out["overall"].first().n == counts.errors and out["showcase"].count() == 10
    path = f"{run.dir}/summary.json"
    store.write_report(spark, path, overall=out["overall"], domains=out["by_domain"])
    with open(path) as f:
        assert json.load(f)["overall"][0]["n"] == counts.errors
    bars = {(r.layer_idx, r.measure): r.value for r in out["probe_accuracy"].collect()}
    assert bars == {(p.layer, m): v for p in fitted for m, v in (("Accuracy", p.accuracy), ("AUC", p.auc))}
    back = probes.load(spark, f"{run.dir}/probes")
    assert [p.accuracy for p in back] == [p.accuracy for p in fitted]


def test_stream_of_responses_is_judged_like_a_batch(spark, run, tmp_path):
    rows = live.responses(spark, f"{run.dir}/responses.jsonl")
    live.write(live.judged(rows).select("task_id", "is_correct"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    live.write(live.scored(live.responses(spark, f"{run.dir}/responses.jsonl")), str(tmp_path / "f"), str(tmp_path / "g")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60 == spark.read.parquet(str(tmp_path / "f")).count()


def test_loader_ids_and_templates(spark, run):
    rows = {r.task_id: r for r in store.read_jsonl(spark, f"{run.dir}/responses.jsonl", store.RESPONSES).collect()}
    assert {"tqa_0000", "gsm_0019", "hs_0007"} <= set(rows) and len(rows) == 60
    assert "  (B) x\n" in rows["hs_0007"].prompt and rows["hs_0007"].ground_truth in "ABCD"
    with pytest.raises(ValueError):
        tasks.load_tasks({}, {"factual_qa": 1})


def test_quotas_and_layers(spark):
    assert probes.quotas({0: 1389, 1: 2111}, 0.2) == {0: 278, 1: 422}
    assert probes.selected_layers(28) == [0, 7, 14, 21, 27]
    row = spark.createDataFrame([(28,), (1,)], "n int").select(probes.selected_layers_of(F.col("n")).alias("l")).collect()
    assert [r.l for r in row] == [[0, 7, 14, 21, 27], [0]]


def test_malformed_json_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"task_id": "a"\n')
    with pytest.raises(Exception):
        store.read_jsonl(spark, str(tmp_path / "x.jsonl"), store.SCORED).collect()


def test_npz_import_and_stage_cache(spark, tmp_path):
    import numpy as np

    np.savez_compressed(tmp_path / "a.npz", layer_0=np.ones((2, 3), np.float32), layer_7=np.zeros((2, 3), np.float32))
    rows = store.import_npz(spark, str(tmp_path / "a.npz"), ["a", "b"]).collect()
    assert {(r.task_id, r.layer_idx) for r in rows} == {("a", 0), ("b", 0), ("a", 7), ("b", 7)}
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [store.stage(spark, str(tmp_path / "s"), make).count() for _ in range(2)] == [3, 3] and calls == [1]


def test_a_stage_that_was_not_written_to_its_end_is_made_again(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "s"))
    (tmp_path / "s" / "_SUCCESS").unlink()
    assert store.stage(spark, str(tmp_path / "s"), lambda: spark.range(5)).count() == 5


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        store.shared_dir(Session)


def test_ordered_lines_follow_the_order(spark, tmp_path):
    path = str(tmp_path / "o.jsonl")
    store.write_jsonl(spark.range(1000).selectExpr("id", "1000 - id as rank").repartition(7), path, order="rank")
    lines = [json.loads(x)["rank"] for f in sorted((tmp_path / "o.jsonl").glob("part-*")) for x in open(f)]
    assert lines == list(range(1, 1001))


def test_command_line_generates_and_reports(spark, tmp_path):
    rows = [{"id": i, "question": f"m{i}", "answer": f"work #### {i * 3}"} for i in range(40)]
    (tmp_path / "maths.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "run.yaml").write_text(json.dumps({"tasks": {"reasoning": {"n_samples": 40}}, "probing": {"test_split": 0.5, "calibrated": True}, "pei": {"min_words": 2}, "output": {"results_dir": str(tmp_path / "out")}}))
    config = ["--config", str(tmp_path / "run.yaml")]
    main(["--stage", "generate", "--source", f"reasoning={tmp_path}/maths.jsonl", *config])
    main(["--stage", "judge", *config])
    judged = store.read_jsonl(spark, str(tmp_path / "out/judged.jsonl"), store.JUDGED).collect()
    rng = random.Random(1)
    acts = [(r.task_id, layer, [rng.gauss(2.0 * r.is_correct, 1) for _ in range(3)]) for r in judged for layer in (0, 1)]
    store.write_activations(spark.createDataFrame(acts, store.ACTIVATIONS), str(tmp_path / "out/activations"))
    for stage in ("probe", "linguistic", "pei", "analyse"):
        main(["--stage", stage, *config])
    with open(tmp_path / "out/report.json") as f:
        report = json.load(f)
    assert len(report["probe_accuracy"]) == 4 and report["overall"][0]["n"] == sum(not r.is_correct for r in judged)
    assert all(r["n_test"] == 20 for r in map(json.loads, "".join(p.read_text() for p in (tmp_path / "out/probe_results.jsonl").glob("part-*")).splitlines()))
    assert (tmp_path / "out/figures/distribution.jsonl").exists()
    with pytest.raises(SystemExit):
        main(["--stage", "generate", *config])


def test_chat_prompt(spark):
    row = spark.createDataFrame([("Why?",)], "p string").select(tasks.chat_prompt(F.col("p")).alias("x")).first()
    assert row.x == "<|im_start|>system\nAnswer the user's question.<|im_end|>\n<|im_start|>user\nWhy?<|im_end|>\n<|im_start|>assistant\n"


def test_probes_scale_by_the_population_deviation(spark):
    df = spark.createDataFrame([([float(x)], float(x > 2), 7) for x in (0, 1, 3, 8)], "act array<double>, label double, layer_idx int")
    (mean, deviation, n), want = probes.scales(df)[7], (38 / 4) ** 0.5
    assert (mean[0], deviation[0], n) == (pytest.approx(3.0), pytest.approx(want), 4)
    w = probes.fitted(df, probes.scales(df))[7]
    fit = probes.Probe(7, mean.tolist(), deviation.tolist(), w[:-1].tolist(), float(w[-1]))
    got = sorted(r.margin for r in probes.margins(df, probes.table(spark, [fit])).collect())
    assert got == pytest.approx([(x - 3.0) / want * w[0] + w[1] for x in (0, 1, 3, 8)])
