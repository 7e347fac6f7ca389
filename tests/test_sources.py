import os
import random
import time
import zipfile

import numpy as np
import pytest

from slipscope.plans.run import Config, Run, main
from slipscope.sources import archive, store


def arrays(seed=1, n=50):
    r = np.random.default_rng(seed)
    return {"layer_0": r.normal(size=(n, 4)).astype(np.float32), "layer_7": r.normal(size=(n, 6)), "layer_12": r.normal(size=(n, 2)).astype(np.float16), "other": np.arange(3), "layer_x": np.arange(3)}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_ranges_equal_the_whole_arrays(spark, tmp_path, save, monkeypatch):
    given = arrays()
    given["layer_9"] = np.asfortranarray(given["layer_7"])
    save(tmp_path / "a.npz", **given)
    df = archive.read_npz(spark, str(tmp_path / "a.npz"), rangeBytes="100")
    got = {(r.layer_idx, r.row): r.act for r in df.collect()}
    assert len(got) == 4 * 50
    for k in (0, 7, 9, 12):
        for i, want in enumerate(given[f"layer_{k}"].astype(np.float32)):
            assert np.array_equal(np.array(got[k, i], np.float32), want)
    # 100 bytes hold 6 rows of layer 0, 2 of layers 7 and 9 and 25 of layer 12.
    assert df.rdd.getNumPartitions() == 9 + 25 + 25 + 2
    assert archive.read_npz(spark, f"file://{tmp_path}/a.npz").rdd.getNumPartitions() == 8


def test_ids_meet_rows_by_number(spark, tmp_path):
    given = arrays(2, 9)
    np.savez(tmp_path / "a.npz", **given)
    ids = [f"t{i}" for i in range(9)]
    out = store.import_npz(spark, str(tmp_path / "a.npz"), ids)
    got = {(r.task_id, r.layer_idx): r.act for r in out.collect()}
    assert out.columns == ["task_id", "layer_idx", "act"] and len(got) == 27
    assert all(np.array_equal(np.array(got[t, 0], np.float32), given["layer_0"][i]) for i, t in enumerate(ids))
    table = spark.createDataFrame(list(enumerate(ids)), "row long, task_id string")
    assert {(r.task_id, r.layer_idx) for r in store.import_npz(spark, str(tmp_path / "a.npz"), table).collect()} == set(got)
    with pytest.raises(ValueError):
        store.import_npz(spark, str(tmp_path / "a.npz"), ids[:-1])


def test_portions_of_a_range(tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PORTION_BYTES", 70)
    x = np.arange(40.0).reshape(10, 4)
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "a.npz", layer_3=x)
        with archive.opened(str(tmp_path / "a.npz")) as z:
            (h,) = archive.headers(z)
            parts = list(archive.rows(z, h, 3, 9))
        assert [(lo, len(p)) for lo, p in parts] == [(3, 2), (5, 2), (7, 2)] and np.array_equal(np.concatenate([p for _, p in parts]), x[3:9])


def test_empty_archives_and_arrays_without_numbers(spark, tmp_path):
    np.savez(tmp_path / "none.npz", other=np.arange(3))
    np.savez(tmp_path / "empty.npz", layer_0=np.empty((0, 4)), layer_1=np.empty((3, 0)))
    assert archive.read_npz(spark, str(tmp_path / "none.npz")).count() == 0
    assert [(r.layer_idx, r.act) for r in archive.read_npz(spark, str(tmp_path / "empty.npz")).collect()] == [(1, [])] * 3
    with zipfile.ZipFile(tmp_path / "bad.npz", "w") as z:
        np.save(z.open("layer_0.npy", "w"), np.array([{}], object), allow_pickle=True)
    with pytest.raises(ValueError):
        archive.lengths(str(tmp_path / "bad.npz"))


def test_a_stage_is_made_again_when_what_it_is_made_of_changes(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in put"))
    read = lambda: spark.read.parquet(str(tmp_path / "in put"))
    calls = []
    make = lambda: calls.append(1) or read()
    run = lambda **settings: store.stage(spark, str(tmp_path / "s"), make, [read()], **settings).count()
    assert [run(weight=1), run(weight=1)] == [3, 3] and len(calls) == 1
    assert run(weight=2) == 3 and len(calls) == 2
    assert run(weight=2) == 3 and len(calls) == 2
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in put"))
    assert run(weight=2) == 8 and len(calls) == 3
    os.remove(tmp_path / "s/_SUCCESS")
    assert run(weight=2) == 8 and len(calls) == 4
    # Without inputs or settings, what is there counts.
    assert store.stage(spark, str(tmp_path / "s"), lambda: spark.range(1)).count() == 8


def test_a_run_is_resumed_where_something_changed(spark, tmp_path):
    r = random.Random(1)
    rows = [{"task_id": f"t{i:03d}", "domain": "factual_qa", "prompt": "p", "ground_truth": "Oslo" if i % 2 else "Rome", "metadata": {"aliases": []}, "response": "Oslo."} for i in range(40)]
    store.write_jsonl(spark.createDataFrame([(x["task_id"], x["domain"], x["prompt"], x["ground_truth"], ([], None, None, None), x["response"]) for x in rows], store.RESPONSES), f"{tmp_path}/responses.jsonl")
    acts = [(x["task_id"], k, [r.gauss(i % 2, 1) for _ in range(3)]) for i, x in enumerate(rows) for k in (0, 1)]
    store.write_activations(spark.createDataFrame(acts, store.ACTIVATIONS), f"{tmp_path}/activations")
    stages = ("judge", "probe", "linguistic", "pei")
    ran = lambda config: [s for s in stages if Run(spark, config).once(s)]
    first = Config(results_dir=str(tmp_path))
    assert ran(first) == list(stages)
    assert ran(first) == []
    assert ran(Config(results_dir=str(tmp_path), isd_weight=0.7)) == ["pei"]
    time.sleep(1.1)
    Run(spark, first).linguistic()
    assert ran(Config(results_dir=str(tmp_path), isd_weight=0.7)) == ["linguistic", "pei"]
    (tmp_path / "c.yaml").write_text(f"output: {{results_dir: {tmp_path}}}\npei: {{isd_weight: 0.7}}\n")
    before = os.stat(tmp_path / "pei_scores.jsonl/_made_of").st_mtime_ns
    main(["--stage", "pei", "--resume", "--config", str(tmp_path / "c.yaml")])
    assert os.stat(tmp_path / "pei_scores.jsonl/_made_of").st_mtime_ns == before
    main(["--stage", "pei", "--config", str(tmp_path / "c.yaml")])
    assert not os.path.exists(tmp_path / "pei_scores.jsonl/_made_of")
