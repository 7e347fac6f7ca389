import random

import pytest
from pyspark.sql import functions as F

from slipscope.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    rows = [(i, i % 10, [r.gauss(1.0 if i % 10 < 5 else 0.0, 1) for _ in range(64)]) for i in range(120)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["is1_internal_scores", "cb3_calibrated_scores"])
def test_scores_are_the_mean_of_all_five_layers(spark, tables, name):
    rows = queries.QUERIES[name](spark, tables).collect()
    assert len(rows) == 120
    assert all(abs(sum(r[f"layer_{i}"] for i in range(5)) / 5 - r.isd_score) < 2e-6 for r in rows)


def test_all_layers_are_fitted_saved_and_scored(spark, tables):
    assert sorted(r.layer_idx for r in queries.cb1_calibrated_probes(spark, tables).collect()) == [0, 1, 2, 3, 4]
    saved = queries.io11_probes_saved(spark, tables)
    assert {(r.layer_idx, r["count"]) for r in saved.groupBy("layer_idx").count().collect()} == {(i, 120) for i in range(5)}
    assert saved.where(~F.col("p").between(0, 1)).isEmpty()
