"""Banded sheet reader, idempotent stage columns, stable row index, model persistence, feature matrix."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from geodemand.operators import additive as AD
from geodemand.operators.enrich import replace_stage_columns
from geodemand.operators.rows import with_row_index
from geodemand.plans import q_model as QM
from geodemand.sources.readers import read_banded


def test_read_banded(spark):
    d = tempfile.mkdtemp(prefix="geodemand-test-", dir="/tmp")
    p = os.path.join(d, "sheet.csv")
    with open(p, "w") as fh:
        fh.write("Title line\n\nRank,Area,Ignored,Visitors\nx,y,z,w\n")
        for i in range(1, 8):
            fh.write(f"{i},Area {i},-,{i * 100}\n")
        fh.write("Note: source footnote,,,\n")
    df = read_banded(spark, p, header_row=2, first_row=4, last_row=9, columns=[1, 3])
    rows = [(r.Area, r.Visitors) for r in df.orderBy("_line").collect()]
    assert rows == [(f"Area {i}", str(i * 100)) for i in range(1, 7)]


def test_replace_stage_columns_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    stage = spark.createDataFrame([(1, 10.0)], "id long, feat double")
    once = replace_stage_columns(base, stage, "id", ["feat"])
    twice = replace_stage_columns(once, stage, "id", ["feat"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert twice.columns == ["id", "name", "feat"]


def test_with_row_index(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (2, "a")], "k int, v string").repartition(3)
    got = [(r.k, r.v, r.row_idx) for r in with_row_index(df, [("k", True), ("v", True)]).collect()]
    assert sorted(got, key=lambda x: x[2]) == [(1, "a", 0), (2, "a", 1), (2, "b", 2), (3, "c", 3)]


def test_model_save_load_round_trip(spark, sf_small):
    m = QM.model_rows(spark, sf_small)
    bins = AD.fit_binning(m, QM.FEATURES, QM.CATEGORICAL, max_bins=8)
    comp = AD.compress(AD.binned(m, bins, keep=["y"]), QM.FEATURES)
    model = AD.fit_additive(comp, QM.FEATURES, bins, rounds=3, interactions=1, interaction_rounds=2)
    path = os.path.join(tempfile.mkdtemp(prefix="geodemand-model-", dir="/tmp"), "model")
    AD.save_model(model, spark, path)
    back = AD.load_model(spark, path)
    a = model.score(m).select("id", "pred_log").toPandas().sort_values("id")["pred_log"].to_numpy()
    b = back.score(m).select("id", "pred_log").toPandas().sort_values("id")["pred_log"].to_numpy()
    assert np.allclose(a, b)


def test_feature_matrix_drops_absent(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "n_orders double, pop double")
    assert AD.feature_matrix(df, ["nation", "n_orders", "pop", "lat"]).columns == ["n_orders", "pop"]
