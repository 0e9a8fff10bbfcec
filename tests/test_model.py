from __future__ import annotations

import os
import subprocess
import sys

import pytest
from conftest import rows
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from cohortloom.operators import model as m
from cohortloom.operators.prep import feature_pipeline
from cohortloom.operators.split import stratified_folds


@pytest.fixture(scope="module")
def prepared(spark):
    n = 600
    rows_ = [(i, float(i * 37 % 100), float(i * 11 % 7), "abc"[i % 3], float((i * 37 % 100) > 60 or i % 13 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows_, "k long, a double, b double, c string, label double")
    out = feature_pipeline(["a", "b"], ["c"]).fit(df).transform(df).select("k", "features", "label")
    fold = stratified_folds(out.select("k", "label"), "k", "label", 1, 2).select("k", "fold")
    return out.join(fold, "k").persist()


@pytest.fixture(scope="module")
def fitted(prepared):
    return m.fit(prepared.select("features", "label"), m.Boosting(rounds=4, depth=2, subsample=1.0))


def test_last_stage_equals_the_model(prepared, fitted, monkeypatch):
    scored = m.score(fitted, prepared, "p")
    for per_step in (50, 3):
        monkeypatch.setattr(m, "TREES_PER_STEP", per_step)
        both = m.staged_scores(fitted, scored.select("k", "features", "p"))
        assert both.filter(F.abs(F.element_at("scores", -1) - F.col("p")) > 1e-9).count() == 0
        assert both.select(F.size("scores")).first()[0] == 4


def test_importance_finds_the_driver(prepared, fitted):
    table = rows(m.importance(fitted, prepared), "rank")
    assert table[0][0] == "a" and table[0][2] == 100.0 and sum(r[1] for r in table) == pytest.approx(1)
    assert len(m.importance(fitted, prepared, top=2).collect()) == 2


def test_early_stop_uses_the_marked_rows(prepared):
    marked = prepared.withColumn("is_validation", F.col("fold") == 1)
    model = m.fit(marked, m.Boosting(rounds=5, depth=2, subsample=1.0), validation="is_validation")
    assert 1 <= len(model.trees) <= 5


def test_choose_rounds(prepared):
    table, best = m.choose_rounds(prepared, m.Boosting(rounds=3, depth=2, subsample=1.0), fold="fold", folds=2, patience=2)
    got = table.collect()
    assert [r["round"] for r in got] == [1, 2, 3] and 1 <= best <= 3
    assert all(0.5 < r["test_mean"] <= 1 and r["test_sd"] is not None for r in got)


def test_scores_do_not_depend_on_cores():
    code = (
        "import sys; sys.path.insert(0, {root!r})\n"
        "from cohortloom.session import local_session\n"
        "from cohortloom.plans import score_queries as q\n"
        "from cohortloom.operators.model import Boosting, fit, score\n"
        "spark = local_session({cores!r}, 4)\n"
        "train, test = q.prepared(spark, '/root/testdata/sf0.001')\n"
        "found = score(fit(train.select('features', 'label'), Boosting(rounds=3, depth=3, subsample=0.7)), test)\n"
        "print('SUM', repr(sum(r['score'] for r in found.orderBy('encounter_id').collect())))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sums = set()
    for cores in ("2", "5"):
        done = subprocess.run([sys.executable, "-c", code.format(root=root, cores=cores)], capture_output=True, text=True, timeout=300, check=True)
        sums.add(done.stdout.split("SUM")[1].strip())
    assert len(sums) == 1


def test_rounds_stop_growing_when_patience_ends(prepared, monkeypatch):
    grown = []
    plain = m.fit
    monkeypatch.setattr(m, "FIRST_STAGE", 1)
    monkeypatch.setattr(m, "fit", lambda train, params, **more: grown.append(params.rounds) or plain(train, params, **more))
    table, best = m.choose_rounds(prepared, m.Boosting(rounds=60, depth=6, subsample=1.0), fold="fold", folds=2, patience=2, with_train=False)
    assert max(grown) < 60 and 1 <= best <= max(grown) and table.filter("train_mean is not null").count() == 0


def test_out_of_fold_scores_come_from_the_other_folds(prepared):
    params = m.Boosting(rounds=2, depth=2, subsample=1.0)
    got = m.out_of_fold(prepared, params, key="k", fold="fold", folds=2)
    other = m.fit(prepared.filter("fold <> 1").select("features", "label"), params)
    want = m.score(other, prepared.filter("fold = 1")).select("k", "score")
    assert got.count() == prepared.count() and rows(got.filter("fold = 1").select("k", "score"), "k") == rows(want, "k")


def test_least_gain_keeps_trees_small(prepared):
    assert m.fit(prepared.select("features", "label"), m.Boosting(rounds=1, depth=3, subsample=1.0, min_info_gain=10.0)).trees[0].depth == 0


def test_score_replaces_a_column_of_its_name(prepared, fitted):
    again = m.score(fitted, m.score(fitted, prepared, "p"), "p")
    assert again.columns.count("p") == 1 and again.filter("p > 0.5").count() > 0


def test_grid_shares_fits_over_rounds(prepared):
    grid = m.parameter_grid({"rounds": [1, 3], "depth": [1, 2], "subsample": [1.0]})
    out = m.search_grid(prepared, grid, fold="fold", folds=2)
    assert out.count() == 4 and {"roc", "sens", "spec", "roc_sd", "sens_sd", "spec_sd"} <= set(out.columns)
    assert m.best_setting(out).first()["roc"] == max(r["roc"] for r in out.collect())


def test_grid_frame_has_every_combination(spark):
    assert m.grid_frame(spark, {"eta": [0.1, 0.2], "depth": [3, 5, 7]}).distinct().count() == 6


def test_save_and_load(prepared, fitted, tmp_path):
    pipeline = Pipeline(stages=[fitted]).fit(prepared)
    m.save(pipeline, str(tmp_path / "model"))
    loaded = m.load_pipeline(str(tmp_path / "model"))
    a, b = m.score(pipeline, prepared.select("k", "features"), "p"), m.score(loaded, prepared.select("k", "features"), "p")
    assert rows(a.select("k", "p"), "k") == rows(b.select("k", "p"), "k")
