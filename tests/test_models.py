"""Closed-form cross-checks of the MLlib fits."""

import numpy as np
import pytest

from ratewise.operators import models as M
from ratewise.operators import series as S
from ratewise.operators.features import FEATURE_COLS

COLS = ["occupancy_rate", "competitor_avg_price", "lead_time_days", "base_price"]


@pytest.fixture(scope="module")
def split(bookings_small):
    table = M.model_table(bookings_small)
    train, test = M.chrono_split(table)
    tv, (te,) = M.vectorize(train, [test], COLS)
    return tv, te


def _xy(df):
    pdf = df.select("features", "actual_price").toPandas()
    x = np.array([v.toArray() for v in pdf["features"]])
    return x, pdf["actual_price"].to_numpy()


def test_linear_matches_lstsq(split):
    train, _ = split
    m = M.estimator("linear").fit(train)
    x, y = _xy(train)
    xa = np.hstack([np.ones((len(x), 1)), x])
    coef = np.linalg.lstsq(xa, y, rcond=None)[0]
    assert m.intercept == pytest.approx(coef[0], rel=1e-6)
    assert list(m.coefficients) == pytest.approx(list(coef[1:]), rel=1e-6, abs=1e-8)


def test_ridge_matches_closed_form(split):
    train, _ = split
    n, s = M.label_stats(train)
    m = M.estimator("ridge", n_rows=n, label_std=s, alpha=1.0).fit(train)
    x, y = _xy(train)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 1.0 * np.eye(x.shape[1]), xc.T @ yc)
    assert list(m.coefficients) == pytest.approx(list(w), rel=1e-5, abs=1e-6)


def test_metrics_match_numpy(split):
    train, test = split
    m = M.estimator("linear").fit(train)
    pred = m.transform(test)
    got = M.metrics(pred).first()
    pdf = pred.select("actual_price", "prediction").toPandas()
    y, p = pdf.actual_price.to_numpy(), pdf.prediction.to_numpy()
    assert got.mae == pytest.approx(np.mean(np.abs(y - p)), abs=1e-6)
    assert got.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)), abs=1e-6)
    assert got.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), abs=1e-6)
    assert got.mape == pytest.approx(np.mean(np.abs(y - p) / np.maximum(np.abs(y), 1e-9)) * 100, abs=1e-6)


def test_leaky_features_refused():
    with pytest.raises(ValueError):
        M.safe_features(["occupancy_rate", "revpar"])
    assert M.safe_features(FEATURE_COLS) == FEATURE_COLS


def test_tree_models_fit_and_rank(split):
    train, test = split
    board = M.leaderboard(["linear", "tree"], train, test, tree={"max_depth": 4}).collect()
    assert {r.model for r in board} == {"linear", "tree"}
    assert board[0].r2 >= board[1].r2


def test_gbt_small_and_importances(split):
    train, test = split
    model, m = M.fit_evaluate("gbt", train, test, n_iter=5)
    assert m.first().r2 > 0
    imp = M.importances(model, COLS, 3).collect()
    assert len(imp) == 3 and imp[0].importance >= imp[-1].importance


def test_cross_validate_reports_mean_and_std(split):
    train, _ = split
    cv = M.cross_validate("linear", train, k=3).first()
    assert 0 < cv.cv_r2_mean <= 1 and cv.cv_r2_std >= 0


def test_random_search_and_effects(split):
    train, _ = split
    res = M.random_search(train, draws=2, folds=2, space={"maxIter": [3, 5], "maxDepth": [2, 3]})
    assert res.count() == 2
    eff = M.tuning_effects(res, "maxDepth").collect()
    assert sum(r.n for r in eff) == 2


def test_out_of_fold_rows_are_scored_by_fits_that_left_them_out(split):
    train, _ = split
    oof, models = M.out_of_fold(train, ["tree", "ridge"], folds=3, tree={"max_depth": 8})
    assert set(models) == {"tree", "ridge"} and oof.count() == train.count()
    keys = M.SPLIT_KEYS
    folded = M.fold_column(train, 3, 42)
    for f in range(3):
        tr, te = folded.where(folded.fold != f), folded.where(folded.fold == f)
        n, s = M.label_stats(tr)
        for b, o in (("tree", {"max_depth": 8}), ("ridge", {})):
            fit = M.estimator(b, n_rows=n, label_std=s, **o).fit(tr)
            want = fit.transform(te).select(*keys, "prediction")
            both = oof.where(oof.fold == f).join(want, keys)
            assert both.count() == te.count()
            assert both.where(f"abs(p_{b} - prediction) > 1e-6 * (1 + abs(prediction))").count() <= 0.01 * te.count()


def test_side_by_side_returns_by_name_and_raises():
    assert M.side_by_side({k: lambda k=k: k * 2 for k in range(9)}, 3) == {k: 2 * k for k in range(9)}
    with pytest.raises(ZeroDivisionError):
        M.side_by_side({"a": lambda: 1, "b": lambda: 1 // 0})


def test_formula_search_against_numpy(bookings_small):
    from pyspark.sql import functions as F
    space = {"a": [0.5, 1.0, 1.5], "b": [0.0, 0.1]}
    price = lambda p: F.col("base_price") * p["a"] + F.col("occupancy_rate") * p["b"]
    got = {(r.a, r.b): r.mean_test_score for r in M.formula_search(bookings_small, price, space, draws=4, folds=3).collect()}
    rows = M.fold_column(bookings_small, 3, 42).select("fold", "actual_price", "base_price", "occupancy_rate").toPandas()
    assert list(got) and len(got) == 4 and set(got) == {tuple(p.values()) for p in M.draws_from(space, 4)}
    for (a, b), r2 in got.items():
        want = []
        for _, g in rows.groupby("fold"):
            p = g.base_price * a + g.occupancy_rate * b
            want.append(1 - ((g.actual_price - p) ** 2).sum() / ((g.actual_price - g.actual_price.mean()) ** 2).sum())
        assert r2 == pytest.approx(np.mean(want), abs=1e-6)


def test_stack_and_learning_curve(split):
    train, test = split
    small = {"forest": {"num_trees": 3, "max_depth": 3}, "gbt": {"n_iter": 3}, "tree": {"max_depth": 3}}
    st = {r.model: r for r in M.fit_stack(train, test, folds=2, **small).collect()}
    assert set(st) == {"stacking", "forest", "gbt", "tree"} and st["stacking"].r2 > 0
    lc = M.learning_curve(train, "tree", sizes=2, folds=2, max_depth=3).collect()
    assert [r.size for r in lc] == [1, 2]


def test_permutation_importance_of_unused_feature_is_zero(bookings_small):
    table = M.model_table(bookings_small)
    train, test = M.chrono_split(table)
    from ratewise.operators.features import scaler_stats
    cols = COLS + ["is_holiday"]  # is_holiday is constant 0: the model cannot use it
    stats = scaler_stats(train, cols)
    tv, (te,) = M.vectorize(train, [test], cols)
    model = M.estimator("linear").fit(tv)
    imp = {r.feature: r for r in M.permutation_importance(model, te, cols, repeats=2, stats=stats).collect()}
    assert imp["is_holiday"].importance_mean == pytest.approx(0.0, abs=1e-9)
    assert imp["competitor_avg_price"].importance_mean > 0


def test_training_rows_lie_in_few_even_parts(bookings_small, monkeypatch):
    assert M.prepared_split(bookings_small, even=True)[0].rdd.getNumPartitions() == 1       # too few rows for more
    monkeypatch.setattr(M, "PART_ROWS", 300)
    train, test = M.prepared_split(bookings_small, even=True)
    rows = train.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert len(rows) == train.sparkSession.sparkContext.defaultParallelism and max(rows) <= 1.2 * min(rows)
    assert sum(rows) + test.count() == bookings_small.count()
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "_scaled" not in plan                           # the vectors are not made anew


def test_permutation_scores_only_rows_that_it_changes(bookings_small):
    from ratewise.operators.features import scaler_stats
    cols = COLS + ["is_holiday", "is_weekend"]
    train, test = M.chrono_split(M.model_table(bookings_small))
    stats = scaler_stats(train, cols)
    model = M.estimator("linear").fit(M.vectorize(train, [], cols)[0])
    scored = []

    class Spy:
        getFeaturesCol = staticmethod(model.getFeaturesCol)

        @staticmethod
        def transform(df):
            scored.append(df)
            return model.transform(df)
    imp = {r.feature: r for r in M.permutation_importance(Spy, test, cols, repeats=3, stats=stats).collect()}
    assert set(imp) == set(cols) and imp["is_holiday"].importance_mean == 0.0
    n, variants = test.count(), scored[-1].groupBy("fi").count().collect()
    by = {cols[r.fi]: r["count"] for r in variants}
    assert "is_holiday" not in by and by["is_weekend"] < 0.6 * 3 * n < by["competitor_avg_price"] <= 3 * n


def test_poly_fit_matches_numpy(spark):
    import datetime as dt
    t = np.arange(40)
    y = 3 + 0.5 * t - 0.02 * t ** 2 + 0.0004 * t ** 3
    s = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=int(i)), int(i), float(v))
                               for i, v in zip(t, y)], "ds date, t_days int, y double")
    model, t_max = S.poly_fit(s, 3)
    fc = S.forecast(s, model, t_max, 5).orderBy("ds").collect()
    expect = [3 + 0.5 * k - 0.02 * k ** 2 + 0.0004 * k ** 3 for k in range(40, 45)]
    assert [r.forecast for r in fc] == pytest.approx(expect, abs=1e-4)
