"""Registered model queries.

SQL-checkable model operators (split, metrics, ranking, residuals, best
pick) run on baseline price predictors that both engines can compute; the
MLlib fits are checked by row count here and by closed forms and invariants
in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.columns import fin
from ratewise.operators import aggregates as A
from ratewise.operators import models as M
from ratewise.operators import recommend as P
from ratewise.operators.features import FEATURE_COLS, scaler_stats, standardize
from ratewise.plans.catalog import query
from ratewise.plans.oracle import R, with_bookings
from ratewise.plans.q_aggregates import sql_histogram
from ratewise.plans.q_clean import _sql_hash
from ratewise.plans.q_features import ENC_CTE, FEAT_CTE, LABEL_MAP_CTE
from ratewise.plans.q_recommend import RULE_CTE, requests_from
from ratewise.sources.bookings import KEY_COLS, bookings, written_bookings

# Baseline predictors of the price: the rule price and the raw references.
BASELINES = ["rule_price", "competitor_avg_price", "competitor_min_price", "competitor_max_price", "base_price"]


def metrics_many(df: DataFrame, preds: list[str], y: str = "actual_price", floor: float = 1e-9) -> DataFrame:
    """M11 for several prediction columns in one pass, one row per predictor."""
    aggs = [F.var_pop(y).alias("_vy"), F.count(y).alias("_n")]
    for p in preds:
        err = F.col(y) - F.col(p)
        aggs += [F.avg(F.abs(err)).alias(f"{p}__mae"), F.avg(err * err).alias(f"{p}__mse"),
                 F.sum(err * err).alias(f"{p}__sse"),
                 F.avg(F.abs(err) / F.greatest(F.abs(F.col(y)), F.lit(floor))).alias(f"{p}__ape")]
    row = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(p).alias("model"), fin(F.col(f"{p}__mae")).alias("mae"), fin(F.sqrt(F.col(f"{p}__mse"))).alias("rmse"),
        fin(1 - F.col(f"{p}__sse") / (F.col("_vy") * F.col("_n"))).alias("r2"),
        fin(F.col(f"{p}__ape") * 100).alias("mape"), F.col("_n").alias("n")) for p in preds]))
    return row.select(rows.alias("m")).select("m.*")


def _sql_metrics(p, y="actual_price", src="ruled"):
    return (f"SELECT '{p}' AS model, {R(f'avg(abs({y} - {p}))')} AS mae, {R(f'sqrt(avg(({y} - {p}) * ({y} - {p})))')} AS rmse, "
            f"{R(f'1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y}))')} AS r2, "
            f"{R(f'avg(abs({y} - {p}) / greatest(abs({y}), 1e-9)) * 100')} AS mape, count({y}) AS n FROM {src}")


BASE_METRICS_CTE = "bm AS (" + " UNION ALL ".join(_sql_metrics(p) for p in BASELINES) + ")"


def _baseline_metrics(spark, d):
    return metrics_many(P.rule_price(bookings(spark, d)), BASELINES)


@query("m01_chrono_split", with_bookings("""
SELECT is_test, count(*) AS n, min(checkin_date) AS first_date, max(checkin_date) AS last_date
FROM bookings GROUP BY is_test"""))
def m01_chrono_split(spark, d):
    b = bookings(spark, d)
    return b.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.min("checkin_date").alias("first_date"),
                                    F.max("checkin_date").alias("last_date"))


_INT_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("m02_random_split", with_bookings(f"""
SELECT CAST(({_sql_hash(_INT_KEYS, 42)}) % 100 >= 80 AS INT) AS is_holdout, count(*) AS n,
       {R('avg(actual_price)')} AS avg_price FROM bookings GROUP BY 1"""))
def m02_random_split(spark, d):
    train, test = M.random_split(bookings(spark, d), 0.8, 42)
    t = train.agg(F.lit(0).alias("is_holdout"), F.count(F.lit(1)).alias("n"), fin(F.avg("actual_price")).alias("avg_price"))
    h = test.agg(F.lit(1).alias("is_holdout"), F.count(F.lit(1)).alias("n"), fin(F.avg("actual_price")).alias("avg_price"))
    return t.unionByName(h)


@query("m11_rule_metrics", with_bookings(_sql_metrics("rule_price"), RULE_CTE))
def m11_rule_metrics(spark, d):
    return metrics_many(P.rule_price(bookings(spark, d)), ["rule_price"])


@query("m11_baseline_metrics", with_bookings("SELECT * FROM bm", RULE_CTE, BASE_METRICS_CTE))
def m11_baseline_metrics(spark, d):
    return _baseline_metrics(spark, d)


@query("m15_rank_models", with_bookings("""
SELECT model, CAST(rank() OVER (ORDER BY r2 DESC, model) AS INT) AS rank_r2,
       CAST(rank() OVER (ORDER BY mae ASC, model) AS INT) AS rank_mae,
       CAST(rank() OVER (ORDER BY rmse ASC, model) AS INT) AS rank_rmse,
       CAST(rank() OVER (ORDER BY mape ASC, model) AS INT) AS rank_mape FROM bm""", RULE_CTE, BASE_METRICS_CTE))
def m15_rank_models(spark, d):
    res = _baseline_metrics(spark, d)
    for metric, asc in (("r2", False), ("mae", True), ("rmse", True), ("mape", True)):
        res = M.rank_models(res, metric, asc)
    return res.select("model", *[F.col(f"rank_{m}").cast("int").alias(f"rank_{m}") for m in ("r2", "mae", "rmse", "mape")])


@query("m16_residual_histogram", sql_histogram("actual_price - rule_price", 60, source="ruled", extra_ctes=(RULE_CTE,)))
def m16_residual_histogram(spark, d):
    r = P.rule_price(bookings(spark, d))
    return A.histogram(r, F.col("actual_price") - F.col("rule_price"), 60)


@query("m16_residual_summary", with_bookings(f"""
SELECT {R('avg(actual_price - rule_price)')} AS mean_residual, {R('stddev_samp(actual_price - rule_price)')} AS std_residual,
       count(*) AS n FROM ruled""", RULE_CTE))
def m16_residual_summary(spark, d):
    r = P.rule_price(bookings(spark, d))
    res = F.col("actual_price") - F.col("rule_price")
    return r.agg(fin(F.avg(res)).alias("mean_residual"), fin(F.stddev_samp(res)).alias("std_residual"),
                 F.count(F.lit(1)).alias("n"))


@query("m24_best_model", with_bookings("SELECT * FROM bm ORDER BY r2 DESC, model LIMIT 1", RULE_CTE, BASE_METRICS_CTE))
def m24_best_model(spark, d):
    return M.best(_baseline_metrics(spark, d), "r2")


def _written(spark, d):
    """What the models are made from, written once: label codes, features and the split read it."""
    return written_bookings(spark, d, *_INT_KEYS, *M.SOURCE_COLS, "is_test")


def _fit(kind):
    def run(spark, d):
        train, test = M.prepared_split(_written(spark, d), even=kind in ("forest", "gbt", "gbt_sub"))
        _, m = M.fit_evaluate(kind, train, test)
        return m
    run.__name__ = f"m_fit_{kind}"
    return run


for _code, _kind in (("m03", "linear"), ("m04", "ridge"), ("m05", "lasso"), ("m06", "tree"),
                     ("m07", "forest"), ("m08", "gbt"), ("m09", "gbt_sub")):
    query(f"{_code}_fit_{_kind}")(_fit(_kind))


_KEYS = ", ".join(_INT_KEYS)
_WHOLE = ", ".join(f"CASE WHEN {c}__s <> 0 THEN floor((coalesce(CAST({c} AS DOUBLE), 0e0) - {c}__m) / {c}__s * 10000 + 5e-1) ELSE 0e0 END"
                   for c in FEATURE_COLS)
_KNN_CTES = (FEAT_CTE, LABEL_MAP_CTE, ENC_CTE, "sc AS (SELECT " + ", ".join(
    f"avg(coalesce(CAST({c} AS DOUBLE), 0e0)) AS {c}__m, stddev_pop(coalesce(CAST({c} AS DOUBLE), 0e0)) AS {c}__s"
    for c in FEATURE_COLS) + " FROM enc WHERE is_test = 0)",
    f"vec AS (SELECT {_KEYS}, actual_price, is_test, CAST([{_WHOLE}] AS DOUBLE[{len(FEATURE_COLS)}]) AS v FROM enc, sc)",
    f"""near AS (SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, any_value(q.actual_price) AS actual_price,
              min({{d: array_distance(q.v, p.v), a: p.l_orderkey, b: p.l_linenumber, c: p.l_partkey, e: p.l_suppkey, y: p.actual_price}}, 7) AS n
         FROM vec q, vec p WHERE q.is_test = 1 AND p.is_test = 0 GROUP BY 1, 2, 3, 4)""",
    """used AS (SELECT *, CASE WHEN n[1].d = 0 THEN list_filter(n, lambda x: x.d = 0) ELSE n END AS u FROM near)""")
_KNN_PRICE = """list_sum(list_transform(u, lambda x: CASE WHEN x.d = 0 THEN x.y ELSE x.y / x.d END))
             / list_sum(list_transform(u, lambda x: CASE WHEN x.d = 0 THEN 1e0 ELSE 1 / x.d END))"""


@query("m10_knn", with_bookings(f"""
SELECT {_KEYS}, {R(_KNN_PRICE)} AS prediction, {R("n[1].d / 1e4")} AS nearest, {R("n[-1].d / 1e4")} AS farthest FROM used""", *_KNN_CTES))
def m10_knn(spark, d):
    """The price of every test row from its 7 nearest train rows."""
    out = M.knn_regression(_written(spark, d))
    return out.select(*_INT_KEYS, *[fin(c).alias(c) for c in ("prediction", "nearest", "farthest")])


@query("m10_knn_metrics")
def m10_knn_metrics(spark, d):
    """M11 of the k-nearest-neighbour predictions."""
    return M.metrics(M.knn_regression(_written(spark, d))).withColumn("model", F.lit("knn"))


@query("m12_cross_validate_linear")
def m12_cross_validate_linear(spark, d):
    train, _ = M.prepared_split(_written(spark, d))
    return M.cross_validate("linear", train, k=5)


@query("m12_cross_validate")
def m12_cross_validate(spark, d):
    """M12 for the models that fit in seconds, a row each."""
    train, _ = M.prepared_split(_written(spark, d))
    out = [M.cross_validate(k, train, k=5) for k in ("linear", "ridge", "lasso", "tree")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("m13_leaderboard")
def m13_leaderboard(spark, d):
    train, test = M.prepared_split(_written(spark, d), even=True)
    fast = ["linear", "ridge", "lasso", "tree"]
    return M.leaderboard([*fast, "forest", "gbt", "gbt_sub"], train, test, cv=fast)


# --- M18-M20 ---------------------------------------------------------------
# A pricing formula's weights; every draw is scored in every fold by one pass.
FORMULA_SPACE = {"w_comp": [0.0, 0.25, 0.5, 0.75, 1.0], "w_occ": [0.0, 0.1, 0.2, 0.3], "w_event": [0.0, 0.25, 0.5, 1.0],
                 "w_weekend": [0.0, 0.05, 0.1]}
_DRAWS = M.draws_from(FORMULA_SPACE, 20)


def formula_price(p: dict):
    """Base and competitor price blended, with premiums for occupancy, events and weekends."""
    blend = (1 - p["w_comp"]) * F.col("base_price") + p["w_comp"] * F.col("competitor_avg_price")
    return (blend * (1 + p["w_occ"] * (F.col("occupancy_rate") - 0.7)) * (1 + p["w_event"] * F.col("event_magnitude") / 10.0)
            * (1 + p["w_weekend"] * F.col("is_weekend")))


_SEARCH_CTES = (
    "dr(draw, w_comp, w_occ, w_event, w_weekend) AS (VALUES " + ", ".join(
        f"({i}, {', '.join(f'{v!r}e0' for v in p.values())})" for i, p in enumerate(_DRAWS)) + ")",
    f"""fo AS (SELECT actual_price AS y, base_price, competitor_avg_price, occupancy_rate, event_magnitude, is_weekend,
         CAST(({_sql_hash(_INT_KEYS, 42)}) % 3 AS INT) AS fold FROM bookings)""",
    """fr AS (SELECT draw, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) AS r2 FROM (
         SELECT draw, fold, y, ((1 - w_comp) * base_price + w_comp * competitor_avg_price) * (1 + w_occ * (occupancy_rate - 7e-1))
                * (1 + w_event * event_magnitude / 1e1) * (1 + w_weekend * is_weekend) AS p FROM fo, dr) t GROUP BY draw, fold)""",
    f"""search AS (SELECT dr.*, s.mean_test_score FROM dr JOIN (SELECT draw, {R('avg(r2)')} AS mean_test_score FROM fr GROUP BY draw) s
         USING (draw))""")


def _search(spark, d):
    return M.formula_search(bookings(spark, d), formula_price, FORMULA_SPACE)


@query("m18_formula_search", with_bookings("SELECT * FROM search", *_SEARCH_CTES))
def m18_formula_search(spark, d):
    """20 draws x 3 folds of a pricing formula."""
    return _search(spark, d)


@query("m19_tuning_effects", with_bookings(" UNION ALL ".join(
    f"SELECT '{k}' AS param, {k} AS setting, {R('avg(mean_test_score)')} AS mean_score, count(*) AS n FROM search GROUP BY {k}"
    for k in FORMULA_SPACE), *_SEARCH_CTES))
def m19_tuning_effects(spark, d):
    """Mean score by setting, for each parameter of the search."""
    from functools import reduce
    found = _search(spark, d)
    found = spark.createDataFrame(found.collect(), found.schema)        # a row a draw
    parts = [M.tuning_effects(found, k).select(F.lit(k).alias("param"), F.col(k).alias("setting"), "mean_score", "n")
             for k in FORMULA_SPACE]
    return reduce(DataFrame.unionByName, parts)


@query("m19_top_draws", with_bookings("SELECT * FROM search ORDER BY mean_test_score DESC, draw LIMIT 15", *_SEARCH_CTES))
def m19_top_draws(spark, d):
    return M.top_draws(_search(spark, d), 15)


# --- fixed values: reference hyper-parameters of the stack -------------------
STACK_PARAMS = {"forest": {"num_trees": 100, "min_leaf": 1}, "gbt": {"n_iter": 100, "step": 0.08, "max_depth": 5}, "tree": {"max_depth": 10}}
# ---------------------------------------------------------------------------


@query("m20_stacking")
def m20_stacking(spark, d):
    """Forest, boosting and tree stacked by a ridge model over 5 folds; their test metrics."""
    train, test = M.prepared_split(_written(spark, d), even=True)
    return M.fit_stack(train, test, **STACK_PARAMS)


@query("m17_tree_importances")
def m17_tree_importances(spark, d):
    train, test = M.prepared_split(_written(spark, d))
    model, _ = M.fit_evaluate("tree", train, test)
    return M.importances(model, FEATURE_COLS, 20)


@query("p02_model_price")
def p02_model_price(spark, d):
    """Price every completed request with a model trained on the bookings
    (features the request lacks are 0, as in the reference)."""
    from pyspark.ml.feature import VectorAssembler
    b = written_bookings(spark, d, *KEY_COLS, *M.SOURCE_COLS, "is_test")
    train, _ = M.chrono_split(M.narrow_table(b))
    stats = scaler_stats(train, FEATURE_COLS)
    asm = VectorAssembler(inputCols=[f"{c}_scaled" for c in FEATURE_COLS], outputCol="features")
    model = M.estimator("linear").fit(asm.transform(standardize(train, FEATURE_COLS, stats)))
    req = P.complete_requests(requests_from(b))
    missing = {c: F.lit(0) for c in FEATURE_COLS if c not in req.columns}
    scored = model.transform(asm.transform(standardize(req.withColumns(missing), FEATURE_COLS, stats)))
    ctx = P.price_context(scored.withColumn("model_price", fin("prediction", 2)), "model_price")
    return ctx.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "model_price",
                      "vs_base_pct", "vs_comp_pct", "expected_revenue")


def _perm_model(spark, d):
    """Gradient boosting (150 rounds, depth 5, rate 0.1) on the chronological
    train split, plus the test rows and the train scaling statistics."""
    train, test = M.chrono_split(M.narrow_table(_written(spark, d)))
    stats = scaler_stats(train, FEATURE_COLS)
    tv, (te,) = M.vectorize(train, [test], FEATURE_COLS)
    model = M.estimator("gbt", n_iter=150, max_depth=5, step=0.1).fit(M.fit_rows(tv.select(M.TARGET, "features")))
    return model, te, stats


@query("m22_permutation_importance")
def m22_permutation_importance(spark, d):
    model, te, stats = _perm_model(spark, d)
    return M.permutation_importance(model, te, FEATURE_COLS, repeats=15, seed=42, top=20, stats=stats)


@query("m23_importance_compare")
def m23_importance_compare(spark, d):
    model, te, stats = _perm_model(spark, d)
    builtin = M.importances(model, FEATURE_COLS, 10)
    top10 = [r.feature for r in builtin.collect()]
    perm = M.permutation_importance(model, te, FEATURE_COLS, repeats=15, seed=42, top=10,
                                    stats=stats, permute=top10)
    return M.importance_compare(builtin, perm, top=10)
