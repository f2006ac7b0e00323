"""Models: fit, evaluate, explain (M1-M24) with MLlib.

Training data is the feature table split chronologically (``is_test``);
features are the scaled model feature list (target-derived columns are kept
out by ``LEAKY_COLS``). Metrics are one aggregation over the prediction
column, so they work on any prediction -- a fitted model's, or a rule
price's.
"""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.functions.columns import fin
from ratewise.operators.clean import row_hash
from ratewise.operators.features import (
    FEATURE_COLS, LEAKY_COLS, engineer, label_encode, scaler_stats, standardize,
)

TARGET = "actual_price"
# the booking columns that the features are made from
SOURCE_COLS = ["checkin_date", "month", "day_of_week", "is_weekend", "is_holiday", "season", "hotel_name", "room_type",
               "channel", "guest_type", "lead_time_days", "length_of_stay", "base_price", "competitor_avg_price",
               "competitor_min_price", "competitor_max_price", "event_type", "event_magnitude", "weather_score",
               "reviews_score", "occupancy_rate", "demand_score", "repeat_guest", "actual_price", "revpar"]
SPLIT_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# MLlib grows no tree deeper than 30, and a tree of unlimited depth needs memory in
# proportion to its nodes on the driver; this is our setting, not the reference's.
FOREST_DEPTH = 10
# rows of a part of a written training table: at least (a pass over fewer costs more to
# start than to run) and at most (a part is held in memory as one block)
PART_ROWS, MOST_PART_ROWS = 20_000, 500_000
# --- fixed values: reference hyper-parameters ------------------------------
MODEL_PARAMS = {
    "linear": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 0.5, "max_iter": 5000},
    "tree": {"max_depth": 10},
    "forest": {"num_trees": 200, "min_leaf": 2, "max_depth": FOREST_DEPTH, "max_features": "all"},
    "gbt": {"n_iter": 200, "step": 0.08, "max_depth": 5},
    "gbt_sub": {"n_iter": 250, "step": 0.07, "max_depth": 6, "subsample": 0.85, "colsample": "0.8"},
}
SEARCH_SPACE = {"maxIter": [100, 150, 200, 300], "maxDepth": [3, 4, 5, 6, 7],
                "stepSize": [0.03, 0.05, 0.08, 0.10, 0.15], "subsamplingRate": [0.7, 0.8, 0.85, 0.9],
                "featureSubsetStrategy": ["0.6", "0.7", "0.8", "0.9"]}
# ---------------------------------------------------------------------------


def safe_features(cols: Sequence[str] = FEATURE_COLS) -> list[str]:
    """The model feature list with every target-derived column refused."""
    bad = [c for c in cols if c in LEAKY_COLS]
    if bad:
        raise ValueError(f"target-derived columns cannot be features: {bad}")
    return list(cols)


def model_table(bookings: DataFrame) -> DataFrame:
    """Bookings -> engineered + label-encoded table (unscaled)."""
    return label_encode(engineer(bookings))


def chrono_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1: train = ``is_test = 0``, test = ``is_test = 1``."""
    return df.filter(F.col("is_test") == 0), df.filter(F.col("is_test") == 1)


def random_split(df: DataFrame, frac: float = 0.8, seed: int = 42,
                 keys: Sequence[str] = SPLIT_KEYS) -> tuple[DataFrame, DataFrame]:
    """M2: stable 80/20 split from a hash of the row key (not ``randomSplit``,
    whose result depends on the partitioning)."""
    bucket = row_hash(keys, seed) % 100
    cut = int(round(frac * 100))
    return df.filter(bucket < cut), df.filter(bucket >= cut)


def fold_column(df: DataFrame, k: int = 5, seed: int = 42, keys: Sequence[str] = SPLIT_KEYS,
                name: str = "fold") -> DataFrame:
    """Fold id in [0, k) from the row-key hash (folds partition the rows)."""
    return df.withColumn(name, (row_hash(keys, seed) % k).cast("int"))


def vectorize(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str] = FEATURE_COLS,
              out: str = "features") -> tuple[DataFrame, list[DataFrame]]:
    """Scale with the *training* statistics, then assemble the vector."""
    cols = safe_features(cols)
    stats = scaler_stats(train, cols)
    scaled_cols = [f"{c}_scaled" for c in cols]
    asm = VectorAssembler(inputCols=scaled_cols, outputCol=out)

    def go(d):
        return asm.transform(standardize(d, cols, stats))
    return go(train), [go(o) for o in others]


def estimator(kind: str, label: str = TARGET, features: str = "features", seed: int = 42,
              n_rows: int | None = None, label_std: float | None = None, **override):
    """M3-M9: the MLlib estimator matching each reference model."""
    p = {**MODEL_PARAMS[kind], **override}
    common = {"featuresCol": features, "labelCol": label}
    if kind == "linear":
        return LinearRegression(solver="normal", regParam=0.0, **common)
    if kind == "ridge":
        # sklearn Ridge(alpha) == MLlib L2 with regParam = alpha * std_pop(y) / n, no standardization.
        reg = p["alpha"] * (label_std or 1.0) / (n_rows or 1)
        return LinearRegression(solver="normal", regParam=reg, elasticNetParam=0.0, standardization=False, **common)
    if kind == "lasso":
        return LinearRegression(regParam=p["alpha"], elasticNetParam=1.0, maxIter=p["max_iter"],
                                standardization=False, **common)
    if kind == "tree":
        return DecisionTreeRegressor(maxDepth=p["max_depth"], seed=seed, **common)
    if kind == "forest":
        return RandomForestRegressor(numTrees=p["num_trees"], minInstancesPerNode=p["min_leaf"],
                                     maxDepth=p["max_depth"], featureSubsetStrategy=p["max_features"],
                                     maxMemoryInMB=64, seed=seed, **common)
    if kind == "gbt":
        return GBTRegressor(maxIter=p["n_iter"], stepSize=p["step"], maxDepth=p["max_depth"], seed=seed, **common)
    if kind == "gbt_sub":
        return GBTRegressor(maxIter=p["n_iter"], stepSize=p["step"], maxDepth=p["max_depth"],
                            subsamplingRate=p["subsample"], featureSubsetStrategy=p["colsample"],
                            seed=seed, **common)
    raise ValueError(f"unknown model kind {kind}")


def metrics(df: DataFrame, y: str = TARGET, p: str = "prediction", floor: float = 1e-9) -> DataFrame:
    """MAE, RMSE, R2, MAPE (denominator floored at ``floor``), one pass."""
    err = F.col(y) - F.col(p)
    return df.agg(
        fin(F.avg(F.abs(err))).alias("mae"),
        fin(F.sqrt(F.avg(err * err))).alias("rmse"),
        fin(1 - F.sum(err * err) / (F.var_pop(y) * F.count(y))).alias("r2"),
        fin(F.avg(F.abs(err) / F.greatest(F.abs(F.col(y)), F.lit(floor))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n"))


def label_stats(train: DataFrame, y: str = TARGET) -> tuple[int, float]:
    row = train.agg(F.count(y).alias("n"), F.stddev_pop(y).alias("s")).first()
    return int(row["n"]), float(row["s"] or 0.0)


def fit_evaluate(kind: str, train: DataFrame, test: DataFrame, **override):
    """Fit one model on vectorized train, score test; returns (model, metrics DF)."""
    n, s = label_stats(train)
    est = estimator(kind, n_rows=n, label_std=s, **override)
    t0 = time.perf_counter()
    model = est.fit(train)
    secs = time.perf_counter() - t0
    m = metrics(model.transform(test)).withColumn("model", F.lit(kind)) \
        .withColumn("train_time_s", F.lit(round(secs, 3)))
    return model, m


def prepared_split(bookings: DataFrame, cols: Sequence[str] = FEATURE_COLS, even: bool = False):
    """Feature table written once (only keys, features, target and split flag), split,
    scaled with train stats. ``even``: the train rows as ``fit_rows``, for fits of many passes."""
    train, test = chrono_split(narrow_table(bookings, cols))
    train_v, (test_v,) = vectorize(train, [test], cols)
    return (fit_rows(train_v.select(*SPLIT_KEYS, TARGET, "features")) if even else train_v), test_v


def fit_rows(df: DataFrame) -> DataFrame:
    """``df`` written once in parts of even size. A fit of trees is a pass over all rows for
    each level of each round, with a task a part: every core gets one (or as many as
    every other), and small tables have few. The vectors are made once here, not in each pass
    that a fit makes before its rows are cached. ``df`` should be a scan of a written table."""
    from ratewise.session import cut_lineage
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    waves = math.ceil(n / (cores * MOST_PART_ROWS))
    parts = max(1, min(cores * waves, math.ceil(n / PART_ROWS)))
    return cut_lineage(df.repartition(parts))


def narrow_table(bookings: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """The columns that fits read, written once (lineage cut)."""
    from ratewise.session import cut_lineage
    return cut_lineage(model_table(bookings).select(*SPLIT_KEYS, *safe_features(cols), TARGET, "is_test"))


def whole_vectors(df: DataFrame, stats: dict, cols: Sequence[str] = FEATURE_COLS, scale: int = 10_000) -> DataFrame:
    """Adds ``vector``: the scaled features in whole 1/``scale`` of a standard
    deviation, so that squared distances are exact and ties are true ties."""
    scaled = standardize(df, safe_features(cols), stats)
    return scaled.withColumn("vector", F.array(*[F.floor(F.col(f"{c}_scaled") * scale + 0.5).cast("double") for c in cols])) \
                 .drop(*[f"{c}_scaled" for c in cols])


def knn_regression(bookings: DataFrame, k: int = 7, cols: Sequence[str] = FEATURE_COLS, **options) -> DataFrame:
    """Every test row's price as the mean of its ``k`` nearest train rows,
    weighted by 1 / distance over the scaled features (exact, see ``neighbours``)."""
    from ratewise.operators.neighbours import knn_join, weighted_value
    train, test = chrono_split(narrow_table(bookings, cols))
    stats = scaler_stats(train, cols)
    points = whole_vectors(train, stats, cols).select(*SPLIT_KEYS, TARGET, "vector")
    asked = whole_vectors(test, stats, cols).select(*SPLIT_KEYS, TARGET, "vector")
    found = knn_join(asked, points, k, "vector", SPLIT_KEYS, TARGET, **options)
    unit = 10_000.0
    return found.select(*SPLIT_KEYS, TARGET, weighted_value("neighbours", TARGET).alias("prediction"),
                        (F.sqrt(F.element_at("neighbours", 1)["d"]) / unit).alias("nearest"),
                        (F.sqrt(F.element_at("neighbours", -1)["d"]) / unit).alias("farthest"))


def leaderboard(kinds: Sequence[str], train: DataFrame, test: DataFrame, cv: Sequence[str] = (), folds: int = 5,
                workers: int = 3, **override) -> DataFrame:
    """Fit each model (``workers`` at a time) and rank by R2.

    ``cv``: the models that also get a cross-validated R2 (null for others). A
    model whose fit fails keeps a row, with its error and without figures.
    """
    from concurrent.futures import ThreadPoolExecutor
    spark = train.sparkSession
    empty = spark.createDataFrame([], "model string, mae double, rmse double, r2 double, mape double, n long, "
                                      "train_time_s double, cv_r2_mean double, cv_r2_std double, error string")

    def one(kind):
        try:
            _, m = fit_evaluate(kind, train, test, **override.get(kind, {}))
            m = spark.createDataFrame(m.collect(), m.schema)       # one row
            if kind in cv:
                m = m.join(cross_validate(kind, train, folds, **override.get(kind, {})).select("model", "cv_r2_mean", "cv_r2_std"), "model")
            return m
        except Exception as e:  # noqa: BLE001 -- recorded in the model's row
            return spark.createDataFrame([(kind, f"{type(e).__name__}: {e}"[:500])], "model string, error string")
    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(one, kinds))
    out = empty
    for m in parts:
        out = out.unionByName(m, allowMissingColumns=True)
    return out.orderBy(F.col("r2").desc_nulls_last(), "model")


def cross_validate(kind: str, df: DataFrame, k: int = 5, seed: int = 42, **override) -> DataFrame:
    """K-fold R2 mean and population std (folds from the key hash)."""
    from ratewise.session import cut_lineage
    folded = cut_lineage(fold_column(df, k, seed).select("features", TARGET, "fold"))

    def score(f):
        tr = folded.filter(F.col("fold") != f)
        n, s = label_stats(tr)
        model = estimator(kind, n_rows=n, label_std=s, **override).fit(tr)
        return metrics(model.transform(folded.filter(F.col("fold") == f))).first()["r2"]
    got = side_by_side({f: lambda f=f: score(f) for f in range(k)}, k)
    scores = [got[f] for f in range(k)]
    mean = sum(scores) / k
    std = (sum((x - mean) ** 2 for x in scores) / k) ** 0.5
    spark = df.sparkSession
    return spark.createDataFrame([(kind, k, float(mean), float(std))],
                                 "model string, folds int, cv_r2_mean double, cv_r2_std double")


def importances(model, cols: Sequence[str] = FEATURE_COLS, top: int = 20) -> DataFrame:
    """Tree feature importances, largest first."""
    vals = model.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(cols, vals), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame([(c, float(v)) for c, v in rows], "feature string, importance double")


def rank_models(results: DataFrame, metric: str, ascending: bool) -> DataFrame:
    """Rank of each model on one metric (1 = best)."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return results.withColumn(f"rank_{metric}", F.rank().over(Window.orderBy(order, F.col("model"))))


def best(results: DataFrame, metric: str = "r2", ascending: bool = False) -> DataFrame:
    """The best row by ``metric``."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return results.orderBy(order, F.col("model")).limit(1)


def side_by_side(jobs: dict, workers: int = 4) -> dict:
    """Runs the calls of ``jobs`` (name -> function without arguments), ``workers`` at a
    time, and returns their results by name. Fits of small nodes leave most of a cluster
    idle; Spark fills it with the stages of the others. The first error is raised."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(workers) as pool:
        running = {name: pool.submit(call) for name, call in jobs.items()}
        return {name: r.result() for name, r in running.items()}


def draws_from(space: dict, draws: int, seed: int = 42) -> list[dict]:
    """``draws`` different configurations of a search space, by a seeded sample."""
    combos = list(itertools.product(*space.values()))
    return [dict(zip(space, c)) for c in random.Random(seed).sample(combos, min(draws, len(combos)))]


def _search_schema(space: dict) -> str:
    kind = {float: "double", str: "string", int: "int"}
    return ", ".join(["draw int", *[f"{k} {kind[type(v[0])]}" for k, v in space.items()], "mean_test_score double"])


def random_search(df: DataFrame, draws: int = 20, folds: int = 3, seed: int = 42,
                  space: dict = SEARCH_SPACE, workers: int = 4) -> DataFrame:
    """``draws`` configurations sampled from ``space``, each scored by
    ``folds``-fold CV R2 of a gradient-boosted model. The fits (draws x folds) run side by
    side over one written table of features, target and fold."""
    picks = draws_from(space, draws, seed)
    folded = fit_rows(fold_column(df, folds, seed).select("features", TARGET, "fold"))

    def score(p, f):
        m = GBTRegressor(featuresCol="features", labelCol=TARGET, seed=seed, **p).fit(folded.filter(F.col("fold") != f))
        return metrics(m.transform(folded.filter(F.col("fold") == f))).first()["r2"]
    scores = side_by_side({(i, f): lambda p=p, f=f: score(p, f) for i, p in enumerate(picks) for f in range(folds)}, workers)
    rows = [(i, *p.values(), float(sum(scores[i, f] for f in range(folds)) / folds)) for i, p in enumerate(picks)]
    return df.sparkSession.createDataFrame(rows, _search_schema(space))


def formula_search(df: DataFrame, price, space: dict, draws: int = 20, folds: int = 3, seed: int = 42) -> DataFrame:
    """M18 for price formulas: ``price`` turns a configuration into a column, and
    every draw's R2 in every fold comes from one pass (a group a fold, a sum a draw)."""
    picks = draws_from(space, draws, seed)
    y = F.col(TARGET)
    sums = (fold_column(df, folds, seed).groupBy("fold")
            .agg((F.var_pop(y) * F.count(y)).alias("sst"),
                 *[F.sum((y - price(p)) * (y - price(p))).alias(f"sse_{i}") for i, p in enumerate(picks)]))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("draw"), *[F.lit(v).alias(k) for k, v in p.items()],
                                        (1 - F.col(f"sse_{i}") / F.col("sst")).alias("r2")) for i, p in enumerate(picks)]))
    return (sums.select(each.alias("d")).select("d.*").groupBy("draw", *space)
            .agg(fin(F.avg("r2")).alias("mean_test_score")))


def tuning_effects(results: DataFrame, param: str) -> DataFrame:
    """Mean CV score per value of one parameter."""
    return (results.groupBy(param).agg(fin(F.avg("mean_test_score")).alias("mean_score"),
                                       F.count(F.lit(1)).alias("n")).orderBy(param))


def top_draws(results: DataFrame, n: int = 15) -> DataFrame:
    """The best configurations of a search."""
    return results.orderBy(F.col("mean_test_score").desc(), "draw").limit(n)


def out_of_fold(train: DataFrame, base: Sequence[str], folds: int = 5, seed: int = 42, workers: int = 4, **override):
    """(predictions, models): ``p_<model>`` of every train row by the fit that left the row's
    fold out, with the row's keys, target and fold, written once; and every
    base model fitted on all rows. All fits run side by side."""
    from ratewise.session import cut_lineage
    folded = fit_rows(fold_column(train, folds, seed).select(*SPLIT_KEYS, TARGET, "features", "fold"))

    def fit(b, f):
        rows = folded if f is None else folded.filter(F.col("fold") != f)
        n, s = label_stats(rows)
        return estimator(b, n_rows=n, label_std=s, **override.get(b, {})).fit(rows)
    models = side_by_side({(b, f): lambda b=b, f=f: fit(b, f) for b in base for f in [None, *range(folds)]}, workers)
    parts = [predictions(folded.filter(F.col("fold") == f), {b: models[b, f] for b in base}) for f in range(folds)]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return (cut_lineage(oof.select(*SPLIT_KEYS, TARGET, "fold", *[f"p_{b}" for b in base])),
            {b: models[b, None] for b in base})


def predictions(df: DataFrame, models: dict) -> DataFrame:
    """``df`` with ``p_<name>`` of each model, in one pass."""
    for name, model in models.items():
        df = model.transform(df).withColumnRenamed("prediction", f"p_{name}")
    return df


def fit_stack(train: DataFrame, test: DataFrame, base: Sequence[str] = ("forest", "gbt", "tree"),
              folds: int = 5, seed: int = 42, workers: int = 4, **override) -> DataFrame:
    """Out-of-fold predictions of the base models feed a ridge meta-model. The
    test metrics of the stack and of each base model."""
    oof, models = out_of_fold(train, base, folds, seed, workers, **override)
    asm = VectorAssembler(inputCols=[f"p_{b}" for b in base], outputCol="meta_features")
    meta_rows = asm.transform(oof)
    n, sd = label_stats(meta_rows)
    meta = estimator("ridge", features="meta_features", n_rows=n, label_std=sd).fit(meta_rows)
    scored = meta.transform(asm.transform(predictions(test.select(TARGET, "features"), models)))
    out = metrics(scored, floor=1.0).withColumn("model", F.lit("stacking"))
    for b in base:
        out = out.unionByName(metrics(scored, p=f"p_{b}", floor=1.0).withColumn("model", F.lit(b)))
    return out


def learning_curve(df: DataFrame, kind: str = "gbt", sizes: int = 10, folds: int = 5,
                   seed: int = 42, workers: int = 4, **override) -> DataFrame:
    """train/validation R2 for growing nested train subsets (hash prefixes of one
    written table), the fits side by side."""
    from ratewise.session import cut_lineage
    folded = cut_lineage(fold_column(df, folds, seed).withColumn("_u", row_hash(SPLIT_KEYS, seed + 1) % 10000)
                         .select("features", TARGET, "fold", "_u"))
    fracs = {i: 0.1 + 0.9 * (i - 1) / max(sizes - 1, 1) for i in range(1, sizes + 1)}

    def score(i, f):
        tr = folded.filter((F.col("fold") != f) & (F.col("_u") < int(fracs[i] * 10000)))
        mdl = estimator(kind, **override).fit(tr)
        return [metrics(mdl.transform(x)).first()["r2"] for x in (tr, folded.filter(F.col("fold") == f))]
    got = side_by_side({(i, f): lambda i=i, f=f: score(i, f) for i in fracs for f in range(folds)}, workers)
    rows = [(i, fracs[i], f, *r2) for (i, f), r2 in got.items()]
    spark = df.sparkSession
    raw = spark.createDataFrame(rows, "size int, frac double, fold int, train_r2 double, val_r2 double")
    return (raw.groupBy("size", "frac")
            .agg(F.avg("train_r2").alias("train_mean"), F.stddev_pop("train_r2").alias("train_std"),
                 F.avg("val_r2").alias("val_mean"), F.stddev_pop("val_r2").alias("val_std"))
            .withColumn("bias", 1 - F.col("val_mean"))
            .withColumn("variance", F.col("train_mean") - F.col("val_mean"))
            .withColumn("final_gap", F.last("variance").over(Window.orderBy("size").rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)))       # ``sizes`` rows
            .orderBy("size"))


def permute_column(df: DataFrame, col: str, seed: int, keys: Sequence[str] = SPLIT_KEYS,
                   bucket_rows: int = 1024, n_rows: int | None = None) -> DataFrame:
    """Random permutation of one column's values among the rows.

    Rows are hashed into buckets of about ``bucket_rows``; inside a bucket,
    the i-th row by one hash order takes the value of the i-th row by a second
    hash order. Buckets are independent of the features, so the column's link
    to the target is broken while every value is kept exactly once; every
    window is partitioned by bucket, so no task holds more than a bucket.
    """
    n = n_rows or df.count()
    buckets = max(1, n // bucket_rows)
    b = (row_hash(keys, seed) % buckets).alias("_b")
    with_b = df.select("*", b, row_hash(keys, seed + 7).alias("_h1"), row_hash(keys, seed + 13).alias("_h2"))
    w1 = Window.partitionBy("_b").orderBy("_h1", *keys)
    w2 = Window.partitionBy("_b").orderBy("_h2", *keys)
    left = with_b.withColumn("_i", F.row_number().over(w1)).drop(col)
    right = with_b.select("_b", F.col(col), F.row_number().over(w2).alias("_i"))
    return left.join(right, ["_b", "_i"]).drop("_b", "_i", "_h1", "_h2")


def permutation_importance(model, test: DataFrame, cols: Sequence[str] = FEATURE_COLS,
                           repeats: int = 15, seed: int = 42, top: int = 20,
                           stats: dict | None = None, keys: Sequence[str] = SPLIT_KEYS,
                           bucket_rows: int = 1024, permute: Sequence[str] | None = None) -> DataFrame:
    """Mean and std of the R2 drop when one feature is permuted (all
    features, or only those in ``permute``).

    One scoring job for all ``len(cols) x repeats`` variants:

    1. the test rows are dealt once into hash buckets of ~``bucket_rows`` rows;
       per repeat, a bucket's rows in one hash order take as partners its rows
       in a second hash order (a permutation inside the bucket);
    2. each (row, repeat) pair is expanded to one variant per feature inside
       the scoring stage, with that feature's scaled value taken from the
       partner, and scored by the model. A variant whose partner has the row's own
       value is the row itself, so its error is the one that is known;
    3. changes of squared errors are summed per (feature, repeat) with partial
       aggregation, so only ``len(cols) x repeats`` partial rows are shuffled.
    """
    from pyspark.ml.functions import array_to_vector
    cols = list(cols)
    n = test.count()
    stats = stats or scaler_stats(test, cols)
    base = standardize(test, cols, stats).select(
        *keys, TARGET, F.array(*[F.col(f"{c}_scaled") for c in cols]).alias("xs"))
    base = base.withColumn("_row", row_hash(keys, seed + 101))
    err = F.col(TARGET) - F.col("prediction")
    base = (model.transform(base.withColumn(model.getFeaturesCol(), array_to_vector("xs")))
            .withColumn("_e", err * err).select(*keys, TARGET, "xs", "_row", "_e"))
    buckets = max(1, n // bucket_rows)
    dealt = (base.groupBy((row_hash(keys, seed) % buckets).alias("_b"))
             .agg(F.collect_list(F.struct("_row", F.col(TARGET).alias("y"), "xs", "_e")).alias("rows"))
             .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))))

    def order(salt):
        return F.array_sort(F.transform("rows", lambda x: F.struct(F.xxhash64(x["_row"], F.col("rep"), F.lit(salt)).alias("h"), x.alias("v"))))
    pairs = (dealt.select("rep", F.explode(F.zip_with(order(1), order(2), lambda a, b: F.struct(
                a["v"]["y"].alias(TARGET), a["v"]["xs"].alias("xs"), a["v"]["_e"].alias("_e"), b["v"]["xs"].alias("pxs")))).alias("p"))
             .select("rep", "p.*"))
    which = [cols.index(c) for c in permute] if permute is not None else list(range(len(cols)))
    changed = F.filter(F.array(*[F.lit(i) for i in which]), lambda i: F.col("xs")[i] != F.col("pxs")[i])
    variants = pairs.select("rep", TARGET, "xs", "pxs", "_e", F.explode(changed).alias("fi"))
    swapped = F.transform("xs", lambda x, i: F.when(i == F.col("fi"), F.col("pxs")[i]).otherwise(x))
    scored = model.transform(variants.withColumn(model.getFeaturesCol(), array_to_vector(swapped)))
    more = scored.groupBy("fi", "rep").agg(F.sum(err * err - F.col("_e")).alias("more"))
    tot = test.agg((F.var_pop(TARGET) * F.count(TARGET)).alias("sst"))
    spark = test.sparkSession
    every = spark.createDataFrame([(i, r) for i in which for r in range(repeats)], "fi int, rep int")
    drop = (every.join(more, ["fi", "rep"], "left").crossJoin(F.broadcast(tot))
            .select("fi", (F.coalesce("more", F.lit(0.0)) / F.col("sst")).alias("d")))
    names = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "fi int, feature string")
    out = (drop.groupBy("fi").agg(F.avg("d").alias("importance_mean"), F.stddev_pop("d").alias("importance_std"))
           .join(F.broadcast(names), "fi"))
    return (out.select("feature", fin("importance_mean").alias("importance_mean"),
                       fin("importance_std").alias("importance_std"))
            .orderBy(F.col("importance_mean").desc(), "feature").limit(top))


def importance_compare(builtin: DataFrame, permuted: DataFrame, top: int = 10) -> DataFrame:
    """Built-in vs permutation importance of the top features, side by side."""
    top_b = builtin.orderBy(F.col("importance").desc(), "feature").limit(top)
    return top_b.join(permuted, "feature", "left").orderBy(F.col("importance").desc())
