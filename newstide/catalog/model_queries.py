"""Queries over model input, predictions, forecasts and their quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newstide.catalog.bindings import daily, obs, predictions, sql
from newstide.catalog.registry import query, rounded
from newstide.catalog.series_queries import CMP, WE, rows
from newstide.functions.scores import grade, outlook, with_band
from newstide.operators import evaluate as E
from newstide.operators import forecast as P
from newstide.operators import scaling as C
from newstide.operators import sequences as Q
from newstide.operators import trees as T
from newstide.operators.asof import align_predictions
from newstide.operators.rules import insight_reliable
from newstide.operators.sets import eligible_entities, keep_entities, latest
from newstide.operators.skew import stored
from newstide.operators.windows import series, trailing_mean
from newstide.plans.report import analysis_report

MEASURES = """count(*) as n, avg((predicted - actual) ** 2) as mse, avg(abs(predicted - actual)) as mae,
  sqrt(avg((predicted - actual) ** 2)) as rmse, 1 - avg((predicted - actual) ** 2) / var_pop(actual) as r2,
  avg(abs((predicted - actual) / actual)) as mape"""
ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in ("mse", "mae", "rmse", "r2", "mape"))
METRICS = f"metrics as (select entity, model, {MEASURES} from predictions group by entity, model)"


def _metrics(spark, sf):
    return E.regression_metrics(predictions(spark, sf), ["entity", "model"])


@query("regression_metrics", sql(f"select entity, model, n, {ROUNDED} from metrics", "predictions", METRICS))
def _(spark, sf):
    return rounded(_metrics(spark, sf))


@query(
    "prediction_errors",
    sql(
        """select entity, d, model, round(actual, 6) as actual, round(predicted, 6) as predicted, round(predicted - actual, 6) + 0e0 as error,
        round(abs(predicted - actual), 6) as abs_error from predictions""",
        "predictions",
    ),
)
def _(spark, sf):
    return rounded(E.with_errors(predictions(spark, sf)))


@query(
    "direction_accuracy",
    sql(
        """select entity, model, round(100 * avg(case when a = p then 1e0 else 0e0 end), 6) as direction_pct, count(*) as steps from (
          select entity, model, sign(actual - lag(actual) over w) as a, sign(predicted - lag(predicted) over w) as p from predictions
          window w as (partition by entity, model order by d)) where a is not null group by 1, 2""",
        "predictions",
    ),
)
def _(spark, sf):
    return rounded(E.direction_accuracy(predictions(spark, sf), ["entity", "model"]))


@query(
    "threshold_accuracy",
    sql(
        """select entity, model, round(100 * avg(case when abs(predicted - actual) <= 0.1 then 1e0 else 0e0 end), 6) as within_pct
        from predictions group by 1, 2""",
        "predictions",
    ),
)
def _(spark, sf):
    return rounded(E.threshold_accuracy(predictions(spark, sf), ["entity", "model"]))


@query(
    "model_means",
    sql("select model, round(avg(r2), 6) as r2, round(avg(mae), 6) as mae, round(avg(rmse), 6) as rmse from metrics group by model", "predictions", METRICS),
)
def _(spark, sf):
    return rounded(E.model_means(_metrics(spark, sf)))


@query(
    "best_models",
    sql(
        """select entity, round(r2, 6) as r2, model from metrics qualify row_number() over (partition by entity order by r2 desc, model desc) = 1
        union all select entity, r2, model from (select 'overall: ' || entity as entity, round(r2, 6) as r2, model from metrics
          order by metrics.r2 desc, model desc, entity desc limit 1)""",
        "predictions",
        METRICS,
    ),
)
def _(spark, sf):
    metrics = _metrics(spark, sf)
    overall = E.best_models(metrics, []).withColumn("entity", F.concat(F.lit("overall: "), "entity"))
    return rounded(E.best_models(metrics).select("entity", "r2", "model").unionByName(overall))


@query(
    "model_leaderboard",
    sql(
        f"""select entity, model, n, {ROUNDED}, cast(row_number() over (partition by entity order by r2 desc, model) as int) as place,
          case when r2 > 0.8 then 'very good' when r2 > 0.6 then 'good' when r2 > 0.4 then 'fair' when r2 > 0.2 then 'ordinary'
            else 'needs work' end as grade from metrics""",
        "predictions",
        METRICS,
    ),
)
def _(spark, sf):
    board = E.model_leaderboard(_metrics(spark, sf))
    return rounded(board.withColumn("grade", grade(F.col("r2"))))


@query("reliable_models", sql("select entity, model, round(r2, 6) as r2 from metrics where r2 > -0.2", "predictions", METRICS))
def _(spark, sf):
    return rounded(insight_reliable(_metrics(spark, sf), -0.2).select("entity", "model", "r2"))


@query(
    "metric_drift",
    sql(
        f"""select entity, model, period, n, {ROUNDED}, round(mae - lag(mae) over (partition by entity, model order by period), 6) + 0e0 as mae_change,
          coalesce(r2 >= 0.75, false) as on_target
        from (select entity, model, cast(date_trunc('year', d) as date) as period, {MEASURES} from predictions group by 1, 2, 3)""",
        "predictions",
    ),
)
def _(spark, sf):
    return rounded(E.metric_drift(predictions(spark, sf), "year", ["entity", "model"]))


HISTORY = """history as (select entity, cast(row_number() over (partition by entity order by m) as int) as epoch, val_loss from (
  select entity, date_trunc('month', d) as m, avg((predicted - actual) ** 2) as val_loss from predictions where model = 'ma7' group by 1, 2))"""


@query(
    "best_epoch",
    sql(
        """select entity, cast(first(epoch order by val_loss, epoch) as int) as best_epoch, round(min(val_loss), 6) as best_val_loss,
          max(epoch) as last_epoch, min(case when epoch - since >= 15 then epoch end) as stop_epoch,
          cast(max(epoch) - first(epoch order by val_loss, epoch) as int) as epochs_since_best
        from (select *, max(case when before is null or val_loss < before then epoch end) over (partition by entity order by epoch) as since
          from (select *, min(val_loss) over (partition by entity order by epoch rows between unbounded preceding and 1 preceding) as before
            from history)) group by entity""",
        "predictions",
        HISTORY,
    ),
)
def _(spark, sf):
    """The monthly loss of a naive forecaster read as a training history."""
    monthly = (
        predictions(spark, sf)
        .where(F.col("model") == "ma7")
        .groupBy("entity", F.trunc("d", "MM").alias("m"))
        .agg(F.avg((F.col("predicted") - F.col("actual")) ** 2).alias("val_loss"))
    )
    epoch = F.row_number().over(Window.partitionBy("entity").orderBy("m"))
    return rounded(E.best_epoch(monthly.select("entity", epoch.alias("epoch"), "val_loss")))


@query(
    "minmax_scaled",
    sql(
        """select entity, d, round((score_mean - s0) / (s1 - s0), 6) as score_mean, round((n_items - n0) / (n1 - n0), 6) as n_items,
          round(score_mean, 6) as restored from daily join (select entity as e, min(score_mean) as s0, max(score_mean) as s1,
            cast(min(n_items) as double) as n0, cast(max(n_items) as double) as n1 from daily group by 1) on entity = e""",
        "daily",
    ),
)
def _(spark, sf):
    cols = ["score_mean", "n_items"]
    series = daily(spark, sf).select("entity", "d", *cols)
    bounds = C.minmax_bounds(series, cols, ["entity"])
    scaled = C.minmax(series, bounds, cols, ["entity"]).withColumn("restored", F.col("score_mean"))
    return rounded(C.unscale(scaled, bounds, "restored", "score_mean", ["entity"]))


@query(
    "minmax_fit_on_train",
    sql(
        """select entity, d, round((score_mean - lo) / case when hi = lo then 1 else hi - lo end, 6) + 0e0 as score_mean, split from cut
        join (select entity as e, min(score_mean) as lo, max(score_mean) as hi from cut where split = 'train' group by 1) on entity = e""",
        "daily",
        """cut as (select entity, d, score_mean, case when row_number() over (partition by entity order by d)
          <= floor(count(*) over (partition by entity) * 0.8) then 'train' else 'test' end as split from daily)""",
    ),
)
def _(spark, sf):
    cut = Q.temporal_split(daily(spark, sf).select("entity", "d", "score_mean"))
    bounds = C.minmax_bounds(cut, ["score_mean"], ["entity"], F.col("split") == "train")
    return rounded(C.minmax(cut, bounds, ["score_mean"], ["entity"]))


@query(
    "robust_scaled",
    sql(
        """select entity, d, round((score_mean - q2) / case when q3 = q1 then 1 else q3 - q1 end, 6) + 0e0 as score_mean,
          round((n_items - m2) / case when m3 = m1 then 1 else m3 - m1 end, 6) + 0e0 as n_items
        from daily join (select entity as e, quantile_cont(score_mean, 0.25) as q1, quantile_cont(score_mean, 0.5) as q2,
          quantile_cont(score_mean, 0.75) as q3, quantile_cont(n_items, 0.25) as m1, quantile_cont(n_items, 0.5) as m2,
          quantile_cont(n_items, 0.75) as m3 from daily group by 1) on entity = e""",
        "daily",
    ),
)
def _(spark, sf):
    return rounded(C.robust_scale(daily(spark, sf).select("entity", "d", "score_mean", "n_items"), ["score_mean", "n_items"], ["entity"]))


FEATURES = ["score_mean", "score_std", "n_items", "positive_ratio"]


@query(
    "sequences",
    sql(
        f"""select entity, d, round(list_sum(a), 6) as x_sum, round(a[1], 6) as x_first, round(a[-1], 6) as x_last, cast(len(a) as int) as x_len,
          round(score_mean, 6) as y from (select *, list(score_mean) over ({WE} rows between 30 preceding and 1 preceding) as a,
          row_number() over ({WE}) as rn from daily) where rn > 30""",
        "daily",
    ),
)
def _(spark, sf):
    seq = Q.sequences(daily(spark, sf), FEATURES, "score_mean", 30)
    first = F.transform("x", lambda v: F.get(v, F.lit(0)))
    return rounded(
        seq.select(
            "entity",
            "d",
            F.aggregate(first, F.lit(0.0), lambda a, v: a + v).alias("x_sum"),
            F.get(first, F.lit(0)).alias("x_first"),
            F.element_at(first, -1).alias("x_last"),
            F.size("x").alias("x_len"),
            "y",
        )
    )


@query(
    "sequence_splits",
    sql(
        """select entity, split, count(*) as n, min(d) as first_day, max(d) as last_day from (
          select entity, d, case when rn <= floor(n * 0.6) then 'train' when rn <= floor(n * 0.8) then 'validation' else 'test' end as split
          from (select entity, d, row_number() over (partition by entity order by d) as rn, count(*) over (partition by entity) as n
            from (select *, row_number() over (partition by entity order by d) as r from daily) where r > 4)) group by 1, 2""",
        "daily",
    ),
)
def _(spark, sf):
    seq = Q.sequences(daily(spark, sf), ["score_mean"], "score_mean", 4).select("entity", "d", "y")
    parts = (("train", 0.6), ("validation", 0.2), ("test", 0.2))
    return Q.sequence_summary(Q.temporal_split(seq, parts))


@query(
    "global_split",
    sql(
        """select split, count(*) as n, min(d) as first_day, max(d) as last_day from (select d,
          case when rn <= floor(n * 0.6) then 'train' when rn <= floor(n * 0.8) then 'validation' else 'test' end as split
          from (select d, row_number() over (order by d, entity) as rn, count(*) over () as n from daily)) group by 1""",
        "daily",
    ),
)
def _(spark, sf):
    parts = (("train", 0.6), ("validation", 0.2), ("test", 0.2))
    cut = Q.temporal_split(daily(spark, sf).select("entity", "d"), parts, by=(), tie=["entity"])
    return Q.sequence_summary(cut, [])


AR = f"""ar as (select entity, regr_intercept(score_mean, x) as b0, regr_slope(score_mean, x) as b1
  from (select entity, d, score_mean, lag(score_mean) over ({WE}) as x from daily) group by entity)"""


@query("ar1_model", sql("select entity, round(b0, 6) as intercept, round(b1, 6) as slope from ar", "daily", AR))
def _(spark, sf):
    return rounded(P.fit_ar1(daily(spark, sf), "score_mean"))


@query(
    "ar1_backtest",
    sql(
        f"""select entity, n, {ROUNDED} from (select entity, {MEASURES} from (
          select entity, score_mean as actual, b0 + b1 * x as predicted from (select entity, score_mean, lag(score_mean) over ({WE}) as x from daily)
          join ar using (entity) where x is not null) group by entity)""",
        "daily",
        AR,
    ),
)
def _(spark, sf):
    series = daily(spark, sf)
    return rounded(E.regression_metrics(P.ar1_predictions(series, P.fit_ar1(series, "score_mean"), "score_mean"), ["entity"]))


AR_PATH = """path as (with recursive f as (select entity, d0, 1 as step, b0 + b1 * y0 as predicted, b0, b1 from start
   union all select entity, d0, step + 1, b0 + b1 * predicted, b0, b1 from f where step < 30)
  select entity, cast(d0 + step as date) as d, step, predicted from f)"""
AR_START = "start as (select entity, max(d) as d0, arg_max(score_mean, d) as y0, any_value(b0) as b0, any_value(b1) as b1 from daily join ar using (entity) group by entity)"


def _forecast(spark, sf):
    series = daily(spark, sf)
    return P.forecast_ar1(latest(series, "score_mean", ["entity"]), P.fit_ar1(series, "score_mean"), "score_mean", 30)


@query(
    "forecast_with_band",
    sql(
        """select entity, d, cast(step as int) as step, round(predicted, 6) as predicted, round(predicted - 0.2, 6) as band_low,
        round(predicted + 0.2, 6) as band_high from path""",
        "daily",
        AR,
        AR_START,
        AR_PATH,
    ),
)
def _(spark, sf):
    return rounded(with_band(_forecast(spark, sf), "predicted"))


@query(
    "forecast_summary",
    sql(
        """select entity, round(avg(predicted), 6) as forecast_mean, round(min(predicted), 6) as forecast_min, round(max(predicted), 6) as forecast_max,
          round(stddev_samp(predicted), 6) as forecast_std, round(any_value(y0), 6) as current, round(avg(predicted) - any_value(y0), 6) + 0e0 as change,
          case when avg(predicted) - any_value(y0) > 0.1 then 'improve' when avg(predicted) - any_value(y0) < -0.1 then 'worsen' else 'stable' end as outlook
        from path join start using (entity) group by entity""",
        "daily",
        AR,
        AR_START,
        AR_PATH,
    ),
)
def _(spark, sf):
    last = latest(daily(spark, sf), "score_mean", ["entity"])
    summary = P.forecast_summary(_forecast(spark, sf), last, "score_mean")
    return rounded(summary.withColumn("outlook", outlook(F.col("change"))))


@query(
    "aligned_predictions",
    sql(
        f"""select entity, d, round(ma7, 6) as predicted, round(score_mean, 6) as actual from (select entity, d, avg(score_mean) over ({WE} {rows(6)}) as ma7
        from daily) join daily using (entity, d)""",
        "daily",
    ),
)
def _(spark, sf):
    base = daily(spark, sf)
    pred = base.select("entity", "d", trailing_mean("score_mean", 7, series(["entity"])).alias("predicted"))
    return rounded(align_predictions(pred, base.select("entity", "d", F.col("score_mean").alias("actual"))))


def _linear(spark, sf):
    series = daily(spark, sf)
    seq = Q.temporal_split(Q.sequences(series, ["score_mean", "positive_ratio"], "score_mean", 4))
    return series, seq, P.fit_linear(seq.where(F.col("split") == "train"))


LIN_X = ", ".join(f"lag({c}, {k}) over ({WE})" for k in (4, 3, 2, 1) for c in ("score_mean", "positive_ratio"))
#: Normal equations of nine weights, solved by elimination down the diagonal (they are positive definite).
LIN = f"""lin as (select entity, d, score_mean as y, [1e0, {LIN_X}] as z, row_number() over ({WE}) as r from daily),
 cutlin as (select entity, d, y, z, row_number() over ({WE}) <= floor(count(*) over (partition by entity) * 0.8) as train from lin where r > 4),
 gram as (select entity, i, list(v order by j) as row_i from (select entity, i, j, sum(z[i] * list_concat(z, [y])[j]) + case when i = j then 1e-8 else 0 end as v
   from cutlin, range(1, 10) a(i), range(1, 11) b(j) where train group by entity, i, j) group by entity, i),
 matrix as (select entity, list(row_i order by i) as m from gram group by entity),
 solved as (with recursive e as (select entity, 0 as k, m from matrix
   union all select entity, k + 1, list_transform(range(1, 10), lambda i: case when i = k + 1 then p else list_transform(range(1, 11), lambda j: m[i][j] - m[i][k + 1] * p[j]) end)
     from (select entity, k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) as p from e where k < 9))
   select entity, list_transform(m, lambda r: r[10]) as b from e where k = 9)"""


@query(
    "linear_backtest",
    sql(
        f"""select entity, n, {ROUNDED} from (select entity, {MEASURES} from (select entity, y as actual, list_inner_product(z, b) as predicted
        from cutlin join solved using (entity) where not train) group by entity)""",
        "daily",
        LIN,
    ),
)
def _(spark, sf):
    """Least squares on four-row windows: fitted on the first 80 % of each series, measured on the rest."""
    _, seq, model = _linear(spark, sf)
    return rounded(E.regression_metrics(P.linear_predictions(seq.where(F.col("split") == "test"), model), ["entity"]))


@query(
    "linear_forecast",
    sql(
        "select entity, cast(d0 + step as date) as d, cast(step as int) as step, round(p, 6) + 0e0 as predicted from rolled",
        "daily",
        LIN,
        f"""lastlin as (select entity, d as d0, list_concat(z[4:], [y, ratio]) as x from (select lin.*, positive_ratio as ratio from lin join daily using (entity, d))
          qualify row_number() over (partition by entity order by d desc) = 1)""",
        """rolled as (with recursive g as (select entity, d0, b, x, 0 as step, 0e0 as p from lastlin join solved using (entity)
          union all select entity, d0, b, list_concat(x[3:], [y, x[8]]), step + 1, y
            from (select *, list_inner_product(list_concat([1e0], x), b) as y from g where step < 30)) select * from g where step > 0)""",
    ),
)
def _(spark, sf):
    series, _, model = _linear(spark, sf)
    window = P.last_window(series, ["score_mean", "positive_ratio"], 4)
    return rounded(P.forecast_linear(window, model, 30))


@query("tree_backtest")
def _(spark, sf):
    seq = Q.temporal_split(Q.sequences(daily(spark, sf), FEATURES, "score_mean", 7))
    model = P.fit_trees(seq.where(F.col("split") == "train"), maxIter=5, maxDepth=3)
    return rounded(E.regression_metrics(P.tree_predictions(seq.where(F.col("split") == "test"), model), ["entity"]))


def _tree_parts(spark, sf):
    """Seven-row windows of the series long enough to train on, cut into train, validation and test along time."""
    series = keep_entities(daily(spark, sf), eligible_entities(daily(spark, sf)))
    parts = (("train", 0.6), ("validation", 0.2), ("test", 0.2))
    return series, stored(Q.temporal_split(Q.sequences(series, FEATURES, "score_mean", 7), parts), "tree-windows")


TREES = {"maxIter": 12, "maxDepth": 3, "stepSize": 0.3}


@query("tree_rounds")
def _(spark, sf):
    """Loss of each boosting round on each part; the round with the least validation loss is marked."""
    _, seq = _tree_parts(spark, sf)
    kept, losses = T.fit_best_trees(seq, **TREES)
    return losses.withColumn("best", F.col("round") == len(kept.roots))


@query("best_tree_backtest")
def _(spark, sf):
    _, seq = _tree_parts(spark, sf)
    kept, _ = T.fit_best_trees(seq, **TREES)
    return E.regression_metrics(T.score_rows(seq.where(F.col("split") == "test"), kept), ["entity"])


@query("tree_forecast")
def _(spark, sf):
    """Thirty days ahead, each prediction fed back into the window."""
    series, seq = _tree_parts(spark, sf)
    kept, _ = T.fit_best_trees(seq, **TREES)
    return T.forecast_trees(P.last_window(series, FEATURES, 7), kept, 30)


LAG2 = f"""lag2 as (select entity, d, score_mean as y, lag(score_mean, 1) over ({WE}) as x1, lag(score_mean, 2) over ({WE}) as x2 from daily
   qualify lag(score_mean, 2) over ({WE}) is not null),
 cut2 as (select *, row_number() over ({WE}) <= floor(count(*) over (partition by entity) * 0.8) as train from lag2),
 cov2 as (select entity, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, y) as s1, covar_pop(x2, y) as s2,
   avg(x1) as m1, avg(x2) as m2, avg(y) as my from cut2 where train group by entity),
 ols2 as (select entity, b1, b2, my - b1 * m1 - b2 * m2 as b0 from (select *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) as b1,
   (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) as b2 from cov2))"""


def _two_lags(spark, sf):
    series = daily(spark, sf)
    seq = Q.temporal_split(Q.sequences(series, ["score_mean"], "score_mean", 2))
    return series, seq, P.fit_linear(seq.where(F.col("split") == "train"))


@query(
    "two_lag_backtest",
    sql(
        f"""select entity, n, {ROUNDED} from (select entity, {MEASURES} from (select entity, y as actual, b0 + b1 * x1 + b2 * x2 as predicted
        from cut2 join ols2 using (entity) where not train) group by entity)""",
        "daily",
        LAG2,
    ),
)
def _(spark, sf):
    _, seq, model = _two_lags(spark, sf)
    return rounded(E.regression_metrics(P.linear_predictions(seq.where(F.col("split") == "test"), model), ["entity"]))


@query(
    "two_lag_forecast",
    sql(
        """select entity, cast(d0 + step as date) as d, cast(step as int) as step, round(p, 6) as predicted from f2""",
        "daily",
        LAG2,
        f"""ends as (select entity, d as d0, score_mean as y1, before as y2 from (select *, lag(score_mean) over ({WE}) as before from daily)
          qualify row_number() over (partition by entity order by d desc) = 1)""",
        """f2 as (with recursive g as (select entity, d0, 1 as step, b0 + b1 * y1 + b2 * y2 as p, y1 as q, b0, b1, b2 from ends join ols2 using (entity)
          union all select entity, d0, step + 1, b0 + b1 * p + b2 * q, p, b0, b1, b2 from g where step < 30) select * from g)""",
    ),
)
def _(spark, sf):
    series, _, model = _two_lags(spark, sf)
    return rounded(P.forecast_linear(P.last_window(series, ["score_mean"], 2), model, 30))


def _tidy_sql(section: str, entity: str, cells: dict[str, str], source: str) -> str:
    return " union all ".join(
        f"select '{section}' as section, {entity} as entity, '{m}' as metric, round(cast({e} as double), 6) + 0e0 as value from {source}"
        for m, e in cells.items()
    )


@query(
    "analysis_report",
    sql(
        " union all ".join(
            [
                _tidy_sql("overview", "'ALL'", {"n": "count(*)", "mean_score": "avg(score)", "std_score": "stddev_samp(score)"}, "obs"),
                _tidy_sql("labels", "label", {"n": "n", "pct": "pct"}, "lab"),
                _tidy_sql(
                    "entities",
                    "entity",
                    {c: c for c in ("n", "share_pct", "mean_score", "std_score", "positive_ratio", "negative_ratio")},
                    "cmp",
                ),
                _tidy_sql("model", "entity", {"mse": "mse", "mae": "mae", "r2": "r2"}, "metrics where model = 'ma7'"),
                _tidy_sql("trend", "entity", {"first": "f", "last": "l", "size": "abs(l - f)"}, "trend"),
                _tidy_sql("volatility", "entity", {"monthly": "v"}, "vol"),
                _tidy_sql("outlook", "entity", {"current": "y0", "mean": "m", "change": "m - y0"}, "outl"),
            ]
        ),
        "predictions",
        METRICS,
        CMP,
        "lab as (select label, count(*) as n, 100e0 * count(*) / (select count(*) from obs) as pct from obs group by 1)",
        """trend as (select entity, arg_min(m, y) as f, arg_max(m, y) as l from (select entity, year(d) as y, avg(score) as m from obs
          group by 1, 2) group by 1)""",
        """vol as (select entity, avg(s) as v from (select entity, date_trunc('month', d) as m, stddev_samp(score) as s from obs group by 1, 2)
          group by 1)""",
        AR,
        AR_START,
        AR_PATH,
        "outl as (select entity, avg(predicted) as m, any_value(y0) as y0 from path join start using (entity) group by 1)",
    ),
)
def _(spark, sf):
    naive = predictions(spark, sf).where(F.col("model") == "ma7")
    return rounded(analysis_report(obs(spark, sf), naive))
