"""Seasonal forecasts, hold-out error and metric ranking, one small model per series inside Spark groups.

A group is one regular weekly series, so it holds at most one row per calendar week. Spark spreads the groups.
"""

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions.records import null_nan, to_number_or_zero
from stockloom.operators.series import rank_metrics
from stockloom.operators.stats import mape, with_periodicity
from stockloom.schemas import MODEL_SCHEMA

# Seasonal lags in weeks offered by default.
SEASONAL_LAGS = (1, 2, 3, 4, 13, 26, 52)
# Mart columns that are ranked by periodicity and predictability.
MART_METRICS = (
    "current_sales_quantity",
    "last_week_quantity",
    "last_week_diff",
    "last_13_week_quantity",
    "last_13_week_diff",
    "last_year_quantity",
    "last_year_diff",
)
AR_BOUND, MA_BOUND = 1.0, 0.98
#: Steps of a fit at most.
ITERATIONS = 200
#: Series that are fitted together, and that are smoothed together: few enough for their grid of parameters to stay in a core's cache.
AT_ONCE = 512
SMOOTHED_AT_ONCE = 32
#: Columns up to which a filter takes all weeks at once.
FEW = 160
TRENDS = {"n": (), "c": (0,), "t": (1,), "ct": (0, 1)}


def _lag_poly(coefs, step):
    """Polynomial 1 + c1 B^step + c2 B^(2 step) + ... as an array."""
    poly = np.zeros(len(coefs) * step + 1)
    poly[0] = 1.0
    poly[step::step] = coefs
    return poly


def _inverse_filter(u, coefs, step):
    """Solve (1 + c1 B^step + ...) e = u with zero start values, for rows of u."""
    if not len(coefs):
        return u
    n = u.shape[-1]
    response = np.zeros(n)
    if len(coefs) == 1:
        response[::step] = (-coefs[0]) ** np.arange(len(response[::step]))
    else:
        response[0] = 1.0
        for t in range(step, n, step):
            response[t] = -sum(c * response[t - i * step] for i, c in enumerate(coefs, 1) if t >= i * step)
    return np.array([np.convolve(row, response)[:n] for row in np.atleast_2d(u)])


def _difference_poly(d, seasonal_d, lag):
    one = np.array([1.0, -1.0])
    season = _lag_poly([-1.0], lag)
    return reduce(np.convolve, [one] * d + [season] * seasonal_d, np.array([1.0]))


class _SeasonalFit:
    """Conditional-sum-of-squares fit of a seasonal ARIMA model to one series."""

    def __init__(self, y, order, seasonal, lag, trend):
        self.p, self.d, self.q = order
        self.sp, self.sd, self.sq = seasonal
        self.lag, self.trend = lag, TRENDS[trend]
        self.diff = _difference_poly(self.d, self.sd, lag)
        self.y = y
        self.w = np.convolve(y, self.diff, "valid")
        self.start = self.p + self.sp * lag

    def usable(self):
        free = self.p + self.q + self.sp + self.sq + len(self.trend)
        return len(self.w) - self.start > free + 1

    def _split(self, x):
        cuts = np.cumsum([self.p, self.sp, self.q])
        return np.split(x, cuts)

    def _ar(self, x):
        ar, sar, _, _ = self._split(x)
        return np.convolve(_lag_poly(-ar, 1), _lag_poly(-sar, self.lag))

    def _residuals(self, x):
        """Innovations for coefficients x, and the trend coefficients that suit them best."""
        _, _, ma, sma = self._split(x)
        u = np.convolve(self.w, self._ar(x), "valid")
        e = _inverse_filter(_inverse_filter(u, ma, 1), sma, self.lag)[0] if len(ma) + len(sma) else u
        if not self.trend:
            return e, np.zeros(0)
        t = np.arange(len(u), dtype=float) + 1
        design = np.array([t**k for k in self.trend])
        shaped = _inverse_filter(_inverse_filter(design, ma, 1), sma, self.lag)
        beta, *_ = np.linalg.lstsq(shaped.T, e, rcond=None)
        return e - beta @ shaped, beta

    def fit(self, iterations):
        """At most so many steps; `converged` tells whether a further one would have helped no more."""
        k = self.p + self.sp + self.q + self.sq
        bound = np.repeat([AR_BOUND, MA_BOUND], [self.p + self.sp, self.q + self.sq])
        x = np.zeros(k)
        e, beta = self._residuals(x)
        loss, damping = e @ e, 1e-2
        self.start_loss = float(loss)
        # Rounding noise of an exact differenced series is no information.
        floor = 1e-20 * max(1.0, float(self.y @ self.y))
        self.converged = loss <= floor or k == 0
        for _ in range(0 if self.converged else iterations):
            jac = np.empty((len(e), k))
            for i in range(k):
                h = -1e-5 if x[i] > 0 else 1e-5
                moved = x.copy()
                moved[i] += h
                jac[:, i] = (self._residuals(moved)[0] - e) / h
            gram, slope = jac.T @ jac, jac.T @ e
            better = False
            while damping < 1e8:
                move = np.linalg.solve(gram + damping * np.diag(np.diag(gram) + 1e-12), -slope)
                trial = np.clip(x + move, -bound, bound)
                e_new, beta_new = self._residuals(trial)
                if e_new @ e_new < loss:
                    better = True
                    break
                damping *= 4
            if not better:
                self.converged = True
                break
            gain = loss - e_new @ e_new
            x, e, beta, loss, damping = trial, e_new, beta_new, e_new @ e_new, max(damping / 4, 1e-8)
            if gain <= 1e-9 * loss or loss <= floor:
                self.converged = True
                break
        self.x, self.e, self.beta = x, e, beta
        return self

    def forecast(self, horizon):
        _, _, ma, sma = self._split(self.x)
        ar = self._ar(self.x)
        moving = np.convolve(_lag_poly(ma, 1), _lag_poly(sma, self.lag))
        w, e, y = list(self.w), list(self.e), list(self.y)
        for step in range(horizon):
            t = len(self.e) + step + 1
            value = sum(b * t**k for b, k in zip(self.beta, self.trend))
            value -= sum(c * w[-i] for i, c in enumerate(ar[1:], 1))
            value += sum(c * e[-i] for i, c in enumerate(moving[1:], 1) if i <= len(e))
            w.append(value)
            e.append(0.0)
            y.append(value - sum(c * y[-i] for i, c in enumerate(self.diff[1:], 1)))
        return np.array(y[-horizon:])


class _SeasonalFits:
    """_SeasonalFit without trend for many series at once: the same steps, with one array operation per week for all of them.

    Arrays are (week, series); shorter series have zeros in front, where innovations are zero too. `model` names order and lag."""

    def __init__(self, model, ys):
        self.model, self.n = model, len(ys)
        self.terms = np.flatnonzero(model.diff)
        ws = [np.convolve(y, model.diff, "valid") for y in ys]
        self.w = np.zeros((max(map(len, ws)), self.n))
        self.y = np.zeros((len(model.diff), self.n))
        for i, (y, w) in enumerate(zip(ys, ws)):
            self.w[len(self.w) - len(w) :, i] = w
            self.y[:, i] = y[-len(model.diff) :]
        self.empty = np.array([len(self.w) - len(w) for w in ws])
        self.floor = np.array([1e-20 * max(1.0, float(y @ y)) for y in ys])

    def _product(self, first, second):
        """(lag, coefficients) of (1 + a1 B + ...)(1 + c1 B^s + ...), rows of `first` and `second` being a and c."""
        found = {}
        for j, c in enumerate([1.0, *second]):
            for i, a in enumerate([1.0, *first]):
                at = i + j * self.model.lag
                found[at] = found.get(at, 0.0) + a * c
        return found

    def _residuals(self, x, w, empty):
        """Innovations (week, ..., series) of the series in the columns of w, for coefficients x (coefficient, ..., series)."""
        m = self.model
        ar, sar, ma, sma = m._split(x)
        rows, lag = len(w) - m.start, m.lag
        w = w.reshape(len(w), *[1] * (x.ndim - 2), -1)
        e = np.zeros((rows, *x.shape[1:]))
        term = np.empty_like(e)
        for at, c in self._product(-ar, -sar).items():
            e += np.multiply(c, w[m.start - at : m.start - at + rows], out=term)
        for row in range(min(rows, int(empty.max()))):
            e[row, ..., empty > row] = 0.0
        self._unfolded(e, ma, 1, term)
        self._unfolded(e, sma, lag, term)
        return e

    @staticmethod
    def _unfolded(e, coefs, step, spare):
        """Solve (1 + c1 B^step + ...) x = e in place with zero start values: week by week, or, where few series leave little to do in a
        week, one coefficient by its powers 1, 2, 4, ... over all weeks at once."""
        rows = len(e)
        if len(coefs) == 1 and e[0].size <= FEW:
            power = -coefs[0]
            while step < rows:
                e[step:] += np.multiply(power, e[:-step], out=spare[step:])
                power, step = power * power, 2 * step
            return
        for t in range(step, rows, step) if len(coefs) else ():
            here = e[t : t + step]
            for i in range(min(t // step, len(coefs))):
                before = t - (i + 1) * step
                here -= np.multiply(coefs[i], e[before : before + len(here)], out=spare[: len(here)])

    def fit(self, iterations):
        m, n = self.model, self.n
        k = m.p + m.sp + m.q + m.sq
        bound = np.repeat([AR_BOUND, MA_BOUND], [m.p + m.sp, m.q + m.sq])[:, None]
        x = np.zeros((k, n))
        e = self._residuals(x, self.w, self.empty)
        loss, damping = (e * e).sum(0), np.full(n, 1e-2)
        self.start_loss = loss.copy()
        self.converged = (loss <= self.floor) | (k == 0)
        for _ in range(iterations):
            on = np.flatnonzero(~self.converged)
            if not len(on):
                break
            h = np.where(x[:, on] > 0, -1e-5, 1e-5)
            moved = np.repeat(x[:, None, on], k, 1)
            moved[np.arange(k), np.arange(k)] += h
            w, empty, e_on = self.w[:, on], self.empty[on], e[:, on]
            jac = self._residuals(moved, w, empty)
            jac -= e_on[:, None]
            jac /= h
            gram, slope = np.empty((len(on), k, k)), np.empty((len(on), k))
            for i in range(k):
                slope[:, i] = np.einsum("tb,tb->b", jac[:, i], e_on)
                for j in range(i + 1):
                    gram[:, i, j] = gram[:, j, i] = np.einsum("tb,tb->b", jac[:, i], jac[:, j])
            diagonal = np.einsum("bii->bi", gram)
            left = np.arange(len(on))  # places in `on` that no step has helped so far
            while True:
                left = left[damping[on[left]] < 1e8]
                if not len(left):
                    break
                at = on[left]
                ridge = damping[at][:, None] * (diagonal[left] + 1e-12)
                move = np.linalg.solve(gram[left] + ridge[:, :, None] * np.eye(k), -slope[left][:, :, None])[:, :, 0].T
                trial = np.clip(x[:, at] + move, -bound, bound)
                e_new = self._residuals(trial, w if len(left) == len(on) else w[:, left], empty[left])
                loss_new = (e_new * e_new).sum(0)
                better = loss_new < loss[at]
                took, now = at[better], loss_new[better]
                gain = loss[took] - now
                x[:, took], e[:, took], loss[took] = trial[:, better], e_new[:, better], now
                self.converged[took] = (gain <= 1e-9 * now) | (now <= self.floor[took])
                damping[took] = np.maximum(damping[took] / 4, 1e-8)
                left = left[~better]
                damping[on[left]] *= 4
            self.converged[on[damping[on] >= 1e8]] = True
        self.x, self.e, self.loss = x, e, loss
        return self

    def forecast(self, horizon):
        """(horizon, series)."""
        m = self.model
        ar, sar, ma, sma = m._split(self.x)
        past, moving = self._product(-ar, -sar), self._product(ma, sma)
        w, e, y = ([*rows] for rows in (self.w, self.e, self.y))
        for _ in range(horizon):
            value = np.zeros(self.n)
            for at, c in past.items():
                value -= c * w[-at] if at else 0.0
            for at, c in moving.items():
                value += c * e[-at] if 0 < at <= len(e) else 0.0
            w.append(value)
            e.append(np.zeros(self.n))
            y.append(value - sum(m.diff[at] * y[-at] for at in self.terms if at))
        return np.array(y[-horizon:])


def _fit_all(ys, lag, order, seasonal, trend, horizon, iterations):
    """Per series: status, forecasts, rss and start_rss, the last three None when it is too short."""
    seasonal = seasonal if lag > 1 else (0, 0, 0)
    models = [_SeasonalFit(y, order, seasonal, lag, trend) if len(y) and not np.isnan(y).any() else None for y in ys]
    usable = [i for i, m in enumerate(models) if m is not None and len(m.y) >= len(m.diff) and m.usable()]
    out = [("too_short", None, None, None)] * len(ys)
    if TRENDS[trend] or horizon < 1:
        for i in usable:
            m = models[i]
            ahead = m.fit(iterations).forecast(horizon)
            out[i] = "ok" if m.converged else "not_converged", ahead.tolist(), float(m.e @ m.e), m.start_loss
        return out
    # Series of like length stand together, so that little is filled up.
    usable.sort(key=lambda i: len(ys[i]))
    for start in range(0, len(usable), AT_ONCE):
        some = usable[start : start + AT_ONCE]
        fits = _SeasonalFits(models[some[0]], [ys[i] for i in some]).fit(iterations)
        ahead = fits.forecast(horizon)
        for j, i in enumerate(some):
            out[i] = "ok" if fits.converged[j] else "not_converged", ahead[:, j].tolist(), float(fits.loss[j]), float(fits.start_loss[j])
    return out


def _fill_gaps(y):
    """Linear interpolation over missing weeks, and how many there were."""
    missing = np.isnan(y)
    if missing.any() and not missing.all():
        at = np.arange(len(y))
        y = np.interp(at, at[~missing], y[~missing])
    return y, int(missing.sum())


def _spread(df, columns, parallelism):
    """One hash partitioning by the group columns with a fixed number of partitions.

    Model fits cost much time on few bytes, so the partitions must not be merged by size. Executors may still be joining when this is
    read, so there are never fewer than the session's shuffle partitions.
    """
    spark = df.sparkSession
    n = parallelism or max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns) if columns else df.repartition(1)


def seasonal_forecast(
    df,
    keys,
    date="week_start",
    value="sales",
    lags=SEASONAL_LAGS,
    horizon=12,
    order=(1, 1, 1),
    seasonal=(1, 1, 1),
    trend="n",
    parallelism=None,
    iterations=ITERATIONS,
    with_fit=False,
):
    """Forecast of the next `horizon` weeks per key and seasonal lag.

    Expects a regular weekly series. Lag 1 has no seasonal part. Columns: keys, lag, date, forecast, interpolated (missing
    weeks filled for the fit) and status: `ok`, `not_converged` if the fit was still improving after `iterations` steps, or
    `too_short` with NULL forecasts. `with_fit` adds the sums of squared innovations of the fit, `rss`, and of the model without
    coefficients that it starts from, `start_rss`.
    """
    lags = sorted({int(k) for k in lags})
    if not lags or lags[0] < 1:
        raise ValueError("lags must be whole weeks, at least 1")
    if trend not in TRENDS:
        raise ValueError(f"trend must be one of {list(TRENDS)}")
    if len(order) != 3 or len(seasonal) != 3 or min((*order, *seasonal)) < 0:
        raise ValueError("order and seasonal are three numbers, none negative")
    keys = list(keys)
    kinds = [df.schema[k] for k in keys]
    fitted = "status string, ahead array<double>, interpolated int, rss double, start_rss double"
    schema = T.StructType([*kinds, T.StructField("_lag", T.IntegerType()), T.StructField("_last", T.DateType()), *T.StructType.fromDDL(fitted).fields])

    def fit_all(frames):
        for frame in frames:
            filled = [_fill_gaps(np.asarray(y, dtype=float)) for y in frame["_y"]]
            out = frame.drop(columns="_y").assign(status="too_short", ahead=None, interpolated=[gaps for _, gaps in filled], rss=None, start_rss=None)
            rows = np.empty((len(frame), 4), object)
            for lag, at in frame.groupby("_lag").indices.items():
                for i, found in zip(at, _fit_all([filled[i][0] for i in at], int(lag), order, seasonal, trend, horizon, iterations)):
                    rows[i] = found
            for i, name in enumerate(("status", "ahead", "rss", "start_rss")):
                out[name] = rows[:, i]
            yield out[schema.names]

    # A series is one array of at most one value per calendar week, made before the fits of its lags are spread.
    each = F.explode(F.array(*[F.lit(k) for k in lags])).alias("_lag")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v"))))
    series = df.groupBy(*keys).agg(pairs.alias("_p")).filter(F.size("_p") > 0)
    arrays = series.select(*keys, F.to_date(F.element_at("_p", -1)["d"]).alias("_last"), F.transform("_p", lambda p: p["v"]).alias("_y"))
    wide = _spread(arrays.select(*keys, each, "_last", "_y"), [*keys, "_lag"], parallelism)
    found = wide.mapInPandas(fit_all, schema).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return found.select(
        *keys,
        F.col("_lag").alias("lag"),
        F.expr("date_add(_last, 7 * _step)").alias("date"),
        F.try_element_at("ahead", F.col("_step")).alias("forecast"),
        "interpolated",
        "status",
        *(["rss", "start_rss"] if with_fit else []),
    )


def fit_models(df, keys, date="week_start", value="sales", lag=12, order=(1, 1, 1), seasonal=(1, 1, 1), trend="n", parallelism=None, iterations=ITERATIONS):
    """One fitted model per key, ready for the model registry: start and end year of the data, the coefficients and the
    complete model state as a blob that `forecast_model` continues from. Missing weeks and text that is no number count as 0.
    """
    if trend not in TRENDS:
        raise ValueError(f"trend must be one of {list(TRENDS)}")
    keys = list(keys)
    schema = T.StructType(
        [
            *[df.schema[k] for k in keys],
            *[f for f in MODEL_SCHEMA.fields if f.name != "created_at"],
        ]
    )

    def fit_one(group_keys, pdf):
        pdf = pdf.sort_values(date)
        years = pd.to_datetime(pdf[date]).dt.year
        model = _SeasonalFit(pdf[value].to_numpy(dtype=float), order, seasonal, lag, trend)
        out = dict(zip(keys, group_keys))
        out.update(start_year=int(years.min()), end_year=int(years.max()), params=None, model_blob=None)
        if model.usable():
            model.fit(iterations)
            ar, sar, ma, sma = model._split(model.x)
            named = {"ar": ar, "seasonal_ar": sar, "ma": ma, "seasonal_ma": sma, "trend": model.beta}
            out["params"] = {f"{k}{i}": float(c) for k, v in named.items() for i, c in enumerate(v, 1)}
            state = {"y": model.y.tolist(), "x": model.x.tolist(), "order": order, "seasonal": seasonal, "lag": lag}
            out["model_blob"] = json.dumps({**state, "trend": trend}).encode()
        return pd.DataFrame([out], columns=schema.names)

    clean = df.select(*keys, date, to_number_or_zero(F.col(value)).alias(value))
    return _spread(clean, keys, parallelism).groupBy(*keys).applyInPandas(fit_one, schema)


def forecast_model(blob, horizon=12):
    """Continue the series of a stored model; one number per week."""
    state = json.loads(blob)
    model = _SeasonalFit(np.array(state["y"]), state["order"], state["seasonal"], state["lag"], state["trend"])
    model.x = np.array(state["x"])
    model.e, model.beta = model._residuals(model.x)
    return model.forecast(horizon)


def _smooth(ys, periods, alpha, beta, gamma):
    """Additive Holt-Winters for many series, the longest first, with a row of parameter sets each; either all have a period or none.

    Gives squared error, and level, trend and season at the end, per series and set. Each week is one array operation for all series
    that reach it."""
    sizes, each = np.array([len(y) for y in ys]), np.arange(len(ys))
    seen_at = np.zeros((sizes[0], len(ys), 1))
    for i, y in enumerate(ys):
        seen_at[: len(y), i, 0] = y
    seasonal = bool(periods[0])
    if seasonal:
        season = np.zeros((len(ys), max(periods), alpha.shape[1]))
        slope, level = np.empty((2, len(ys), 1))
        for i, (y, m) in enumerate(zip(ys, periods)):
            first, second = y[:m].mean(), y[m : 2 * m].mean()
            slope[i] = (second - first) / m
            level[i] = first - slope[i] * (m + 1) / 2
            season[i, :m] = (y[:m] - first - slope[i] * (np.arange(m) - (m - 1) / 2))[:, None]
    else:
        season, slope = np.zeros((len(ys), 1, alpha.shape[1])), seen_at[1] - seen_at[0]
        level = seen_at[0] - slope
    level, trend = (np.broadcast_to(start, alpha.shape).copy() for start in (level, slope))
    loss = np.zeros(alpha.shape)
    keep_alpha, keep_beta, keep_gamma = 1 - alpha, 1 - beta, 1 - gamma
    periods = np.maximum(periods, 1)
    reach = (sizes[None, :] > np.arange(sizes[0])[:, None]).sum(1)
    for t, k in enumerate(reach):
        at = each[:k], t % periods[:k]
        seen, s = seen_at[t, :k], season[at] if seasonal else 0.0
        base = level[:k] + trend[:k]
        loss[:k] += (seen - base - s) ** 2
        new = alpha[:k] * (seen - s) + keep_alpha[:k] * base
        trend[:k] = beta[:k] * (new - level[:k]) + keep_beta[:k] * trend[:k]
        if seasonal:
            season[at] = gamma[:k] * (seen - base) + keep_gamma[:k] * s
        level[:k] = new
    return loss, level, trend, season


def _smooth_ahead(ys, periods, horizons, weights=None):
    """Forecasts of series as _smooth takes them, with the given smoothing parameters or those of least squared error, by a grid that is
    refined three times."""
    each = np.arange(len(ys))
    centre, width = np.full((3, len(ys)), 0.5), 0.5
    best = np.full(len(ys), np.inf)
    ends = None
    for _ in range(4 if weights is None else 1):
        if weights is None:
            axes = [np.clip(np.linspace(c - width, c + width, 5, axis=1), 0.0, 1.0) for c in centre]
            if not periods[0]:
                axes[2] = np.zeros((len(ys), 1))
            grid = np.array(np.broadcast_arrays(axes[0][:, :, None, None], axes[1][:, None, :, None], axes[2][:, None, None, :]))
            grid = grid.reshape(3, len(ys), -1)
        else:
            grid = np.repeat(np.array(weights, dtype=float).reshape(3, 1, 1), len(ys), axis=1)
        loss, level, trend, season = _smooth(ys, periods, *grid)
        pick = np.nanargmin(loss, axis=1) if weights is None else np.zeros(len(ys), int)
        found = [level[each, pick], trend[each, pick], season[each, :, pick]]
        better = loss[each, pick] <= best
        if ends is None:
            better[:] = True
            ends = [np.empty_like(f) for f in found]
        for end, f in zip(ends, found):
            end[better] = f[better]
        best[better] = loss[each, pick][better]
        centre[:, better] = grid[:, each, pick][:, better]
        width /= 3
    out = []
    for y, period, horizon, level, trend, season in zip(ys, periods, horizons, *ends):
        steps = np.arange(1, horizon + 1)
        out.append(level + steps * trend + season[(len(y) + steps - 1) % (period or 1)])
    return out


def _holdout_forecasts(train_frac, weights):
    """Column function: forecasts of the last values of a series, NaN where too few come before them."""

    def of(values: pd.Series, periods: pd.Series) -> pd.Series:
        out, alike = [None] * len(values), {}
        for i, (y, period) in enumerate(zip(values, periods)):
            cut = int(len(y) * train_frac)
            period = int(period) if pd.notna(period) and 1 < period < cut else 0
            if cut < max(2, 2 * period):
                out[i] = np.full(len(y) - cut, np.nan)
            else:
                alike.setdefault(period > 0, []).append((i, np.asarray(y[:cut], dtype=float), period, len(y) - cut))
        for series in alike.values():
            series.sort(key=lambda one: -len(one[1]))
            for start in range(0, len(series), SMOOTHED_AT_ONCE):
                at, ys, periods, horizons = zip(*series[start : start + SMOOTHED_AT_ONCE])
                for i, ahead in zip(at, _smooth_ahead(ys, periods, horizons, weights)):
                    out[i] = ahead
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<double>")


def holdout_predictions(df, keys, order, value, periods=None, train_frac=0.8, parallelism=None, weights=None):
    """The last rows of each series (after int(n * train_frac)) with their smoothed forecast, NULL when the fit fails.

    The period is the column `period_weeks`, of the frame itself or of `periods` by key; without either there is no season. The
    seasonal part is used when 1 < period < length of the training part; with fewer than two full periods to train on there is
    no forecast. The weights of level, trend and season are those of least squared error, unless `weights` gives the three.
    """
    keys = list(keys)
    if periods is not None:
        state = periods.select(*keys, "period_weeks")
        df = df.join(state, keys, "left") if keys else df.withColumn("period_weeks", state.scalar())
    period = F.col("period_weeks") if "period_weeks" in df.columns else F.lit(None)
    clean = df.select(
        *keys, order, F.col(value).cast("double").alias(value), period.cast("int").alias("_period")
    ).filter(F.col(value).isNotNull())
    # A series is one array, in the order of its rows; rows without a place in the order come last.
    row = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("at"), F.col(value).alias("v"), F.col("_period").alias("period"))
    series = _spread(clean, keys, parallelism).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    period = F.try_element_at("_rows", F.lit(1))["period"]
    ahead = _holdout_forecasts(train_frac, weights)(F.transform("_rows", lambda r: r["v"]), period)
    found = series.select(*keys, "_rows", ahead.alias("_ahead"))
    tested = F.slice("_rows", F.size("_rows") - F.size("_ahead") + 1, F.size("_ahead"))
    pairs = F.zip_with(tested, "_ahead", lambda r, p: F.struct(r["at"].alias(order), null_nan(r["v"]).alias("actual"), null_nan(p).alias("predicted")))
    return found.select(*keys, F.inline(pairs))


def assess_predictability(df, keys, order, value, periods=None, train_frac=0.8):
    """MAPE of the hold-out forecast per key; NULL when the model cannot be fitted."""
    return mape(holdout_predictions(df, keys, order, value, periods, train_frac), "actual", "predicted", keys)


def analyze_metrics(df, metrics=MART_METRICS, order="date", keys=(), max_lag=52, min_length=10):
    """Period, strength, hold-out MAPE and ranks of each metric, within each key. Series shorter than ten are left out."""
    keys = list(keys)
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    long = df.select(*keys, order, F.inline(F.array(*pairs)))
    series = [*keys, "metric"]
    points = with_periodicity(long, series, order, "value", max_lag).filter(F.col("n") >= min_length)
    # Period and strength are the same on all rows of a series, so they can be carried as keys.
    described = [*series, "period_weeks", "periodicity_strength"]
    held_out = holdout_predictions(points, described, order, "value")
    return rank_metrics(mape(held_out, "actual", "predicted", described), keys)
