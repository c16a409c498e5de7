"""A random walk seen through noise, as folds over ordered arrays.

Observations are array<struct<y, q, r>>: the value, a factor on the process noise on the way into the step, and a factor
on its observation noise (null: 1). The first step starts from the prior without process noise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import fixed

from .arrays import bind

STATE = "array<struct<mean:double,var:double,ahead_mean:double,ahead_var:double>>"


def kalman_filter(observations: Column, *, process: float = fixed.PROCESS_NOISE, noise: float = fixed.OBSERVATION_NOISE, mean: float = fixed.FIRST_MEAN, var: float = fixed.FIRST_VARIANCE) -> Column:
    """Mean and variance after each observation, and before it (``ahead_*``, of the state, without observation noise)."""

    def step(acc: Column, x: Column) -> Column:
        before = F.try_element_at(acc, F.lit(-1))
        m = F.coalesce(before["mean"], F.lit(mean))
        p = F.coalesce(before["var"] + F.coalesce(x["q"], F.lit(1.0)) * process, F.lit(var))

        def update(s: Column) -> Column:
            gain = s["p"] / (s["p"] + F.coalesce(x["r"], F.lit(1.0)) * noise)
            return F.struct((s["m"] + gain * (x["y"] - s["m"])).alias("mean"), ((1 - gain) * s["p"]).alias("var"), s["m"].alias("ahead_mean"), s["p"].alias("ahead_var"))

        return F.concat(acc, F.array(bind(F.struct(m.alias("m"), p.alias("p")), update)))

    return F.aggregate(observations, F.array().cast(STATE), step)


def kalman_predict(states: Column, *, q: Column | None = None, r: Column | None = None, process: float = fixed.PROCESS_NOISE, noise: float = fixed.OBSERVATION_NOISE) -> Column:
    """Mean and variance of the next observation."""
    last = F.element_at(states, -1)
    factor = lambda c: F.lit(1.0) if c is None else F.coalesce(c, F.lit(1.0))
    return F.struct(last["mean"].alias("mean"), (last["var"] + factor(q) * process + factor(r) * noise).alias("var"))


def kalman_smooth(states: Column) -> Column:
    """Means and variances given all observations, in order (a backward pass over the filter's states)."""

    def step(acc: Column, s: Column) -> Column:
        later = acc["later"]
        gain = s["var"] / later["ahead_var"]
        mean = F.when(later.isNull(), s["mean"]).otherwise(s["mean"] + gain * (later["mean"] - later["ahead_mean"]))
        var = F.when(later.isNull(), s["var"]).otherwise(s["var"] + gain * gain * (later["var"] - later["ahead_var"]))
        done = F.struct(mean.alias("mean"), var.alias("var"), s["ahead_mean"].alias("ahead_mean"), s["ahead_var"].alias("ahead_var"))
        return bind(done, lambda d: F.struct(d.alias("later"), F.concat(F.array(F.struct(d["mean"].alias("mean"), d["var"].alias("var"))), acc["out"]).alias("out")))

    start = F.struct(F.lit(None).cast("struct<mean:double,var:double,ahead_mean:double,ahead_var:double>").alias("later"), F.array().cast("array<struct<mean:double,var:double>>").alias("out"))
    return F.aggregate(F.reverse(states), start, step)["out"]
