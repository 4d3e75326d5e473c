"""Stateful folds over ordered frames: what no window expresses, since each step needs the last step's result.

A session, or a part of it that nothing links with the rest, is the unit of state, as in the streaming twins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewright.config import DEFAULT, Config

BOX = ("cx", "cy", "w", "h")


State = dict[str, np.ndarray]


def lockstep(df: DataFrame, keys: list[str], order: str, columns: list[str], start: Callable[[int], State], step: Callable[[State, np.ndarray, State], State], schema: str, keep: list[str] | None = None) -> DataFrame:
    """A fold of each key's rows in the order of `order`, which is unique within a key; all keys of a partition take a
    step together, as arrays.

    start(n) makes the state of n fresh keys, arrays with a row a key. step(state, at, values) changes the rows `at` and
    returns the new columns of the step's rows. Rows come sorted by `order` first, so that a batch holds one step of
    many keys; the state is carried across batches, so memory grows with the keys of a partition and not with their rows.
    keep: further columns that go through as they are, so that nothing has to be joined back.
    """
    keep = keep or []
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[tuple, int] = {}
        state = start(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.array([slots.setdefault(k, len(slots)) for k in zip(*(batch[c].to_pylist() for c in keys))])
            if len(slots) > len(next(iter(state.values()))):
                fresh = start(len(slots))  # twice as many as there are at least
                state = {c: np.concatenate([v, fresh[c]]) for c, v in state.items()}
            when = batch[order].to_numpy()
            values = {c: batch[c].to_numpy(zero_copy_only=False).astype(float) for c in columns}
            cuts = np.concatenate(([0], np.flatnonzero(when[1:] != when[:-1]) + 1, [len(when)]))
            steps = [step(state, at[a:z], {c: v[a:z] for c, v in values.items()}) for a, z in zip(cuts, cuts[1:])]
            made = {c: np.concatenate([s[c] for s in steps]) for c in steps[0]}
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in [*keys, order, *keep]), *(pa.array(made[c], from_pandas=True) for c in names)], names=[*keys, order, *keep, *names])

    kept = df.select(*keys, order, *columns, *keep)
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in [*keys, order, *keep])
    return kept.repartition(*keys).sortWithinPartitions(order, *keys).mapInArrow(run, f"{kinds}, {schema}")


def ema(df: DataFrame, keys: list[str], order: str, x: str, alpha: float) -> DataFrame:
    """Exponential average of x up to each row, the first value as it is."""

    def step(state: State, at: np.ndarray, row: State) -> State:
        old = state["y"][at]
        state["y"][at] = np.where(np.isnan(old), row[x], old * (1 - alpha) + row[x] * alpha)
        return {"y": state["y"][at]}

    return lockstep(df, keys, order, [x], lambda n: {"y": np.full(n, np.nan)}, step, "y double")


def hysteresis(df: DataFrame, keys: list[str], order: str, vote: str, commit: int = 3) -> DataFrame:
    """Number of commits up to each row: a vote adds one, a missing vote takes one back (not below 0), `commit` votes
    commit and reset."""

    def step(state: State, at: np.ndarray, row: State) -> State:
        n = np.where(row[vote] > 0, state["n"][at] + 1, np.maximum(state["n"][at] - 1, 0))
        state["n"][at] = np.where(n >= commit, 0, n)
        state["swaps"][at] += n >= commit
        return {"swaps": state["swaps"][at]}

    return lockstep(df, keys, order, [vote], lambda n: {"n": np.zeros(n), "swaps": np.zeros(n, np.int64)}, step, "swaps long")


def keep_best(df: DataFrame, keys: list[str], at: str, then: list[str], conf: str, gap: int) -> DataFrame:
    """Events in the order of `at` and `then`: one less than `gap` after the last kept is dropped, or takes its place if
    its confidence is higher; the anchor moves with it.

    An event at least `gap` behind its neighbour starts anew whatever came before, so sessions are cut there, and a run
    between two cuts is a key of its own. Only numbers go through the fold; the last that took a place is looked up."""
    w = Window.partitionBy(*keys).orderBy(at, *then)
    cut = F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True))
    df = df.withColumns({"_n": F.row_number().over(w), "_cut": cut.cast("int")}).withColumn("_run", F.sum("_cut").over(w)).drop("_cut")

    def step(state: State, slot: np.ndarray, row: State) -> State:
        fresh = row["_at"] - state["anchor"][slot] >= gap
        taken = fresh | (row["_conf"] > state["conf"][slot])
        state["anchor"][slot] = np.where(taken, row["_at"], state["anchor"][slot])
        state["conf"][slot] = np.where(taken, row["_conf"], state["conf"][slot])
        state["cluster"][slot] += fresh
        return {"_cluster": state["cluster"][slot], "_taken": taken.astype(np.int64)}

    start = lambda n: {"anchor": np.full(n, -np.inf), "conf": np.zeros(n), "cluster": np.zeros(n, np.int64)}
    runs = df.select(*keys, "_run", "_n", F.col(at).alias("_at"), F.col(conf).alias("_conf"))
    told = lockstep(runs, [*keys, "_run"], "_n", ["_at", "_conf"], start, step, "_cluster long, _taken long")
    last = told.where("_taken = 1").groupBy(*keys, "_run", "_cluster").agg(F.max("_n").alias("_n")).select(*keys, "_n")
    return df.join(last, [*keys, "_n"], "left_semi").drop("_n", "_run")


def one_euro(df: DataFrame, keys: list[str], order: str, config: Config = DEFAULT) -> DataFrame:
    """Adaptive low-pass of x over the time t, as y: the faster the signal, the less it is smoothed. Where `known` is
    false the last smoothed value is held, and x stays as it is before there is one."""

    def weight(cutoff: np.ndarray, dt: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + 1.0 / (2.0 * math.pi * np.maximum(cutoff, 1e-6)) / dt)

    def start(n: int) -> State:
        return {"value": np.full(n, np.nan), "speed": np.zeros(n), "last": np.zeros(n)}

    def step(state: State, at: np.ndarray, row: State) -> State:
        value, speed, x, known = state["value"][at], state["speed"][at], row["x"], row["known"] > 0
        begun = ~np.isnan(value)
        dt = np.maximum(row["t"] - state["last"][at], 1e-6)
        a = weight(np.float64(config.euro_d_cutoff), dt)
        faster = a * (x - value) / dt + (1.0 - a) * speed
        a = weight(config.euro_min_cutoff + config.euro_beta * np.abs(faster), dt)
        moved = known & begun
        state["speed"][at] = np.where(moved, faster, speed)
        state["value"][at] = np.where(moved, a * x + (1.0 - a) * value, np.where(known, x, value))
        state["last"][at] = np.where(known, row["t"], state["last"][at])
        return {"y": np.where(known | begun, state["value"][at], x)}

    return lockstep(df, keys, order, ["t", "x", "known"], start, step, "y double")


def kalman_predict(x: np.ndarray, v: np.ndarray, cov: np.ndarray, config: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Centre, size and their covariance one frame on. The noises are diagonal, so each of the four numbers has a two by
    two covariance of its own: cov[..., 0] of the place, [..., 1] with the speed, [..., 2] of the speed."""
    drift = np.array(config.kalman_drift)
    return x + v, np.stack([cov[..., 0] + 2 * cov[..., 1] + cov[..., 2] + drift[:4], cov[..., 1] + cov[..., 2], cov[..., 2] + drift[4:]], -1)


def kalman_update(x: np.ndarray, v: np.ndarray, cov: np.ndarray, seen: np.ndarray, config: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gain, other = (cov[..., k] / (cov[..., 0] + np.array(config.kalman_noise)) for k in (0, 1))
    return x + gain * (seen - x), v + other * (seen - x), np.stack([(1 - gain) * cov[..., 0], (1 - gain) * cov[..., 1], cov[..., 2] - other * cov[..., 1]], -1)


def kalman_start(n: int, config: Config = DEFAULT) -> np.ndarray:
    place, speed = np.array(config.kalman_start[:4]), np.array(config.kalman_start[4:])
    return np.tile(np.stack([place, np.zeros(4), speed], -1), (n, 1, 1))


def kalman_track(df: DataFrame, keys: list[str], order: str, config: Config = DEFAULT) -> DataFrame:
    """Constant-velocity tracking of boxes (cx, cy, w, h; null where nothing was detected), with the frames since the
    last detection as `coast` and a confidence. From the third frame without one the speed is damped. Null before the
    first detection."""

    def start(n: int) -> State:
        return {"x": np.full((n, 4), np.nan), "v": np.zeros((n, 4)), "cov": kalman_start(n, config), "coast": np.zeros(n)}

    def step(state: State, at: np.ndarray, row: State) -> State:
        seen = np.stack([row[c] for c in BOX], -1)
        found = ~np.isnan(seen).any(1)
        seen[:, 2:] = np.maximum(seen[:, 2:], config.least_box)
        x, v, cov, coast = (state[c][at] for c in ("x", "v", "cov", "coast"))
        begun = ~np.isnan(x[:, 0])
        x, cov = np.where(begun[:, None], kalman_predict(x, v, cov, config)[0], x), np.where(begun[:, None, None], kalman_predict(x, v, cov, config)[1], cov)
        fused = kalman_update(x, v, cov, seen, config)
        coast = np.where(found | ~begun, 0, coast + 1)
        damped = np.where((coast >= config.damp_after)[:, None], v * config.damping, v)
        both, first = (begun & found)[:, None], (found & ~begun)[:, None]
        state["x"][at] = np.where(both, fused[0], np.where(first, seen, x))
        state["v"][at] = np.where(both, fused[1], damped)
        state["cov"][at] = np.where(both[..., None], fused[2], cov)
        state["coast"][at] = coast
        conf = np.where(np.isnan(state["x"][at][:, 0]), np.nan, np.maximum(0.0, 1 - config.coast_fade * coast))
        return {**{c: state["x"][at][:, k] for k, c in enumerate(BOX)}, "coast": coast.astype(np.int64), "conf": conf}

    return lockstep(df, keys, order, list(BOX), start, step, "cx double, cy double, w double, h double, coast long, conf double")
