"""Baselines under update regimes, as closed loops: a decision gates the update that the next decision rests on.

All regimes run side by side in one pass over an entity's windows, each with a baseline, a watch for poisoning and a
recovery of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recursions import WARM, streamed

#: Whether a window that is not frozen out may update, by (detected, attack).
REGIMES = {
    "frozen_audit": lambda detected, attack: False,
    "conjunction_benign": lambda detected, attack: not detected and not attack,
    "production_episode": lambda detected, attack: not detected,
    "attack_skip": lambda detected, attack: not attack,
}


@dataclass(frozen=True)
class Guard:
    """Poison protection: ``count`` changes of the mean by more than ``rate`` within ``window`` seconds freeze a baseline
    until ``recovery`` seconds later.  The defaults are fixed values."""

    rate: float = 2.0
    window: float = 300.0
    count: int = 10
    recovery: float = 900.0


@dataclass
class Loop:
    """One regime's state: mean, variance and count; the mean of the window before, the count of large changes since
    ``since``, and since when the baseline is frozen."""

    mean: float = 0.0
    var: float = 0.0
    n: int = 0
    last: float | None = None
    since: float | None = None
    changes: int = 0
    frozen_at: float | None = None

    def score(self, x: float) -> float:
        if self.n < WARM:
            return 0.0
        deviation = max(self.var**0.5, 0.02 * self.mean if self.mean > 50 else 1.0)
        return min(max((x - self.mean) / deviation, -100.0), 100.0)

    def recover(self, t: float, calm: bool, guard: Guard) -> None:
        if self.frozen_at is not None and calm and t - self.frozen_at >= guard.recovery:
            self.frozen_at, self.changes, self.since = None, 0, None

    def update(self, x: float, alpha: float) -> None:
        d = x - self.mean
        self.mean, self.var = (self.mean + alpha * d, (1 - alpha) * (self.var + alpha * d * d)) if self.n else (x, 0.0)
        self.n += 1

    def watch(self, t: float, guard: Guard) -> None:
        """Count a change of the mean between two windows; means under 1 are too small to judge."""
        if self.since is None or t - self.since > guard.window:
            self.since, self.changes, self.last = t, 0, self.mean
        if self.frozen_at is None and self.n >= WARM:
            if self.last >= 1 and abs(self.mean - self.last) / self.last > guard.rate:
                self.changes += 1
                if self.changes >= guard.count:
                    self.frozen_at = t
        self.last = self.mean


def update_allowed(regime: str, detected: bool, attack: bool, frozen: bool) -> bool:
    """Whether a window may update the baseline; an unknown regime raises."""
    if regime not in REGIMES:
        raise ValueError(f"unknown regime: {regime}")
    return not frozen and REGIMES[regime](detected, attack)


def closed_loops(windows: DataFrame, keys: list[str], order: str, seconds: Column, value: Column, attack: Column, train: Column, theta: float = 4.0, alpha: float = 0.15, guard: Guard = Guard(), regimes: tuple[str, ...] = tuple(REGIMES)) -> DataFrame:
    """keys, order and for every regime z, detected, updated and frozen (each ``<what>_<regime>``) of each window.

    Training windows update every baseline and are never detected.  Of the others, in turn: a frozen baseline recovers
    if its time is up and the window is calm; the window is scored against the baseline before it; the decision and
    the regime say whether it updates; the change of the mean is watched, and may freeze what follows.  A null value
    counts as 0.  ``order`` must not repeat within an entity.
    """
    for r in regimes:
        update_allowed(r, False, False, False)

    def step(loops: list[Loop], t: float, x: float, is_attack: bool, is_train: bool) -> tuple:
        out: list[object] = []
        for regime, loop in zip(regimes, loops, strict=True):
            z = loop.score(x)
            detected = not is_train and abs(z) >= theta
            loop.recover(t, not detected, guard)
            frozen = loop.frozen_at is not None
            updated = not frozen if is_train else update_allowed(regime, detected, is_attack, frozen)
            if updated:
                loop.update(x, alpha)
            loop.watch(t, guard)
            out += [z, detected, updated, frozen]
        return loops, tuple(out)

    rows = windows.select(*keys, order, seconds.cast("double").alias("_t"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("_x"), F.coalesce(attack, F.lit(False)).alias("_a"), F.coalesce(train, F.lit(False)).alias("_f"))
    outputs = ", ".join(f"z_{r} double, detected_{r} boolean, updated_{r} boolean, frozen_{r} boolean" for r in regimes)
    return streamed(rows, keys, [order], lambda: [Loop() for _ in regimes], step, [*keys, order], outputs)


def regime_summary(loops: DataFrame, windows: DataFrame, keys: list[str], order: str, attack: str, train: str, regimes: tuple[str, ...] = tuple(REGIMES)) -> DataFrame:
    """regime, test windows, detection rate over attacks, false rate over benign windows, updates, frozen windows."""
    each = F.array(*[F.struct(F.lit(r).alias("regime"), F.col(f"detected_{r}").alias("detected"), F.col(f"updated_{r}").alias("updated"), F.col(f"frozen_{r}").alias("frozen")) for r in regimes])
    test = loops.join(windows.filter(~F.col(train)).select(*keys, order, attack), [*keys, order])
    long = test.select(attack, F.inline(each))
    a = F.col(attack)
    rate = lambda hit, of: F.try_divide(F.count_if(hit & of), F.count_if(of))
    return long.groupBy("regime").agg(F.count("*").alias("windows"), rate(F.col("detected"), a).alias("detection_rate"), rate(F.col("detected"), ~a).alias("false_rate"), F.count_if("updated").alias("updates"), F.count_if("frozen").alias("frozen"))
