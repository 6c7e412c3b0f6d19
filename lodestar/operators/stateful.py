"""Sequential state per key: circuit breaker, alert cooldown, recovery limits, provider fallback, conversation rounds.

The first four need the order of events. Each key's events go to one task, sorted, and are walked through batch by
batch with the key's state alone in memory, so a key with any number of events needs no more; the streaming twins in
lodestar.streaming keep the same state between batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walked(events: DataFrame, key: str, columns: list[str], start: Callable, out: str) -> DataFrame:
    """key, t, seq and the columns of out: for each key's events by (t, seq), what the function that start() makes returns
    for (t, *columns), in the order of out."""
    kind = events.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in out.split(", ")]
    types = [{"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[f.split()[1]] for f in out.split(", ")]

    def run(batches):
        step, now, begun = None, None, False
        for batch in batches:
            given = [batch.column(c).to_pylist() for c in ("t", *columns)]
            found = []
            for k, *values in zip(batch.column(key).to_pylist(), *given, strict=True):
                if not begun or k != now:
                    step, now, begun = start(), k, True
                found.append(step(*values))
            made = [pa.array(list(c), kind) for c, kind in zip(zip(*found, strict=True), types, strict=True)] if found else [pa.array([], kind) for kind in types]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("t"), batch.column("seq"), *made], names=[key, "t", "seq", *names])

    ordered = events.select(key, F.col("t").cast("double").alias("t"), F.col("seq").cast("long").alias("seq"), *[c for c in columns if c != key]).repartition(key).sortWithinPartitions(key, "t", "seq")
    return ordered.mapInArrow(run, f"{key} {kind}, t double, seq long, {out}")


@dataclass
class Breaker:
    """closed, open or half_open. Failures in a row open it; after reset seconds one call is let through."""

    failure: int = 5
    success: int = 3
    reset: float = 30.0
    state: str = "closed"
    failures: int = 0
    successes: int = 0
    opened_at: float = 0.0

    def step(self, at: float, ok: bool) -> tuple[str, bool]:
        """The state after an event, and whether the call was rejected."""
        if self.state == "open":
            if at - self.opened_at < self.reset:
                return self.state, True
            self.state, self.successes = "half_open", 0
        if ok:
            self.failures = 0
            if self.state == "half_open":
                self.successes += 1
                if self.successes >= self.success:
                    self.state, self.successes, self.opened_at = "closed", 0, 0.0
        else:
            self.failures += 1
            self.successes = 0
            if self.state == "half_open" or (self.state == "closed" and self.failures >= self.failure):
                self.state, self.opened_at = "open", at
        return self.state, False

    def saved(self) -> tuple:
        d = asdict(self)
        return d["state"], d["failures"], d["successes"], d["opened_at"]


class Rejected(RuntimeError):
    """The breaker is open: the call was not made."""


def protected(call: Callable, breaker: Breaker, clock: Callable[[], float]) -> Callable:
    """call behind a breaker: its errors count as failures and are passed on; while the breaker is open it is not made."""

    def guarded(*args, **kwargs):
        now = clock()
        if breaker.state == "open" and now - breaker.opened_at < breaker.reset:
            raise Rejected(f"open since {breaker.opened_at}")
        try:
            out = call(*args, **kwargs)
        except Exception:
            breaker.step(now, False)
            raise
        breaker.step(now, True)
        return out

    return guarded


def circuit_breaker(events: DataFrame, key: str = "service", failure: int = 5, success: int = 3, reset: float = 30.0) -> DataFrame:
    """events (key, t seconds, seq, ok) as key, t, seq, state, rejected."""
    return walked(events, key, ["ok"], lambda: Breaker(failure, success, reset).step, "state string, rejected boolean")


def cooldown(alerts: DataFrame, key: str, gap: float = 300.0) -> DataFrame:
    """alerts (key, t, seq) with sent: an alert goes out unless one of its key went out less than gap seconds before."""

    def start():
        last = None

        def step(t):
            nonlocal last
            go = last is None or t - last >= gap
            last = t if go else last
            return (go,)

        return step

    return walked(alerts, key, [], start, "sent boolean")


def recovery_limit(requests: DataFrame, key: str, gap: float = 60.0, hourly: int = 5) -> DataFrame:
    """requests with allowed: at least gap seconds after the last allowed one, and no more than `hourly` in an hour."""

    def start():
        done: list[float] = []

        def step(t):
            done[:] = [d for d in done if t - d < 3600.0]
            go = (not done or t - done[-1] >= gap) and len(done) < hourly
            if go:
                done.append(t)
            return (go,)

        return step

    return walked(requests, key, [], start, "allowed boolean")


def fallback(attempts: DataFrame, key: str, providers: list[str], skip_after: int = 3, for_seconds: float = 60.0) -> DataFrame:
    """Requests (key, t, seq, one boolean column a provider) with the provider that answered; one that failed skip_after times in a row rests a while."""

    def start():
        failed, until = dict.fromkeys(providers, 0), dict.fromkeys(providers, float("-inf"))

        def step(t, *answers):
            for p, good in zip(providers, answers, strict=True):
                if t < until[p]:
                    continue
                if good:
                    failed[p] = 0
                    return (p,)
                failed[p] += 1
                if failed[p] >= skip_after:
                    failed[p], until[p] = 0, t + for_seconds
            return (None,)

        return step

    return walked(attempts, key, providers, start, "provider string")


def first_success(rows: DataFrame, providers: list[str], value: str = "value") -> DataFrame:
    """rows with the value and name of the first provider, in order, that has one (a column each); null if none has."""
    found = F.coalesce(*[F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("v"), F.lit(p).alias("p"))) for p in providers])
    return rows.withColumn(value, found["v"]).withColumn("provider", found["p"])


def rounds(turns: DataFrame, most: int = 3) -> DataFrame:
    """Conversation turns (conv_id, turn, role) with the round and state: a user turn opens a round, the last round executes."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    round_ = F.least(F.sum((F.col("role") == "user").cast("int")).over(so_far).cast("int"), F.lit(most))
    out = turns.select("conv_id", "turn", "role", round_.alias("round"))
    return out.withColumn("state", F.when(F.col("round") >= most, "execute").when(F.col("round") > 0, "clarify").otherwise("new"))
