"""Worker registry as a stateful stream, and dispatch over its latest state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrykit.session import ship

EXPIRATION_MS = 30_000
STATE = "name string, models string, speed double, queue long, beat long, registered boolean, known boolean"


def registry(events: DataFrame, expiration_ms: int = EXPIRATION_MS) -> DataFrame:
    """A stream (name, kind, models, speed, queue, ts) of register, beat and remove events -> a row a change.

    A beat of a worker that is not registered is answered with known = false; a worker
    whose event-time passes its last beat by the expiration is removed (registered = false).
    """
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = key[0]
        if state.hasTimedOut:
            models, speed, queue, beat = state.get
            state.remove()
            yield pd.DataFrame([(name, models, speed, queue, beat, False, True)], columns=[c.split()[0] for c in STATE.split(", ")])
            return
        out = []
        now = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        for r in rows.itertuples():
            ms = int(r.ts.timestamp() * 1000)
            if r.kind == "register":
                now = (r.models, float(r.speed), int(r.queue), ms)
            elif r.kind == "remove":
                if now is not None:
                    out.append((name, *now, False, True))
                now = None
                continue
            elif now is None:
                out.append((name, None, None, None, ms, False, False))
                continue
            else:
                now = (now[0], now[1], int(r.queue), ms)
            out.append((name, *now, True, True))
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update(now)
            state.setTimeoutTimestamp(max(now[3] + expiration_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    keyed = events.withWatermark("ts", "0 seconds").groupBy("name")
    return keyed.applyInPandasWithState(step, STATE, "models string, speed double, queue long, beat long", "append", GroupStateTimeout.EventTimeTimeout)


def latest(changes: DataFrame) -> DataFrame:
    """The registered workers of a table of changes."""
    last = changes.where("known").groupBy("name").agg(F.max_by(F.struct("models", "speed", "queue", "beat", "registered"), "beat").alias("s"))
    return last.select("name", "s.*").where("registered").drop("registered")


def alive(beats: DataFrame, now: str, expiration_s: int) -> DataFrame:
    """G02 over a table (name, ts): name, last_beat of workers whose last beat is not older than the expiration."""
    return beats.groupBy("name").agg(F.max("ts").alias("last_beat")).where(F.col("last_beat") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(expiration_s)))


def shortest_queue(workers: DataFrame, model: str) -> DataFrame:
    """The worker of a model with the least queue / speed, the first name of equals, with its queue one longer."""
    fits = workers.where(F.array_contains(F.split("models", ","), model))
    return fits.agg(F.min_by(F.struct("name", "queue"), F.struct(F.col("queue") / F.col("speed"), "name")).alias("w")).where("w is not null").select("w.name", (F.col("w.queue") + 1).alias("queue"))


def lottery(workers: DataFrame, requests: DataFrame, model: str) -> DataFrame:
    """Each request (id, draw in [0, 1)) with the worker whose share of the speeds its draw falls into."""
    w = Window.orderBy("name")
    fits = workers.where(F.array_contains(F.split("models", ","), model)).where("speed > 0")
    total = F.sum("speed").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shares = fits.select("name", (F.sum("speed").over(w) / total).alias("upto"), F.coalesce(F.sum("speed").over(w.rowsBetween(Window.unboundedPreceding, -1)) / total, F.lit(0.0)).alias("start"))
    return requests.join(F.broadcast(shares), (F.col("draw") >= F.col("start")) & (F.col("draw") < F.col("upto"))).select("id", "name")


def trailing_means(steps: DataFrame, value: str, order: str = "step", window: int = 128, by: str | None = None) -> DataFrame:
    """The mean over the last `window` rows, the current one included."""
    w = (Window.partitionBy(by) if by else Window).orderBy(order).rowsBetween(-(window - 1), 0)
    return steps.withColumn("trailing_mean", F.avg(value).over(w))


def resumed(steps: DataFrame, step: int) -> DataFrame:
    """G08."""
    return steps.where(F.col("step") >= step)
