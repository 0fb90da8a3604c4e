"""Incremental ingestion and trigger windows over unbounded logs."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evenkeel.sources import store


def append_new(spark: SparkSession, source: str, schema, target: str, keys: list[str], checkpoint: str) -> int:
    """Read what is new in ``source``, append rows whose key ``target`` does not have, and stop; returns all rows appended so far.

    The stream's state knows the keys of its checkpoint, so ``target`` is not
    read for them; only keys that streams with other checkpoints appended are,
    once a call. A batch is written beside ``target``, and its files get names
    of the checkpoint and the batch when they are moved there; its mark in
    ``target.batches``, written last, holds its rows. A batch with a mark adds
    nothing when it comes again, and one that broke before is replaced.
    """
    store.write_once(spark, f"{checkpoint}.run", uuid.uuid4().hex)
    run = store.read_text(spark, f"{checkpoint}.run")
    rows = spark.readStream.schema(schema).parquet(source).dropDuplicates(keys)
    if any(not n.startswith(run) for n in store.names(spark, f"{target}.batches")):
        other = spark.read.parquet(target).where(~F.col("_metadata.file_name").startswith(run)).select(*[F.col(k).alias(f"_{k}") for k in keys])
        rows = rows.join(other, [rows[k].eqNullSafe(other[f"_{k}"]) for k in keys], "left_anti")

    def batch(df: DataFrame, epoch: int) -> None:
        s, name = df.sparkSession, f"{run}-{epoch}"
        if store.exists(s, f"{target}.batches/{name}"):
            df.write.format("noop").mode("overwrite").save()  # the keys still go into the state
            return
        for n in store.names(s, target):
            if n.startswith(f"{name}-"):
                store.remove(s, f"{target}/{n}")
        part = f"{target}.attempts/{name}-{uuid.uuid4().hex}"
        df.write.parquet(part)
        for n in store.sizes(s, part):
            store.move(s, f"{part}/{n}", f"{target}/{name}-{n}")
        moved = [f"{target}/{n}" for n in store.names(s, target) if n.startswith(f"{name}-")]
        store.write_once(s, f"{target}.batches/{name}", str(s.read.schema(df.schema).parquet(*moved).count() if moved else 0))

    q = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(int(store.read_text(spark, f"{target}.batches/{n}")) for n in store.names(spark, f"{target}.batches"))


def _watermarked(events: DataFrame, at: Column, delay: str, *columns: Column) -> DataFrame:
    """``columns`` beside a watermark on ``at``. Spark's watermark begins at 1970 and drops what is not after it, so earlier rows count there as the first microsecond's."""
    at = at.cast("timestamp")
    return events.select(*columns, F.when(F.unix_micros(at) <= 0, F.timestamp_micros(F.lit(1))).otherwise(at).alias("_mark")).withWatermark("_mark", delay)


def trigger_windows_stream(events: DataFrame, key: str, at: str, opening: Column, code: Column, outcome: Column, delay: str = "1 hour") -> DataFrame:
    """Windows of ``operators.prep.trigger_windows`` on a stream whose batches arrive in time order per key.

    The state of a key is its open window; a window goes out when the next one
    opens or, with no more rows of the key, when the watermark passes its last
    row by ``delay``. Its number stays in the state, so the next window goes on
    from it; rows that still come before the next opening belong to no window.
    """
    wait = int(pd.Timedelta(delay).total_seconds() * 1000)
    kind = events.schema[key].dataType.simpleString()
    d = _watermarked(events, F.col(at), delay, F.col(key), F.col(at).alias("at"), opening.alias("opens"), F.when(outcome, code).alias("code"))

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, n, out_at, first = state.get[:5] if state.exists else (0, None, 0, None, None)
        last = state.get[5] if state.exists else 0
        done = []

        def close():
            if start is not None and first is not None:
                done.append((k[0], number, start, n, out_at, first))

        if state.hasTimedOut:
            close()
            state.update((number, None, 0, None, None, last))
        else:
            for r in pd.concat(list(batches)).sort_values("at").itertuples(index=False):
                if r.opens:
                    close()
                    number, start, n, out_at, first = number + 1, r.at, 0, None, None
                n += 1
                last = max(last, int(pd.Timestamp(r.at).timestamp() * 1000))
                if first is None and r.code is not None and start is not None:
                    out_at, first = r.at, r.code
            state.update((number, start, n, out_at, first, last))
            if start is not None:
                state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=[key, "window", "start", "n_rows", "outcome_at", "first_code"])

    return d.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, window long, start timestamp, n_rows long, outcome_at timestamp, first_code string",
        "number long, start timestamp, n long, out_at timestamp, first string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def window_decisions_stream(events: DataFrame, key: str, at: str, opening: Column, outcome: Column, code: Column, invalid: Column | None = None, interruption: Column | None = None, delay: str = "1 hour") -> DataFrame:
    """``operators.prep.window_decisions`` on a stream whose rows may come in any order within ``delay``.

    A key's rows wait in its state until the watermark has passed them, so that
    no earlier one can come, and are then taken in order of time (openings
    first among rows of one time). A window goes out with its decision when the
    next opens, or when the watermark passes its last row by another ``delay``:
    rows that a key sends after that, before its next opening, belong to no
    window. Rows that come later than ``delay`` are dropped by Spark. The state
    of a key is its open window and the rows of the last ``delay``.
    """
    wait = int(pd.Timedelta(delay).total_seconds() * 1_000_000)
    kind = events.schema[key].dataType.simpleString()
    holds = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    d = _watermarked(events, F.col(at), delay, F.col(key), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), holds(opening).alias("opens"), F.when(holds(outcome), code).alias("code"), holds(outcome).alias("hit"), holds(invalid).alias("bad"), holds(interruption).alias("cut"))

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, window, waiting = pickle.loads(state.get[0]) if state.exists else (0, None, [])
        seen = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += pdf[["us", "opens", "code", "hit", "bad", "cut"]].itertuples(index=False, name=None)
        waiting.sort(key=lambda r: (r[0], not r[1]))
        ready = [r for r in waiting if r[0] <= seen] if seen > 0 else []  # at 0 the watermark has passed nothing, also not what is before 1970
        waiting = waiting[len(ready):]
        done = []

        def close():
            start, n, last, out, bad, cut = window
            decision = "kept" if out else "invalid" if bad else "interrupted" if cut else "unresolved"
            done.append((k[0], number, start, n, out[0] if out else None, out[1] if out else None, decision))

        for us, opens, c, hit, bad, cut in ready:
            if window and window[2] + wait < us and not opens:  # the window was over before
                close()
                window = None
            if opens:
                if window:
                    close()
                number, window = number + 1, (us, 0, us, None, False, False)
            if window:
                start, n, _, out, b, x = window
                window = (start, n + 1, us, out or ((us, c) if hit else None), b or bool(bad), x or bool(cut))
        if window and not waiting and window[2] + wait <= seen and seen > 0:
            close()
            window = None
        state.update((pickle.dumps((number, window, waiting)),))
        if waiting or window:
            wake = waiting[0][0] if waiting else window[2] + wait
            state.setTimeoutTimestamp(max(wake // 1000 + 1, seen // 1000 + 1))
        if done:
            yield pd.DataFrame(done, columns=[key, "window", "start", "n_rows", "outcome_at", "first_code", "decision"]).astype({"outcome_at": "Int64"})

    out = d.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, window long, start long, n_rows long, outcome_at long, first_code string, decision string", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({"start": F.timestamp_micros("start"), "outcome_at": F.timestamp_micros("outcome_at")})
