"""Streams of receipts: usage by window, deduplication, deny rates, tool budgets, hysteresis of readings, open lifecycles, a partitioned sink.

Every function takes and returns a streaming DataFrame with an event time ``ts`` (or the batch
equivalent). Rows later than the watermark are dropped by Spark and counted in its progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.health import READINGS
from ..operators.policy import outcome_class
from ..operators.usage import calls


def usage(receipts: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, tokens, cost and errors of each model in tumbling windows, which start at the epoch."""
    rows = calls(receipts.withWatermark("ts", late))
    return rows.groupBy(F.window("ts", width), "model_id").agg(F.count("*").alias("calls"), F.sum("all_tokens").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"), F.count_if("failed").alias("errors"))


def dedup(receipts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first receipt of each id within the watermark."""
    return receipts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pack_id", "receipt_id"])


def deny_rates(receipts: DataFrame, width: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Receipts and denials of each window."""
    rows = receipts.withWatermark("ts", late).withColumn("class", outcome_class())
    return rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("total"), F.count_if(F.col("class") == "denied").alias("denied"))


def tool_budgets(receipts: DataFrame, limits: dict[str, int], default: int = 1_000_000) -> DataFrame:
    """(session, tool_name, seq, allowed): a session may call a tool as often as its limit says.

    The state of a session and tool is one count; rows of a batch are taken in sequence order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        most = limits.get(key[1], default)
        allowed = [used + i < most for i in range(len(rows))]
        state.update((min(used + len(rows), most),))
        yield pd.DataFrame({"session": key[0], "tool_name": key[1], "seq": rows["seq"].to_numpy(), "allowed": allowed})

    rows = receipts.where("type = 'mcp_tool_call'").select(F.col("trace_id").alias("session"), "tool_name", "seq")
    return rows.groupBy("session", "tool_name").applyInPandasWithState(step, "session string, tool_name string, seq long, allowed boolean", "used long", "append", "NoTimeout")


def grace(checked: DataFrame, key: str = "user_id", order: str = "seq", readings: int = READINGS, unanimous: bool = True) -> DataFrame:
    """(key, order, passes, in_grace): the hysteresis of readings as they come.

    checked: key and order (whole numbers) and passes, a boolean; null counts as failed. The state of a key is its
    last readings, oldest first, and where it stands; rows of a batch are taken in order, and a batch's rows
    come after those of the batches before."""
    need = readings if unanimous else readings // 2 + 1

    def step(found: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        history, inside = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        stands = []
        for ok in rows["passes"]:
            history = (history + ("1" if ok else "0"))[-readings:]
            good = history.count("1")
            if len(history) == readings:
                inside = True if good >= need else False if readings - good >= need else inside
            stands.append(inside)
        state.update((history, inside))
        yield pd.DataFrame({key: found[0], order: rows[order].to_numpy(), "passes": rows["passes"].to_numpy(bool), "in_grace": stands})

    rows = checked.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.coalesce("passes", F.lit(False)).alias("passes"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, passes boolean, in_grace boolean", "history string, inside boolean", "append", "NoTimeout")


def write_traces(lines: DataFrame, path: str, bad_path: str, checkpoint: str):
    """Parse JSON lines (raw, date) as they come; good rows go to Parquet by epoch and date, bad lines to a side table by
    epoch. A batch that runs again replaces what it wrote before, so every line is there once."""
    from ..sources.receipts import SCHEMA, normalize

    def write(batch: DataFrame, epoch: int) -> None:
        parsed = batch.withColumn("ok", F.expr("try_parse_json(raw)").isNotNull()).persist()
        try:
            good = normalize(parsed.where("ok").withColumn("r", F.from_json("raw", SCHEMA)).select("date", "raw", "r.*"))
            good.write.mode("overwrite").partitionBy("date").parquet(f"{path}/epoch={epoch}")
            parsed.where("not ok").select("date", "raw").write.mode("overwrite").parquet(f"{bad_path}/epoch={epoch}")
        finally:
            parsed.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Write what is there to Parquet at ``path`` and stop; its checkpoint lies beside it."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


_LIFECYCLES = pa.schema([("key", pa.string()), ("opened", pa.int64()), ("n", pa.int64()), ("last_type", pa.string()), ("last_at", pa.int64()), ("closed", pa.bool_()), ("due", pa.int64())])
#: Stands for no opening.
_NEVER = np.iinfo(np.int64).min


def open_lifecycles(events: DataFrame, timeout: float, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """(key, opened_at, receipts, last_type, last_at) of lifecycles that stay open for ``timeout`` seconds of event time.

    events: key (text), type, step (``open``, ``close`` or null) and ts. A key's first opening starts it, all its receipts from then on
    count, and a close ends it whenever it comes before the timer: only then nothing is reported. The state of a key is
    one row; its timer is the opening and ``timeout``, and it goes when the watermark passes that. Rows of a batch
    are taken by time; ties put openings first.

    Keys are dealt over ``buckets`` by hash; a bucket's keys are one group, taken together in columns, and its timer is the
    earliest of theirs. So very many keys cost few calls; a task holds one bucket's keys and new rows at a time.
    """

    def step(found: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, timed_out = state.getCurrentWatermarkMs(), state.hasTimedOut
        known = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else _LIFECYCLES.empty_table()
        given = [] if timed_out else list(batches)
        rows = pd.concat(given) if given else pd.DataFrame({"key": [], "type": [], "step": [], "at": []})
        m = known.num_rows
        codes, keys = pd.factorize(np.concatenate([known["key"].to_numpy(), rows["key"].to_numpy(object)]), use_na_sentinel=False)
        held = lambda name, blank: np.concatenate([known[name].to_numpy(), np.full(len(keys) - m, blank)])
        opened, n, last_type, last_at, closed, due = held("opened", _NEVER), held("n", 0), held("last_type", None), held("last_at", 0), held("closed", False).astype(bool), held("due", 0)
        at, kind, what = rows["at"].to_numpy(np.int64), rows["type"].to_numpy(object), rows["step"].to_numpy(object)
        order = np.lexsort((what != "open", at, codes[m:]))
        key, at, kind, what = codes[m:][order], at[order], kind[order], what[order]
        # of each key's new rows, in order, the first and the last
        new = np.concatenate([key[1:] != key[:-1], [True]])[: len(key)]
        last = np.flatnonzero(new)
        first = np.concatenate([[0], last[:-1] + 1])[: len(last)].astype(int)
        touched, was = key[last], opened != _NEVER
        starts = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(starts, key[what == "open"], at[what == "open"])
        opened = np.where(~was & (starts < np.iinfo(np.int64).max), starts, opened)
        counts = (opened[key] != _NEVER) & (was[key] | (at >= opened[key]))
        n = n + np.bincount(key[counts], minlength=len(keys))
        ended = last[opened[touched] != _NEVER]
        last_type[key[ended]], last_at[key[ended]] = kind[ended], at[ended]
        closed[key[what == "close"]] = True
        base = np.where(opened[touched] != _NEVER, opened[touched], at[first])
        due[touched] = np.maximum((base / 1000 + timeout * 1000).astype(np.int64), now + 1)
        over = due < now
        out = over & (opened != _NEVER) & ~closed
        stay = ~over
        if stay.any():
            columns = [keys[stay], opened[stay], n[stay], last_type[stay], last_at[stay], closed[stay], due[stay]]
            table = pa.Table.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, _LIFECYCLES, strict=True)], schema=_LIFECYCLES)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _LIFECYCLES) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(due[stay].min()))
        else:
            state.remove()
        if out.any():
            yield pd.DataFrame({"key": keys[out], "opened_us": opened[out], "receipts": n[out], "last_type": last_type[out], "last_us": last_at[out]})

    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    rows = events.withWatermark("ts", late).select(bucket, "key", "type", "step", "ts", F.unix_micros("ts").alias("at"))
    out = rows.groupBy("bucket").applyInPandasWithState(step, "key string, opened_us long, receipts long, last_type string, last_us long", "kept binary", "append", "EventTimeTimeout")
    return out.select("key", F.timestamp_micros("opened_us").alias("opened_at"), "receipts", "last_type", F.timestamp_micros("last_us").alias("last_at"))
