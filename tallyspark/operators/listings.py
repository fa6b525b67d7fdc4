"""Decompiler output handling: bodies from address-commented listings (P2),
bodies from token streams (P3), run-outcome classification (P4) and the
pluggable batch-inference surface (U2).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_regex, let, py_strip

# Listing markers and runner messages.
ADDRESS_COMMENT = re.compile(r"// ([0-9A-Fa-f]+):")
RANGE_MARKER = "// Address range:"
RANGE_ADDRESS = r"0x\w+"
TIME_LIMIT = "Exceeded time limit"
EMPTY_RESULT = "Empty decompile result"
NO_DETAILS = "No details provided"
ERROR_VALUE = "ERROR"
RUNNER_FAILURES = ("Failed to find the function at the given address.", "Failed to decompile the function.")


def listing_bodies(listings: DataFrame, key: str = "listing_id", code: str = "code",
                   addresses: str = "addresses", block_chars: int | None = None) -> DataFrame:
    """One row per (listing, wanted address) found after a ``// HEX:`` comment.

    The body starts on the line after the comment and ends at the brace that
    balances; an unbalanced body ends one character early (as the reference).
    A listing may be of any size: it is cut into blocks, see
    :mod:`~tallyspark.operators.listing_blocks`. ``key`` names one row.
    """
    from . import listing_blocks as B
    blocks = B.listing_blocks(listings, key, code, block_chars or B.BLOCK_CHARS)
    requests = listings.select(key, F.explode(addresses).alias("address"))
    return B.block_listing_bodies(blocks, requests, key)


def token_list_bodies(listings: DataFrame, key: str = "listing_id", tokens: str = "tokens",
                      addresses: str = "addresses") -> DataFrame:
    """P3 where a listing is one row, as the tools write it: ``tokens`` (array of ``kind, val`` in order) and the
    requested ``addresses``. A comment token holding ``// Address range:`` with a requested address starts a
    function; values are concatenated until the braces balance; the body is stripped. Each body holds only its own
    tokens (the reference never clears its buffer, so its later bodies repeat earlier ones). A later body for the same address wins.

    Row-local: only braces and requested comments are folded over, with the depth and the open function as state; the
    values between a comment and its closing place are joined. No shuffle.
    """
    found = lambda t: F.regexp_extract(t["val"], java_regex(RANGE_ADDRESS), 0)

    def event(t, i):
        address = F.when((t["kind"] == "cmnt") & t["val"].contains(RANGE_MARKER), found(t))
        return F.when(t["val"] == "{", _event(i, 1)).when(t["val"] == "}", _event(i, -1)).when(
            F.coalesce(F.array_contains(F.col(addresses), address), F.lit(False)), _event(i, 0, address))

    events = F.filter(F.transform(F.col(tokens), event), lambda e: e.isNotNull())
    spans = "array<struct<address: string, start: int, close: int>>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(None).cast("string").alias("address"),
                     F.lit(0).alias("start"), F.array().cast(spans).alias("out"))

    def step(s, e):
        mark = e["step"] == 0
        depth = F.when(mark, 0).otherwise(s["depth"] + e["step"])
        opened = ~mark & (s["opened"] | (e["step"] == 1))
        closes = opened & (depth == 0) & s["address"].isNotNull()
        span = F.struct(s["address"].alias("address"), s["start"].alias("start"), e["at"].alias("close"))
        return F.struct(depth.alias("depth"), opened.alias("opened"), F.when(mark, e["address"]).when(~closes, s["address"]).alias("address"),
                        F.when(mark, e["at"]).otherwise(s["start"]).alias("start"),
                        F.when(closes, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    def last_of_each(out):
        names = F.array_distinct(F.transform(out, lambda b: b["address"]))
        return let(names, lambda ns: F.when(F.size(ns) == F.size(out), out).otherwise(
            F.transform(ns, lambda n: F.element_at(F.filter(out, lambda b: b["address"] == n), -1))))

    bodies = let(F.aggregate(events, start, step, lambda s: s["out"]), last_of_each)
    body = F.array_join(F.transform(F.slice(F.col(tokens), F.col("_b.start") + 2, F.col("_b.close") - F.col("_b.start")), lambda t: t["val"]), "")
    return (listings.select(key, tokens, F.explode_outer(bodies).alias("_b")).filter(F.col("_b").isNotNull())
            .select(key, F.col("_b.address").alias("address"), py_strip(body).alias("body")))


def _event(at: Column, step: int, address: Column | None = None) -> Column:
    address = F.lit(None).cast("string") if address is None else address
    return F.struct(at.cast("int").alias("at"), F.lit(step).alias("step"), address.alias("address"))


def token_bodies(tokens: DataFrame, requests: DataFrame, key: str = "listing_id", block_tokens: int | None = None) -> DataFrame:
    """Bodies from a token stream ``(listing_id, pos, kind, val)`` of any length, by the rules of
    :func:`token_list_bodies`; ``requests``: ``listing_id, address``. See :mod:`~tallyspark.operators.listing_blocks`."""
    from . import listing_blocks as B
    return B.block_token_bodies(tokens, requests, key, block_tokens or B.BLOCK_TOKENS)


def classify_runs(runs: DataFrame) -> DataFrame:
    """Reason per run log ``(system, timed_out, returncode, stdout, stderr)``.

    ``time_limit``; ``empty_result`` (exit 0, no output); ``error`` (non-zero
    exit, message = stdout + newline + stderr, stripped, or a default);
    ``runner_failure`` (output is a runner's failure message); else ``ok``.
    """
    msg = py_strip(F.concat_ws("\n", F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))))
    reason = (F.when(F.col("timed_out"), F.lit("time_limit"))
              .when((F.col("returncode") == 0) & (F.coalesce(F.length("stdout"), F.lit(0)) == 0), F.lit("empty_result"))
              .when(F.col("returncode") != 0, F.lit("error"))
              .when(F.col("stdout").isin(*RUNNER_FAILURES), F.lit("runner_failure"))
              .otherwise(F.lit("ok")))
    message = (F.when(F.col("timed_out"), F.lit(TIME_LIMIT))
               .when((F.col("returncode") == 0) & (F.coalesce(F.length("stdout"), F.lit(0)) == 0), F.lit(EMPTY_RESULT))
               .when(F.col("returncode") != 0, F.when(msg == "", F.lit(NO_DETAILS)).otherwise(msg)))
    return runs.withColumn("reason", reason).withColumn("message", message)


def reason_counts(classified: DataFrame) -> DataFrame:
    """Runs per (system, reason)."""
    return classified.groupBy("system", "reason").agg(F.count(F.lit(1)).alias("runs"))


# Stated error of the run-time quantiles: of the rank, as a share of the runs, at the default sketch size.
SKETCH_K = 200
RANK_ERROR = 0.0133
RUN_TIMES = "system string, reason string, runs bigint, seconds double, least double, most double, sketch binary"


def run_times(classified: DataFrame, seconds: str = "seconds", k: int = SKETCH_K) -> DataFrame:
    """Run times per (system, reason): runs, their sum, least and most, and a mergeable quantile sketch. Runs without a
    time are left out."""
    return (classified.filter(F.col(seconds).isNotNull()).groupBy("system", "reason")
            .agg(F.count(F.lit(1)).alias("runs"), F.sum(seconds).alias("seconds"), F.min(seconds).alias("least"), F.max(seconds).alias("most"),
                 F.kll_sketch_agg_double(F.col(seconds), F.lit(k)).alias("sketch")))


def merge_run_times(parts: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Run times of several batches as those of one."""
    return parts.groupBy("system", "reason").agg(
        F.sum("runs").alias("runs"), F.sum("seconds").alias("seconds"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double(F.col("sketch"), F.lit(k)).alias("sketch"))


def run_time_quantiles(times: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``system, reason, rank, value`` from the sketches."""
    values = F.kll_sketch_get_quantile_double(F.col("sketch"), F.array(*[F.lit(r) for r in ranks]))
    pairs = F.arrays_zip(F.array(*[F.lit(r) for r in ranks]).alias("rank"), values.alias("value"))
    return times.select("system", "reason", F.explode(pairs).alias("q")).select("system", "reason", "q.rank", "q.value")


def infer_in_flight(df: DataFrame, call: Callable, input_col: str = "prompt", output_col: str = "output", in_flight: int = 16,
                    time_limit: float | None = None, error_value: str = ERROR_VALUE) -> DataFrame:
    """Many calls in flight per partition, results in input order.

    ``call`` takes one value and gives text; it is a coroutine function or a plain one. At most ``in_flight`` calls of a
    partition run at a time, and at most eight times as many rows wait for an earlier one. A call that fails, takes longer than
    ``time_limit`` seconds or gives nothing yields ``error_value`` and a message in ``error``; other rows are not affected. A coroutine that
    runs out of time is cancelled; a plain call cannot be, and keeps its place until it returns. Spark repeats lost tasks, so calls must be
    idempotent.
    """
    schema = df.schema.simpleString()[len("struct<"):-1]
    out_schema = f"{schema},{output_col}:string,error:string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import asyncio
        import inspect
        import threading
        from collections import deque
        from concurrent.futures import ThreadPoolExecutor

        loop = asyncio.new_event_loop()
        threading.Thread(target=loop.run_forever, daemon=True).start()
        pool, places = ThreadPoolExecutor(in_flight), threading.Semaphore(in_flight)
        is_coroutine = inspect.iscoroutinefunction(call)

        async def answer(value):
            try:
                if is_coroutine:
                    text = await asyncio.wait_for(call(value), time_limit)
                    places.release()
                else:
                    started = loop.run_in_executor(pool, call, value)
                    started.add_done_callback(lambda _: places.release())
                    text = await asyncio.wait_for(asyncio.shield(started), time_limit)
                return (str(text), None) if text else (error_value, "no result")
            except (TimeoutError, asyncio.TimeoutError):
                failure = f"no result after {time_limit} s"
            except Exception as e:  # noqa: BLE001
                failure = f"{type(e).__name__}: {e}"
            if is_coroutine:
                places.release()
            return error_value, failure

        waiting: deque = deque()  # (batch, future) in input order
        held: dict[int, list] = {}

        def finished(n, pdf):
            answers = held.pop(n)
            out = pdf.copy()
            out[output_col], out["error"] = [a for a, _ in answers], [e for _, e in answers]
            return out

        frames: dict[int, pd.DataFrame] = {}
        try:
            for n, pdf in enumerate(batches):
                frames[n], held[n] = pdf, []
                if not len(pdf):
                    yield finished(n, frames.pop(n))
                for value in pdf[input_col]:
                    while waiting and (waiting[0][1].done() or len(waiting) >= 8 * in_flight):
                        k, future = waiting.popleft()
                        held[k].append(future.result())
                        if len(held[k]) == len(frames[k]):
                            yield finished(k, frames.pop(k))
                    places.acquire()
                    waiting.append((n, asyncio.run_coroutine_threadsafe(answer(value), loop)))
            while waiting:
                k, future = waiting.popleft()
                held[k].append(future.result())
                if len(held[k]) == len(frames[k]):
                    yield finished(k, frames.pop(k))
        finally:
            loop.call_soon_threadsafe(loop.stop)
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInPandas(run, out_schema)


def infer(df: DataFrame, fn: Callable[[pd.Series], pd.Series], input_col: str = "prompt",
          output_col: str = "output", batch_rows: int = 64) -> DataFrame:
    """Call a caller-supplied batch function on ``input_col`` with ``mapInPandas``.

    A failing batch is retried row by row; a failing row yields a null output
    and its message in ``error`` - one bad row never aborts the job.
    Spark retries lost tasks; the caller's function must be idempotent.
    """
    schema = df.schema.simpleString()[len("struct<"):-1]
    out_schema = f"{schema},{output_col}:string,error:string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch_rows):
                part = pdf.iloc[s:s + batch_rows].copy()
                try:
                    part[output_col] = list(fn(part[input_col]))
                    part["error"] = None
                except Exception:  # per-row fallback
                    outs, errs = [], []
                    for v in part[input_col]:
                        try:
                            outs.append(list(fn(pd.Series([v])))[0])
                            errs.append(None)
                        except Exception as e:  # noqa: BLE001
                            outs.append(None)
                            errs.append(f"{type(e).__name__}: {e}")
                    part[output_col] = outs
                    part["error"] = errs
                yield part

    return df.mapInPandas(run, out_schema)
