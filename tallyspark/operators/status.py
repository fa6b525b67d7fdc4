"""Task-status decoding (B17), latest status per task (S1 batch), result extraction.

The status log is append-only: ``task_id, seq, raw`` where ``raw`` is the
service's stored value (``completed:<json>``, ``error:<msg>``,
``processing:...``, ``failed:<msg>`` or null). The latest entry per task is a
partial-aggregable ``max_by``; nothing is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, py_strip

# Status prefixes of the service, the text for an unknown task
# and the reference's cut position for completed/error payloads.
P_COMPLETED = "completed:"
P_ERROR = "error:"
P_PROCESSING = "processing:"
P_FAILED = "failed:"
NOT_FOUND = "Task not found"
REFERENCE_CUT = 10

RESULT_MAP = "map<string,string>"


def decode_status(raw: Column | str, reference_cut: bool = False) -> Column:
    """struct(status, result) of a stored status value.

    ``completed:``/``error:`` keep the text after the prefix, stripped. The
    reference cuts both at 10 characters, so an ``error:`` message loses its
    first 4 characters; ``reference_cut=True`` reproduces that, the default
    cuts after the prefix. Unknown prefixes give a null status (no answer).
    """
    r = col_(raw)
    def after(prefix: str) -> Column:
        cut = REFERENCE_CUT if reference_cut else len(prefix)
        return py_strip(F.substring(r, cut + 1, 1 << 30))
    status = (F.when(r.isNull() | (r == ""), F.lit("completed"))
              .when(r.startswith(P_COMPLETED), F.lit("completed"))
              .when(r.startswith(P_ERROR), F.lit("error"))
              .when(r.startswith(P_PROCESSING), F.lit("processing"))
              .when(r.startswith(P_FAILED), F.lit("error")))
    result = (F.when(r.isNull() | (r == ""), F.lit(NOT_FOUND))
              .when(r.startswith(P_COMPLETED), after(P_COMPLETED))
              .when(r.startswith(P_ERROR), after(P_ERROR))
              .when(r.startswith(P_FAILED), F.substring(r, len(P_FAILED) + 1, 1 << 30)))
    return F.struct(status.alias("status"), result.alias("result"))


def latest_status(log: DataFrame, key: str = "task_id", seq: str = "seq", raw: str = "raw",
                  reference_cut: bool = False) -> DataFrame:
    """S1 (batch): the client's view of each task after its latest poll.

    ``completed`` with a result that is not a JSON object becomes ``error``
    (result kept as text in ``error``); completed rows carry the parsed map in
    ``result`` and its first value in ``code``.
    """
    last = log.groupBy(key).agg(F.max_by(F.col(raw), F.col(seq)).alias("raw"))
    return client_view(last, key, reference_cut)


def client_view(last: DataFrame, key: str = "task_id", reference_cut: bool = False) -> DataFrame:
    d = last.select(key, decode_status("raw", reference_cut).alias("s"))
    parsed = F.from_json(F.col("s.result"), RESULT_MAP)
    d = d.select(key, F.col("s.status").alias("status0"), F.col("s.result").alias("text"), parsed.alias("m"))
    is_done = F.col("status0") == "completed"
    status = F.when(is_done & F.col("m").isNull(), F.lit("error")).otherwise(F.col("status0"))
    return d.select(
        key, status.alias("status"),
        F.when(is_done, F.col("m")).alias("result"),
        F.when(is_done, F.get(F.map_values("m"), 0)).alias("code"),
        F.when(status == "error", F.col("text")).alias("error"))


def completed_results(view: DataFrame) -> DataFrame:
    """Completed tasks with a non-empty result; the first value of the result map."""
    return view.filter((F.col("status") == "completed") & (F.size("result") > 0))


def triage_attempts(attempts: DataFrame, key: str = "task_id") -> DataFrame:
    """Final compile flag per task from an attempt log.

    ``attempts``: ``task_id, attempt (1|2), status ('ok'|'fail'|'timeout'), stderr``.
    The first attempt decides unless it failed with warnings; then the second
    attempt (run with ``-Wno-<w>`` per warning) decides. A timeout counts as 0
    with no warnings. One small aggregation per task (at most two rows).
    """
    from ..functions.code_text import suppress_flags, warnings

    first = F.max_by(F.struct("status", "stderr"), F.when(F.col("attempt") == 1, F.lit(1)).otherwise(F.lit(0)))
    second = F.max(F.when(F.col("attempt") == 2, F.col("status")))
    t = attempts.groupBy(key).agg(first.alias("a1"), second.alias("a2"))
    ws = F.when(F.col("a1.status") == "timeout", F.array().cast("array<string>")).otherwise(warnings(F.col("a1.stderr")))
    t = t.withColumn("ws", ws)
    retry = (F.col("a1.status") == "fail") & (F.size("ws") > 0)
    flag = (F.when(F.col("a1.status") == "ok", F.lit(1))
            .when(retry, (F.coalesce(F.col("a2"), F.lit("fail")) == "ok").cast("int"))
            .otherwise(F.lit(0)))
    return t.select(key, flag.alias("flag"), F.when(retry, suppress_flags("ws")).alias("retry_flags"))
