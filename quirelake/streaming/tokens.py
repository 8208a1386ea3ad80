"""Token streams: decoding of provider lines, keyed state, idle time and end states.

The functions work on batch and streaming DataFrames alike, but for ``concatenated`` and ``idle_runs``, which need an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sessions import save_table


def decode(lines: DataFrame, most: int = 1 << 20) -> DataFrame:
    """lines (request_id, provider, seq, line) -> token, done and blocked of each line that holds an event; overlong lines raise no token."""
    body = F.regexp_replace("line", r"^data:\s*", "")
    get = lambda path: F.get_json_object("body", path)
    rows = lines.withColumn("body", F.trim(body)).where((F.col("body") != "") & (F.length("body") <= most))
    token = (
        F.when(F.col("provider") == "ollama", F.coalesce(get("$.response"), get("$.message.content")))
        .when(F.col("provider") == "claude", get("$.delta.text"))
        .when(F.col("provider") == "openai", get("$.choices[0].delta.content"))
        .when(F.col("provider") == "gemini", get("$.candidates[0].content.parts[0].text"))
    )
    done = (F.col("body") == "[DONE]") | (get("$.done") == "true") | (get("$.type") == "message_stop")
    blocked = F.coalesce(get("$.promptFeedback.blockReason"), F.when(get("$.candidates[0].finishReason") == "SAFETY", "SAFETY"), F.when(get("$.choices[0].finish_reason") == "content_filter", "content_filter"))
    return rows.select(*lines.columns, F.coalesce(token, F.lit("")).alias("token"), F.coalesce(done, F.lit(False)).alias("done"), blocked.alias("blocked"))


def concatenated(tokens: DataFrame) -> DataFrame:
    """Text and end state of each request: blocked, empty or done, else open."""
    got = F.array_sort(F.collect_list(F.struct("seq", "token")))
    rows = tokens.groupBy("request_id").agg(F.array_join(F.transform(got, lambda x: x["token"]), "").alias("text"), F.max("done").alias("ended"), F.max("blocked").alias("blocked"))
    state = F.when(F.col("blocked").isNotNull(), "BLOCKED").when(F.col("ended") & (F.col("text") == ""), "EMPTY_RESPONSE").when(F.col("ended"), "done").otherwise("open")
    return rows.select("request_id", "text", state.alias("state"))


def idle_runs(events: DataFrame, key: str, ts: str, idle: str = "60 seconds") -> DataFrame:
    """Runs of events of a key without a pause over idle: key, first, last, n."""
    w = Window.partitionBy(key).orderBy(ts)
    pause = F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {idle}")
    rows = events.withColumn("run", F.sum(F.coalesce(pause, F.lit(False)).cast("int")).over(w))
    return rows.groupBy(key, "run").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def idle_windows(events: DataFrame, key: str, ts: str, idle: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """The same runs on a stream, emitted once the watermark has passed them."""
    rows = events.withWatermark(ts, late).groupBy(F.session_window(ts, idle), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "n")


def timed_out(rows: DataFrame, *, idle_s: int = 120, total_s: int = 10_800) -> DataFrame:
    """timed_out of requests (started, last, now)."""
    gone = lambda a: F.col("now").cast("double") - F.col(a).cast("double")
    return rows.withColumn("timed_out", (gone("last") > idle_s) | (gone("started") > total_s))


def start_persisting(tokens: DataFrame, path: str, checkpoint: str, every: str = "2 seconds"):
    """Writes a stream's tokens batch by batch (a batch again after a failure replaces itself), one writer at a time."""

    def save(batch: DataFrame, number: int) -> None:
        save_table(batch, f"{path}/batch={number}")

    return tokens.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
