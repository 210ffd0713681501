"""Change signals and jobs: debounced batches, idempotent capture, the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP_MS, CAP_MS = 500, 2000
LEASE_SECONDS, MAX_ATTEMPTS = 60, 5
#: What may be told of a lease, the one that counts first.
OUTCOMES = ["complete", "cancel", "fail", "heartbeat"]


def debounced(signals: DataFrame, gap_ms: int = GAP_MS, cap_ms: int = CAP_MS) -> DataFrame:
    """(key, first, last, fires, n) of signals (key, ts): a batch fires gap_ms after its last signal or cap_ms after its
    first, whichever is sooner. Gap sessions come from a window; the cap is a fold over one session's signals."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = signals.select("key", ms.alias("t"))
    w = Window.partitionBy("key").orderBy("t")
    start = (F.col("t") - F.lag("t").over(w) >= gap_ms) | F.lag("t").over(w).isNull()
    marked = rows.withColumn("s", start.cast("int")).withColumn("session", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kind = "array<struct<first:bigint,last:bigint,n:bigint>>"
    fold = f"""aggregate(ts, cast(array() as {kind}), (a, t) -> if(size(a) > 0 and t < element_at(a, -1).first + {cap_ms},
        concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', t, 'n', element_at(a, -1).n + 1))),
        concat(a, array(named_struct('first', t, 'last', t, 'n', 1L)))))"""
    batches = marked.groupBy("key", "session").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("key", F.explode(F.expr(fold)).alias("b"))
    fires = F.least(F.col("b.last") + gap_ms, F.col("b.first") + cap_ms)
    return batches.select("key", F.col("b.first").alias("first"), F.col("b.last").alias("last"), fires.alias("fires"), F.col("b.n").alias("n"))


def debounced_stream(signals: DataFrame, watermark: str = "10 seconds", gap: str = "500 milliseconds") -> DataFrame:
    """The streaming form of the gap rule: a session window per key, given once the watermark has passed it."""
    s = signals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return s.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("first"), F.col("w.end").alias("fires"), "n")


def new_snapshots(captures: DataFrame) -> DataFrame:
    """Captures (agent, at, snapshot_id) that differ from the one before them: unchanged ones aren't delivered again."""
    w = Window.partitionBy("agent").orderBy("at")
    return captures.withColumn("before", F.lag("snapshot_id").over(w)).filter("before is null or before <> snapshot_id").drop("before")


def enqueue(there: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs to add for requests (kind, key, priority, available_at): the id is a digest of kind and key, and an id that is
    queued already, or requested twice, is added once."""
    job_id = F.sha2(F.concat("kind", F.char(F.lit(0)), "key").cast("binary"), 256)
    first = Window.partitionBy("id").orderBy(F.desc("priority"), "available_at")
    new = requests.withColumn("id", job_id).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return new.join(there.select("id"), "id", "left_anti")


def claimable(jobs: DataFrame, now: int) -> DataFrame:
    """Jobs that are queued and due, or running with an expired lease."""
    return jobs.filter(((F.col("status") == "queued") & (F.col("available_at") <= now)) | ((F.col("status") == "running") & (F.col("lease_until") <= now)))


def claim(jobs: DataFrame, now: int, owner: str, limit: int = 1) -> DataFrame:
    """The next jobs by priority, then age, then id, as they are once claimed: fence and attempts one higher, leased."""
    order = [F.desc("priority"), F.col("available_at"), F.col("id")]
    return claimable(jobs, now).orderBy(*order).limit(limit).withColumns(
        {"status": F.lit("running"), "owner": F.lit(owner), "fence": F.col("fence") + 1, "attempts": F.col("attempts") + 1, "lease_until": F.lit(now + LEASE_SECONDS).cast("bigint")}
    )


def apply_outcome(jobs: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """jobs after outcomes (id, owner, fence, outcome: heartbeat, complete, fail, cancel). An outcome counts only with the
    job's owner and fence and an unexpired lease; of several for one lease the first of complete, cancel, fail, heartbeat
    counts; a failure is retried after 2 ** min(attempts, 8) seconds, up to five attempts. A job stays one row."""
    first = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    o = outcomes.filter(F.col("outcome").isin(OUTCOMES)).groupBy("id", "owner", "fence").agg(F.min_by("outcome", first).alias("outcome"))
    j = jobs.join(o, ["id", "owner", "fence"], "left")
    held = (F.col("status") == "running") & (F.col("lease_until") > now)
    does = F.when(F.coalesce(held, F.lit(False)), F.col("outcome"))
    retry = (does == "fail") & (F.col("attempts") <= MAX_ATTEMPTS)
    status = F.when(does == "complete", "succeeded").when(does == "cancel", "cancelled").when(retry, "queued").when(does == "fail", "failed").otherwise(F.col("status"))
    available = F.when(retry, now + F.pow(F.lit(2), F.least(F.col("attempts"), F.lit(8))).cast("bigint")).otherwise(F.col("available_at"))
    lease = F.when(does == "heartbeat", F.lit(now + LEASE_SECONDS).cast("bigint")).otherwise(F.col("lease_until"))
    return j.withColumns({"status": status, "available_at": available, "lease_until": lease}).select(*jobs.columns)


def publish_fenced(heads: DataFrame, attempts: DataFrame) -> DataFrame:
    """heads (name, fence, value) after attempts: per name the highest fence wins, and one below the head's is refused."""
    every = heads.select("name", "fence", "value").unionByName(attempts.select("name", "fence", "value"))
    return every.groupBy("name").agg(F.max("fence").alias("fence"), F.max_by("value", "fence").alias("value"))
