"""Structured Streaming forms of the feedback, lock and debounce operators."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """One parquet table, a file or a folder, as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    reader = spark.readStream.schema(schema).options(**options)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its result as a table in the shared folder."""
    spark, out = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:

        def keep(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(out)

        query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def debounced(stream: DataFrame, at: str, gap: str, keys: list[str], item: str, late: str = "0 seconds") -> DataFrame:
    """STR01: (keys, first, last_end, items, n): one row per burst, closed by silence of ``gap`` in event time."""
    rows = stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("w"))
    return rows.agg(F.array_sort(F.collect_set(item)).alias("items"), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("first"), F.col("w.end").alias("last_end"), "items", "n")


def latest_state(stream: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """STR10: the last values per key so far, and how many rows there were; for complete or update mode."""
    agg = stream.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v"), F.count("*").alias("n"))
    return agg.select(key, *[F.col(f"_v.{v}").alias(v) for v in values], "n")


def deduplicated(stream: DataFrame, at: str, keys: list[str], within: str) -> DataFrame:
    """STR12: the first row of each key within the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def correlated(searches: DataFrame, commits: DataFrame, key: str, at: str, commit_key: str, commit_at: str, window: str, late: str = "1 hour") -> DataFrame:
    """STR13: searches with the commits of the same session within the window after them, as a stream-stream join."""
    a, b = searches.withWatermark(at, late), commits.withWatermark(commit_at, late)
    near = (F.col(commit_at) >= F.col(at)) & (F.col(commit_at) < F.col(at) + F.expr(f"interval {window}"))
    return a.join(b, (F.col(key) == F.col(commit_key)) & near)


def lock_decisions(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """STR04-05: (file, agent, at, decision, attempts): exclusive locks per file with a time to live.

    ``stream`` has file, agent, action (claim, renew or release), at (timestamp)
    and ttl_s.  State is one lock per file and the refused attempts of each
    agent since; an expired lock grants.  A second refusal escalates.  Events of
    one file are taken in order of time within a batch.  State older than its
    lock goes by event-time timeout.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        holder, until, refused = state.get if state.exists else (None, 0.0, "{}")
        tries: dict[str, int] = json.loads(refused)
        out = []
        for row in pd.concat(list(batches)).sort_values(["at", "agent", "action"], kind="stable").itertuples():
            now = row.at.timestamp()
            if holder is not None and now >= until:
                holder, tries = None, {}
            if row.action == "release":
                said = "released" if holder == row.agent else "not held"
                if holder == row.agent:
                    holder, tries = None, {}
            elif row.action == "renew":
                said = "renewed" if holder == row.agent else "not held"
                if holder == row.agent:
                    until = now + row.ttl_s
            elif holder in (None, row.agent):
                holder, until, said = row.agent, now + row.ttl_s, "granted"
            else:
                tries[row.agent] = tries.get(row.agent, 0) + 1
                said = "escalated" if tries[row.agent] >= 2 else "refused"
            out.append((key[0], row.agent, row.at, said, tries.get(row.agent, 0)))
        if holder is None:
            if state.exists:
                state.remove()
        else:
            state.update((holder, float(until), json.dumps(tries)))
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["file", "agent", "at", "decision", "attempts"])

    return (
        stream.withWatermark("at", late).groupBy("file")
        .applyInPandasWithState(decide, "file string, agent string, at timestamp, decision string, attempts int", "holder string, until double, refused string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def versioned(stream: DataFrame, root: str, transform, interval: str | None = None):
    """STR02-03, SNK06: each batch, transformed, becomes a new version; a pointer names the last whole one.

    Readers of ``current_version`` see a version that was written whole; a
    strong read calls ``query.processAllAvailable()`` first.
    """
    spark = stream.sparkSession

    def write(df: DataFrame, epoch: int) -> None:
        path = f"{root}/v={epoch:09d}"
        transform(df).write.mode("overwrite").parquet(path)
        spark.createDataFrame([(epoch, path)], "epoch long, path string").coalesce(1).write.mode("append").json(f"{root}/pointer")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").queryName(f"versions-{uuid.uuid4().hex[:8]}").trigger(**trigger).start()


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """The last version that was written whole."""
    last = spark.read.schema("epoch long, path string").json(f"{root}/pointer").orderBy(F.desc("epoch")).first()
    return spark.read.parquet(last["path"])


def coalesced_jobs(jobs: DataFrame, seq: str, repo: str, scope: str) -> DataFrame:
    """STR06: pending jobs to run: a repo job (null scope) takes in every scope job of its repo; equal scope jobs run once, the first."""
    whole = jobs.filter(F.col(scope).isNull()).groupBy(repo).agg(F.min(seq).alias(seq)).withColumn(scope, F.lit(None).cast("string"))
    single = jobs.filter(F.col(scope).isNotNull()).join(whole.select(repo), repo, "left_anti").groupBy(repo, scope).agg(F.min(seq).alias(seq))
    return whole.select(seq, repo, scope).unionByName(single.select(seq, repo, scope))


def wait_for_refresh(pending: Callable[[], bool], timeout_s: float = 1.0, poll_s: float = 0.05, heal: Callable[[], None] | None = None) -> str:
    """STR09: wait on the driver until nothing is pending, within a budget: fresh, healed after ``heal`` ran, or stale.

    A check that fails counts as pending; ``heal`` is called once, when the
    budget is used up, and has half of it again to take effect.
    """

    def settled(budget: float) -> bool:
        until = time.monotonic() + budget
        while True:
            try:
                if not pending():
                    return True
            except Exception:  # the state cannot be read just now
                pass
            if time.monotonic() >= until:
                return False
            time.sleep(min(poll_s, max(0.0, until - time.monotonic())))

    if settled(timeout_s):
        return "fresh"
    if heal is not None:
        heal()
        if settled(timeout_s / 2):
            return "healed"
    return "stale"


def pending_jobs(jobs: DataFrame, repo: str) -> Callable[[], bool]:
    """STR09: is a job of the repo pending or running?  ``jobs`` has repo and state, and is read anew each time."""
    return lambda: not jobs.filter((F.col("repo") == repo) & F.col("state").isin("pending", "running")).isEmpty()
