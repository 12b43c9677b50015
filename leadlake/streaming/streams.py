"""Structured Streaming forms of the incremental behaviour (#93-#95).

* ``stream_enrich``: the stateless page pipeline over arriving page files;
* ``stream_new_domains``: each unseen, unblocked, not-yet-stored domain once,
  with event-time deduplication bounded by a watermark;
* ``stream_sessions``: sessions per key, emitted when the watermark passes them;
* ``stream_unanswered``: openings without an answer in time, by a timer per key;
* ``stream_upsert``: every micro-batch folded into a bucketed lead table by ``upsert_leads``; its
  commit names the query id of the stream and the batch id, so a replayed batch does nothing.

Checkpoints and outputs live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions import names as N
from leadlake.functions.urls import host_of
from leadlake.operators import pages as P
from leadlake.operators import timeline as T
from leadlake.sources import merge_table as MT


def stream_enrich(pages_stream: DataFrame) -> DataFrame:
    """#93: audit + contacts + score per arriving page (stateless)."""
    s = P.score_pages(pages_stream)
    return s.select("page_id", "url", "seo", "outreach", "score", "score_reasons")


def stream_new_domains(hits_stream: DataFrame, known: DataFrame, event_col: str = "ts",
                       delay: str = "1 hour") -> DataFrame:
    """#94: hosts of arriving hits, minus blocked hosts and stored domains
    (stream-static anti-join), each emitted once; duplicates are tracked only
    within the watermark, rows later than it are dropped."""
    h = hits_stream.select(F.col(event_col).cast("timestamp").alias("ts"), host_of(F.col("url")).alias("domain"))
    h = h.where(F.col("domain").isNotNull() & ~N.is_blocked(F.col("domain")))
    h = h.join(known.select("domain").distinct(), "domain", "left_anti")
    return h.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["domain"])


def stream_sessions(events_stream: DataFrame, key: str, time: str, gap: str, delay: str, *aggregates) -> DataFrame:
    """Sessions (``timeline.sessions``) of a stream whose rows may be ``delay`` late; output mode append."""
    return T.sessions(T.with_lateness(events_stream, time, delay), key, time, gap, *aggregates)


def stream_unanswered(events_stream: DataFrame, key: str, time: str, opens, closes, within_seconds: int,
                      delay: str) -> DataFrame:
    """The rows of ``timeline.unanswered``, each when the watermark has passed its due time.

    A key keeps its open and closing instants in state, and a timer at the earliest due time. At that
    time every row up to it has come or is too late, so rows may come in any order within ``delay``; the
    state then drops what can't matter any more, and goes when nothing is open."""
    import pandas as pd

    marks = T.with_lateness(events_stream, time, delay).select(
        F.col(key).alias("k"), F.col(time).alias("t"), F.coalesce(opens, F.lit(False)).alias("o"), F.coalesce(closes, F.lit(False)).alias("c"))
    # rows that neither open nor close move the watermark too: a condition without the time would be pushed below it
    marks = marks.where(F.when(F.col("t").isNull(), F.lit(False)).otherwise(F.col("k").isNotNull() & (F.col("o") | F.col("c"))))
    wait = within_seconds * 1_000_000

    def follow(who, frames, state):
        opened, closed = (set(x) for x in state.get) if state.exists else (set(), set())
        for f in frames:
            t = f["t"].astype("datetime64[us]").astype("int64")
            opened.update(t[f["o"]].tolist())
            closed.update(t[f["c"]].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        due = sorted(o for o in opened if o + wait < passed)
        fired = [o for o in due if not any(o < c <= o + wait for c in closed)]
        opened.difference_update(due)
        needed = min([passed, *opened])
        closed = {c for c in closed if c >= needed}
        if opened or closed:
            state.update((sorted(opened), sorted(closed)))
            first = min([o + wait for o in opened] + [c + wait for c in closed])
            state.setTimeoutTimestamp(max(first // 1000 + 1, passed // 1000 + 1))
        else:
            state.remove()
        if fired:
            at = pd.to_datetime(pd.Series(fired), unit="us")
            yield pd.DataFrame({key: [who[0]] * len(fired), "opened_at": at, "due_at": at + pd.Timedelta(seconds=within_seconds)})

    kind = events_stream.schema[key].dataType.simpleString()
    return marks.groupBy("k").applyInPandasWithState(
        follow, f"{key} {kind}, opened_at timestamp, due_at timestamp", "opened array<long>, closed array<long>",
        "append", "EventTimeTimeout")


def stream_upsert(leads_stream: DataFrame, root: str, base_store: DataFrame, run_id: int, now: str | None,
                  checkpoint: str, trigger_once: bool = True, buckets: int = MT.BUCKETS, next_id: int | None = None):
    """#95: fold each micro-batch into the bucketed lead table at ``root/leads``.

    ``base_store`` becomes its first commit where there is no table yet, with ``next_id`` as the stored
    counter of ids. A batch reads the buckets that its domains fall into and writes the rows it
    changes (``LeadTable.merge``), so its cost follows the batch; buckets with many deltas are compacted after it. A
    commit names the stream (the query id in its checkpoint) and the batch, so a replayed batch is known
    and skipped. A second stream on the table goes on from its newest commit; if two write at once, one of
    them fails and is retried by its checkpoint. ``now`` stamps the rows; ``None`` takes each batch's time."""
    spark = leads_stream.sparkSession
    table = MT.LeadTable(spark, f"{root.rstrip('/')}/leads", buckets)
    if table.state() is None:
        table.create(base_store, next_id)

    def fold(batch: DataFrame, batch_id: int) -> None:
        import json
        from datetime import UTC, datetime
        query_id = json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
        table.merge(batch, run_id, now or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), query_id, batch_id)
        table.compact()

    w = leads_stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if trigger_once else w).start()
    return q


def latest_store(spark: SparkSession, root: str) -> DataFrame:
    """The lead table that ``stream_upsert`` keeps at ``root``."""
    return MT.LeadTable(spark, f"{root.rstrip('/')}/leads").read()
