"""Structured Streaming: recorded positions, latest per item, queue states, late rows, degradation, ends.

State is kept per key and holds a few numbers; idle keys time out, so state does not grow with the stream. Such a query
runs batches without data to see to timeouts; for a run that ends (availableNow), set
spark.sql.streaming.noDataMicroBatches.enabled to false."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.lookups import active_sentence
from lectern.operators.progress import latest

IDLE_MS = 3_600_000
#: A slow synthesis opens stage 1 of mitigation; this many samples later one that is still slow opens stage 2.
SLOW, WINDOW = 1.2, 3


def _stateful(rows: DataFrame, key: str, fn: Callable, out: str, state: str) -> DataFrame:
    return rows.groupBy(key).applyInPandasWithState(fn, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _in_order(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    pdf = pd.concat(list(pdfs))
    return pdf.sort_values("seq", kind="stable")


def debounce(rows: DataFrame, least: float = 5.0) -> DataFrame:
    """rows: item_id string, seq long, position double. Rows at least `least` from the last kept row of their item."""

    def step(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for r in _in_order(pdfs).itertuples():
            now = 0.0 if pd.isna(r.position) else float(r.position)
            if last is None or abs(now - last) >= least:
                last = now
                kept.append((key[0], r.seq, now))
        state.update((last,))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(kept, columns=["item_id", "seq", "position"])

    return _stateful(rows.select("item_id", "seq", "position"), "item_id", step, "item_id string, seq long, position double", "last double")


def latest_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Keep the latest row of each key in versions under `path`: each micro-batch merges into the newest version and
    swaps. A batch that comes again gives the same table, so delivery at least once suffices."""
    from pyspark.errors import AnalysisException, PySparkException

    from lectern.sources.sinks import current, swap

    def merge(batch: DataFrame, _: int) -> None:
        new = latest(batch, keys, order)
        try:
            new = latest(current(batch.sparkSession, path).unionByName(new), keys, order)
        except (AnalysisException, PySparkException) as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        swap(new, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def queue_states(events: DataFrame) -> DataFrame:
    """events: text, seq, event in enqueue, launch, done, fail, consume. The states of each text as they change:
    queued, pending, ready, failed, gone. A text already known is not enqueued again; events out of turn are dropped."""
    turns = {(None, "enqueue"): "queued", ("queued", "launch"): "pending", ("pending", "done"): "ready", ("pending", "fail"): "failed", ("ready", "consume"): "gone", ("failed", "consume"): "gone"}

    def step(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else None
        made = []
        for r in _in_order(pdfs).itertuples():
            nxt = turns.get((now, r.event))
            if nxt:
                now = None if nxt == "gone" else nxt
                made.append((key[0], r.seq, nxt))
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update((now,))
            state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(made, columns=["text", "seq", "status"])

    return _stateful(events.select("text", "seq", "event"), "text", step, "text string, seq long, status string", "status string")


def fresh_rows(rows: DataFrame) -> DataFrame:
    """rows: session, seq, generation, idx. Drops rows of an older generation, or not above the highest index seen."""

    def step(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        top = tuple(state.get) if state.exists else (-1, -1)
        kept = []
        for r in _in_order(pdfs).itertuples():
            if (r.generation, r.idx) > top:
                top = (int(r.generation), int(r.idx))
                kept.append((key[0], r.seq, r.generation, r.idx))
        state.update(top)
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(kept, columns=["session", "seq", "generation", "idx"])

    return _stateful(rows.select("session", "seq", "generation", "idx"), "session", step, "session string, seq long, generation long, idx long", "generation long, idx long")


def degrade(samples: DataFrame) -> DataFrame:
    """samples: session, seq, rtf. Each rise of the mitigation stage, by the mean of the last three samples."""

    def step(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        stage, n, mark, a, b = state.get if state.exists else (0, 0, 0, float("nan"), float("nan"))
        made = []
        for r in _in_order(pdfs).itertuples():
            n += 1
            mean = (a + b + r.rtf) / 3 if n >= 3 else float("nan")
            a, b = b, float(r.rtf)
            if mean >= SLOW and stage < 2 and (stage == 0 or n - mark >= WINDOW):
                stage, mark = stage + 1, n
                made.append((key[0], r.seq, stage))
        state.update((stage, n, mark, a, b))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(made, columns=["session", "seq", "stage"])

    return _stateful(samples.select("session", "seq", "rtf"), "session", step, "session string, seq long, stage int", "stage int, n long, mark long, a double, b double")


def finished(positions: DataFrame) -> DataFrame:
    """positions: session, seq, t, last_end, idle. The first row of a session that is idle a second past its end."""
    return positions.where((F.col("t") >= F.col("last_end") + 1) & F.col("idle")).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["session"])


def highlight(positions: DataFrame, spans: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Stream-static lookup of the sentence at each position: book, t against spans of book, start_time, index."""
    return positions.writeStream.foreachBatch(lambda b, i: sink(active_sentence(b, spans, "book", "t"), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_files(spark, path: str, schema: str = "type string, t double, payload string") -> DataFrame:
    """A stream of JSON-lines files."""
    return spark.readStream.schema(schema).json(path)
