"""Guards and tag readers over Structured Streaming: what they hold of a document is state, and timers end what stalls.

Chunks (doc_id, chunk_no, ts, text, and `last` where they have it) come in any micro-batches; within one they are taken in order of
chunk_no. State and timers live in the RocksDB store, by document, through Spark's processors of arbitrary state. Time is that of the chunks: a
timer fires once the watermark has passed it, whether or not the document has another chunk. A document that has ended leaves a
mark, so that chunks that still come are passed over; a second timer takes that away after `keep_s`.

Defined results: those of guard_batch() and read_tags() over the same chunks, `until` being the watermark; chunks without a time set no
timers; chunks behind the watermark (`delay`) are passed over; a document of which no row has been let through yet has no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.streaming.guard import FRESH, Guard, Limits, Run, TagReader

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _ByDocument(StatefulProcessor):
    """State of a document as one text; `until` is its timer in ms, if it has one."""

    keep_s = 3600.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held string")

    def close(self) -> None:
        pass

    def held(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def hold(self, held: dict, until: float | None) -> None:
        """Keeps what is held, and sets the timer anew if it is another; without a time there is none."""
        ms = None if until is None else int(until * 1000) + 1
        if held.get("until") != ms:
            if held.get("until") is not None:
                self.handle.deleteTimer(held["until"])
            if ms is not None:
                self.handle.registerTimer(ms)
        self.state.update((json.dumps(held | {"until": ms}),))

    def taken(self, held: dict, came: pd.DataFrame, latest: float | None) -> tuple[dict, pd.DataFrame | None, float | None]:
        """(what is held now, a row or none, when the timer is due) once the chunks have come."""
        raise NotImplementedError

    def timed_out(self, key: tuple, held: dict) -> pd.DataFrame | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        came = pd.concat(list(rows)).sort_values(["chunk_no", "text"])
        if held.get("over"):
            return
        latest = max([t.timestamp() for t in came["ts"].dropna()] + [t for t in [held.get("latest")] if t is not None], default=None)
        now, row, due = self.taken(held, came, latest)
        if now["over"]:
            now, due = {"over": True}, None if latest is None else latest + self.keep_s
        self.hold(now | {"latest": latest, "until": held.get("until")}, due)
        if row is not None:
            yield row.assign(doc_id=key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, at = self.held(), expiredTimerInfo.getExpiryTimeInMs()
        if held.get("until") != at:
            return
        if held.get("over"):
            self.state.clear()
            return
        row = self.timed_out(key, held)
        self.hold({"over": True}, at / 1000 + self.keep_s)
        if row is not None:
            yield row.assign(doc_id=key[0])


class _Guarded(_ByDocument):
    def __init__(self, limits: Limits | None, limit_s: float | None, keep_s: float):
        self.limits, self.limit_s, self.keep_s = limits, limit_s, keep_s

    def _run(self, held: dict) -> Run:
        return Run(Guard(self.limits, held.get("state", dict(FRESH))), self.limit_s, held.get("start"), came=held.get("came", 0))

    def _row(self, text: str, run: Run) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [None], "text": [text], "stopped": [run.stopped], "timed_out": [run.late]})

    def taken(self, held, came, latest):
        run = self._run(held)
        last = came["last"] if "last" in came else [None] * len(came)
        shown = [run.take(t, None if pd.isna(at) else at.timestamp(), None if pd.isna(end) else bool(end)) for t, at, end in zip(came["text"], came["ts"], last, strict=True)]
        now = {"state": run.guard.state, "start": run.start, "came": run.came, "over": run.over}
        return now, self._row("".join(shown), run), None if run.start is None or self.limit_s is None else run.start + self.limit_s

    def timed_out(self, key, held):
        run = self._run(held)
        return self._row(run.await_until(float("inf")), run)


class _Tagged(_ByDocument):
    def __init__(self, mode: str | None, idle_s: float, most: int, keep_s: float):
        self.mode, self.idle_s, self.most, self.keep_s = mode, idle_s, most, keep_s

    def _reader(self, held: dict) -> TagReader:
        reader = TagReader(self.mode, self.most)
        reader.held, reader.trims = held.get("held", ""), held.get("trims", False)
        return reader

    def taken(self, held, came, latest):
        reader, shown, over = self._reader(held), [], False
        for text, end in zip(came["text"], came["last"] if "last" in came else [None] * len(came), strict=True):
            if over:
                break
            shown.append(reader.feed(text or ""))
            over = not pd.isna(end) and bool(end)
        shown.append(reader.end() if over else "")
        row = pd.DataFrame({"doc_id": [None], "shown": ["".join(shown)], "boxes": [len(reader.boxes)]})
        return {"held": reader.held, "trims": reader.trims, "over": over}, row, None if latest is None else latest + self.idle_s

    def timed_out(self, key, held):
        return pd.DataFrame({"doc_id": [None], "shown": [self._reader(held).end()], "boxes": [0]})


def _processed(chunks: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    chunks.sparkSession.conf.set(*STORE)  # timers need it
    names = [c for c in ("doc_id", "chunk_no", "ts", "text", "last") if c in chunks.columns]
    watched = chunks.select(*names).withWatermark("ts", delay)
    return watched.groupBy("doc_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


GUARDED = "doc_id long, text string, stopped boolean, timed_out boolean"


def guard_stream(chunks: DataFrame, limits: Limits | None = None, limit_s: float | None = None, delay: str = "0 seconds", keep_s: float = 3600.0) -> DataFrame:
    """GUARDED rows, one for each micro-batch of a document until it ends: what the guard lets through of the chunks that came; and
    a row with the mark for a document that has not ended `limit_s` after its first chunk."""
    return _processed(chunks, _Guarded(limits, limit_s, keep_s), GUARDED, delay)


TAGGED = "doc_id long, shown string, boxes long"


def tag_stream(chunks: DataFrame, mode: str | None, idle_s: float = 60.0, most: int = 1000, delay: str = "0 seconds", keep_s: float = 3600.0) -> DataFrame:
    """TAGGED rows, one for each micro-batch of a document: the text that is certain, and how many boxes its tags held.

    A tag that has begun is state until the micro-batch that ends it. What is still held back comes with the document's `last` chunk, or `idle_s` after
    its latest one.
    """
    return _processed(chunks, _Tagged(mode, idle_s, most, keep_s), TAGGED, delay)
