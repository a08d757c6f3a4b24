"""Bundles of pages that arrive in any order, cut into segments once complete.

A bundle's pages are kept as state until it has been silent for a while of
event time: a timer, set anew by each arrival, then lets them go all at once.
What is let go is a table of whole bundles, to which the batch operator is
applied, so a stream has the segments that a table has.  A page that comes
twice is one; a page that comes after its bundle has gone begins it anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leafwright.operators import segments

#: A page as analysed, with the time of its arrival.
PAGES = "bundle string, page long, provider string, dos string, doc_type string, is_separator boolean, is_cover boolean, at timestamp"
_KEPT = "page long, provider string, dos string, doc_type string, is_separator boolean, is_cover boolean"
_NAMES = [c.split()[0] for c in _KEPT.split(", ")]
#: Pages handed on at a time.
_CHUNK = 10_000


class _Bundle(StatefulProcessor):
    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # by number, so that a page is kept once
        self.pages = handle.getMapState("pages", "page long", _KEPT.removeprefix("page long, "))
        self.seen = handle.getValueState("seen", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0] if self.seen.exists() else 0
        for pdf in rows:
            for r in pdf[[*_NAMES, "ms"]].astype(object).where(pdf[[*_NAMES, "ms"]].notna(), None).itertuples(index=False):
                self.pages.updateValue((int(r[0]),), (r[1], r[2], r[3], None if r[4] is None else bool(r[4]), None if r[5] is None else bool(r[5])))
                last = max(last, int(r[6]))
        self.seen.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.silence)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        chunk: list[tuple] = []
        for number, kept in self.pages.iterator():
            chunk.append((key[0], number[0], *kept))
            if len(chunk) >= _CHUNK:
                yield pd.DataFrame(chunk, columns=["bundle", *_NAMES])
                chunk = []
        if chunk:
            yield pd.DataFrame(chunk, columns=["bundle", *_NAMES])
        self.pages.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def completed(arriving: DataFrame, silence: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The pages (columns of ``PAGES`` but ``at``) of bundles that have been
    silent for a while of event time, each bundle in one batch."""
    spark = arriving.sparkSession
    # timers and maps need this store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    timed = arriving.withWatermark("at", late).where("bundle is not null and page is not null").withColumn("ms", F.unix_millis("at"))
    return timed.groupBy("bundle").transformWithStateInPandas(_Bundle(ms), f"bundle string, {_KEPT}", "Append", "EventTime")


def segmented(arriving: DataFrame, keep: Callable[[DataFrame], None], checkpoint: str, silence: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """A query that hands the segments of completed bundles to ``keep``; a batch
    that is repeated after a failure hands the same ones again."""

    def run(pages: DataFrame, number: int) -> None:
        pages = pages.persist()
        if not pages.isEmpty():
            keep(segments.index_segments(pages))
        pages.unpersist()

    return completed(arriving, silence, late).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
