"""Web facts as a stream: events change a fact's state, timers make it stale when its time is over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorewell.operators.webfacts import EVENT_COLUMNS, TRANSITION, Fact, advanced, expired

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOLD = Row(*(c.split()[0] for c in TRANSITION.split(", ")))


def _plain(row: Row) -> dict:
    """An event as the batch has it, None for what is missing."""
    out = {k: None if isinstance(v, float) and v != v else v for k, v in row.asDict().items()}
    return out | {"at": out["at"] or 0}


def _order(e: dict) -> tuple:
    """By time, number and kind, null first."""
    return (e["at"], e["seq"] is not None, e["seq"] or 0, e["op"] or "")


class FactProcessor(StatefulProcessor):
    """Holds each fact as one value; a timer waits for the second at which it is too old.

    What is held says which timer waits, so timers aren't listed, and what doesn't change isn't written: each call of the
    state costs more than an event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fact = handle.getValueState("fact", "packed string")

    def _kept(self, fact: Fact | None, before: str | None, due: int | None) -> None:
        after = fact.packed() if fact else None
        if after is None or after == before:
            return
        self.fact.update((after,))
        if fact.expires_at() != due:
            if due is not None:
                self.handle.deleteTimer(due * 1000)
            if fact.expires_at() is not None:
                self.handle.registerTimer(fact.expires_at() * 1000)

    def _known(self) -> tuple[Fact | None, str | None, int | None]:
        """The fact, as it is held, and when its timer is due."""
        held = self.fact.get()
        fact = Fact.unpacked(held[0]) if held else None
        return fact, held[0] if held else None, fact.expires_at() if fact else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fact, before, due = self._known()
        for e in sorted(map(_plain, rows), key=_order):
            fact, made = advanced(key[0], fact, e, True)
            yield from (_TOLD(*r) for r in made)
        self._kept(fact, before, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fact, before, due = self._known()
        yield from (_TOLD(*r) for r in expired(key[0], fact, expiredTimerInfo.getExpiryTimeInMs() // 1000))
        self._kept(fact, before, due)

    def close(self) -> None:
        pass


def fact_transitions(events: DataFrame) -> DataFrame:
    """Transitions of a stream of events (EVENT_COLUMNS), as operators.webfacts.transitions gives with expire_until at the
    watermark, a second before the latest event.  Events of one fact are put in order within a batch; batches come in the
    order of time, and what is older than the watermark, or than 1970, is late and left out."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.where("fact_id is not null").select(*EVENT_COLUMNS).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", "1 second")
    return timed.groupBy("fact_id").transformWithState(FactProcessor(), TRANSITION, "Append", "EventTime")


def transitions_of_files(spark: SparkSession, path: str, out: str, checkpoint: str, files_at_once: int = 1) -> DataFrame:
    """Runs until the files below a path are read, the oldest first, and returns the transitions."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    query = fact_transitions(source).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", out).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(TRANSITION).parquet(out)
