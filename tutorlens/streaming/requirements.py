"""Requirement check of events as they come: the concepts that users have met are keyed state, events wait in state until
the watermark has passed them, and are then judged by the first meetings before them. Equal to audit.eligibility on the same
rows. Events later than the watermark when they come are left out (they could have changed what was already told)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import levels
from ..sources.files import shared_dir

JUDGED = "event_id long, user_id long, content_id int, r1 boolean, r2 boolean, r3 boolean, r4 boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Users of neighbouring ids, 2 ** SHARED_BITS of them, share a key. Each key costs a dozen calls to the state store, however few its events.
SHARED_BITS = 6
#: Rows of the judge's state. A user is `place`, the low bits of its id, and rows of no user are not `known`.
WAITING = pa.schema(
    [("event_id", pa.int64()), ("user", pa.int64()), ("known", pa.bool_()), ("content_id", pa.int32()), ("at", pa.int64()), ("r1", pa.bool_()), ("r2", pa.bool_())]
    + [(c, pa.list_(pa.int32())) for c in ("need3", "need4", "gives")]
)
MET = pa.schema([("place", pa.int64()), ("concept", pa.int64()), ("first", pa.int64())])


class Judge(StatefulProcessor):
    """State of a key's users: concepts met with the time (microseconds) of the first meeting, and events that wait, both as
    Arrow tables (waiting: one a batch that brought events). A timer stands at the earliest waiting event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.met = handle.getValueState("met", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, earliest = timerValues.getCurrentWatermarkInMs(), None
        for part in rows:
            part = part[part["listed"] & (part["at"] // 1000 >= passed)]
            if len(part):
                self.waiting.appendValue((_packed(pa.Table.from_pandas(part[WAITING.names], WAITING, preserve_index=False)),))
                first = int(part["at"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [_unpacked(r[0]) for r in self.waiting.get()]
        if not parts:
            return
        rows = pa.concat_tables(parts).combine_chunks()
        ripe = _array(rows, "at") // 1000 < timerValues.getCurrentWatermarkInMs()
        if not ripe.any():
            return
        ready, later = rows.filter(pa.array(ripe)), rows.filter(pa.array(~ripe))
        told = self.met.get()
        before = _unpacked(told[0]) if told else MET.empty_table()
        met = first_meetings(*(np.concatenate(both) for both in zip([_array(before, c) for c in MET.names], listed(ready, "gives"), strict=True)))
        if len(met[0]) > len(before):
            self.met.update((_packed(pa.table(list(met), MET)),))
        self.waiting.clear()
        if len(later):
            self.waiting.appendValue((_packed(later),))
            self.handle.registerTimer(int(_array(later, "at").min()) // 1000 + 1)
        out = {c: _array(ready, c) for c in ("event_id", "content_id", "r1", "r2")} | {f"r{need[4]}": lacks(ready, need, met) for need in ("need3", "need4")}
        out["user_id"] = pd.arrays.IntegerArray(_array(ready, "user").copy(), ~_array(ready, "known"))
        yield pd.DataFrame(out)[[c.split()[0] for c in JUDGED.split(", ")]]

    def close(self) -> None:
        pass


def first_meetings(place: np.ndarray, concept: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The earliest time of each user and concept, in their order."""
    order = np.lexsort((at, concept, place))
    place, concept, at = place[order], concept[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (concept[1:] != concept[:-1])
    return place[new], concept[new], at[new]


def lacks(rows: pa.Table, need: str, met: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a row needs a concept that its user had not met before it."""
    place, concept, at = listed(rows, need)
    joined = lambda places, concepts: (places << 32) + concepts  # noqa: E731, concepts are of 32 bits, so the order of met stays
    keys, asked = joined(*met[:2]), joined(place, concept)
    found = np.searchsorted(keys, asked)
    had = np.zeros(len(asked), dtype=bool)
    inside = found < len(keys)
    had[inside] = (keys[found[inside]] == asked[inside]) & (met[2][found[inside]] < at[inside])
    owner = np.repeat(np.arange(len(rows)), _lengths(rows, need))
    return np.bincount(owner[~had], minlength=len(rows)) > 0


def listed(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, concept, at) of each entry of a column of concepts; the place of no user is one that meets nothing."""
    n = _lengths(rows, column)
    place = np.where(_array(rows, "known"), _array(rows, "user") & ((1 << SHARED_BITS) - 1), 1 << SHARED_BITS)
    return np.repeat(place, n), rows[column].combine_chunks().flatten().to_numpy().astype("int64"), np.repeat(_array(rows, "at"), n)


def _lengths(rows: pa.Table, column: str) -> np.ndarray:
    return np.diff(rows[column].combine_chunks().offsets.to_numpy())


def _array(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].to_numpy()


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(rows)).read_all()


def facts(events: DataFrame, users: DataFrame, contents: DataFrame, topic_concepts: DataFrame, needs: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """events with what the judge has to know of their user and content; users and contents are tables. Rows without a time
    or an event_id are left out; the watermark of a stream sees all others, those of unknown contents too."""
    events = events.filter("ts is not null and event_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", lateness) if events.isStreaming else events
    empty = F.array().cast("array<int>")
    asked = needs.groupBy("content_id").agg(*[F.collect_list(F.when(F.col("rule") == r, F.col("concept_id"))).alias(f"need{r[1]}") for r in ("r3", "r4")])
    given = contents.join(topic_concepts, "topic").groupBy("content_id").agg(F.collect_set("concept_id").alias("gives"))
    known = contents.select("content_id", "difficulty", "is_investment_related").join(asked, "content_id", "left").join(given, "content_id", "left")
    r1, r2 = levels()
    # unknown contents are left to the judge: a filter here would be pushed below the watermark
    whole = events.join(users.select("user_id", "level", "experience"), "user_id", "left").join(known.withColumn("listed", F.lit(True)), "content_id", "left")
    user = F.col("user_id")
    engaged = user.isNotNull() & F.coalesce(F.col("event") != "disliked", F.lit(False))
    return whole.select(
        "event_id", F.coalesce(user, F.lit(0).cast("long")).alias("user"), user.isNotNull().alias("known"), F.coalesce("content_id", F.lit(0)).alias("content_id"), F.unix_micros("ts").alias("at"),
        F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce(r1, F.lit(False)).alias("r1"), F.coalesce(r2, F.lit(False)).alias("r2"), F.coalesce("need3", empty).alias("need3"), F.coalesce("need4", empty).alias("need4"),
        F.when(engaged, F.coalesce("gives", empty)).otherwise(empty).alias("gives"), F.shiftright(F.coalesce(user, F.col("event_id")), SHARED_BITS).alias("key"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """The stream of facts() with the rules that each event breaks; an event comes out once the watermark has passed it. Needs
    the RocksDB state store (see replay)."""
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Judge(), outputStructType=JUDGED, outputMode="Append", timeMode="EventTime")


def replay(source: DataFrame, tell, path: str | None = None) -> DataFrame:
    """All of a stream judged and read back as a table: tell(stream of events) gives facts(). Whatever is there is taken in
    one go; then the query starts again from its checkpoint with one closing row after the last event, which moves the
    watermark past the events that still wait. path: where rows and checkpoint go (a new place of the shared folder)."""
    spark = source.sparkSession
    path = path or f"{shared_dir(spark)}/tutorlens-requirements-{uuid.uuid4().hex}"
    closing = spark.createDataFrame([(-1, None, None, "2200-01-01 00:00:00", None, None)], "event_id long, user_id long, content_id int, ts string, score double, event string")
    closing = closing.select([F.col(c).cast(t).alias(c) for c, t in source.dtypes])
    closing.limit(0).write.parquet(f"{path}/closing")
    ends = spark.readStream.schema(source.schema).parquet(f"{path}/closing")
    timed = source.unionByName(ends)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for last in (False, True):
            if last:
                closing.write.mode("append").parquet(f"{path}/closing")
            run = judged(tell(timed)).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(JUDGED).parquet(f"{path}/rows")
