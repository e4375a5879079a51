"""Live sessions as streams: the rules of `colloquy.operators.folds` on keyed state.

A session's state is the few counters that its rule keeps, in the state store; it goes when the session is silent for the
time to live, by an event-time timer. Order within a session is that of time, then id, among the rows of a micro-batch;
rows behind the watermark are dropped by the stateful operator and can be taken aside by `late_rows` first. The state
store has to be RocksDB (see CONF).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState
from pyspark.sql.types import StructType

from colloquy.operators import folds
from colloquy.operators.folds import Fold

#: What a session needs for these streams.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY = 86_400_000


def _ordered(frames: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(list(order), kind="stable")


class _Entries:
    """A rule's table of entries in the state store: an event reads and writes its own alone."""

    def __init__(self, state: MapState):
        self.state = state

    def get(self, key):
        return self.state.getValue((key,))[0] if self.state.containsKey((key,)) else None

    def __setitem__(self, key, value) -> None:
        self.state.updateValue((key,), (value,))

    def pop(self, key) -> None:
        self.state.removeKey((key,))

    def items(self):
        return ((k[0], v[0]) for k, v in self.state.iterator())


class _Timer:
    """The one timer of a session, whose time is kept beside it; a later one takes its place."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.at = handle, handle.getValueState("timer", StructType().add("at", "long"))

    def set(self, at: int) -> None:
        if self.at.exists():
            self.handle.deleteTimer(self.at.get()[0])
        self.handle.registerTimer(at)
        self.at.update((at,))

    def clear(self) -> None:
        self.at.clear()


class _Processor(StatefulProcessor):
    """Steps a rule over the rows of a session."""

    def __init__(self, rule: Fold, order: Sequence[str], kept: Sequence[str], ttl_ms: int, schema: StructType):
        self.rule, self.order, self.kept, self.ttl_ms, self.schema = rule, order, kept, ttl_ms, schema
        self.kept_state = StructType.fromDDL(rule.state)
        self.kept_entries = [StructType().add(name, kind) for name, kind in zip(("key", "value"), rule.entries or (), strict=False)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.kept_state)
        self.timer = _Timer(handle)
        if self.rule.entries:
            self.entries = handle.getMapState("entries", *self.kept_entries)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, self.order)
        state = self.state.get() if self.state.exists() else self.rule.start
        table = [_Entries(self.entries)] if self.rule.entries else []
        out = []
        for values in zip(*(batch[c].tolist() for c in self.rule.columns), strict=True):
            state, said = self.rule.step(tuple(state), *table, *values)
            out.append(said)
        self.state.update(tuple(state))
        self.timer.set(max(int(batch["ms"].max()), timerValues.getCurrentWatermarkInMs()) + self.ttl_ms)
        made = pd.DataFrame(out, columns=self.rule.names(), index=batch.index).astype(object)
        yield pd.concat([batch[list(self.kept)], made], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.timer.clear()
        if self.rule.entries:
            self.entries.clear()
        yield pd.DataFrame(columns=self.schema.fieldNames()).astype(object)

    def close(self) -> None:
        pass


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with their time as ts, and a watermark on it, if they have none yet."""
    return events if "ts" in events.columns else events.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", delay)


def _run(events: DataFrame, processor: StatefulProcessor, schema: StructType, delay: str) -> DataFrame:
    passed_on = "ts" if "ts" in schema.fieldNames() else ""
    return timed(events, delay).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventtime", eventTimeColumnName=passed_on,
    )


def followed(events: DataFrame, rule: Fold, kept: Sequence[str] = ("session_id", "event_id"), delay: str = "1 hour", ttl_ms: int = DAY, order: Sequence[str] = ("ms", "event_id")) -> DataFrame:
    """The kept columns of a stream of events, and what the rule says at each; the batch twin is folds.fold.

    events: session_id, event_id, ms and the rule's columns. With ts among the kept columns the watermark goes on with
    them, so that the result can be followed by a further rule.
    """
    schema = StructType([(timed(events, delay).schema)[c] for c in kept] + StructType.fromDDL(rule.out).fields)
    return _run(events, _Processor(rule, order, kept, ttl_ms, schema), schema, delay)


class _Enrolment(StatefulProcessor):
    """Enrols two voices; embeddings from before that wait in a list, and get their roles when it is done."""

    def __init__(self, same: float, weight: float, ttl_ms: int, schema: StructType):
        self.rule, self.ttl_ms, self.schema = folds.enrol(same, weight), ttl_ms, schema
        self.two, self.one = StructType.fromDDL(self.rule.state), StructType.fromDDL("event_id long, embedding array<double>")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timer = _Timer(handle)
        self.voices = handle.getValueState("voices", self.two)
        self.waiting = handle.getListState("waiting", self.one)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ("ms", "event_id"))
        state = tuple(self.voices.get()) if self.voices.exists() else self.rule.start
        out = []
        for event_id, embedding in zip(batch["event_id"].tolist(), batch["embedding"].tolist(), strict=True):
            embedding = [float(x) for x in embedding]
            state, (phase, *_) = self.rule.step(state, embedding)
            if phase in ("interviewer", "update"):
                self.waiting.appendValue((event_id, embedding))
                continue
            before = [(i, list(e)) for i, e in self.waiting.get()] if phase == "candidate" and self.waiting.exists() else []
            if before:
                self.waiting.clear()
            for i, e in [*before, (event_id, embedding)]:
                role = "candidate" if folds.alike(e, list(state[1])) > folds.alike(e, list(state[0])) else "interviewer"
                out.append((key[0], i, role, i != event_id))
        self.voices.update(state)
        self.timer.set(max(int(batch["ms"].max()), timerValues.getCurrentWatermarkInMs()) + self.ttl_ms)
        yield pd.DataFrame(out, columns=self.schema.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A session that ends without a second voice: all that waits is the interviewer's."""
        left = [(key[0], i, "interviewer", True) for i, _ in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        self.voices.clear()
        self.timer.clear()
        yield pd.DataFrame(left, columns=self.schema.fieldNames())

    def close(self) -> None:
        pass


def enrolled_roles(events: DataFrame, same: float = 0.75, weight: float = 0.2, delay: str = "1 hour", ttl_ms: int = DAY) -> DataFrame:
    """(session_id, event_id, role, corrected) for a stream of embeddings (session_id, event_id, ms, embedding).

    corrected: the embedding came before both voices were known, and gets its role afterwards.
    """
    schema = StructType([events.schema["session_id"], events.schema["event_id"], *StructType.fromDDL("role string, corrected boolean").fields])
    return _run(events, _Enrolment(same, weight, ttl_ms, schema), schema, delay)


def running(columns: Sequence[str], least: dict[str, int]) -> Fold:
    """Sums of a session's counts so far, and the kinds of questions it has answered: what rolling features follow from.

    A row has kind, the kind of question if an interviewer asks one; the candidate's next answer takes it.
    """

    def step(state: tuple, speaker: str, told: bool, kind: str, *values: int) -> tuple[tuple, tuple]:
        pending, kinds, *sums = state
        sums = [a + b for a, b in zip(sums, values, strict=True)]
        if speaker == "interviewer":
            pending = kind
        elif speaker == "candidate":
            if told and (pending or "unlabelled") not in kinds.split(","):
                kinds = f"{kinds},{pending or 'unlabelled'}".strip(",")
            pending = ""
        out = [max(least.get(c, 0), s) for c, s in zip(columns, sums, strict=True)]
        return (pending, kinds, *sums), (len(kinds.split(",")) if kinds else 0, *out)

    state = "pending string, kinds string, " + ", ".join(f"{c} long" for c in columns)
    return Fold(("speaker", "told", "kind", *columns), state, ("", "", *[0] * len(columns)), "n_types bigint, " + ", ".join(f"sofar_{c} bigint" for c in columns), step)


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once while the watermark lets it repeat."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def activity(frames: DataFrame, gap_ms: int = 400, delay: str = "1 minute", least_ms: int = 1000) -> DataFrame:
    """Segments of active frames (stream_id, ts, energy, prob) that end after a gap; short ones are dropped.

    The length is taken from the frames: a filter on the window itself would be pushed below the aggregate, to where
    each frame still has a window of its own.
    """
    active = frames.where("energy >= 0.005 and prob > 0.6").withWatermark("ts", delay)
    out = active.groupBy("stream_id", F.session_window("ts", f"{gap_ms} milliseconds").alias("w")).agg(F.count("*").alias("frames"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.where(F.unix_millis("last") - F.unix_millis("first") + gap_ms >= least_ms).select("stream_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def late_rows(batch: DataFrame, watermark_ms: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch, for foreachBatch: late ones go to a table of their own."""
    late = F.unix_millis("ts") < watermark_ms
    return batch.where(~late), batch.where(late)
