"""Rules that follow a session's events one after the other: each is a small step over a few counters.

A batch sorts the rows of each partition by session and time and walks over them once; what is kept from row to row is
the state alone, and each row leaves as it is done, so a long session needs no more memory than a short one. The streams
in `colloquy.streaming` run the same steps on keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, MutableMapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

State = tuple


@dataclass(frozen=True)
class Fold:
    """step(state, *values of the columns) gives (new state, values of out). state: the DDL of what is kept.

    entries: the types of key and value of a table that the rule keeps beside it, of which each event reads and writes a
    few entries; step gets it after the state, as a mapping with get, pop, items and assignment.
    """

    columns: tuple[str, ...]
    state: str
    start: State
    out: str
    step: Callable[..., tuple[State, tuple]]
    entries: tuple[str, str] | None = None

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.out.split(", ")]


def fold(rows: DataFrame, rule: Fold, key: str = "session_id", order: Sequence[str] = ("ms", "event_id")) -> DataFrame:
    """rows with the columns of the rule's out, for each key in the given order. Null keys are a session of their own.

    One session is one task's work in sequence, as the rule asks; sessions of all sizes pass through in batches.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(rule.out).fields])
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    types = [arrow[f.dataType.simpleString()] for f in schema.fields[len(rows.columns) :]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = run  # no key is equal to it
        state = rule.start
        table: dict = {}
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *rule.columns)), strict=True):
                if k != now:
                    now, state, table = k, rule.start, {}
                state, said = rule.step(state, *([table] if rule.entries else []), *values)
                out.append(said)
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.fieldNames())

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def refresh(segments: int = 2, chars: int = 80) -> Fold:
    """Fires at a segment if since the last fire there are enough segments or candidate characters."""

    def step(s: State, speaker: str, n_chars: int) -> tuple[State, tuple]:
        n, c = s[0] + 1, s[1] + (n_chars if speaker == "candidate" else 0)
        fire = n >= segments or c >= chars
        return ((0, 0) if fire else (n, c)), (fire,)

    return Fold(("speaker", "chars"), "n long, c long", (0, 0), "fired boolean", step)


def fast(wait_ms: int = 1000, chars: int = 20) -> Fold:
    """Fires if the last fire is long enough ago and since then there is a segment, or enough characters, or a partial text that grew.

    Characters are those of the candidate's segments and partial text. A partial text is replaced by the next one, and
    goes with a segment of its speaker or when it is blank.
    """

    def step(s: State, ms: int, kind: str, speaker: str, n_chars: int) -> tuple[State, tuple]:
        n, told, part, at, last_n, last_chars = s
        mine = speaker == "candidate"
        if kind == "final":
            n, told, part = n + 1, told + (n_chars if mine else 0), 0 if mine else part
        elif mine:
            part = n_chars
        now = told + part
        fire = (n > 0 or part > 0) and (at is None or ms - at >= wait_ms) and (n - last_n >= 1 or now - last_chars >= chars or (part > 0 and now > last_chars))
        return ((n, told, part, ms, n, now) if fire else (n, told, part, at, last_n, last_chars)), (fire,)

    state = "n long, told long, part long, at long, last_n long, last_chars long"
    return Fold(("ms", "kind", "speaker", "chars"), state, (0, 0, 0, None, 0, 0), "fired boolean", step)


def throttle(wait_ms: int = 10_000) -> Fold:
    """Emits if the signature differs from the last emitted one, or that is long enough ago."""

    def step(s: State, ms: int, signature: str) -> tuple[State, tuple]:
        sig, at = s
        emit = at is None or signature != sig or ms - at >= wait_ms
        return ((signature, ms) if emit else s), (emit,)

    return Fold(("ms", "signature"), "sig string, at long", (None, None), "emitted boolean", step)


def both(one: Fold, other: Fold) -> Fold:
    """Two rules over the same events, with the columns of both; neither may keep entries."""
    k, n = len(one.start), len(one.columns)

    def step(s: State, *values: Any) -> tuple[State, tuple]:
        a, x = one.step(s[:k], *values[:n])
        b, y = other.step(s[k:], *values[n:])
        return (*a, *b), (*x, *y)

    return Fold(one.columns + other.columns, f"{one.state}, {other.state}", (*one.start, *other.start), f"{one.out}, {other.out}", step)


def single_flight(wait_ms: int = 8000, ttl_ms: int | None = None) -> Fold:
    """What becomes of a request: cached if its key ran before, throttled if the last run is too near, else run.

    ttl_ms: how long a key counts as having run; older ones are forgotten. The keys are entries of a table: an event looks
    at its own alone, and all are looked through only once for as many runs as there are keys.
    """

    def step(s: State, ran: MutableMapping[str, int], ms: int, request: str) -> tuple[State, tuple]:
        at, runs, kept = s
        before = ran.get(request)
        if before is not None and (ttl_ms is None or ms - before <= ttl_ms):
            return s, ("cached",)
        if at is not None and ms - at < wait_ms:
            return s, ("throttled",)
        ran[request] = ms
        runs += 1
        if ttl_ms is not None and runs > max(kept, 16):
            entries = list(ran.items())
            old = [k for k, v in entries if ms - v > ttl_ms]
            for k in old:
                ran.pop(k)
            runs, kept = 0, len(entries) - len(old)
        return (ms, runs, kept), ("run",)

    return Fold(("ms", "request"), "at long, runs long, kept long", (None, 0, 0), "outcome string", step, ("string", "long"))


def smoothed(before: int | None, now: int) -> int:
    """0.58 of the score before and 0.42 of the new one, rounded half to even; the first as it is."""
    return now if before is None else round((58 * before + 42 * now) / 100)


def ema() -> Fold:
    def step(s: State, value: int) -> tuple[State, tuple]:
        out = smoothed(s[0], value)
        return (out,), (out,)

    return Fold(("value",), "score long", (None,), "score bigint", step)


def append(registered: bool = False) -> Fold:
    """Numbers the segments of an active session. Others are rejected with the reason: unknown, not_active or blank.

    registered: a session is known only after an event of kind open, which is its registration.
    """

    def step(s: State, kind: str, chars: int, ended: bool) -> tuple[State, tuple]:
        n, known, over = s
        if kind == "open":
            return (n, True, over), (None, "open")
        if not known:
            return s, (None, "unknown")
        if over:
            return s, (None, "not_active")
        if not chars:
            return (n, known, ended), (None, "blank")
        return (n + 1, known, ended), (n + 1, "ok")

    return Fold(("kind", "chars", "ended"), "n long, known boolean, over boolean", (0, not registered, False), "seg_id bigint, status string", step)


def partials() -> Fold:
    """Characters of the candidate's partial text after each event; null without one. The candidate's segment, or a blank, takes it away."""

    def step(s: State, kind: str, speaker: str, chars: int) -> tuple[State, tuple]:
        if speaker != "candidate":
            return s, (s[0] or None,)
        part = chars if kind == "partial" else 0
        return (part,), (part or None,)

    return Fold(("kind", "speaker", "chars"), "part long", (0,), "partial bigint", step)


def speaker_partials() -> Fold:
    """The partial text of an event's speaker after it, and how many speakers have one.

    A partial text takes the place of the speaker's last one; a blank one, or a segment of the speaker, takes it away.
    """

    def step(s: State, parts: MutableMapping[str, str], kind: str, speaker: str, text: str | None) -> tuple[State, tuple]:
        (n,) = s
        had = parts.get(speaker) is not None
        if kind == "partial" and (text or "").strip():
            parts[speaker] = text
            return (n + (not had),), (text, n + (not had))
        if had:
            parts.pop(speaker)
        return (n - had,), (None, n - had)

    return Fold(("kind", "speaker", "text"), "n long", (0,), "partial string, n_open bigint", step, ("string", "string"))


def change(jump: float = 0.2, louder: float = 0.5) -> Fold:
    """Is a frame a point of change? The features of the two frames before it are the state; the rule is frames.change_sql's."""

    def step(s: State, now: list[float]) -> tuple[State, tuple]:
        one, two = s
        changed = False
        if one is not None:
            near = max(abs(a - b) for a, b in zip(now, one, strict=True))
            if two is None:
                changed = near > round(1.5 * jump, 9)
            else:
                loud = abs(1 - now[0] / one[0]) if one[0] > 0 else 0
                far = sum(abs(a - b) for a, b in zip(now, two, strict=True)) / len(now)
                changed = (near > jump or loud > louder) and far > round(0.7 * jump, 9)
        return (list(now), one), (changed,)

    return Fold(("features",), "one array<double>, two array<double>", (None, None), "changed boolean", step)


def hysteresis(silence_ms: int = 300, least_ms: int = 250, prob: float = 0.5) -> Fold:
    """The segment that a frame closes, else nulls: after silence_ms without activity one more inactive frame closes it.

    The counter of inactive frames is the state, with the open segment; the rule is frames.hysteresis_sql's.
    """

    def step(s: State, ms: int, p: float) -> tuple[State, tuple]:
        n, was, waited, first, last, active = s
        on = p > prob
        was = ms if on else was
        quiet = not on and was is not None and ms - was >= silence_ms
        if quiet and waited:
            told = first is not None and last - first >= least_ms
            out = (n + 1, first, last, active) if told else (None,) * 4
            return (n + told, was, quiet, None, None, 0), out
        first = ms if on and first is None else first
        if first is not None:
            last, active = ms, active + on
        return (n, was, quiet, first, last, active), (None,) * 4

    state = "n long, was long, waited boolean, first long, last long, active long"
    return Fold(("ms", "prob"), state, (0, None, False, None, None, 0), "seg bigint, start_ms bigint, end_ms bigint, active bigint", step)


def until_end() -> Fold:
    """Where a session is: active, completed at its end event, not_active after it."""

    def step(s: State, ended: bool) -> tuple[State, tuple]:
        if s[0]:
            return s, ("not_active",)
        return (bool(ended),), ("completed" if ended else "active",)

    return Fold(("ended",), "over boolean", (False,), "status string", step)


DISC = "CDIS"  # equal scores are ranked by letter


def live(roles: dict[str, tuple[str, ...]], least_chars: int = 20, most_roles: int = 4) -> Fold:
    """Live scores: smoothed from one analysis to the next, with deltas, and roles that stay while the two first styles do.

    With too few candidate characters a row is collecting, with scores of 0, from which later ones are smoothed.
    """

    def step(s: State, chars: int, *raw: int) -> tuple[State, tuple]:
        *before, signature, kept = s
        if chars < least_chars:
            return (0, 0, 0, 0, "", kept), ("collecting", "", "", 0, 0, 0, 0, 0, 0, 0, 0, kept or "")
        now = [smoothed(b, r) for b, r in zip(before, raw, strict=True)]
        deltas = [0 if b is None else n - b for b, n in zip(before, now, strict=True)]
        first, second = (DISC[i] for i in sorted(range(4), key=lambda i: (-now[i], i))[:2])
        if signature != first + second or not kept:
            kept = ",".join(list(dict.fromkeys([*roles[first], *roles[second]]))[:most_roles])
        return (*now, first + second, kept), ("ready", first, second, *now, *deltas, kept)

    scores = [f"disc_{d.lower()}" for d in DISC]
    out = ["status string", "dominant string", "secondary string", *(f"live_{d.lower()} bigint" for d in DISC), *(f"delta_{d.lower()} bigint" for d in DISC), "roles string"]
    return Fold(("cand_chars", *scores), "c long, d long, i long, s long, signature string, roles string", (None,) * 4 + ("", None), ", ".join(out), step)


def _unit(v: list[float]) -> list[float]:
    size = max(sum(x * x for x in v) ** 0.5, 1e-8)
    return [x / size for x in v]


def alike(a: list[float], b: list[float]) -> float:
    """(cosine + 1) / 2."""
    size = max(sum(x * x for x in a) ** 0.5, 1e-8) * max(sum(x * x for x in b) ** 0.5, 1e-8)
    return (sum(x * y for x, y in zip(a, b, strict=True)) / size + 1) / 2


def enrol(same: float = 0.75, weight: float = 0.2) -> Fold:
    """Automatic enrolment: the first embedding is the interviewer's, those like it update it, the first other one is the candidate's and ends it.

    phase: interviewer, update, candidate or done. size: the interviewer's similarity to this embedding, 1 at first.
    """

    def step(s: State, embedding: list[float]) -> tuple[State, tuple]:
        a, b = s
        if b is not None:
            return s, ("done", None, a, b)
        if a is None:
            return (embedding, None), ("interviewer", 1.0, embedding, None)
        near = alike(a, embedding)
        if near >= same:
            mixed = _unit([x * (1 - weight) + y * weight for x, y in zip(a, embedding, strict=True)])
            return (mixed, None), ("update", near, mixed, None)
        return (a, embedding), ("candidate", near, a, embedding)

    return Fold(("embedding",), "a array<double>, b array<double>", (None, None), "phase string, similarity double, interviewer array<double>, candidate array<double>", step)


def profile(weight: float = 0.2) -> Fold:
    """A profile after each sample in order: (1 - weight) old + weight sample, of unit length; the first as it is."""

    def step(s: State, embedding: list[float]) -> tuple[State, tuple]:
        new = embedding if s[0] is None else _unit([x * (1 - weight) + y * weight for x, y in zip(s[0], embedding, strict=True)])
        return (new,), (new,)

    return Fold(("embedding",), "p array<double>", (None,), "profile array<double>", step)
