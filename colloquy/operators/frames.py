"""Frames of an audio stream (stream_id, frame_id, ms, energy, prob) to segments of activity and points of change.

Each is windows over a stream's frames in order of time; the text is SQL that both Spark and ANSI engines read, over a
table `frames`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

BY = "partition by stream_id order by ms, frame_id"
PAST = f"({BY} rows between unbounded preceding and 1 preceding)"
SOFAR = f"({BY} rows between unbounded preceding and current row)"


def activity_sql(gap_ms: int = 400, least_ms: int = 1000, energy: float = 0.005, prob: float = 0.6) -> str:
    """A segment closes after gap_ms without activity, which is part of its length; short ones are dropped. The last one can be open."""
    return f"""
with f as (select *, case when energy >= {energy} and prob > {prob} then 1 else 0 end as on_ from frames),
a as (select *, max(case when on_ = 1 then ms end) over {PAST} as was, max(ms) over (partition by stream_id) as ends from f),
b as (select *, sum(case when on_ = 1 and (was is null or ms - was > {gap_ms}) then 1 else 0 end) over {SOFAR} as seg from a),
c as (select stream_id, seg, min(case when on_ = 1 then ms end) as first, max(case when on_ = 1 then ms end) as last, sum(on_) as active, max(ends) as ends from b where seg > 0 group by stream_id, seg)
select stream_id, cast(seg as bigint) as seg, first as start_ms, last + {gap_ms} as end_ms, cast(active as bigint) as active, case when ends - last >= {gap_ms} then 'silence_timeout' else 'open' end as reason
from c where last + {gap_ms} - first >= {least_ms}"""


def hysteresis_sql(silence_ms: int = 300, least_ms: int = 250, prob: float = 0.5) -> str:
    """After silence_ms without activity one more inactive frame, which is not part of the segment, closes it; open ones do not count."""
    return f"""
with f as (select *, prob > {prob} as on_ from frames),
a as (select *, max(case when on_ then ms end) over {SOFAR} as was from f),
b as (select *, case when not on_ and ms - was >= {silence_ms} then 1 else 0 end as quiet from a),
q as (select *, coalesce(lag(quiet) over ({BY}), 0) as quiet_before from b),
n as (select *, case when quiet = 1 and quiet_before = 1 then 1 else 0 end as closes from q),
o as (select *, coalesce(sum(closes) over {PAST}, 0) as run from n),
g as (select *, min(case when on_ then ms end) over (partition by stream_id, run) as first from o),
h as (select stream_id, run, max(first) as first, max(case when closes = 0 then ms end) as last, max(closes) as closed, sum(case when on_ then 1 else 0 end) as active from g where ms >= first group by stream_id, run)
select stream_id, cast(row_number() over (partition by stream_id order by run) as bigint) as seg, first as start_ms, last as end_ms, cast(active as bigint) as active
from h where closed = 1 and last - first >= {least_ms}"""


def change_sql(features: Sequence[str], jump: float = 0.2, louder: float = 0.5) -> str:
    """A frame whose features jump from the one before, or whose energy changes much, and that is far from the one before that too.

    The first of the features is the energy. With one frame of history a jump has to be half as large again.
    """
    lags = ", ".join(f"lag({x}, {k}) over ({BY}) as {x}_{k}" for x in features for k in (1, 2))
    near = "greatest(" + ", ".join(f"abs({x} - {x}_1)" for x in features) + ")"
    far = "(" + " + ".join(f"abs({x} - {x}_2)" for x in features) + f") / {len(features)}"
    first = features[0]
    return f"""
with a as (select *, {lags} from frames),
b as (select *, {near} as jump, case when {first}_1 > 0 then abs(1 - {first} / {first}_1) else 0 end as louder, {far} as older from a)
select stream_id, frame_id, case when {first}_1 is null then false when {first}_2 is null then jump > {round(1.5 * jump, 9)} else (jump > {jump} or louder > {louder}) and older > {round(0.7 * jump, 9)} end as changed from b"""


def activity(rows: DataFrame, **parameters: float) -> DataFrame:
    return rows.sparkSession.sql(activity_sql(**parameters).replace("from frames", "from {frames}"), frames=rows)


def activity_hysteresis(rows: DataFrame, **parameters: float) -> DataFrame:
    return rows.sparkSession.sql(hysteresis_sql(**parameters).replace("from frames", "from {frames}"), frames=rows)


def change_points(rows: DataFrame, features: Sequence[str] = ("energy", "prob"), **parameters: float) -> DataFrame:
    return rows.sparkSession.sql(change_sql(features, **parameters).replace("from frames", "from {frames}"), frames=rows)
