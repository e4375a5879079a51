"""Detections by relational division: interviews divided by rules whose conditions are rows.

An interview's features become rows (feature, number or label); each condition of a rule meets the feature that it names.
A rule holds for an interview if as many of its conditions hold as it has. So any number of rules is one join with a
bounded table and one count, and the plan does not grow with the rules; the compiled form (`tables.compiled`) is a CASE
for each. The features of an interview are made from its own row, so the count follows the rows' own partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from colloquy.plans.tables import ALWAYS, Detection

#: Features that follow from others, as SQL.
DERIVED = {"dim_sum": "dim_s + dim_t + dim_a + dim_r", "disc_pair": "concat(disc_top, disc_second)"}
#: Schemes whose results are features of other schemes: defect_x is the detail of code x.
FEEDS = ("defect",)
ROW = "interview_id, feature, number, label"


def feature_rows(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """(interview_id, feature, number, label) of the named features that the row has; numbers as doubles, null ones left out."""
    columns = scored.withColumns({n: F.expr(DERIVED[n]) for n in names if n in DERIVED and n not in scored.columns})
    kinds = {f.name: f.dataType for f in columns.schema.fields}

    def row(n: str):
        number = isinstance(kinds[n], (NumericType, BooleanType))
        value = F.col(n).cast("double") if number else F.lit(None).cast("double")
        label = F.lit(None).cast("string") if number else F.col(n).cast("string")
        return F.struct(F.lit(n).alias("feature"), value.alias("number"), label.alias("label"))

    unknown = [n for n in names if n not in kinds]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    rows = F.filter(F.array(*(row(n) for n in names)), lambda r: r["number"].isNotNull() | r["label"].isNotNull())
    return columns.select("interview_id", F.explode(rows).alias("r")).select("interview_id", "r.feature", "r.number", "r.label")


def _holding(features: DataFrame, rules: Sequence[Detection]) -> DataFrame:
    """(interview_id, scheme, place, code, detail) of the rules of which all conditions hold."""
    made = [
        (r.scheme, r.place, r.code, r.detail, len(r.conditions), c.feature, c.op, c.number, c.label)
        for r in rules for c in r.conditions
    ]
    conditions = features.sparkSession.createDataFrame(
        made, "scheme string, place int, code string, detail string, need int, feature string, op string, least double, wanted string",
    )
    number, label = F.col("number"), F.col("label")
    holds = (
        F.when(F.col("op") == ">=", number >= F.col("least")).when(F.col("op") == "<=", number <= F.col("least"))
        .when(F.col("op") == ">", number > F.col("least")).when(F.col("op") == "<", number < F.col("least"))
        .when((F.col("op") == "=") & F.col("least").isNotNull(), number == F.col("least"))
        .when(F.col("op") == "=", label == F.col("wanted")).when(F.col("op") == "has", F.contains(label, F.col("wanted")))
        .otherwise(True)  # is present
    )
    # tables.detections_of has refused more rules than its bound
    met = features.join(F.broadcast(conditions), "feature").where(holds)
    return met.groupBy("interview_id", "scheme", "place", "code", "detail", "need").count().where("count = need").drop("count", "need")


def detect(scored: DataFrame, detections: Mapping[str, Sequence[Detection]], caps: Mapping[str, int] | None = None) -> DataFrame:
    """(interview_id, scheme, place, code, detail): what the rules of each scheme find, in order; the first rule of a code gives its detail.

    caps: how many codes of a scheme are kept. Rules of other schemes may ask for the results of `FEEDS`.
    """
    fed = {f"{s}_{r.code}" for s in FEEDS for r in detections.get(s, ())}
    rules = [r for rs in detections.values() for r in rs]
    later = [r for r in rules if any(c.feature in fed for c in r.conditions)]
    at_once = [r for r in rules if r not in later]
    names = lambda rs: sorted({c.feature for r in rs for c in r.conditions} - fed)
    always = lambda rs: scored.select("interview_id", F.lit(ALWAYS).alias("feature"), F.lit(1.0).alias("number"), F.lit(None).cast("string").alias("label"))

    def given(rs: Sequence[Detection]) -> DataFrame:
        own = names(rs)
        rows = feature_rows(scored, [n for n in own if n != ALWAYS])
        return rows.unionByName(always(rs)) if ALWAYS in own else rows

    found = _first(_holding(given(at_once), at_once))
    if later:
        results = found.where(F.col("scheme").isin(*FEEDS)).select("interview_id", F.concat_ws("_", "scheme", "code").alias("feature"), F.lit(None).cast("double").alias("number"), F.col("detail").alias("label"))
        more = given(later).unionByName(results) if names(later) else results
        found = found.unionByName(_first(_holding(more, later)))
    place = F.row_number().over(Window.partitionBy("interview_id", "scheme").orderBy("place"))
    found = found.withColumn("place", place.cast("long"))
    for scheme, most in (caps or {}).items():
        found = found.where((F.col("scheme") != scheme) | (F.col("place") <= most))
    return found.select("interview_id", "scheme", "place", "code", "detail")


def _first(found: DataFrame) -> DataFrame:
    """The first rule of each code."""
    best = found.groupBy("interview_id", "scheme", "code").agg(F.min(F.struct("place", "detail")).alias("best"))
    return best.select("interview_id", "scheme", "code", "best.place", "best.detail")
