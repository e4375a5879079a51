"""Words, rules, bands, probes and mappings as five dimension tables: written for users to edit, read back, and what they give.

The tables hold the library's own lists; `tables` reads any of them, as edited, into what the operators take.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import division
from colloquy.operators import scoring as S
from colloquy.operators.bands import banded
from colloquy.operators.words import category_hits
from colloquy.plans import detections as D
from colloquy.plans import lexicon as L
from colloquy.plans import rows as R
from colloquy.plans import tables

SCHEMAS = {
    "lexicon": "category string, word string",
    "rules": "scheme string, place int, code string, detail string, rule string",
    "bands": "scheme string, upto double, band string",
    "probes": "defect string, place int, question string",
    "mappings": "source string, target string, weight double",
}
#: (scheme, upper end, band); an end that is null is open. Numbers are fixed values.
BANDS = (
    ("bigfive", 24, "low"), ("bigfive", 49, "guarded"), ("bigfive", 74, "clear"), ("bigfive", None, "strong"),
    ("star", 49, "low"), ("star", 74, "medium"), ("star", None, "high"),
    ("enneagram", 49, "low"), ("enneagram", 64, "medium"), ("enneagram", None, "high"),
    ("motive", 49, "faint"), ("motive", 69, "present"), ("motive", None, "marked"),
)


def own_tables(spark: SparkSession, words=L.WORDS) -> dict[str, DataFrame]:
    """The library's lists as tables."""
    rows = {
        "lexicon": [(k, w) for k, ws in words.items() for w in ws],
        "rules": [(scheme, i, *r) for scheme, rules in D.RULES.items() for i, r in enumerate(rules)],
        "bands": [(s, None if u is None else float(u), b) for s, u, b in BANDS],
        "probes": [(k, i, q) for k, qs in R.PROBES.items() for i, q in enumerate(qs)],
        "mappings": [(d, str(t), w) for d, types in L.DISC_TO_TYPE.items() for t, w in types],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def save(found: dict[str, DataFrame], path: str) -> None:
    for name, df in found.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}


def used(interviews: DataFrame, scored: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(kind, scheme, code, interviews): in how many interviews each row of the tables counts.

    A word list counts by its hits in the transcript; a rule if it is found; a band of a trait's score; a probe that is
    asked; a mapping of the interview's first style.
    """
    words = category_hits(interviews.select("interview_id", "w"), "w", tables.categories_of(found["lexicon"]))
    rules = division.detect(scored, tables.detections_of(found["rules"]), D.CAPS)
    traits = S.score_rows(scored, "bigfive", list("OCEAN"), [f"big_{d}" for d in "ocean"])
    bands = banded(traits.selectExpr("interview_id", "model as scheme", "score"), tables.bands_of(found["bands"]))
    probes = S.probes(scored, tables.probes_of(found["probes"]))
    mappings = S.disc_to_types(scored, tables.mapping_of(found["mappings"]))
    each = (
        words.selectExpr("'lexicon' as kind", "'' as scheme", "category as code", "interview_id"),
        rules.selectExpr("'rules' as kind", "scheme", "code", "interview_id"),
        bands.selectExpr("'bands' as kind", "scheme", "band as code", "interview_id"),
        probes.selectExpr("'probes' as kind", "defect as scheme", "question as code", "interview_id"),
        mappings.selectExpr("'mappings' as kind", "disc_top as scheme", "type as code", "interview_id"),
    )
    # the rows of each table are summed by themselves, so that no one meets all others
    count = lambda df: df.groupBy("kind", "scheme", "code").agg(F.countDistinct("interview_id").alias("interviews"))
    return reduce(DataFrame.unionByName, map(count, each))
