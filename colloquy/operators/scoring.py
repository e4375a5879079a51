"""Long tables from scored interviews: rankings, detections, mappings. All are projections; ranks need no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans import lexicon as L
from colloquy.plans.rows import MOTIVES, PROBES, STYLE_ROLES, Rule


def first_of_each(made: Column, code: str = "code") -> Column:
    """The first of the structs with the same code, in order."""
    seen = lambda acc, x: F.exists(acc, lambda a: a[code] == x[code])
    return F.aggregate(
        made, F.filter(made, lambda x: F.lit(False)), lambda acc, x: F.when(seen(acc, x), acc).otherwise(F.concat(acc, F.array(x))),
    )


def rows_where(scored: DataFrame, rules: Sequence[Rule], most: int | None = None) -> DataFrame:
    """(interview_id, ord, code, detail) of the rules that hold, in order; the first of equal codes, and `most` at most."""
    row = lambda i, c, d, w: F.struct(
        F.lit(i).alias("ord"), F.lit(c).alias("code"), F.expr(d).alias("detail"), F.expr(w).alias("on"),
    )
    made = F.filter(F.array(*(row(i, *rule) for i, rule in enumerate(rules))), lambda r: F.coalesce(r["on"], F.lit(False)))
    if len({c for c, *_ in rules}) < len(rules):
        made = first_of_each(made)
    if most is not None:
        made = F.slice(made, 1, most)
    return scored.select("interview_id", F.explode(made).alias("r")).select(
        "interview_id", F.col("r.ord").cast("long").alias("ord"), "r.code", "r.detail",
    )


def codes(rules: Sequence[Rule], most: int) -> Column:
    """The codes of the first rules that hold, each once."""
    return F.slice(F.array_distinct(F.array_compact(F.array(*(F.when(F.expr(w), F.lit(c)) for c, _, w in rules)))), 1, most)


def conflict_union(scored: DataFrame, rules: Sequence[tuple[str, str, str, str]], most: int = 8) -> DataFrame:
    """(interview_id, ord, type, severity, description): conflicts and risks of all models; the first of equal type and first 40 characters."""
    coded = [(f"{kind}:{text[:40]}", severity, condition) for kind, severity, condition, text in rules]
    rows = rows_where(scored, coded, most)
    kinds, texts = (F.array(*map(F.lit, c)) for c in (tuple(r[0] for r in rules), tuple(r[3] for r in rules)))
    at = F.col("ord").cast("int")
    return rows.select(
        "interview_id", "ord", F.get(kinds, at).alias("type"), F.col("detail").alias("severity"), F.get(texts, at).alias("description"),
    )


def score_rows(scored: DataFrame, model: str, dims: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(interview_id, model, dim, dim_ord, score): long scores."""
    made = F.array(
        *(F.struct(
            F.lit(d).alias("dim"), F.lit(i).cast("long").alias("dim_ord"), F.col(c).alias("score"),
        ) for i, (d, c) in enumerate(zip(dims, columns, strict=True))),
    )
    return scored.select("interview_id", F.lit(model).alias("model"), F.explode(made).alias("s")).select("interview_id", "model", "s.*")


def ranked(scored: DataFrame, model: str, dims: Sequence[str], columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """score_rows with their rank: larger scores first, then the declared order. The few scores of a row are sorted in place.

    carry: more columns of scored, as SQL, that each row keeps.
    """
    one = lambda i, d, c: F.struct((-F.col(c)).alias("neg"), F.lit(i).cast("long").alias("dim_ord"), F.lit(d).alias("dim"))
    made = F.array_sort(F.array(*(one(i, d, c) for i, (d, c) in enumerate(zip(dims, columns, strict=True)))))
    out = scored.select("interview_id", F.lit(model).alias("model"), F.posexplode(made).alias("at", "s"), *map(F.expr, carry))
    kept = [c for c in out.columns if c not in ("interview_id", "model", "at", "s")]
    return out.select(
        "interview_id", "model", "s.dim", "s.dim_ord", (-F.col("s.neg")).alias("score"), (F.col("at") + 1).cast("long").alias("rank"),
        *kept,
    )


def band(score: Column) -> Column:
    return F.when(score <= 24, "low").when(score <= 49, "guarded").when(score <= 74, "clear").otherwise("strong")


def probes(scored: DataFrame, questions: Mapping[str, Sequence[str]] = PROBES) -> DataFrame:
    """(interview_id, defect, severity, question, place): the questions of each defect, graver defects first; each question is asked once."""
    order = lambda c: F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)
    one = lambda i, k, j, q: F.struct(
        order(F.col(f"defect_{k}")).alias("grave"), F.lit(i).alias("ord"), F.lit(j).alias("n"), F.lit(k).alias("defect"),
        F.col(f"defect_{k}").alias("severity"), F.lit(q).alias("question"),
    )
    made = F.array_sort(
        F.filter(
            F.array(*(one(i, k, j, q) for i, (k, qs) in enumerate(questions.items()) for j, q in enumerate(qs))),
            lambda r: r["severity"].isNotNull(),
        ),
    )
    placed = F.transform(made, lambda r, i: r.withField("place", (i + 1).cast("long")))
    rows = scored.select("interview_id", placed.alias("all"))
    return rows.select("interview_id", F.explode(first_of_each(F.col("all"), "question")).alias("r")).select(
        "interview_id", "r.defect", "r.severity", "r.question", "r.place",
    )


def mapping_rows(pairs: Sequence[tuple[str, str, float]]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(float(w)).alias("w")) for k, v, w in pairs))


def disc_to_types(scored: DataFrame, mapping: Mapping[str, Sequence[tuple[int | str, float]]] = L.DISC_TO_TYPE) -> DataFrame:
    pairs = [(d, str(t), w) for d, types in mapping.items() for t, w in types]
    return scored.select(
        "interview_id", "disc_top", F.explode(F.filter(mapping_rows(pairs), lambda r: r["k"] == F.col("disc_top"))).alias("r"),
    ).select(
        "interview_id", "disc_top", F.col("r.v").alias("type"), F.col("r.w").alias("weight"),
    )


def dim_adjustments(scored: DataFrame, least: float = 0.3) -> DataFrame:
    pairs = [(d, b, w) for d, dims in L.DISC_TO_BIGFIVE.items() for b, w in dims.items() if abs(w) >= least]
    return scored.select(
        "interview_id", "disc_top", F.explode(F.filter(mapping_rows(pairs), lambda r: r["k"] == F.col("disc_top"))).alias("r"),
    ).select(
        "interview_id", "disc_top", F.col("r.v").alias("dim"), F.col("r.w").alias("adjustment"),
    )


def _bigfive_condition(text: str) -> str:
    return " and ".join(f"big_{c.split()[0].lower()} {c.split(' ', 1)[1]}" for c in text.split(" and "))


BIGFIVE_TYPES: list[Rule] = [(str(t), f"cast({round(w * 100)} as bigint)", _bigfive_condition(c)) for c, t, w in L.BIGFIVE_TO_TYPE]


def bigfive_to_types(scored: DataFrame, most: int = 3) -> DataFrame:
    """(interview_id, type, weight, rank): the conjunctive rules that hold, by weight (in hundredths), then in order."""
    one = lambda i, c, d, w: F.struct(
        (-F.expr(d)).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("type"), F.expr(w).alias("on"),
    )
    made = F.array_sort(
        F.filter(F.array(*(one(i, *rule) for i, rule in enumerate(BIGFIVE_TYPES))), lambda r: F.coalesce(r["on"], F.lit(False))),
    )
    rows = scored.select("interview_id", F.posexplode(F.slice(made, 1, most)).alias("at", "r"))
    return rows.select("interview_id", "r.type", (-F.col("r.neg")).alias("weight"), (F.col("at") + 1).cast("long").alias("rank"))


def type_fusion(scored: DataFrame, most: int = 3) -> DataFrame:
    """(interview_id, type, points, sources, rank): Big Five rules, the DISC map and the direct score, summed in hundredths.

    All nine sums are made in the interview's own row, so nothing is shuffled.
    """
    made = []
    for k in map(str, range(1, 10)):
        rules = [(d, w) for c, d, w in BIGFIVE_TYPES if c == k]
        big = [F.when(F.expr(w), F.expr(d)).otherwise(F.lit(0)) for d, w in rules]
        by_big = reduce(lambda a, b: a | b, (F.coalesce(F.expr(w), F.lit(False)) for _, w in rules), F.lit(False))
        weights = {s: round(w * 100) for s, types in L.DISC_TO_TYPE.items() for t, w in types if str(t) == k}
        disc = reduce(lambda a, s: a.when(F.col("disc_top") == s, F.lit(weights[s])), weights, F.when(F.lit(False), F.lit(0)))
        points = reduce(lambda a, b: a + b, big, F.col(f"type_{k}") + F.coalesce(disc, F.lit(0)))
        sources = F.concat_ws(",", F.when(by_big, "bigfive"), F.lit("direct"), F.when(disc.isNotNull(), "disc"))
        made.append(F.struct((-points).cast("long").alias("neg"), F.lit(k).alias("type"), sources.alias("sources")))
    rows = scored.select("interview_id", F.posexplode(F.slice(F.array_sort(F.array(*made)), 1, most)).alias("at", "r"))
    return rows.select(
        "interview_id", "r.type", (-F.col("r.neg")).alias("points"), "r.sources", (F.col("at") + 1).cast("long").alias("rank"),
    )


def style_roles(scored: DataFrame, most: int = 4) -> DataFrame:
    """(interview_id, roles): roles of the first style, then of the second, each once."""
    table = F.create_map(*(x for k, v in STYLE_ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    both = F.concat(F.element_at(table, F.col("disc_top")), F.element_at(table, F.col("disc_second")))
    return scored.select("interview_id", F.array_join(F.slice(F.array_distinct(both), 1, most), ",").alias("roles"))


def motives(scored: DataFrame) -> DataFrame:
    table = F.create_map(
        *(x for k, v in MOTIVES.items() for x in (
            F.lit(str(k)), F.struct(*(F.lit(t).alias(n) for t, n in zip(v, ("motive", "fear", "desire"), strict=True))),
        )),
    )
    level = F.when(F.col("type_max") >= 70, "marked").when(F.col("type_max") >= 50, "present").otherwise("faint")
    return scored.select("interview_id", "type_top", F.element_at(table, F.col("type_top")).alias("m"), level.alias("level")).select(
        "interview_id", "type_top", "m.*", "level",
    )
