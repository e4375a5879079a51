"""Reports, model requests and what comes back: nested rows built from flat ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.rows import FINDINGS, GAPS, PROBES, STAR_DEFECTS, Rule


def rule_list(rules: Sequence[Rule], most: int) -> Column:
    """The codes of the rules that hold, in order, `most` at most."""
    held = F.array_compact(F.array(*(F.when(F.expr(w), F.lit(c)) for c, _, w in rules)))
    return F.slice(F.array_distinct(held), 1, most)


#: Stages of an analysis in order, and what each counts.
STAGES = {"parse": "n_turns", "features": "text_length", "star": "n_high", "disc": "contradictions", "mbti": "n_open", "masking": "size(findings)", "decision": "size(gaps)"}


def report(scored: DataFrame, turns: DataFrame) -> DataFrame:
    """(interview_id, report): one nested row for each interview. turns: rows of qa_pairs; the join is on the key that both are grouped by."""
    part = lambda **c: F.struct(*(F.expr(e).alias(n) for n, e in c.items()))
    turn = F.struct("turn_id", "question", "question_type", "answer_summary", "answer_length")
    told = turns.groupBy("interview_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = scored.withColumns({"findings": rule_list(FINDINGS, 4), "gaps": rule_list(GAPS, 5)}).join(told, "interview_id", "left")
    trace = F.array(
        *(F.struct(
            F.lit(name).alias("stage"), F.lit("completed").alias("status"), F.expr(f"cast({e} as bigint)").alias("n"),
        ) for name, e in STAGES.items()),
    )
    return rows.select(
        "interview_id",
        F.struct(
            part(segments="n_segments", turns="n_turns", candidate_chars="cand_chars", sample_quality="sample_quality").alias("overview"),
            F.struct(
                F.coalesce(
                    "turns",
                    F.array().cast(
                        "array<struct<turn_id:bigint,question:string,question_type:string,answer_summary:string,answer_length:bigint>>",
                    ),
                ).alias(
                    "turns",
                ),
            ).alias(
                "interview_map",
            ),
            part(action="action_ratio", hedge="hedge_ratio", structure="structure", richness="richness", stability="stability").alias(
                "features",
            ),
            part(D="disc_d", I="disc_i", S="disc_s", C="disc_c", top="disc_top", confidence="disc_confidence").alias("disc"),
            part(O="big_o", C="big_c", E="big_e", A="big_a", N="big_n", confidence="big_confidence").alias("bigfive"),
            part(type="mbti_type", confidence="mbti_confidence").alias("mbti"),
            part(top="type_top", wing="wing", confidence="type_confidence").alias("enneagram"),
            part(S="dim_s", T="dim_t", A="dim_a", R="dim_r", overall="star_overall", confidence="star_confidence").alias("star"),
            part(style="style_label").alias("mapping"),
            "findings",
            "gaps",
            rule_list(STAR_DEFECTS, 6).alias("defects"),
            trace.alias("stages"),
        ).alias("report"),
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """The reports as Parquet, an interview in each row."""
    reports.write.parquet(path)


def score_update(live: DataFrame) -> DataFrame:
    """(interview_id, seg_id, event): the compact JSON event of a score change, from rows of live_disc and `partial`."""
    four = lambda prefix: F.struct(*(F.col(f"{prefix}_{d}").alias(d.upper()) for d in "disc"))
    event = F.struct(
        F.lit("disc.update").alias("type"), "dominant", "secondary", four("live").alias("scores"), four("delta").alias("deltas"),
        F.col("disc_confidence").alias("confidence"), F.col("partial").alias("is_partial"),
    )
    return live.select("interview_id", "seg_id", F.to_json(event).alias("event"))


def snapshots(interviews: DataFrame, live: DataFrame, rolled: DataFrame, segments: DataFrame) -> DataFrame:
    """A session's view: its segments and transcript, the last live scores with deltas and roles, the last rolling analysis.

    live and rolled: rows of operators.rolling.live_disc and refreshed; segments: (interview_id, segments).
    """
    scores = [f"{p}_{d}" for d in "cdis" for p in ("live", "delta")]
    analysed = ("mbti_type", "big_top", "star_overall", "sample_quality")
    last = live.groupBy("interview_id").agg(F.max(F.struct("seg_id", "status", "dominant", "secondary", "roles", *scores)).alias("x"))
    result = rolled.groupBy("interview_id").agg(F.max(F.struct("seg_id", *analysed)).alias("r"))
    rows = interviews.select("interview_id", "n_segments", F.col("w").alias("transcript")).join(segments, "interview_id")
    rows = rows.join(last, "interview_id", "left").join(result, "interview_id", "left")
    return rows.select(
        "interview_id", "n_segments", "segments", "transcript", F.col("x.seg_id").alias("analysed_to"),
        F.coalesce("x.status", F.lit("waiting")).alias("status"), "x.dominant", "x.secondary", "x.roles", *(f"x.{c}" for c in scores),
        F.col("r.seg_id").alias("rolled_to"), *(f"r.{c}" for c in analysed),
    )


SYSTEM = "Read the transcript and the local results; ask what the evidence leaves open. Answer in JSON."


def inference_requests(scored: DataFrame, tail: int = 4000, most: int = 4) -> DataFrame:
    """(interview_id, request): JSON of a model request: a system message, and a user message with what the local rules found.

    The transcript's end, the ranking, the first gaps and questions, open axes, and the defects of high severity.
    """
    dims = F.array(
        *(F.struct((-F.col(f"disc_{d}")).alias("neg"), F.lit(i).alias("ord"), F.lit(d.upper()).alias("dim")) for i, d in enumerate("disc")),
    )
    ranking = F.array_join(F.transform(F.array_sort(dims), lambda x: x["dim"]), " / ")
    axes = F.array_compact(
        F.array(*(F.when(F.col(f"pref_{a}").isin("neutral", "unclear"), F.lit(a.upper())) for a in ("ei", "ns", "tf", "jp"))),
    )
    grave = F.array_compact(F.array(*(F.when(F.expr(d) == "high", F.lit(c)) for c, d, _ in STAR_DEFECTS)))
    asked = F.slice(
        F.array_distinct(
            F.flatten(
                F.array(
                    *(F.when(F.expr(w), F.array(*map(F.lit, PROBES[c]))).otherwise(
                        F.array().cast("array<string>"),
                    ) for c, _, w in STAR_DEFECTS),
                ),
            ),
        ),
        1, most,
    )
    user = F.struct(
        F.right("w", F.lit(tail)).alias("transcript"), ranking.alias("ranking"), F.struct(
            *(F.col(f"disc_{d}").alias(d.upper()) for d in "disc"),
        ).alias(
            "scores",
        ),
        rule_list(GAPS, most).alias("gaps"), F.col("impression_risk").alias("risk"), F.col("mbti_type").alias("mbti"), axes.alias("open_axes"), grave.alias("defects"), asked.alias("questions"),
    )
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return scored.select(
        "interview_id",
        F.to_json(F.struct(F.array(message("system", F.lit(SYSTEM)), message("user", F.to_json(user))).alias("messages"))).alias("request"),
    )


def merge_results(local: DataFrame, remote: DataFrame, key: str, columns: Sequence[str], lists: Mapping[str, int] | None = None) -> DataFrame:
    """local with each of the columns taken from remote where it has a value that is not blank.

    lists: columns that are arrays, taken from remote where they are not empty, and the most elements that each keeps.
    """
    lists = dict(lists or {})
    far = remote.select(key, *(F.col(c).alias(f"__remote_{c}") for c in [*columns, *lists]))
    merged = {c: F.coalesce(F.when(F.trim(F.col(f"__remote_{c}").cast("string")) != "", F.col(f"__remote_{c}")), F.col(c)) for c in columns}
    merged |= {c: F.slice(
        F.when(F.size(f"__remote_{c}") > 0, F.col(f"__remote_{c}")).otherwise(F.col(c)), 1, most,
    ) for c, most in lists.items()}
    return local.join(far, key, "left").withColumns(merged).select(local.columns)


def rule_hit_rates(scored: DataFrame, families: dict[str, Sequence[Rule]]) -> DataFrame:
    """(family, checks, hits): how many rules of each family were tried and held, over all interviews."""
    sums = [(
        f, len(rules), F.sum(sum((F.when(F.expr(w), 1).otherwise(0) for _, _, w in rules), F.lit(0))),
    ) for f, rules in families.items()]
    row = scored.agg(F.count("*").alias("n"), *(s.alias(f) for f, _, s in sums))
    made = F.array(
        *(F.struct(
            F.lit(f).alias("family"), (F.col("n") * k).alias("checks"), F.coalesce(F.col(f), F.lit(0)).cast("long").alias("hits"),
        ) for f, k, _ in sums),
    )
    return row.select(F.explode(made).alias("r")).select("r.*")
