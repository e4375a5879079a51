"""From texts to segments, turns and interviews. The key of all of it is interview_id, and one shuffle on it serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans import lexicon as L

#: Labels of the two speakers (fixed values); the interviewer's are tried first, each as a part of the label.
INTERVIEWER = ("面试官", "interviewer", "面试老师", "hr", "hrbp")
CANDIDATE = ("候选人", "应聘者", "求职者", "面试者", "candidate")
ROLE_LABEL = {"interviewer": "面试官", "candidate": "候选人"}
OTHER_LABEL = "发言人"
SENTENCE_END = "。！？!?；;\n"


def utrim(text: Column) -> Column:
    """Without white space of any alphabet at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Line ends become newlines; the ends are trimmed. Null stays null."""
    return utrim(F.regexp_replace(F.regexp_replace(text, "﻿", ""), "\r\n?", "\n"))


def turn_breaks(text: Column) -> Column:
    """A newline before each speaker label that follows the end of a sentence in the same line; full-width colons after labels."""
    labels = "|".join(sorted((*INTERVIEWER, *CANDIDATE), key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iU)(?<!^)([。！？!?；;])\s*({labels})\s*[:：]", "$1\n$2：")


def role_of_label(label: Column) -> Column:
    low = F.lower(label)
    said = lambda names: F.greatest(*(F.contains(low, F.lit(n)) for n in names))
    return F.when(said(INTERVIEWER), "interviewer").when(said(CANDIDATE), "candidate")


def speaker_lines(transcripts: DataFrame) -> DataFrame:
    """(interview_id, line, role, text): lines with their label's role, null without a label; blank lines are left out."""
    lines = transcripts.select(
        "interview_id", F.posexplode(F.split(turn_breaks(normalize_text(F.col("text"))), "\n")).alias("line", "raw"),
    ).withColumn(
        "raw", utrim(F.col("raw")),
    ).where(
        "raw <> ''",
    )
    pattern = r"(?Us)^([^:：]{1,20})[:：]\s*(.+)$"
    role = role_of_label(F.regexp_extract("raw", pattern, 1))
    return lines.select(
        "interview_id", "line", role.alias("role"),
        F.when(role.isNotNull(), F.regexp_extract("raw", pattern, 2)).otherwise(F.col("raw")).alias("text"),
    )


def merge_segments(lines: DataFrame) -> DataFrame:
    """(interview_id, seg_id, speaker, text): consecutive lines of one speaker are one segment; unlabelled lines follow the last label.

    lines: (interview_id, line, role, text). Lines before any label are of an unknown speaker.
    """
    order = Window.partitionBy("interview_id").orderBy("line")
    who = F.coalesce(F.last("role", ignorenulls=True).over(order), F.lit("unknown"))
    marked = lines.withColumn("speaker", who).withColumn("new", (~F.lag("speaker").over(order).eqNullSafe(F.col("speaker"))).cast("int"))
    grouped = marked.withColumn("seg_id", F.sum("new").over(order))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return grouped.groupBy("interview_id", "seg_id", "speaker").agg(texts.alias("text")).select(
        "interview_id", F.col("seg_id").cast("long").alias("seg_id"), "speaker", "text",
    )


#: Cues of a question and of an answer in a single line (own lists).
QUESTION_CUES = ("请问", "能不能", "能否", "可不可以", "怎么", "如何", "为什么", "什么", "有没有", "是否", "哪个", "哪些", "多少", "介绍一下", "说说")
ANSWER_CUES = ("我", "当时", "因为", "所以", "最后", "负责", "完成", "项目", "结果")


def looks_like_question(text: Column) -> Column:
    """Ends with a question mark or holds a cue; blank text does not."""
    return (text != "") & (text.rlike("[？?]$") | text.rlike("|".join(QUESTION_CUES)))


def looks_like_answer(text: Column, least: int = 18) -> Column:
    """Long enough, or holds a cue; blank text does not."""
    return (text != "") & ((F.length(text) >= least) | text.rlike("|".join(ANSWER_CUES)))


def question_type(text: Column) -> Column:
    out = F.when(F.coalesce(text, F.lit("")) == "", "unlabelled")
    for kind, words in L.QUESTIONS:
        out = out.when(
            F.greatest(*(F.contains(text, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(text, F.lit(words[0])), kind,
        )
    return out.otherwise("general")


def answer_summary(text: Column, size: int = 80) -> Column:
    flat = F.regexp_replace(text, r"(?U)\s+", "")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def asked() -> Column:
    """The latest interviewer segment's text that no candidate segment has answered yet; null if there is none."""
    past = Window.partitionBy("interview_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1)
    question = F.last(F.when(F.col("speaker") == "interviewer", F.struct("seg_id", "text")), ignorenulls=True).over(past)
    answered = F.last(F.when(F.col("speaker") == "candidate", F.col("seg_id")), ignorenulls=True).over(past)
    return F.when(answered.isNull() | (question["seg_id"] > answered), question["text"])


def qa_pairs(segments: DataFrame) -> DataFrame:
    """(interview_id, turn_id, question, question_type, answer, answer_summary, answer_length): each candidate segment with its question.

    A question is used once. Ids are given before blank answers are dropped, so there can be gaps.
    """
    order = Window.partitionBy("interview_id").orderBy("seg_id")
    told = segments.withColumn("question", utrim(F.coalesce(asked(), F.lit("")))).where("speaker = 'candidate'").withColumn(
        "turn_id", F.row_number().over(order).cast("long"),
    )
    told = told.withColumn("answer", utrim(F.coalesce("text", F.lit("")))).where("answer <> ''")
    return told.select(
        "interview_id", "turn_id", "question", question_type(F.col("question")).alias("question_type"),
        "answer", answer_summary(F.col("answer")).alias("answer_summary"), F.length("answer").cast("long").alias("answer_length"),
    )


def display_line(speaker: Column, text: Column) -> Column:
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLE_LABEL.items() for x in kv)), speaker), F.lit(OTHER_LABEL))
    return F.concat(label, F.lit("："), text)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, f"[{SENTENCE_END}]+"), utrim), lambda s: s != "")


def interviews(segments: DataFrame) -> DataFrame:
    """One row for each interview: t, w, sent, sent_chars, n_segments, n_turns, n_types, cand_chars. Interviews without an answer stay."""
    said = utrim(F.coalesce("text", F.lit("")))
    rows = segments.withColumns(
        {"kind": question_type(F.coalesce(asked(), F.lit(""))), "is_turn": (F.col("speaker") == "candidate") & (said != ""), "said": said},
    )
    # the segments of an interview are gathered once and put in order; both texts are read from them
    part = F.struct("seg_id", "is_turn", "said", display_line(F.col("speaker"), F.coalesce("text", F.lit(""))).alias("line"))
    out = rows.groupBy("interview_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.count("*").alias("n_segments"),
        F.count(F.when(F.col("is_turn"), 1)).alias("n_turns"),
        F.size(F.collect_set(F.when(F.col("is_turn"), F.col("kind")))).cast("long").alias("n_types"),
        F.sum(F.when(F.col("is_turn"), F.length("said")).otherwise(0)).alias("cand_chars"),
    )
    answers = F.transform(F.filter("parts", lambda p: p["is_turn"]), lambda p: p["said"])
    whole = F.transform("parts", lambda p: p["line"])
    out = out.withColumns({"t": F.array_join(answers, "\n"), "w": F.array_join(whole, "\n")}).drop("parts")
    pieces = sentences(F.col("t"))
    return out.withColumn("sent", F.size(pieces).cast("long")).withColumn(
        "sent_chars", F.aggregate(pieces, F.lit(0), lambda a, s: a + F.length(s)).cast("long"),
    )


def speakers_of(segments: DataFrame) -> DataFrame:
    """(interview_id, segments): each segment's number, speaker and characters, in order."""
    one = F.concat_ws(":", F.col("seg_id").cast("string"), "speaker", F.length(F.coalesce("text", F.lit(""))).cast("string"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seg_id", one.alias("one")))), lambda x: x["one"])
    return segments.groupBy("interview_id").agg(F.array_join(listed, ",").alias("segments"))
