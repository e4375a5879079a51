"""Views of the test tables in the shapes that interviews have; the library's readers do not use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.tables import conversation_segments

#: Sentences of a synthetic interview in Chinese, put before each turn's own text so that rules for Chinese have something to find.
SAMPLE_SENTENCES = (
    "当时项目背景很复杂，时间紧。", "我的任务是负责订单目标。", "我先分析数据，然后推进方案落地。", "最后结果提升了30%，成本降低了5万元。",
    "我们团队一起沟通，大家配合。", "如果有风险，我可能会先验证边界。", "我直接拍板，必须马上完成。", "因为流程不清，所以我复盘并总结。",
    "效果不错，大家很满意。", "我们要体系化，打通全链路闭环。", "首先我写了文档，其次改了接口。", "有点担心压力，但是也很兴奋。",
)


def zh_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the conversation table, each with two sample sentences before its own text."""
    rows = conversation_segments(spark, sf_dir)
    picks = F.array(*map(F.lit, SAMPLE_SENTENCES))
    first = F.get(picks, F.pmod(F.col("interview_id") * 7 + F.col("seg_id") * 5, F.lit(12)).cast("int"))
    second = F.get(picks, F.pmod(F.col("interview_id") * 3 + F.col("seg_id") * 11 + 4, F.lit(12)).cast("int"))
    return rows.withColumn("text", F.concat(first, second, F.coalesce("text", F.lit(""))))


#: Labels that the lines of a transcript carry in turn, by what is left of the line's number.
LABELS = {"interviewer": ("面试官", "Interviewer", "HRBP", "面试老师"), "candidate": ("候选人", "求职者", "面试者", "应聘者", "Candidate")}


def flat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(interview_id, text): transcripts as one text each, a line for each segment, or all in one line for odd ids."""
    rows = zh_turns(spark, sf_dir).where("speaker <> 'unknown'")
    label = lambda who: F.get(F.array(*map(F.lit, LABELS[who])), F.pmod("seg_id", F.lit(len(LABELS[who]))).cast("int"))
    named = F.when(F.col("speaker") == "interviewer", label("interviewer")).otherwise(label("candidate"))
    spoken = F.concat(named, F.lit("："), F.regexp_replace("text", r"\s+", " "), F.lit("。"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seg_id", spoken.alias("line")))), lambda x: x["line"])
    one = F.when(F.col("interview_id") % 2 == 0, F.array_join(lines, "\n")).otherwise(F.array_join(lines, ""))
    return rows.groupBy("interview_id").agg(one.alias("text"))
