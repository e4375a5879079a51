"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

From each line on, the lines that hold the next `noise` words make a shingle, and its hash is the hash of its lines'
hashes. Over all starts within the next `guarantee - noise` words the smallest hash is selected as a fingerprint. So
every run of lines with `guarantee` words or more that stands in two places has a fingerprint in common, and no match
has fewer than `noise` words. Fingerprints of two places or more are extended both ways, line by line, over as many
words as the window can leave uncovered; each extended match has a hash of its own, which is joined with the first
position of that hash in the corpus (by doc_id, then line). What stands there later than there is deleted.

So the lines of every run of `guarantee` words or more that stands anywhere earlier go, wherever that is, and only lines
of runs of `noise` words or more that stand earlier can go; the tests hold this against brute force. Blank lines are
passed over; those inside a deleted run go with it.

What is shuffled is positions, hashes and counts. The number of extended matches follows the number of lines, no pairs of
positions are made, and a hash that is common meets its one first position in a join that Spark can split. A fingerprint
carries the hashes of the lines in its reach, never those of the whole text, so work follows a text's length. Lines are
told apart by 128 bits (MD5) and matches by two hashes of these, of 64 bits each, so a line and another one that share
a 64-bit hash are different lines.

Null texts stay null, empty texts stay empty. A text of which all is repeated becomes empty. Very long texts are split
into lines by Spark. Rows with equal doc_id and text are one document (by a hash of 128 bits) and get the same text. Texts
with equal doc_id are ordered by that hash; a null doc_id comes first. Ties in a window go to the last line. An empty
table stays empty. All columns of docs are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.llm._shared import free_prefix, spill

WORD = r"[^\x20\x09-\x0D]+"


def _key() -> Column:
    """A document: its id and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.col("text").cast("binary"))).cast("binary")))


def line_table(docs: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """(key, doc_id, at, mark, lo, mid, hi, from, near) for each line whose shingle was selected as a fingerprint.

    at counts the lines with a word. mark is the hash of the shingle from this line on, which ends at line mid; from lo
    to hi are the lines that it has to be extended to. near has (pos, h) of the lines from the line numbered `from` to hi:
    their place among all lines, and 128 bits of hash. They lie within some `guarantee` words, so a fingerprint carries
    no more of a long text than of a short one.
    """
    # the key is made below the split, once for a text and not once for each of its lines
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), "text")
    split = keyed.select("doc_id", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = split.select("key", "doc_id", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("h"), F.regexp_count("line", F.lit(WORD)).alias("n")).where("n > 0")
    lines = lines.repartition("key").groupBy("key", "pos").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("n").alias("n"))
    order = Window.partitionBy("key").orderBy("pos")
    lines = lines.withColumn("at", F.row_number().over(order)).withColumn("c", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ahead = Window.partitionBy("key").orderBy("c")
    shingle = ahead.rangeBetween(0, noise - 1)
    reach = guarantee - noise - 1
    lines = lines.withColumns({
        "s": F.when(F.sum("n").over(shingle) >= noise, F.xxhash64(F.collect_list("h").over(shingle))),
        "mid": F.col("at") + F.count("*").over(shingle) - 1,
        "lo": F.col("at") - F.count("*").over(ahead.rangeBetween(-reach, 0)) + 1,
        "end": F.col("at") + F.count("*").over(ahead.rangeBetween(0, guarantee - 1)) - 1,
    })
    # lines that begin within `guarantee` words after this one
    lines = lines.withColumn("hi", F.greatest("mid", F.coalesce(F.lead("end").over(ahead), F.col("at"))))
    best = F.min(F.when(F.col("s").isNotNull(), F.struct("s", (-F.col("at")).alias("at")))).over(ahead.rangeBetween(0, reach))
    lines = lines.withColumn("best", best)
    # a line is selected if a window that begins at or before it selects it
    chosen = F.collect_set(-F.col("best.at")).over(ahead.rangeBetween(-reach, 0))
    one = F.struct(F.col("pos").cast("int").alias("pos"), "h")
    before = F.collect_list(one).over(ahead.rangeBetween(-reach, -1))
    onward = F.collect_list(one).over(ahead.rangeBetween(0, guarantee - 1))
    lines = lines.withColumns({"before": before, "next": F.lead(onward).over(ahead), "chosen": F.array_contains(chosen, F.col("at"))})
    numbers = [F.col(c).cast("int").alias(c) for c in ("at", "lo", "mid", "hi")]
    near = F.concat("before", F.array(one), F.coalesce("next", F.array().cast("array<struct<pos:int,h:binary>>")))
    return lines.where("chosen and s is not null").select("key", "doc_id", F.col("s").alias("mark"), *numbers, (F.col("at") - F.size("before")).cast("int").alias("from"), near.alias("near"))


def repeated_runs(docs: DataFrame, noise: int = 25, guarantee: int = 50) -> DataFrame:
    """(key, runs): for each document with repeated runs, the line numbers (first, last) of the later ones, apart from each other and in order."""
    marks = spill(line_table(docs, noise, guarantee), "line-marks")
    shared = marks.groupBy("mark").count().where("count > 1").select("mark")
    found = marks.join(shared, "mark", "left_semi")
    # the shingle, and what it becomes when lines before or after it join
    after = F.transform(F.sequence("mid", "hi"), lambda e: F.struct(F.col("at").alias("a"), e.alias("b")))
    before = F.when(F.col("lo") < F.col("at"), F.transform(F.sequence(F.col("lo"), F.col("at") - 1), lambda a: F.struct(a.alias("a"), F.col("mid").alias("b"))))
    spans = F.concat(after, F.coalesce(before, F.array().cast("array<struct<a:int,b:int>>")))

    def match(x: Column) -> Column:
        lines = F.slice("near", x["a"] - F.col("from") + 1, x["b"] - x["a"] + 1)
        hashes = lines["h"]
        pos = lambda i: F.get("near", i - F.col("from"))["pos"]
        # two hashes with different seeds of the lines' own 128 bits
        return F.struct(F.xxhash64(hashes).alias("m1"), F.xxhash64(F.lit(1), hashes).alias("m2"), x["a"].alias("a"), pos(x["a"]).alias("first"), pos(x["b"]).alias("last"))

    met = found.select("key", "doc_id", F.explode(F.transform(spans, match)).alias("x"))
    place = F.struct("doc_id", "key", "x.a").alias("place")
    matches = spill(met.select("x.m1", "x.m2", place, "x.first", "x.last"), "line-matches")
    first = matches.groupBy("m1", "m2").agg(F.min("place").alias("earliest"), F.count("*").alias("k")).where("k > 1").select("m1", "m2", "earliest")
    later = matches.join(first, ["m1", "m2"]).where("place > earliest").select("place.key", "first", "last").distinct()
    # runs that touch or overlap become one
    order = Window.partitionBy("key").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = later.withColumn("new", F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int"))
    runs = parted.withColumn("run", F.sum("new").over(order)).groupBy("key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The parts of the lines between the runs, which are apart and in order."""
    n = F.size(runs)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["last"] + 1)
    end = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(runs, i)["first"])
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))


def dedup_lines(docs: DataFrame, noise: int = 25, guarantee: int = 50) -> DataFrame:
    """docs with later repeated runs deleted from text; two columns follow: all lines of a text, and the removed ones.

    They are named __line_total and __line_removed, with more underscores before them if docs has such names.
    """
    own = free_prefix(docs, "__line_")
    key, found, kept, total, removed = (own + x for x in ("key", "runs", "kept", "total", "removed"))
    runs = repeated_runs(docs.select("doc_id", "text"), noise, guarantee).select(F.col("key").alias(key), F.col("runs").alias(found))
    lines = F.split("text", "\n", -1)
    out = docs.withColumn(key, _key()).join(runs, key, "left").withColumn(kept, F.when(F.col(found).isNotNull(), _kept(lines, F.col(found))))
    count = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out = out.withColumn(total, count).withColumn(removed, F.when(F.col(kept).isNotNull(), F.col(total) - F.size(kept)).otherwise(0))
    new = F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    return out.withColumn("text", new).select(*(F.col(f"`{c}`") for c in docs.columns), total, removed)
