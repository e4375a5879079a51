"""Spelling variants: frequent words that differ by one inserted, deleted or replaced code point, grouped under the more frequent form.

The words are counted once over all texts, so what follows works on distinct words. They are sorted, and the nodes of
the trie of their beginnings are numbered: a word's node at some depth is that of the word before it as far as the two
begin alike, and a new number from there on. Sorted parts are numbered side by side; nodes that a part shares with the
part before it get that part's numbers (a few numbers for each part, from its first and last word). The reversed words
give the numbers of endings in the same way. So a pair of integers (node of the first i letters, node of the rest) says
exactly what stands on both sides of a place, however long the word is, and no string is hashed or compared.

The pair dictionary has for each word the pairs around each of its letters (the letter skipped), and around each place
between letters (where one may be inserted). Two words of the same pair of skipped letters differ in that letter; a
skipped letter and an insertion place of the same pair differ by it. Of equal letters in a row only the last one is
skipped against insertions, so no two words meet twice. A pair is shared by at most one word for each letter of the
alphabet and the word without it, so no group grows with the corpus, and nothing is emitted for pairs of words: each
word of a group gets the number of the others it is near to, and the best of them.

A word's form is its near word with the largest count (ties: the smallest word), if that is at least twice its own.
Counts double along a chain of forms, so chains are short; roots are found by doubling links a few times.

Null texts have no words. Texts of any length are read whole; runs are split from them in one pass. A letter is one of
A-Z, a-z and U+00C0 to U+00FF; only A-Z is lowered. A null doc_id counts as an empty id in `thinned`. Repeated rows count
as often as they stand there. Empty tables, and tables without a frequent word, give no rows. Only doc_id and text are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._shared import bounded_batches, partitions, spill

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Distinct words that a task holds before it hands their counts on.
MOST_WORDS = 200_000
#: Words in a sorted part, and the bits that number nodes and words within a part.
PART_WORDS = 200_000
PART_BITS = 40
#: Bytes of node numbers shared between parts up to which they are broadcast.
SHARED_BYTES = 8 << 20

Edit = Callable[[int | None, str], str]


def thinned(doc_id: int | None, word: str) -> str:
    """The rewriting of the registered query: one code point of every 97th pair of document and word goes."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    at = h % len(word)
    return word if h % 97 else word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least_chars: int = 5, least_count: int = 3, edit: Edit | None = None) -> DataFrame:
    """(word, n): words of all texts, with how often they occur. Each task sums before its counts are shuffled."""
    find = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}").findall  # an edit can only shorten

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in Counter(find((text.as_py() or b"").translate(LOWER).decode())).items():
                    word = edit(doc_id, word) if edit else word
                    if len(word) >= least_chars:
                        seen[word] += n
                if len(seen) > MOST_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    bounded_batches(docs.sparkSession)
    some = docs.where("text is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    return some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def alike(a: str, b: str) -> int:
    """How many code points two words begin with in common."""
    most = min(len(a), len(b))
    return next((i for i in range(most) if a[i] != b[i]), most)


def numbered(words: DataFrame, parts: int, name: str) -> DataFrame:
    """(part, place, key, rest..., nodes): nodes of the trie of all keys, from the first letter on.

    words: key, and columns that are kept. part and place number the keys in order. Written as a table.
    """
    kept = [c for c in words.columns if c != "key"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, path, place, top = "", [], 0, part << PART_BITS
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                same = alike(last, key)
                path = path[:same] + list(range(top + 1, top + 1 + len(key) - same))
                top += len(key) - same
                last = key
                rows.append(path)
            n = len(rows)
            made = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(place, place + n))]
            place += n
            yield pa.RecordBatch.from_arrays([*made, *batch.columns, pa.array(rows, pa.list_(pa.int64()))], names=["part", "place", "key", *kept, "nodes"])

    types = "".join(f", {c} {t}" for c, t in words.select(kept).dtypes)
    in_order = words.select("key", *kept).repartitionByRange(parts, "key").sortWithinPartitions("key")
    made = spill(in_order.mapInArrow(run, f"part long, place long, key string{types}, nodes array<long>"), name)
    edge = lambda f: f(F.struct("place", "key", "nodes"))
    edges = made.groupBy("part").agg(edge(F.min).alias("first"), edge(F.max).alias("last")).orderBy("part").collect()
    shared, before = [], None
    for e in edges:
        head: list[int] = []
        if before is not None:
            head = before[1][: alike(before[0], e["first"]["key"])]
            shared.append((e["part"], e["first"]["nodes"][: len(head)], head))
        own = dict(zip(e["first"]["nodes"], head, strict=False))
        before = e["last"]["key"], [own.get(x, x) for x in e["last"]["nodes"]]
    same = words.sparkSession.createDataFrame(shared, "part long, own array<long>, head array<long>")
    if sum(16 * len(s[1]) + 8 for s in shared) <= SHARED_BYTES:
        same = F.broadcast(same)
    fixed = F.transform("nodes", lambda x, i: F.when((i < F.size("own")) & (F.get("own", i) == x), F.get("head", i)).otherwise(x))
    return made.join(same, "part", "left").withColumn("nodes", F.when(F.col("own").isNull(), F.col("nodes")).otherwise(fixed)).drop("own", "head")


INSERTED, SKIPPED, SKIPPED_LAST = 0, 1, 2


def pair_dictionary(words: DataFrame) -> DataFrame:
    """(before, after, id, n, kind) for each letter and each place of each word (id, key, n, nodes, endings)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(w) for w in batch.column(1).to_pylist()]
            at = 0
            while at < batch.num_rows:  # as many words as make a million pairs, one at least
                to, pairs = at, 0
                while to < batch.num_rows and (to == at or pairs + 2 * sizes[to] < 1 << 20):
                    pairs += 2 * sizes[to] + 1
                    to += 1
                yield pairs_of(batch.slice(at, to - at))
                at = to

    return words.select("id", "key", "n", "nodes", "endings").mapInArrow(run, "before long, after long, id long, n long, kind byte")


def pairs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = "".join(batch.column(1).to_pylist())
    size = np.array([len(w) for w in batch.column(1).to_pylist()])
    begin = np.cumsum(size) - size
    letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    nodes, endings = (batch.column(c).flatten().to_numpy() for c in (3, 4))
    row = np.repeat(np.arange(len(size)), size)
    i = np.arange(len(letters)) - begin[row]
    # what stands before letter i, and from letter i on: the empty beginning and ending have number 0
    before = np.where(i > 0, nodes[np.maximum(np.arange(len(nodes)) - 1, 0)], 0)
    onward = endings[begin[row] + size[row] - 1 - i]
    last = i == size[row] - 1
    after = np.where(last, 0, np.append(onward[1:], 0))
    ends_run = last | (letters != np.append(letters[1:], 0))
    all_of = begin + size - 1
    who = np.concatenate([row, row, np.arange(len(size))])
    kind = np.concatenate([np.where(ends_run, SKIPPED_LAST, SKIPPED), np.full(len(row) + len(size), INSERTED)]).astype(np.int8)
    cols = [np.concatenate([before, before, nodes[all_of]]), np.concatenate([after, onward, np.zeros(len(size), np.int64)])]
    ids, counts = (batch.column(c).to_numpy()[who] for c in (0, 2))
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(ids), pa.array(counts), pa.array(kind)], names=["before", "after", "id", "n", "kind"])


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words each word is near to, and (-n, id) of the first of them by count, then word."""
    group = pairs.groupBy("before", "after").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "id", "kind"))).alias("all"))

    def others(m: Column) -> Column:
        by_place = (F.lit(SKIPPED_LAST), F.lit(INSERTED))
        fits = lambda o: (
            (o["kind"] > INSERTED) & (m["kind"] > INSERTED) & (o["id"] != m["id"])
            | (o["kind"] == by_place[0]) & (m["kind"] == by_place[1])
            | (o["kind"] == by_place[1]) & (m["kind"] == by_place[0])
        )
        return F.filter("all", fits)

    met = group.where(F.size("all") > 1).select(F.explode(F.transform("all", lambda m: F.struct(m["id"].alias("id"), others(m).alias("near")))).alias("m"))
    found = met.where(F.size("m.near") > 0).select("m.id", F.size("m.near").alias("k"), F.get("m.near", F.lit(0)).alias("best"))
    return found.groupBy("id").agg(F.sum("k").alias("n_near"), F.min(F.struct("best.less", "best.id")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root): where the links (id, form) lead to. Each round doubles the length of the known part of a chain."""
    links = spill(links.select("id", F.col("form").alias("root")), "variants-links")
    while True:
        step = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = spill(links.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-links")
        links = longer.select("id", "root")
        if longer.where("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, least_chars: int = 5, least_count: int = 3, edit: Edit | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word with so many code points and occurrences.

    edit: what a word of a document is read as; it must not make words longer.
    """
    counted = spill(word_counts(docs, least_chars, least_count, edit), "variants-words")
    parts = max(partitions(docs.sparkSession), -(-counted.count() // PART_WORDS))
    forward = spill(numbered(counted.select(F.col("word").alias("key"), "n"), parts, "variants-trie").select(F.expr(f"shiftleft(part, {PART_BITS}) + place").alias("id"), "key", "n", "nodes"), "variants-forward")
    backward = numbered(forward.select(F.reverse("key").alias("key"), "id"), parts, "variants-endings").select("id", F.col("nodes").alias("endings"))
    near = spill(near_words(pair_dictionary(forward.join(backward, "id"))), "variants-near")
    words = forward.select("id", F.col("key").alias("word"), "n")
    some = words.join(near, "id").withColumn("is_form", -F.col("best.less") >= 2 * F.col("n"))
    some = some.select("id", "word", "n", "n_near", F.when(F.col("is_form"), F.col("best.id")).alias("form_id"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"))
    some = spill(some, "variants-forms")
    linked = some.where("form_id is not null")
    ends = roots(linked.select("id", F.col("form_id").alias("form")))
    named = lambda id_, word: words.select(F.col("id").alias(id_), F.col("word").alias(word))
    with_form = linked.join(ends.withColumnRenamed("root", "root_id"), "id").join(named("form_id", "form"), "form_id").join(named("root_id", "root"), "root_id")
    alone = words.join(near.select("id", "n_near"), "id", "left").join(linked.select("id"), "id", "left_anti")
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    return with_form.select(*columns).unionByName(
        alone.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.lit(None).cast("long").alias("form_n")),
    )
