"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: leaves of LEAF pre-tokens with where they end in the text, and
sums of their tokens up to the root. An edit re-encodes only the leaves that it touches and those that its context
reaches: splitting starts again at a leaf that ends well before the edit and goes on until a boundary falls on the end
of an old leaf, after which the text is split as before. The new pre-tokens are dealt out to the same leaves, and only
the sums above them change; where an edit brings more than twice what its leaves should hold, they become more leaves,
and the sums are made anew from the leaves. So the work of an update follows the size of its edits, not of the document.

Documents are counted and updated where they are; nothing is shuffled. Null and empty texts have no tokens. A very long
text has a long row of its own. An empty table gives no rows. Ties cannot occur. Edits are
(start, end, text) in code points of the text before them, sorted, not overlapping; null or no edits leave a document
as it is, and of equal starts the given order holds. Repeated rows get equal results. Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import bpe
from colloquy.llm._shared import bounded_batches, release_memory

LEAF = 32
#: No pre-token looks further ahead than this: the longest special token has 13 characters.
CONTEXT = 16
MOST_CACHED = 400_000

EDITS = "array<struct<start: int, end: int, text: string>>"
STATE = f"doc_id long, text string, edits {EDITS}, leaf_ends array<int>, sums array<int>"
UPDATED = "doc_id long, text string, leaf_ends array<int>, sums array<int>, n_before long, n_edits long, n_reencoded long"


class Counter:
    """Tokens of pre-tokens; each is encoded once while the cache holds it."""

    def __init__(self, tokenizer_json: str):
        import regex

        self.tokenizer = bpe._tokenizer(tokenizer_json)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.word = regex.compile(bpe.WORD.removeprefix("(?U)"))
        self.cache: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        if self.special is None:
            return self.word.findall(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.word.findall(part)
        return out

    def counts(self, words: list[str]) -> list[int]:
        new = list(dict.fromkeys(w for w in words if w not in self.cache))
        if new:
            if len(self.cache) + len(new) > MOST_CACHED:
                self.cache.clear()
                new = list(dict.fromkeys(words))
            for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                self.cache[w] = len(e.ids)
        return [self.cache[w] for w in words]


def tree(leaves: np.ndarray) -> np.ndarray:
    """Sums over the leaves: the root at 1, the children of i at 2 i and 2 i + 1, the leaves last; a single 0 without any."""
    if not len(leaves):
        return np.zeros(1, dtype=np.int64)
    width = 1 << (len(leaves) - 1).bit_length()
    out = np.zeros(2 * width, dtype=np.int64)
    out[width : width + len(leaves)] = leaves
    while width > 1:
        out[width // 2 : width] = out[width : 2 * width : 2] + out[width + 1 : 2 * width : 2]
        width //= 2
    return out


def put(sums: list[int], at: int, value: int) -> None:
    """Sets a leaf and updates the sums above it."""
    node = len(sums) // 2 + at
    change = value - sums[node]
    while node and change:
        sums[node] += change
        node //= 2


def build_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text, edits, leaf_ends, sums) for each row of docs (doc_id, text, edits)."""
    tokenizer = bpe.read_tokenizer(tokenizer_path)
    special = tuple(t.content for t in bpe._tokenizer(tokenizer).get_added_tokens_decoder().values())
    bounded_batches(docs.sparkSession)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits"), bpe.words(F.col("text"), special).alias("words"))
    return split.mapInArrow(lambda batches: _built(batches, Counter(tokenizer)), STATE)


def _built(batches: Iterable[pa.RecordBatch], counter: Counter) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, edits, words) to rows of STATE."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            coded = pc.dictionary_encode(part.column(3).flatten())
            codes = coded.indices.to_numpy()
            count = np.array(counter.counts(coded.dictionary.to_pylist()), dtype=np.int64)[codes] if len(codes) else codes
            chars = pc.utf8_length(coded.dictionary).to_numpy()[codes] if len(codes) else codes
            edge = np.append(0, np.cumsum(pc.list_value_length(part.column(3)).to_numpy(zero_copy_only=False)))
            ends, sums = [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                first = np.arange(a, b, LEAF)
                ends.append(np.cumsum(np.add.reduceat(chars[a:b], first - a)) if b > a else np.zeros(0, np.int64))
                sums.append(tree(np.add.reduceat(count[a:b], first - a) if b > a else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ends, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int32()))], names=["doc_id", "text", "edits", "leaf_ends", "sums"])


def update(text: str, ends: list[int], sums: list[int], edits: list[dict], counter: Counter) -> tuple[str, list[int], list[int], int]:
    """The edited text and its tree, and how many pre-tokens were encoded again."""
    if not ends:  # nothing to build on
        new = "".join(e["text"] or "" for e in edits)
        words = counter.split(new)
        parts = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
        return new, np.cumsum([sum(map(len, p)) for p in parts]).tolist(), tree(np.array([sum(counter.counts(p)) for p in parts], dtype=np.int64)).tolist(), len(words)
    old, starts = np.array(ends), np.append(0, ends[:-1])
    new_size, sums, again = (old - starts).tolist(), list(sums), 0
    grown: list[tuple[int, int, list[int], list[int]]] = []
    pieces, done, i = [], 0, 0  # text up to `done` of the old text is in pieces
    while i < len(edits):
        a = min(int(np.searchsorted(old, max(0, edits[i]["start"] - CONTEXT), "left")), len(old) - 1)
        if a and pieces and starts[a] < done:
            a = int(np.searchsorted(starts, done))
        lo, at, region, b = int(starts[a]), int(starts[a]), [], a
        while True:
            b = max(b, min(int(np.searchsorted(old, at, "left")), len(old) - 1))
            while i < len(edits) and edits[i]["start"] <= int(old[b]) + CONTEXT:
                e = edits[i]
                region += [text[at : e["start"]], e["text"] or ""]
                at, i = max(at, e["end"]), i + 1
                b = max(b, min(int(np.searchsorted(old, at, "left")), len(old) - 1))
            hi = int(old[b])
            whole = "".join(region) + text[at : hi + CONTEXT]
            size = len(whole) - (min(len(text), hi + CONTEXT) - hi)
            words = counter.split(whole)
            edge = np.append(0, np.cumsum([len(w) for w in words])) if words else np.zeros(1, dtype=np.int64)
            cut = int(np.searchsorted(edge, size))
            if b == len(old) - 1 or cut < len(edge) and edge[cut] == size and at <= hi:
                words = words[:cut] if b < len(old) - 1 else words
                break
            b += 1
        again += len(words)
        n = b - a + 1
        each = -(-len(words) // n)
        counts = counter.counts(words)
        if each > 2 * LEAF:  # too much for these leaves: they become more
            parts = [slice(k, k + LEAF) for k in range(0, len(words), LEAF)]
            grown.append((a, b, [sum(map(len, words[p])) for p in parts], [sum(counts[p]) for p in parts]))
        else:
            for k in range(n):
                own = slice(k * each, (k + 1) * each)
                new_size[a + k] = sum(map(len, words[own]))
                put(sums, a + k, sum(counts[own]))
        pieces += [text[done:lo], whole[:size] if b < len(old) - 1 else whole]
        done = int(old[b])
    pieces.append(text[done:])
    if grown:
        leaves = sums[len(sums) // 2 :][: len(old)]
        for a, b, sizes, counts in reversed(grown):
            new_size[a : b + 1], leaves[a : b + 1] = sizes, counts
        sums = tree(np.array(leaves, dtype=np.int64)).tolist()
    return "".join(pieces), np.cumsum(new_size).tolist(), sums, again


def _roots(sums: pa.Array) -> pa.Array:
    """The root is at 1 of a tree with leaves; without any there is one 0."""
    return pa.array([s[1] if len(s) > 1 else 0 for s in sums.to_pylist()], pa.int64())


def update_trees(states: DataFrame, tokenizer_path: str) -> DataFrame:
    """Applies the edits of each row of states: (doc_id, text, leaf_ends, sums, n_before, n_edits, n_reencoded)."""
    tokenizer = bpe.read_tokenizer(tokenizer_path)
    rows = states.select("doc_id", "text", "edits", "leaf_ends", "sums")
    return rows.mapInArrow(lambda batches: _updated(batches, Counter(tokenizer)), UPDATED)


def _updated(batches: Iterable[pa.RecordBatch], counter: Counter) -> Iterator[pa.RecordBatch]:
    """Rows of STATE to rows of UPDATED."""
    names = ["doc_id", "text", "leaf_ends", "sums", "n_before", "n_edits", "n_reencoded"]
    for batch in batches:
        n_edits = pc.fill_null(pc.list_value_length(batch.column(2)), 0).cast(pa.int64())
        some = pc.greater(n_edits, 0)
        same = batch.filter(pc.invert(some))
        zero = pa.array(np.zeros(same.num_rows, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([same.column(0), same.column(1), same.column(3), same.column(4), _roots(same.column(4)), zero, zero], names=names)
        edited = batch.filter(some)
        rows = [update(t or "", ends, sums, edits, counter) for t, edits, ends, sums in zip(*(edited.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
        if rows:
            text, ends, sums, again = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([edited.column(0), pa.array(text, pa.string()), pa.array(ends, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int32())), _roots(edited.column(4)), n_edits.filter(some), pa.array(again, pa.int64())], names=names)


def total(sums: str = "sums"):
    """Tokens of a document: the root of its tree."""
    return F.when(F.size(sums) > 1, F.get(sums, F.lit(1))).otherwise(0).cast("long")


def masks() -> Callable[[str], list[dict]]:
    """What gives a text's edits: secrets become [SECRET], runs of three symbols or more go."""
    from colloquy.llm.secrets import BASE

    rules = [(re.compile(r.pattern, r.flags), r.ok, "[SECRET]") for r in BASE] + [(re.compile(r"[#*$%&|<>]{3,}"), lambda m: True, "")]

    def propose(text: str) -> list[dict]:
        spans = sorted((m.start(), m.end(), by) for pattern, ok, by in rules for m in pattern.finditer(text) if ok(m))
        edits, at = [], 0
        for start, end, by in spans:
            if start >= at:
                edits.append({"start": start, "end": end, "text": by})
                at = end
        return edits

    return propose


EDIT_LIST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


def edited_counts(docs: DataFrame, tokenizer_path: str, proposer: Callable[[], Callable[[str], list[dict]]] = masks) -> DataFrame:
    """Trees for each row of docs (doc_id, text), then the edits that the proposer finds in it, in one step: rows as of update_trees."""
    bounded_batches(docs.sparkSession)
    tokenizer = bpe.read_tokenizer(tokenizer_path)
    special = tuple(t.content for t in bpe._tokenizer(tokenizer).get_added_tokens_decoder().values())
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", bpe.words(F.col("text"), special).alias("words"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, propose = Counter(tokenizer), proposer()

        def with_edits() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                release_memory()
                edits = pa.array([propose(t or "") for t in batch.column(1).to_pylist()], EDIT_LIST)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), edits, batch.column(2)], names=["doc_id", "text", "edits", "words"])

        yield from _updated(_built(with_edits(), counter), counter)

    return split.mapInArrow(run, UPDATED)
