"""Secret scans through a trigram inverted index.

Each rule is a regular expression. A Boolean trigram query is derived from it: texts that match hold these trigrams.
The documents are indexed in segments (an Arrow batch each): the trigrams that any rule asks for point to the texts of
the segment that hold them, A to Z folded. A rule's query intersects and unites these postings, and the rule then runs
over the whole text of what is left. A rule without mandatory trigrams (long hexadecimal strings) runs over every text.
Segments are where their documents are, so nothing is shuffled.

Null and empty texts have no spans. Very long texts are indexed and searched whole. An empty table gives no rows.
Repeated rows get equal results. Matches of one rule do not overlap (leftmost
first); matches of different rules may, and equal starts are ordered as the rules are listed. Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _words as W
from colloquy.llm._shared import bounded_batches


@dataclass(frozen=True)
class Rule:
    """ok: which matches stay; the others are dropped, what they cover stays covered."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    ok: Callable[[re.Match], bool] = lambda m: True


#: The three kinds that the counts are for, in order. A run that is too short holds no match that is long enough.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE, lambda m: m.end(2) - m.start(2) >= 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Publicly documented shapes of credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\s:@/]{3,}@"),
)

#: Bytes with A to Z folded.
FOLD = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: A query: a trigram, ("and", parts) or ("or", parts); ("and", ()) holds for every text.
ANY = ("and", ())


def _every(parts: Iterable) -> tuple:
    flat = list(dict.fromkeys(p for p in parts if p != ANY))
    return flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _some(parts: Iterable) -> tuple:
    parts = list(dict.fromkeys(parts))
    held = {p: {p} if isinstance(p, bytes) else set(p[1]) for p in parts if isinstance(p, bytes) or p[0] == "and"}
    flat = [p for p in parts if p not in held or not any(held[q] < held[p] for q in held)]
    return ANY if ANY in flat or not flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of(text: bytes) -> tuple:
    return _every(text[i : i + 3] for i in range(len(text) - 2))


def _fold(code: int) -> bytes:
    return chr(code).encode().lower()


def trigram_query(pattern: str) -> tuple:
    """What trigrams (A to Z folded) a text that matches the pattern must hold."""

    def walk(nodes) -> tuple[list[bytes] | None, tuple]:
        """(all strings the nodes can match, if they are few; the query of the nodes)."""
        run: list[bytes] = [b""]
        complete, must = True, []
        for op, arg in nodes:
            exact: list[bytes] | None = None
            need = ANY
            if op is K.LITERAL:
                exact = [_fold(arg)]
            elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
                exact = list(dict.fromkeys(_fold(a) for _, a in arg))
            elif op is K.AT:
                exact = [b""]
            elif op is K.SUBPATTERN:
                exact, need = walk(arg[3])
            elif op is K.BRANCH:
                ways = [walk(way) for way in arg[1]]
                need = _some(n for _, n in ways)
                exact = [s for strings, _ in ways for s in strings] if all(s is not None for s, _ in ways) else None
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                low, high, body = arg
                strings, inner = walk(body)
                need = inner if low else ANY
                if strings is not None and (low, high) == (0, 1):
                    exact = [b"", *strings]
            if exact is not None and len(run) * len(exact) <= 64:
                run = [a + b for a in run for b in exact]
                continue
            must += [_some(map(_of, run)), need]
            run, complete = [b""], False
        must.append(_some(map(_of, run)))
        return (run if complete else None), _every(must)

    return walk(_parser.parse(pattern))[1]


def trigrams(query: tuple | bytes) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Segment:
    """The inverted index of some texts: trigram to the ascending numbers of the texts that hold it.

    It is built in one pass over the bytes of all texts, from the trigrams that stand there; those that no rule asks for
    get no list.
    """

    def __init__(self, texts: pa.Array, wanted: set[bytes]):
        self.all = np.arange(len(texts))
        grams = sorted(wanted)
        data, offsets = W.text_bytes(texts)
        self.postings = {g: self.all[:0] for g in grams}
        if len(data) < 3:
            return
        number = np.zeros(1 << 24, dtype=np.uint16)
        for i, g in enumerate(grams, 1):
            number[int.from_bytes(g, "big")] = i
        owners, found = [], []
        for at in range(0, len(data) - 2, W.STEP_BYTES):
            part = FOLD[data[at : at + W.STEP_BYTES + 2]].astype(np.uint32)
            here = number[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            place = np.flatnonzero(here)
            owner = np.searchsorted(offsets, place + at, side="right") - 1
            inside = place + at + 3 <= offsets[owner + 1]
            owners.append(owner[inside])
            found.append(here[place[inside]])
        pairs = np.unique(np.concatenate(found).astype(np.int64) * len(texts) + np.concatenate(owners))
        which, owner = pairs // len(texts), pairs % len(texts)
        ends = np.searchsorted(which, np.arange(1, len(grams) + 2))
        self.postings = {g: owner[ends[i] : ends[i + 1]] for i, g in enumerate(grams)}

    def find(self, query: tuple | bytes) -> np.ndarray:
        if isinstance(query, bytes):
            return self.postings[query]
        found = [self.find(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        out = self.all
        for ids in sorted(found, key=len):
            out = np.intersect1d(out, ids, assume_unique=True)
        return out


SPANS = "array<struct<kind: string, start: int, end: int>>"


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id and spans, by start and then as the rules are listed.

    start and end count code points; the end is exclusive. A span is the whole match.
    """
    plans = [(r.kind, re.compile(r.pattern, r.flags), r.ok, trigram_query(r.pattern)) for r in rules]
    wanted = set().union(*(trigrams(q) for *_, q in plans))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            segment = Segment(batch.column(1), wanted)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans: list[list] = [[] for _ in texts]
            for order, (name, pattern, ok, query) in enumerate(plans):
                for i in segment.find(query):
                    spans[i] += [(m.start(), order, m.end(), name) for m in pattern.finditer(texts[i]) if ok(m)]
            rows = [[{"kind": n, "start": s, "end": e} for s, _, e, n in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def spans_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans (of these kinds), comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with each span replaced; a span that overlaps one before it is taken together with it."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate(
        spans,
        start,
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(by)).alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
    )
    return F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.length(text)))
