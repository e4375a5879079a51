"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles (A to Z folded; a text with fewer words is one shingle). Two
documents link when 100 * intersection >= 80 * union. The work has three parts.

1. Which shingles occur in two documents or more? Documents lie in blocks. Each block sends the shingles it has, packed
   and dealt out by hash range; each range counts them over all blocks and sends the frequency classes back. A document
   with fewer shared shingles than a link needs is on its own. The other sets are kept, rarest shingles first.
2. An inverted index over the prefix that any link must touch. Equal sets are one entry. Its lists are cut in blocks by
   set size and position; two blocks meet only if sizes and positions allow a link, so most are skipped unread.
3. Answers by set relation. Each list first compares its entries with one pivot. Entries that link to it have answers
   that follow from the pivot's: entries of one component are not compared again, and for others the overlaps with a
   pivot bound the overlap of the two. Only pairs that no bound decides are verified exactly.

Pivots make one link for each member of a group of copies, so copies are never expanded into all pairs, and no link
between different components is lost. A document's component is found by spreading the smallest key over the links.

Null and empty texts have no shingles and are linked with nothing. Very long texts are sets like any other. An empty table
gives no rows. Rows without a doc_id get no component. Sets are told apart by 128 bits of hash and numbered after that.
Equal texts are linked (similarity 1). Rows that repeat a doc_id each stand for themselves. Rows that repeat id and text
very often go through the work once, with their number. A tie for the smallest id cannot matter. Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _words as W
from colloquy.llm._shared import partitions, parts_for, release_memory, spill

#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Frequencies are counted over hash buckets of so many bits; two shingles in one bucket only seem more frequent.
BUCKET_BITS = 40
#: Bytes of input for each range of buckets, and four times that of a block: a range, or a block's texts, lie in one worker.
RANGE_INPUT = 128 << 20
#: Blocks deal rows by id and text, so equal rows meet in one; those that repeat more often are one row with a number.
REPEATS = 1_000
#: Rows that one row with a number gives back in one step.
REPEAT_STEP = 100_000


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _block_sets(texts: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    release_memory()
    h, _, _, bounds = W.words(texts.column("text"), fold=True)
    value, own = W.unique_shingles(h, bounds, k)
    return value, own, len(bounds) - 1


def _cuts(n: int) -> np.ndarray:
    """Where each of n equal ranges of buckets begins."""
    return np.array([(i << BUCKET_BITS) // n for i in range(n + 1)], dtype=np.uint64)


def _sender(n: int, k: int):
    """A block's texts to one packed message for each range: its distinct buckets and in how many of its documents each is."""

    def run(texts: pa.Table) -> pa.Table:
        block = texts.column("block")[0].as_py()
        value, _, _ = _block_sets(texts, k)
        bucket, count = np.unique(value >> np.uint64(64 - BUCKET_BITS), return_counts=True)
        at = np.searchsorted(bucket, _cuts(n))
        rows = [(
            i, block, _pack(np.diff(bucket[a:b], prepend=np.uint64(0))), _pack(count[a:b]),
        ) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        return pa.table(
            [pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True) if rows else ([], [], [], []), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True,
            )],
            names=["range", "block", "buckets", "counts"],
        )

    return run


def _count(messages: pa.Table) -> pa.Table:
    """One range of buckets: over all blocks, how frequent is each? Class 0 is one document, then eight classes for each doubling."""
    parts = [np.cumsum(_unpack(x), dtype=np.uint64) for x in messages.column("buckets").to_pylist()]
    counts = np.concatenate([_unpack(x) for x in messages.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=counts)
    level = np.where(total < 2, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(total, 2))))).astype(np.uint8)[inverse]
    ends = np.cumsum([len(p) for p in parts])
    packed = [zstandard.compress(level[e - len(p) : e].tobytes(), 1) for p, e in zip(parts, ends, strict=True)]
    return pa.table([messages.column("range"), messages.column("block"), pa.array(packed, pa.binary())], names=["range", "block", "levels"])


def _keeper(k: int):
    """A block's texts and its frequency classes to a row for each document; tokens only where a link is possible."""

    def run(texts: pa.Table, levels: pa.Table) -> pa.Table:
        value, own, n = _block_sets(texts, k)
        size = np.bincount(own, minlength=n)
        bucket, inverse = np.unique(value >> np.uint64(64 - BUCKET_BITS), return_inverse=True)
        got = levels.sort_by("range").column("levels").to_pylist() if levels.num_rows else []
        level = np.frombuffer(b"".join(map(zstandard.decompress, got)), dtype=np.uint8)[inverse]
        shared = np.bincount(own, weights=level > 0, minlength=n).astype(np.int64)
        low, high = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        np.add.at(low, own, W.mix(value))
        np.add.at(high, own, W.mix(value ^ np.uint64(0x5851F42D4C957F2D)))
        set_key, set_check = W.mix(low + size.astype(np.uint64)).view(np.int64), W.mix(high).view(np.int64)
        stays = (size > 0) & (100 * shared >= PERCENT * size)
        # rows without an id are no entries, so they must not stand for an equal set that has one
        stays &= np.asarray(texts.column("doc_id").is_valid())
        able = np.flatnonzero(stays)
        stays[:] = False
        stays[able[np.unique(np.column_stack([set_key[able], set_check[able]]), axis=0, return_index=True)[1]]] = True
        mine = np.flatnonzero(stays[own])
        mine = mine[np.lexsort((value[mine], level[mine], own[mine]))]
        ends = np.cumsum(np.where(stays, size, 0))
        tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(value[mine].view(np.int64)))
        return pa.table(
            [
                texts.column("doc_id").cast(pa.int64()), texts.column("copies"), pa.array(size), pa.array(set_key), pa.array(set_check),
                pa.array(size - shared), pa.array(stays), tokens,
            ],
            names=["doc_id", "copies", "n_shingles", "set_key", "set_check", "n_single", "is_entry", "tokens"],
        )

    return run


def document_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, copies, n_shingles, set_key, set_check, n_single, is_entry, tokens) for each row of docs (doc_id, text, copies).

    Equal sets have equal set_key and set_check. tokens: the set, rarest first; empty where no other document can be
    linked, or where an equal set of the same block has them.
    """
    n = parts_for(docs, RANGE_INPUT)
    blocks = docs.select("doc_id", "text", "copies", F.pmod(F.xxhash64("doc_id", "text"), F.lit(4 * n)).alias("block")).repartition(n, "block")
    messages = blocks.groupBy("block").applyInArrow(_sender(n, k), "range long, block long, buckets binary, counts binary")
    levels = messages.groupBy("range").applyInArrow(_count, "range long, block long, levels binary")
    return blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(
        _keeper(k),
        "doc_id long, copies long, n_shingles long, set_key long, set_check long, n_single long, is_entry boolean, tokens array<long>",
    )


def _needed(a: Column, b: Column) -> Column:
    """The smallest overlap of sets of these sizes that links them."""
    return F.ceil(PERCENT * (a + b) / F.lit(100 + PERCENT) - 1e-9)


def _sizes_allow(a: Column, b: Column) -> Column:
    return (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


def verified(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """pairs (a, b) with the size of both sets and their overlap."""
    left = entries.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = entries.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).cast("long").alias("overlap"))


def _is_link(n_a: Column, n_b: Column, overlap: Column) -> Column:
    return 100 * overlap >= PERCENT * (n_a + n_b - overlap)


def components(links: DataFrame, name: str = "component", max_rounds: int = 50) -> DataFrame:
    """(node, label) for nodes with a smaller one in reach over the links (a, b): label is the smallest.

    Alternates two steps: larger neighbours of a node move to its smallest neighbour, then smaller ones do. Each round
    is written to the shared folder; it ends when a round changes nothing.
    """
    edges = spill(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least_below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least_below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least_below.select("u", F.col("m").alias("v")),
        )
        edges = spill(small.distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


def index(entries: DataFrame) -> DataFrame:
    """(token, node, n, n_single, rest): for each entry, the tokens of the prefix that a link must touch; rest: tokens from there on.

    Tokens of one document come first in each set and need no list.
    """
    prefix = F.col("n") - F.ceil(PERCENT * F.col("n") / 100 - 1e-9) + 1
    listed = F.slice("tokens", (F.col("n_single") + 1).cast("int"), F.greatest(prefix - F.col("n_single"), F.lit(0)).cast("int"))
    return entries.select("node", "n", "n_single", F.posexplode(listed).alias("pos", "token")).select(
        "token", "node", "n", "n_single", (F.col("n") - F.col("n_single") - F.col("pos")).alias("rest"),
    )


def with_blocks(entries: DataFrame) -> DataFrame:
    """Adds the list block of an index row: by size (a link spans two bands at most) and by eighths of the position."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).alias("band")
    return entries.select("*", band, F.floor(8 * F.col("rest") / (F.col("n") + 1)).alias("part"))


def links(entries: DataFrame) -> DataFrame:
    """Links (a, b) among entries (node, n, n_single, tokens) that connect all that is linked, directly or in steps."""
    lists = spill(index(entries), "jaccard-index")
    # the pivot of a list is its most central entry: the one with the smallest share of shingles of its own
    share = F.floor(1000 * F.col("n_single") / F.col("n")).alias("share")
    pivot = lists.groupBy("token").agg(F.min(F.struct(share, "n", "node")).alias("p"), F.count("*").alias("k")).where("k > 1").select(
        "token", F.col("p.node").alias("b"), F.col("p.n").alias("n_p"),
    )
    to_pivot = lists.join(pivot, "token").where((F.col("node") != F.col("b")) & _sizes_allow(F.col("n"), F.col("n_p"))).select(
        F.col("node").alias("a"), "b",
    ).distinct()
    known = spill(verified(to_pivot, entries), "jaccard-pivots")
    sure = known.where(_is_link(F.col("n_a"), F.col("n_b"), F.col("overlap"))).select("a", "b")
    group = components(sure, "jaccard-groups")

    # each entry's nearest pivot, and the overlap with it
    nearest = known.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("overlap", "b")).alias("x")).select(
        "node", F.col("x.b").alias("near"), F.col("x.overlap").alias("with_near"),
    )
    rich = with_blocks(lists.join(group, "node", "left").join(nearest, "node", "left").withColumn("label", F.coalesce("label", "node")))
    mixed = rich.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    rich = spill(rich.join(mixed, "token", "left_semi"), "jaccard-mixed")

    # skip pairs of list blocks by their sizes, positions and components
    heads = rich.groupBy("token", "band", "part").agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("rest").alias("rest"), F.min("label").alias("lo"),
        F.max("label").alias("hi"),
    )
    x, y = heads.alias("x"), heads.alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & (100 * F.col("x.n_hi") >= PERCENT * F.col("y.n_lo")) & (100 * F.col("y.n_hi") >= PERCENT * F.col("x.n_lo"))
    meet &= F.least("x.rest", "y.rest") >= _needed(F.col("x.n_lo"), F.col("y.n_lo"))
    meet &= ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    skip = x.join(y, meet).select(
        F.col("x.token").alias("token"), F.col("x.band").alias("band"), F.col("x.part").alias("part"), F.col("y.band").alias("band_b"),
        F.col("y.part").alias("part_b"),
    )

    x, y = rich.join(skip, ["token", "band", "part"]).alias("x"), rich.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band_b") == F.col("y.band")) & (F.col("x.part_b") == F.col("y.part"))
    n_a, n_b = F.col("x.n"), F.col("y.n")
    open_ = (F.col("x.label") < F.col("y.label")) & _sizes_allow(n_a, n_b) & (F.least("x.rest", "y.rest") >= _needed(n_a, n_b))
    # what two sets share lies in a pivot of both, or in what neither shares with it nor has for itself
    bound = F.least("x.with_near", "y.with_near") + F.least(
        n_a - F.col("x.with_near") - F.col("x.n_single"), n_b - F.col("y.with_near") - F.col("y.n_single"),
    )
    open_ &= F.when(F.col("x.near") == F.col("y.near"), bound >= _needed(n_a, n_b)).otherwise(True)
    rest = x.join(y, same & open_).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = verified(rest, entries).where(_is_link(F.col("n_a"), F.col("n_b"), F.col("overlap"))).select("a", "b")
    return sure.unionByName(more)


def _counted(docs: DataFrame, repeats: int | None) -> tuple[DataFrame, bool]:
    """(docs (doc_id, text) with copies, are there any): 1 for each row, but rows that repeat more often than repeats are one row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    single = rows.withColumn("copies", F.lit(1).cast("long"))
    if repeats is None:
        return single, False
    row = F.xxhash64("doc_id", "text")
    often = spill(rows.groupBy(row.alias("row")).agg(F.count("*").alias("n")).where(F.col("n") > repeats).select("row"), "jaccard-repeats")
    if often.isEmpty():
        return single, False
    keyed = single.withColumn("row", row)
    many = keyed.join(often, "row", "left_semi").groupBy("doc_id", "text").agg(F.sum("copies").alias("copies"))
    return keyed.join(often, "row", "left_anti").drop("row").unionByName(many), True


def _given_back(rows: DataFrame, step: int = REPEAT_STEP) -> DataFrame:
    """Each row as often as copies says; long repetitions are dealt out in steps."""
    last = F.floor((F.col("copies") - 1) / F.lit(step))
    steps = rows.where("copies > 1").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    steps = steps.repartition(partitions(rows.sparkSession))
    left = F.least(F.lit(step).cast("long"), F.col("copies") - F.col("step") * F.lit(step))
    each = steps.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return rows.where("copies = 1").drop("copies").unionByName(each.drop("copies", "step", "copy"))


def jaccard_components(docs: DataFrame, k: int = 5, repeats: int | None = REPEATS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text); component_id: the smallest doc_id reachable.

    repeats: from how many rows of equal id and text on they go through the work as one; None where ids are unique.
    """
    rows, repeated = _counted(docs, repeats)
    sets = spill(document_sets(rows, k), "jaccard-sets")
    named = sets.where("doc_id is not null and n_shingles > 0").groupBy("set_key", "set_check").agg(
        F.min("doc_id").alias("own"), F.max("n_shingles").alias("n"), F.max("n_single").alias("n_single"), F.max("is_entry").alias("is_entry"),
        F.first(F.when(F.col("is_entry"), F.col("tokens")), ignorenulls=True).alias("tokens"),
    )
    # numbers are given once and written, so each different set is a node of its own
    named = spill(named.withColumn("node", F.monotonically_increasing_id()), "jaccard-entries")
    found = components(links(named.where("is_entry").select("node", "n", "n_single", "tokens")), "jaccard-components")
    named = named.select("set_key", "set_check", "node", "own").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("own").alias("component_id"))
    by_set = named.join(least, "label").select("set_key", "set_check", "component_id")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = sets.select("doc_id", "copies", "n_shingles", *(F.when(linked, F.col(c)).alias(c) for c in ("set_key", "set_check")))
    out = out.join(by_set, ["set_key", "set_check"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "copies")
    return _given_back(spill(out, "jaccard-counted")) if repeated else out.drop("copies")
