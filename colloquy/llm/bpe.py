"""BPE encoding and decoding through a table of distinct words.

Spark splits every whole text into the tokenizer's words. Documents are gathered in blocks; a block has a dictionary of
its distinct words and, for each position, the word's number. The dictionaries of all blocks are dealt out by word in
packed rows, each distinct word is encoded once, its ids meet their pieces in a join of the id-to-piece table, and both
go back to the blocks, where they join the positions. What is shuffled for a common word is an entry for each block, not
one for each occurrence, so no word makes a large group. The rows of the blocks are shuffled once and used twice; docs
has to be read from files or a written table, so that a task that runs again makes the same blocks.

Null and empty texts have no ids and decode to an empty text. Very long texts are a large row of their own block. An
empty table gives no rows. The shuffle is dealt out as the session says, or wider where a worker's part of it would be
too large, so memory does not grow with the corpus.
Repeated rows get equal results. Ties cannot occur. Special tokens inside a text are taken as such, as the tokenizers
library does. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import _words as W
from colloquy.llm._shared import bounded_batches, parts_for, release_memory

#: The published word pattern of byte-level BPE; (?U) gives \s its Unicode meaning in Java.
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place is block * SLOT + the word's number in the block's dictionary; a block is task * TASK + its number there. So
#: 2 ** 24 tasks, each with 8,192 blocks of 67 million distinct words, fit 63 bits.
SLOT = 1 << 26
TASK = 1 << 13


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(json_text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(json_text)
    out.no_truncation()
    out.no_padding()
    return out


def read_tokenizer(path: str) -> str:
    """The tokenizer's file, of a fixed size, which the tasks get as text."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def words(text: Column, special: tuple[str, ...]) -> Column:
    """The tokenizer's words of a text, special tokens as words of their own."""
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if not special:
        return plain
    quoted = ["".join(f"\\{c}" if not c.isalnum() else c for c in s) for s in sorted(special, key=len, reverse=True)]
    parts = F.split(text, f"(?<={'|'.join(quoted)})|(?={'|'.join(quoted)})", -1)
    apart = F.flatten(
        F.transform(parts, lambda p: F.when(p.isin(*special), F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))),
    )
    return F.when(text.rlike("|".join(quoted)), apart).otherwise(plain)


def _pack(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, so the empty ones vanish."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: Bytes of input for each range of words: its distinct words, over all blocks, lie in one worker.
RANGE_INPUT = 2 << 30
#: A block ends after so many words, or with a document that has more.
BLOCK_WORDS = 1_000_000
ROWS = "target long, block long, number long, docs array<long>, sizes binary, data binary"


def _blocks(n: int):
    """(doc_id, words) to packed rows: for each block its documents, and for each of n ranges the block's words in it.

    A word's number in its block is its rank by range and then by the word. Rows of documents have the block as target
    and the dictionary's size as number; rows of words have -1 - range as target and their first word's number.
    """

    def row(target, block, number, docs, sizes, data) -> pa.RecordBatch:
        values = [pa.array([v], pa.int64()) for v in (target, block, number)]
        return pa.RecordBatch.from_arrays(
            [*values, pa.ListArray.from_arrays([0, len(docs)], docs), pa.array([sizes], pa.binary()), pa.array([data], pa.binary())],
            names=[f.split()[0] for f in ROWS.split(", ")],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_WORDS, "right")))
                if number >= TASK or task >= 1 << 24:
                    raise ValueError(f"task {task} has too many rows for one partition: read the table in smaller splits")
                block = task * TASK + number
                coded = pc.dictionary_encode(batch.column(1).slice(at, to - at).flatten())
                words = coded.dictionary.cast(pa.string())
                if len(words) > SLOT:
                    raise ValueError("a text has too many distinct words")
                part = (W.string_hashes(words) % np.uint64(n)).astype(np.int32)
                order = pc.sort_indices(
                    pa.table({"part": part, "word": words}), sort_keys=[("part", "ascending"), ("word", "ascending")],
                ).to_numpy()
                words, part = words.take(pa.array(order)), part[order]
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                yield row(
                    block, block, len(order), batch.column(0).slice(at, to - at).cast(pa.int64()), _pack(sizes[at:to]),
                    _pack(rank[coded.indices.to_numpy()]),
                )
                for a in np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else ():
                    some = words.slice(a, int(np.searchsorted(part, part[a], "right")) - a)
                    data, offsets = W.text_bytes(some)
                    yield row(
                        -1 - int(part[a]), block, int(a), pa.array([], pa.int64()), _pack(np.diff(offsets)),
                        zstandard.compress(data.tobytes(), 3),
                    )
                at, number = to, number + 1
                del coded, words
                release_memory()

    return run


def _encoder(tokenizer_json: str):
    """The rows of words of a partition to rows (ids, places): a row for each distinct word; a word is in one partition only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, places = [], []
        for batch in batches:
            for i in np.flatnonzero(batch.column("target").to_numpy() < 0):
                sizes = _unpack(batch.column("sizes")[i].as_py()).astype(np.int64)
                data = zstandard.decompress(batch.column("data")[i].as_py())
                parts.append(
                    pa.Array.from_buffers(
                        pa.large_string(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(data)],
                    ),
                )
                places.append(
                    batch.column("block")[i].as_py() * SLOT + batch.column("number")[i].as_py() + np.arange(len(sizes), dtype=np.int64),
                )
        if not parts:
            return
        coded = pc.dictionary_encode(pa.concat_arrays(parts))
        codes, place = coded.indices.to_numpy(), np.concatenate(places)
        order = np.argsort(codes, kind="stable")
        place, ends = place[order], np.append(0, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))))
        del parts, places, codes, order
        release_memory()
        tokenizer = _tokenizer(tokenizer_json)
        for at in range(0, len(coded.dictionary), 20_000):
            distinct = coded.dictionary.slice(at, 20_000).to_pylist()
            ids = [e.ids for e in tokenizer.encode_batch(distinct, add_special_tokens=False)]
            edge = ends[at : at + len(distinct) + 1]
            for lo in range(0, len(distinct), 5_000):
                own = edge[lo : lo + 5_001]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo : lo + 5_000], pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(place[own[0] : own[-1]])),
                    ],
                    names=["ids", "places"],
                )

    return run


def piece_table(spark: SparkSession, tokenizer_json: str) -> DataFrame:
    """(id, piece): the bytes of each id of the vocabulary, whose size is fixed (50,257 rows)."""
    tokenizer = _tokenizer(tokenizer_json)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    byte = _byte_of_char()
    rows = [(
        i, special[i].encode() if i in special else bytes(byte[c] for c in t),
    ) for t, i in tokenizer.get_vocab(with_added_tokens=True).items()]
    ids, pieces = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array(pieces, pa.binary())}))


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (places, pos, id, piece), as posexplode_outer left them, to rows (places, ids, bytes): pos 0 or null begins one."""
    rest: pa.RecordBatch | None = None

    def close(table: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
        ends = np.append(begin, table.num_rows)
        ids = pc.fill_null(table.column(2), 0).cast(pa.int32())
        full = pc.is_valid(table.column(2)).to_numpy(zero_copy_only=False)
        piece = pc.fill_null(table.column(3), b"").cast(pa.large_binary())
        byte_at = np.frombuffer(piece.buffers()[1], dtype=np.int64)[piece.offset : piece.offset + len(piece) + 1]
        data = piece.buffers()[2] or pa.py_buffer(b"")
        id_at = np.concatenate([[0], np.cumsum(full)])[ends] * 4
        kept = np.ascontiguousarray(ids.to_numpy(zero_copy_only=False)[full], dtype="<i4")
        return pa.RecordBatch.from_arrays(
            [
                table.column(0).take(pa.array(begin)),
                pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(id_at.astype(np.int64)), pa.py_buffer(kept)]),
                pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.ascontiguousarray(byte_at[ends])), data]),
            ],
            names=["places", "ids", "bytes"],
        )

    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        begin = np.flatnonzero(pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False) == 0)
        if not len(begin):
            rest = batch
            continue
        if len(begin) > 1:
            yield close(batch.slice(0, begin[-1]), begin[:-1])
        rest = batch.slice(begin[-1])
    if rest is not None and rest.num_rows:
        yield close(rest, np.array([0]))


def with_pieces(coded: DataFrame, pieces: DataFrame, keep: str) -> DataFrame:
    """Decodes (keep, ids): each id meets its piece in a join; the rows stay in order, so nothing is shuffled.

    Returns (keep, id, pos, piece). The vocabulary has a fixed size, so it is broadcast.
    """
    out = coded.select(keep, F.posexplode_outer("ids").alias("pos", "id"))
    return out.join(F.broadcast(pieces), "id", "left").select(keep, "pos", "id", "piece")


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(places, ids, bytes) to rows (target, packed): slots, id counts, ids, byte counts, bytes; some for each block."""

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = table.column(0).combine_chunks()
        place = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        order = np.argsort(place)
        place, owner = place[order], owner[order]
        block = place // SLOT
        at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        rows = []
        for a, b in zip(at, np.append(at[1:], len(block)), strict=True):
            who = pa.array(owner[a:b])
            ids, data = table.column(1).take(who).combine_chunks(), table.column(2).take(who).combine_chunks()
            packed = [
                _pack(np.diff(place[a:b] % SLOT, prepend=0)), _pack(pc.binary_length(ids).to_numpy() // 4),
                _pack(np.frombuffer(b"".join(ids.to_pylist()), dtype="<u4")), _pack(pc.binary_length(data).to_numpy()),
                zstandard.compress(b"".join(data.to_pylist()), 3),
            ]
            rows.append((int(block[a]), packed))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], names=["target", "packed"],
        )

    parts, size = [], 0
    for batch in batches:
        parts.append(
            batch.set_column(1, "ids", batch.column(1).cast(pa.large_binary())).set_column(
                2, "bytes", batch.column(2).cast(pa.large_binary()),
            ),
        )
        size += len(batch.column(0).flatten())
        if size >= 1_000_000:
            yield pack(parts)
            parts, size = [], 0
    if size:
        yield pack(parts)


def _spread(codes: np.ndarray, start: np.ndarray, size: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code one after the other, and how many each has."""
    n = size[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start[codes] - (ends - n), n) + np.arange(total)], n


def _assemble(blocks: pa.Table, parts: pa.Table) -> pa.Table:
    """Joins ids and pieces to the positions of a block's documents."""
    release_memory()
    out = []
    for row in blocks.to_batches():
        for i in range(row.num_rows):
            docs, n = row.column("docs")[i].values, row.column("number")[i].as_py()
            if row.column("target")[i].as_py() < 0:
                continue
            counts, codes = _unpack(row.column("sizes")[i].as_py()).astype(np.int64), _unpack(row.column("data")[i].as_py())
            got = [p for chunk in parts.column("packed").chunks for p in chunk.to_pylist()]
            slot = np.concatenate([np.cumsum(_unpack(p[0]).astype(np.int64)) for p in got] or [np.zeros(0, np.int64)])
            tables = []
            for size_at, decode in ((1, _unpack), (3, lambda d: np.frombuffer(zstandard.decompress(d), dtype=np.uint8))):
                size_in = np.concatenate([_unpack(p[size_at]).astype(np.int64) for p in got] or [np.zeros(0, np.int64)])
                size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
                size[slot], start[slot] = size_in, np.cumsum(size_in) - size_in
                tables.append((start, size, np.concatenate([decode(p[size_at + 1]) for p in got] or [np.zeros(0, np.uint8)])))
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 400_000, "right")))
                part = codes[(ends[at - 1] if at else 0) : ends[to - 1]]
                edges = np.concatenate([[0], np.cumsum(counts[at:to])])
                cols = [docs.slice(at, to - at)]
                for start, size, values in tables:
                    spread, per = _spread(part, start, size, values)
                    edge = np.concatenate([[0], np.cumsum(per)])[edges]
                    width = values.dtype.itemsize
                    cols.append(
                        pa.Array.from_buffers(
                            pa.large_binary(), to - at,
                            [None, pa.py_buffer((edge * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(spread))],
                        ).cast(
                            pa.binary(),
                        ),
                    )
                out.append(pa.RecordBatch.from_arrays([*cols[:2], _text(cols[2])], names=["doc_id", "ids", "text"]))
                at = to
    return pa.Table.from_batches(out) if out else pa.table(
        {"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "text": pa.array([], pa.string())},
    )


def _text(data: pa.Array) -> pa.Array:
    try:
        return data.cast(pa.string())
    except pa.ArrowInvalid:  # ids that do not come from an encoder can stand for broken UTF-8
        return pa.array([d.decode(errors="replace") for d in data.to_pylist()], pa.string())


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, text) for each row of docs (doc_id, text): ids as little-endian unsigned 32-bit numbers, text decoded from them."""
    spark = docs.sparkSession
    n = parts_for(docs, RANGE_INPUT)
    tokenizer = read_tokenizer(tokenizer_path)
    special = tuple(t.content for t in _tokenizer(tokenizer).get_added_tokens_decoder().values())
    bounded_batches(docs.sparkSession)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text"), special).alias("words"))
    rows = split.mapInArrow(_blocks(n), ROWS).repartition(n, "target")
    coded = rows.mapInArrow(_encoder(tokenizer), "ids array<int>, places array<long>")
    joined = with_pieces(coded, piece_table(spark, tokenizer), "places")
    packed = joined.select("places", "pos", "id", "piece").mapInArrow(
        lambda batches: _by_block(_sequences(batches)), "target long, packed array<binary>",
    )
    return rows.groupBy("target").cogroup(packed.groupBy("target")).applyInArrow(_assemble, "doc_id long, ids binary, text string")


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
