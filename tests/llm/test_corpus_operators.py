"""Each operator against brute force on the small corpus, and on an empty table."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, jaccard, leaks, licenses, lines, quality, secrets, sharding, token_counts, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.table(spark).repartition(3).persist()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in corpus.rows()]


def words(text):
    return (text or "").encode().split()


# 1
def test_leaks_are_all_windows_with_the_similarity(spark, docs, pairs):
    near = corpus.ITEM.split()
    items = [(1, corpus.ITEM), (2, None), (3, ""), (4, "not in any text at all here"), (5, "tiny text"), (6, corpus.prose(41, 50)), (7, " ".join(["begin", *near[1:]])), (8, " ".join(corpus.prose(20, 40).split() + corpus.prose(21, 40).split() * 3))]
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in pairs:
        w = leaks.split_words(t)
        for i, item in items:
            v = leaks.split_words(item)
            if v and any(leaks.similarity(leaks.weighted(v), leaks.weighted(w[p : p + len(v)])) >= 0.8 for p in range(max(1, len(w) - len(v) + 1))):
                want.add((d, i))
    assert got == want and (13, 1) in got and (13, 7) in got


def test_hamming_blocks_give_all_within_the_radius():
    rng = np.random.default_rng(1)
    known = rng.integers(0, 2**63, 40, dtype=np.uint64)
    found = known[rng.integers(0, 40, 500)].copy()
    for i in range(500):
        for bit in rng.choice(64, rng.integers(0, 16), replace=False):
            found[i] ^= np.uint64(1) << np.uint64(bit)
    at, which = leaks.HammingBlocks(known, 11).within(found)
    want = {(i, j) for i in range(500) for j in range(40) if bin(int(found[i] ^ known[j])).count("1") <= 11}
    assert set(zip(at.tolist(), which.tolist(), strict=True)) == want


def test_simhash_is_the_majority_of_word_pairs():
    h = np.random.default_rng(2).integers(0, 2**63, 60, dtype=np.uint64)
    from colloquy.llm import _words as W

    features = W.windows(h, 2)
    for size, got in leaks.simhashes(h, [2, 12, 48]).items():
        for p in (0, 5, len(got) - 1):
            part = features[p : p + size - 1]
            bits = [sum(int(x) >> b & 1 for x in part) > len(part) // 2 for b in range(64)]
            assert all(bool(int(got[p]) >> b & 1) == v for b, v in enumerate(bits))


def test_leaks_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(docs, none).count() == 0
    assert leaks.without_leaks(corpus.empty(spark), none).count() == 0


# 2
def test_license_scan_finds_held_out_notices_and_nothing_else(spark, docs):
    more = spark.createDataFrame([(101, f"{corpus.prose(50, 40)}\nReleased under the MIT License."), (102, "This file is licensed under the Apache License, Version 2.0 by us.\nmore"), (103, "the license to drive\nthis version of the public story")], "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in licenses.license_scan(docs.select("doc_id", "text").unionByName(more)).where("confirmed").collect()}
    assert got == {(101, "MIT"), (102, "Apache-2.0")}


def test_license_needed_words_bound_every_prediction():
    model = licenses.Model({"mit": [2.0] + [0.0] * 12, "the": [0.5] + [0.0] * 12, "the_mit": [1.0] + [0.0] * 12}, [-3.0] + [-50.0] * 11 + [0.0], 0.5)
    need = set(model.needed_words())
    for terms in (["mit", "the", "the_mit"], ["mit", "the_mit"]):
        assert -3 + sum(model.weights[t][0] for t in terms) >= 0 and need & {w for t in terms for w in t.split("_")}


# 3
def brute_runs(pairs, least):
    """Whether each document still has a run of `least` words or more that stands earlier."""
    seen, out = set(), []
    for d, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0])):
        kept = [x for x in (t or "").split("\n") if x.encode().split()]
        size = [len(words(x)) for x in kept]
        for i in range(len(kept)):
            total = 0
            for j in range(i, len(kept)):
                total += size[j]
                if total >= least:
                    run = tuple(kept[i : j + 1])
                    if run in seen:
                        out.append(d)
                    seen.add(run)
                    break
    return out


def test_line_dedup_leaves_no_long_run_twice_and_takes_only_repeats(docs, pairs):
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "__line_total", "__line_removed"]
    rows = got.collect()
    assert len(rows) == len(pairs)
    once = {(r.doc_id, r.text) for r in rows}  # equal rows are one document
    assert brute_runs(list(once), 50) == []
    before = {d: t for d, t in pairs}
    everywhere = Counter(x for t in {t for _, t in pairs if t} for x in t.split("\n"))
    for r in rows:
        if r.doc_id in (1, 2, 3, 4, 10, 13, 15):
            assert r.text == before[r.doc_id]
        gone = Counter((before[r.doc_id] or "").split("\n")) - Counter((r.text or "").split("\n")) if r.doc_id not in (None, 19) else Counter()
        assert all(everywhere[x] > 1 or r.doc_id in (7,) for x in gone)
    assert next(r.text for r in rows if r.doc_id == 11) == "\n".join([corpus.prose(11, 80), corpus.prose(12, 20)])


def test_line_dedup_empty(spark):
    assert lines.dedup_lines(corpus.empty(spark)).count() == 0


# 4
def test_secrets_are_all_matches(docs, pairs):
    got = Counter((r.doc_id, r.s) for r in secrets.secret_spans(docs).select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect())
    want = Counter()
    for d, t in pairs:
        found = [(m.start(), i, m.end(), r.kind) for i, r in enumerate(secrets.BASE + secrets.MORE) for m in re.finditer(r.pattern, t or "", r.flags) if r.ok(m)]
        want[d, ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))] += 1
    assert got == want and any("access" in s and "assign" in s and "hex" in s for _, s in got)


@pytest.mark.parametrize("pattern", [r"abc(de|fg)+h", r"x?yz{2}w[ab]cd", r"(foo|ba[rz])qux", r"[a-z]+", r"a.c", r"(abc)?def", r"(?:abc){0,2}"])
def test_trigram_queries_never_miss(pattern):
    query = secrets.trigram_query(pattern)
    texts = ["abcdeh", "abcfgdeh", "xyzzwacd", "fooqux", "bazqux", "lower", "abc", "abcdef", "def", "nothing", ""]
    segment = secrets.Segment(pa.array(texts), secrets.trigrams(query))
    found = set(segment.find(query).tolist())
    for gram, held in segment.postings.items():
        assert held.tolist() == [i for i, t in enumerate(texts) if gram in t.encode().lower()]
    assert all(i in found for i, t in enumerate(texts) if re.search(pattern, t))


def test_an_index_over_several_steps(monkeypatch):
    monkeypatch.setattr(secrets.W, "STEP_BYTES", 7)
    texts = ["akiaAKIA", None, "", "ab", "xxTOKENyy", "tok", "en" * 40 + "token"]
    segment = secrets.Segment(pa.array(texts), {b"aki", b"tok", b"oke", b"ken", b"zzz"})
    for gram, held in segment.postings.items():
        assert held.tolist() == [i for i, t in enumerate(texts) if gram in (t or "").encode().lower()]


def test_masking(spark):
    df = spark.createDataFrame([(1, "x token = abcdef123 y")], "doc_id long, text string")
    out = secrets.secret_spans(df).join(df, "doc_id").select(secrets.mask(F.col("text"), F.col("spans")).alias("m")).first().m
    assert out == "x [SECRET] y"


# 5
def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 300, 60)) + (" vile nasty vile rotten" * (1 + i % 3) if i % 4 == 0 else "")) for i in range(400)]
    table = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)] + [(7, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    assert len(got) == 402
    held = range(240, 400)
    assert np.mean([got[i].toxic == (i % 4 == 0) for i in held]) >= 0.97
    assert np.mean([got[i].expected_severity for i in held if i % 12 == 8]) > np.mean([got[i].expected_severity for i in held if i % 12 == 0])
    none = toxicity.toxicity(table, labels.limit(0)).agg(F.max("expected_severity"), F.count("*")).first()
    assert tuple(none) == (0.0, 402)


# 6
def test_shards_fit_and_rows_stay(docs, spark):
    limit = 20_000
    got = sharding.shard(docs, limit)
    assert got.columns == [*docs.columns, "shard", "depth", "shard_bytes"]
    rows = got.collect()
    assert len(rows) == docs.count()
    size, count = defaultdict(int), defaultdict(set)
    for r in rows:
        size[r.shard] += len((r.text or "").encode())
        count[r.shard].add((r.doc_id, r.text))
    assert all(s <= limit or len(count[k]) == 1 for k, s in size.items())
    assert not any(a != b and b.startswith(a) for a in size for b in size)
    assert sharding.shard(corpus.empty(spark), limit).count() == 0


def test_equal_rows_above_the_limit_are_paged(spark):
    df = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, "y")], "doc_id long, text string")
    sizes = Counter(r.shard for r in sharding.shard(df, 1000).collect())
    assert sum(sizes.values()) == 51 and max(sizes.values()) <= 10


# 7
def test_encoding_is_the_library_s_and_decodes(docs, pairs, spark):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    t = Tokenizer.from_file(path)
    got = Counter((r.doc_id, bytes(r.ids), r.text) for r in bpe.encode_decode(docs, path).collect())
    want = Counter()
    for d, text in pairs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[d, np.array(ids, dtype="<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode_decode(corpus.empty(spark), path).count() == 0


# 8
def brute_quality(text):
    w = [x.decode() for x in words(text)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_quality_counts_and_verdicts(docs, pairs, spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    assert got == Counter((d, *brute_quality(t)) for d, t in pairs)
    kept = {r.doc_id for r in quality.good_documents(docs).collect()}
    assert {6, 8, 10, 11, 13, 15} <= kept and not {1, 2, 3, 4, 12, 17, 18} & kept
    assert quality.quality_rules(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [2, 5, 10])
def test_coverage_of_repeated_grams(n):
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] * 2 + [40, 41], dtype=np.uint64)
    grams = Counter(tuple(ids[i : i + n]) for i in range(len(ids) - n + 1))
    want = {i + j for i in range(len(ids) - n + 1) if grams[tuple(ids[i : i + n])] > 1 for j in range(n)}
    assert set(np.flatnonzero(quality.in_repeated(ids, n)).tolist()) == want


# 9
def brute_components(pairs):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in pairs:
        w = words((t or "").translate(fold))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    label = list(range(len(sets)))
    for _ in sets:
        for i, (a, s) in enumerate(sets):
            for j, (b, t) in enumerate(sets):
                if s and t and a is not None and b is not None and 100 * len(s & t) >= 80 * len(s | t):
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for x, (d, _) in zip(label, sets, strict=True):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return Counter((d, len(s), least[x] if s and d is not None else d) for x, (d, s) in zip(label, sets, strict=True))


def test_jaccard_components(docs, pairs, spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == brute_components(pairs)
    assert jaccard.jaccard_components(corpus.empty(spark)).count() == 0


def test_jaccard_on_families_of_near_copies(spark):
    rng = np.random.default_rng(4)
    rows = []
    for family in range(6):
        base = corpus.prose(60 + family // 2, 90).split()
        for _ in range(12):
            w = list(base)
            for i in rng.choice(90, rng.integers(0, 5), replace=False):
                w[i] = f"e{rng.integers(50)}"
            rows.append((len(rows), " ".join(w[: 90 - int(rng.integers(0, 8))])))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# 10
def test_edits_give_the_counts_of_the_edited_text(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    t = Tokenizer.from_file(path)
    rows = token_counts.edited_counts(docs, path).select("*", token_counts.total().alias("n")).collect()
    for r in rows:
        assert r.n == len(t.encode(r.text or "", add_special_tokens=False).ids)
    assert Counter((r.doc_id, r.n_before) for r in rows) == Counter((d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in [(q[0], q[1]) for q in corpus.rows()])
    assert any(r.n_edits for r in rows)


def test_an_edit_of_a_long_text_encodes_little(spark):
    path = bpe.default_tokenizer()
    text = corpus.prose(3, 5000)
    df = spark.createDataFrame([(1, text, [(15_000, 15_003, "zz yy")]), (2, "", [(0, 0, "some new words")])], f"doc_id long, text string, edits {token_counts.EDITS}")
    got = {r.doc_id: r for r in token_counts.update_trees(token_counts.build_trees(df, path), path).collect()}
    assert got[1].n_reencoded <= 4 * token_counts.LEAF and got[1].text == text[:15_000] + "zz yy" + text[15_003:]
    assert got[2].text == "some new words"


def test_digests(spark, docs):
    row = bpe.encode_decode(docs.where("doc_id = 4"), bpe.default_tokenizer()).select(F.sha2("ids", 256).alias("s"), "ids").first()
    assert row.s == hashlib.sha256(bytes(row.ids)).hexdigest()


def test_empty_tables(spark):
    none = corpus.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert secrets.secret_spans(none).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert token_counts.edited_counts(none, bpe.default_tokenizer()).count() == 0
