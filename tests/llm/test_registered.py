"""Every registered query of the subpackage on the small tables: its columns, its SQL, and what the contracts ask for."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from colloquy.llm import _words as W
from colloquy.llm import bpe, quality, secrets, token_counts

NAMES = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]


@pytest.fixture(scope="module")
def texts(sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = entry.queries()[name](spark, sf_dir).collect()
        return kept[name]

    return get


def test_all_operators_and_the_pipeline_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n != "pipeline") == list(range(1, 14)) and "pipeline" in NAMES


@pytest.mark.parametrize("name", NAMES)
def test_rows(results, texts, name):
    rows = results(name)
    whole = ("op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12")
    if name.split("_")[0] in whole:
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if not name.startswith("op13"):
        assert rows and all(r.doc_id in texts for r in rows)


@pytest.mark.parametrize("name", ["op6_sharding", "op9_ngram_jaccard_join"])
def test_same_rows_as_the_sql(results, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    want = Counter(tuple(r[at.index(c)] for c in sorted(at)) for r in cur.fetchall())
    assert Counter(tuple(r[c] for c in sorted(at)) for r in results(name)) == want


def test_op4_digests(results, texts):
    for r in results("op4_secret_scan"):
        t = texts[r.doc_id] or ""
        found = {rule.kind: [(m.start(), m.end()) for m in __import__("re").finditer(rule.pattern, t, rule.flags) if rule.ok(m)] for rule in secrets.BASE}
        spans = sorted((s, i, e, k) for i, (k, v) in enumerate(found.items()) for s, e in v)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*map(len, found.values()), digest)


def test_op7_digests(results, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    library.no_padding()
    for r in results("op7_bpe_encode_decode"):
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def covered(words, n):
    """Characters of the words inside n-word windows that stand twice or more."""
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {i + j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(n)}
    return sum(len(words[i]) for i in inside)


def test_op8_verdicts(results, texts):
    limits = quality.Limits()
    for r in results("op8_quality_rules"):
        t = texts[r.doc_id] or ""
        words = [w.decode() for w in t.encode().split()]
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += sum(len(w.decode()) for w in line.encode().split()) if line in seen else 0
            seen.add(line)
        grams = [covered(words, n) for n in limits.grams]
        total = sum(map(len, words))
        fits = dup <= limits.lines * total and all(g <= s * total for g, s in zip(grams, limits.grams.values(), strict=True))
        assert (r.dup_line_chars, list(r.dup_gram_chars), r.kept) == (dup, grams, fits and not r.base_failed)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7, 10])
def test_windows_are_polynomials_of_their_words(k):
    h = np.random.default_rng(k).integers(0, 2**63, 50, dtype=np.uint64)
    want = [sum(int(h[i + j]) * pow(W.BASE, j, 1 << 64) for j in range(k)) % (1 << 64) for i in range(50 - k + 1)]
    assert W.windows(h, k).tolist() == W.mix(np.array(want, dtype=np.uint64)).tolist()


def test_a_large_insertion_becomes_leaves_of_its_own():
    counter = token_counts.Counter(bpe.read_tokenizer(bpe.default_tokenizer()))
    text = " ".join(f"word{i % 50}" for i in range(1000))
    words = counter.split(text)
    parts = [words[i : i + token_counts.LEAF] for i in range(0, len(words), token_counts.LEAF)]
    ends = np.cumsum([sum(map(len, p)) for p in parts]).tolist()
    sums = token_counts.tree(np.array([sum(counter.counts(p)) for p in parts])).tolist()
    more = " ".join(f"other{i % 70}" for i in range(3000))
    new, new_ends, new_sums, _ = token_counts.update(text, ends, sums, [{"start": 900, "end": 905, "text": more}, {"start": 4000, "end": 4001, "text": ""}], counter)
    assert new == text[:900] + more + text[905:4000] + text[4001:] and new_ends[-1] == len(new)
    assert len(new_ends) > len(ends) + 80 and new_sums[1] == sum(counter.counts(counter.split(new)))
    assert max(np.diff(new_ends)) < 12 * token_counts.LEAF
