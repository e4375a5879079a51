"""The quality classifier on held-out labels; periodic runs and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpus import empty, rows, table
from pyspark.sql import functions as F

import __spark_entry__ as entry
from colloquy.llm import periodic, quality_model, variants


@pytest.fixture(scope="module")
def texts(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


# periodic runs


def runs_of(words, least=6):
    """(start, length, period) by comparing all words that are apart by each period."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + size - d)) for d in range(1, q)) if size >= 4 * q else True
            if size >= max(least, 4 * q) and not smaller:
                found.append((i, size, q))
            i = j + 1
    return sorted(found)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_in(words):
    ((runs, text),) = periodic.measure([1], [" ".join(words).encode()], 6, None)
    return [(r["start"], r["length"], r["period"]) for r in runs], text.decode()


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [
    fibonacci(400), [str(i.bit_count() % 2) for i in range(400)], "a" * 300, ("ab" * 40 + "c") * 7, (fibonacci(34) + "x") * 5 + "y" + (fibonacci(34) + "x") * 4,
    "aaaa", "aaaaaa", "abababa", "abababab", "xabcabcabcabcz", "abcdabcdabcdabc", "abcdabcdabcdabcd", "",
])
def test_runs_of_words_with_many_periods(words):
    runs = runs_of(list(words))
    assert found_in(list(words)) == (runs, collapsed(list(words), runs))


@pytest.mark.parametrize("period", [*range(1, 20), 31, 32, 33, 47, 48, 63, 64, 65, 127, 128])
def test_a_run_of_each_period_and_its_limits(period):
    base = [f"w{i}" for i in range(period)]
    for size in (4 * period - 1, 4 * period, 4 * period + 1, 7 * period + period // 2):
        words = ["left"] + (base * 8)[:size] + ["right", "end"]
        runs = [(1, size, period)] if size >= max(6, 4 * period) else []
        assert found_in(words)[0] == runs == runs_of(words)


def test_texts_of_a_batch_do_not_meet():
    rnd = random.Random(3)
    for _ in range(60):
        docs = []
        for _ in range(rnd.randint(1, 6)):
            words = []
            for _ in range(rnd.randint(0, 5)):
                base = [str(rnd.randrange(rnd.choice([1, 2, 3, 40]))) for _ in range(rnd.choice([1, 2, 3, 5, 8, 15, 16, 17, 33]))]
                words += base * rnd.randint(1, 7) + base[: rnd.randint(0, len(base))]
            docs.append(words)
        got = list(periodic.measure(list(range(len(docs))), [" ".join(d).encode() for d in docs], 6, None))
        for words, (runs, text) in zip(docs, got, strict=True):
            want = runs_of(words)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want and text.decode() == collapsed(words, want)


def test_op12_query(spark, sf_dir, texts):
    got = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_of(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_runs_of_odd_rows(spark):
    got = periodic.periodic_runs(table(spark).withColumn("runs", F.lit("theirs")).withColumn("collapsed", F.lit(1))).collect()
    assert Counter((r.doc_id, r.collapsed) for r in got) == Counter((i, collapsed(w := re.findall(r"[^\x20\x09-\x0D]+", t or ""), runs_of(w))) for i, t, *_ in rows())
    assert periodic.periodic_runs(empty(spark)).count() == 0
    long = " ".join(f"w{i % 1009}" for i in range(300_000))
    ((runs, text),) = periodic.measure([1], [long.encode()], 6, None)
    assert [(r["start"], r["length"], r["period"]) for r in runs] == [(0, 300_000, 1009)] and len(text.split()) == 1009


# spelling variants


def variants_of(texts, edit=None, least_chars=5, least_count=3):
    count = Counter()
    for doc_id, text in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({i: i + 32 for i in range(65, 91)})
            w = edit(doc_id, w) if edit else w
            if len(w) >= least_chars:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= least_count}
    holes, near = defaultdict(set), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    for (a, b), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
            if a + b in count:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return out


def test_op13_query(spark, sf_dir, texts):
    got = entry.queries()["op13_spelling_variants"](spark, sf_dir).collect()
    want = variants_of(texts.items(), variants.thinned)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.form and r.root != r.form for r in got)


@pytest.mark.parametrize("parts", ["1", "3", "17"])
def test_variants_of_words_made_to_meet(spark, parts):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("aabé") for _ in range(rnd.randint(5, 9))) for _ in range(250)} | {"a" * n for n in range(5, 12)} | {"z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1500}
    said = [(i, " ".join([w.upper() if i % 2 else w] * rnd.choice([2, 3, 3, 6, 7, 14, 30])) + ".") for i, w in enumerate(sorted(words))]
    said += [(None, None), (7, ""), (8, "3 + 4"), (9, "aaaaa-aaaaa aaaaa")]
    docs = spark.createDataFrame([(i, t, 1, "theirs") for i, t in said], "doc_id long, text string, n int, word string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = variants.spelling_variants(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = variants_of([(i, t.replace("É", "É") if t else t) for i, t in said])
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_frequent_word(spark):
    assert variants.spelling_variants(empty(spark)).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "once twice")], "doc_id long, text string")).count() == 0


# quality classifier


def test_op11_query(spark, texts):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entry.queries()["op11_quality_classifier"](spark, sf_dir).collect()}
    labels = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{sf_dir}/labels.parquet", columns=["doc_id", "quality"]).columns), strict=True))
    assert len(got) == pq.read_metadata(f"{sf_dir}/documents.parquet").num_rows
    for doc_id, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.98 * len(held)


def test_held_out_labels_are_not_learned_from(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.col("doc_id") % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = ({r.doc_id: r.score for r in quality_model.quality_scores(docs, x, held).collect()} for x in (labels, turned))
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 1e-4 for i in one)


def test_statistics_of_a_text():
    text = "The cat. THE END!!\n\nfoo### | the the the\nThe cat. THE END!!\n 12 été"
    x = dict(zip(quality_model.NAMES, quality_model.statistics(pa.array(["", text, None, " \n"]))[1], strict=True))
    words = text.split()
    chars = sum(map(len, words))
    assert x["capitals"] == pytest.approx(14 / chars) and x["symbols"] == pytest.approx(3 / chars) and x["bars"] == pytest.approx(1 / chars)
    assert x["digits"] == pytest.approx(2 / chars) and x["exclaims"] == pytest.approx(4 / chars) and x["mean_word"] == pytest.approx(chars / len(words))
    assert x["repeated_words"] == pytest.approx((len(words) - len(set(words))) / len(words)) and x["following_words"] == pytest.approx(2 / len(words))
    assert x["top_word"] == pytest.approx(3 / len(words)) and x["repeated_lines"] == pytest.approx(1 / 4) and x["capital_words"] == pytest.approx(4 / len(words))
    assert x["log_words"] == pytest.approx(np.log1p(len(words))) and x["log_lines"] == pytest.approx(np.log1p(4))
    assert not np.isnan(quality_model.statistics(pa.array(["", None, "x"]))).any() and quality_model.statistics(pa.array([], pa.string())).shape == (0, len(quality_model.NAMES))


def test_statistics_do_not_depend_on_the_batch(texts):
    some = list(texts.values())[:60]
    together = quality_model.statistics(pa.array(some))
    assert np.allclose(together, np.concatenate([quality_model.statistics(pa.array([t])) for t in some]))


def test_normal_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((500, len(quality_model.NAMES))).astype(np.float32), rng.integers(0, 2, 500).astype(float)
    model = quality_model.Model(x.mean(0), x.std(0), np.zeros(33), quality_model.Settings(features=32), np.zeros(1), np.zeros(1))
    labelled = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<float>, y double").repartition(7)
    a, b = quality_model.normal_equations(labelled, model, 10**9)
    z = model.basis(x.astype(float))
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(quality_model.NAMES))) * 0.7
    model = quality_model.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(1), quality_model.Settings(features=20_000), np.zeros(1), np.zeros(1))
    z = model.basis(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * model.settings.width**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_isotonic_levels():
    rng = np.random.default_rng(2)
    weight = rng.integers(1, 5, 60).astype(float)
    total = np.minimum(weight, rng.integers(0, 5, 60))
    first, last, level = quality_model.isotonic(weight, total)
    assert (np.diff(level) > 0).all() and first[0] == 0 and last[-1] == 59 and (first[1:] == last[:-1] + 1).all()
    fitted = np.repeat(level, last - first + 1)
    for i in range(60):  # the largest mean of a beginning against the smallest mean of an end
        want = max(min(total[a : b + 1].sum() / weight[a : b + 1].sum() for b in range(i, 60)) for a in range(i + 1))
        assert fitted[i] == pytest.approx(want)


def test_scores_of_odd_rows_and_labels(spark):
    docs = table(spark).withColumn("score", F.lit("theirs")).withColumn("x", F.lit(1))
    ids = sorted((r[0] for r in rows()), key=str)
    none = spark.createDataFrame([(1, None), (None, 1), (999, 1)], "doc_id long, quality int")
    held = F.col("doc_id") % 4 == 2
    got = quality_model.quality_scores(docs, none, held).collect()
    assert sorted((r.doc_id for r in got), key=str) == ids and {r.score for r in got} == {0.5}
    both = spark.createDataFrame([(i, i % 2) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12, 13)] * 2, "doc_id long, quality int")
    got = quality_model.quality_scores(docs, both, held).collect()
    assert sorted((r.doc_id for r in got), key=str) == ids and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert quality_model.quality_scores(empty(spark), both, held).count() == 0
