"""Leaks that are alike over the item's whole length, wherever they differ, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import leaks


def _words(rng, n):
    return [f"v{x}" for x in rng.integers(0, 10**9, n)]


@pytest.mark.parametrize(("length", "changed"), [(23, 2), (47, 4), (59, 6), (200, 21), (600, 63)])
@pytest.mark.parametrize("place", ["head", "tail"])
def test_leaks_changed_at_one_end_are_found(length, changed, place):
    rng = np.random.default_rng(length)
    n = 30 if length < 100 else 4
    items, texts, want = [], [], set()
    for i in range(n):
        v = _words(rng, length)
        w = [*_words(rng, changed), *v[changed:]] if place == "head" else [*v[:-changed], *_words(rng, changed)]
        w = [*_words(rng, length), *w, *_words(rng, length)]
        items.append((i, " ".join(v)))
        texts.append(" ".join(w))
        a, b = [x.encode() for x in v], [x.encode() for x in w]
        best = max((leaks.similarity(leaks.weighted(a), leaks.weighted(b[p : p + length])), -p) for p in range(len(b) - length + 1))
        if best[0] >= 0.8:
            want.add((i, i, best[0], -best[1], length))
    assert len(want) > n // 2 - 1
    assert set(leaks.Items(items, 11).find(pa.array(texts))) == want


@pytest.mark.parametrize(("length", "missing"), [(40, 5), (40, 7), (59, 5), (59, 11), (119, 12), (200, 21), (200, 39)])
@pytest.mark.parametrize("end", ["last", "first"])
def test_leaks_cut_by_an_end_of_the_text_are_found(length, missing, end):
    rng = np.random.default_rng(length + missing)
    v = ["word%06d" % x for x in rng.choice(10**6, length, replace=False)]
    other = ["text%06d" % x for x in rng.choice(10**6, 230, replace=False)]
    w = [*other, *v[:-missing]] if end == "last" else [*v[missing:], *other]
    (got,) = leaks.Items([(3, " ".join(v))], 11).find(pa.array(["nothing here", " ".join(w)]))
    a, b = [x.encode() for x in v], [x.encode() for x in w]
    windows = [b[max(0, p) : p + length] for p in range(1 - length, len(b))]
    best = max(leaks.similarity(leaks.weighted(a), leaks.weighted(x)) for x in windows)
    assert got[:3] == (1, 3, best) and best >= 0.8
    assert got[3:] == ((len(other), length - missing) if end == "last" else (0, length - missing))
    assert not list(leaks.Items([(3, " ".join(v))], 11).find(pa.array([" ".join([*other, *v[: length // 2]])])))


@pytest.mark.parametrize("length", [20, 60, 300, 600, 1000])
@pytest.mark.parametrize("place", ["head", "tail", "spread", "inserted"])
def test_leaks_are_found_wherever_they_differ(length, place):
    """The windows of an item cover it whole, so most edits leave one of them within the radius."""
    rng = np.random.default_rng(length)
    items, texts, want = [], [], set()
    for i in range(40 if length < 100 else 8):
        v = _words(rng, length)
        k = max(1, length // 50 if place == "spread" else length // 12)
        at = int(rng.integers(length))
        w = {"head": [*_words(rng, k), *v[k:]], "tail": [*v[:-k], *_words(rng, k)], "inserted": [*v[:at], *_words(rng, k), *v[at:]]}.get(place, list(v))
        if place == "spread":
            for j in rng.choice(length, k, replace=False):
                w[j] = f"x{j}"
        a, b = [x.encode() for x in v], [x.encode() for x in w]
        if max(leaks.similarity(leaks.weighted(a), leaks.weighted(b[p : p + length])) for p in range(len(b) - length + 1)) >= 0.8:
            want.add(i)
        items.append((i, " ".join(v)))
        texts.append(" ".join([*_words(rng, length), *w, *_words(rng, length)]))
    found = {i for i, *_ in leaks.Items(items, 11).find(pa.array(texts))}
    assert found <= want | found and len(found & want) >= 0.98 * len(want)


def test_blocks_give_what_one_block_gives(spark):
    rng = np.random.default_rng(7)
    items = [(i, " ".join(_words(rng, int(rng.integers(1, 90))))) for i in range(40)] + [(40, None), (41, ""), (None, items_text := " ".join(_words(rng, 30)))]
    docs = [(i, " ".join([*_words(rng, 20), t or "", *_words(rng, 20)])) for i, t in items] + [(90, None), (91, ""), (92, items_text)]
    items_df, docs_df = (spark.createDataFrame(x, f"{k} long, text string").repartition(2) for x, k in ((items, "item_id"), (docs, "doc_id")))
    want = sorted(map(str, leaks.find_leaks(docs_df, items_df).collect()))
    assert len(list(leaks._blocks(items_df, 2000))) > 3 and len(want) >= 42
    assert sorted(map(str, leaks.find_leaks(docs_df, items_df, block_bytes=2000).collect())) == want
    assert leaks.find_leaks(docs_df.where("false"), items_df).count() == 0 == leaks.find_leaks(docs_df, items_df.where("false")).count()


def test_a_text_of_many_megabytes():
    rng = np.random.default_rng(8)
    item = _words(rng, 80)
    words = [f"w{x}" for x in rng.integers(0, 5000, 1_500_000).tolist()]
    text = " ".join([*words[:900_000], *item, *words[900_000:]])
    assert len(text) > 8_000_000
    assert list(leaks.Items([(5, " ".join(item))], 11).find(pa.array(["short", text]))) == [(1, 5, 1.0, 900_000, 80)]
