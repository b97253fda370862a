import random

import numpy as np
import pytest

from evidara.llm import neardup, ngram_join

from .test_neardup import DOCS, brute, corpus


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def expected(rows, width, percent):
    return [r[:3] for r in brute(rows, width, percent)[0]]


@pytest.mark.parametrize("width, percent", [(3, 90), (3, 80), (2, 70), (1, 60), (3, 100)])
def test_equals_brute_force(spark, width, percent):
    rows = corpus(width + percent)
    assert result(ngram_join.jaccard_join(spark.createDataFrame(rows, DOCS), width, percent)) == expected(rows, width, percent)


def chain(seed, words=60, steps=40):
    """Copies of which each differs from the one before: partners of different sizes, at the threshold and next to it."""
    rnd = random.Random(seed)
    text = [f"w{rnd.randrange(40)}" for _ in range(words)]
    rows = []
    for i in range(steps):
        rows.append((i, " ".join(text)))
        at = rnd.randrange(len(text))
        text = rnd.choice([lambda t: t[:at] + ["new"] + t[at:], lambda t: t[:at] + t[at + 1 :], lambda t: t + [f"x{i}"], lambda t: t[2:], lambda t: [f"y{i}", *t]])(text)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_links_at_the_threshold(spark, seed):
    rows = chain(seed)
    assert result(ngram_join.jaccard_join(spark.createDataFrame(rows, DOCS), 3, 90)) == expected(rows, 3, 90)


def test_long_lists_and_blocks_change_nothing(spark, monkeypatch):
    rows = chain(7) + [(100 + i, t) for i, t in corpus(5) if i is not None and i < 150]
    monkeypatch.setattr(neardup, "GROUP_BLOCK", 300)
    monkeypatch.setattr(ngram_join, "LONGEST", 3)
    assert result(ngram_join.jaccard_join(spark.createDataFrame(rows, DOCS).repartition(3), 3, 90)) == expected(rows, 3, 90)


@pytest.mark.parametrize("longest", [3, 1000])
def test_shared_entries_of_sorted_batches(monkeypatch, longest):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "LONGEST", longest)
    rnd = random.Random(longest)
    for _ in range(60):
        shingles = sorted(rnd.choice([1, 2, 2, 2, 3, 4, 5, 9, 9, rnd.randrange(60)]) for _ in range(rnd.randint(0, 40)))
        rows = list(enumerate(shingles))
        cuts = sorted(rnd.randint(0, len(rows)) for _ in range(rnd.randint(0, 6)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_pydict({"class": pa.array([r[0] for r in p], pa.int64()), "shingle": pa.array([r[1] for r in p], pa.int64())}) for p in parts]
        got = sorted((r["class"], r["shingle"], r["size"]) for b in ngram_join._shared(batches) for r in b.to_pylist())
        assert got == [(c, x, min(longest, n)) for c, x in rows if (n := shingles.count(x)) > 1]


@pytest.mark.parametrize("percent", [60, 80, 90, 99])
def test_linked_sizes_are_in_neighbouring_classes(percent):
    bounds = ngram_join.size_bounds(percent, 3000)
    of = lambda n: sum(b <= n for b in bounds)
    for n in range(1, 3000):
        assert of(n) - of(int(ngram_join.least_overlap(n, percent))) in (0, 1)


def test_merge_skip_counts_what_is_on_enough_lists():
    rnd = random.Random(4)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(30), rnd.randint(0, 12))) for _ in range(rnd.randint(1, 12))]
        least = rnd.randint(1, 6)
        want = [(e, n) for e in range(30) if (n := sum(e in x for x in lists)) >= least]
        assert ngram_join.merge_skip(lists, least) == want


def test_divide_skip_finds_every_set_that_shares_enough():
    rnd = random.Random(5)
    for _ in range(120):
        base = rnd.sample(range(400), rnd.randint(5, 60))
        sets = [np.array(sorted({x if rnd.random() > 0.06 else rnd.randrange(400) for x in base}), np.uint64) for _ in range(rnd.randint(2, 25))]
        sizes = np.array([len(s) for s in sets])
        percent = rnd.choice([60, 80, 90, 95])
        for k, q in enumerate(sets):
            lists = [x for v in q if len(x := np.array([i for i, s in enumerate(sets) if v in s])) > 1]
            want = [i for i, s in enumerate(sets) if i != k and 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
            got = [i for i in ngram_join.divide_skip(len(q), lists, sizes, percent).tolist() if i != k]
            assert sorted(got) == want


def test_empty_table_clashing_columns_and_long_texts(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", 7, b"x"), (2, "A b c\td e f", 8, b"y"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep long, fp binary")
    assert result(ngram_join.jaccard_join(df, 3, 90)) == [(1, 4, 1), (2, 4, 1), (3, 0, 3)]
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[900:])), (3, " ".join(words[9000:]))]
    assert [r[2] for r in result(ngram_join.jaccard_join(spark.createDataFrame(rows, DOCS), 3, 90))] == [1, 1, 3]


def test_percent_out_of_range_fails(spark):
    with pytest.raises(ValueError):
        ngram_join.jaccard_join(spark.createDataFrame([], DOCS), 3, 50)
