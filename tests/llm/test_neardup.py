import random

import numpy as np
import pytest

from evidara.llm import neardup

DOCS = "doc_id long, text string"


def brute(rows, width=5, percent=80):
    """Union-find over all pairs of full shingle sets."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(low).encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    key = lambda r: (r[0] is None, r)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)), key=lambda r: (r[0] is None, r[0] or 0, r[1])), key


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "the", "or", "IN", "é", "st"]) for _ in range(rnd.randint(1, 4)))
    rows, bases = [], [[word() for _ in range(rnd.randint(6, 120))] for _ in range(12)]
    for i in range(150):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return [*rows, (200, None), (201, ""), (202, " \n"), (203, "two words"), (204, "TWO  words"), (204, "TWO  words"), (205, "é"), (None, "two words"), (206, " ".join(bases[0]) * 40)]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force(spark, width):
    rows = corpus(width)
    assert result(neardup.near_duplicates(spark.createDataFrame(rows, DOCS), width)) == brute(rows, width)[0]


def test_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(neardup, "GROUP_BLOCK", 200)
    assert result(neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 4)) == brute(rows, 4)[0]


IDS = [
    [(3, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (7, "g h i j k l")],
    [(3, "a b c d e f"), (7, "a b c d e f"), (7, "g h i j k l")],
    [(3, "a b c d e f"), (5, None), (5, "a b c d e f"), (9, None), (9, ""), (5, " ")],
    [(5, "a b c d e f"), (5, "g h i j k l"), (4, "g h i j k l"), (8, "m n o p"), (8, "m n o p")],
    [(5, "a b c d e f"), (6, "g h i j k l"), (6, "a b c d e f"), (2, "g h i j k l")],
]


def test_documents_with_one_id_share_their_links(spark):
    for rows in IDS:
        assert result(neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 4)) == brute(rows, 4)[0], rows
    got = result(neardup.near_duplicates(spark.createDataFrame(IDS[0], DOCS), 4))
    assert {r[2] for r in got} == {3}


def test_repeated_ids_with_unlike_texts_equal_brute_force(spark):
    for seed in (5, 6):
        rnd = random.Random(seed)
        rows = [(i if i is None else rnd.randrange(110) if rnd.random() < 0.4 else i, t) for i, t in corpus(seed)]
        assert result(neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 4)) == brute(rows, 4)[0]


def test_dropping_loses_no_text(spark):
    kept = lambda rows: sorted(map(tuple, neardup.drop_near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect()), key=repr)
    assert kept(IDS[0]) == [(3, "a b c d e f"), (5, "g h i j k l")]
    assert kept(IDS[1]) == [(3, "a b c d e f"), (7, "g h i j k l")]
    assert kept(IDS[2]) == sorted([(3, "a b c d e f"), (5, None), (9, None), (9, ""), (5, " ")], key=repr)
    assert kept(IDS[3]) == sorted([(4, "g h i j k l"), (5, "a b c d e f"), (8, "m n o p"), (8, "m n o p")], key=repr)


def test_large_groups_meet_their_first_member_first(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(neardup, "GROUP_BLOCK", 400)
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(40)}" for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(5)}"
        rows.append((i, " ".join(w)))
    assert result(neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 4)) == brute(rows, 4)[0]


def test_running_out_of_rounds_fails(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        neardup.components(edges, max_rounds=1)


def test_empty_table_and_clashing_columns(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (3, None, None, None)]
    df = spark.createDataFrame(rows, DOCS + ", rep int, fp string")
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "u long, v long")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_sketch_counts_differences():
    rng = np.random.default_rng(5)
    bad = 0
    limit = neardup.sketch_limit(80)
    for _ in range(300):
        m = rng.integers(0, 1 << 63, neardup.SAMPLES, dtype=np.uint64)
        other = np.where(rng.random(neardup.SAMPLES) < 0.2, rng.integers(0, 1 << 63, neardup.SAMPLES, dtype=np.uint64), m)
        x = neardup.odd_sketch(m) ^ neardup.odd_sketch(other)
        bad += int(np.bitwise_count(x.view(np.uint64)).sum()) > limit
    assert bad == 0
    far = neardup.odd_sketch(rng.integers(0, 1 << 63, neardup.SAMPLES, dtype=np.uint64)) ^ neardup.odd_sketch(rng.integers(0, 1 << 63, neardup.SAMPLES, dtype=np.uint64))
    assert np.bitwise_count(far.view(np.uint64)).sum() > limit
