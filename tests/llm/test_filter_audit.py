import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from evidara.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
NAMES = "ABCDE"


def failures(rows):
    """Which filters each row fails, from the rules."""
    out = []
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, _ in rows:
        t = t or ""
        words = [w for w in t.encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
        capitals = sum("A" <= c <= "Z" for c in t)
        out.append([len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first[t]])
    return out


def brute(rows, labels):
    """Every order played through, document by document."""
    fails = failures(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        removed_of = Counter()
        for order in permutations(range(5)):
            left = mine
            for step, k in enumerate(order):
                gone = [x for x in left if x[1][k]]
                kept = [x for x in left if not x[1][k]]
                removed_of[k] += len(gone)
                out[part, "".join(NAMES[j] for j in order), step + 1] = [
                    len(kept), len(gone), sum(f[k] for _, f in mine) - len(gone), sum(f[k] and sum(f) == 1 for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), k,
                ]
                left = kept
        for key, v in out.items():
            if key[0] == part:
                v[6] = removed_of[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def table(rnd, n):
    texts = [None, "", "short", "A B C", " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " | é", "x " * 300, "Shout " * 250, "\t".join(f"É{i}" for i in range(199)), "q\x0bw " * 120]
    texts += [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(150)) for _ in range(rnd.randint(150, 260))) + rnd.choice(["", "$", "\n"]) for _ in range(6)]
    rows = [(rnd.choice([None, *range(n // 2)]), rnd.choice(texts), rnd.choice([None, "", "a", "b", "ü"])) for _ in range(n)]
    labels = [(rnd.choice([None, *range(n // 2 + 5)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(n)]
    return rows + rows[:7], labels


def result(df):
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in filter_audit.MEASURES) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    """With nulls in any column, repeated rows and ids, several labels of an id, and columns of clashing names."""
    rows, labels = table(random.Random(seed), 60)
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], DOCS + ", mask int, part string, good boolean").repartition(3)
    got = result(filter_audit.order_table(filter_audit.counts_by_mask(docs, spark.createDataFrame(labels, LABELS))))
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.order_table(filter_audit.counts_by_mask(docs, labels)).count() == 0
    one = result(filter_audit.order_table(filter_audit.counts_by_mask(spark.createDataFrame([(1, None, None)], DOCS), labels)))
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and one["", "BCDEA", 5] == (0, 1, 0, 1, 0, 0, 120)


def test_subset_sums():
    rng = np.random.default_rng(3)
    for k in (1, 3, 5):
        counts = rng.integers(0, 9, (2, 3, 1 << k))
        z = filter_audit.subset_sums(counts)
        for x in range(1 << k):
            assert (z[..., x] == sum(counts[..., m] for m in range(1 << k) if m & ~x == 0)).all()


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", m, m + 1, 0, 1) for m in range(4)], "part string, mask int, n long, good long, toxic long")
    got = result(filter_audit.order_table(counts, "XY"))
    assert got["p", "XY", 1] == (4, 6, 0, 2, 0, 2, 8) and got["p", "XY", 2] == (1, 3, 4, 3, 0, 1, 10)
    assert len(got) == 4
    with pytest.raises(ValueError):
        filter_audit.order_table(counts, "ABCDEFGH")
