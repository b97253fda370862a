import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from evidara.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """Levels of a tree, and for each leaf its siblings by level: those before, those after."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            a = i // 3 * 3
            path.append((level[a:i], level[i + 1 : a + 3]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    order = sorted(rows, key=lambda r: (*key(r), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(order, key=key)]
    made = [tree([leaf(r) for r in g]) for g in groups]
    root, tops = tree([sub for sub, _ in made])
    out = []
    for g, (sub, paths), top in zip(groups, made, tops):
        for r, path in zip(g, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            value = leaf((*r[:4], r[4].replace("\n", "") if tampered and r[4] is not None else r[4]))
            for before, after in path + top:
                value = h(*before, value, *after)
            out.append((r[0], leaf(r), sub, root, h(*(x for before, after in path + top for x in before + after)), value, value == root))
    return sorted(out, key=repr)


def result(spark, rows, extra=False):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows] if extra else rows, DOCS + (", leaf int, claimed string" if extra else ""))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    m = merkle.build(merkle.document_leaves(df.repartition(3), tampered))
    return sorted((tuple(r) for r in merkle.proofs(m).collect()), key=repr), m


def table(rnd, n, sources):
    rows = []
    for _ in range(n):
        text = rnd.choice([None, "", "a\nb", "\n", "éß\n\n", "plain", "long " * 300])
        rows.append((rnd.choice([None, *range(n)]), rnd.choice(sources), rnd.choice([None, "en"]), rnd.choice([None, 0, 12]), text))
    return rows + rows[:5]


@pytest.mark.parametrize("n, sources, leaves", [(60, [None, "", "a", "b", "ü", "z"], 7), (200, ["hot"] * 9 + ["x", "y"], 11), (40, [f"s{i}" for i in range(60)], 3), (90, ["one"], 5), (30, ["a", "b"], 50_000)])
def test_equals_the_tree_made_by_hand(spark, monkeypatch, n, sources, leaves):
    """Nulls in any column, repeated rows and ids, sources of one row, and sources over many ranges."""
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    rows = table(random.Random(n), n, sources)
    assert result(spark, rows, extra=True)[0] == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_small_trees(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEAVES", 4)
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
    assert result(spark, rows)[0] == brute(rows)


def test_forests_are_a_monoid():
    rnd = random.Random(8)
    for _ in range(60):
        total = rnd.randint(1, 90)
        digests = [h(str(i)) for i in range(total)]
        cuts = sorted({0, total, *(rnd.randint(0, total) for _ in range(5))})
        totals = {0: total, merkle.TOP: 1}
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            _, open_ = merkle.settle(digests[a:b], a, total)
            parts.append(merkle.Forest({(0, *k): v for k, v in open_.items()}, {}))
        rnd.shuffle(parts)
        left = merkle.Forest({}, {})
        for p in parts:
            left = merkle.merge(left, p, totals)
        while len(parts) > 1:
            i = rnd.randrange(len(parts) - 1)
            parts[i : i + 2] = [merkle.merge(parts[i], parts[i + 1], totals)]
        right = merkle.merge(parts[0], merkle.Forest({}, {}), totals)
        assert left.unresolved == right.unresolved == {(merkle.TOP, 0, 0): tree(digests)[0]}


def test_what_ranges_send_grows_with_levels_only():
    for n in (3**8, 3**8 + 1):
        _, open_ = merkle.settle([h(str(i)) for i in range(1000, 5000)], 1000, n)
        assert len(open_) <= 4 * len(merkle.level_sizes(n))


def test_empty_table(spark):
    got, m = result(spark, [])
    assert got == [] and m.root is None


def test_rows_as_they_were_are_folded_too(spark):
    """Beside a manifest with another root, every row gives the root of its own siblings, and none is verified."""
    rows = [(i, "s" if i % 3 else "t", "en", 1, f"t{i}") for i in range(20)]
    m = result(spark, rows)[1]
    top = max(k for k in m.forest.unresolved if k[0] == merkle.TOP)
    other = m._replace(forest=m.forest._replace(unresolved={**m.forest.unresolved, top: h("x")}))
    got = merkle.proofs(other).collect()
    assert other.root == h("x") and {r.folded_root for r in got} == {m.root} and not any(r.verified for r in got)
