import random
import re

import pytest

from evidara.llm import decontam


def grams(text, w):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)}


def brute(docs, items, width=5, percent=80):
    out = []
    for d, text in docs:
        for i, item in set(items):
            n = len(re.findall(r"\w+", (item or "").lower()))
            if not n:
                continue
            s = grams(item, min(width, n))
            both = len(s & grams(text, min(width, n)))
            if 100 * both >= percent * len(s):
                out.append((d, i, len(s), both))
    return sorted(out, key=str)


def data(seed=2):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("the of and er tion ing on re é an".split()) + rnd.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 6, 20, 40])))) for i in range(25)]
    items += [(3, items[3][1]), (100, None), (101, "..."), (None, "one two three four five six")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rnd.randint(0, 400))]
        if rnd.random() < 0.6:
            part = rnd.choice(items)[1] or ""
            part = part.split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if part:
                    part[rnd.randrange(len(part))] = word()
            at = rnd.randint(0, len(w))
            w[at:at] = [p.upper() + rnd.choice(["", ",", "."]) for p in part]
        docs.append((d, " ".join(w)))
    return [*docs, (500, None), (501, ""), (None, items[6][1]), (1, docs[1][1])], items


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", block)
    docs, items = data()
    found = decontam.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found.collect()), key=str) == brute(docs, items)


def test_drops_only_contaminated(spark):
    docs, items = data(5)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    kept = decontam.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, *_ in brute(list(enumerate(t for _, t in docs)), items)}
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for k, (d, _) in enumerate(docs) if k not in bad), key=str)


def test_empty_sides(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.find_items(d.limit(0), i).count() == 0
    assert decontam.find_items(d, i.limit(0)).count() == 0
