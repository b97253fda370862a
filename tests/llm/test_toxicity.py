import math
import random
import zlib

from evidara.llm import toxicity


def corpus(n=900, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("ab ca de fi go lu me no ra".split()) for _ in range(rnd.randint(2, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(5, 80))]
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(["Idiot", "xarpent" + word(), "m0ron", "іdiot", "st@pid"[:2] + "upid"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_fold_keeps_length_and_maps():
    for t in ["ІDIОT m0r0n", "İdiot", "a@b $c s$um", None, "", "ｉｄｉｏｔ"]:
        assert len(toxicity.fold(t)) == len(t or "")
    assert toxicity.fold("іdі0t ST@R $5") == "idiot star $s"


def test_boundaries_and_exceptions():
    m = toxicity.Matcher(toxicity.Model({("clown", True): 2.0, ("ass", False): 1.0}))
    found = lambda t: [t[a:b] for a, b, _ in m.matches(toxicity.fold(t))]
    assert found("clowns, class pass ass. a clown fish; CLOWN") == ["clown", "ass", "CLOWN"]
    assert m.score("x " * 5 + "clown") > m.score("x " * 500 + "clown") > m.score("x") == m.score(None) == m.score("")


def by_hand(model, text):
    """Score by looking for every entry at every place."""
    t = toxicity.fold(text)
    letter = lambda i: 0 <= i < len(t) and t[i].isalpha()
    places = lambda p: [i for i in range(len(t)) if t.startswith(p, i) and not letter(i - 1)]
    shields = [(i, i + len(p)) for p in model.exceptions for i in places(p)]
    weights = [
        w for (term, start), w in model.weights.items() for i in places(term)
        if (start or not letter(i + len(term))) and not any(a <= i and i + len(term) <= b for a, b in shields)
    ]
    x = (0.0, 0.0, 0.0)
    if weights:
        total = math.fsum(weights)
        x = (max(weights), math.log1p(max(0.0, total)), math.log1p(max(0.0, 100 * total / max(1, len(t.split())))))
    z = model.coefficients[0] + sum(c * v for c, v in zip(model.coefficients[1:], x))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_scores_equal_brute_force():
    rnd = random.Random(12)
    bits = ["clown", "clowns", "a clown car", "ass", "pass", "cl0wn", "ｃlown", "trash can", "trash", "s$s", "аss", " ", ".", "-", "\n", "x", "İ", "idiotproof", "idiot-proof", "idiot"]
    model = toxicity.Model({("clown", True): 2.0, ("ass", False): 1.0, ("trash", True): 1.5, ("idiot", True): 0.7, ("idi", True): -0.4, ("lown", False): 3.0})
    matcher = toxicity.Matcher(model)
    for _ in range(3000):
        text = "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 12)))
        assert math.isclose(matcher.score(text), by_hand(model, text), rel_tol=1e-9), text


def test_terms_are_ranked_without_a_cap(spark):
    rows = [(f"w{i:05d}", False, 30 + i % 7, i % 3) for i in range(25_000)] + [("weak", False, 4, 4), ("rest", True, 900, 0)]
    df = spark.createDataFrame(rows, "term string, start boolean, bad long, good long")
    ranked = [tuple(r) for r in toxicity.ranked_terms(df, 1000, 1000).collect()]
    evidence = lambda t, c: (t * math.log(t / ((t + c) * 0.5)) if t else 0) + (c * math.log(c / ((t + c) * 0.5)) if c else 0)
    want = sorted(((round(evidence(t, c), 6), not s, len(w), w) for w, s, t, c in rows if evidence(t, c) > 16), reverse=True)
    assert [r[0] for r in ranked] == [x[3] for x in want] and len(want) > 20_000 and want[0][3] == "rest"


def test_repeated_ids_are_learned_from_once(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.fit(d.unionByName(d).unionByName(d), lab.unionByName(lab)) == toxicity.fit(d, lab)


def test_learns_and_holds_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(5000, None), (5001, ""), (None, "idiot")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (5001, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    assert any(t.startswith("xarp") for t, _ in model.weights)
    rows = toxicity.score(d, model).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs + [(5000, 0), (5001, 0)] if zlib.crc32(str(i).encode()) % 5 == 0}
    known = [r for r in held if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    flipped = spark.createDataFrame([(i, (1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    assert toxicity.fit(d, flipped) == model  # held-out labels are not read


def test_no_labels_empty_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "idiot", 1.0), (2, "fine words", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(d, none)
    scores = {r.doc_id: r.score for r in toxicity.score(d, model, spans=True).collect()}
    assert scores[1] > scores[2]
    assert toxicity.score(d.limit(0), model).count() == 0
    kept = toxicity.drop_toxic(d, none)
    assert kept.columns == d.columns
    assert [r.doc_id for r in kept.collect()] == [2]


def test_places_within_exceptions_equal_all_pairs():
    import random

    rnd = random.Random(3)
    for _ in range(400):
        places = [(a := rnd.randrange(40), a + rnd.randint(1, 6), 1.0) for _ in range(rnd.randint(0, 12))]
        shields = [(a := rnd.randrange(40), a + rnd.randint(1, 9)) for _ in range(rnd.randint(0, 8))]
        assert toxicity.outside(places, list(shields)) == [f for f in places if not any(a <= f[0] and f[1] <= b for a, b in shields)]


def test_a_long_text_of_exceptions_takes_time_in_proportion():
    import time

    model = toxicity.Model({("trash", True): 2.0}, ("trash can",))
    matcher, took = toxicity.Matcher(model), []
    for n in (50_000, 200_000):
        begun = time.process_time()
        assert matcher.matches("trash can " * n) == [] and matcher.features("trash can " * n + "trash")[0] == 2.0
        took.append(time.process_time() - begun)
    assert took[1] < 8 * took[0]
