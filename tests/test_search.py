"""The search planner, its routes and fallbacks, and the kept trigram index."""

import random

import pytest
from pyspark.sql import functions as F

from evidara.operators.lexical_index import LexicalIndex, gram_codes, gram_rows, kept_index
from evidara.plans.search import Corpus, SearchRequest, fuse, plan, promoted, search, understand

EVIDENCE = "citation string, content string, title string, actor string, conversation string, at long, source_type string"


def corpus(spark, tmp_path, rows, name="index"):
    e = spark.createDataFrame(rows, EVIDENCE)
    index = LexicalIndex(spark, f"file://{tmp_path}/{name}", "citation", ["content", "title", "actor"])
    index.build(e)
    return Corpus(e, index)


def message(i, text, conversation="c", actor="ann", title="t"):
    return (f"m/{i}", text, title, actor, conversation, i, "message")


def cited(df):
    return [r.context_anchor for r in df.collect()]


def test_the_phrase_comes_first_and_no_citation_twice(spark, tmp_path):
    rows = [message(1, "alpha beta gamma"), message(2, "beta then alpha"), message(3, "nothing", title="alpha beta"), message(4, "alpha beta " * 400), ("d/9", "see alpha beta there", "t", "en", None, -1, "document")]
    c = corpus(spark, tmp_path, rows)
    got = cited(search(c, SearchRequest("alpha beta", limit=5)))
    assert len(set(got)) == len(got) and set(got) == {"m/1", "m/2", "m/3", "m/4", "d/9"} and got.index("m/1") < got.index("m/2")
    assert "m/3" not in cited(search(c, SearchRequest("alpha beta", filters={"title": "x"})))
    assert set(cited(search(c, SearchRequest("alpha beta", filters={"source_type": "document"})))) == {"d/9"}
    assert set(cited(search(c, SearchRequest("alpha beta", filters={"sender": "EN"})))) == {"d/9"}
    assert cited(search(c, SearchRequest("no such words"))) == []


def test_fallbacks_follow_one_another(spark, tmp_path):
    rows = [message(1, "alpha one beta"), message(2, "beta before alpha"), message(3, "neither"), message(4, "ok")]
    c = corpus(spark, tmp_path, rows)
    assert cited(search(c, SearchRequest("alpha beta")))[:1] == ["m/1"]  # words in order
    assert [r.context_anchor for r in search(c, SearchRequest("beta alpha one")).collect() if "exact" in r.paths] == ["m/1"]  # all terms
    assert cited(search(c, SearchRequest("ok"))) == ["m/4"]  # fewer than three characters: no index


def test_empty_evidence_and_empty_texts(spark, tmp_path):
    assert cited(search(corpus(spark, tmp_path, []), SearchRequest("alpha beta", multi_hop=True))) == []
    c = corpus(spark, tmp_path, [message(1, None), message(2, ""), message(3, "alpha", actor=None, title=None)], "other")
    assert cited(search(c, SearchRequest("alpha"))) == ["m/3"]


def test_vectors_are_asked_where_lexical_candidates_are_too_few(spark, tmp_path):
    c = corpus(spark, tmp_path, [message(i, f"word{i} alpha") for i in range(12)])
    v = spark.createDataFrame([(f"m/{i}#chunk-0", [float(i), 1.0]) for i in range(12)], "citation string, vector array<double>")
    q = spark.createDataFrame([([50.0, 1.0],)], "q array<double>")
    c = Corpus(c.evidence, c.index, "message", v, q)
    few, many = search(c, SearchRequest("word3", limit=3)), search(c, SearchRequest("alpha", limit=3))
    assert any("vector" in r.paths for r in few.collect()) and not any("vector" in r.paths for r in many.collect())
    assert not any("vector" in r.paths for r in search(c, SearchRequest("word3", limit=3, semantic="off")).collect())


def test_plan_rules():
    of = lambda q, vectors=True, **k: plan(SearchRequest(q, **k), understand(SearchRequest(q, **k)), vectors)
    p = of("price plan")
    assert (p.lexical_depth, p.vector_depth, p.fts_depth, p.rewrite, p.vector, p.skip_fts) == (30, 20, 30, False, None, False)
    assert p.fts_queries == ("price plan", "price", "plan")
    p = of("price of the plan", limit=20)
    assert (p.lexical_depth, p.vector_depth, p.fts_depth, p.rewrite, p.vector, p.fts_queries) == (10, 200, 6, True, True, ("price of the plan",))
    assert of("price", filters={"sender": "ann"}).rewrite and not of("price", filters={"sender": "ann"}, vectors=False).rewrite
    assert of("price", filters={"source_type": "document"}).vector is False and of("a b c d", filters={"source_type": "document"}).rewrite is False
    assert of("price", semantic="on").vector is True and of("price", semantic="off").vector is False and of("price").skip_fts
    assert of("how did it end").multi_hop and not of("how did it end", filters={"since": "2024"}).multi_hop
    with pytest.raises(ValueError):
        of("x", limit=51)


def test_understanding():
    u = understand(SearchRequest("price plan of a price"))
    assert u.terms == ("price", "plan", "of") and "cost" in u.expansions and u.intents == ("general_evidence",)
    assert u.queries[:3] == ["price plan of a price", "price plan of", "price"] and len(u.queries) <= 8
    u = understand(SearchRequest("什么价格"), {"commercial": ["价格"]})
    assert u.terms == ("什么价格",) and u.intents == ("commercial",)
    assert understand(SearchRequest("什么价格", dictionary=("价格",))).terms == ("价格",)


def test_fusion_on_parents_keeps_the_first_row(spark):
    rows = [("m/1", "m/1", 1, "exact", 0), ("m/1#chunk-2", "m/1", 1, "evidence", 1), ("m/2#chunk-0", "m/2", 2, "evidence", 1)]
    got = {r.key: (r.citation, r.paths, r.score) for r in fuse(spark.createDataFrame(rows, "citation string, key string, rank long, route string, turn int"), 10).collect()}
    assert got == {"m/1": ("m/1", ["evidence", "exact"], round(12 / 61, 9)), "m/2": ("m/2#chunk-0", ["evidence"], round(10 / 62, 9))}


def test_promotion(spark):
    schema = "key string, conversation string, at long, paths array<string>, place int"
    ctx = ["conversation-context"]
    order = lambda rows: [r.key for r in promoted(spark.createDataFrame(rows, schema)).orderBy("place").collect()]
    rows = [("a", "x", 5, ["exact"], 1), ("b", "c", 5, ["episode-evidence"], 2), ("d", "c", 7, ctx, 3), ("e", "c", 6, ctx, 4), ("f", "c", 1, ctx, 5), ("g", "y", 1, ctx, 6)]
    assert order(rows) == ["b", "f", "d", "a", "g", "e"]
    assert order(rows[:4]) == ["b", "d", "e", "a"]  # two of one side
    assert order(rows[:2] + rows[5:]) == ["a", "b", "g"]  # none to choose: the order stays


def brute(rows, phrase):
    grams = {phrase.lower()[i : i + 3] for i in range(len(phrase) - 2)}
    return {k for k, *texts in rows if all(any(g in (t or "").lower() for t in texts) for g in grams)}


def test_index_equals_brute_force_after_updates(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice(["ab", "é", "c", "𝒳", " ", "AB"]) for _ in range(rnd.randint(0, 30)))
    rows = {i: (i, text(), rnd.choice([None, "", text()])) for i in range(150)}
    df = lambda some: spark.createDataFrame(list(some), "id long, a string, b string")
    index = LexicalIndex(spark, f"file://{tmp_path}/kept", "id", ["a", "b"])
    index.build(df(rows.values()))

    def check():
        for phrase in ("abc", "cab", "é é", "𝒳𝒳c", "abab", "zzz", "ABAB "):
            assert {r.id for r in index.candidates(phrase).collect()} == brute(rows.values(), phrase), phrase
        live = {r.key: (r.len_a, r.len_b) for r in index.live().collect()}
        assert live == {k: (len(a or ""), len(b or "")) for k, a, b in rows.values()}

    check()
    for phrase in ("abc", "é é", "ab", "zzz", "𝒳𝒳c"):  # whatever it leaves out has no such phrase
        for share in (0.0, 0.2, 1.0):
            left = {r.id for r in index.narrowed(df(rows.values()), [phrase], share).collect()}
            assert {k for k, *ts in rows.values() if any(phrase in (t or "").lower() for t in ts)} <= left <= set(rows)
    assert index.frequencies(["abc"]) == {int(g): sum(any("abc" in (t or "").lower() for t in ts) for _, *ts in rows.values()) for g in gram_codes("abc")}
    changed = [(i, text(), "new") for i in rnd.sample(range(200), 40)]
    gone = rnd.sample([i for i in range(150) if i not in {c[0] for c in changed}], 20)
    index.update(df(changed), spark.createDataFrame([(i,) for i in gone], "id long"))
    rows |= {c[0]: c for c in changed}
    for i in gone:
        del rows[i]
    check()
    index.update(df([(5, "abc back", None)]))
    rows[5] = (5, "abc back", None)
    check()
    index.compact()
    assert len(index.segments()) == 1
    check()


def test_kept_index_is_made_once_for_the_same_files(spark, tmp_path):
    spark.createDataFrame([(1, "abcd"), (2, "xyz")], "id long, a string").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    one, two = kept_index("t", rows, "id", ["a"]), kept_index("t", rows, "id", ["a"])
    assert one.root == two.root and two.segments() == [1]
    spark.createDataFrame([(3, "abc")], "id long, a string").write.mode("append").parquet(f"{tmp_path}/t")
    three = kept_index("t", spark.read.parquet(f"{tmp_path}/t"), "id", ["a"])
    assert three.root != one.root and {r.id for r in three.candidates("abc").collect()} == {1, 3}
    with pytest.raises(ValueError):
        three.candidates("ab")
    assert three.live().agg(F.count("*")).first()[0] == 3


def test_chunks_are_those_of_the_rule(spark):
    from evidara.operators.lexical import fixed_chunks

    rnd = __import__("random").Random(2)
    texts = [None, "", "a", *("".join(rnd.choice("ab\n é😀") for _ in range(n)) for n in (119, 120, 779, 780, 781, 899, 900, 901, 1559, 1560, 1561, 1680, 1681, 5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {}
    for r in fixed_chunks(df, "i", "t").collect():
        got.setdefault(r.i, {})[r.chunk_index] = (r.chunk, r.citation)
    for i, t in enumerate(texts):
        n = max(1, -(-(len(t or "") - 120) // 780))
        assert got[i] == {k: (None if t is None else t[k * 780 : k * 780 + 900], f"{i}#chunk-{k}") for k in range(n)}, i


@pytest.mark.parametrize("letters", ["ab", "abcd é中🙂", "".join(map(chr, range(32, 0x11000, 2)))])
def test_grams_of_many_rows_are_those_of_each(letters):
    rnd = random.Random(4)
    letters = [c for c in letters if not 0xD800 <= ord(c) < 0xE000]
    rows = [[None if rnd.random() < 0.1 else "".join(rnd.choices(letters, k=rnd.choice([0, 1, 2, 3, 300]))) for _ in range(3)] for _ in range(400)]
    got = gram_rows(list(zip(*rows)))
    assert list(zip(*(x.tolist() for x in got))) == sorted({(int(g), i) for i, texts in enumerate(rows) for t in texts if t for g in gram_codes(t)})
