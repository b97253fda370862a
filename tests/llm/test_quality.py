import random
import re

from evidara.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, t in enumerate(threes) if threes.count(t) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def texts():
    rnd = random.Random(4)
    out = [None, "", " \n\t", "a", "a a a", "a a a a", "é\xa0b\x1cc d", "x\n x\nx\n\n\nx", "1 2 3 1 2 3 4 1 2 3", "#*$%&|<> | #"]
    return out + ["".join(rnd.choice(["a ", "b ", "é ", "a\n", "b|\n", "\t"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]


def test_counts_equal_brute_force():
    for t in texts():
        assert quality.base_counts(t) == brute(t), t


def test_rules():
    fault = lambda x: quality.line_fault(x, x.split())
    assert fault("A plain line of words, with an end.") is None
    assert fault("Home | News | Contact | About") == "navigation"
    assert fault("Read more about this.") == "boilerplate"
    assert fault("of%%% the*** and&&& or###") == "symbols"
    assert fault("ALL OF THIS IS LOUD.") == "capitals"
    assert fault("for for for for for for for for for.") == "repetition"
    assert fault("no end mark here") == "punctuation"


def test_verdicts(spark):
    clean = "".join(" ".join(f"word{i}{k}" for k in "abcdefgh") + ".\n" for i in range(12))  # no three words twice
    rows = [(1, clean + "Home | News\n"), (2, "a | b | c | d\n" * 2 + clean[:60] + "x | y | z | w | v | u | t\n" * 9), (3, "short."), (4, None), (None, clean), (1, clean)]
    df = spark.createDataFrame([(*r, True, 5) for r in rows], "doc_id long, text string, kept boolean, n_words int")
    out = quality.assess(df).collect()
    assert sorted(((r.doc_id, r.base_failed, r.kept) for r in out), key=str) == sorted([(1, False, True), (2, True, False), (3, True, False), (4, True, False), (None, False, True), (1, False, True)], key=str)
    assert next(r for r in out if r.doc_id == 1 and r.failed_lines).clean_text == clean
    assert quality.assess(df.limit(0)).count() == 0
