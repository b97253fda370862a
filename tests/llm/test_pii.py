import hashlib
import random
import re
import time

from evidara.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            s = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, d[::-1])))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and s % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def texts(n=1500):
    rnd = random.Random(8)
    bits = ["a.b", "@", "x-y.com", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", " ", "é", "%", "_", "a@b@c.de", "x@a.b.c%d@e.f", "(", "-", "٣"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def test_base_equals_finditer():
    for t in texts():
        assert pii.base_spans(t) == brute(t), t


def test_base_of_long_runs_takes_linear_time():
    digits = "7" * 1_000_000
    for t in (digits, "1." * 400_000, "1.2.3." * 100_000 + digits, "@" * 300_000, "a" * 600_000 + "@" + "b" * 600_000, "+" + "1(" * 300_000, "1-" * 300_000 + " x"):
        began = time.perf_counter()
        pii.base_spans(t)
        assert time.perf_counter() - began < 3, t[:20]
    began = time.perf_counter()
    assert pii.base_spans(digits) == []
    assert time.perf_counter() - began < 1


def test_candidates_of_long_runs_take_linear_time():
    for t in ("token=" + "aB3$" * 250_000, "x at " * 150_000, "Anna B" * 150_000, "Mr. " * 200_000 + "A" + "b" * 400_000 + "_", "key" * 300_000, "eyJ" + "a-" * 300_000, "1.2.3.4 " * 60_000 + "555-123-4567 " * 60_000):
        began = time.perf_counter()
        pii.candidates(t, pii.base_spans(t))
        assert time.perf_counter() - began < 6, t[:20]


def test_long_secrets_go_whole(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFG0123456789") for _ in range(10_000))
    rows = [(i, f"the password = {long[: 300 + i]} stays secret") for i in range(60)] + [(99, f"token: {long} end"), (100, "AKIA" + "B7" * 40)]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[99] == "token: [SECRET] end" and out[100] == "[SECRET]"
    assert all(out[i] == "the password = [SECRET] stays secret" for i in range(60))


def accepted(raw, base):
    """By every pair: in order, what overlaps neither a base span nor one accepted before it."""
    out = []
    for a, b, kind in sorted(raw):
        if all(b <= x or y <= a for _, x, y in base) and all(b <= y[1] or y[2] <= a for y in out):
            out.append((kind, a, b))
    return out


def test_candidates_equal_every_pattern_and_pair():
    """Added spans by the ungated patterns over the whole text, and by comparing all pairs."""
    rnd = random.Random(9)
    bits = ["token=", "key: ", "aB3dE6gH9", "Mr. ", "Anna Miller", "Peter ", "Schmidt", " at ", "mail.com", "(dot)", "DE89 3704 0044 0532 0130 00", "123-45-6789", "(555) 123-4567", "555-123-4567", "ghp_" + "a1B2" * 6, " ", "\n", ".", "é", "1.2.3.4", "x@y.de", "+1 555 1234567", "'", '"']
    found = 0
    for _ in range(4000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14)))
        raw = [(*m.span(), "email") for m in pii._AT.finditer(t)]
        raw += [(*m.span(2), "secret") for m in pii._SECRET.finditer(t)] + [(*m.span(), "secret") for m in pii._BARE.finditer(t)]
        raw += [(*m.span(), "iban") for m in pii._IBAN.finditer(t)] + [(*m.span(), "ssn") for m in pii._SSN.finditer(t)] + [(*m.span(), "phone") for m in pii._NATIONAL.finditer(t)]
        raw += [(*m.span(1), "name") for m in pii._NAME.finditer(t)] + [(m.start(1), m.end(2), "name") for m in pii._GIVEN.finditer(t) if m[1].lower() in pii.GIVEN_NAMES]
        base = pii.base_spans(t)
        want = accepted(raw, base)
        assert [c[:3] for c in pii.candidates(t, base)] == want, t
        found += len(want)
    assert found > 3000


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.iban_ok("DE89 3704 0044 0532 0130 00") and not pii.iban_ok("DE89 3704 0044 0532 0130 01")


def corpus():
    rnd = random.Random(2)
    hexed = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(32))
    rows = []
    for i in range(400):
        kind = rnd.choice(["secret", "fake", "iban", "at", "name", "phone", "none"])
        text = {
            "secret": f'the of token = "{hexed()}" and on',
            "fake": "version key: aaaaaaaaaaaa end",
            "iban": "bank account DE89 3704 0044 0532 0130 00 end",
            "at": "mail me: john.doe (at) mail dot com now",
            "name": "Dear Mr. Peter Miller, hello",
            "phone": "call (555) 123-4567 today",
            "none": "plain words é of no note",
        }[kind]
        rows.append((i, text))
    return rows


def test_em_keeps_true_and_drops_false(spark):
    rows = corpus() + [(900, None), (901, ""), (None, "x a@b.de"), (902, "twice +1 (555) 123-4567 4111111111111111"), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.find(df).collect()
    assert len(out) == len(rows)
    text_of = dict(rows[:400])
    for r in out:
        if r.doc_id is None or r.doc_id >= 400:
            continue
        spans = [s.split(":") for s in r.spans.split(",") if s]
        t = text_of[r.doc_id]
        want = {"toke": "secret", "bank": "iban", "mail": "email", "Dear": "name", "call": "phone"}.get(next((w for w in ("toke", "bank", "mail", "Dear", "call") if w in t), ""), None)
        assert [s[0] for s in spans] == ([want] if want else []), (t, r.spans)
    one = next(r for r in out if r.doc_id is None)
    assert (one.n_email, one.spans) == (1, "email:2:8")
    assert all(r.found == bool(r.spans) for r in out)
    assert one.base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert next(r.spans for r in out if r.doc_id == 902) == "phone:9:23"  # the base patterns take too many digits and fail
    none = next(r for r in out if r.doc_id == 900)
    assert (none.spans, none.base_sha256) == ("", hashlib.sha256(b"").hexdigest())


def test_redaction_keeps_columns_and_other_text(spark):
    rows = [(i, t, len(t), "z") for i, t in corpus()] + [(700, None, None, "z"), (701, "mail a.b@c.de or 1.2.3.4", 24, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert out[701].text == "mail [EMAIL] or [IP]" and out[701].n_chars == len("mail [EMAIL] or [IP]")
    assert out[700].text is None and out[700].n_chars is None
    plain = [i for i, t in corpus() if t.startswith("plain")]
    assert all(out[i].text == dict(corpus())[i] for i in plain)
    assert pii.redact(df.limit(0)).count() == 0
    assert pii.find(df.limit(0)).count() == 0


def test_spelled_addresses_equal_the_pattern():
    rnd = random.Random(3)
    bits = ["john", "j.d", "a", " ", " ", "  ", "\n", "at", " at ", "(at)", "[at]", "{at}", "mail", ".", " . ", " dot ", "(dot)", "[dot]", "com", "é", "x" * 70, "@", "9"]
    some = ["contact john at mail.com", "john at mail [dot] com", *("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(30000))]
    found = 0
    for t in some:
        want = [m.span() for m in pii._AT.finditer(t)]
        assert list(pii._spelled(t)) == want, t
        assert bool(want) <= any(kind == "email" for kind, *_ in pii.candidates(t, [])), t
        found += len(want)
    assert found > 200


def test_spelled_addresses_and_names_without_other_hints(spark):
    rows = [(i, t) for i, t in enumerate(["please contact john at mail.com today", "please contact john at mail [dot] com today", "we met Peter Miller there", "she looked at home. It was late", "he arrived at noon. Then he left"] * 40)]
    out = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = {0: "email:15:31", 1: "email:15:37", 2: "name:7:19"}.get(i % 5, "")
        assert out[i] == want, (t, out[i])
    assert pii.candidates("Dear Peter Miller", [])[0][:3] == ("name", 5, 17)
