"""Personal data spans by weak supervision.

Four kinds have a fixed base (email, ip, card, phone), whose spans always stand. Other
candidates (spelled-out email addresses, national phone numbers, IBANs, social security
numbers, secrets after a key word, names after a title or a given name) are voted on by
labelers of three sorts: patterns and checksums, gazetteers, and words nearby. A labeler
votes for, against, or not. Expectation-maximisation over counts of vote patterns of all
candidates in the corpus estimates each labeler's reliability and the chance that a
candidate of each pattern is personal data; with these chances as soft labels, a
logistic classifier over the votes and the shape of the span is trained, and decides.
Counts of patterns go to the driver, never candidates; there are few patterns.

Spans are code points, end exclusive. Defined cases: null and empty texts have no spans;
spans of base kinds that overlap each other all stand, candidates that overlap a base
span or an earlier candidate fall away; repeated rows stay; a corpus without candidates
gives a classifier of the labelers' prior; null ids and other columns are not touched.
Spans are of any length, and time is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, materialize, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret", "name")
# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The same matches in linear time: a match of either begins with a run of digits and ends with one, so no digit is given back.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD_LINEAR = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
# Gazetteers and words of the context labelers.
GIVEN_NAMES = frozenset("anna maria john james mary robert michael david linda sarah thomas peter paul laura julia marie pierre jean claire sophie luc hans klaus stefan petra sabine jürgen carlos josé juan ana carmen lucia pablo miguel elena emma noah liam olivia".split())
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame mme señor señora sr sra".split())
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu co ch at it nl".split())
COUNTRIES = frozenset("AD AT BE CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
CUES = {
    "email": ("mail", "contact", "write", "reach", "address", "correo", "kontakt"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "anruf", "appel"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social", "security", "insurance", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "key", "credential", "bearer"),
    "name": ("name", "sign", "regards", "dear", "contact", "author", "nom", "nombre"),
}
AGAINST = ("version", "isbn", "issn", "page", "chapter", "figure", "example", "sample", "order", "model", "serial", "part", "checksum", "commit", "sha1", "md5")

_AT = re.compile(r"([A-Za-z0-9._%+-]{2,})\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?([A-Za-z0-9-]{2,}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z]{2,})+)")
_NATIONAL = re.compile(r"(?<![\w+.-])(?:\(\d{2,5}\)[ -]?\d{3,4}[ -]?\d{3,5}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_SECRET = re.compile(r"(?i:(token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|key|bearer))[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,})")
_BARE = re.compile(r"(?<![A-Za-z0-9_/+=-])(?:ghp_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16,}|sk-[A-Za-z0-9]{20,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,})")
_NAME = re.compile(r"(?<!\w)(?i:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? ([A-ZÀ-Þ][^\W\d_]++(?: [A-ZÀ-Þ][^\W\d_]++(?!\w))?)(?!\w)")
#: The word of every match of _AT; two capitalised words, of which the first may be a given name.
_AT_SIGN = re.compile(r"(?<=[\s(\[{])at(?=[\s)\]}])")
_GIVEN = re.compile(r"(?<!\w)([A-ZÀ-Þ][^\W\d_]++)(?= ([A-ZÀ-Þ][^\W\d_]++)(?!\w))")
_CAPITALISED, _AFTER = re.compile(r"[A-ZÀ-Þ][^\W\d_]++"), re.compile(r" ([A-ZÀ-Þ][^\W\d_]++)(?!\w)")
LABELERS = ("shape", "checksum", "gazetteer", "cue", "against", "mixed")
#: Shape features of the classifier, besides votes and kind.
SHAPES = ("long", "digits", "quoted")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string())])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As finditer of the email pattern, but led by the at signs, since a match begins with the run before one."""
    at, free = text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _EMAIL.match(text, a) if a < at else None
        if m:
            free = m.end()
            yield m.span()
        at = text.find("@", max(at + 1, free))


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """As finditer of the spelled-out pattern, but led by the word at, as _emails is by the sign."""
    free = 0
    for at in _AT_SIGN.finditer(text):
        b = at.start() - 1
        if b > free and text[b - 1].isspace():
            b -= 1
        a = b
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _AT.match(text, a) if a < b else None
        if m:
            free = m.end()
            yield m.span()


def _given(text: str) -> Iterator[tuple[int, int]]:
    """Spans of both groups of _GIVEN's matches with a given name, led by capital letters."""
    for m in _CAPITALISED.finditer(text):
        a = m.start()
        if m[0].lower() in GIVEN_NAMES and not (a and (text[a - 1].isalnum() or text[a - 1] == "_")):
            if after := _AFTER.match(text, m.end()):
                yield a, after.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _DOTTED.finditer(text) if "." in text else ():
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):  # four runs make a match, and the next begins after it
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, at + size))
            at += size + 1
    for m in _CARD_LINEAR.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _votes(kind: str, text: str, a: int, b: int) -> str:
    """One character for each labeler: + for, - against, 0 none; then the shape features."""
    span = text[a:b]
    near = text[max(0, a - 48) : a].lower() + " " + text[b : b + 24].lower()
    bare = re.sub(r"\W", "", span)
    v = dict.fromkeys(LABELERS, "0")
    if kind == "email":
        # a bare at, and a full stop before white space: more likely two sentences
        prose = re.search(r"\.\s", span) and not re.search(r"[(\[{]|\bdot\b", span)
        v["shape"] = "-" if prose else "+" if "(" in span or "[" in span or "{" in span else "0"
        v["gazetteer"] = "+" if re.split(r"\W+", span.lower())[-1] in TOP_DOMAINS or bare.lower().endswith(tuple(TOP_DOMAINS)) else "-"
        v["mixed"] = "-" if prose else "+"
    elif kind == "phone":
        v["shape"] = "+" if "(" in span or span.count("-") == 2 else "0"
        v["checksum"] = "-" if len(set(bare)) <= 2 else "+"
    elif kind == "iban":
        v["shape"] = "+" if 15 <= len(bare) <= 34 else "-"
        v["checksum"] = "+" if iban_ok(span) else "-"
        v["gazetteer"] = "+" if span[:2] in COUNTRIES else "-"
    elif kind == "ssn":
        area, group, serial = span.split("-")
        v["shape"] = "+"
        v["checksum"] = "-" if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else "+"
    elif kind == "secret":
        v["shape"] = "+" if re.fullmatch(r"[0-9a-fA-F]{20,}|[\w+/=.-]{16,}", span) else "-"
        v["mixed"] = "+" if len(set(span)) >= 10 and re.search(r"\d", span) and re.search(r"[A-Za-z]", span) else "-"
        v["gazetteer"] = "+" if span.startswith(("ghp_", "AKIA", "sk-", "eyJ")) else "0"
    elif kind == "name":
        first = span.split()[0].lower()
        before = re.findall(r"[^\W\d_]+", text[max(0, a - 14) : a].lower())
        v["gazetteer"] = "+" if first in GIVEN_NAMES else "-"
        v["mixed"] = "+" if before and before[-1] in TITLES else "0"
        v["shape"] = "+" if " " in span else "0"
    v["cue"] = "+" if any(c in near for c in CUES[kind]) else "-"
    v["against"] = "-" if any(c in near for c in AGAINST) else "0"
    shape = (len(bare) >= 16, sum(map(str.isdigit, bare)) * 2 > len(bare), a > 0 and text[a - 1] in "\"'")
    return "".join(v[x] for x in LABELERS) + "".join(map(str, map(int, shape)))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, votes) of spans that are no base spans."""
    raw: list[tuple[int, int, str]] = []
    low = text.lower()
    raw += [(*span, "email") for span in _spelled(text)]
    if any(map(low.__contains__, ("token", "secret", "passw", "pwd", "key", "bearer"))):
        raw += [(*m.span(2), "secret") for m in _SECRET.finditer(text)]
    if "ghp_" in text or "AKIA" in text or "sk-" in text or "eyJ" in text:
        raw += [(*m.span(), "secret") for m in _BARE.finditer(text)]
    if _HAS_DIGIT.search(text):
        raw += [(*m.span(), "iban") for m in _IBAN.finditer(text)]
        raw += [(*m.span(), "ssn") for m in _SSN.finditer(text)]
        raw += [(*m.span(), "phone") for m in _NATIONAL.finditer(text)]
    if any(f"{w} " in low or f"{w}. " in low for w in TITLES):
        raw += [(*m.span(1), "name") for m in _NAME.finditer(text)]
    raw += [(*span, "name") for span in _given(text)]
    if not raw:
        return []
    taken: list[list[int]] = []  # base spans, those that overlap as one
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, at, free = [], 0, 0
    for a, b, kind in sorted(raw):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= free and (at == len(taken) or b <= taken[at][0]):
            free = b
            out.append((kind, a, b, _votes(kind, text, a, b)))
    return out


_HAS_DIGIT = re.compile(r"\d{2}")


@dataclass
class Model:
    """Reliabilities by (kind, labeler): chances of a right vote, and the classifier's weights."""

    reliability: dict[tuple[str, str], tuple[float, float]]
    weights: dict[str, float]

    def chance(self, kind: str, votes: str) -> float:
        z = sum(self.weights.get(f, 0.0) for f in _features(kind, votes))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(kind: str, votes: str) -> list[str]:
    n = len(LABELERS)
    out = ["bias", f"kind={kind}"]
    out += [f"{x}{v}" for x, v in zip(LABELERS, votes) if v != "0"]
    return out + [f"{x}" for x, v in zip(SHAPES, votes[n:]) if v == "1"]


def learn(patterns: dict[tuple[str, str], int], rounds: int = 50) -> Model:
    """EM over counts of (kind, votes), then the classifier on its chances.

    Each kind has its own share of true spans; each labeler, of each kind, a chance to vote
    for a true span and one to vote for a false one, both from a weak prior.
    """
    n = len(LABELERS)
    share = dict.fromkeys(KINDS, 0.6)
    rate = {(k, x): (0.75, 0.3) for k in KINDS for x in LABELERS}

    def chance(kind: str, votes: str) -> float:
        yes, no = math.log(share[kind]), math.log(1 - share[kind])
        for x, v in zip(LABELERS, votes):
            p, q = rate[kind, x]
            if v != "0":
                yes += math.log(p if v == "+" else 1 - p)
                no += math.log(q if v == "+" else 1 - q)
        return 1 / (1 + math.exp(max(-30.0, min(30.0, no - yes))))

    for _ in range(rounds):
        soft = {key: chance(*key) for key in patterns}
        for kind in KINDS:
            rows = [(v, c, soft[k, v]) for (k, v), c in patterns.items() if k == kind]
            total = sum(c for _, c, _ in rows)
            share[kind] = min(0.98, max(0.05, (6 + sum(c * s for _, c, s in rows)) / (10 + total)))
            for i, x in enumerate(LABELERS):
                votes = [(v[i], c, s) for v, c, s in rows if v[i] != "0"]
                good, bad = sum(c * s for _, c, s in votes), sum(c * (1 - s) for _, c, s in votes)
                p = (15 + sum(c * s for v, c, s in votes if v == "+")) / (20 + good)
                q = (6 + sum(c * (1 - s) for v, c, s in votes if v == "+")) / (20 + bad)
                p, q = min(0.98, max(0.5, p)), min(0.5, max(0.02, q))  # no labeler is worse than chance
                rate[kind, x] = (p, q)
    # The classifier also sees every pattern of two votes or fewer once, so unseen patterns follow the labelers.
    rows = [(k, v, math.sqrt(c), chance(k, v)) for (k, v), c in patterns.items()]
    blank = "0" * n
    for k in KINDS[0:1] + KINDS[3:]:
        for i in range(n):
            for v in "+-":
                one = blank[:i] + v + blank[i + 1 :]
                rows.append((k, one + "000", 0.5, chance(k, one)))
                rows += [(k, one[:j] + w + one[j + 1 :] + "000", 0.5, chance(k, one[:j] + w + one[j + 1 :])) for j in range(i) for w in "+-"]
    names = sorted({f for k, v, _, _ in rows for f in _features(k, v)})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (k, v, _, _) in enumerate(rows):
        x[i, [at[f] for f in _features(k, v)]] = 1
    y, c = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    w = np.zeros(len(names))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (c * (y - p)) - 0.3 * w)
    return Model(rate, dict(zip(names, map(float, w))))


_FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int,votes:string>>"


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of docs (doc_id, text): base spans, whose votes are null, and candidates."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN))])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", lambda: None)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = candidates(text, base) if text else []
                out.append([dict(zip(("kind", "start", "end", "votes"), (*s, None)[:4])) for s in (*base, *more)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(SPAN))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, _FOUND)


def fit(found: DataFrame) -> Model:
    """A model of find_candidates' rows. Counts of (kind, votes) are bounded by the number of patterns."""
    span = found.select(F.explode("spans").alias("s")).filter("s.votes is not null")
    return learn({(r["kind"], r["votes"]): r["n"] for r in span.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()})


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def digest(found: DataFrame, model: Model) -> DataFrame:
    """Counts and hash of base spans, the string of all accepted spans and whether there is one, for each row of found."""
    sent = found.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.bool_())]
    schema = pa.schema(fields)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for spans in batch.column("spans").to_pylist():
                base = [(s["kind"], s["start"], s["end"]) for s in spans if s["votes"] is None]
                more = [(s["kind"], s["start"], s["end"]) for s in spans if s["votes"] is not None and sent.value.chance(s["kind"], s["votes"]) >= 0.5]
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), bool(base or more)))
            columns = list(zip(*rows)) if rows else [[]] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return found.mapInArrow(apply, "doc_id long, " + "".join(f"n_{k} long, " for k in BASE_KINDS) + "base_sha256 string, spans string, found boolean")


def find(docs: DataFrame) -> DataFrame:
    """digest of docs (doc_id, text) with a model of all of them; texts are read once."""
    found = materialize(find_candidates(docs), "spans")
    return digest(found, fit(found))


def redacted(text: str, model: Model) -> str:
    """The text with each span replaced by its kind in brackets."""
    base = base_spans(text)
    spans = base + [(k, a, b) for k, a, b, v in candidates(text, base) if model.chance(k, v) >= 0.5]
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with personal data replaced in text, and n_chars, where there is one, counted anew."""
    model = fit(find_candidates(docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", lambda: None)
        for batch in slices(batches):
            texts = pa.array([redacted(t, sent.value) if t else t for t in batch.column("text").to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    out = docs.mapInArrow(apply, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out
