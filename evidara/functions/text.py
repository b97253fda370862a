"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is collapsed: ASCII white space, no-break space and ideographic space.
BLANK = "[ \\t\\n\\r\\f\\x0B\\u00A0\\u3000]+"


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANK, " "))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen; `untitled` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) > 0, F.substring(s, 1, 80)).otherwise("untitled")


def bounded(c: Column, size: int) -> Column:
    """The normalised text, cut to size characters with an ellipsis."""
    t = normalize_text(c)
    return F.when(F.length(t) > size, F.concat(F.rtrim(F.substring(t, 1, size - 1)), F.lit("…"))).otherwise(t)


def contains_fold(c: Column, needle: str) -> Column:
    """Containment without regard to case; wildcards in the needle have no meaning."""
    return F.lower(c).contains(needle.lower())


def snippet(c: Column, needle: str, radius: int = 60) -> Column:
    """radius characters on either side of the first hit, with ellipses where text is cut; without a hit, the beginning."""
    at = F.locate(needle.lower(), F.lower(c))
    size = len(needle) + 2 * radius
    first = F.greatest(at - radius, F.lit(1))
    last = F.least(at + (len(needle) + radius - 1), F.length(c))
    cut = F.concat(F.when(first > 1, "…").otherwise(""), F.substring(c, first, last - first + 1), F.when(last < F.length(c), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(c, 1, min(120, size)))


def spanning(c: Column, phrase: str) -> Column:
    """Whether the words of a phrase follow one another in a text, with anything between, after white space is collapsed."""
    escaped = [w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for w in phrase.lower().split()]
    return F.lower(normalize_text(c)).like("%" + "%".join(escaped) + "%")


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping hits, without regard to case."""
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The value of the first rule that holds."""
    out = reduce(lambda w, r: w.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    return out.otherwise(default)


def keyword_labels(c: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """All labels of which a key word stands in the text, in order of the groups."""
    low = F.lower(c)
    hit = [F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(label)) for label, words in groups.items()]
    return F.array_compact(F.array(*hit))


def latin_tokens(c: Column) -> Column:
    """Distinct words of ASCII letters, digits and underscores, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), 0))


def compact(c: Column) -> Column:
    """The text without white space, ASCII punctuation and underscores, in lower case, as compared by containment."""
    return F.regexp_replace(F.lower(c), "[\\s!-/:-@\\[-`{-~]+", "")


def redact(c: Column) -> Column:
    """Email addresses, long tokens and absolute paths replaced by their kind."""
    c = F.regexp_replace(c, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "[email]")
    c = F.regexp_replace(c, "[0-9a-f]{24,}", "[token]")
    return F.regexp_replace(c, "(/[A-Za-z0-9._-]+){3,}", "[path]")


def stable_id(*parts: Column, size: int = 16) -> Column:
    """A prefix of the SHA-256 of the parts, joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, size)


def file_kind(name: Column, kinds: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    end = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    return first_match([(end.isin(*ends), kind) for kind, ends in kinds.items()], default)


#: The characters of Chinese text that tokenisers take for letters.
CJK = "\u4e00-\u9fff"


def safe_label(c: Column) -> Column:
    """A name that can be a file name: white space collapsed, runs of slashes and control characters as one
    hyphen, 80 characters; `untitled` if nothing is left."""
    s = F.substring(F.regexp_replace(normalize_text(F.coalesce(c, F.lit(""))), "[/\\\\\u0000-\u001f]+", "-"), 1, 80)
    return F.when(F.length(s) > 0, s).otherwise("untitled")


def page_slug(c: Column, default: str = "wiki-page") -> Column:
    """Letters and digits of ASCII, Chinese characters, underscores and hyphens; anything else as one hyphen."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), f"[^0-9A-Za-z{CJK}_-]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) > 0, F.substring(s, 1, 80)).otherwise(default)


def query_tokens(c: Column) -> Column:
    """Distinct words of ASCII letters, digits and underscores, and runs of Chinese characters, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+|[\u3400-\u9fff]+"), 0))


def shingle_tokens(c: Column) -> Column:
    """Distinct tokens to compare texts by, sorted: pairs of neighbouring Chinese characters (a lone one itself)
    and words of two characters or more."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"[a-z0-9_]+|[{CJK}]+"), 0)

    def of(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        chinese = t.rlike(f"^[{CJK}]")
        return F.when(F.length(t) >= 2, F.when(chinese, pairs).otherwise(F.array(t))).when(chinese, F.array(t)).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, of))))


def important_terms(query: str, dictionary: Sequence[str] = ()) -> list[str]:
    """Up to two terms of a query, of which the dictionary's come first, or three where it has none: words of three
    letters or more, runs of Chinese characters of two or more, of long ones the first, middle and last four."""
    import re

    terms = [t for t in dictionary if t in query.lower()]
    most = 2 if terms else 3
    for token in re.findall(rf"[A-Za-z][A-Za-z0-9_.-]{{2,}}|[{CJK}]{{2,}}", query):
        if len(token) > 4 and re.fullmatch(f"[{CJK}]+", token):
            mid = (len(token) - 4) // 2
            terms += [token[:4], token[mid : mid + 4], token[-4:]]
        else:
            terms.append(token)
    terms = list(dict.fromkeys(terms))
    if not terms and " " in query:
        terms = [t for t in query.lower().split() if len(t) >= 2]
    return terms[:most]


def interval_seconds(c: Column) -> Column:
    """Seconds of texts as 90, 90s, 60m, 1h, 2d; null where it is something else or less than a minute."""
    t = F.lower(F.trim(c))
    n, unit = F.regexp_extract(t, "^([0-9]{1,12})\\s*([smhd]?)$", 1).try_cast("long"), F.regexp_extract(t, "^([0-9]{1,12})\\s*([smhd]?)$", 2)
    seconds = n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(seconds >= 60, seconds)


def clock_minutes(c: Column) -> Column:
    """Minutes since midnight of texts as 7:05; null where it is no time of day."""
    t = F.trim(c)
    h, m = (F.regexp_extract(t, "^([0-9]{1,2}):([0-9]{2})$", i).try_cast("long") for i in (1, 2))
    return F.when((h <= 23) & (m <= 59), h * 60 + m)


def canonical_json(**fields: Column) -> Column:
    """An object with its keys sorted and without spaces; nulls are kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
