"""Line-first cleaning: rules for each line, then a verdict on what is left.

A line fails if it lacks an end mark (punctuation), is made of separators (navigation),
is a short line with a stock phrase (boilerplate), or is mostly symbols, capitals or one
word repeated. Failing lines go; a document is rejected if less than a share of its words
is left.

Words are runs of bytes other than space and \\x09-\\x0D. Defined cases: null, empty and
blank texts have counts of 0 and fail the base rules; repeated rows stay; texts of any
length are read whole; ids, null ones too, and other columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Characters and phrases of the rules.
SYMBOLS = b"#*$%&|<>"
END_MARKS = ".!?…\"'»”’):;"
SEPARATORS = {"|", ">", ">>", "»", "›", "·", "•", "/", "::", "-", "–"}
BOILERPLATE = (
    "all rights reserved", "click here", "read more", "sign in", "sign up", "log in", "privacy policy",
    "terms of use", "terms of service", "cookie", "javascript", "subscribe to", "follow us", "share this",
    "lorem ipsum", "skip to content", "back to top", "powered by", "copyright ©",
)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blank = len(data) - sum(map(len, words))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    threes = list(zip(words, words[1:], words[2:]))
    if len(set(threes)) < len(threes):
        times, reached = Counter(threes), 0
        for i, w in enumerate(threes):
            if times[w] > 1:
                repeated += i + 3 - max(i, reached)
                reached = i + 3
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeated


def _has_stock_phrase(line: str) -> bool:
    return any(p in line for p in BOILERPLATE)


def line_fault(line: str, words: list[str]) -> str | None:
    """The rule that a line with words fails."""
    n = len(words)
    marks = sum(w in SEPARATORS for w in words)
    if marks >= 3 and 5 * marks >= n or marks and marks * 2 >= n:
        return "navigation"
    if n <= 25 and _has_stock_phrase(line.lower()):
        return "boilerplate"
    symbols = sum(map(line.count, "#*$%&|<>"))
    if symbols * 2 > n:
        return "symbols"
    if n >= 4:
        if line.upper() == line and line.lower() != line:
            return "capitals"
        if n >= 8 and 2 * sum(map(str.__eq__, words, words[1:])) > n:
            return "repetition"
    if line.rstrip()[-1] not in END_MARKS:
        return "punctuation"
    return None


def clean_lines(text: str | None) -> tuple[str, int, int, dict[str, int]]:
    """The text without failing lines, words before and after, and failing lines by rule."""
    kept, before, after, faults = [], 0, 0, {}
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            kept.append(line)
            continue
        before += len(words)
        fault = line_fault(line, words)
        if fault:
            faults[fault] = faults.get(fault, 0) + 1
        else:
            kept.append(line)
            after += len(words)
    return "\n".join(kept), before, after, faults


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def assess(docs: DataFrame, min_left: float = 0.5, with_text: bool = True) -> DataFrame:
    """doc_id, the counts, base_failed, kept, n_words_left, failed_lines (by rule), and with_text
    clean_text, for each row of docs (doc_id, text)."""
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_words_left", pa.int64()), ("failed_lines", pa.map_(pa.string(), pa.int64()))]
    schema = pa.schema(fields + [("clean_text", pa.string())] * with_text)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                counts = base_counts(text)
                clean, before, after, faults = clean_lines(text)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                rows.append((*counts, failed, not failed and after >= min_left * before, after, list(faults.items()), clean))
            columns = list(zip(*rows))[: len(schema) - 1] if rows else [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    kinds = "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean, n_words_left long, failed_lines map<string,long>" + ", clean_text string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, kinds)
