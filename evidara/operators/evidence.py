"""The unified evidence relation and what works on citations: lookup, dirty documents, media hints, live merge, purge."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import citation_keys
from .lexical import with_fallback
from .windows import first_by


def unified(families: Sequence[tuple[str, int, DataFrame]], columns: Sequence[str] = ("citation", "actor", "content")) -> DataFrame:
    """All families (name, priority, rows with these columns), each citation once, from the family of the lowest priority."""
    parts = [df.select(*columns, F.lit(name).alias("family"), F.lit(priority).alias("priority")) for name, priority, df in families]
    return first_by(reduce(lambda a, b: a.unionByName(b), parts), ["citation"], F.asc("priority"), F.asc("family"))


def lookup(families: Mapping[str, Sequence[Callable[[list[tuple[int, ...]]], tuple[str, int, DataFrame]]]], citations: Sequence[str]) -> DataFrame:
    """Rows of a stated list of citations: each family is asked for the numbers of its citations, which
    its scan can filter by, and only families that the list names are read."""
    keys = citation_keys(citations)
    parts = [of(keys[prefix]) for prefix, makers in families.items() if prefix in keys for of in makers]
    return unified(parts).filter(F.col("citation").isin(list(citations)))


def dirty_documents(chunks: DataFrame, dirty: DataFrame) -> DataFrame:
    """Chunks whose citation or parent is among dirty citations, each once: two semi-joins for an OR."""
    own = chunks.join(dirty.select("citation"), "citation", "left_semi")
    by_parent = chunks.join(dirty.select(F.col("citation").alias("parent")), "parent", "left_semi").select(*chunks.columns)
    return own.unionByName(by_parent).dropDuplicates(["citation"])


def media_hints(citations: DataFrame, media: DataFrame) -> DataFrame:
    """Media citations that hang on a citation: `x#image-…` and `x#video-…` belong to x and to chunks of x.

    The text range of such names is an equality on the part before the mark.
    """
    base = F.regexp_replace("citation", "#(chunk|image|video)-.*$", "")
    left = citations.select("citation", base.alias("parent")).distinct()
    right = media.filter(F.col("citation").rlike("#(image|video)-")).select(F.col("citation").alias("media"), base.alias("parent"))
    return left.join(right, "parent").select("citation", "media").distinct()


def merge_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """History (position, kind, text, direction, citation), and the live messages that it has not yet, as incoming ones.

    A live message is in the history if an incoming one stands at its place with its kind, or,
    of texts, with its text but for white space around it.
    """
    text = F.when(F.col("kind") == "text", F.trim(F.coalesce("text", F.lit("")))).otherwise("")
    kind = F.when(F.col("kind") == "text", "text").otherwise(F.col("kind"))
    known = history.filter("direction = 'incoming'").select("position", kind.alias("__kind"), text.alias("__text")).distinct()
    # a live text meets any text of its place, whatever kind it is noted under
    any_kind = history.filter("direction = 'incoming'").select("position", F.lit("text").alias("__kind"), F.trim(F.coalesce("text", F.lit(""))).alias("__text")).distinct()
    new = live.withColumn("__kind", kind).withColumn("__text", text).join(known.unionByName(any_kind).distinct(), ["position", "__kind", "__text"], "left_anti")
    columns = ["position", "kind", "text", "direction", "citation"]
    return history.select(*columns, F.lit(False).alias("live")).unionByName(new.withColumn("direction", F.lit("incoming")).select(*columns, F.lit(True).alias("live")))


def purged(tables: Mapping[str, DataFrame], excluded: DataFrame, keys: Mapping[str, str], parent: Mapping[str, tuple[str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without rows of excluded keys, children without rows of removed parents, and rows removed by table.

    excluded has one column of the top key; keys names each top table's column, parent each
    child's (parent table, column) in order of dependency.
    """
    top = excluded.columns[0]
    left: dict[str, DataFrame] = {}
    for name, column in keys.items():
        left[name] = tables[name].join(excluded.select(F.col(top).alias(column)), column, "left_anti")
    for name, (above, column) in parent.items():
        left[name] = tables[name].join(left[above].select(column).distinct(), column, "left_semi")
    counts = [tables[n].agg(F.count("*").alias("before")).join(left[n].agg(F.count("*").alias("after"))).select(F.lit(n).alias("table"), (F.col("before") - F.col("after")).alias("removed")) for n in left]
    return left, reduce(lambda a, b: a.unionByName(b), counts)


def keep_unless_new(old: Column, new: Column, replace: bool = False) -> Column:
    """The new text where there is one, else the old; with replace the new one in any case."""
    return new if replace else F.when(F.coalesce(F.length(F.trim(new)), F.lit(0)) > 0, new).otherwise(old)


def logical_key(*parts: Column) -> Column:
    """One key of normalised parts, nulls as empty, so that copies of a row from two sources are equal."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.lower(F.trim(p.cast("string"))), F.lit("")) for p in parts)), 256)


def plain(c: Column) -> Column:
    """Text as it is compared in logical keys: case-folded, white space collapsed, null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\s+", " ")))


#: Columns of the logical keys of each kind of evidence, besides its name; those of text are compared by plain().
KEYS = {
    "message": (("conversation_type", "conversation_title", "sender_name", "content_kind"), ("at", "shard", "local_id")),
    "moment": (("text",), ("author", "at")),
    "interaction": (("interaction_type",), ("author", "actor", "at")),
    "media": (("text", "modality"), ("author", "at", "position")),
}


def logical_key_of(kind: str) -> Column:
    """The key under which copies of one event from several imports are equal; content that parsers may improve is no part of a message's."""
    texts, exact = KEYS[kind]
    parts = [plain(F.col(c)) for c in texts] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in exact]
    return F.sha2(F.concat_ws("\u001f", F.lit(kind), *parts), 256)


def media_position(citation: Column) -> Column:
    """The part of a citation after its last #, which tells the media of one item apart."""
    return F.when(citation.contains("#"), F.substring_index(citation, "#", -1)).otherwise("")


def first_come(routes: Sequence[DataFrame], key: str, order: str, limit: int) -> DataFrame:
    """Rows of several queries in order of the queries, each key once, up to a limit."""
    parts = [r.withColumn("__query", F.lit(i)) for i, r in enumerate(routes)]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return first_by(u, [key], F.asc("__query"), F.asc(order)).orderBy("__query", order, key).limit(limit).drop("__query")


def content_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row that identifies the content of a table, whatever the order of its rows: sum and XOR of 60 bits of each row's MD5."""
    text = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))


def kind_of_packed(packed: Column, kinds: Mapping[int, str], default: str = "unknown") -> Column:
    """The kind named by the low 32 bits of a packed integer."""
    low = packed.bitwiseAND(F.lit(0xFFFFFFFF))
    out = F.lit(default)
    for code, name in kinds.items():
        out = F.when(low == code, name).otherwise(out)
    return out


def display_content(kind: Column, content: Column, placeholders: Mapping[str, str], size: int = 200) -> Column:
    """Text as it is, a placeholder for media, and other content cut to size."""
    out = F.substring(content, 1, size)
    for name, text in placeholders.items():
        out = F.when(kind == name, text).otherwise(out)
    return F.when(kind == "text", content).otherwise(out)


def episode_tail(changed: DataFrame, numbered: DataFrame, conversation: str, gone: DataFrame) -> DataFrame:
    """For each conversation with changes, from which row number its episodes must be made anew.

    changed and numbered hold (conversation, n), rows numbered from 1. A changed suffix without
    deletions needs only the episodes from three rows before it, at a multiple of three;
    anything else the whole conversation, from 0.
    """
    c = changed.groupBy(conversation).agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    last = numbered.groupBy(conversation).agg(F.max("n").alias("last"))
    g = gone.select(conversation, F.lit(True).alias("gone")).distinct()
    j = c.join(last, conversation).join(g, conversation, "left")
    suffix = (F.col("last") - F.col("first") + 1 == F.col("rows")) & F.col("gone").isNull()
    start = F.floor(F.greatest(F.col("first") - 1 - 3, F.lit(0)) / 3) * 3
    return j.select(conversation, F.when(suffix, start).otherwise(0).cast("long").alias("from_row"), suffix.alias("tail_only"))


def vector_documents(chunks: DataFrame, messages: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """Chunks, or messages where there is no chunk at all (citation, actor, content), with the text that is embedded;
    with dirty citations only those. Decided in the plan."""
    rows = with_fallback(chunks.select("citation", "actor", "content"), messages.select("citation", "actor", "content"))
    if dirty is not None:
        rows = rows.join(dirty.select("citation").distinct(), "citation", "left_semi")
    return rows.withColumn("vector_text", F.concat_ws("\n", F.concat(F.lit("by "), "actor"), "content"))


def priced(use: DataFrame, prices: Sequence[tuple[str, str, int]]) -> DataFrame:
    """calls, tokens, unpriced calls and cost by model of use (model, at, tokens), each at the price that held then.

    prices is a stated list (model, since, price of a token), so it may be broadcast; a price holds
    until the next one of its model. Use of a model without a price, or before its first one, counts
    as unpriced and costs nothing; a null model is one, and null tokens are none.
    """
    listed = []
    for model in sorted({m for m, _, _ in prices}):
        own = sorted((s, p) for m, s, p in prices if m == model)
        listed += [(model, s, own[i + 1][0] if i + 1 < len(own) else None, p) for i, (s, p) in enumerate(own)]
    p = use.sparkSession.createDataFrame(listed, "__model string, since string, until string, price long")
    p = p.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})
    holds = (F.col("model") == F.col("__model")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    j = use.join(F.broadcast(p), holds, "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return j.groupBy("model").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.count_if(F.col("price").isNull()).alias("unpriced"), F.coalesce(F.sum(tokens * F.col("price")), F.lit(0)).alias("cost"))
