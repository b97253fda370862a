"""Timeline items of exports: their XML form, and copies of one item under several feed keys."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.slices import sliced

_BLANK = re.compile(r"\s+")
#: The most bytes of an item, as the format has them.
_MAX_ITEM = 256 * 1024


def parse_timeline(xml: str | None) -> tuple[str, str | None, str | None, int | None, str | None, str | None, list[str]]:
    """(status, id, author, time in seconds, text, link, keys of the feed) of an item; declarations of entities and too long ones are rejected."""
    from xml.etree import ElementTree

    none = (None, None, None, None, None, [])
    if xml is None or not xml.strip():
        return ("empty", *none)
    if len(xml.encode("utf-8", "surrogatepass")) > _MAX_ITEM or "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        return ("rejected", *none)
    try:
        root = ElementTree.fromstring(xml.strip())
    except ElementTree.ParseError:
        return ("malformed", *none)
    item = root if root.tag == "TimelineObject" else root.find(".//TimelineObject")
    if item is None or not (item.findtext("id") or "").strip():
        return ("unsupported", *none)
    field = lambda name: _BLANK.sub(" ", item.findtext(name) or "").strip()
    at = field("createTime")
    keys = [k.text.strip() for k in item.iter("feedKey") if k.text and k.text.strip()]
    return "parsed", field("id"), field("username"), int(at) if at.isdigit() and len(at) < 18 else None, field("contentDesc"), field("ContentObject/contentUrl") or None, keys


ITEM = {n: (pa.string(), StringType()) for n in ("status", "id", "author", "at", "text", "link")} | {"at": (pa.int64(), LongType()), "keys": (pa.list_(pa.string()), ArrayType(StringType()))}
parsed_timeline = sliced(parse_timeline, pa.struct([(n, a) for n, (a, _) in ITEM.items()]), StructType([StructField(n, s) for n, (_, s) in ITEM.items()]), list(ITEM))


def one_of_each(items: DataFrame, order: str) -> DataFrame:
    """Parsed items (id, author, at, text, link, keys), each id once: the copy of the latest time, then of the
    longest text, then the last in order; with the keys of all copies, sorted, and how many copies there were."""
    best = F.max(F.struct(F.coalesce("at", F.lit(-1).cast("long")).alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("n"), F.col(order).alias("o"), "author", "at", "text", "link"))
    g = items.groupBy("id").agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("keys"), F.count("*").alias("copies"))
    return g.select("id", "b.author", "b.at", "b.text", "b.link", "keys", "copies")


def with_items(interactions: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Interactions (key of a feed), all of them, with the id of their item, null and orphan where none has the key."""
    by_key = items.select(F.col("id").alias("item_id"), F.explode("keys").alias(key)).groupBy(key).agg(F.min("item_id").alias("item_id"))
    return interactions.join(by_key, key, "left").withColumn("orphan", F.col("item_id").isNull())


def bare_citation(c: Column) -> Column:
    """The citation of an item, from that of one of its media."""
    return F.regexp_replace(c, "#(media|image|video)-.*$", "")
