"""Entity resolution: scores of identifiers, candidates by stages, selection of a leader, merging of ids.

identifiers has (entity_id, kind, value, confidence), entities (entity_id, display_name,
confidence). Stages follow each other in one plan: where a stage has rows, those after it
give none, without a question to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .lexical import with_fallback

# Scores by kind of identifier for exact and partial hits, reasons, and the strength of reasons.
EXACT = {"user_id": 0.99, "remark": 0.97, "nickname": 0.94, "group_alias": 0.90, "alias": 0.88, "display_name": 0.88}
PARTIAL = {"user_id": 0.78, "display_name": 0.74}
PARTIAL_LOSS, PARTIAL_MOST = 0.2, 0.76
REASONS = {"user_id": "user_id_exact", "remark": "contact_remark_exact", "nickname": "contact_nickname_exact", "group_alias": "group_alias_exact"}
PARTIAL_REASONS = {"user_id": "user_id_partial", "display_name": "identifier_partial"}
PRIORITY = {"private_conversation_title_exact": 50, "user_id_exact": 45, "contact_remark_exact": 40, "contact_nickname_exact": 30, "group_alias_exact": 20, "identifier_exact": 10}

#: Lengths of the runs of characters that values are posted under.
RUNS = (1, 2, 3, 6, 12, 24)


def normalized(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " ")))


def _by_kind(values: Mapping[str, object], default: object) -> Column:
    return reduce(lambda out, kv: F.when(F.col("kind") == kv[0], F.lit(kv[1])).otherwise(out), values.items(), F.lit(default))


def partial_scores() -> dict[str, float]:
    return {k: PARTIAL.get(k, min(round(v - PARTIAL_LOSS, 6), PARTIAL_MOST)) for k, v in EXACT.items()}


def scored(identifiers: DataFrame, needle: str) -> DataFrame:
    """(entity_id, score, reasons) of entities with an identifier that is, or contains, the needle."""
    n = needle.strip().lower()
    v = normalized(F.col("value"))
    exact = v == n
    reason = _by_kind(REASONS, "identifier_exact")
    partial = F.coalesce(_by_kind(PARTIAL_REASONS, None), F.concat(reason, F.lit("_partial")))
    d = identifiers.filter(v.contains(n)).withColumn("score", F.when(exact, _by_kind(EXACT, 0.0)).otherwise(_by_kind(partial_scores(), 0.0)))
    d = d.withColumn("reasons", F.when(exact, F.array(reason, F.lit("identifier_exact"))).otherwise(F.array(partial)))
    return d.groupBy("entity_id").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))


def candidates(entities: DataFrame, identifiers: DataFrame, needle: str, most_entities: int = 10, most_aliases: int = 12) -> DataFrame:
    """One row per person: key (the user id, else the entity), entity_id and display_name of the surest
    entity, confidence, reasons, entity_ids and aliases, the lists cut to their bounds.

    Entities with an identifier equal to the needle, or else those that contain it. A score is
    bounded by the entity's own confidence. Entities of the same user id are one person, and
    those that share it without a hit are named as siblings.
    """
    n = needle.strip().lower()
    v = normalized(F.col("value"))
    hit = with_fallback(identifiers.filter(v == n), identifiers.filter(v.contains(n) & (v != n)))
    named = hit.withColumn("reason", F.array(_by_kind(REASONS, "identifier_exact"), F.lit("identifier_exact")))
    hits = named.groupBy("entity_id").agg(F.max(F.least("confidence", F.lit(1.0))).alias("sure"), F.flatten(F.collect_set("reason")).alias("named"))
    own = identifiers.join(hits.select("entity_id"), "entity_id", "left_semi")
    known = own.groupBy("entity_id").agg(F.min(F.when(F.col("kind") == "user_id", F.col("value"))).alias("user_id"), F.collect_set("value").alias("values"))
    s = hits.join(known, "entity_id").join(scored(own, needle), "entity_id", "left").join(entities.withColumnRenamed("confidence", "own"), "entity_id")
    s = s.select(
        "entity_id", "display_name", "user_id", "values",
        F.coalesce("user_id", "entity_id").alias("key"),
        F.least(F.greatest(F.coalesce("score", F.lit(0.0)), "sure"), F.greatest(F.least("own", F.lit(1.0)), F.lit(0.0))).alias("confidence"),
        F.array_union("named", F.coalesce("reasons", F.array().cast("array<string>"))).alias("reasons"),
    ).filter("confidence > 0")
    first = F.min(F.struct((-F.col("confidence")).alias("c"), "entity_id", "display_name"))
    merged = s.groupBy("key").agg(
        first.alias("b"), F.max("user_id").alias("user_id"), F.flatten(F.collect_set("reasons")).alias("reasons"),
        F.collect_set("entity_id").alias("ids"), F.flatten(F.collect_set(F.array_append("values", F.col("display_name")))).alias("aliases"),
    )
    shared = identifiers.filter("kind = 'user_id'").select(F.col("value").alias("user_id"), "entity_id").join(merged.filter("user_id is not null").select("user_id"), "user_id", "left_semi")
    others = identifiers.join(shared.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.collect_set("value").alias("values"))
    shared = shared.join(others, "entity_id").join(entities.select("entity_id", "display_name"), "entity_id")
    siblings = shared.groupBy("user_id").agg(F.collect_set("entity_id").alias("more_ids"), F.flatten(F.collect_set(F.array_append("values", F.col("display_name")))).alias("more_aliases"))
    j = merged.join(siblings, "user_id", "left")
    none = F.array().cast("array<string>")
    listed = lambda c, more, most: F.slice(F.array_sort(F.array_distinct(F.concat(c, F.coalesce(more, none)))), 1, most)
    sibling = F.when(F.col("more_ids").isNotNull(), F.array(F.lit("user_id_sibling"))).otherwise(none)
    return j.select(
        "key", F.col("b.entity_id").alias("entity_id"), F.col("b.display_name").alias("display_name"), F.round(-F.col("b.c"), 6).alias("confidence"),
        F.array_sort(F.array_distinct(F.concat("reasons", sibling))).alias("reasons"),
        listed(F.col("ids"), F.col("more_ids"), most_entities).alias("entity_ids"), listed(F.col("aliases"), F.col("more_aliases"), most_aliases).alias("aliases"),
    )


def with_conversations(found: DataFrame, conversations: DataFrame, messages: DataFrame, most: int = 20) -> DataFrame:
    """Candidates with conversation_ids and sender_ids: private conversations (conversation_id, title,
    type) whose title is an alias of one candidate and of no other conversation, and who wrote in them."""
    private = conversations.filter("type = 'private'").select("conversation_id", normalized(F.col("title")).alias("alias"))
    aliases = found.select("key", F.explode(F.transform("aliases", normalized)).alias("alias")).distinct()
    matched = aliases.join(private, "alias")
    alone = matched.groupBy("key", "alias").agg(F.count("*").alias("n"), F.min("conversation_id").alias("conversation_id")).filter("n = 1")
    pairs = alone.select("key", "conversation_id").distinct()
    senders = messages.filter("direction = 'incoming'").select("conversation_id", "sender_id").distinct()
    g = pairs.join(senders, "conversation_id", "left").groupBy("key")
    cut = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, most)
    none = F.array().cast("array<string>")
    j = found.join(g.agg(cut("conversation_id").alias("conversation_ids"), cut("sender_id").alias("sender_ids")), "key", "left")
    return j.withColumns({c: F.coalesce(c, none) for c in ("conversation_ids", "sender_ids")})


def unresolved(conversations: DataFrame, messages: DataFrame, needle: str, limit: int = 5) -> DataFrame:
    """Candidates where no entity is known: private conversations of exactly this title, or else the
    first messages whose title or sender contains it; columns as of candidates, without lists."""
    n = needle.strip().lower()
    title = F.lower(F.col("title"))
    by_title = conversations.filter((F.col("type") == "private") & (title == n)).select(
        F.col("conversation_id").alias("key"), F.col("title").alias("display_name"), F.lit(1.0).alias("confidence"), F.array(F.lit("private_conversation_title_exact")).alias("reasons")
    )
    m = messages.filter(F.lower("conversation_title").contains(n) | F.lower("sender_name").contains(n)).orderBy("timestamp", "citation").limit(limit)
    private = (F.col("conversation_type") == "private") & (F.lower("conversation_title") == n)
    group = (F.col("conversation_type") == "group") & (F.lower("sender_name") == n)
    reason = F.when(private, "private_conversation_title_exact").when(group, "group_alias_exact").otherwise("message_metadata")
    rows = m.select(
        F.when(private, F.col("conversation_id")).otherwise(F.coalesce("sender_id", "conversation_title", "sender_name")).alias("key"),
        F.coalesce("conversation_title", "sender_name").alias("display_name"),
        F.when(private, 1.0).when(group, 0.9).otherwise(0.4).alias("confidence"),
        reason.alias("reason"), "timestamp", "citation",
    )
    first = F.min(F.struct((-F.col("confidence")).alias("c"), "timestamp", "citation", "display_name"))
    by_message = rows.groupBy("key").agg(first.alias("b"), F.array_sort(F.collect_set("reason")).alias("reasons")).select("key", F.col("b.display_name").alias("display_name"), (-F.col("b.c")).alias("confidence"), "reasons")
    out = with_fallback(by_title, by_message)
    return out.select("key", F.concat(F.lit("unresolved:"), "key").alias("entity_id"), "display_name", "confidence", "reasons")


def leader(found: DataFrame, limit: int = 5) -> DataFrame:
    """One row: the candidate of the strongest reason, then of the highest confidence, with status `ok`;
    `ambiguous` if another equals it or its reasons have no strength and it is not alone, or `no_results`.

    As of the surest candidates up to limit, which is what a caller is shown.
    """
    strength = F.array_max(F.transform("reasons", lambda r: reduce(lambda out, kv: F.when(r == kv[0], kv[1]).otherwise(out), PRIORITY.items(), F.lit(0))))
    shown = found.withColumn("p", strength).orderBy(F.desc("confidence"), "entity_id").limit(limit)
    order = [F.desc("p"), F.desc("confidence"), F.asc("entity_id")]
    ranked = shown.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # of limit rows
    one = ranked.agg(F.count("*").alias("c"), F.max(F.struct("p", "confidence")).alias("top"), F.max(F.when(F.col("n") == 1, F.col("entity_id"))).alias("entity_id"), F.collect_list(F.struct("p", "confidence")).alias("all"))
    ties = F.size(F.filter("all", lambda x: x == F.col("top")))
    status = F.when(F.col("c") == 0, "no_results").when((F.col("c") == 1) | ((ties == 1) & (F.col("top.p") > 0)), "ok").otherwise("ambiguous")
    return one.select(F.when(status == "ok", F.col("entity_id")).alias("entity_id"), status.alias("status"))


def repointed(df: DataFrame, merges: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """df with the ids of these columns replaced by their canonical one (merges: old_id, new_id)."""
    names, order = [columns] if isinstance(columns, str) else list(columns), df.columns
    for c in names:
        m = merges.select(F.col("old_id").alias(c), F.col("new_id").alias("__new"))
        df = df.join(m, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return df.select(*order)


def _grams(c: Column, size: Column) -> Column:
    """Distinct runs of size characters; of a shorter text none."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(c) - size), lambda i: F.substring(c, i + 1, size)))


def _containing(values: DataFrame, asked: DataFrame, scope: Sequence[str]) -> DataFrame:
    """asked (.., part) joined with the values (.., v) that contain part, within the same scope.

    Values are posted under their runs of the lengths of RUNS that are asked for, as far as these
    begin what is asked; each part asks the list of the rarest of its own runs of the longest such length, and
    what it finds there is verified. So no part meets values that have nothing in common with it.
    """
    longest = F.array_max(F.filter(F.array(*(F.lit(k) for k in RUNS)), lambda k: k <= F.length("part")))
    parts = asked.select(*scope, "part").distinct().filter("part <> ''").withColumn("k", longest)
    wanted = parts.select(*scope, "part", F.explode(_grams(F.col("part"), F.col("k"))).alias("gram"))
    sizes = parts.select("k").distinct()  # RUNS at most
    posted = values.select(*scope, "v").distinct().join(F.broadcast(sizes), F.length("v") >= F.col("k"))
    posted = posted.withColumn("gram", F.explode(_grams(F.col("v"), F.col("k")))).drop("k").join(wanted.select(*scope, "gram").distinct(), [*scope, "gram"], "left_semi")
    sizes_of = posted.groupBy(*scope, "gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(sizes_of, [*scope, "gram"], "left").groupBy(*scope, "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    rarest = rarest.filter("g.n > 0").select(*scope, "part", F.col("g.gram").alias("gram"))
    return rarest.join(posted, [*scope, "gram"]).filter(F.col("v").contains(F.col("part"))).select(*scope, "part", "v")


def candidates_of_many(entities: DataFrame, identifiers: DataFrame, needles: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """needle, entity_id, stage, confidence and reasons for every needle of a table, in one plan.

    Stages of a needle: identifiers equal to it; else those that contain it; else, if it is of several
    words, the entities that each word hits. scope names columns (an account, say) that identifiers
    and needles share, and within which they meet. Confidence is the score of the hits, or the
    certainty of an identifier where that is higher, up to the entity's own; of words, that of the weakest one.
    """
    ids = identifiers.withColumn("v", normalized(F.col("value")))
    asked = needles.select(*scope, "needle", normalized(F.col("needle")).alias("part")).distinct()
    of_needle = [*scope, "needle"]

    def hits(met: DataFrame, keys: list[str]) -> DataFrame:
        """What each identifier (kind, v, confidence) that contains a part says of its entity."""
        exact = F.col("v") == F.col("part")
        reason = _by_kind(REASONS, "identifier_exact")
        partial = F.coalesce(_by_kind(PARTIAL_REASONS, None), F.concat(reason, F.lit("_partial")))
        score = F.when(exact, F.greatest(_by_kind(EXACT, 0.0), F.least("confidence", F.lit(1.0)))).otherwise(_by_kind(partial_scores(), 0.0))
        return met.select(*keys, "entity_id", exact.alias("exact"), score.alias("score"), F.when(exact, F.array(reason, F.lit("identifier_exact"))).otherwise(F.array(partial)).alias("reasons"))

    whole = hits(asked.join(_containing(ids, asked, scope), [*scope, "part"]).join(ids, [*scope, "v"]), of_needle)
    best = F.max("exact").over(Window.partitionBy(*of_needle))
    whole = whole.withColumn("best", best).filter("exact = best").groupBy(*of_needle, "entity_id", "exact").agg(F.max("score").alias("score"), F.flatten(F.collect_set("reasons")).alias("reasons"))
    whole = settled(whole.withColumn("stage", F.when(F.col("exact"), "exact").otherwise("partial")).drop("exact"), "whole")

    split = asked.withColumn("words", F.array_distinct(F.split("part", " "))).filter("size(words) > 1").join(whole.select(*of_needle).distinct(), of_needle, "left_anti").drop("part")
    words = settled(split.select("*", F.explode("words").alias("part")), "words")
    # A word that many identifiers contain would meet them once for each needle that has it: only the rarest word
    # of a needle is looked up, and the others are looked for in the identifiers of the entities found.
    values = settled(_containing(ids, words, scope), "containing")
    met_by = values.join(ids.groupBy(*scope, "v").agg(F.count("*").alias("met")), [*scope, "v"]).groupBy(*scope, "part").agg(F.sum("met").alias("met"))
    rarest = words.join(met_by, [*scope, "part"], "left").groupBy(*of_needle, "words").agg(F.min(F.struct(F.coalesce("met", F.lit(0)).alias("met"), "part")).alias("r"))
    rarest = rarest.filter("r.met > 0").select(*of_needle, "words", F.col("r.part").alias("part"))
    some = rarest.join(values, [*scope, "part"]).join(ids.select(*scope, "v", "entity_id"), [*scope, "v"]).select(*of_needle, "words", "entity_id").distinct()
    met = some.join(ids, [*scope, "entity_id"]).withColumn("part", F.explode("words")).filter(F.col("v").contains(F.col("part")))
    each = hits(met.withColumn("n", F.size("words")), [*of_needle, "n", "part"]).groupBy(*of_needle, "n", "part", "entity_id").agg(F.max("score").alias("score"), F.flatten(F.collect_set("reasons")).alias("reasons"))
    every = each.groupBy(*of_needle, "n", "entity_id").agg(F.count("*").alias("hit"), F.min("score").alias("score"), F.flatten(F.collect_set("reasons")).alias("reasons")).filter("hit = n")
    found = whole.unionByName(every.select(*of_needle, "entity_id", "score", "reasons", F.lit("words").alias("stage")))
    own = entities.select("entity_id", F.col("confidence").alias("own"))
    sure = F.least("score", F.greatest(F.least("own", F.lit(1.0)), F.lit(0.0)))
    return found.join(own, "entity_id").select(*of_needle, "entity_id", "stage", F.round(sure, 6).alias("confidence"), F.array_sort(F.array_distinct("reasons")).alias("reasons")).filter("confidence > 0")
