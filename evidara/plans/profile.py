"""Profiles: one row per person from one shuffle of their interactions, contexts, key events, sections and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import newest_k, spread_sample, with_sessions

# Categories of key events in order, sections of a customer's profile, rules of claims.
KEY_CATEGORIES = ("identity_and_life_context", "goals_and_needs", "values_and_tradeoffs", "emotion_and_stress", "boundaries_and_conflict", "gratitude_and_help", "commitments_and_open_loops")
SECTIONS = (
    "identity", "needs", "objections", "commitments", "next_actions", "file_exchanges", "timeline_summary", "moments", "moments_authored", "moments_mentioned",
    "interactions", "voice_transcripts", "pending_voice", "image_observations", "chat_evidence", "observations", "ambiguities",
)
CLASSES = {"fact": 0.99, "pattern": 0.85, "hypothesis": 0.70, "unknown": 0.0, "action": 0.80}
MOST_CONTEXTS, MOST_CITATIONS, MOST_EVENTS = 100, 8, 30


def person_profiles(interactions: DataFrame, person: str = "user_id", gap_seconds: int = 28_800, recent_days: int = 10) -> DataFrame:
    """Counts by direction and kind, first and last time, sessions and who began them, and the recent
    trend, for each person of interactions (person, event_id, ts, kind, direction).

    Sessions and the latest time are windows over the person, and the aggregate has the same
    key, so rows are shuffled once.
    """
    s = with_sessions(interactions, [person], "ts", "event_id", gap_seconds).withColumn("latest", F.max("ts").over(Window.partitionBy(person)))
    near, far = (F.col("latest") - F.expr(f"interval {d} days") for d in (recent_days, 2 * recent_days))
    start, is_ = F.col("new_session") == 1, lambda side: F.col("direction") == side
    recent = F.count_if(F.col("ts") >= near)
    previous = F.count_if((F.col("ts") >= far) & (F.col("ts") < near))
    return s.groupBy(person).agg(
        F.count("*").alias("total"),
        *(F.count_if(is_(side)).alias(f"n_{side}") for side in ("self", "peer", "unknown")),
        F.countDistinct("kind").alias("kinds"),
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
        F.max("session_no").alias("sessions"),
        F.count_if(start & is_("self")).alias("self_started"),
        F.count_if(start & is_("peer")).alias("peer_started"),
        F.when(recent == previous, "equal").when(recent > previous, "higher").otherwise("lower").alias("trend"),
    )


def group_contexts(messages: DataFrame, by: list[str], most: int = MOST_CONTEXTS) -> DataFrame:
    """For each of by (say a person) the groups (conversation) in which peers were read: messages, first and last
    time, and a map of kinds to counts; those of most messages first (place from 1), up to most of them.

    messages has by, conversation, direction, kind and at.
    """
    peer = messages.filter("direction = 'peer'").groupBy(*by, "conversation", "kind").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    g = peer.groupBy(*by, "conversation").agg(
        F.sum("n").alias("messages"), F.min("first").alias("first_at"), F.max("last").alias("last_at"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"),  # an entry for each kind
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("messages"), "conversation"))
    return g.withColumn("place", place).filter(F.col("place") <= most)


def key_events(evidence: DataFrame, person: str, most: int = MOST_EVENTS, categories: tuple[str, ...] = KEY_CATEGORIES) -> DataFrame:
    """Evidence (person, category, citation, at, summary) of the categories that tell of a life, each citation once,
    under its first category; of more than most, evenly spread ones in order of time."""
    order = F.lit(len(categories))
    for i, c in enumerate(categories):
        order = F.when(F.col("category") == c, i).otherwise(order)
    first = evidence.filter(F.col("category").isin(list(categories))).withColumn("__o", order)
    one = newest_k(first, [person, "citation"], 1, F.asc("__o")).drop("__o")
    return spread_sample(one, [person], ["at", "citation"], most)


def profile_sections(claims: DataFrame, person: str, limit: int = 5) -> DataFrame:
    """Claims (person, section, value, citations, rank) as sections: without those of low signal, each (value,
    citations) once in a section, the first by rank, up to limit of a section; place from 1.

    Sections other than those of SECTIONS are left out.
    """
    signal = F.regexp_replace(F.coalesce("value", F.lit("")), "[^\\p{L}\\p{N}]+", "")
    kept = claims.filter(F.col("section").isin(list(SECTIONS)) & (F.length(signal) >= 2) & ~signal.rlike("^[0-9]+$"))
    once = kept.groupBy(person, "section", "value", "citations").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(person, "section").orderBy("rank", "value"))
    return once.withColumn("place", place).filter(F.col("place") <= limit)


def claim_errors(claims: DataFrame, evidence: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """claims with error, the first rule that a claim breaks or null, and the confidence that its class allows.

    A claim has claim_id, dimension, evidence_class, statement, citations, counterevidence,
    reviewed, alternatives, confidence and scope; evidence has the citations that there are.
    """
    c = claims.withColumn("__cited", F.array_distinct(F.concat("citations", "counterevidence")))
    asked = c.select("claim_id", F.explode("__cited").alias("citation"))
    lost = asked.join(evidence.select("citation").distinct(), "citation", "left_anti").groupBy("claim_id").agg(F.min("citation").alias("__lost"))
    j = c.join(lost, "claim_id", "left")
    n, k, strong = F.size(F.array_distinct("citations")), F.size(F.array_distinct("counterevidence")), F.col("evidence_class").isin("pattern", "hypothesis")
    size, scope = F.length(F.trim("statement")), F.length(F.trim("scope"))
    most = F.lit(None).cast("double")
    for name, value in CLASSES.items():
        most = F.when(F.col("evidence_class") == name, value).otherwise(most)
    error = (
        F.when(~F.col("dimension").isin(list(dimensions)), "dimension").when(~F.col("evidence_class").isin(list(CLASSES)), "evidence_class").when((size < 1) | (size > 1000), "statement")
        .when((F.col("evidence_class") != "unknown") & (n == 0), "uncited").when((n > MOST_CITATIONS) | (k > MOST_CITATIONS), "too_many_citations").when(strong & (n < 3), "too_few_citations")
        .when((F.col("evidence_class") == "hypothesis") & (F.size("alternatives") == 0), "no_alternative").when(strong & ~F.col("reviewed"), "not_reviewed").when(F.col("__lost").isNotNull(), "citation_not_found")
        .when(~F.col("confidence").between(0, 1), "confidence").when((scope < 1) | (scope > 200), "scope")
    )
    return j.withColumn("error", error).withColumn("confidence", F.least("confidence", most)).drop("__cited", "__lost")
