"""Streaming jobs run over what is available, with results read back; twins of batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.incremental import BucketTable
from ..sources import tables as S
from ..sources.scratch import settled, shared_place
from ..streaming import jobs, rounds
from .registry import query


def fed(spark, d, name, run):
    """The event table in four parts, in event order, each appended to the folder that a stream watches and
    taken up by a run of the job over what is then there; the state between runs is the job's checkpoint."""
    base = shared_place(spark, f"stream-{name}")
    e = S.raw(spark, d, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    for k in range(4 if low else 1):
        part = e
        if low:
            a, b = (F.lit(low + (high - low) * x / 4) for x in (k, k + 1))
            part = e.filter((F.col("ts") >= a) & ((F.col("ts") < b) | F.lit(k == 3)))
        part.write.mode("append").parquet(f"{base}/in")
        run(jobs.read_events(spark, f"{base}/in"), base)
    return base


@query("stream_tumbling", """SELECT window_start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) w
 WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_tumbling(spark, d):
    """Windows that the watermark has passed: all but those of the last hours."""
    base = fed(spark, d, "tumbling", lambda events, base: jobs.run_available(jobs.tumbling(events, late="1 hour"), f"{base}/out", f"{base}/cp"))
    return spark.read.schema("window_start timestamp, event_type string, n long").parquet(f"{base}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_dedupe", "SELECT DISTINCT event_id, user_id FROM events")
def stream_dedupe(spark, d):
    base = fed(spark, d, "dedupe", lambda events, base: jobs.run_available(jobs.deduplicated(events, late="40 days").select("event_id", "user_id"), f"{base}/out", f"{base}/cp"))
    return spark.read.schema("event_id long, user_id long").parquet(f"{base}/out")


@query("stream_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1")
def stream_upsert(spark, d):
    """The latest event of each user."""
    columns = ["user_id", "event_id", "ts", "event_type"]
    base = fed(spark, d, "upsert", lambda events, base: jobs.run_upserts(events.select(*columns), f"{base}/table", f"{base}/cp", ["user_id"]))
    rows = BucketTable(spark, f"{base}/table", ["user_id"]).read()
    if rows is None:
        rows = spark.createDataFrame([], "user_id long, event_id long, ts timestamp, event_type string")
    return rows.select("user_id", "event_id", "event_type")


QUIET = "least(1800.0, 300.0 + 60.0 * least(n, 10) + CASE WHEN kind = 'purchase' THEN 600.0 ELSE 0.0 END)"
#: One step for each event of a user; a round ends where the next event begins another, or where the last watermark passes its quiet time.
ROUNDS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT user_id, rn, event_id AS first_event, event_id AS last_event, 1::BIGINT AS n, sec AS started, sec AS ended, event_type AS kind, CAST(NULL AS VARCHAR) AS why FROM e WHERE rn = 1
  UNION ALL SELECT user_id, rn, CASE WHEN why IS NULL THEN first_event ELSE event_id END, event_id, CASE WHEN why IS NULL THEN n + 1 ELSE 1 END, CASE WHEN why IS NULL THEN started ELSE sec END, sec, event_type, why
  FROM (SELECT e.user_id, e.rn, r.first_event, e.event_id, r.n, r.started, e.sec, e.event_type, CASE WHEN e.sec - r.ended >= {QUIET} THEN 'quiet' WHEN e.sec - r.started >= 7200 THEN 'cap' END AS why FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) x)
 SELECT a.user_id, a.first_event, a.last_event, a.n, coalesce(b.why, 'quiet') AS closed_by, CAST(floor(a.ended) - floor(a.started) AS BIGINT) AS seconds FROM r a LEFT JOIN r b ON b.user_id = a.user_id AND b.rn = a.rn + 1
 WHERE b.why IS NOT NULL OR (b.user_id IS NULL AND a.ended + (SELECT {QUIET} FROM (SELECT a.n AS n, a.kind AS kind) q) <= (SELECT max(sec) - 3600 FROM e))"""


@query("stream_rounds", ROUNDS)
def stream_rounds(spark, d):
    with rounds.state_on_disk(spark):
        base = fed(spark, d, "rounds", lambda events, base: jobs.run_available(jobs.adaptive_rounds(events, late="1 hour"), f"{base}/out", f"{base}/cp"))
    out = spark.read.schema(jobs.ROUND).parquet(f"{base}/out")
    return out.withColumn("seconds", F.unix_seconds("ended") - F.unix_seconds("started")).drop("started", "ended")


def steps_sql(t: rounds.Timing) -> str:
    """State of each user after each of its events, with what that event ended (why) or superseded (sup), by one step for each event."""
    quiet = f"{t.quiet} + {t.per_message} * least(n, {t.counted}) + CASE WHEN kind = '{t.longer}' THEN {t.longer_by} ELSE 0.0 END"
    due = f"CASE WHEN blocked THEN ended + {t.expire} ELSE greatest(least(started + {t.greatest}, ended + {quiet}), not_before) END"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT user_id, 0::BIGINT AS rn, false AS live, 0::BIGINT AS first_event, 0::BIGINT AS last_event, 0::BIGINT AS n, 0::DOUBLE AS started, 0::DOUBLE AS ended, '' AS kind, 0::BIGINT AS attempts, 0::DOUBLE AS not_before, false AS blocked, CAST(NULL AS VARCHAR) AS why, false AS sup FROM (SELECT DISTINCT user_id FROM e) u
  UNION ALL SELECT user_id, rn, held OR NOT bad, CASE WHEN held THEN first_event ELSE event_id END, CASE WHEN bad THEN last_event ELSE event_id END, CASE WHEN bad THEN n WHEN held THEN n + 1 ELSE 1 END, CASE WHEN held THEN started ELSE sec END, CASE WHEN bad THEN ended ELSE sec END, CASE WHEN bad THEN kind ELSE event_type END,
   CASE WHEN held AND bad THEN attempts + 1 ELSE 0 END, CASE WHEN held AND bad THEN sec + least({t.most_back_off}, {t.back_off} * power(2, attempts)) ELSE 0 END, held AND bad AND attempts + 1 >= {t.attempts}, why, held AND NOT bad AND prepared <= sec
  FROM (SELECT *, live AND why IS NULL AS held FROM (SELECT e.user_id, e.rn, e.event_id, e.event_type, e.sec, e.event_type = '{t.failure}' AS bad, live, first_event, last_event, n, started, ended, kind, attempts, not_before, blocked, least(started + {t.greatest}, ended + {t.prepare}) AS prepared,
   CASE WHEN live AND {due} <= e.sec THEN CASE WHEN blocked THEN 'expired' ELSE 'ready' END END AS why FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) x) y),
 s AS (SELECT r.*, least(started + {t.greatest}, ended + {t.prepare}) AS made, {due} <= (SELECT max(sec) - 3600 FROM e) AS passed, lead(why) OVER w AS next_why, lead(sup) OVER w AS next_sup, lead(rn) OVER w IS NULL AS is_last FROM r WINDOW w AS (PARTITION BY user_id ORDER BY rn))"""


#: A draft is told once its round has ended: at the next event, or by the last watermark.
DRAFTS = f"""{steps_sql(rounds.Timing())},
 ends AS (SELECT user_id, first_event, coalesce(next_why, CASE WHEN blocked THEN 'expired' ELSE 'ready' END) AS outcome FROM s WHERE live AND (next_why IS NOT NULL OR (is_last AND passed)))
 SELECT s.user_id, s.first_event, s.last_event, s.n AS revision, s.attempts, CASE WHEN s.next_sup THEN 'superseded' ELSE ends.outcome END AS outcome, round(s.made - s.started, 3) AS seconds
 FROM s JOIN ends ON ends.user_id = s.user_id AND ends.first_event = s.first_event WHERE s.live AND (s.next_sup OR s.next_why IS NOT NULL OR (s.is_last AND s.passed))"""


def drafted(spark, d, name):
    """The stream is stopped after each part and begun again, with the state of its checkpoint."""
    return fed(spark, d, name, lambda events, base: jobs.run_available(rounds.drafted_rounds(events), f"{base}/out", f"{base}/cp"))


@query("stream_drafts", DRAFTS)
def stream_drafts(spark, d):
    with rounds.state_on_disk(spark):
        base = drafted(spark, d, "drafts")
    return spark.read.schema(rounds.DRAFT).parquet(f"{base}/out").withColumn("seconds", F.round("seconds", 3))


@query("stream_open_rounds", f"{steps_sql(rounds.Timing())} SELECT user_id, first_event, n AS revision, attempts, blocked FROM s WHERE live AND is_last AND NOT passed")
def stream_open_rounds(spark, d):
    """What the stream still holds after the last part, from its state."""
    with rounds.state_on_disk(spark):
        base = drafted(spark, d, "open-rounds")
        return settled(rounds.open_rounds(spark, f"{base}/cp"), "open-rounds")
