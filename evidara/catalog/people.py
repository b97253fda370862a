"""Queries of entity resolution and of merging identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as N
from ..operators.windows import newest_k
from ..sources import tables as S
from .registry import query

ENTITIES = "(SELECT 'c' || c_custkey AS entity_id, c_name AS display_name, 1.0 AS own FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 0.9 FROM supplier)"
IDENTIFIERS = """(SELECT 'c' || c_custkey AS entity_id, 'user_id' AS kind, CAST(c_custkey AS VARCHAR) AS value, 0.95 AS sure FROM customer UNION ALL SELECT 'c' || c_custkey, 'display_name', c_name, 0.7 FROM customer
 UNION ALL SELECT 'c' || c_custkey, 'remark', c_mktsegment || ' ' || c_nationkey, 0.6 FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'user_id', CAST(s_suppkey AS VARCHAR), 0.9 FROM supplier UNION ALL SELECT 's' || s_suppkey, 'alias', s_name, 0.8 FROM supplier UNION ALL SELECT 's' || s_suppkey, 'nickname', 'sup ' || s_nationkey, 0.5 FROM supplier)"""


def score_sql(needle: str, of: str = IDENTIFIERS) -> str:
    """The ladder, written out kind by kind."""
    return f"""(SELECT entity_id, max(CASE WHEN lower(trim(value)) = '{needle}' THEN CASE kind WHEN 'user_id' THEN 0.99 WHEN 'remark' THEN 0.97 WHEN 'nickname' THEN 0.94 WHEN 'alias' THEN 0.88 WHEN 'display_name' THEN 0.88 END
   ELSE CASE kind WHEN 'user_id' THEN 0.78 WHEN 'remark' THEN 0.76 WHEN 'nickname' THEN 0.74 WHEN 'alias' THEN 0.68 WHEN 'display_name' THEN 0.74 END END)::DOUBLE AS score,
  flatten(list(CASE WHEN lower(trim(value)) = '{needle}' THEN [CASE kind WHEN 'user_id' THEN 'user_id_exact' WHEN 'remark' THEN 'contact_remark_exact' WHEN 'nickname' THEN 'contact_nickname_exact' ELSE 'identifier_exact' END, 'identifier_exact']
   ELSE [CASE kind WHEN 'user_id' THEN 'user_id_partial' WHEN 'remark' THEN 'contact_remark_exact_partial' WHEN 'nickname' THEN 'contact_nickname_exact_partial' WHEN 'display_name' THEN 'identifier_partial' ELSE 'identifier_exact_partial' END] END)) AS reasons
  FROM {of} i WHERE contains(lower(value), '{needle}') GROUP BY entity_id)"""


def candidates_sql(needle: str) -> str:
    return f"""i AS (SELECT * FROM {IDENTIFIERS} x), ent AS (SELECT * FROM {ENTITIES} x), ex AS (SELECT * FROM i WHERE lower(trim(value)) = '{needle}'),
 hit AS (SELECT * FROM ex UNION ALL SELECT * FROM i WHERE contains(lower(value), '{needle}') AND NOT EXISTS (SELECT 1 FROM ex)),
 h AS (SELECT entity_id, max(sure) AS sure, flatten(list([CASE kind WHEN 'user_id' THEN 'user_id_exact' WHEN 'remark' THEN 'contact_remark_exact' WHEN 'nickname' THEN 'contact_nickname_exact' ELSE 'identifier_exact' END, 'identifier_exact'])) AS named FROM hit GROUP BY entity_id),
 per AS (SELECT ent.entity_id, display_name, min(value) FILTER (WHERE kind = 'user_id') AS user_id, list(value) AS vals FROM ent JOIN i ON i.entity_id = ent.entity_id GROUP BY 1, 2),
 s AS (SELECT h.entity_id, per.display_name, per.user_id, per.vals, coalesce(per.user_id, h.entity_id) AS key, least(greatest(coalesce(sc.score, 0), h.sure), ent.own)::DOUBLE AS confidence, list_concat(h.named, coalesce(sc.reasons, [])) AS reasons
  FROM h JOIN per ON per.entity_id = h.entity_id JOIN ent ON ent.entity_id = h.entity_id LEFT JOIN {score_sql(needle, "i")} sc ON sc.entity_id = h.entity_id),
 g AS (SELECT key, max(user_id) AS user_id, max(confidence) AS confidence, first(entity_id ORDER BY confidence DESC, entity_id) AS entity_id, first(display_name ORDER BY confidence DESC, entity_id) AS display_name, flatten(list(reasons)) AS reasons, list(entity_id) AS ids, flatten(list(list_append(vals, display_name))) AS names FROM s GROUP BY key),
 sib AS (SELECT user_id, list(entity_id) AS ids, flatten(list(list_append(vals, display_name))) AS names FROM per WHERE user_id IN (SELECT user_id FROM g) GROUP BY user_id),
 c AS (SELECT g.key, g.entity_id, g.display_name, round(g.confidence, 6) AS confidence, list_sort(list_distinct(CASE WHEN sib.user_id IS NULL THEN g.reasons ELSE list_append(g.reasons, 'user_id_sibling') END)) AS reasons,
  list_sort(list_distinct(list_concat(g.ids, coalesce(sib.ids, []))))[1:10] AS entity_ids, list_sort(list_distinct(list_concat(g.names, coalesce(sib.names, []))))[1:12] AS aliases FROM g LEFT JOIN sib ON sib.user_id = g.user_id)"""


SHOWN = "key, entity_id, display_name, confidence, array_to_string(reasons, ',') AS reasons, array_to_string(entity_ids, ',') AS entity_ids, array_to_string(aliases, ',') AS aliases"
CONVERSATIONS = "(SELECT 'n' || n_nationkey AS conversation_id, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'private' ELSE 'group' END AS kind FROM nation UNION ALL SELECT 'd' || c_custkey, c_name, 'private' FROM customer WHERE c_custkey % 3 = 0)"
MESSAGES = """(SELECT 'msg/' || c_custkey AS citation, 'n' || c_nationkey AS conversation_id, 'NATION_' || c_nationkey AS conversation_title, CASE WHEN c_nationkey % 2 = 0 THEN 'private' ELSE 'group' END AS kind, 'c' || c_custkey AS sender_id, c_mktsegment AS sender_name, c_custkey AS sent, CASE WHEN c_acctbal > 0 THEN 'incoming' ELSE 'outgoing' END AS direction FROM customer
 UNION ALL SELECT 'own/' || c_custkey, 'd' || c_custkey, c_name, 'private', 'c' || c_custkey, c_name, c_custkey, 'incoming' FROM customer WHERE c_custkey % 3 = 0)"""


def entities(spark, d):
    c = S.raw(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("display_name"), F.lit(1.0).alias("confidence"))
    return c.unionByName(S.raw(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("display_name"), F.lit(0.9).alias("confidence")))


def identifiers(spark, d):
    def of(name, letter, key, kinds):
        rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value"), F.lit(sure).alias("confidence")) for k, v, sure in kinds))).alias("p")
        return S.raw(spark, d, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("entity_id"), rows).select("entity_id", "p.kind", "p.value", "p.confidence")

    c = of("customer", "c", "c_custkey", [("user_id", F.col("c_custkey"), 0.95), ("display_name", F.col("c_name"), 0.7), ("remark", F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")), 0.6)])
    return c.unionByName(of("supplier", "s", "s_suppkey", [("user_id", F.col("s_suppkey"), 0.9), ("alias", F.col("s_name"), 0.8), ("nickname", F.concat(F.lit("sup "), F.col("s_nationkey").cast("string")), 0.5)]))


def conversations(spark, d):
    kind = lambda key: F.when(F.col(key) % 2 == 0, "private").otherwise("group")
    n = S.raw(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("conversation_id"), F.col("n_name").alias("title"), kind("n_nationkey").alias("type"))
    own = S.raw(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("conversation_id"), F.col("c_name").alias("title"), F.lit("private").alias("type"))
    return n.unionByName(own)


def messages(spark, d):
    c, key = S.raw(spark, d, "customer"), F.col("c_custkey").cast("string")
    nation = F.col("c_nationkey").cast("string")
    a = c.select(
        F.concat(F.lit("msg/"), key).alias("citation"), F.concat(F.lit("n"), nation).alias("conversation_id"), F.concat(F.lit("NATION_"), nation).alias("conversation_title"),
        F.when(F.col("c_nationkey") % 2 == 0, "private").otherwise("group").alias("conversation_type"), F.concat(F.lit("c"), key).alias("sender_id"), F.col("c_mktsegment").alias("sender_name"),
        F.col("c_custkey").alias("timestamp"), F.when(F.col("c_acctbal") > 0, "incoming").otherwise("outgoing").alias("direction"),
    )
    own = c.filter("c_custkey % 3 = 0").select(
        F.concat(F.lit("own/"), key).alias("citation"), F.concat(F.lit("d"), key).alias("conversation_id"), F.col("c_name").alias("conversation_title"), F.lit("private").alias("conversation_type"),
        F.concat(F.lit("c"), key).alias("sender_id"), F.col("c_name").alias("sender_name"), F.col("c_custkey").alias("timestamp"), F.lit("incoming").alias("direction"),
    )
    return a.unionByName(own)


def shown(c):
    return c.select("key", "entity_id", "display_name", "confidence", *(F.concat_ws(",", x).alias(x) for x in ("reasons", "entity_ids", "aliases")))


@query("entity_exact_ladder", f"SELECT entity_id, score, array_to_string(list_sort(list_distinct(reasons)), ',') AS reasons FROM {score_sql('12')} s")
def entity_exact_ladder(spark, d):
    return N.scored(identifiers(spark, d), "12").withColumn("reasons", F.concat_ws(",", "reasons"))


@query("entity_candidates", f"WITH {candidates_sql('12')} SELECT {SHOWN} FROM c")
def entity_candidates(spark, d):
    """Exact hits: a customer and a supplier of one user id are one person."""
    return shown(N.candidates(entities(spark, d), identifiers(spark, d), "12"))


@query("entity_candidates_partial", f"WITH {candidates_sql('#00000004')} SELECT {SHOWN} FROM c")
def entity_candidates_partial(spark, d):
    return shown(N.candidates(entities(spark, d), identifiers(spark, d), "#00000004"))


@query("entity_conversations", f"""WITH {candidates_sql('building 3')}, a AS (SELECT DISTINCT key, lower(trim(unnest(aliases))) AS alias FROM c), v AS (SELECT conversation_id, lower(trim(title)) AS alias FROM {CONVERSATIONS} x WHERE kind = 'private'),
 u AS (SELECT key, alias, min(conversation_id) AS conversation_id FROM a JOIN v USING (alias) GROUP BY 1, 2 HAVING count(*) = 1), m AS (SELECT DISTINCT conversation_id, sender_id FROM {MESSAGES} x WHERE direction = 'incoming'),
 k AS (SELECT key, list_sort(list_distinct(list(u.conversation_id)))[1:20] AS cs, list_sort(list_distinct(list(sender_id) FILTER (WHERE sender_id IS NOT NULL)))[1:20] AS ss FROM u LEFT JOIN m ON m.conversation_id = u.conversation_id GROUP BY key)
 SELECT c.key, entity_id, confidence, coalesce(array_to_string(cs, ','), '') AS conversation_ids, coalesce(array_to_string(ss, ','), '') AS sender_ids FROM c LEFT JOIN k ON k.key = c.key""")
def entity_conversations(spark, d):
    c = N.with_conversations(N.candidates(entities(spark, d), identifiers(spark, d), "building 3"), conversations(spark, d), messages(spark, d))
    return c.select("key", "entity_id", "confidence", *(F.concat_ws(",", x).alias(x) for x in ("conversation_ids", "sender_ids")))


def unresolved_sql(needle: str) -> str:
    return f"""t AS (SELECT conversation_id AS key, title AS display_name, 1.0::DOUBLE AS confidence, 'private_conversation_title_exact' AS reasons FROM {CONVERSATIONS} x WHERE kind = 'private' AND lower(title) = '{needle}'),
 w AS (SELECT * FROM {MESSAGES} x WHERE contains(lower(conversation_title), '{needle}') OR contains(lower(sender_name), '{needle}') ORDER BY sent, citation LIMIT 5),
 r AS (SELECT *, CASE WHEN kind = 'private' AND lower(conversation_title) = '{needle}' THEN 1.0 WHEN kind = 'group' AND lower(sender_name) = '{needle}' THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence FROM w),
 q AS (SELECT CASE confidence WHEN 1.0 THEN conversation_id ELSE sender_id END AS key, conversation_title, confidence, CASE confidence WHEN 1.0 THEN 'private_conversation_title_exact' WHEN 0.9 THEN 'group_alias_exact' ELSE 'message_metadata' END AS reason, sent, citation FROM r),
 z AS (SELECT * FROM t UNION ALL SELECT key, first(conversation_title ORDER BY confidence DESC, sent, citation), max(confidence), array_to_string(list_sort(list_distinct(list(reason))), ',') FROM q WHERE NOT EXISTS (SELECT 1 FROM t) GROUP BY key)
 SELECT key, 'unresolved:' || key AS entity_id, display_name, confidence, reasons FROM z"""


@query("entity_unresolved", f"WITH {unresolved_sql('household')}")
def entity_unresolved(spark, d):
    return N.unresolved(conversations(spark, d), messages(spark, d), "household").withColumn("reasons", F.concat_ws(",", "reasons"))


@query("entity_unresolved_title", f"WITH {unresolved_sql('nation_4')}")
def entity_unresolved_title(spark, d):
    return N.unresolved(conversations(spark, d), messages(spark, d), "nation_4").withColumn("reasons", F.concat_ws(",", "reasons"))


def leader_sql(needle: str) -> str:
    return f"""WITH {candidates_sql(needle)}, p AS (SELECT *, CASE WHEN list_contains(reasons, 'user_id_exact') THEN 45 WHEN list_contains(reasons, 'contact_remark_exact') THEN 40 WHEN list_contains(reasons, 'contact_nickname_exact') THEN 30 WHEN list_contains(reasons, 'identifier_exact') THEN 10 ELSE 0 END AS p FROM c ORDER BY confidence DESC, entity_id LIMIT 5),
 t AS (SELECT * FROM p WHERE p = (SELECT max(p) FROM p)), l AS (SELECT * FROM t WHERE confidence = (SELECT max(confidence) FROM t)),
 n AS (SELECT (SELECT count(*) FROM p) AS shown, (SELECT count(*) FROM l) AS ties, (SELECT max(p) FROM p) AS top, (SELECT min(entity_id) FROM l) AS id)"""


LEADER = "SELECT '{0}' AS needle, CASE WHEN shown = 1 OR (ties = 1 AND top > 0) THEN id END AS entity_id, CASE WHEN shown = 0 THEN 'no_results' WHEN shown = 1 OR (ties = 1 AND top > 0) THEN 'ok' ELSE 'ambiguous' END AS status FROM n"
NEEDLES = ("12", "#00000004", "sup 3", "nobody at all")


@query("entity_select", " UNION ALL ".join(f"(SELECT * FROM ({leader_sql(n)} {LEADER.format(n)}))" for n in NEEDLES))
def entity_select(spark, d):
    """One leader, several alike, and none."""
    e, i, out = entities(spark, d), identifiers(spark, d), None
    for n in NEEDLES:
        one = N.leader(N.candidates(e, i, n)).withColumn("needle", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query("entity_merge_map", "SELECT CASE WHEN o_custkey % 10 = 5 THEN o_custkey - 5 ELSE o_custkey END AS o_custkey, count(*) AS orders FROM orders GROUP BY 1")
def entity_merge_map(spark, d):
    m = S.raw(spark, d, "orders").select("o_custkey").distinct().filter("o_custkey % 10 = 5").select(F.col("o_custkey").alias("old_id"), (F.col("o_custkey") - 5).alias("new_id"))
    return N.repointed(S.raw(spark, d, "orders").select("o_custkey"), m, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("entity_merge_relations", "WITH m AS (SELECT c_custkey AS a, c_custkey - 1 AS b FROM customer WHERE c_custkey % 4 = 1) SELECT event_id, coalesce(x.b, user_id) AS user_id, coalesce(y.b, event_id % 100) AS other_id FROM events LEFT JOIN m x ON x.a = user_id LEFT JOIN m y ON y.a = event_id % 100")
def entity_merge_relations(spark, d):
    """Both ends of a relation are repointed."""
    m = S.raw(spark, d, "customer").filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - 1).alias("new_id"))
    e = S.raw(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 100).alias("other_id"))
    return N.repointed(e, m, ["user_id", "other_id"])


@query("customer_sections", "SELECT c_custkey, section, o_orderkey FROM (SELECT o_custkey AS c_custkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS section, o_orderkey, row_number() OVER (PARTITION BY o_custkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) t WHERE n <= 5")
def customer_sections(spark, d):
    section = F.when(F.col("o_totalprice") > 200_000, "large").when(F.col("o_orderstatus") == "O", "open").otherwise("other")
    o = S.raw(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), section.alias("section"), "o_orderkey", "o_orderdate")
    return newest_k(o, ["c_custkey", "section"], 5, F.desc("o_orderdate"), F.asc("o_orderkey")).drop("o_orderdate")


#: Needles of four sorts, each asked of the people of a nation only: a remark, a nickname, the end of a name, and two words of different identifiers.
MANY = """(SELECT n_nationkey AS nation, 'Building ' || n_nationkey AS needle FROM nation UNION ALL SELECT n_nationkey, 'SUP  ' || n_nationkey FROM nation
 UNION ALL SELECT c_nationkey, right(c_name, 3) FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT c_nationkey, c_mktsegment || ' ' || c_name FROM customer WHERE c_custkey % 20 = 1 UNION ALL SELECT n_nationkey, 'nobody at all' FROM nation)"""
MANY_SQL = f"""WITH n AS (SELECT DISTINCT nation, needle, lower(trim(regexp_replace(needle, ' +', ' ', 'g'))) AS part FROM {MANY} x),
 home AS (SELECT 'c' || c_custkey AS entity_id, c_nationkey AS nation FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
 i AS (SELECT x.*, nation, lower(trim(value)) AS v FROM {IDENTIFIERS} x JOIN home ON home.entity_id = x.entity_id),
 w AS (SELECT nation, needle, part, part AS word, 1 AS words, false AS split FROM n UNION ALL SELECT nation, needle, part, unnest(list_distinct(string_split(part, ' '))), len(list_distinct(string_split(part, ' '))), true FROM n WHERE contains(part, ' ')),
 m AS (SELECT w.*, entity_id, v = word AS exact, CASE WHEN v = word THEN greatest(CASE kind WHEN 'user_id' THEN 0.99 WHEN 'remark' THEN 0.97 WHEN 'nickname' THEN 0.94 ELSE 0.88 END, sure)
   ELSE CASE kind WHEN 'user_id' THEN 0.78 WHEN 'remark' THEN 0.76 WHEN 'nickname' THEN 0.74 WHEN 'alias' THEN 0.68 ELSE 0.74 END END::DOUBLE AS score,
  CASE WHEN v = word THEN [CASE kind WHEN 'user_id' THEN 'user_id_exact' WHEN 'remark' THEN 'contact_remark_exact' WHEN 'nickname' THEN 'contact_nickname_exact' ELSE 'identifier_exact' END, 'identifier_exact']
   ELSE [CASE kind WHEN 'user_id' THEN 'user_id_partial' WHEN 'remark' THEN 'contact_remark_exact_partial' WHEN 'nickname' THEN 'contact_nickname_exact_partial' WHEN 'display_name' THEN 'identifier_partial' ELSE 'identifier_exact_partial' END] END AS reasons
  FROM w JOIN i ON i.nation = w.nation AND contains(v, word)),
 a AS (SELECT nation, needle, entity_id, CASE WHEN exact THEN 'exact' ELSE 'partial' END AS stage, max(score) AS score, flatten(list(reasons)) AS reasons FROM (SELECT *, max(exact) OVER (PARTITION BY nation, needle) AS best FROM m WHERE NOT split) q WHERE exact = best GROUP BY 1, 2, 3, 4),
 e AS (SELECT nation, needle, words, entity_id, word, max(score) AS score, flatten(list(reasons)) AS reasons FROM m WHERE split AND (nation, needle) NOT IN (SELECT (nation, needle) FROM a) GROUP BY 1, 2, 3, 4, 5),
 t AS (SELECT nation, needle, entity_id, 'words' AS stage, min(score) AS score, flatten(list(reasons)) AS reasons FROM e GROUP BY nation, needle, words, entity_id HAVING count(*) = words)
 SELECT nation, needle, f.entity_id, stage, round(least(score, own)::DOUBLE, 6) AS confidence, array_to_string(list_sort(list_distinct(reasons)), ',') AS reasons FROM (SELECT * FROM a UNION ALL SELECT * FROM t) f JOIN {ENTITIES} o ON o.entity_id = f.entity_id"""


@query("entity_candidates_many", MANY_SQL)
def entity_candidates_many(spark, d):
    n, c = S.raw(spark, d, "nation"), S.raw(spark, d, "customer")
    key = F.col("n_nationkey").alias("nation")
    needles = n.select(key, F.concat(F.lit("Building "), "n_nationkey").alias("needle")).unionByName(n.select(key, F.concat(F.lit("SUP  "), "n_nationkey").alias("needle")))
    needles = needles.unionByName(c.filter("c_custkey % 20 = 0").select(F.col("c_nationkey").alias("nation"), F.substring("c_name", -3, 3).alias("needle")))
    needles = needles.unionByName(c.filter("c_custkey % 20 = 1").select(F.col("c_nationkey").alias("nation"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("needle")))
    needles = needles.unionByName(n.select(key, F.lit("nobody at all").alias("needle")))
    home = c.select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_nationkey").alias("nation"))
    home = home.unionByName(S.raw(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("nation")))
    found = N.candidates_of_many(entities(spark, d), identifiers(spark, d).join(home, "entity_id"), needles, ["nation"])
    return found.withColumn("reasons", F.concat_ws(",", "reasons"))
