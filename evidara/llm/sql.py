"""DuckDB SQL of the operators that SQL can express, from the rules of each and not from the code."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NO_WORDS = "CAST([] AS VARCHAR[])"


def shingles(words: str, width: int | str) -> str:
    """Distinct runs of width words of a list of words, or all of a shorter list as one."""
    return f"""CASE WHEN len({words}) = 0 THEN {NO_WORDS} WHEN len({words}) < {width} THEN [array_to_string({words}, ' ')]
 ELSE list_distinct(list_transform(range(1, len({words}) - {width} + 2), lambda i: array_to_string({words}[i:i + {width} - 1], ' '))) END"""


def linked(width: int, percent: int, columns: str) -> str:
    """Links are pairs of rows that share enough shingles, and rows of one id; components their closure, written on ids."""
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(ASCII_LOWER.format("coalesce(text, '')"))} AS words FROM documents),
 s AS MATERIALIZED (SELECT r, doc_id, {shingles("words", width)} AS shingles FROM w),
 u AS MATERIALIZED (SELECT r, hash(g) AS g FROM (SELECT r, unnest(shingles) AS g FROM s) x),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS n_both FROM u a JOIN u b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p JOIN s x ON x.r = p.a JOIN s y ON y.r = p.b WHERE 100 * n_both >= {percent} * (len(x.shingles) + len(y.shingles) - n_both) AND x.doc_id <> y.doc_id),
 e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
 c(doc_id, other) AS (SELECT a, b FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.other = e.a),
 m AS (SELECT doc_id, min(other) AS low FROM c GROUP BY doc_id)
 SELECT s.doc_id, len(s.shingles) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id{columns} FROM s LEFT JOIN m ON m.doc_id = s.doc_id"""


NEAR_DUPLICATES = linked(4, 80, ", s.doc_id <= coalesce(m.low, s.doc_id) AS kept")
NGRAM_JOIN = linked(3, 90, "")

_LETTER_RUNS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
DECONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_LETTER_RUNS.format("text")} AS words FROM documents),
 i AS (SELECT DISTINCT item_id, text FROM benchmark), iw AS (SELECT item_id, {_LETTER_RUNS.format("text")} AS words FROM i),
 iz AS MATERIALIZED (SELECT row_number() OVER () AS k, item_id, least(5, len(words)) AS width, words FROM iw WHERE len(words) > 0),
 s AS MATERIALIZED (SELECT k, item_id, width, {shingles("words", "width")} AS shingles FROM iz),
 iu AS (SELECT k, width, unnest(shingles) AS g FROM s),
 du AS (SELECT DISTINCT r, width, g FROM (SELECT r, width, unnest({shingles("words", "width")}) AS g FROM d, (SELECT DISTINCT width FROM s) v WHERE len(words) >= width) x),
 h AS (SELECT r, k, count(*) AS n_both FROM du JOIN iu ON du.g = iu.g AND du.width = iu.width GROUP BY 1, 2)
 SELECT d.doc_id, s.item_id, len(s.shingles) AS n_item, n_both AS n_shared, n_both / len(s.shingles) AS containment FROM h JOIN s ON s.k = h.k JOIN d ON d.r = h.r WHERE 100 * n_both >= 80 * len(s.shingles)"""

_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STOCK = (
    "all rights reserved", "click here", "read more", "sign in", "sign up", "log in", "privacy policy", "terms of use", "terms of service", "cookie",
    "javascript", "subscribe to", "follow us", "share this", "lorem ipsum", "skip to content", "back to top", "powered by", "copyright ©",
)
_MARKS = ("|", ">", ">>", "»", "›", "·", "•", "/", "::", "-", "–")
_ENDS = ".!?…\"''»”’):;"
QUALITY = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 b AS MATERIALIZED (SELECT r, doc_id, t, {WORDS.format("t")} AS words FROM d),
 g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS times FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM b) x),
 rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) o WHERE times > 1 GROUP BY r),
 lines AS MATERIALIZED (SELECT r, line, regexp_extract_all(line, '[^{_BLANK}]+') AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) x),
 dup AS (SELECT r, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) x GROUP BY r),
 v AS (SELECT r, len(lw) AS n, len(list_filter(lw, lambda w: w IN ({", ".join(f"'{m}'" for m in _MARKS)}))) AS marks, lower(line) AS low, line, lw,
   length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols FROM lines WHERE len(lw) > 0),
 q AS (SELECT r, n, CASE WHEN (marks >= 3 AND 5 * marks >= n) OR (marks > 0 AND marks * 2 >= n) THEN 'navigation'
   WHEN n <= 25 AND ({" OR ".join(f"contains(low, '{p}')" for p in _STOCK)}) THEN 'boilerplate'
   WHEN symbols * 2 > n THEN 'symbols' WHEN n >= 4 AND upper(line) = line AND low <> line THEN 'capitals'
   WHEN n >= 8 AND 2 * len(list_filter(range(1, n), lambda i: lw[i] = lw[i + 1])) > n THEN 'repetition'
   WHEN NOT contains('{_ENDS}', right(lw[n], 1)) THEN 'punctuation' END AS fault FROM v),
 f AS (SELECT r, CAST(sum(n) AS BIGINT) AS before, CAST(sum(CASE WHEN fault IS NULL THEN n ELSE 0 END) AS BIGINT) AS after FROM q GROUP BY r),
 z AS (SELECT b.doc_id, len(words) AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(before, 0) AS before, coalesce(after, 0) AS after
   FROM b LEFT JOIN dup ON dup.r = b.r LEFT JOIN rep ON rep.r = b.r LEFT JOIN f ON f.r = b.r)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND after >= 0.5 * before AS kept, after AS n_words_left FROM z"""

#: Every order is played through: a step removes what fails its filter and passed those before it.
FILTER_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
 lab AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
 c AS MATERIALIZED (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
 l AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
 o AS (SELECT [p.x, q.x, r.x, s.x, t.x] AS ord FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
 st AS MATERIALIZED (SELECT ord, step, ord[step] AS own, ord[:step - 1] AS earlier FROM o, (SELECT x AS step FROM l) y),
 u AS MATERIALIZED (SELECT part, ord, step, own, CAST(sum(CASE WHEN NOT gone AND NOT fails[own] THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND fails[own] THEN n ELSE 0 END) AS BIGINT) AS removed,
   CAST(sum(CASE WHEN gone AND fails[own] THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails[own] AND len(list_filter(fails, lambda b: b)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
   CAST(sum(CASE WHEN NOT gone AND fails[own] AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND fails[own] AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
   FROM (SELECT c.*, st.*, len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone FROM c, st) z GROUP BY ALL)
 SELECT part, array_to_string(list_transform(ord, lambda i: 'ABCDE'[i]), '') AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM u"""


def _encoded(field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN '-' ELSE strlen(CAST({field} AS VARCHAR)) || ':' || CAST({field} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_encoded, ['doc_id', 'source', 'lang', 'n_chars']))} || {_encoded(text)})"


#: Levels of a tree group the ranks of the level before by threes; a path follows each leaf up, through the tree on top.
MERKLE = f"""WITH RECURSIVE bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
 crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
 d AS MATERIALIZED (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS bare,
   xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a >> 8, t[1 + xor(a, x) % 256]), 4294967295), 4294967295) AS crc FROM documents, crc),
 p AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN crc % 2 = 0 THEN bare ELSE leaf END AS claimed, dense_rank() OVER (ORDER BY source IS NOT NULL, CAST(source AS VARCHAR)) - 1 AS s,
   row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i FROM d),
 up(s, lvl, i, h, n) AS (SELECT s, 0, i, leaf, count(*) OVER (PARTITION BY s) FROM p
   UNION ALL SELECT s, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY s, lvl, i // 3),
 low AS MATERIALIZED (SELECT s, lvl, i, h, n FROM up),
 top(lvl, i, h, n) AS (SELECT 0, s, h, count(*) OVER () FROM low WHERE n = 1
   UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, i // 3),
 nodes AS MATERIALIZED (SELECT s, lvl, i, h, n FROM low UNION ALL SELECT -1, lvl, i, h, n FROM top),
 runs AS MATERIALIZED (SELECT s, lvl, i // 3 AS run, list(h ORDER BY i) AS hs, max(n) AS n FROM nodes GROUP BY ALL),
 walk(id, s, lvl, i, v, proof, leafy, at_root) AS (SELECT row_number() OVER (ORDER BY s, i), s, 0, i, claimed, '', true, false FROM p
   UNION ALL SELECT id, CASE WHEN r.n = 1 THEN -1 ELSE w.s END, CASE WHEN r.n = 1 THEN 0 ELSE w.lvl + 1 END, CASE WHEN r.n = 1 THEN w.s ELSE w.i // 3 END,
    CASE WHEN r.n = 1 THEN v ELSE sha256(array_to_string(hs[:w.i % 3], '') || v || array_to_string(hs[w.i % 3 + 2:], '')) END,
    CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(hs[:w.i % 3], '') || array_to_string(hs[w.i % 3 + 2:], '') END, false, r.n = 1 AND w.s = -1
   FROM walk w JOIN runs r ON r.s = w.s AND r.lvl = w.lvl AND r.run = w.i // 3 WHERE NOT at_root),
 ends AS (SELECT id, v, proof FROM walk WHERE at_root), ids AS (SELECT row_number() OVER (ORDER BY s, i) AS id, * FROM p)
 SELECT doc_id, leaf, b.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = root.h AS verified
 FROM ids JOIN ends ON ends.id = ids.id JOIN low b ON b.s = ids.s AND b.n = 1, (SELECT h FROM top WHERE n = 1) root"""

ORACLE_SQL = {"op5_line_quality": QUALITY, "op8_decontamination": DECONTAMINATION, "op10_near_duplicates": NEAR_DUPLICATES, "op11_ngram_join": NGRAM_JOIN, "op12_filter_audit": FILTER_AUDIT, "op13_merkle_manifest": MERKLE}
