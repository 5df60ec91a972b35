"""The registered queries as DuckDB SQL over the same tables; written by hand, no value is shared with the operators."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

EV = """ev AS (
  SELECT event_id AS id, ts AS timestamp,
    CASE event_id % 3 WHEN 0 THEN 'USER' WHEN 1 THEN 'AGENT' ELSE 'SYSTEM' END AS actor,
    CASE event_type WHEN 'signup' THEN 'PLANT' WHEN 'purchase' THEN 'ADD' WHEN 'error' THEN 'REMOVE' WHEN 'click' THEN 'UPDATE' ELSE 'OBSERVE' END AS action,
    user_id AS object_id, value AS d_value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS d_k,
    CAST(0.5 + (event_id % 50) / 100.0 AS DOUBLE) AS confidence,
    CAST(CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS authority,
    CAST(1.0 AS DOUBLE) AS freshness, CAST(user_id % 4 AS DOUBLE) AS corroboration,
    CASE event_type WHEN 'signup' THEN 'identity' WHEN 'purchase' THEN 'fact' WHEN 'view' THEN 'preference' WHEN 'click' THEN 'event' ELSE 'prediction' END AS memory_type
  FROM events)"""


def score(c="confidence", a="authority", f="freshness", r="corroboration") -> str:
    return f"(1e0 * {c} + 1.2e0 * {a} + 0.8e0 * {f} + 0.6e0 * ln(1e0 + {r}))"


def days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 8.64e10)"


RATE = "(CASE memory_type WHEN 'fact' THEN 0.001e0 WHEN 'preference' THEN 0.01e0 WHEN 'event' THEN 0.1e0 WHEN 'prediction' THEN 0.5e0 WHEN 'identity' THEN 0e0 ELSE 0.02e0 END)"


def fresh(base: str, d: str) -> str:
    return f"(CASE WHEN {RATE} = 0 THEN 1e0 ELSE greatest(0.01e0, {base} * exp(-{RATE} * {d})) END)"


def segmented(source: str, name: str = "seg") -> str:
    """CTEs that mark resets and segments of rows (object_id, key, timestamp, id, action, num)."""
    return f"""{name}_a AS (
  SELECT *, CASE WHEN num IS NULL OR lag(num) OVER w IS NULL OR action IN ('UPDATE', 'OBSERVE', 'INFER') THEN 1 ELSE 0 END AS reset
  FROM {source} WINDOW w AS (PARTITION BY object_id, key ORDER BY timestamp, id)
), {name} AS (
  SELECT *, CASE WHEN reset = 1 THEN num WHEN action = 'REMOVE' THEN -num ELSE num END AS part,
    CAST(sum(reset) OVER (PARTITION BY object_id, key ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
  FROM {name}_a
)"""


def folded(source: str, name: str = "st") -> str:
    return f"""{segmented(source, name + "_seg")}, {name} AS (
  SELECT object_id, key, sum(part) AS num FROM {name}_seg
  WHERE (object_id, key, segment) IN (SELECT object_id, key, max(segment) FROM {name}_seg GROUP BY ALL) GROUP BY ALL
)"""


VAL = "val AS (SELECT object_id, 'value' AS key, timestamp, id, action, d_value AS num FROM ev)"
HEADS = "heads AS (SELECT object_id, count(*) AS version, arg_max(id, (timestamp, id)) AS last_event_id, max(timestamp) AS updated_at, arg_max(confidence, (timestamp, id)) AS confidence, arg_max(authority, (timestamp, id)) AS authority, arg_max(freshness, (timestamp, id)) AS freshness, arg_max(corroboration, (timestamp, id)) AS corroboration FROM ev GROUP BY 1)"

SNAP = f"""{segmented("val", "sn_seg")}, line AS (
  SELECT *, sum(part) OVER (PARTITION BY object_id, key, segment ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS state FROM sn_seg
), snaps AS (
  SELECT object_id, timestamp, id, state AS num FROM (SELECT *, row_number() OVER (PARTITION BY object_id, CAST(timestamp AS DATE) ORDER BY timestamp DESC, id DESC) AS n FROM line) WHERE n = 1
)"""

ISLANDS = f"""isl_a AS (
  SELECT *, CASE WHEN lag(actor) OVER w IS NOT DISTINCT FROM actor AND lag(action) OVER w IS NOT DISTINCT FROM action AND (lag(d_k) OVER w IS NULL) = (d_k IS NULL) THEN 0 ELSE 1 END AS c
  FROM ev WHERE timestamp > {AS_OF} - INTERVAL 30 DAY WINDOW w AS (PARTITION BY object_id ORDER BY timestamp, id)
), isl AS (
  SELECT *, sum(c) OVER (PARTITION BY object_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS island FROM isl_a
), runs AS (
  SELECT object_id, island, any_value(actor) AS actor, any_value(action) AS action, count(*) AS n, arg_min(id, (timestamp, id)) AS first_id, arg_max(id, (timestamp, id)) AS last_id,
    sum(d_value) AS total, arg_max(d_value, (timestamp, id)) AS last_value, CAST(sum(d_k) AS DOUBLE) AS total_k, CAST(arg_max(d_k, (timestamp, id)) AS DOUBLE) AS last_k, max(timestamp) AS last_ts, string_agg(CAST(id AS VARCHAR), ',' ORDER BY timestamp, id) AS antecedents, arg_min(confidence, (timestamp, id)) AS confidence
  FROM isl GROUP BY ALL HAVING count(*) > 1
)"""

CUSTOMER_STATES = """cs AS (
  SELECT c_custkey AS id, greatest(0e0, least(1e0, (c_acctbal + 1e3) / 1.1e4)) AS authority, la AS last_accessed, coalesce(n, 0) AS access_count
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS la, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
), latest AS (SELECT max(o_orderdate) + INTERVAL 1 DAY AS t FROM orders
), scored AS (
  SELECT id, authority, last_accessed, access_count, t, 0.5e0 * greatest(0e0, 1e0 - floor(epoch_us(t) / 8.64e10 - epoch_us(coalesce(last_accessed, t)) / 8.64e10) / 90e0) + 0.3e0 * authority
    + 0.2e0 * least(1e0, ln(access_count + 1e0) / ln(100e0)) AS prune_score FROM cs, latest
)"""

REL = """rel AS (
  SELECT 'S' || s_suppkey AS source_id, 'N' || s_nationkey AS target_id, 'part_of' AS relation_type, 0.9e0 AS confidence FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'part_of', 0.8e0 FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'located_in', 0.95e0 FROM customer)"""

SPANS = f"""{segmented("val", "sp_seg")}, sp_line AS (
  SELECT *, sum(part) OVER (PARTITION BY object_id, segment ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS state FROM sp_seg
), spans AS (
  SELECT object_id, value, timestamp AS valid_from, lead(timestamp) OVER (PARTITION BY object_id ORDER BY timestamp) AS valid_to
  FROM (SELECT object_id, timestamp, arg_max(state, id) AS value FROM sp_line GROUP BY ALL))"""

LINKS = """links AS (
  SELECT a.id AS s, b.id AS t, a.confidence AS c, CASE WHEN b.action = 'REMOVE' THEN 'caused' ELSE 'happened_before' END AS kind
  FROM ev a JOIN ev b ON a.object_id = b.object_id AND (a.timestamp, a.id) < (b.timestamp, b.id) AND epoch_us(b.timestamp) - epoch_us(a.timestamp) <= 43200000000)"""


def chained(kind: str, hops: int, least: str, implied: str) -> str:
    return f"""way AS (
  SELECT s AS start, t AS goal, [s, t] AS path, c AS confidence FROM links WHERE kind = '{kind}' AND c >= {least}
  UNION ALL
  SELECT start, t, list_append(path, t), confidence * c FROM way JOIN links ON goal = s WHERE kind = '{kind}' AND len(path) <= {hops} AND confidence * c >= {least} AND NOT list_contains(path, t)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY round(confidence, 12) DESC, len(path), path) AS n FROM way
), chain AS (
  SELECT start AS source_id, goal AS target_id, CASE WHEN len(path) = 2 THEN '{kind}' ELSE '{implied}' END AS relation_type, len(path) - 1 AS hops, array_to_string(path, '>') AS path, round(confidence, 6) AS confidence, len(path) > 2 AS is_inferred FROM best WHERE n = 1)"""


CENTERS = """v AS (SELECT vec_id AS id, label AS domain, vec_id // 100 AS win, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
), x AS (SELECT domain, win, pos, sum(vec[pos]) AS total, count(*) AS n FROM v, range(1, 65) AS p(pos) WHERE pos <= len(vec) GROUP BY ALL
), y AS (SELECT *, sum(total) OVER w AS past, sum(n) OVER w AS past_n FROM x WINDOW w AS (PARTITION BY domain, pos ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), centers AS (SELECT domain, win, max(n) AS n, list(total / n ORDER BY pos) AS now, list(past / past_n ORDER BY pos) FILTER (WHERE past_n > 0) AS before FROM y GROUP BY ALL)"""

OEDGE = """oe AS (
  SELECT CAST(o_custkey AS VARCHAR) AS source_id, o_orderpriority AS target_id, CAST(o_orderkey % 100 / 1e2 AS DOUBLE) AS confidence, o_orderkey % 2 = 0 AS is_inferred, o_orderstatus AS k, CAST(o_orderkey AS VARCHAR) AS v, o_orderkey AS ord FROM orders)"""

DUPS = """hits AS (
  SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS whole, round(whole, 5) AS similarity
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35
), top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(whole, 12) DESC, CASE WHEN left_id = right_id THEN 0 ELSE 1 END, right_id) AS n FROM hits) WHERE n <= 5 AND left_id <> right_id
), dups AS (
  SELECT left_id, right_id, whole, similarity, greatest(left_id, right_id) AS source_id, least(left_id, right_id) AS target_id, printf('Vector similarity %.4f', whole) AS reason FROM top
)"""

ASKED = "asked AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 20 = 0)"
MEM = """mem AS (
  SELECT doc_id AS id, text, lang AS namespace, CAST(0.5 + (doc_id % 50) / 100.0 AS DOUBLE) AS confidence, CASE WHEN doc_id % 2 = 0 THEN 1e0 ELSE 0.5e0 END AS authority FROM documents
), held AS (
  SELECT DISTINCT id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+')) AS word FROM mem
), words AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(coalesce(query, '')), '[\\x20\\x09-\\x0D]+')) AS word FROM asked
), sizes AS (SELECT query_id, count(*) AS n FROM words WHERE word <> '' GROUP BY 1
), rel_k AS (SELECT query_id, id, count(*) / CAST(n AS DOUBLE) AS relevance FROM held JOIN words USING (word) JOIN sizes USING (query_id) WHERE word <> '' GROUP BY query_id, id, n)"""

ST = """st AS (
  SELECT event_id AS id, user_id AS namespace, event_id AS ord, ts AS timestamp, CASE WHEN event_id % 5 = 0 THEN 'agent' ELSE 'user' END AS source, event_id % 12 AS kind, k,
    CASE event_id % 12 WHEN 0 THEN 'I am from Town' || k || ' and I like tea ' || k || '.' WHEN 1 THEN 'My favorite colour is shade ' || k || '!' WHEN 2 THEN 'I hate rain on day ' || k
      WHEN 3 THEN 'I always walk, call me P' || k WHEN 4 THEN 'He stopped work at Firm' || k WHEN 5 THEN 'I''m employed at Firm' || k || ', based in Town' || k
      WHEN 6 THEN 'I usually enjoy nothing unlike part ' || k WHEN 7 THEN 'I prefer number ' || k || ' of the very long list of things that nobody in this town has ever heard of.'
      WHEN 8 THEN 'I live in Town' || k || '. They aren''t here.' WHEN 9 THEN 'Mail a' || k || '@x-' || k || '.org or see https://x' || k || '.org/a?b=1 from 10.0.' || k || '.7 on ' || strftime(ts, '%Y-%m-%d')
      WHEN 10 THEN 'I LOVE   quiet days!! ' ELSE 'Schedule a meeting today, I like rain on day ' || k END AS text
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
), names AS (
  SELECT id, 'GPE' AS label, 'Town' || k AS value FROM st WHERE kind = 0 UNION ALL SELECT id, 'PERSON', 'P' || k FROM st WHERE kind = 3 UNION ALL SELECT id, 'ORG', 'Firm' || k FROM st WHERE kind = 4
  UNION ALL SELECT id, 'ORGANIZATION', 'Firm' || k FROM st WHERE kind = 5 UNION ALL SELECT id, 'LOCATION', 'Town' || k FROM st WHERE kind = 5 UNION ALL SELECT id, 'LOC', 'Town' || k FROM st WHERE kind = 8
)"""
EVERY = ST + """, every AS (
  SELECT 'conversation' AS kind, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'statement', id, text FROM st)"""
#: Relations of texts x(id, text) with names n(id, label, value).
STATED = """pref AS (
  SELECT id, regexp_replace(substr(text, CASE WHEN contains(low, 'like') THEN strpos(low, 'like') + 4 WHEN contains(low, 'prefer') THEN strpos(low, 'prefer') + 6
    WHEN contains(low, 'love') THEN strpos(low, 'love') + 4 ELSE strpos(low, 'enjoy') + 5 END), '^\\s+|\\s+$', '', 'g') AS o
  FROM (SELECT *, lower(text) AS low FROM x) WHERE contains(low, 'i like') OR contains(low, 'i prefer') OR contains(low, 'i love') OR contains(low, 'i enjoy')
), stated AS (
  SELECT id, 'PREFERS' AS relation, rtrim(o, '.!') AS object, 0.9e0 AS confidence FROM pref WHERE length(o) BETWEEN 1 AND 49
  UNION ALL SELECT id, 'HAS_NAME', value, 0.95e0 FROM x JOIN n USING (id) WHERE label = 'PERSON' AND regexp_matches(lower(text), 'my name is|i am |i''m |call me ')
  UNION ALL SELECT id, 'WORKS_AT', value, 0.9e0 FROM x JOIN n USING (id) WHERE label IN ('ORG', 'ORGANIZATION') AND regexp_matches(lower(text), 'work at|work for|working at|employed at|job at')
  UNION ALL SELECT id, 'LOCATED_IN', value, 0.85e0 FROM x JOIN n USING (id) WHERE label IN ('GPE', 'LOC', 'LOCATION') AND regexp_matches(lower(text), 'live in|from |based in|located in')
)"""
MAIL = "[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+"
LINK = "https?://[^\\s\\x0B]+"
ADDRESS = "\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b"
NATURAL = """the and of to a in that is was he for it with as his on be at by i this had not are but from or have an they which one you were her all she there would their we him been has
when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any my now"""


def route_sql() -> str:
    known = "[" + ", ".join(f"'{a}'" for a in NATURAL.split()) + "]"
    return f"""WITH {EVERY}, w AS (SELECT kind, id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM every
), c AS (SELECT kind, id, word, count(*) AS n FROM (SELECT kind, id, unnest(ws) AS word FROM w) GROUP BY ALL
), cosv AS (SELECT kind, id, coalesce(sum(n) FILTER (WHERE list_contains({known}, word)), 0) / (sqrt(sum(n * n)) * sqrt({len(NATURAL.split())}e0)) AS cosine FROM c GROUP BY ALL
), m AS (SELECT w.kind, w.id, text, coalesce(cosine, 0e0) AS cosine, length(regexp_replace(text, '[^0-9]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) AS ratio FROM w LEFT JOIN cosv USING (kind, id))
SELECT kind, id, CASE WHEN length(text) < 40 OR ratio > 0.4 OR contains(substr(text, 1, 50), 'INFO') OR contains(substr(text, 1, 50), 'WARN') OR contains(substr(text, 1, 50), 'ERROR') OR contains(substr(text, 1, 50), 'Exception') THEN 'TRIVIAL'
  WHEN length(text) < 200 AND (regexp_matches(text, '{MAIL}') OR regexp_matches(text, '{LINK}')) THEN 'STRUCTURED'
  WHEN cosine > 0.1 THEN 'NATURAL' ELSE 'COMPLEX' END AS route, round(ratio, 6) AS digit_ratio FROM m"""


def scanned(pairs: str) -> str:
    """CTEs of the greedy scan: one step per pair in scan order, with the list of what is done with."""
    return f"""ordered AS (SELECT *, row_number() OVER (ORDER BY left_id, whole DESC, right_id) AS n FROM {pairs}
), walk(n, done, cur, open, emits) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT), false, false
  UNION ALL SELECT n, CASE WHEN op AND NOT list_contains(done, right_id) THEN list_concat(done, [source_id, target_id]) ELSE done END, left_id, op, op AND NOT list_contains(done, right_id)
  FROM (SELECT o.*, w.done, CASE WHEN w.cur = o.left_id THEN w.open ELSE NOT list_contains(w.done, o.left_id) END AS op FROM walk w JOIN ordered o ON o.n = w.n + 1)
), emitted AS (SELECT o.* FROM walk w JOIN ordered o ON o.n = w.n WHERE w.emits)"""


def word_in(alternatives: str) -> str:
    return f"regexp_matches(lower(coalesce(text, '')), '(^|[^\\pL\\pN_])({alternatives})($|[^\\pL\\pN_])')"


MULTI = f"WITH {EV}, rows_ AS (SELECT object_id, 'value' AS key, timestamp, id, action, d_value AS num FROM ev UNION ALL SELECT object_id, 'k', timestamp, id, action, CAST(d_k AS DOUBLE) FROM ev WHERE d_k IS NOT NULL), {folded('rows_')} SELECT object_id, key, round(num, 4) AS value FROM st"


def oracle_sql() -> dict[str, str]:
    after = days(AS_OF, "timestamp")
    classify = f"""CASE WHEN {word_in("i am|i''m|i live in|my name is")} THEN 'identity' WHEN {word_in("i prefer|my favorite|i like|i always|i usually")} THEN 'preference' ELSE 'event' END"""
    found = " UNION ALL ".join(f"SELECT id, {k} AS k, '{label}' AS label, unnest(regexp_extract_all(text, '{p}')) AS value FROM t" for k, (label, p) in enumerate([("EMAIL", MAIL), ("URL", LINK), ("IP", ADDRESS)]))
    contradiction = """, m AS (SELECT namespace, id, ord, lower(text) AS t FROM said
), asks AS (SELECT * FROM m WHERE contains(t, 'not ') OR contains(t, 'don''t') OR contains(t, 'hate')
), p AS (SELECT namespace, id, ord, trim(replace(t, 'hate', 'like')) AS p FROM asks WHERE contains(t, 'hate') UNION ALL SELECT namespace, id, ord, trim(replace(t, 'don''t', '')) FROM asks WHERE contains(t, 'don''t') UNION ALL SELECT namespace, id, ord, trim(replace(t, 'not', '')) FROM asks WHERE contains(t, 'not'))
SELECT p.namespace, p.id, arg_min(m.id, (m.ord, m.id)) AS other_id FROM p JOIN m ON m.namespace = p.namespace AND m.ord < p.ord AND (contains(m.t, p.p) OR contains(p.p, m.t)) GROUP BY ALL"""
    early = "timestamp <= TIMESTAMP '2024-01-30 12:00:00'"
    told = f"{ST}, told AS (SELECT id, ord, timestamp, source, namespace || '-' || kind AS object_id, kind, text, CAST(0.5 + (id % 50) / 100.0 AS DOUBLE) AS confidence, CASE WHEN source = 'user' THEN 0.9e0 ELSE 0.5e0 END AS authority FROM st)"
    out = {
        "truth_score": f"WITH {EV} SELECT id, round({score()}, 6) AS score FROM ev",
        "freshness_decay": f"WITH {EV} SELECT id, memory_type, round({fresh('freshness', after)}, 6) AS freshness FROM ev",
        "legacy_decay": f"WITH {EV} SELECT id, round(greatest(0.01e0, confidence * exp(-(CASE memory_type WHEN 'identity' THEN 0.0005e0 WHEN 'preference' THEN 0.005e0 ELSE 0.02e0 END) * {after})), 6) AS importance FROM ev",
        "decay_curve": f"WITH {EV} SELECT memory_type, day, round({fresh('1e0', 'day')}, 6) AS freshness FROM (SELECT DISTINCT memory_type FROM ev), (SELECT CAST(range AS BIGINT) AS day FROM range(0, 101, 10))",
        "merge_truth_vectors": f"WITH {EV} SELECT object_id, max(authority) AS authority, max(freshness) AS freshness, sum(corroboration) + count(*) - 1 AS corroboration, round(list_reduce(list(confidence ORDER BY timestamp, id), lambda x, y: (x * x + y * y) / (x + y)), 6) AS confidence FROM ev GROUP BY 1",
        "state_fold": f"WITH {EV}, {VAL}, {HEADS}, {folded('val')} SELECT object_id, round(num, 4) AS value, version, last_event_id, round({score()}, 6) AS score FROM st JOIN heads USING (object_id)",
        "state_fold_multi_key": MULTI,
        "state_fold_runs": MULTI,
        "state_timeline_runs": f"WITH {EV}, {VAL}, {segmented('val')} SELECT id, object_id, round(sum(part) OVER (PARTITION BY object_id, key, segment ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING), 4) AS value FROM seg",
        "snapshot_before_event": f"WITH {EV}, {VAL}, {SNAP} SELECT e.id, e.object_id, s.id AS snapshot_id, round(s.num, 4) AS value FROM ev e ASOF LEFT JOIN snaps s ON e.object_id = s.object_id AND e.timestamp > s.timestamp",
        "late_routes": f"""WITH {EV}, r AS (SELECT id, action, CASE WHEN id % 50 = 0 THEN 1100e0 WHEN id % 7 = 0 THEN 180e0 ELSE 0e0 END AS late FROM ev)
SELECT CASE WHEN late <= 30 THEN 'accept' WHEN late <= 365 THEN 'approve' ELSE 'reject' END AS route, action, count(*) AS n, min(id) AS first_id, max(late) AS most_late FROM r GROUP BY 1, 2""",
        "state_timeline": f"WITH {EV}, {VAL}, {segmented('val')} SELECT id, object_id, segment, round(sum(part) OVER (PARTITION BY object_id, key, segment ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING), 4) AS value FROM seg",
        "state_as_of": f"WITH {EV}, {VAL}, early AS (SELECT * FROM val WHERE timestamp <= TIMESTAMP '2024-01-15 00:00:00'), {folded('early')} SELECT object_id, round(num, 4) AS value FROM st",
        "replay_verify": f"""WITH {EV}, {VAL}, early AS (SELECT * FROM val WHERE {early}), {folded('early', 'a')}, {folded('val', 'b')}, t1 AS (SELECT object_id, arg_max(memory_type, (timestamp, id)) AS t FROM ev WHERE {early} GROUP BY 1), t2 AS (SELECT object_id, arg_max(memory_type, (timestamp, id)) AS t FROM ev GROUP BY 1)
SELECT coalesce(a.object_id, b.object_id) AS object_id, coalesce(a.key, b.key) AS key, round(a.num, 4) AS expected, round(b.num, 4) AS actual, CAST(NULL AS VARCHAR) AS expected_raw, CAST(NULL AS VARCHAR) AS actual_raw FROM a FULL JOIN b ON a.object_id = b.object_id AND a.key = b.key WHERE a.num IS NULL OR b.num IS NULL OR abs(a.num - b.num) > 1e-4
UNION ALL SELECT object_id, 'type', NULL, NULL, '"' || t1.t || '"', '"' || t2.t || '"' FROM t1 FULL JOIN t2 USING (object_id) WHERE t1.t IS DISTINCT FROM t2.t""",
        "late_event_repair": f"WITH {EV}, {VAL}, {folded('val')} SELECT object_id, round(num, 4) AS value, CASE WHEN object_id IN (SELECT object_id FROM ev WHERE action = 'ADD') THEN 'repaired' ELSE 'kept' END AS status FROM st",
        "snapshot_latest": f"WITH {EV}, {VAL}, {SNAP} SELECT object_id, arg_max(id, (timestamp, id)) AS last_event_id, round(arg_max(num, (timestamp, id)), 4) AS value FROM snaps WHERE timestamp < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1",
        "snapshot_tail_replay": f"WITH {EV}, {VAL}, {folded('val')} SELECT object_id, round(num, 4) AS value FROM st",
        "snapshot_retention": f"""WITH {EV}, {VAL}, {SNAP}, aged AS (SELECT *, {after} AS age FROM snaps), tiers AS (
  SELECT *, CASE WHEN age <= 1 THEN 'all' WHEN age <= 7 THEN 'day' WHEN age <= 30 THEN 'week' ELSE 'month' END AS tier,
    CASE WHEN age <= 1 THEN timestamp WHEN age <= 7 THEN date_trunc('day', timestamp) WHEN age <= 30 THEN date_trunc('week', timestamp) ELSE date_trunc('month', timestamp) END AS slot FROM aged
), kept AS (SELECT *, row_number() OVER (PARTITION BY object_id, tier, slot ORDER BY timestamp DESC, id DESC) AS n FROM tiers)
SELECT object_id, tier, count(*) AS kept, max(id) AS newest_id FROM kept WHERE n = 1 GROUP BY ALL""",
        "snapshot_hash": f"WITH {EV}, {VAL}, {folded('val')} SELECT object_id, sha256(object_id || '|' || key || '|' || CAST(CAST(round(num * 100) AS BIGINT) AS VARCHAR)) AS state_hash FROM st",
        "transfer_expand": "WITH moved AS (SELECT -1 - l_suppkey AS object_id, -l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey), known AS (SELECT c_custkey AS object_id FROM customer UNION ALL SELECT -1 - s_suppkey FROM supplier) SELECT object_id, round(coalesce(sum(q), 0e0), 2) AS balance FROM known LEFT JOIN moved USING (object_id) GROUP BY 1",
        "ancestry_fingerprint": f"WITH {EV} SELECT object_id, count(*) AS n_events, string_agg(CAST(id AS VARCHAR), ',' ORDER BY timestamp, id) AS chain, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR))) AS fingerprint FROM ev GROUP BY 1",
        "ancestry_running": f"WITH {EV} SELECT id, object_id, count(*) OVER (PARTITION BY object_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS chain_length FROM ev",
        "causal_ancestry": f"WITH {EV}, n AS (SELECT id, row_number() OVER (PARTITION BY object_id, CAST(timestamp AS DATE) ORDER BY timestamp, id) - 1 AS k FROM ev) SELECT id, k AS n_causes, k AS depth FROM n WHERE k > 0",
        "decay_update": f"""WITH {EV}, {HEADS}, k AS (SELECT object_id, arg_max(memory_type, (timestamp, id)) AS memory_type FROM ev GROUP BY 1), x AS (
  SELECT object_id AS id, memory_type, freshness AS old_freshness, {days(AS_OF, 'updated_at')} AS days FROM heads JOIN k USING (object_id)
), y AS (SELECT *, {fresh('old_freshness', 'days')} AS f FROM x)
SELECT id, memory_type, old_freshness, round(f, 4) AS new_freshness, f < 0.1 AS stale FROM y WHERE days >= 1 AND abs(f - old_freshness) >= 0.01""",
        "pruning_candidates": f"WITH {CUSTOMER_STATES} SELECT id, round(prune_score, 6) AS prune_score FROM scored WHERE prune_score < 0.3",
        "prune_apply": f"WITH {CUSTOMER_STATES} SELECT id, CASE WHEN prune_score < 0.3 THEN 'inactive' ELSE 'active' END AS status FROM scored",
        "consolidation_runs": f"WITH {EV}, {ISLANDS} SELECT object_id, actor, action, n, first_id, last_id FROM runs",
        "consolidation_summary": f"WITH {EV}, {ISLANDS} SELECT object_id, 'summary-' || first_id AS summary_id, 'SYSTEM' AS actor, action, n, round(total, 4) AS value, round(total_k, 4) AS k, antecedents, confidence FROM runs",
        "consolidation_replay_safe": f"WITH {EV}, {ISLANDS} SELECT 'summary-' || first_id AS summary_id, action, n, round(CASE WHEN action IN ('UPDATE', 'OBSERVE', 'INFER') THEN last_value ELSE total END, 4) AS value, round(CASE WHEN action IN ('UPDATE', 'OBSERVE', 'INFER') THEN last_k ELSE total_k END, 4) AS k FROM runs",
        "consolidation_apply": f"WITH {EV}, {ISLANDS} SELECT CAST(ev.id AS VARCHAR) AS id, ev.object_id, ev.actor, ev.action, round(ev.d_value, 4) AS value, round(CAST(ev.d_k AS DOUBLE), 4) AS k, CAST(0 AS BIGINT) AS antecedents, 'summary-' || first_id AS consolidated_into FROM ev LEFT JOIN isl ON isl.id = ev.id LEFT JOIN runs ON runs.object_id = isl.object_id AND runs.island = isl.island UNION ALL SELECT 'summary-' || first_id, object_id, 'SYSTEM', action, round(total, 4), round(total_k, 4), n, NULL FROM runs",
        "consolidation_saving": f"WITH {EV}, {ISLANDS} SELECT count(*) AS runs, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS saved FROM runs",
        "entity_active": "SELECT c_custkey AS id, c_mktsegment AS entity_type, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
        "duplicate_pairs": f"WITH {DUPS} SELECT left_id, right_id, similarity, source_id, target_id, reason FROM dups",
        "merge_apply": f"""WITH RECURSIVE {DUPS}, best AS (SELECT source_id, arg_max(target_id, (whole, -target_id)) AS target_id FROM dups GROUP BY 1
), walk(id, cur, n) AS (SELECT vec_id, vec_id, 0 FROM embeddings UNION ALL SELECT id, target_id, n + 1 FROM walk JOIN best ON source_id = cur)
SELECT e.vec_id AS id, b.target_id AS merged_into, c.cur AS canonical_id FROM embeddings e LEFT JOIN best b ON b.source_id = e.vec_id JOIN (SELECT id, arg_max(cur, n) AS cur FROM walk GROUP BY 1) c ON c.id = e.vec_id""",
        "bool_flip": f"WITH {EV}, x AS (SELECT id, object_id, CAST(d_value > 100 AS VARCHAR) AS now, lag(CAST(d_value > 100 AS VARCHAR)) OVER (PARTITION BY object_id ORDER BY timestamp, id) AS was FROM ev) SELECT id, object_id, was, now FROM x WHERE was <> now",
        "text_contradiction": "WITH said AS (SELECT conv_id AS namespace, conv_id * 1000 + turn AS id, turn AS ord, text FROM conversations)" + contradiction,
        "conflict_winner": f"WITH {EV}, x AS (SELECT *, round({score('confidence', 'CASE WHEN actor = ’USER’ THEN 1e0 ELSE 0.5e0 END', '1e0', '0e0')}, 6) AS score FROM ev), y AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, timestamp, id) AS n FROM x) SELECT object_id, id, round(d_value, 4) AS value, score FROM y WHERE n = 1".replace("’", "'"),
        "conflict_log": f"WITH {EV}, x AS (SELECT *, round({score('confidence', 'CASE WHEN actor = ’USER’ THEN 1e0 ELSE 0.5e0 END', '1e0', '0e0')}, 6) AS score FROM ev), y AS (SELECT *, max(score) OVER (PARTITION BY object_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x) SELECT id, object_id, score, b IS NULL OR score > b AS accepted FROM y".replace("’", "'"),
        "conflict_precedence": f"WITH {EV}, y AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY authority DESC, timestamp DESC, corroboration DESC, id DESC) AS n FROM ev) SELECT object_id, id, round(d_value, 4) AS value FROM y WHERE n = 1",
        "integrity_violations": f"WITH {EV}, {VAL}, {folded('val')} SELECT object_id, key, round(num, 4) AS value FROM st WHERE num < 0",
        "burst_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 15",
        "relation_upsert": f"WITH {OEDGE} SELECT source_id, target_id, round(arg_max(confidence, ord), 6) AS confidence, arg_min(is_inferred, ord) AS is_inferred, min(ord) AS created_ord, max(ord) AS confirmed_ord, count(*) AS writes, arg_max(v, ord) FILTER (WHERE k = 'F') AS meta_f FROM oe GROUP BY 1, 2",
        "neighbors_both": f"WITH {REL}, nodes AS (SELECT 'N' || n_nationkey AS node FROM nation) SELECT node, target_id AS neighbor, 'out' AS direction, relation_type, confidence FROM nodes JOIN rel ON node = source_id UNION ALL SELECT node, source_id, 'in', relation_type, confidence FROM nodes JOIN rel ON node = target_id AND source_id <> target_id",
        "shortest_path": f"""WITH RECURSIVE {REL}, pairs AS (SELECT DISTINCT 'S' || s_suppkey AS start, 'R' || n_regionkey AS goal FROM supplier JOIN nation ON s_nationkey = n_nationkey
), walk(start, node, path, hops) AS (SELECT DISTINCT start, start, start, 0 FROM pairs UNION ALL SELECT start, target_id, path || '>' || target_id, hops + 1 FROM walk JOIN rel ON source_id = node WHERE hops < 3)
SELECT start, goal, CAST(min(hops) AS BIGINT) AS hops, arg_min(path, (hops, path)) AS path FROM pairs JOIN walk USING (start) WHERE node = goal GROUP BY 1, 2""",
        "common_neighbors": f"WITH {REL}, x AS (SELECT target_id, min(source_id) AS a FROM rel WHERE source_id LIKE 'S%' GROUP BY 1), y AS (SELECT target_id, min(source_id) AS b FROM rel WHERE source_id LIKE 'C%' GROUP BY 1), pairs AS (SELECT a, b FROM x JOIN y USING (target_id)) SELECT DISTINCT a, b, r1.target_id AS neighbor FROM pairs JOIN rel r1 ON r1.source_id = a JOIN rel r2 ON r2.source_id = b AND r2.target_id = r1.target_id",
        "transitive_part_of": f"WITH {REL} SELECT x.source_id, y.target_id, round(max(x.confidence * y.confidence * 0.9e0), 6) AS confidence, true AS is_inferred FROM rel x JOIN rel y ON x.target_id = y.source_id WHERE x.relation_type = 'part_of' AND y.relation_type = 'part_of' GROUP BY 1, 2",
        "inverse_relations": f"WITH {REL} SELECT target_id AS source_id, CASE relation_type WHEN 'part_of' THEN 'contains' ELSE 'location_of' END AS relation_type, count(*) AS n, round(max(confidence), 6) AS confidence FROM rel GROUP BY 1, 2",
        "single_location_conflicts": f"WITH {OEDGE} SELECT source_id, count(DISTINCT target_id) AS n_targets, arg_max(target_id, (confidence, target_id)) AS kept FROM oe GROUP BY 1 HAVING count(DISTINCT target_id) > 1",
        "keyword_recall": f"WITH {ASKED}, {MEM}, s AS (SELECT query_id, id, round(relevance, 6) AS relevance, round(0.6e0 * {score('confidence', 'authority', '1e0', '0e0')} + 0.4e0 * relevance, 6) AS score FROM rel_k JOIN mem USING (id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS total_found FROM s WHERE score >= 0.3) SELECT * FROM r WHERE rank <= 10",
        "vector_recall": """WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0
), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS k FROM n) WHERE k <= 20
), s AS (SELECT query_id, id, similarity, round(0.4e0 * CAST(0.5 + (id % 50) / 100.0 AS DOUBLE) + 0.3e0 * (CASE WHEN id % 2 = 0 THEN 1e0 ELSE 0.5e0 END) + 0.2e0 + 0.1e0 * similarity, 8) AS score FROM t
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
        "hybrid_recall": f"""WITH {ASKED}, {MEM}, n AS (SELECT query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity FROM (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0) a, embeddings b
), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS k FROM n) WHERE k <= 40
), w AS (SELECT * FROM (SELECT query_id, id, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 6) DESC, id) AS k FROM rel_k) WHERE k <= 20
), b AS (SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.id, w.id) AS id, similarity, relevance FROM v FULL JOIN w ON v.query_id = w.query_id AND v.id = w.id
), s AS (SELECT query_id, b.id, round(0.5e0 * coalesce(similarity, 0e0) + 0.2e0 * coalesce(relevance, 0e0) + 0.15e0 * coalesce(label / 4e0 / 12e0, 0e0) + 0.1e0 * coalesce(CASE WHEN namespace = 'en' THEN confidence END, 0.5e0)
    + 0.05e0 * (CASE WHEN mem.id IS NOT NULL AND namespace <> 'fr' THEN pow(0.99e0, floor(epoch({AS_OF}) / 86400e0 - (1700000000 + b.id * 3600) / 86400e0)) ELSE 0.5e0 END), 8) AS score
  FROM b LEFT JOIN embeddings ON vec_id = b.id LEFT JOIN mem ON mem.id = b.id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10""",
        "context_window": """WITH h AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rank, text, CASE role WHEN 'user' THEN '90' WHEN 'assistant' THEN '70' ELSE '50' END AS pc FROM conversations
), l AS (SELECT query_id, rank, rank || '. [' || pc || '% confidence] ' || text AS line FROM h
), u AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM l)
SELECT query_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY rank) AS context FROM u WHERE used <= 2000 GROUP BY 1""",
        "memory_health": f"WITH {EV}, x AS (SELECT *, {fresh('freshness', after)} AS f FROM ev), y AS (SELECT *, {score(f='f')} AS s FROM x) SELECT count(*) AS total, round(avg(s), 6) AS average_score, count(*) FILTER (WHERE s < 0.3) AS low_truth, count(*) FILTER (WHERE f < 0.2) AS stale, round(1 - (count(*) FILTER (WHERE s < 0.3) + count(*) FILTER (WHERE f < 0.2)) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS health FROM y",
        "classify_text": f"WITH {EVERY} SELECT kind, id, {classify} AS memory_type, {word_in("not|don''t|no longer|stopped|quit|isn''t|aren''t")} AS negated FROM every",
        "regex_entities": f"WITH {ST}, t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'p' || page_id, coalesce(url || ' ' || html, '') FROM pages UNION ALL SELECT 's' || id, text FROM st), f AS ({found}) SELECT id, arg_min(label, k) AS label, value, count(*) AS n FROM f GROUP BY id, value",
        "route_text": route_sql(),
        "ngram_profile": """WITH t AS (SELECT conv_id * 1000 + turn AS id, row_number() OVER () AS u, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM conversations
), p AS (SELECT id, u, w, unnest(range(1, len(w))) AS i FROM t WHERE len(w) >= 2), g AS (SELECT id, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM p GROUP BY ALL)
SELECT gram, count(*) AS texts, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1""",
        "relation_patterns": f"WITH {EVERY}, x AS (SELECT kind || id AS id, text FROM every), n AS (SELECT 'statement' || id AS id, label, value FROM names), {STATED} SELECT id, relation, object, confidence FROM stated",
        "hash_embedding": """WITH m AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), b AS (SELECT doc_id, list_transform(range(0, 16), lambda i: CAST('0x' || substr(h, CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER)) AS v FROM m)
SELECT doc_id, CAST(1536 AS BIGINT) AS dimensions, array_to_string(v, ',') AS bytes, round(96 * (list_sum(v) / 128e0 - 16), 6) AS total FROM b""",
        "ingest_validate": f"""WITH {EV} SELECT 'event' AS kind, CASE WHEN action = 'PLANT' THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN action = 'PLANT' THEN 'SOW' ELSE action END AS action, count(*) AS n, count(object_id) AS with_object FROM ev GROUP BY ALL
UNION ALL SELECT 'page', CASE WHEN octet_length(encode(html)) + 4 > 65536 THEN 'oversize' ELSE 'accepted' END, 'UPDATE', count(*), 0 FROM pages GROUP BY ALL""",
        "stream_state_fold": f"WITH {EV}, {VAL}, {folded('val')} SELECT object_id, round(num, 4) AS value FROM st",
        "trace_round_trip": f"WITH {EV}, {VAL}, {folded('val')} SELECT object_id, round(num, 4) AS value, true AS equal FROM st",
        "replay_verify_vectors": f"""WITH {EV}, h AS (SELECT *, {early} AS old FROM ev), u AS (SELECT object_id, old, timestamp, id, unnest(['confidence', 'authority', 'freshness', 'corroboration']) AS part, unnest([confidence, authority, freshness, corroboration]) AS v FROM h
), x AS (SELECT object_id, part, arg_max(v, (timestamp, id)) FILTER (WHERE old) AS expected, arg_max(v, (timestamp, id)) AS actual FROM u GROUP BY ALL) SELECT * FROM x WHERE expected IS NULL OR abs(expected - actual) > 1e-4""",
        "entity_provenance": f"WITH {EV} SELECT object_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY timestamp, id) AS chain FROM ev WHERE object_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY 1",
        "transaction_mixed": f"""WITH {EV}, e AS (SELECT *, action = 'UPDATE' AND id % 2 = 0 AS moves FROM ev WHERE true), rows_ AS (
  SELECT object_id, 'inventory' AS key, timestamp, id, action, d_value AS num FROM e WHERE NOT moves UNION ALL SELECT object_id, 'inventory', timestamp, id, 'REMOVE', d_value FROM e WHERE moves UNION ALL SELECT object_id + 1, 'inventory', timestamp, id, 'ADD', d_value FROM e WHERE moves
), known AS (SELECT * FROM rows_ WHERE object_id <= 100 AND object_id IN (SELECT object_id FROM ev)), {folded('known')} SELECT object_id, round(num, 4) AS value FROM st""",
        "events_created": f"WITH {EV} SELECT object_id, action, count(*) AS n, max(confidence) AS confidence, 1e0 AS authority, 0.75e0 AS freshness, min(CASE WHEN confidence > 0.6 THEN confidence ELSE 0.5e0 END) AS importance FROM ev GROUP BY 1, 2",
        "state_upsert": f"WITH {EV} SELECT object_id, arg_max(id, (timestamp, id)) AS last_event_id FROM ev WHERE object_id % 2 = 0 OR timestamp <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1",
        "prune_policy": f"WITH {CUSTOMER_STATES} SELECT id, round(prune_score, 6) AS prune_score FROM scored WHERE prune_score < 0.5 AND NOT (authority > 0.8 OR {days('t', 'last_accessed')} < 30)",
        "prune_recover": f"WITH {CUSTOMER_STATES} SELECT id, CASE WHEN prune_score < 0.3 AND id % 2 = 1 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN prune_score < 0.3 AND id % 2 = 0 THEN t ELSE last_accessed END AS last_accessed FROM scored",
        "prune_untrue": f"WITH {EV}, {HEADS} SELECT object_id, last_event_id FROM heads WHERE {score()} >= 3.5",
        "access_reinforced": f"WITH {CUSTOMER_STATES}, hits AS (SELECT o_custkey, max(o_orderdate + INTERVAL 3 DAY) AS hit, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) SELECT id, CASE WHEN n IS NULL THEN 0.25e0 ELSE 1e0 END AS freshness, greatest(last_accessed, hit) AS last_accessed, access_count + coalesce(n, 0) AS access_count FROM cs LEFT JOIN hits ON o_custkey = id",
        "consolidation_replay": f"""WITH {EV}, {ISLANDS}, merged AS (
  SELECT ev.object_id, ev.timestamp, CAST(ev.id AS VARCHAR) AS id, ev.action, ev.d_value AS v, CAST(ev.d_k AS DOUBLE) AS k FROM ev LEFT JOIN isl ON isl.id = ev.id LEFT JOIN runs ON runs.object_id = isl.object_id AND runs.island = isl.island WHERE runs.n IS NULL
  UNION ALL SELECT object_id, last_ts, 'summary-' || first_id, action, CASE WHEN action IN ('UPDATE', 'OBSERVE', 'INFER') THEN last_value ELSE total END, CASE WHEN action IN ('UPDATE', 'OBSERVE', 'INFER') THEN last_k ELSE total_k END FROM runs
), rows_ AS (SELECT object_id, 'value' AS key, timestamp, id, action, v AS num FROM merged UNION ALL SELECT object_id, 'k', timestamp, id, action, k FROM merged WHERE k IS NOT NULL), {folded('rows_')} SELECT object_id, key, round(num, 4) AS value FROM st""",
        "consolidation_count": f"WITH {EV}, {ISLANDS} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS consolidated FROM runs",
        "consolidation_policy": f"WITH {EV} SELECT action, count(*) AS n, max(id) AS newest_id FROM ev WHERE timestamp <= {AS_OF} - INTERVAL 7 DAY AND confidence <= 0.9e0 GROUP BY 1",
        "entity_lookup": "SELECT c_custkey AS id, c_mktsegment AS entity_type, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)",
        "entity_created": """WITH m AS (SELECT c_name AS name, md5(c_name || ': ' || c_mktsegment || ' ' || '{"nation": ' || c_nationkey || '}') AS h FROM customer), b AS (SELECT name, list_transform(range(0, 32), lambda i: CAST('0x' || substr(h, CAST((i % 16) * 2 + 1 AS BIGINT), 2) AS INTEGER) / 128e0 - 1) AS v FROM m)
SELECT name, 'user' AS namespace, CAST(32 AS BIGINT) AS dimensions, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM b""",
        "statement_contradiction": f"WITH {ST}, said AS (SELECT * FROM st)" + contradiction,
        "topic_drift": f"WITH {ST} SELECT id, CASE WHEN namespace % 2 = 0 THEN 'weather' ELSE 'work' END AS domain, CASE WHEN namespace % 2 = 0 THEN contains(lower(text), 'firm') OR contains(lower(text), 'tea') ELSE contains(lower(text), 'rain') END AS drifted FROM st",
        "transitive_upsert": f"""WITH {REL}, e AS (SELECT source_id, target_id, confidence FROM rel WHERE relation_type = 'part_of' UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey, 0.5e0 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0
), inf AS (SELECT x.source_id, y.target_id, max(x.confidence * y.confidence * 0.9e0) AS c FROM e x JOIN e y ON x.target_id = y.source_id GROUP BY 1, 2)
SELECT coalesce(e.source_id, inf.source_id) AS source_id, coalesce(e.target_id, inf.target_id) AS target_id, round(coalesce(c, confidence), 6) AS confidence, e.source_id IS NULL AS is_inferred, CAST((c IS NOT NULL)::INT + (confidence IS NOT NULL)::INT AS BIGINT) AS writes, CASE WHEN c IS NOT NULL THEN 'transitivity' END AS rule
FROM e FULL JOIN inf ON e.source_id = inf.source_id AND e.target_id = inf.target_id""",
        "path_confidence": "SELECT DISTINCT 'S' || s_suppkey AS start, 'R' || n_regionkey AS goal, CAST(2 AS BIGINT) AS hops, round(0.9e0 * 0.8e0, 6) AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "temporal_chains": f"WITH RECURSIVE {EV}, {LINKS}, {chained('happened_before', 3, '0e0', 'happened_before')} SELECT source_id, target_id, relation_type, hops, confidence, is_inferred FROM chain",
        "causal_chains": f"WITH RECURSIVE {EV}, {LINKS}, {chained('caused', 4, '2e-1', 'may_have_caused')} SELECT source_id, target_id, relation_type, hops, path, confidence, is_inferred FROM chain",
        "centroid_drift": f"""WITH {CENTERS} SELECT domain, win AS "window", n, round(1 - list_cosine_similarity(now, before), 5) AS distance, coalesce(1 - list_cosine_similarity(now, before) > 0.3, false) AS drifted FROM centers""",
        "quarantined_vectors": f"""WITH {CENTERS} SELECT id, domain, win AS "window", round(1 - list_cosine_similarity(vec, before), 5) AS distance, coalesce(1 - list_cosine_similarity(vec, before) > 0.7, false) AS quarantined FROM v LEFT JOIN centers USING (domain, win)""",
        "state_store_counts": f"WITH {EV}, h AS (SELECT object_id, arg_max(memory_type, (timestamp, id)) AS namespace FROM ev WHERE object_id % 5 <> 0 GROUP BY 1) SELECT namespace, count(*) AS n, false AS is_total FROM h GROUP BY 1 UNION ALL SELECT NULL, count(*), true FROM h",
        "state_intervals": f"WITH {EV}, {VAL}, {SPANS} SELECT object_id, round(value, 4) + 0e0 AS value, valid_from, valid_to FROM spans",
        "sql_state_at": f"WITH {EV}, {VAL}, {SPANS} SELECT id, ev.object_id, round(value, 4) + 0e0 AS value FROM ev JOIN spans ON ev.object_id = spans.object_id AND valid_from <= timestamp - INTERVAL 1 HOUR AND (valid_to IS NULL OR timestamp - INTERVAL 1 HOUR < valid_to)",
        "sql_neighbors": f"WITH {REL}, n AS (SELECT DISTINCT source_id AS node FROM rel WHERE relation_type = 'part_of') SELECT node, target_id AS neighbor, 'out' AS direction, relation_type, confidence FROM n JOIN rel ON source_id = node UNION ALL SELECT node, source_id, 'in', relation_type, confidence FROM n JOIN rel ON target_id = node",
        "sql_reached": f"WITH {REL}, a AS (SELECT source_id AS node, target_id AS reached, 1 AS hops, confidence FROM rel WHERE source_id LIKE 'C%') SELECT node, reached, CAST(hops AS BIGINT) AS hops, round(confidence, 6) AS confidence FROM (FROM a UNION ALL SELECT node, target_id, 2, a.confidence * rel.confidence FROM a JOIN rel ON source_id = reached)",
        "ancestry_set_hash": f"WITH {EV}, m AS (SELECT object_id, md5(CAST(id AS VARCHAR)) AS h FROM ev) SELECT object_id, count(*) AS n_events, CAST(sum(CAST('0x' || h[1:15] AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS low, CAST(sum(CAST('0x' || h[16:30] AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS high FROM m GROUP BY 1",
        "relations_deleted": f"WITH {REL} SELECT source_id, target_id, relation_type FROM rel WHERE target_id NOT IN ('N1', 'N2', 'R0')",
        "recall_faceted": """WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0
), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS k FROM n) WHERE k <= 80
), s AS (SELECT query_id, id, label, round(0.4e0 * CAST(0.5 + (id % 50) / 100.0 AS DOUBLE) + 0.3e0 * (CASE WHEN id % 2 = 0 THEN 1e0 ELSE 0.5e0 END) + 0.2e0 + 0.1e0 * similarity, 8) AS score FROM t
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s WHERE score >= 0)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r WHERE k <= 40 AND label IN (1, 2) AND id BETWEEN 40 AND 350 AND (id BETWEEN 100 AND 399 OR id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 13))""",
        "recall_forgotten": f"WITH {EV}, {HEADS}, x AS (SELECT object_id AS id, confidence, authority, corroboration, CASE WHEN object_id % 3 = 0 THEN 0e0 ELSE freshness END AS freshness FROM heads) SELECT id, freshness, round({score()}, 6) AS score FROM x",
        "remember_events": f"WITH {told} SELECT ord AS event, object_id, CASE WHEN source = 'user' THEN 'USER' ELSE 'AGENT' END AS actor, CASE WHEN kind >= 2 AND row_number() OVER (PARTITION BY object_id ORDER BY timestamp, ord) = 1 THEN 'ADD' ELSE 'UPDATE' END AS action, authority, text AS content FROM told",
        "remember_states": f"WITH {told}, x AS (SELECT object_id, arg_max(text, (timestamp, ord)) AS content, count(*) AS version, arg_max(confidence, (timestamp, ord)) AS confidence, arg_max(authority, (timestamp, ord)) AS authority FROM told GROUP BY 1) SELECT *, round({score('confidence', 'authority', '1e0', '0e0')}, 6) AS score FROM x",
        "remember_relations": f"WITH {told}, x AS (SELECT id, text FROM told WHERE source = 'user'), n AS (SELECT * FROM names), {STATED}, y AS (SELECT 'relation' AS kind, relation, 'USER ' || relation || ' ' || object AS content, confidence FROM stated UNION ALL SELECT 'entity', label, value, 0.9e0 FROM n JOIN x USING (id) WHERE label IN ('PERSON', 'ORG', 'GPE', 'PRODUCT')) SELECT kind, relation, content, count(*) AS n, max(confidence) AS confidence FROM y GROUP BY 1, 2, 3",
        "extract_fields": f"""WITH {EVERY}, f AS (SELECT kind, id, regexp_extract_all(coalesce(text, ''), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b') AS e, regexp_extract_all(coalesce(text, ''), '\\b(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})\\b') AS d FROM every)
SELECT kind, id, CASE WHEN len(e) > 0 THEN array_to_string(e, ',') END AS emails, CASE WHEN len(d) > 0 THEN array_to_string(d, ',') END AS dates, coalesce(array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ','), '') AS entities FROM f WHERE len(e) > 0 OR len(d) > 0""",
        "event_messages": f"WITH {EV} SELECT CAST(object_id AS VARCHAR) AS key, id, action, round(d_value, 4) AS value FROM ev",
        "merged_vectors": f"WITH {DUPS} SELECT vec_id AS id, label AS kind FROM embeddings WHERE vec_id NOT IN (SELECT source_id FROM dups)",
        "named_entities": f"WITH {ST}, t AS (SELECT id, text FROM st), f AS ({found} UNION ALL SELECT id, 3, label, value FROM names UNION ALL SELECT id, 3, 'PRODUCT', '10.0.' || k || '.7' FROM st WHERE kind = 9) SELECT id, arg_min(label, (k, label)) AS label, value, count(*) AS n FROM f GROUP BY id, value",
        "entities_merged": """WITH made AS (
  SELECT sha256(concat_ws(chr(31), c_name, c_mktsegment, '{"nation": ' || c_nationkey || '}')) AS id, c_mktsegment AS kind, md5(c_name || ': ' || c_mktsegment || ' {"nation": ' || c_nationkey || '}') AS h FROM customer
), vectors AS (
  SELECT id, kind, list_transform(range(16), lambda i: (16 * (strpos('0123456789abcdef', h[2 * i + 1]) - 1) + strpos('0123456789abcdef', h[2 * i + 2]) - 1) / 128e0 - 1e0) AS v FROM made
), hits AS (
  SELECT a.id AS left_id, b.id AS right_id, list_cosine_similarity(a.v, b.v) AS s FROM vectors a JOIN vectors b USING (kind) WHERE list_cosine_similarity(a.v, b.v) >= 0.7
), top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(s, 12) DESC, left_id <> right_id, right_id) AS n FROM hits) WHERE n <= 5 AND left_id <> right_id
)
SELECT made.id, arg_min(left_id, (-s, left_id)) AS merged_into FROM made LEFT JOIN top ON right_id = made.id GROUP BY made.id""",
        "duplicate_greedy": f"WITH RECURSIVE {DUPS}, {scanned('dups')} SELECT left_id, right_id, similarity, source_id, target_id, reason, CASE WHEN similarity > 0.95 THEN 'auto' WHEN similarity >= 0.85 THEN 'review' ELSE 'reject' END AS band FROM emitted",
        "weekly_merges": f"WITH RECURSIVE {DUPS}, own AS (SELECT dups.* FROM dups JOIN embeddings ON vec_id = left_id WHERE label IN (0, 1, 2)), {scanned('own')} SELECT source_id, target_id, similarity FROM emitted WHERE whole > 0.35",
        "weekly_applied": f"""WITH RECURSIVE {DUPS}, own AS (SELECT dups.* FROM dups JOIN embeddings ON vec_id = left_id WHERE label IN (0, 1, 2)), {scanned('own')}, best AS (SELECT source_id, arg_min(target_id, (-whole, target_id)) AS merged_into FROM emitted WHERE whole > 0.35 GROUP BY 1)
SELECT vec_id AS id, CASE label WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'place' ELSE 'other' END AS kind, merged_into FROM embeddings LEFT JOIN best ON source_id = vec_id""",
        "transaction_states": f"""WITH {EV}, e AS (SELECT *, action = 'UPDATE' AND id % 2 = 0 AS moves FROM ev WHERE true), rows_ AS (
  SELECT object_id, 'inventory' AS key, timestamp, id, action, d_value AS num FROM e WHERE NOT moves UNION ALL SELECT object_id, 'inventory', timestamp, id, 'REMOVE', d_value FROM e WHERE moves UNION ALL SELECT object_id + 1, 'inventory', timestamp, id, 'ADD', d_value FROM e WHERE moves
), known AS (SELECT * FROM rows_ WHERE object_id <= 100 AND object_id IN (SELECT object_id FROM ev)), {folded('known')}, tops AS (
  SELECT known.object_id, count(*) AS version, arg_max(ev.id, (ev.timestamp, ev.id)) AS last_event_id, arg_max(ev.confidence, (ev.timestamp, ev.id)) AS confidence, arg_max(ev.authority, (ev.timestamp, ev.id)) AS authority FROM known JOIN ev ON ev.id = known.id GROUP BY 1
) SELECT object_id, round(num, 4) AS value, version, last_event_id, confidence, authority FROM st JOIN tops USING (object_id)""",
        "snapshot_compact": f"WITH {EV}, {VAL}, {SNAP} SELECT object_id, id, coalesce(c_mktsegment, 'user') AS namespace FROM snaps LEFT JOIN customer ON c_custkey = object_id WHERE timestamp >= {AS_OF} - INTERVAL 10 DAY",
        "merge_log": f"WITH {DUPS} SELECT source_id, target_id, similarity AS confidence, reason, {AS_OF} AS timestamp FROM dups",
        "hybrid_entities": f"WITH {ST}, t AS (SELECT id, text FROM st), f AS ({found} UNION ALL SELECT id, 3, label, value FROM names WHERE label IN ('GPE', 'LOC') UNION ALL SELECT id, 4, 'B-' || label, value FROM names WHERE label <> 'GPE' AND id NOT IN (SELECT id FROM names WHERE label = 'GPE')) SELECT id, arg_min(label, (k, label)) AS label, value, count(*) AS n FROM f GROUP BY id, value",
        "ingest_identified": """SELECT event_id AS id, 'accepted' AS status, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE sha256(event_id || chr(31) || '{"action":"ADD","delta":{"value":1}}') END AS object_id FROM events""",
    }
    out["events_played_back"] = f"SELECT event_type, CASE WHEN {days(AS_OF, 'ts')} > 365 THEN 'reject' WHEN {days(AS_OF, 'ts')} > 30 THEN 'approve' ELSE 'accept' END AS route, count(*) AS n, count(user_id) AS with_user, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"
    out["decay_counts"] = f"SELECT count(*) AS updated, count(*) FILTER (WHERE stale) AS stale FROM ({out['decay_update']})"
    out["recall_grounded"] = f"""WITH {EV}, hits AS ({out['vector_recall']}), c AS (
  SELECT object_id, count(*) AS n_events, count(*) FILTER (WHERE actor = 'USER' AND action = 'PLANT') AS n_planted, count(*) FILTER (WHERE action = 'REMOVE' AND timestamp >= TIMESTAMP '2024-01-29 00:00:00') AS n_failed, arg_min(id, (timestamp, id)) AS first_id, arg_max(id, (timestamp, id)) AS last_id FROM ev GROUP BY 1
) SELECT query_id, id, score, n_events, n_planted, n_failed, first_id, last_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits JOIN c ON object_id = id WHERE n_planted > 0 AND n_failed > 0"""
    out["recall_evidence"] = f"""WITH {EV}, hits AS ({out['vector_recall']}), p AS (SELECT *, (row_number() OVER (ORDER BY object_id, timestamp, id) - 1) // 4096 AS run FROM ev WHERE object_id IN (SELECT id FROM hits)), g AS (
  SELECT object_id, run, count(*) AS n, min(timestamp) AS first_at, max(timestamp) AS last_at, string_agg(CAST(id AS VARCHAR), ',' ORDER BY timestamp, id) AS ids FROM p GROUP BY 1, 2
) SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY run) - 1 AS part, n, first_at, last_at, ids FROM g"""
    return out
