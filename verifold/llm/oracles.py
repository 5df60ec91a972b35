"""DuckDB SQL of the resampling and of the conversation repair, written by hand; no value is shared with the operators."""

from __future__ import annotations


def crc32(hex_text: str) -> str:
    """CRC-32 of bytes given as hex digits, bit by bit."""
    digit = lambda nth: f"strpos('0123456789ABCDEF', {hex_text}[2 * i + {nth}]) - 1"
    octets = f"list_transform(range(length({hex_text}) // 2), lambda i: (16 * ({digit(1)}) + {digit(2)})::BIGINT)"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {bits}))"


OP13_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, true AS doc, text FROM documents UNION ALL SELECT -1, NULL, false, text FROM benchmark
), words AS (
  SELECT r, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), bucketed AS (
  SELECT word, {crc32("h")} % 10000 AS bucket FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words)
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE doc) AS s, count(*) FILTER (WHERE NOT doc) AS t FROM words JOIN bucketed USING (word) GROUP BY bucket
), totals AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, totals
), weights AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE doc GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE texts.doc
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, 10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS most FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= most THEN k END AS rank FROM ordered
"""


def _edit(state: str, letter: str, cost: str, turn: str | None = None) -> str:
    """A way on from a state's best: cost, edits and turns so far."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{f' || [{turn}]' if turn else ''}}}"


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _with_inserts(source: str, keys: str) -> str:
    """Best ways to the four states when turns may also be inserted."""
    user = _best("s2", *(_edit(s, "I", "2", "'user:'") for s in ("s0", "s1", "s3")))
    return f"SELECT {keys}, s0, s1, u AS s2, {_best('s3', _edit('u', 'I', '2', chr(39) + 'assistant:' + chr(39)))} AS s3 FROM (SELECT *, {user} AS u FROM ({source}))"


_FAR = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
_ROW = "d.role || ':' || d.text"


def _if(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} ELSE {_FAR} END"


_SOUND = "d.fault IN ('', 't')"
_TO_USER = [w for s in ("s0", "s1", "s3") for w in (_if(f"{_SOUND} AND d.role[1] = 'u'", _edit(f"p.{s}", "K", "d.cut", _ROW)), _if(_SOUND, _edit(f"p.{s}", "R", "(2 + d.cut)", "'user:' || d.text")))]
_TO_ASSISTANT = [_if(f"{_SOUND} AND d.role[1] = 'a'", _edit("p.s2", "K", "d.cut", _ROW)), _if(_SOUND, _edit("p.s2", "R", "(2 + d.cut)", "'assistant:' || d.text"))]
_STEP = f"""SELECT p.r, p.i + 1 AS i, {_edit("p.s0", "D", "3")} AS s0,
      {_best(_edit("p.s1", "D", "3"), _if(f"{_SOUND} AND d.role[1] = 's'", _edit("p.s0", "K", "d.cut", _ROW)))} AS s1,
      {_best(_edit("p.s2", "D", "3"), *_TO_USER)} AS s2,
      {_best(_edit("p.s3", "D", "3"), *_TO_ASSISTANT)} AS s3
    FROM ways p JOIN judged d ON d.r = p.r AND d.i = p.i + 1"""

OP11_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), folds AS (
  SELECT k, {crc32("h")} % 20 AS f FROM (SELECT DISTINCT k, hex(encode(k)) AS h FROM given)
), damaged AS (
  SELECT r, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given JOIN folds USING (k)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY r, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS stop FROM damaged
), faults AS (
  SELECT r, i, turn, role, text, CASE WHEN stop = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN stop NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM ordered
), judged AS (
  SELECT *, CASE fault WHEN 't' THEN 1 ELSE 0 END AS cut, role[1] || lead(role[1]) OVER (PARTITION BY r ORDER BY i) NOT IN ('su', 'ua', 'au') AS illegal FROM faults
), start AS ({_with_inserts(f"SELECT DISTINCT r, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, {_FAR} AS s1, {_FAR} AS s2, {_FAR} AS s3 FROM given", "r, i")}
), ways AS (
  SELECT * FROM start UNION ALL {_with_inserts(_STEP, "r, i")}
), ends AS (
  SELECT r, {_best("s0", "s3")} AS e FROM ways QUALIFY row_number() OVER (PARTITION BY r ORDER BY i DESC) = 1
), counts AS (
  SELECT r, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM judged GROUP BY r
)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.c AS cost, e.a AS audit, sha256(array_to_string(e.t, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT r, conv_id FROM given) g JOIN ends USING (r) LEFT JOIN counts USING (r)
"""
