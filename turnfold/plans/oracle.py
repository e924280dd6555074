"""DuckDB SQL for the queries; written request by request, where the engine uses running sums."""

from ..operators.turns import EXPORTED
from ..sources.tables import LEDGER, PATHS

_PATHS = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"
_T = f"WITH t AS (SELECT *, {_PATHS}[path_no + 1] AS path FROM ({LEDGER.replace(' DIV ', ' // ')}) q)"
_KIND = """CASE WHEN bare LIKE '%/chat/completions' THEN 'chat' WHEN bare LIKE '%/completions' THEN 'completions' WHEN bare LIKE '%/responses' THEN 'responses'
WHEN bare LIKE '%/messages' OR bare LIKE '%/count!_tokens' ESCAPE '!' THEN 'messages' WHEN bare LIKE '%/embeddings' THEN 'embeddings' WHEN bare LIKE '%/models' THEN 'models' ELSE 'other' END"""
_K = _T + f", k AS (SELECT *, {_KIND} AS kind FROM (SELECT *, rtrim(split_part(path, '?', 1), '/') AS bare FROM t) z)"
_GATE = "CASE WHEN kind IN ('models', 'other') THEN 'path' WHEN body < 4096 THEN 'too_small' WHEN body > 18000 THEN 'too_large' END"
_HUMAN = """CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0) ELSE printf('%.2f GiB', n / 1073741824.0) END"""

_M = r"""WITH m AS (
  SELECT conv_id, turn, '{"role":"' || role || '","content":"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"}' AS msg
  FROM conversations),
x AS (
  SELECT *, strlen(msg) AS len, strlen(msg) >= 128 AS big, row_number() OVER (ORDER BY conv_id, turn) AS seq,
    (sum(strlen(msg)) OVER w + row_number() OVER w - 1 + 27)::BIGINT AS body,
    (sum(strlen(msg)) OVER w + row_number() OVER w - 1 + 27) >= 1024 AND max((strlen(msg) >= 128)::INT) OVER w = 1 AS split
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (
  SELECT a.conv_id, a.turn AS req, a.seq, a.body, a.split, b.turn, b.msg, b.len, b.big FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.turn <= a.turn),
f AS (SELECT msg, max(len) AS len, min(seq) AS fs FROM e WHERE split AND big GROUP BY msg),
p AS (SELECT fs, count(*) AS push_blocks, sum(len)::BIGINT AS push_bytes FROM f GROUP BY fs),
g AS (
  SELECT e.conv_id, e.req AS turn, e.seq, any_value(e.body) AS body, any_value(e.split) AS split, count(*) FILTER (e.big) AS refs,
    count(*) FILTER (e.big AND f.fs < e.seq) AS refs_hit, coalesce(sum(e.len) FILTER (e.big), 0)::BIGINT AS covered
  FROM e LEFT JOIN f ON f.msg = e.msg GROUP BY e.conv_id, e.req, e.seq),
s AS (
  SELECT conv_id, turn, seq, body AS body_len, split, CASE WHEN split THEN refs ELSE 0 END AS refs, CASE WHEN split THEN refs_hit ELSE 0 END AS refs_hit,
    CASE WHEN split THEN refs - refs_hit ELSE 0 END AS refs_new, CASE WHEN split THEN covered ELSE 0 END AS covered,
    CASE WHEN split THEN coalesce(push_blocks, 0) ELSE 0 END AS push_blocks, CASE WHEN split THEN coalesce(push_bytes, 0) ELSE 0 END AS push_bytes,
    CASE WHEN split THEN body - covered + coalesce(push_bytes, 0) + 20 * refs + 4 * (refs + 1) ELSE body END AS wire_model
  FROM g LEFT JOIN p ON p.fs = g.seq),
st AS (SELECT * EXCLUDE seq, split AND wire_model > body_len + greatest(body_len // 16, 1024) AS inflated FROM s)
"""
_ROWS = "SELECT conv_id, turn, body_len, wire_model, greatest(body_len - wire_model, 0) AS saved, CASE WHEN body_len = 0 THEN 0 ELSE greatest(body_len - wire_model, 0) * 10000 // body_len END AS saved_bp, refs_hit::DOUBLE / greatest(refs, 1) AS hit_ratio FROM st"
_VAR = lambda n: f"(CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 WHEN {n} < 2097152 THEN 3 ELSE 4 END)"
# literals of a program are what lies between references in the body; found by cutting it at them
_PROGRAM = _M + f""", ends AS (
  SELECT conv_id, req, seq, turn, len, big, body, 25 + sum(len + 1) OVER (PARTITION BY conv_id, req ORDER BY turn) - 1 AS e FROM e WHERE split),
refs AS (SELECT conv_id, req, seq, body, len, e - len AS a, e, coalesce(lag(e) OVER (PARTITION BY conv_id, req ORDER BY turn), 0) AS prior FROM ends WHERE big),
pr AS (
  SELECT conv_id, req AS turn, any_value(seq) AS seq, 2 * count(*) + 1 AS instrs,
    sum(1 + {_VAR('a - prior')} + a - prior + 17 + {_VAR('len')})::BIGINT + 1 + {_VAR('(max(body) - max(e))')} + max(body) - max(e) AS b
  FROM refs GROUP BY conv_id, req),
prog AS (SELECT conv_id, turn, seq, instrs::BIGINT AS instrs, ({_VAR('instrs')} + b)::BIGINT AS program_bytes FROM pr)
"""
_FRAME = lambda n: f"(2 + {_VAR(n)} + {n})"
_BUCKET = """requests, split_requests, body_bytes, wire_bytes, refs, refs_hit, pushed, repairs, greatest(body_bytes - wire_bytes, 0) AS saved_bytes,
  CASE WHEN body_bytes = 0 THEN 0 ELSE greatest(body_bytes - wire_bytes, 0) * 10000 // body_bytes END AS saved_bp, CASE WHEN refs = 0 THEN 0 ELSE refs_hit * 10000 // refs END AS hit_bp
FROM (SELECT {key} AS key, count(*) AS requests, sum(split::INT)::BIGINT AS split_requests, sum(body)::BIGINT AS body_bytes, sum(wire)::BIGINT AS wire_bytes, sum(refs)::BIGINT AS refs,
  sum(refs_hit)::BIGINT AS refs_hit, sum(pushed)::BIGINT AS pushed, sum(repairs)::BIGINT AS repairs FROM {src} GROUP BY {key}) b"""
_COUNTERS = """SELECT count(*) AS requests, sum(split::INT)::BIGINT AS split_requests, sum((NOT split)::INT)::BIGINT AS passthrough, sum(body)::BIGINT AS body_bytes, sum(wire)::BIGINT AS wire_bytes,
  sum(CASE WHEN split THEN refs ELSE 0 END)::BIGINT AS refs, sum(CASE WHEN split THEN refs_hit ELSE 0 END)::BIGINT AS refs_hit, sum(CASE WHEN split THEN pushed ELSE 0 END)::BIGINT AS blocks_pushed,
  sum(repairs)::BIGINT AS repairs, count(*) FILTER (outcome = 'rebuilt') AS rebuilds, count(*) FILTER (outcome = 'rebuild failed') AS rebuild_failures, count(*) FILTER (upstream_failed) AS upstream_errors,
  count(*) FILTER (link_failed) AS link_errors, sum(response_bytes)::BIGINT AS response_bytes, sum(link_us)::BIGINT AS link_us, sum(upstream_us)::BIGINT AS upstream_us, sum(rejected)::BIGINT AS store_rejected FROM t"""
_SNAPSHOT = f"SELECT * EXCLUDE (link_us, upstream_us), link_us // 1000 AS link_ms, upstream_us // 1000 AS upstream_ms FROM ({_COUNTERS}) c"
_LINES = ", ".join(f"'# HELP turnfold_{n} {said}', '# TYPE turnfold_{n} counter', 'turnfold_{n} ' || {c}" for c, (n, said) in EXPORTED.items())
_RING = ", r AS (SELECT * FROM t ORDER BY seq DESC LIMIT 200)"


def _prune(max_bytes: int, max_blocks: int, ttl: int, now: int) -> str:
    old = f"({now} - used_at > {ttl})" if ttl else "false"
    return f"""WITH d AS (SELECT source AS peer, doc_id, strlen(text) AS len, doc_id * 60 AS used_at FROM documents),
o AS (SELECT *, {old} AS old, sum(len) OVER (PARTITION BY peer) - {max_bytes} AS over_bytes, count(*) OVER (PARTITION BY peer) - {max_blocks} AS over_blocks FROM d),
c AS (SELECT *, coalesce(sum(CASE WHEN old THEN 0 ELSE len END) OVER w, 0) AS b, coalesce(sum(CASE WHEN old THEN 0 ELSE 1 END) OVER w, 0) AS n FROM o
  WINDOW w AS (PARTITION BY peer ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT peer, doc_id, len, CASE WHEN (over_bytes > 0 OR over_blocks > 0) AND old THEN 'expired' WHEN (over_bytes > 0 OR over_blocks > 0) AND (b < over_bytes OR n < over_blocks) THEN 'evicted' ELSE 'kept' END AS state FROM c"""


ORACLE_SQL = {
    "classify_paths": _K + " SELECT path, kind, kind NOT IN ('models', 'other') AS dedupable, count(*) AS n FROM k GROUP BY ALL",
    "gate_reasons": _K + f" SELECT coalesce({_GATE}, 'split') AS reason, count(*) AS n, sum(body)::BIGINT AS body_bytes FROM k GROUP BY 1",
    "skip_labels": _K + f" SELECT CASE {_GATE} WHEN 'path' THEN 'endpoint is relayed' WHEN 'too_small' THEN 'body is small' ELSE 'body is large' END AS label, count(*) AS n FROM k WHERE {_GATE} IS NOT NULL GROUP BY 1",
    "inflation_guard": _T + " SELECT split, wire + refs * 200 > body + greatest(body // 16, 1024) AS inflates, count(*) AS n FROM t GROUP BY ALL",
    "header_filter": "SELECT event_id, 'content-type=' || event_type || ';authorization=Bearer u' || user_id AS headers FROM events",
    "response_header_filter": "SELECT event_id, 'content-type=' || event_type || ';x-request-id=r' || user_id || ';te=x' AS headers FROM events",
    "header_auth": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'accept=*/*;authorization=Bearer u' || user_id WHEN event_id % 2 = 0 THEN 'accept=*/*;anthropic-version=2023-06-01;x-api-key=k' || event_id % 3
      ELSE 'accept=*/*;authorization=Bearer k' || event_id % 3 END AS headers FROM events""",
    "query_params": _T + " SELECT DISTINCT path, CASE WHEN path LIKE '%part=%' THEN '2' END AS part, CASE WHEN path LIKE '%name=%' THEN 'x' END AS name, 'https://up' || path AS url, CASE WHEN length(path) <= 12 THEN path ELSE '..' || right(path, 10) END AS short FROM t",
    "human_sizes": f"SELECT o_orderkey, {_HUMAN} AS size FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37) % 5000000000 AS n FROM orders)",
    "hex_digests": "SELECT doc_id, substr(sha256(text), 1, 32) AS hex, substr(sha256(text), 1, 12) AS short, 16::BIGINT AS n_bytes FROM documents",
    "message_blocks": _M + " SELECT conv_id, turn, len, sha256(msg) AS sha, big FROM x",
    "first_seen_refs": _M + " SELECT sha256(msg) AS sha, count(*) AS uses, arg_min(conv_id, seq) AS conv_id, arg_min(turn, seq) AS turn FROM x WHERE big GROUP BY msg",
    "push_set": _M + " SELECT conv_id, turn, push_blocks, push_bytes FROM st WHERE push_blocks > 0",
    "split_stats": _M + " SELECT * FROM st",
    "replay_rows": _M + _ROWS,
    "replay_topn": _M + _ROWS + " ORDER BY saved DESC, conv_id, turn LIMIT 12",
    "replay_totals": _M + """ SELECT *, CASE WHEN body_split = 0 THEN 0 ELSE (body_split - wire_split) * 10000 // body_split END AS saved_bp FROM (
      SELECT count(*) AS requests, sum(split::INT)::BIGINT AS split, sum(refs)::BIGINT AS refs, sum(refs_hit)::BIGINT AS refs_hit, coalesce(sum(wire_model) FILTER (split), 0)::BIGINT AS wire_split,
        coalesce(sum(body_len) FILTER (split), 0)::BIGINT AS body_split, sum(body_len)::BIGINT AS body_all, sum(inflated::INT)::BIGINT AS inflated FROM st)""",
    "replay_sequential": _M + """ SELECT count(*) AS requests, sum(split::INT)::BIGINT AS split, sum(refs)::BIGINT AS refs, sum(refs_hit)::BIGINT AS refs_hit, coalesce(sum(wire_model) FILTER (split), 0)::BIGINT AS wire_split,
        coalesce(sum(body_len) FILTER (split), 0)::BIGINT AS body_split FROM st""",
    "presence_probe": _M + """, u AS (SELECT msg, min(conv_id) AS pushed_by FROM e WHERE split AND big GROUP BY msg)
      SELECT x.conv_id, count(*) AS known FROM x JOIN u ON u.msg = x.msg WHERE big AND u.pushed_by < x.conv_id AND x.conv_id IN (SELECT conv_id FROM x WHERE split) GROUP BY x.conv_id""",
    "whole_doc_dedup": "SELECT sha256(text) AS sha, min(doc_id) AS first, count(*) AS copies, max(strlen(text)) AS n_bytes, (sum(strlen(text)) - max(strlen(text)))::BIGINT AS saved FROM documents GROUP BY text",
    "cross_agent_sharing": _M + " SELECT count(*) * 2 AS pushes_apart, count(*) AS pushes_shared, sum(len)::BIGINT AS bytes_saved FROM f",
    "epoch_reset": _M + " SELECT epoch, count(*) AS blocks, sum(len)::BIGINT AS bytes FROM (SELECT DISTINCT conv_id // 100 AS epoch, msg, len FROM x WHERE big) GROUP BY epoch",
    "shadow_estimate": _M + """ SELECT conv_id, turn, body_len, wire_model, 'shadow' AS reason, body_len + 20 * refs + 4 * (refs + 1) AS wire_cold,
      body_len + 20 * refs + 4 * (refs + 1) > body_len + greatest(body_len // 16, 1024) AS inflates FROM st WHERE split""",
    "program_sizes": _PROGRAM + " SELECT conv_id, turn, instrs, program_bytes FROM prog",
    "wire_frames_exact": _PROGRAM + f""", blk AS (SELECT fs, sum({_FRAME('w')})::BIGINT AS push FROM (SELECT fs, 17 + {_VAR('len')} + len AS w FROM f) GROUP BY fs)
      SELECT g.conv_id, g.turn, g.split, (CASE WHEN g.split THEN {_FRAME('program_bytes')} + coalesce(push, 0) ELSE {_FRAME('g.body')} END)::BIGINT AS wire_frames
      FROM g LEFT JOIN prog ON prog.seq = g.seq LEFT JOIN blk ON blk.fs = g.seq""",
    "resolve_identity": _M + """ SELECT conv_id, req AS turn, 'ok' AS status, sha256('{"model":"m","messages":[' || string_agg(msg, ',' ORDER BY turn) || ']}') AS sha FROM e WHERE split GROUP BY conv_id, req""",
    "missing_blocks": _M + " SELECT sha256(msg) AS sha, max(len) AS len FROM x WHERE big AND msg NOT IN (SELECT msg FROM x WHERE big AND conv_id % 3 <> 0) GROUP BY msg",
    "missing_closure": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, '"data:text/plain;base64,' || to_base64(encode(coalesce(text, ''))) || '"' AS media FROM documents WHERE doc_id IS NOT NULL),
      z AS (SELECT doc_id, t, strlen('{"role":"user","content":"note ' || doc_id || repeat('x', 200) || '"}') AS note, strlen('{"role":"user","content":[{"type":"image_url","url":' || media || '}]}') AS item, strlen(media) AS media FROM d),
      y AS (SELECT *, item >= 128 AND t NOT IN (SELECT t FROM z WHERE doc_id % 3 = 1) AS no_item FROM z),
      w AS (SELECT *, no_item AND media >= 4096 AND t NOT IN (SELECT t FROM z WHERE doc_id % 3 = 2) AS no_media FROM y)
      SELECT doc_id AS request, 1 + no_item::BIGINT + no_media::BIGINT AS blocks, (note + CASE WHEN no_item THEN item ELSE 0 END + CASE WHEN no_media THEN media ELSE 0 END)::BIGINT AS bytes FROM w""",
    "rebuild_status": _M + """, b AS (SELECT msg, min(conv_id) AS c FROM x WHERE big GROUP BY msg),
      q AS (SELECT DISTINCT e.conv_id, e.req, e.msg, e.len, e.big AND c % 3 = 0 AS lost, e.big AND c % 3 <> 0 AND c % 7 = 3 AS spoilt FROM e LEFT JOIN b ON b.msg = e.msg WHERE e.split),
      r AS (SELECT conv_id, req AS turn, count(*) FILTER (lost) AS resent, coalesce(sum(len) FILTER (lost), 0)::BIGINT AS resent_bytes, count(*) FILTER (spoilt) AS bad FROM q GROUP BY ALL)
      SELECT conv_id, turn, CASE WHEN resent > 0 THEN 'missing' WHEN bad = 0 THEN 'ok' ELSE 'mismatch' END AS status, resent, resent_bytes, CASE WHEN bad = 0 THEN 'rebuilt' ELSE 'whole' END AS outcome FROM r""",
    "link_charges": _PROGRAM + f""", blk AS (SELECT fs, sum(12 + 17 + {_VAR('len')} + len)::BIGINT AS push FROM f GROUP BY fs)
      SELECT g.conv_id, g.turn, (24 + CASE WHEN g.split THEN program_bytes + coalesce(push, 0) ELSE g.body END)::BIGINT AS charge
      FROM g LEFT JOIN prog ON prog.seq = g.seq LEFT JOIN blk ON blk.fs = g.seq""",
    "peer_views": _M + """, v AS (SELECT DISTINCT conv_id % 3 AS peer, conv_id % 6 AS profile, msg, len FROM x WHERE big AND conv_id IN (SELECT conv_id FROM x WHERE split))
      SELECT peer, count(*) AS pushes_apart, count(DISTINCT msg) AS pushes_shared, (sum(len) - (SELECT sum(len) FROM (SELECT DISTINCT peer AS p, msg, len FROM v) u WHERE u.p = v.peer))::BIGINT AS bytes_saved FROM v GROUP BY peer""",
    "saved_ratios": _T + " SELECT seq, CASE WHEN body = 0 THEN 0.0 ELSE 1 - wire::DOUBLE / body END AS saved_ratio FROM t",
    "control_frames": _T + f""", c AS (SELECT seq, CASE outcome WHEN 'rebuild failed' THEN 19 ELSE 11 END::BIGINT AS tag, CASE outcome WHEN 'rebuild failed' THEN '{{"reason":"' || outcome || '","clear_presence":' || (repairs > 0) || '}}'
      ELSE '{{"wire_bytes":' || wire || ',"body_bytes":' || body || ',"upstream_us":' || upstream_us || ',"repairs":' || repairs || ',"store_blocks":' || pushed || ',"store_bytes":' || pushed * 300 || '}}' END AS payload FROM t)
      SELECT seq, tag, payload, (1 + {_VAR('seq')} + {_VAR('strlen(payload)')} + strlen(payload))::BIGINT AS frame_bytes, true AS same FROM c""",
    "json_validate": """SELECT event_id, json_valid(props) AS valid, json_valid(left(props, length(props) - 1)) AS cut, json_valid(regexp_replace(props, ':', ':0')) AS spoilt FROM events""",
    "codec_roundtrip": f"""WITH n AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents),
      l AS (SELECT doc_id, n, least(n, 10) AS a, greatest(least(n, 30) - 10, 0) AS b FROM n),
      p AS (SELECT doc_id, 17 + {_VAR('n')} + n AS block, 1 + CASE WHEN a > 0 THEN 2 + a ELSE 0 END + 17 + {_VAR('n')} + CASE WHEN b > 0 THEN 2 + b ELSE 0 END AS program FROM l)
      SELECT doc_id, (2 + 2 * {_VAR('doc_id')} + {_VAR('program')} + program + {_VAR('block')} + block)::BIGINT AS n_bytes, true AS same FROM p""",
    "stream_presence": """SELECT (user_id % 4)::VARCHAR AS peer, count(*) AS refs, count(*) - count(DISTINCT event_type) AS refs_hit, (100 * count(DISTINCT event_type))::BIGINT AS pushed_bytes FROM events GROUP BY 1""",
    "payload_containment": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
      z AS (SELECT doc_id, length(line) AS n, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT - length(line) - 1 AS a FROM l),
      y AS (SELECT doc_id, n, a, a + n AS b, a // 1000 AS cell FROM z),
      o AS (SELECT doc_id, cell, min(a) AS oa, max(b) AS ob FROM y GROUP BY doc_id, cell)
      SELECT y.doc_id, y.a, y.b, o.cell::BIGINT AS cell FROM y JOIN o ON o.doc_id = y.doc_id AND y.a >= o.oa AND y.b <= o.ob WHERE y.n >= 200""",
    "turn_ledger": _T + " SELECT seq, profile, path, body, wire, greatest(body - wire, 0) AS saved, greatest(body - wire, 0) * 10000 // body AS saved_bp FROM t",
    "turn_counters": _T + " " + _SNAPSHOT,
    "buckets_by_path": _T + " SELECT key, " + _BUCKET.format(key="path", src="t"),
    "buckets_by_profile": _T + " SELECT key, " + _BUCKET.format(key="profile", src="t"),
    "ring_buckets": _T + _RING + " SELECT key, " + _BUCKET.format(key="path", src="r"),
    "ring_recent": _T + _RING + " SELECT seq, profile, path, body, wire FROM r",
    "summary_line": _T + f""", c AS ({_COUNTERS}), h AS (SELECT *, (SELECT {_HUMAN} FROM (SELECT body_bytes AS n)) AS a, (SELECT {_HUMAN} FROM (SELECT wire_bytes AS n)) AS b FROM c)
      SELECT a || ' -> ' || b || ', saved ' || printf('%.1f', 100 - wire_bytes * 100.0 / body_bytes) || '%, hits ' || refs_hit || '/' || refs || ', repairs ' || repairs || ', requests ' || requests AS line FROM h""",
    "prometheus_lines": _T + f", c AS ({_COUNTERS}), l AS (SELECT [{_LINES}] AS lines FROM c) SELECT (generate_subscripts(lines, 1) - 1)::INT AS pos, unnest(lines) AS line FROM l",
    "sparkline_points": _T + """, l AS (SELECT seq, greatest(body - wire, 0) AS v FROM t ORDER BY seq DESC LIMIT 40), n AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS c, greatest(max(v) OVER (), 1) AS top FROM l)
      SELECT string_agg((CASE WHEN c = 1 THEN 100 ELSE i * 200 // (c - 1) END) || ',' || (40 - v * 40 // top), ' ' ORDER BY seq) AS points FROM n""",
    "lru_prune": _prune(40_000, 20, 0, 0),
    "ttl_eviction": _prune(60_000, 1000, 30_000, 60_000),
    "store_stats": "SELECT count(*) AS blocks, sum(n)::BIGINT AS bytes, (sum(c) - count(*))::BIGINT AS duplicates, sum((n > 20000)::INT)::BIGINT AS rejected FROM (SELECT strlen(text) AS n, count(*) AS c FROM documents GROUP BY text)",
    "json_spans": """SELECT event_id, k AS key, length(lead)::BIGINT AS start, (length(lead) + length(raw))::BIGINT AS "end",
      CASE WHEN raw LIKE '"%' THEN 'string' WHEN raw IN ('true', 'false') THEN 'bool' WHEN raw = 'null' THEN 'null' ELSE 'number' END AS kind, raw
      FROM (SELECT *, regexp_extract(props, '^(.*?"' || k || '": *)', 1) AS lead, trim(regexp_extract(props, '"' || k || '": *("[^"]*"|[^,}]*)', 1)) AS raw FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events))""",
}
