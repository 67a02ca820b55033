"""The SQL of the longer queries."""

from __future__ import annotations

#: floor(1024 * x) is exact in double precision for the given values, and so are their sums.
TOP_K = (
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings "
    "WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score "
    "FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) "
    "SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"
)

_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
FILTER_AUDIT = (
    "WITH RECURSIVE said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id), "
    "d0 AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents), "
    f"d1 AS (SELECT *, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d0), "
    "d AS (SELECT d1.part, coalesce(s.good, 0) AS good, coalesce(s.toxic, 0) AS toxic, "
    "concat(CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END, "
    "CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END, "
    "CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN d1.doc_id > first THEN 'E' END) AS fails "
    "FROM d1 LEFT JOIN said s ON s.doc_id = d1.doc_id), "
    "c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails), "
    "o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || l FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f(l) WHERE NOT contains(filter_order, l)), "
    "s AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before "
    "FROM o, range(1, 6) g(step) WHERE length(filter_order) = 5), "
    "m AS (SELECT c.part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS fail, "
    "len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone FROM c, s), "
    "t AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed, "
    "sum(n) FILTER (fail AND gone) AS redundant, sum(n) FILTER (fails = f) AS unique_fails, sum(good) FILTER (fail AND NOT gone) AS good_lost, "
    "sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost FROM m GROUP BY part, filter_order, step, f) "
    "SELECT part, filter_order, step, "
    + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))
    + ", CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM t"
)

#: crc32 over the bytes of an ASCII string: bit by bit, with the usual reversed polynomial.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: "
    "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"
)
#: From state (0 nothing, 1 system, 2 user, 3 assistant): inserts before the row, their number, the state they lead to.
_INSERTS = "ins(p, i, k, m) AS (VALUES (0, '', 0, 0), (0, 'I', 1, 2), (0, 'II', 2, 3), (1, '', 0, 1), (1, 'I', 1, 2), (1, 'II', 2, 3), (2, '', 0, 2), (2, 'I', 1, 3), (3, '', 0, 3), (3, 'I', 1, 2))"
#: State, initial of a turn that it takes, next state, whether a changed role is this one.
_TAKES = "takes(m, a, q, rerole) AS (VALUES (0, 's', 1, false), (0, 'u', 2, true), (1, 'u', 2, true), (2, 'a', 3, true), (3, 'u', 2, true))"
_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
REPAIR = (
    f"WITH RECURSIVE {_INSERTS}, {_TAKES}, "
    f"given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(key=_KEY)} % 20 AS kind FROM conversations), "
    "hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, "
    "CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text "
    "FROM given, range(2) g(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, substr(role, 1, 1) AS a, "
    r"regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid FROM hurt), "
    "r AS (SELECT *, CASE WHEN solid = '' THEN 1 WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN 2 "
    "WHEN NOT regexp_matches(solid, '[.!?]$') THEN 3 ELSE 0 END AS fault, lag(a) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM placed), "
    "n AS (SELECT conv_id, count(*) AS rows, greatest(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0), 0) AS gaps, "
    "count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, "
    "count(*) FILTER (prior IS NOT NULL AND prior || a NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id), "
    # The ways on over one row: (state, initial, fault) to (cost, edits, next state).
    "e AS (SELECT DISTINCT r.a, r.fault, ins.p, w.cost + 5 * ins.k AS cost, ins.i || w.letter AS edits, w.q FROM (SELECT DISTINCT a, fault FROM r) r, ins, LATERAL ("
    "SELECT 2 AS cost, 'D' AS letter, ins.m AS q UNION ALL "
    "SELECT CASE WHEN r.fault = 3 THEN 5 ELSE 0 END, 'K', t.q FROM takes t WHERE t.m = ins.m AND t.a = r.a AND r.fault NOT IN (1, 2) UNION ALL "
    "SELECT 1 + CASE WHEN r.fault = 3 THEN 5 ELSE 0 END, 'R', t.q FROM takes t WHERE t.m = ins.m AND t.rerole AND r.fault NOT IN (1, 2)) w), "
    # Cost and edits in one string, so that the least one is the cheapest and of these the first.
    "walk(conv_id, pos, p, best) AS (SELECT conv_id, 0::BIGINT, 0, '000000000' FROM n UNION ALL "
    "SELECT walk.conv_id, r.pos, e.q, min(lpad((substr(walk.best, 1, 9)::BIGINT + e.cost)::VARCHAR, 9, '0') || substr(walk.best, 10) || e.edits) "
    "FROM walk JOIN r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.pos = walk.pos + 1 JOIN e ON e.p = walk.p AND e.a = r.a AND e.fault = r.fault GROUP BY walk.conv_id, r.pos, e.q), "
    "ended AS (SELECT walk.conv_id, min(lpad((substr(best, 1, 9)::BIGINT + 5 * length(f.i))::VARCHAR, 9, '0') || substr(best, 10) || f.i) AS best "
    "FROM walk JOIN n ON n.conv_id IS NOT DISTINCT FROM walk.conv_id AND n.rows = walk.pos JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) f(p, i) ON f.p = walk.p GROUP BY walk.conv_id), "
    "letters AS (SELECT conv_id, j, substr(best, 9 + j, 1) AS l FROM (SELECT conv_id, best, unnest(generate_series(1, length(best) - 9)) AS j FROM ended)), "
    "counted AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS pos, count(*) FILTER (l <> 'D') OVER w AS outs FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)), "
    "turns AS (SELECT c.*, r.role, r.text, r.a FROM counted c LEFT JOIN r ON l <> 'I' AND r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.pos = c.pos WHERE l <> 'D'), "
    "heads AS (SELECT conv_id, bool_or(outs = 1 AND l = 'K' AND a = 's')::INT AS headed FROM turns GROUP BY conv_id), "
    "said AS (SELECT t.conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (outs - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS said "
    "FROM turns t JOIN heads ON heads.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id) "
    "SELECT b.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, "
    "coalesce(n.illegal, 0) AS illegal, coalesce(substr(ended.best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(ended.best, 10), '') AS audit, sha256(coalesce(said.said, '')) AS repaired_sha256 "
    "FROM (SELECT DISTINCT conv_id FROM conversations) b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id "
    "LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM b.conv_id"
)
