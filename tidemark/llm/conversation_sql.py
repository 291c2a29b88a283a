"""SQL of the conversation operators, in DuckDB's dialect."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(
        [4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda l: ascii(l)::BIGINT),
        lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
            lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


REPAIR = rf"""
    WITH RECURSIVE faulty AS (
        SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS c, turn, coalesce(role, ' ') AS role,
            coalesce(text, ' ') AS text,
            {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20
                AS fault
        FROM conversations
    ), damaged AS (
        SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
            CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                ELSE text END AS text,
            unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS again
        FROM faulty WHERE fault <> 0
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY c
                ORDER BY turn NULLS FIRST, role, sha256(text), again) AS n,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail
        FROM damaged
    ), coded AS MATERIALIZED (
        SELECT c, n, turn, role, text,
            lag(role) OVER (PARTITION BY c ORDER BY n) AS role_before,
            CASE WHEN tail = '' THEN 'b'
                WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'd'
                WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
            CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial
        FROM numbered
    ), moves(state, after) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
    kept(initial, state, after) AS (
        VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
    ), path AS (
        SELECT DISTINCT c, 0::BIGINT AS n, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best
        FROM coded
        UNION ALL
        SELECT c, n, state, min(best) FROM (
            WITH inserted AS (
                SELECT c, n, state, min(best) AS best FROM (
                    SELECT c, n, state, best FROM path
                    UNION ALL
                    SELECT c, n, m.after, {{'cost': best.cost + 3, 'audit': best.audit || 'I'}}
                    FROM path JOIN moves m USING (state)
                    UNION ALL
                    SELECT c, n, o.after, {{'cost': best.cost + 6, 'audit': best.audit || 'II'}}
                    FROM path JOIN moves m USING (state) JOIN moves o ON o.state = m.after)
                GROUP BY ALL)
            SELECT i.c, r.n, i.state,
                {{'cost': best.cost + 4, 'audit': best.audit || 'D'}} AS best
            FROM inserted i JOIN coded r ON r.c = i.c AND r.n = i.n + 1
            UNION ALL
            SELECT i.c, r.n, k.after,
                {{'cost': best.cost + CASE r.fault WHEN 't' THEN 3 ELSE 0 END,
                  'audit': best.audit || 'K'}}
            FROM inserted i JOIN coded r ON r.c = i.c AND r.n = i.n + 1
                JOIN kept k ON k.initial = r.initial AND k.state = i.state
            WHERE r.fault IN ('t', 'k')
            UNION ALL
            SELECT i.c, r.n, m.after,
                {{'cost': best.cost + CASE r.fault WHEN 't' THEN 6 ELSE 3 END,
                  'audit': best.audit || 'R'}}
            FROM inserted i JOIN coded r ON r.c = i.c AND r.n = i.n + 1
                JOIN moves m ON m.state = i.state
            WHERE r.fault IN ('t', 'k'))
        GROUP BY ALL
    ), ended AS (
        SELECT c, min({{'cost': best.cost + e.cost, 'audit': best.audit || e.letters}}) AS best
        FROM path JOIN (SELECT c, max(n) AS n FROM coded GROUP BY c) USING (c, n)
            JOIN (VALUES (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')) AS e(state, cost, letters)
                USING (state)
        GROUP BY c
    ), letters AS (
        SELECT c, unnest(string_split(best.audit, '')) AS letter,
            unnest(range(length(best.audit))) AS pos
        FROM ended WHERE best.audit <> ''
    ), edits AS (
        SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER so_far AS n,
            count(*) FILTER (WHERE letter <> 'D') OVER so_far AS place
        FROM letters WINDOW so_far AS (PARTITION BY c ORDER BY pos)
    ), made AS (
        SELECT e.c, e.pos, e.letter, e.place, r.role, r.text,
            max(CASE WHEN e.place = 1 AND e.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END)
                OVER (PARTITION BY e.c) AS begins
        FROM edits e LEFT JOIN coded r ON r.c = e.c AND r.n = e.n AND e.letter <> 'I'
        WHERE e.letter <> 'D'
    ), repaired AS (
        SELECT c, string_agg(
            CASE WHEN letter = 'K' THEN role WHEN (place - begins) % 2 = 1 THEN 'user'
                ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS text
        FROM made GROUP BY c
    ), counted AS (
        SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (WHERE fault = 'b') AS blank,
            count(*) FILTER (WHERE fault = 'd') AS duplicate,
            count(*) FILTER (WHERE fault = 't') AS truncated,
            count(*) FILTER (WHERE n > 1 AND left(role_before, 1) || left(role, 1)
                NOT IN ('su', 'ua', 'au')) AS illegal
        FROM coded GROUP BY c)
    SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
        coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
        coalesce(best.audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, c FROM faulty) i
        LEFT JOIN counted USING (c) LEFT JOIN ended USING (c) LEFT JOIN repaired USING (c)
"""

TRIE = f"""
    WITH named AS (
        SELECT conv_id AS c, turn, length(coalesce(role, '')) || ':' || coalesce(role, '')
                || coalesce(text, '') AS item,
            length(coalesce(text, '')) AS points, coalesce(role, '') AS role
        FROM conversations WHERE conv_id IS NOT NULL
    ), turns AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(item))
            AS n
        FROM named
    ), convs AS (
        SELECT c, max(n) AS own, {_crc32("c::VARCHAR")} % 6 AS h, c - c % 100 AS base
        FROM turns GROUP BY c
    ), rebuilt AS (
        SELECT k.c, b.n AS d, b.item, b.points
        FROM convs k JOIN turns b ON b.c = k.base AND b.n <= k.h
        UNION ALL
        SELECT k.c, o.n - k.h + least(k.h, coalesce(b.own, 0)), o.item, o.points
        FROM convs k JOIN turns o ON o.c = k.c AND o.n > k.h LEFT JOIN convs b ON b.c = k.base
    ), members AS (
        SELECT c, 0 AS d, []::VARCHAR[] AS path, 0 AS points FROM convs
        UNION ALL
        SELECT c, d, list(item) OVER (PARTITION BY c ORDER BY d), points FROM rebuilt
    ), nodes AS (
        SELECT path, d, min(m.c) AS conv_id, count(*) AS n_convs, max(points) AS points,
            string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE m.d = l.size) AS ends
        FROM members m JOIN (SELECT c, max(d) AS size FROM members GROUP BY c) l USING (c)
        GROUP BY path, d
    ), children AS (
        SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
    ), full_nodes AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children
        FROM nodes n LEFT JOIN children USING (path)
    ), subtrees AS (
        SELECT path[1 : k] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
            sum((n_convs - 1) * points)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_nodes) GROUP BY 1
    )
    SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
        s.n_leaves, s.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM full_nodes n JOIN subtrees s USING (path)
        LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1 : n.d - 1]
"""
