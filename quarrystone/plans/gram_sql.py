"""SQL that finds sparse grams, postings and chunks from their definitions, for comparison with the operators."""

from __future__ import annotations

# Weights of pairs of byte classes, in either order (l, u, d, s, c, p, o as in operators/grams.py).
_EITHER = (
    "ls 15, ss 5, uu 60, dd 80, ld 70, ud 75, pl 120, pu 130, pp 140, ps 90, su 50, sd 60, dp 110, oo 230, cc 200"
)
# Ranks of frequent letter pairs.
_RANKS = (
    "th 1, he 2, in 3, er 4, an 5, re 6, on 7, at 8, en 9, nd 10, ti 11, es 12, et 12, or 13, te 14, st 14, of 15, rn 15, ed 16, ng 16, is 17, le 17, it 18, un 18, al 19, ar 20, ct 20"
)


def _values(pairs: str) -> str:
    return ", ".join(f"('{k}', {v})" for k, v in (p.split() for p in pairs.split(", ")))


def _class(x: str) -> str:
    return (
        f"CASE WHEN {x} BETWEEN 97 AND 122 THEN 'l' WHEN {x} BETWEEN 65 AND 90 THEN 'u' WHEN {x} BETWEEN 48 AND 57 THEN 'd' WHEN {x} IN (9, 10, 13, 32) THEN 's' "
        f"WHEN {x} < 32 OR {x} = 127 THEN 'c' WHEN {x} >= 128 THEN 'o' ELSE 'p' END"
    )


_TWO_64 = "18446744073709551616::UHUGEINT"


def grams(most: int, where: str = "true") -> str:
    """CTEs; found has chunk_id and gram_hex of every distinct gram of the chunks, of at most so many bytes."""
    return f"""
    classes AS (SELECT CAST(x AS INTEGER) AS x, {_class("x")} AS k FROM range(256) r(x)),
    either AS (SELECT * FROM (VALUES {_values(_EITHER)}) v(k, w)),
    ranks AS (SELECT * FROM (VALUES {_values(_RANKS)}) v(k, w)),
    weights AS (
      SELECT a, b, least(251, greatest(1, CASE WHEN a = b THEN w * 7 // 10 ELSE w END)) AS w FROM (
        SELECT p.x AS a, q.x AS b, CASE
          WHEN p.k = 'l' AND q.k = 'l' THEN coalesce(3 + (SELECT r.w FROM ranks r WHERE r.k = chr(p.x) || chr(q.x)), 30 + xor(p.x * 7, q.x * 13) % 20)
          WHEN p.k = 'l' AND q.k = 'u' THEN 100 WHEN p.k = 'u' AND q.k = 'l' THEN 40
          ELSE coalesce((SELECT e.w FROM either e WHERE e.k IN (p.k || q.k, q.k || p.k) LIMIT 1), CASE WHEN 'o' IN (p.k, q.k) THEN 220 ELSE 180 END) END AS w
        FROM classes p, classes q)),
    raw AS (SELECT chunk_id, hex(encode(text)) AS h FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND {where}),
    pairs AS (
      SELECT chunk_id, i, instr('0123456789ABCDEF', h[2 * i - 1]) * 16 + instr('0123456789ABCDEF', h[2 * i]) - 17 AS a, instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS b
      FROM (SELECT chunk_id, h, unnest(range(1, length(h) // 2)) AS i FROM raw)),
    lists AS (SELECT chunk_id, list(w ORDER BY i) AS ws FROM pairs JOIN weights USING (a, b) GROUP BY chunk_id),
    places AS (SELECT chunk_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
    reach AS (
      SELECT chunk_id, len(ws) AS n, i, list_position(list_transform(ws[i + 1 : i + {most} - 2], lambda x: x >= ws[i]), true) AS right_end,
        list_position(list_transform(list_reverse(ws[greatest(1, i - {most} + 2) : i - 1]), lambda x: x >= ws[i]), true) AS left_end
      FROM places),
    spans AS (
      SELECT chunk_id, i AS begin, 2 AS length FROM reach UNION ALL SELECT chunk_id, i, 3 FROM reach WHERE i < n AND {most} >= 3
      UNION ALL SELECT chunk_id, i, right_end + 2 FROM reach WHERE right_end >= 2
      UNION ALL SELECT chunk_id, i - left_end, left_end + 2 FROM reach WHERE left_end >= 2),
    found AS (SELECT DISTINCT chunk_id, lower(substr(h, CAST(2 * begin - 1 AS BIGINT), CAST(2 * length AS BIGINT))) AS gram_hex FROM spans JOIN raw USING (chunk_id))"""


#: CTEs after grams(): hashed has chunk_id and gram, the 64-bit hash of each.
HASHED = f"""
    folded AS (
      SELECT gram_hex, length(gram_hex) // 2 AS n, list_reduce(list_prepend(0::UHUGEINT,
          list_transform(range(1, length(gram_hex) // 2 + 1), lambda k: CAST(instr('0123456789abcdef', gram_hex[2 * k - 1]) * 16 + instr('0123456789abcdef', gram_hex[2 * k]) - 17 AS UHUGEINT))),
          lambda h, x: (h * {0x9E3779B97F4A7C15}::UHUGEINT + x + 1) % {_TWO_64}) AS h
      FROM (SELECT DISTINCT gram_hex FROM found)),
    mixed AS (SELECT gram_hex, CAST((CAST(xor(CAST(h AS UBIGINT), CAST(h AS UBIGINT) >> 33) AS UHUGEINT) * {0xFF51AFD7ED558CCD}::UHUGEINT + CAST(n AS UHUGEINT)) % {_TWO_64} AS UBIGINT) AS h FROM folded),
    signed AS (SELECT gram_hex, CAST(xor(h, h >> 29) AS HUGEINT) AS h FROM mixed),
    hashed AS (SELECT chunk_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS gram FROM found JOIN signed USING (gram_hex))"""


def having_all(*grams_: str) -> str:
    """Chunks that have all of some grams."""
    return "SELECT chunk_id FROM found WHERE gram_hex IN ({}) GROUP BY chunk_id HAVING count(*) = {}".format(", ".join(f"'{g.encode().hex()}'" for g in grams_), len(grams_))


_BLANK = r"[\s\x85\x1c-\x1f\p{Z}]"


def _with_ends(rows: str, most: int) -> str:
    """rows (row_no, no, field, text, s, nth: a piece begins after s characters) with e, where the piece ends."""
    head = "substr(text, CAST(s + 1 AS BIGINT), CAST(k AS BIGINT))"
    upto_break = f"length(regexp_extract({head}, '^(?s:.*)[\\n \\t]'))"
    fits = f"coalesce(list_max(list_filter(range({most} // 4, {most} + 1), lambda k: k <= length(w) AND strlen(substr(w, 1, CAST(k AS BIGINT))) <= {most})), length(w))"
    return f"""
      SELECT row_no, no, field, text, s, nth, s + CASE WHEN s + k >= length(text) OR {upto_break} = 0 THEN k ELSE {upto_break} END AS e FROM (
        SELECT row_no, no, field, text, s, nth, {fits} AS k FROM (SELECT row_no, no, field, text, s, nth, substr(text, CAST(s + 1 AS BIGINT), {most}) AS w FROM {rows}))"""


def pieces(units: str, most: int, overlap: int) -> str:
    """CTEs (the first is recursive); piece has row_no, no, field, nth and t of the pieces of every unit, cut at a line
    end, blank or tab. units: row_no, no, field, text."""
    tail = "substr(text, CAST(e - c + 1 AS BIGINT), CAST(c AS BIGINT))"
    blanks = f"length(regexp_extract(substr(text, CAST(start + 1 AS BIGINT)), '^{_BLANK}*'))"
    return f"""
    step AS (
      SELECT row_no, no, field, text, CAST(0 AS BIGINT) AS s, 0 AS nth FROM {units} WHERE strlen(text) > {most}
      UNION ALL
      SELECT row_no, no, field, text, CAST(start + {blanks} AS BIGINT), nth + 1 FROM (
        SELECT row_no, no, field, text, nth, CASE WHEN c > 0 AND e - c > s THEN e - c ELSE e END AS start FROM (
          SELECT row_no, no, field, text, s, e, nth, coalesce(list_max(list_filter(range(0, {overlap} + 1), lambda c: c <= e AND strlen({tail}) <= {overlap})), 0) AS c
          FROM ({_with_ends("step", most)}) WHERE e < length(text)))
      WHERE start + {blanks} < length(text)),
    piece AS (
      SELECT row_no, no, field, nth, regexp_replace(substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t FROM ({_with_ends("step", most)})
      UNION ALL SELECT row_no, no, field, 0, text FROM {units} WHERE strlen(text) <= {most})"""
