"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import vector_codes


def vector_codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """Every distance of every part, round after round, in doubles that hold whole numbers exactly."""

    def assigned(books: str) -> str:
        return f"""SELECT a.i, a.vec_id, a.label, a.p, a.x, min({{'d': a.xx - 2 * list_inner_product(a.x, b.c) + b.cc, 'e': b.e}}) AS best
            FROM cuts a JOIN {books} b ON a.p = b.p GROUP BY a.i, a.vec_id, a.label, a.p, a.x"""

    def entry(of: str) -> str:
        return f"SELECT p, e, c, list_inner_product(c, c) AS cc FROM ({of})"

    ctes = [
        f"""kept AS (SELECT vec_id, label, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "numbered AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS i, *, len(v) // %d AS w FROM kept)" % parts,
        f"split AS MATERIALIZED (SELECT i, vec_id, label, p, v[p * w + 1 : p * w + w] AS x FROM numbered, range({parts}) t(p))",
        "cuts AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM split)",
        f"books0 AS MATERIALIZED ({entry(f'SELECT p, i AS e, x AS c FROM split WHERE i < {entries}')})",
    ]
    for r in range(rounds):
        ctes += [
            f"near{r} AS MATERIALIZED ({assigned(f'books{r}')})",
            f"""sums{r} AS (SELECT p, best.e AS e, k, sum(CAST(x[k] AS HUGEINT)) AS s, count(*) AS n
            FROM near{r}, unnest(range(1, len(x) + 1)) t(k) GROUP BY ALL)""",
            # Whole numbers, floored: the remainder is made positive first.
            f"means{r} AS (SELECT p, e, list(CAST((s - ((s % n + n) % n)) // n AS DOUBLE) ORDER BY k) AS c FROM sums{r} GROUP BY p, e)",
            f"books{r + 1} AS MATERIALIZED ({entry(f'SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM books{r} b LEFT JOIN means{r} m ON b.p = m.p AND b.e = m.e')})",
        ]
    return f"""WITH {', '.join(ctes)},
        final AS ({assigned(f'books{rounds}')}),
        coded AS (SELECT i, vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
            FROM final GROUP BY i, vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string([CAST(y AS BIGINT) FOR y IN c], ','), ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256
        FROM coded"""


def crc32_sql(text: str) -> str:
    """The CRC-32 of a text of ASCII characters, bit by bit; 3988292384 is the polynomial."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce([CAST(k AS BIGINT) FOR k IN range(8)], lambda c, k: {bit}, xor(h, ch))"
    codes = f"[CAST(ascii(x) AS BIGINT) FOR x IN string_split({text}, '')]"
    return f"xor(list_reduce({codes}, lambda h, ch: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def repair_sql() -> str:
    """Costs back from each conversation's end, then one edit a step, without checkpoints; states count from 1 in lists."""
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    same = "IS NOT DISTINCT FROM"
    return f"""WITH RECURSIVE kinds AS MATERIALIZED (SELECT k, {crc32_sql("k")} % 20 AS kind FROM (SELECT DISTINCT {key} AS k FROM conversations)),
        damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
            FROM conversations JOIN kinds ON k = {key} WHERE kind <> 0),
        told AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, left(role, 1) AS initial,
            right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ends FROM damaged),
        faulty AS (SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM told),
        lines AS MATERIALIZED (SELECT conv_id, i, role, text, turn, fault, pair, CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind,
            fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut FROM faulty),
        sums AS MATERIALIZED (SELECT c.conv_id, count(l.i) AS n, coalesce(max(l.turn) - min(l.turn) + 1 - count(DISTINCT l.turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN lines l ON c.conv_id {same} l.conv_id GROUP BY c.conv_id),
        back AS (SELECT conv_id, n AS i, [0, 4, 2, 0] AS v FROM sums
            UNION ALL SELECT conv_id, i, [least(c0, 2 + bu), least(cs, 2 + bu), bu, ba]
            FROM (SELECT *, least(cu, 2 + ca) AS bu, least(ca, 2 + cu) AS ba FROM (SELECT b.conv_id, l.i,
                least(v[1] + 3, CASE WHEN must THEN 9e9 WHEN kind = 1 THEN least(cut + v[2], 2 + cut + v[3]) WHEN kind = 2 THEN cut + v[3] ELSE 2 + cut + v[3] END) AS c0,
                least(v[2] + 3, CASE WHEN must THEN 9e9 WHEN kind = 2 THEN cut + v[3] ELSE 2 + cut + v[3] END) AS cs,
                least(v[3] + 3, CASE WHEN must THEN 9e9 WHEN kind = 3 THEN cut + v[4] ELSE 2 + cut + v[4] END) AS cu,
                least(v[4] + 3, CASE WHEN must THEN 9e9 WHEN kind = 2 THEN cut + v[3] ELSE 2 + cut + v[3] END) AS ca
                FROM back b JOIN lines l ON b.conv_id {same} l.conv_id AND l.i = b.i - 1))),
        walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, n, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS told FROM sums
            UNION ALL SELECT conv_id, i + CASE edit WHEN 'I' THEN 0 ELSE 1 END, n, CASE edit WHEN 'D' THEN s WHEN 'K' THEN kind ELSE goal END, audit || edit,
                CASE edit WHEN 'D' THEN told WHEN 'K' THEN list_append(told, role || ':' || text)
                ELSE list_append(told, CASE goal WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END
            FROM (SELECT *, CASE WHEN av IS NOT NULL AND nv[s + 1] = 3 + av[s + 1] THEN 'D' WHEN nv[s + 1] = 2 + nv[goal + 1] THEN 'I'
                WHEN NOT must AND (kind = goal OR kind = 1 AND s = 0) AND nv[s + 1] = cut + av[kind + 1] THEN 'K' ELSE 'R' END AS edit
                FROM (SELECT w.*, CASE w.s WHEN 2 THEN 3 ELSE 2 END AS goal, now.v AS nv, after.v AS av, l.* EXCLUDE (conv_id, i)
                    FROM walk w JOIN back now ON w.conv_id {same} now.conv_id AND w.i = now.i
                    LEFT JOIN back after ON w.conv_id {same} after.conv_id AND after.i = w.i + 1
                    LEFT JOIN lines l ON w.conv_id {same} l.conv_id AND l.i = w.i WHERE w.i < w.n OR w.s IN (1, 2))))
        SELECT s.conv_id, s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, CAST(b.v[1] AS BIGINT) AS cost, w.audit,
            sha256(coalesce(array_to_string(w.told, chr(10)), '')) AS repaired_sha256
        FROM sums s JOIN back b ON s.conv_id {same} b.conv_id AND b.i = 0 JOIN walk w ON s.conv_id {same} w.conv_id AND w.i = w.n AND w.s IN (0, 3)"""
