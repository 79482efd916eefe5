"""DuckDB SQL for the queries that SQL can express."""

# DuckDB has no CRC-32: the register is folded over the bytes.  The table entry of a byte is
# the exclusive or of the entries of its bits, each made by the polynomial's rule.
_POLYNOMIAL = 0xEDB88320


def _entry(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ _POLYNOMIAL * (value & 1)
    return value


def _table(byte: str) -> str:
    terms = [f"(({byte} >> {k}) & 1) * {_entry(1 << k)}" for k in range(8)]
    while len(terms) > 1:
        terms = [f"xor({a}, {b})" for a, b in zip(terms[::2], terms[1::2])]
    return terms[0]


_CRC32 = f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, {_table('xor(c & 255, b)')})))"""


def _feistel(rounds: int, key: str) -> str:
    """One pass over (l, r) as nested subqueries; `p` in, `p` out."""
    source = "SELECT *, p % a AS l, p // a AS r FROM {inner}"
    for n in range(rounds):
        one, other, side = ("l", "r", "a") if n % 2 == 0 else ("r", "l", "b")
        mixed = f"('0x' || substr(md5('{key}:{n}:' || {other}), 1, 12))::BIGINT % {side}"
        source = f"SELECT * REPLACE (({one} + {mixed}) % {side} AS {one}) FROM ({source})"
    return f"SELECT * EXCLUDE (l, r) REPLACE (l + r * a AS p) FROM ({source})"


SHARDING = f"""
WITH RECURSIVE numbered AS (
    SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, {_CRC32} AS text_crc32,
        row_number() OVER (ORDER BY doc_id NULLS FIRST, octet_length(encode(coalesce(text, ''))),
            md5(coalesce(text, ''))) - 1 AS row_number,
        count(*) OVER () AS total
    FROM documents),
sides AS (
    SELECT *, ceil(sqrt(total))::BIGINT AS a,
        ceil(total / ceil(sqrt(total)))::BIGINT AS b FROM numbered),
walk AS (
    SELECT row_number, 0 AS step, row_number AS p, a, b, total FROM sides WHERE total > 1
    UNION ALL
    ({_feistel(4, 'shuffle').format(
        inner="(SELECT * REPLACE (step + 1 AS step) FROM walk WHERE step = 0 OR p >= total)")})),
ends AS (SELECT row_number, arg_max(p, step) AS p FROM walk GROUP BY row_number)
SELECT doc_id, size, text_crc32, 'rows' AS law, (coalesce(p, 0) % 40)::INTEGER AS shard,
    (coalesce(p, 0) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM sides LEFT JOIN ends USING (row_number)
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Filters: every order applied to the sets of letters that documents fail.
FILTERS = f"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, {_WORDS} AS words FROM documents),
labelled AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
    SELECT part, good, toxic,
        CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails
    FROM docs LEFT JOIN labelled USING (doc_id)),
sets AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
    SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS x,
        substr(filter_order, 1, step - 1) AS before
    FROM orders, range(1, 6) AS r(step)),
counts AS (
    SELECT part, filter_order, step, x,
        coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept,
        coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
        coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
        coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
    FROM (
        SELECT *, contains(fails, x) AS hit, translate(fails, before, '') <> fails AS gone FROM sets, steps)
    GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM counts
"""


def _inverse(pieces: list[tuple[float, float, float, float]], total: float) -> str:
    """Time at which the integral over (t0, w0, t1, w1) pieces reaches share `x` of `total`."""
    sql, before = "CASE", 0.0
    for t0, w0, t1, w1 in pieces:
        rest, area = f"(x * {total} - {before})", (t1 - t0) * (w0 + w1) / 2
        root = f"sqrt({w0 * w0} + {rest} * {2 * (w1 - w0) / (t1 - t0)})"
        sql += f" WHEN x * {total} < {before + area} THEN {t0}::DOUBLE + {rest} * 2 / ({w0} + {root})"
        before += area
    return f"{sql} END"


MIXING = f"""
WITH sized AS (
    SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
        md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS digest, md5(coalesce(text, '')) AS text_digest
    FROM documents),
sources AS (
    SELECT source, source_size, [3.0, 1.0, 2.0][kind + 1]::DOUBLE AS weight, kind FROM (
        SELECT source, sum(size)::BIGINT AS source_size,
            (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
        FROM sized GROUP BY source)),
shared AS (  -- sources in the order in which they reach twice their size as the level rises
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS wanted,
        coalesce(sum(2 * source_size) OVER (
            ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (
            ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
        row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS place
    FROM sources),
level AS (
    SELECT arg_min((wanted - capped) / left_weight, place) AS level FROM shared
    WHERE weight * ((wanted - capped) / left_weight) <= 2 * source_size),
targets AS (
    SELECT source, source_size, kind, least(2.0::DOUBLE * source_size, weight * coalesce(level, 0)) AS target
    FROM sources, level),
placed AS (
    SELECT doc_id, size, source_size, target, kind, sum(size) OVER (
            PARTITION BY s.source ORDER BY digest, doc_id NULLS FIRST, size, text_digest
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
    SELECT *, greatest(least(round(target)::BIGINT - start, size), 0) AS once,
        greatest(least(round(target)::BIGINT - start - source_size, size), 0) AS again,
        start / target AS x
    FROM placed)
SELECT doc_id, size, source_size, target, (once + again)::BIGINT AS taken,
    CASE WHEN once = 0 THEN NULL
        WHEN kind = 0 THEN {_inverse([(0.0, 4.0, 0.5, 3.0), (0.5, 3.0, 1.0, 2.0)], 3.0)}
        WHEN kind = 1 THEN {_inverse([(0.0, 1.0, 1.0, 1.0)], 1.0)}
        ELSE {_inverse([(0.0, 1.0, 0.5, 2.0), (0.5, 2.0, 1.0, 3.0)], 2.0)} END AS position
FROM taken
"""

_KEY_CRC32 = _CRC32.replace("coalesce(text, '')", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")

# Conversations: the least (cost, initials) of every state, row after row.
CONVERSATIONS = f"""
WITH RECURSIVE keyed AS (
    SELECT *, {_KEY_CRC32} % 20 AS fate, row_number() OVER () AS row FROM conversations),
spoilt AS (
    SELECT conv_id, turn, fate, row,
        CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
            ELSE coalesce(text, ' ') END AS text
    FROM keyed WHERE fate <> 0),
numbered AS (
    SELECT conv_id, turn, role, text, row_number() OVER w AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, row, copy) > 1 AS seen,
        lag(left(role, 1)) OVER w AS before
    FROM (SELECT *, 1 AS copy FROM spoilt UNION ALL SELECT *, 2 FROM spoilt WHERE fate = 3)
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), row, copy)),
judged AS (
    SELECT *, left(role, 1) AS initial,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
            WHEN seen THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM numbered),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        max(i) AS last
    FROM judged GROUP BY conv_id),
put AS (  -- from a state, by up to two messages put in, to another
    SELECT * FROM (VALUES
        ('0', 0, '0', ''), ('0', 1, 'u', 'user:'), ('0', 2, 'a', 'user:' || chr(10) || 'assistant:'),
        ('s', 0, 's', ''), ('s', 1, 'u', 'user:'), ('s', 2, 'a', 'user:' || chr(10) || 'assistant:'),
        ('u', 0, 'u', ''), ('u', 1, 'a', 'assistant:'), ('u', 2, 'u', 'assistant:' || chr(10) || 'user:'),
        ('a', 0, 'a', ''), ('a', 1, 'u', 'user:'), ('a', 2, 'a', 'user:' || chr(10) || 'assistant:')
    ) AS p(state, n, reached, lines)),
edits AS (  -- what may follow a state: kept, given a role, deleted
    SELECT * FROM (VALUES
        ('0', 's', 'K', 's', NULL), ('0', 'u', 'K', 'u', NULL), ('s', 'u', 'K', 'u', NULL),
        ('u', 'a', 'K', 'a', NULL), ('a', 'u', 'K', 'u', NULL),
        ('0', '*', 'R', 'u', 'user'), ('s', '*', 'R', 'u', 'user'), ('u', '*', 'R', 'a', 'assistant'),
        ('a', '*', 'R', 'u', 'user'),
        ('0', '*', 'D', '0', NULL), ('s', '*', 'D', 's', NULL), ('u', '*', 'D', 'u', NULL), ('a', '*', 'D', 'a', NULL)
    ) AS e(reached, initial, letter, ends, new_role)),
best AS (
    SELECT conv_id, 0::BIGINT AS i, '0' AS state,
        {{'cost': 0::BIGINT, 'audit': '', 'body': ''}} AS path
    FROM counts
    UNION ALL
    SELECT b.conv_id, b.i + 1, e.ends, min({{
        'cost': b.path.cost + 3 * p.n + CASE e.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
            + CASE WHEN e.letter <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END,
        'audit': b.path.audit || repeat('I', p.n) || e.letter,
        'body': b.path.body || CASE WHEN p.n > 0 THEN p.lines || chr(10) ELSE '' END
            || CASE WHEN e.letter = 'D' THEN '' ELSE coalesce(e.new_role, j.role) || ':' || j.text || chr(10) END}})
    FROM best b JOIN judged j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = b.i + 1
        JOIN put p ON p.state = b.state
        JOIN edits e ON e.reached = p.reached AND e.initial IN ('*', j.initial)
            AND (e.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
    GROUP BY b.conv_id, b.i, e.ends),
ends AS (
    SELECT b.conv_id, min({{
        'cost': b.path.cost + 3 * p.n, 'audit': b.path.audit || repeat('I', p.n),
        'body': b.path.body || CASE WHEN p.n > 0 THEN p.lines || chr(10) ELSE '' END}}) AS path
    FROM best b JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.last
        JOIN put p ON p.state = b.state AND p.reached IN ('0', 'a')
    GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
    coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(path.cost, 0)::BIGINT AS cost,
    coalesce(path.audit, '') AS audit,
    sha256(CASE WHEN coalesce(path.body, '') = '' THEN '' ELSE left(path.body, length(path.body) - 1) END)
        AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
