"""The registered queries in DuckDB SQL, written from the definitions.

DuckDB matches with RE2, so the patterns stand here unchanged.
"""

from . import workload as W
from .functions import fixed_values as V
from .functions.rules import Rule
from .operators.metrics import SKETCH_ERROR
from .queries import ARRIVALS, HOLD, LIMITS, QUOTA, RATE_LIMIT, RATE_WINDOW


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _chars(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in value)


def _view(name: str, columns: dict[str, str], table: str) -> str:
    body = ", ".join(f"{sql} AS {alias}" for alias, sql in columns.items())
    return f"{name} AS (SELECT {body} FROM {table})"


def _with(*views: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(views) + " "


DOCS = _view("docs", W.document_columns(True), "documents")
PROMPTS = _view("prompts", W.prompt_columns(True), "conversations")
ANSWERS = _view("answers", W.answer_columns(True), "conversations")
REQUESTS = _view("requests", W.request_columns(True), "events")
CONTEXTS = _view("contexts", W.context_columns(True), "events")
LATENCIES = _view("latencies", W.latency_columns(True), "events")
RULE_ROWS = _view("rule_rows", W.rule_row_columns(True), "events")
TENANTS = (
    "tenants AS (SELECT DISTINCT 'key-' || event_type AS api_key, event_type AS tenant_id, "
    "upper(event_type) AS tenant_name FROM events)"
)

# --- text -------------------------------------------------------------------

WS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in V.UNICODE_SPACE) + "]"
NON_WS = "[^" + WS[1:]
ASCII_WS = r"[\t\n\f\r ]"


def strip_invisible(x):
    return f"translate({x}, {_chars(V.INVISIBLE)}, '')"


def fold_leet(x):
    return f"translate({x}, {_text(V.LEET_FROM)}, {_text(V.LEET_TO)})"


def strip_ws(x):
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def collapse(x):
    once = r"'([\p{L}\p{Nd}])[-._/]([\p{L}\p{Nd}])', '\1 \2', 'g'"
    apart = f"regexp_replace(regexp_replace({x}, {once}), {once})"
    word = (
        r"CASE WHEN regexp_full_match(w, '[-._/]*\p{L}[-._/]*') "
        r"THEN chr(1) || regexp_replace(w, '[-._/]', '', 'g') || chr(2) ELSE w END"
    )
    words = f"regexp_extract_all(c, '{NON_WS}+')"
    joined = (
        f"replace(replace(replace(array_to_string(list_transform({words}, lambda w: {word}), ' '), "
        "chr(2) || ' ' || chr(1), ''), chr(1), ''), chr(2), '')"
    )
    chunk = f"CASE WHEN len({words}) = 0 THEN c ELSE {joined} END"
    return (
        f"array_to_string(list_transform(string_split_regex({apart}, '{ASCII_WS}{{2,}}'), "
        f"lambda c: {chunk}), ' ')"
    )


def forms_views(table: str, key: str, text: str) -> list[str]:
    """Views f1 to forms: the six forms of each text as a list."""
    return [
        f"f1 AS (SELECT {key}, {text} AS raw, {strip_invisible(text)} AS clean FROM {table})",
        f"f2 AS (SELECT *, {fold_leet('clean')} AS leet FROM f1)",
        f"forms AS (SELECT *, [raw, clean, leet, {collapse('clean')}, {collapse('leet')}, "
        f"{strip_ws('leet')}] AS forms FROM f2)",
    ]


def _hits(x, pattern):
    return f"len(regexp_extract_all({x}, {_text(pattern)}))"


def _best(body):
    return f"list_max(list_transform(forms, lambda v: {body}))"


def signal_sql() -> dict[str, str]:
    words = f"len(regexp_extract_all(v, '{NON_WS}+'))"
    density = f"({_hits('v', V.OVERRIDE_VERBS)}::DOUBLE / {words})"
    repetition = _best(
        f"CASE WHEN {words} = 0 THEN 0.0::DOUBLE WHEN {density} >= 0.5 THEN 1.0::DOUBLE "
        f"ELSE least({density} / 0.05::DOUBLE, 1.0::DOUBLE) END"
    )
    raw_words = f"regexp_extract_all(raw, '{NON_WS}+')"
    singles = f"len(list_filter({raw_words}, lambda w: length(w) = 1))"
    spelled = f"len({raw_words}) >= 5 AND {singles}::DOUBLE / len({raw_words}) >= 0.4::DOUBLE"
    solid = strip_ws("raw")
    counts = f"map_values(list_histogram(string_split({solid}, '')))"
    total = f"length({solid})"
    bits = (
        f"list_sum(list_transform({counts}, lambda c: -(c::DOUBLE / {total}) * log2(c::DOUBLE / {total})))"
    )
    return {
        "keyword": _best(f"least(0.6::DOUBLE * {_hits('v', V.KEYWORD)}, 1.0::DOUBLE)"),
        "structural": _best(f"least(0.65::DOUBLE * {_hits('v', V.STRUCTURAL)}, 1.0::DOUBLE)"),
        "repetition": (
            f"CASE WHEN {spelled} AND {repetition} > 0 THEN greatest({repetition}, 0.85::DOUBLE) "
            f"ELSE {repetition} END"
        ),
        "boundary": f"least(0.5::DOUBLE * {_hits('raw', V.BOUNDARY)}, 1.0::DOUBLE)",
        "entropy": (
            f"CASE WHEN strlen(raw) < 20 OR {total} = 0 THEN 0.0::DOUBLE WHEN {bits} <= 5 THEN 0.0::DOUBLE "
            f"ELSE least(({bits} - 5.0::DOUBLE) / 1.5::DOUBLE, 1.0::DOUBLE) END"
        ),
    }


def _round2(x):
    return f"round({x} * 100.0::DOUBLE) / 100.0::DOUBLE"


def score_views(table: str, key: str, text: str) -> list[str]:
    """Views up to scored: key columns, rounded signals, score and verdict."""
    signals = ", ".join(f"{sql} AS {name}" for name, sql in signal_sql().items())
    total = " + ".join(f"{n} * {w}::DOUBLE" for n, w in V.SIGNAL_WEIGHTS.items())
    rounded = ", ".join(f"{_round2(n)} AS {n}" for n in V.SIGNAL_WEIGHTS)
    return [
        *forms_views(table, key, text),
        f"signals AS (SELECT * EXCLUDE (raw, clean, leet, forms), {signals} FROM forms)",
        f"totals AS (SELECT *, {_round2('(' + total + ')')} AS score FROM signals)",
        f"scored AS (SELECT * REPLACE ({rounded}), CASE WHEN score >= 0.6::DOUBLE THEN 'block' "
        "WHEN score >= 0.18::DOUBLE THEN 'tag' ELSE 'pass' END AS verdict FROM totals)",
    ]


def flags_sql(x: str) -> dict[str, str]:
    return {n: f"regexp_matches({x}, {_text(p)})" for n, p in V.OUTPUT_PATTERNS.items()}


def unsafe_sql(x: str) -> str:
    return "(" + " OR ".join(flags_sql(x).values()) + ")"


def joined_view(x):
    return f"replace(replace(replace(replace({x}, 'data: ', ''), chr(10), ''), chr(13), ''), '[DONE]', '')"


def spaced_view(x):
    return f"replace(replace(replace(replace({x}, 'data: ', ''), '[DONE]', ''), chr(13), ' '), chr(10), ' ')"


# --- requests ---------------------------------------------------------------


def key_sql(header="auth_header"):
    key = f"regexp_replace(regexp_replace(substr({header}, 8), '^{WS}+', ''), '{WS}+$', '')"
    return f"CASE WHEN starts_with({header}, 'Bearer ') AND {key} <> '' THEN {key} END"


def gate_sql() -> str:
    routes = ", ".join(_text(r) for r in V.ROUTES)
    return (
        f"CASE WHEN path NOT IN ({routes}) THEN 'not_found' WHEN path IN ('/healthz', '/metrics') THEN NULL "
        "WHEN method <> 'POST' THEN 'method_not_allowed' "
        f"WHEN strlen(body) > {LIMITS.max_body_bytes} THEN 'payload_too_large' "
        "WHEN NOT json_valid(body) THEN 'invalid_request_body' "
        "WHEN json_type(body) <> 'OBJECT' THEN 'invalid_request_body' "
        "WHEN coalesce(json_type(body, '$.prompt'), 'NULL') NOT IN ('VARCHAR', 'NULL') THEN 'invalid_request_body' "
        "WHEN coalesce(json_extract_string(body, '$.prompt'), '') = '' THEN 'prompt_required' END"
    )


GATED = (
    f"gate AS (SELECT *, {gate_sql()} AS gate_error FROM requests), "
    "gated AS (SELECT *, CASE gate_error WHEN 'not_found' THEN 404 WHEN 'method_not_allowed' THEN 405 "
    "WHEN 'payload_too_large' THEN 413 WHEN 'invalid_request_body' THEN 400 WHEN 'prompt_required' THEN 400 END "
    "AS gate_status, CASE WHEN gate_error IS NULL AND path NOT IN ('/healthz', '/metrics') THEN json_extract_string(body, '$.prompt') END "
    "AS prompt FROM gate)"
)


def rule_condition(rule: Rule, tokens: str) -> str:
    """A rule's condition; AND and OR from left to right."""
    sql = ""
    for atom in rule.atoms:
        if atom.op == "NOT_IN":
            values = ", ".join(_text(v.lower()) for v in atom.str_values)
            one = f"lower(model) NOT IN ({values})" if values else "TRUE"
        elif atom.field == "request.model":
            one = f"lower(model) = {_text(atom.str_values[0].lower())}"
        else:
            column = "score" if atom.field == "input.risk_score" else tokens
            op = "=" if atom.op == "==" else atom.op
            one = f"{column} {op} {atom.num_value}::DOUBLE"
        sql = f"({sql} {atom.connective} {one})" if sql else f"({one})"
    return sql


def rule_case(value, tokens="daily_tokens", tenants=None, log=False) -> str:
    """CASE over the rules of each tenant; `value` maps a rule to its result.

    With `log` the rules are those in force at `ts`.
    """
    spans = [("own", "TRUE")]
    if log:
        accepted = [(kind, f"TIMESTAMP '{at:%Y-%m-%d %H:%M:%S}'") for kind, _, at in W.RULE_LOG if kind != "faulty"]
        ends = [f" AND ts < {at}" for _, at in accepted[1:]] + [""]
        spans = [(kind, f"ts >= {at}{end}") for (kind, at), end in zip(accepted, ends)]
    arms = []
    for tenant, rules in W.TENANT_RULES.items():
        if tenants and tenant not in tenants:
            continue
        guard = "" if tenants else f"tenant_id = {_text(tenant)} AND "
        for kind, span in spans:
            arms += [
                f"WHEN {guard}{span} AND {rule_condition(r, tokens)} THEN {_text(value(r))}"
                for r in (rules if kind == "own" else W.OLD_RULES)
            ]
    return f"CASE {' '.join(arms)} END"


def verdict_columns(tokens="daily_tokens", tenants=None, log=False) -> str:
    name = rule_case(lambda r: r.rule_name, tokens, tenants, log)
    return (
        f"{name} IS NOT NULL AS matched, {name} AS rule_name, "
        f"{rule_case(lambda r: r.action.upper(), tokens, tenants, log)} AS action, "
        f"{rule_case(lambda r: r.reason, tokens, tenants, log)} AS reason"
    )


def rate_views(source: str, limit: int, window_seconds: float) -> list[str]:
    """Recursive views up to rated(tenant_id, request_id, admitted, remaining)."""
    window_us = int(window_seconds * 1_000_000)
    return [
        f"rate_in AS MATERIALIZED (SELECT tenant_id, request_id, epoch_us(ts) AS us, row_number() OVER "
        f"(PARTITION BY tenant_id ORDER BY ts, request_id) AS rn FROM {source})",
        "rate_fold AS (SELECT DISTINCT tenant_id, 0::BIGINT AS rn, []::BIGINT[] AS log, FALSE AS admitted, "
        "0::BIGINT AS remaining FROM rate_in UNION ALL "
        "SELECT tenant_id, rn, CASE WHEN room THEN list_append(live, us) ELSE live END, room, "
        f"CASE WHEN room THEN {limit} - len(live) - 1 ELSE 0 END FROM ("
        "SELECT r.tenant_id, r.rn, r.us, "
        f"list_filter(f.log, lambda x: x > r.us - {window_us}) AS live, "
        f"len(list_filter(f.log, lambda x: x > r.us - {window_us})) < {limit} AS room "
        "FROM rate_fold f JOIN rate_in r ON r.tenant_id = f.tenant_id AND r.rn = f.rn + 1))",
        "rated AS (SELECT r.tenant_id, r.request_id, f.admitted, f.remaining FROM rate_fold f "
        "JOIN rate_in r ON r.tenant_id = f.tenant_id AND r.rn = f.rn)",
    ]


def quota_fold_views(source: str, limit: int) -> list[str]:
    """Recursive views up to judged; `source` has tenant_id, request_id, ts, score, model, tokens."""
    name = rule_case(lambda r: r.rule_name, "used", log=True)
    action = rule_case(lambda r: r.action.upper(), "used", log=True)
    return [
        "quota_in AS MATERIALIZED (SELECT tenant_id, request_id, ts, CAST(ts AS DATE) AS day, score, model, tokens, "
        f"row_number() OVER (PARTITION BY tenant_id, CAST(ts AS DATE) ORDER BY ts, request_id) AS rn FROM {source})",
        "quota_fold AS (SELECT DISTINCT tenant_id, day, 0::BIGINT AS rn, 0::BIGINT AS used_after, "
        "0::BIGINT AS used, FALSE AS quota_ok, 0::BIGINT AS charged, NULL::VARCHAR AS policy_rule, "
        "NULL::VARCHAR AS policy_action FROM quota_in UNION ALL "
        "SELECT tenant_id, day, rn, used + cost, used, ok, cost, CASE WHEN ok THEN rule END, "
        "CASE WHEN ok THEN act END FROM (SELECT *, "
        "CASE WHEN NOT ok OR act = 'BLOCK' THEN 0 ELSE tokens END::BIGINT AS cost FROM ("
        f"SELECT *, used < {limit} AS ok, {name} AS rule, {action} AS act FROM ("
        "SELECT q.*, f.used_after AS used FROM quota_fold f JOIN quota_in q "
        "ON q.tenant_id = f.tenant_id AND q.day = f.day AND q.rn = f.rn + 1))))",
        "judged AS (SELECT q.tenant_id, q.request_id, CASE WHEN f.quota_ok THEN f.used END AS used_before, "
        "f.quota_ok, f.charged, f.policy_rule, f.policy_action FROM quota_fold f JOIN quota_in q "
        "ON q.tenant_id = f.tenant_id AND q.day = f.day AND q.rn = f.rn)",
    ]


CHARGE = (
    "CASE WHEN input_tokens + output_tokens >= 1 THEN input_tokens + output_tokens "
    "ELSE greatest((strlen(prompt) + strlen(response_text)) // 4, 1) END"
)


def decide_views() -> str:
    """Views up to decided: every request with its answer."""
    open_routes = "('/healthz', '/metrics')"
    reasons = " ".join(
        f"WHEN {_text(r.rule_name)} THEN {_text(r.reason)}"
        for rules in [*W.TENANT_RULES.values(), W.OLD_RULES] for r in rules
    )
    views = [
        REQUESTS, TENANTS, GATED,
        "asked AS (SELECT * FROM gated WHERE prompt IS NOT NULL)",
        *score_views("asked", "request_id", "prompt"),
        f"keyed AS (SELECT *, {key_sql()} AS api_key FROM gated)",
        "stage AS (SELECT k.request_id, k.ts, k.path, k.model, k.provider_error, k.gate_status, k.gate_error, "
        f"t.tenant_id, t.tenant_id IS NULL AND k.path NOT IN {open_routes} AS refused, s.score, s.verdict, "
        "coalesce(s.verdict <> 'block', FALSE) AND k.provider_error IS NULL AND k.path = '/v1/complete' AS billed, "
        f"{unsafe_sql('k.response_text')} AS unsafe, {CHARGE} AS cost "
        "FROM keyed k LEFT JOIN tenants t USING (api_key) LEFT JOIN scored s USING (request_id))",
        f"limited AS (SELECT * FROM stage WHERE tenant_id IS NOT NULL AND path NOT IN {open_routes})",
        *rate_views("limited", LIMITS.requests_per_window, LIMITS.window_seconds),
        "costed AS (SELECT l.tenant_id, l.request_id, l.ts, l.score, l.model, "
        "CASE WHEN r.admitted AND l.billed THEN l.cost ELSE 0 END AS tokens "
        "FROM limited l JOIN rated r USING (request_id))",
        *quota_fold_views("costed", LIMITS.daily_tokens),
        "merged AS (SELECT s.*, r.admitted, r.remaining, j.quota_ok, j.used_before, j.charged, j.policy_rule, "
        "j.policy_action FROM stage s LEFT JOIN rated r USING (request_id) LEFT JOIN judged j USING (request_id))",
        f"answered AS (SELECT *, CASE WHEN path IN {open_routes} THEN NULL WHEN refused THEN 'unauthorized' "
        "WHEN NOT admitted THEN 'rate_limit_exceeded' WHEN NOT quota_ok THEN 'daily_quota_exceeded' "
        "WHEN gate_error IS NOT NULL THEN gate_error WHEN verdict = 'block' THEN 'guardrail_block' "
        "WHEN policy_action = 'BLOCK' THEN 'policy_block' WHEN provider_error = 'timeout' THEN 'provider_timeout' "
        "WHEN provider_error IS NOT NULL THEN 'provider_error' "
        "WHEN unsafe AND billed THEN 'output_policy_violation' END AS error, "
        "coalesce(admitted AND quota_ok AND verdict <> 'block', FALSE) AS policy_evaluated FROM merged)",
        "decided AS (SELECT * REPLACE (coalesce(charged, 0) AS charged, "
        "CASE WHEN policy_evaluated THEN policy_rule END AS policy_rule, "
        "CASE WHEN policy_evaluated THEN policy_action END AS policy_action), "
        f"CASE WHEN policy_evaluated THEN CASE policy_rule {reasons} END END AS policy_reason, "
        "CASE WHEN error IS NULL THEN 200 WHEN error = 'unauthorized' THEN 401 "
        "WHEN error IN ('rate_limit_exceeded', 'daily_quota_exceeded') THEN 429 "
        "WHEN gate_status IS NOT NULL THEN gate_status "
        "WHEN error IN ('guardrail_block', 'policy_block') THEN 403 WHEN path = '/v1/stream' THEN 200 "
        "WHEN error = 'provider_timeout' THEN 504 WHEN error = 'provider_error' THEN 502 ELSE 403 END AS status "
        "FROM answered)",
    ]
    return _with(*views, recursive=True)


# --- streams ----------------------------------------------------------------


def chunk_views(source: str, text: str, keep: str, ended: str = "TRUE") -> list[str]:
    """Views up to chunks(stream_id, chunk_idx, raw, start_b, end_b, total, full_b)."""
    plain = "regexp_replace(regexp_replace(regexp_replace(raw, '[\\x{80}-\\x{7FF}]', chr(1) || chr(1), 'g'), " \
        "'[\\x{800}-\\x{FFFF}]', chr(1) || chr(1) || chr(1), 'g'), " \
        "'[\\x{10000}-\\x{10FFFF}]', chr(1) || chr(1) || chr(1) || chr(1), 'g')"
    return [
        f"word_lists AS (SELECT {keep}, CASE WHEN {ended} THEN list_append(string_split({text}, ' '), '[DONE]') "
        f"ELSE string_split({text}, ' ') END AS words FROM {source})",
        f"word_rows AS (SELECT {keep}, unnest(words) AS word, unnest(range(len(words))) AS chunk_idx FROM word_lists)",
        f"raw_chunks AS (SELECT *, 'data: ' || word || chr(10) || chr(10) AS raw FROM word_rows)",
        f"byte_chunks AS (SELECT * REPLACE ({plain} AS raw) FROM raw_chunks)",
        "placed AS (SELECT *, sum(length(raw)) OVER (PARTITION BY stream_id ORDER BY chunk_idx)::BIGINT AS end_b "
        "FROM byte_chunks)",
        "fulls AS (SELECT stream_id, string_agg(raw, '' ORDER BY chunk_idx) AS full_b, "
        "sum(length(raw))::BIGINT AS total, count(*) AS n_chunks FROM byte_chunks GROUP BY stream_id)",
        "chunks AS (SELECT p.*, p.end_b - length(p.raw) AS start_b, f.full_b, f.total, f.n_chunks "
        "FROM placed p JOIN fulls f USING (stream_id))",
        f"buffers AS (SELECT *, substr(full_b, (greatest(start_b - {HOLD}, 0) + 1)::BIGINT, "
        f"(end_b - greatest(start_b - {HOLD}, 0))::BIGINT) AS buffer FROM chunks)",
        f"scanned AS (SELECT *, {unsafe_sql(joined_view('buffer'))} OR {unsafe_sql(spaced_view('buffer'))} AS unsafe "
        "FROM buffers)",
        f"tails AS (SELECT stream_id, total, n_chunks, right(full_b, {HOLD}) AS tail FROM fulls)",
        f"drains AS (SELECT *, {unsafe_sql(joined_view('tail'))} OR {unsafe_sql(spaced_view('tail'))} AS drain_unsafe "
        "FROM tails)",
        "firsts AS (SELECT stream_id, min(chunk_idx) FILTER (unsafe) AS abort_chunk_idx, "
        "min(start_b) FILTER (unsafe) AS abort_start FROM scanned GROUP BY stream_id)",
        "outcomes AS (SELECT stream_id, n_chunks, total AS total_bytes, "
        "abort_chunk_idx IS NOT NULL OR drain_unsafe AS aborted, "
        "CASE WHEN abort_chunk_idx IS NOT NULL THEN 'flush' WHEN drain_unsafe THEN 'drain' END AS abort_stage, "
        f"abort_chunk_idx, CASE WHEN abort_chunk_idx IS NOT NULL THEN greatest(abort_start - {HOLD}, 0) "
        f"WHEN drain_unsafe THEN greatest(total - {HOLD}, 0) ELSE total END AS forwarded_bytes "
        "FROM firsts JOIN drains USING (stream_id))",
    ]


STREAMS = [ANSWERS, *chunk_views("answers", "answer", "stream_id, tenant_id")]
FORWARDS = (
    "sent AS (SELECT s.*, "
    f"{W.BASE_US} + s.stream_id * 1000000 + s.chunk_idx * 20000 + (s.chunk_idx * s.chunk_idx % 7) * 1000 AS us "
    "FROM scanned s), "
    f"forwards AS (SELECT s.stream_id, s.us FROM sent s JOIN firsts f USING (stream_id) WHERE s.end_b > {HOLD} "
    "AND s.end_b > s.start_b AND (f.abort_chunk_idx IS NULL OR s.chunk_idx < f.abort_chunk_idx))"
)


def _buckets(value: str, by: str, table: str, buckets, digits: int = 3) -> str:
    """Cumulative buckets as rows of le, cumulative, total, sum."""
    bounds = ", ".join(f"({b}::DOUBLE, '{b:.{digits}f}')" for b in buckets)
    keys = ", ".join(f"h.{k}" for k in by.split(", "))
    return (
        f"per AS (SELECT {by}, count(*) AS total, sum({value}) AS sum FROM {table} GROUP BY {by}), "
        f"bounds(b, le) AS (VALUES {bounds}, ('infinity'::DOUBLE, '+Inf')), "
        f"cumulative AS (SELECT {keys}, b.le, b.b, h.total, h.sum, "
        f"(SELECT count(*) FROM {table} x WHERE x.{value} <= b.b AND "
        + " AND ".join(f"x.{k} = h.{k}" for k in by.split(", "))
        + ") AS cumulative FROM per h CROSS JOIN bounds b)"
    )


def _rates(by: str, where: str = "TRUE") -> str:
    step, steps, window = 15_000_000, 4, 60
    return (
        _with(LATENCIES)
        + f"SELECT {by}, make_timestamp(e * {step}) AS window_end, round(count(*) / {window}.0::DOUBLE, 6) AS per_second "
        f"FROM (SELECT {by}, unnest(range(epoch_us(ts) // {step} + 1, epoch_us(ts) // {step} + {steps} + 1)) AS e "
        f"FROM latencies WHERE {where}) GROUP BY {by}, e"
    )


def _rank(q: float) -> str:
    return (
        "(SELECT seconds FROM (SELECT seconds, row_number() OVER (ORDER BY seconds) AS rn, count(*) OVER () AS n "
        f"FROM latencies) WHERE rn = floor((n - 1) * {q}::DOUBLE) + 1)"
    )


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    for name, function in (
        ("strip_invisible", strip_invisible), ("fold_leet", fold_leet),
        ("collapse_spaced", collapse), ("strip_ws", strip_ws),
    ):
        sql[name] = _with(DOCS) + f"SELECT doc_id, {function('text')} AS result FROM docs"
    doc_forms = forms_views("docs", "doc_id", "text")
    sql["prompt_variants"] = _with(DOCS, *doc_forms) + "SELECT doc_id, " + ", ".join(
        f"forms[{i + 1}] AS form_{i}" for i in range(6)
    ) + " FROM forms"
    for name, body in signal_sql().items():
        sql[f"signal_{name}"] = (
            _with(DOCS, *doc_forms) + f"SELECT doc_id, round({body}, 6) AS {name} FROM forms"
        )
    signals = ", ".join(V.SIGNAL_WEIGHTS)
    scored_prompts = score_views("prompts", "prompt_id, tenant_id", "prompt")
    sql["input_scan"] = _with(PROMPTS, *scored_prompts) + (
        f"SELECT prompt_id, tenant_id, score, verdict, {signals} FROM scored"
    )
    sql["live_input_scan"] = sql["input_scan"]
    scored_docs = score_views("docs", "doc_id, lang, source", "text")
    sql["verdict_summary"] = _with(DOCS, *scored_docs) + (
        "SELECT lang, source, count(*) AS n, count(*) FILTER (verdict = 'pass') AS n_pass, "
        "count(*) FILTER (verdict = 'tag') AS n_tag, count(*) FILTER (verdict = 'block') AS n_block, "
        "sum(round(score * 100)::BIGINT)::BIGINT / (count(score) * 100.0::DOUBLE) AS mean_score, max(score) AS max_score FROM scored GROUP BY lang, source"
    )
    sql["corpus_scan"] = _with(
        DOCS, *scored_docs, f"risky AS (SELECT doc_id, {unsafe_sql('text')} AS unsafe FROM docs)"
    ) + (
        "SELECT lang, source, count(*) AS n, count(*) FILTER (verdict = 'block') AS n_block, "
        "count(*) FILTER (verdict = 'tag') AS n_tag, count(*) FILTER (unsafe) AS n_unsafe, "
        "sum(round(score * 100)::BIGINT)::BIGINT / (count(score) * 100.0::DOUBLE) AS mean_score, max(score) AS max_score FROM scored JOIN risky USING (doc_id) "
        "GROUP BY lang, source"
    )

    sql["request_gate"] = _with(REQUESTS, GATED) + (
        "SELECT request_id, path, gate_status, gate_error, prompt FROM gated"
    )
    streams = _view("streams", W.raw_stream_columns(), "conversations")
    sql["sse_frames"] = _with(
        streams,
        "line_rows AS (SELECT stream_id, unnest(string_split_regex(raw, '\\r?\\n')) AS line, "
        "unnest(range(len(string_split_regex(raw, '\\r?\\n')))) AS i FROM streams)",
        "ends AS (SELECT stream_id, min(i) AS last FROM line_rows WHERE line = 'data: [DONE]' GROUP BY stream_id)",
    ) + (
        "SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY i) - 1 AS frame_idx, "
        "substr(line, 7) AS payload FROM line_rows LEFT JOIN ends USING (stream_id) "
        "WHERE starts_with(line, 'data: ') AND (last IS NULL OR i < last)"
    )
    sql["sse_deltas"] = (
        "SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY i) - 1 AS chunk_idx, word AS delta "
        "FROM (SELECT conv_id * 1000 + turn AS stream_id, unnest(string_split(text, ' ')) AS word, "
        "unnest(range(len(string_split(text, ' ')))) AS i FROM conversations) WHERE word <> ''"
    )
    sql["completions"] = (
        "SELECT conv_id * 1000 + turn AS request_id, CASE WHEN conv_id % 5 <> 0 THEN text ELSE '' END AS text, "
        "CASE WHEN turn % 3 <> 0 THEN turn ELSE 0 END AS input_tokens, "
        "CASE WHEN turn % 3 <> 0 THEN length(text) ELSE 0 END AS output_tokens, 'small-chat' AS model FROM conversations"
    )

    keyed = f"keyed AS (SELECT *, {key_sql()} AS api_key FROM requests)"
    sql["authenticate"] = _with(REQUESTS, TENANTS, keyed) + (
        "SELECT request_id, tenant_id, tenant_name, CASE WHEN tenant_id IS NULL AND path NOT IN "
        "('/healthz', '/metrics') THEN 401 END AS auth_status FROM keyed LEFT JOIN tenants USING (api_key)"
    )
    sql["unauthorized"] = _with(REQUESTS, TENANTS, keyed) + (
        "SELECT request_id, path, auth_header FROM keyed k WHERE path NOT IN ('/healthz', '/metrics') "
        "AND NOT EXISTS (SELECT 1 FROM tenants t WHERE t.api_key = k.api_key)"
    )

    sql["policy_first_match"] = _with(CONTEXTS) + (
        f"SELECT request_id, {verdict_columns(tenants=['click'])} FROM contexts"
    )
    sql["policy_rule_join"] = _with(CONTEXTS) + (
        f"SELECT request_id, tenant_id, {verdict_columns()} FROM contexts"
    )
    sql["policy_as_of"] = _with(CONTEXTS) + (
        f"SELECT request_id, tenant_id, {verdict_columns(log=True)} FROM contexts"
    )
    fault = (
        "CASE WHEN field NOT IN ('input.risk_score', 'tenant.daily_tokens', 'request.model') THEN 'unknown_field' "
        "WHEN op = 'NOT_IN' AND field <> 'request.model' THEN 'not_in_on_number' WHEN op = 'NOT_IN' THEN NULL "
        "WHEN field = 'request.model' AND op <> '==' THEN 'unsupported_op' "
        "WHEN field <> 'request.model' AND op NOT IN ('>', '<', '==') THEN 'unsupported_op' "
        "WHEN field <> 'request.model' AND num_value IS NULL THEN 'not_a_number' END"
    )
    checked = (
        f"checked AS (SELECT *, coalesce({fault}, CASE WHEN upper(action) NOT IN "
        "('BLOCK', 'TAG', 'LOG', 'REDACT') THEN 'unknown_action' END) AS fault FROM rule_rows)"
    )
    sql["rule_table_check"] = _with(RULE_ROWS, checked) + (
        "SELECT tenant_id, version, rule_order, rule_name, fault FROM checked WHERE fault IS NOT NULL"
    )
    sql["live_versions"] = _with(
        RULE_ROWS, checked,
        "versions AS (SELECT tenant_id, version, max(written_at) AS written_at, "
        "count(*) FILTER (fault IS NOT NULL) AS n_faulty FROM checked GROUP BY tenant_id, version)",
    ) + (
        "SELECT tenant_id, arg_max(version, written_at) FILTER (n_faulty = 0) AS live_version, "
        "arg_max(version, written_at) AS newest_version, count(*) FILTER (n_faulty > 0) AS n_rejected "
        "FROM versions GROUP BY tenant_id"
    )
    hit_parts = []
    for tenant, rules in W.TENANT_RULES.items():
        for order, rule in enumerate(rules):
            earlier = " AND ".join(
                [f"NOT {rule_condition(r, 'daily_tokens')}" for r in rules[:order]] or ["TRUE"]
            )
            hit_parts.append(
                f"SELECT {_text(tenant)} AS tenant_id, {order} AS rule_order, {_text(rule.rule_name)} AS rule_name, "
                f"count(*) AS n_held, count(*) FILTER ({earlier}) AS n_won, "
                f"count(*) FILTER (NOT ({earlier})) AS n_shadowed FROM contexts "
                f"WHERE tenant_id = {_text(tenant)} AND {rule_condition(rule, 'daily_tokens')}"
            )
    sql["rule_hits"] = _with(CONTEXTS) + " UNION ALL ".join(hit_parts)
    sql["policy_versions"] = (
        "WITH versions AS (SELECT source AS tenant_id, substr(sha256(text), 1, 16) AS version, "
        f"make_timestamp(max({W.BASE_US} + doc_id * 60000000)) AS written_at, count(*) AS n_writes "
        "FROM documents GROUP BY 1, 2), lives AS (SELECT *, written_at + INTERVAL 24 HOURS AS expires_at, "
        "written_at + INTERVAL 24 HOURS > (SELECT max(written_at) FROM versions) AS is_live FROM versions) "
        "SELECT *, is_live AND row_number() OVER (PARTITION BY tenant_id ORDER BY is_live DESC, written_at DESC, "
        "version DESC) = 1 AS is_latest FROM lives"
    )

    flag_columns = ", ".join(f"{body} AS {name}" for name, body in flags_sql("text").items())
    flagged = f"flagged AS (SELECT *, {flag_columns}, {unsafe_sql('text')} AS unsafe FROM docs)"
    names = ", ".join(V.OUTPUT_PATTERNS)
    sql["output_scan"] = _with(DOCS, flagged) + f"SELECT doc_id, {names}, unsafe FROM flagged"
    html_flags = ", ".join(f"{body} AS {name}" for name, body in flags_sql("html").items())
    sql["page_scan"] = f"SELECT page_id, {html_flags}, {unsafe_sql('html')} AS unsafe FROM pages"
    raw = "'data: ' || replace(answer, ' ', chr(10) || chr(10) || 'data: ')"
    sql["output_scan_views"] = _with(
        ANSWERS, f"framed AS (SELECT stream_id, {raw} AS raw FROM answers)",
        f"seen AS (SELECT stream_id, {unsafe_sql(joined_view('raw'))} AS joined_unsafe, "
        f"{unsafe_sql(spaced_view('raw'))} AS spaced_unsafe FROM framed)",
    ) + "SELECT *, joined_unsafe OR spaced_unsafe AS unsafe FROM seen"
    sql["sync_output_block"] = _with(ANSWERS) + (
        "SELECT stream_id, tenant_id, 403 AS status, 'output_policy_violation' AS error FROM answers "
        f"WHERE {unsafe_sql('answer')}"
    )
    sql["pii_counts"] = _with(DOCS, flagged) + "SELECT lang, source, count(*) AS n, " + ", ".join(
        f"count(*) FILTER ({name}) AS n_{name}" for name in [*V.OUTPUT_PATTERNS, "unsafe"]
    ) + " FROM flagged GROUP BY lang, source"

    sql["rate_limit"] = _with(
        CONTEXTS, *rate_views("contexts", RATE_LIMIT, RATE_WINDOW), recursive=True
    ) + "SELECT tenant_id, request_id, admitted, remaining FROM rated"
    sql["live_rate_limit"] = sql["rate_limit"]
    sql["live_policy"] = sql["policy_rule_join"]
    arrived = "".join(
        f"WHEN ts >= TIMESTAMP '{start:%Y-%m-%d}' THEN TIMESTAMP '{start:%Y-%m-%d}' " for start in W.ARRIVAL_STARTS[::-1]
    )
    sql["live_policy_refresh"] = _with(
        _view("all_contexts", W.context_columns(True), "events"),
        f"contexts AS (SELECT * REPLACE (CASE {arrived}ELSE TIMESTAMP '{W.ARRIVAL_STARTS[0]:%Y-%m-%d}' END AS ts) FROM all_contexts)",
    ) + f"SELECT request_id, tenant_id, {verdict_columns(log=True)} FROM contexts"
    sql["daily_quota"] = _with(
        CONTEXTS,
        "sums AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY tenant_id, CAST(ts AS DATE) "
        "ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM contexts)",
    )
    quota_ok = f"before < {QUOTA}"
    sql["live_daily_quota"] = sql["daily_quota"] + (
        f"SELECT tenant_id, request_id, CASE WHEN {quota_ok} THEN before END AS used_before, {quota_ok} AS quota_ok "
        "FROM sums"
    )
    sql["daily_quota"] += (
        f"SELECT tenant_id, request_id, tokens, CASE WHEN {quota_ok} THEN before END AS used_before, "
        f"{quota_ok} AS quota_ok FROM sums"
    )
    sql["quota_policy_fold"] = _with(
        CONTEXTS, *quota_fold_views("contexts", LIMITS.daily_tokens), recursive=True
    ) + "SELECT tenant_id, request_id, used_before, quota_ok, charged, policy_rule, policy_action FROM judged"
    sql["token_usage"] = _with(
        REQUESTS, f"asked AS (SELECT * , body AS prompt FROM requests)",
        f"costed AS (SELECT model AS tenant_id, CAST(ts AS DATE) AS day, CASE WHEN path = '/v1/complete' THEN {CHARGE} "
        "ELSE 0 END AS tokens FROM asked)",
    ) + (
        "SELECT tenant_id, day, sum(tokens)::BIGINT AS tokens, count(*) FILTER (tokens > 0) AS charged_requests "
        "FROM costed GROUP BY tenant_id, day"
    )

    sql["holdback_buffer"] = _with(*STREAMS) + (
        f"SELECT stream_id, chunk_idx, length(buffer) AS buffer_bytes, unsafe, least(end_b, {HOLD}) AS held_bytes, "
        f"greatest(end_b - {HOLD}, 0) AS forwarded_bytes FROM scanned"
    )
    sql["stream_abort"] = _with(*STREAMS) + "SELECT * FROM outcomes"
    half_marked = chunk_views("answers", "answer", "stream_id, tenant_id", "stream_id % 2 = 0")
    sql["live_intercept"] = _with(ANSWERS, *half_marked) + (
        "SELECT stream_id, forwarded_bytes, CASE abort_stage WHEN 'flush' THEN 'abort' "
        "WHEN 'drain' THEN 'drain_abort' END AS stopped FROM outcomes"
    )
    sql["stream_timing"] = _with(
        *STREAMS, FORWARDS,
        "sums AS (SELECT stream_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM forwards GROUP BY stream_id)",
        "spans AS (SELECT stream_id, min(us) AS start_us, max(us) AS end_us FROM sent GROUP BY stream_id)",
    ) + (
        "SELECT stream_id, aborted, n_chunks, coalesce(n, 0) AS n_forwards, "
        "coalesce(first_us, CASE WHEN NOT aborted THEN end_us END) - start_us AS ttft_us, "
        "greatest(coalesce(n, 0) - 1, 0) AS n_gaps, "
        "round(CASE WHEN n > 1 THEN (last_us - first_us)::DOUBLE / (n - 1) ELSE 0 END, 3) AS avg_gap_us, "
        "end_us - start_us AS duration_us FROM outcomes LEFT JOIN sums USING (stream_id) JOIN spans USING (stream_id)"
    )
    sql["inter_chunk_histogram"] = _with(
        *STREAMS, FORWARDS,
        "gaps AS (SELECT stream_id % 5 AS kind, (us - lag(us) OVER (PARTITION BY stream_id ORDER BY us)) / 1e6 AS seconds "
        "FROM forwards)",
        "real_gaps AS (SELECT * FROM gaps WHERE seconds IS NOT NULL)",
        _buckets("seconds", "kind", "real_gaps", V.INTER_CHUNK_BUCKETS),
    ) + "SELECT kind, le, cumulative, total, round(sum, 4) AS sum FROM cumulative"
    sql["ttft_histogram"] = _with(
        *STREAMS, FORWARDS,
        "sums AS (SELECT stream_id, min(us) AS first_us FROM forwards GROUP BY stream_id)",
        "spans AS (SELECT stream_id, min(us) AS start_us, max(us) AS end_us FROM sent GROUP BY stream_id)",
        "times AS (SELECT stream_id % 5 AS kind, (coalesce(first_us, CASE WHEN NOT aborted THEN end_us END) - start_us) "
        "/ 1e6 AS seconds FROM outcomes LEFT JOIN sums USING (stream_id) JOIN spans USING (stream_id))",
        "real_times AS (SELECT * FROM times WHERE seconds IS NOT NULL)",
        _buckets("seconds", "kind", "real_times", V.TTFT_BUCKETS),
    ) + "SELECT kind, le, cumulative, total, round(sum, 4) AS sum FROM cumulative"
    sql["check_histogram"] = _with(
        LATENCIES, "checks AS (SELECT tenant_id, seconds / 1000 AS seconds FROM latencies)",
        _buckets("seconds", "tenant_id", "checks", V.CHECK_BUCKETS, 6),
    ) + "SELECT tenant_id, le, cumulative, total, round(sum, 4) AS sum FROM cumulative"
    sql["stream_aborts"] = _with(*STREAMS) + (
        "SELECT tenant_id, count(*) AS n FROM outcomes JOIN answers USING (stream_id) WHERE aborted GROUP BY tenant_id"
    )

    sql["requests_total"] = _with(LATENCIES) + (
        "SELECT tenant_id, status, path, count(*) AS n FROM latencies WHERE status NOT IN (401, 429) "
        "AND path NOT IN ('/healthz', '/metrics') GROUP BY tenant_id, status, path"
    )
    sql["latency_histogram"] = _with(
        LATENCIES, _buckets("seconds", "tenant_id, path", "latencies", V.REQUEST_BUCKETS)
    ) + "SELECT tenant_id, path, le, cumulative, total, round(sum, 4) AS sum FROM cumulative"
    sql["histogram_quantile"] = _with(
        LATENCIES, _buckets("seconds", "tenant_id", "latencies", V.REQUEST_BUCKETS),
        "steps AS (SELECT *, coalesce(lag(b) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS below "
        "FROM cumulative WINDOW w AS (PARTITION BY tenant_id ORDER BY b))",
        "ranks AS (SELECT s.*, q.q FROM steps s CROSS JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) q(q))",
        "reached AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, q ORDER BY b) AS rn FROM ranks "
        "WHERE cumulative >= q * total)",
    ) + (
        "SELECT tenant_id, q AS quantile, round(CASE WHEN le = '+Inf' THEN low ELSE "
        "low + (b - low) * ((q * total - below) / (cumulative - below)) END, 6) AS value FROM reached WHERE rn = 1"
    )
    sql["rate_per_second"] = _rates("tenant_id")
    sql["error_rate"] = _rates("tenant_id, status", "status BETWEEN 400 AND 599")
    ok = "count(*) FILTER (status BETWEEN 200 AND 299)"
    sql["load_report"] = _with(LATENCIES) + (
        f"SELECT count(*) AS sent, {ok} AS ok, count(*) - {ok} AS errors, "
        f"round({ok} / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) AS throughput, "
        f"{_rank(0.5)} AS p50, {_rank(0.95)} AS p95, {_rank(0.99)} AS p99, max(seconds) AS max_latency, "
        f"(count(*) - {ok})::DOUBLE / count(*) > 0.05 AS too_many_errors FROM latencies"
    )
    step = f"ln({1 + SKETCH_ERROR}::DOUBLE / {1 - SKETCH_ERROR}::DOUBLE)"
    sql["approximate_ranks"] = _with(
        LATENCIES,
        "placed AS (SELECT tenant_id, seconds, row_number() OVER (PARTITION BY tenant_id ORDER BY seconds) - 1 AS place, "
        "count(*) OVER (PARTITION BY tenant_id) AS n FROM latencies WHERE seconds IS NOT NULL)",
        "wanted(quantile) AS (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE))",
    ) + (
        "SELECT tenant_id, quantile, n, round(CASE WHEN seconds > 0 "
        f"THEN exp(ceil(ln(seconds) / {step}) * {step}) * {1 - SKETCH_ERROR}::DOUBLE ELSE 0 END, 6) AS value "
        "FROM placed, wanted WHERE place = floor((n - 1) * quantile)"
    )
    sql["total_requests"] = _with(LATENCIES) + (
        "SELECT count(*) AS total, CASE WHEN count(*) >= 10000 THEN 'red' WHEN count(*) >= 1000 THEN 'yellow' "
        "ELSE 'green' END AS band FROM latencies"
    )

    decided = decide_views()
    sql["decide_complete"] = decided + (
        "SELECT request_id, tenant_id, path, score, verdict, admitted, remaining, quota_ok, used_before, charged, "
        "policy_evaluated, policy_rule, policy_action, policy_reason, status, error, "
        "CASE WHEN error = 'guardrail_block' THEN 'Request blocked by input safety policy' "
        "WHEN error = 'policy_block' THEN policy_reason END AS reason FROM decided WHERE path <> '/v1/stream'"
    )
    stream_texts = "sent_texts AS (SELECT request_id AS stream_id, response_text FROM requests WHERE path = '/v1/stream')"
    with_streams = (
        decided.rstrip() + ", "
        + ", ".join([stream_texts, *[
            v.replace("scanned AS", "scanned_chunks AS", 1).replace("FROM scanned GROUP", "FROM scanned_chunks GROUP")
            for v in chunk_views("sent_texts", "response_text", "stream_id")
        ]])
    )
    ended = (
        ", all_decided AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN error IS NULL AND aborted THEN "
        "'output_policy_violation' ELSE error END AS error), path = '/v1/stream' AS stream, abort_stage, "
        "error IS NULL AND forwarded_bytes > CASE WHEN aborted THEN 0 ELSE "
        f"{LIMITS.window_bytes} END AS first_sent FROM decided d LEFT JOIN outcomes o ON o.stream_id = d.request_id) "
    )
    sql["blocks_total"] = with_streams + ended + (
        "SELECT tenant_id, stage, count(*) AS n FROM (SELECT tenant_id, CASE WHEN error = 'guardrail_block' THEN 'input' "
        "WHEN error = 'output_policy_violation' AND path = '/v1/stream' THEN 'output' "
        "WHEN error = 'output_policy_violation' THEN 'output_sync' END AS stage FROM all_decided) "
        "WHERE stage IS NOT NULL AND tenant_id IS NOT NULL GROUP BY tenant_id, stage"
    )
    sql["policy_verdicts"] = decided + (
        "SELECT tenant_id, coalesce(lower(policy_action), 'pass') AS verdict, count(*) AS n FROM decided "
        "WHERE policy_evaluated GROUP BY 1, 2"
    )
    sql["rate_hits"] = decided + (
        "SELECT tenant_id, CASE error WHEN 'rate_limit_exceeded' THEN 'rate' ELSE 'quota' END AS kind, count(*) AS n "
        "FROM decided WHERE error IN ('rate_limit_exceeded', 'daily_quota_exceeded') GROUP BY 1, 2"
    )
    sql["decide_stream"] = (
        with_streams
        + " SELECT request_id, tenant_id, status, CASE WHEN error IS NULL AND aborted THEN 'output_policy_violation' "
        "ELSE error END AS error, error IS NULL OR error IN ('provider_timeout', 'provider_error') AS opened, "
        "error IS NULL AND coalesce(aborted, FALSE) AS aborted, "
        "CASE WHEN error IS NULL THEN abort_stage END AS abort_stage, "
        "CASE WHEN error IS NULL THEN coalesce(forwarded_bytes, 0) END AS forwarded_bytes "
        "FROM decided d LEFT JOIN outcomes o ON o.stream_id = d.request_id WHERE path = '/v1/stream'"
    )
    early = "('unauthorized', 'rate_limit_exceeded', 'daily_quota_exceeded')"
    handled = f"coalesce(error, '') NOT IN {early}"
    complete = "path = '/v1/complete'"
    arms = [
        ("warn", "auth_failed", "error = 'unauthorized'"),
        ("warn", "rate_limited", "error = 'rate_limit_exceeded'"),
        ("warn", "quota_exceeded", "error = 'daily_quota_exceeded'"),
        ("info", "request_started", handled),
        ("warn", "request_body_too_large", f"{complete} AND error = 'payload_too_large'"),
        ("info", "guardrail_scan", f"verdict IS NOT NULL AND {handled}"),
        ("warn", "guardrail_blocked", "error = 'guardrail_block'"),
        ("warn", "policy_blocked", "error = 'policy_block'"),
        ("error", "provider_timeout", f"{complete} AND error = 'provider_timeout'"),
        ("error", "provider_error", f"{complete} AND error = 'provider_error'"),
        ("info", "provider_response_ok",
         f"{complete} AND coalesce(error, 'output_policy_violation') = 'output_policy_violation'"),
        ("warn", "output_blocked", f"{complete} AND error = 'output_policy_violation'"),
        ("error", "stream_provider_timeout", "stream AND error = 'provider_timeout'"),
        ("error", "stream_provider_error", "stream AND error = 'provider_error'"),
        ("info", "stream_first_chunk_sent", "stream AND first_sent"),
        ("warn", "stream_aborted_unsafe_output",
         "stream AND error = 'output_policy_violation' AND abort_stage = 'flush'"),
        ("warn", "stream_aborted_unsafe_output_drain",
         "stream AND error = 'output_policy_violation' AND abort_stage = 'drain'"),
        ("info", "stream_completed", "stream AND error IS NULL"),
        ("info", "request_completed", handled),
    ]
    sql["audit_log"] = with_streams + ended + (
        " UNION ALL ".join(
            f"SELECT request_id, '{level}' AS level, '{message}' AS message, tenant_id, "
            f"{'status' if message == 'request_completed' else 'NULL::INT'} AS status, "
            f"{'score' if message.startswith('guardrail') else 'NULL::DOUBLE'} AS score, "
            f"{'policy_rule' if message == 'policy_blocked' else 'NULL::VARCHAR'} AS rule FROM all_decided WHERE {condition}"
            for level, message, condition in arms
        )
    )
    sql["live_audit_log"] = sql["audit_log"]
    sql["json_corpus"] = _with(DOCS) + (
        "SELECT doc_id, lang, source, length(text) AS n_chars, md5(text) AS md5 FROM docs"
    )
    sql["live_counters"] = _with(LATENCIES) + (
        "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start, tenant_id, status, count(*) AS n FROM latencies "
        "GROUP BY 1, 2, 3"
    )
    sql["live_histogram"] = _with(
        LATENCIES,
        "daily AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start, tenant_id, seconds FROM latencies)",
        _buckets("seconds", "window_start, tenant_id", "daily", V.REQUEST_BUCKETS),
    ) + "SELECT window_start, tenant_id, le, cumulative, total, round(sum, 4) AS sum FROM cumulative"
    sql["late_rows"] = _with(
        CONTEXTS,
        f"arrived AS (SELECT tenant_id, ts, request_id % {ARRIVALS} AS batch FROM contexts)",
        "newest AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
        "AS known FROM arrived GROUP BY batch)",
    ) + (
        "SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE known IS NULL OR ts >= known - INTERVAL 1 HOUR) "
        "AS in_time FROM arrived JOIN newest USING (batch) GROUP BY tenant_id"
    )
    return sql
