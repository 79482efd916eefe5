"""Request bodies, event streams and completion documents as tables.

Each raw document lies in one row, so order within it is handled by array
functions in that row: no window and no shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V


def _variant_string(variant: Column, path: str) -> Column:
    """The string at `path`, null if absent or of another type."""
    value = F.variant_get(variant, path, "variant")
    return F.when(
        F.schema_of_variant(value) == "STRING", F.variant_get(variant, path, "string")
    )


def gate_requests(
    requests: DataFrame, max_bytes: int = V.MAX_BODY_BYTES, keep: list[str] | None = None
) -> DataFrame:
    """Method, size and body checks in order; adds gate_status, gate_error, prompt.

    The key `prompt` is read as written (no case folding); a null or absent prompt
    counts as empty, any other type as a bad body.
    """
    keep = keep if keep is not None else requests.columns
    body = F.col("body")
    needed = [c for c in ("method", "path") if c not in keep]
    # Oversized bodies are refused before they are decoded.
    parsed = requests.select(
        *keep,
        *needed,
        F.octet_length(body).alias("_bytes"),
        F.when(
            (F.col("method") == "POST") & (F.octet_length(body) <= max_bytes),
            F.try_parse_json(body),
        ).alias("_json"),
    )
    kind = F.schema_of_variant(F.col("_json"))
    prompt_kind = F.coalesce(
        F.schema_of_variant(F.variant_get(F.col("_json"), "$.prompt", "variant")), F.lit("VOID")
    )
    error = (
        F.when(~F.col("path").isin(*V.ROUTES), "not_found")
        .when(F.col("path").isin(*V.OPEN_ROUTES), None)
        .when(F.col("method") != "POST", "method_not_allowed")
        .when(F.col("_bytes") > max_bytes, "payload_too_large")
        .when(F.col("_json").isNull(), "invalid_request_body")
        .when(~(kind.startswith("OBJECT") | (kind == "VOID")), "invalid_request_body")
        .when(~prompt_kind.isin("STRING", "VOID"), "invalid_request_body")
        .when(
            F.coalesce(_variant_string(F.col("_json"), "$.prompt"), F.lit("")) == "",
            "prompt_required",
        )
    )
    status = (
        F.when(F.col("gate_error") == "not_found", 404)
        .when(F.col("gate_error") == "method_not_allowed", 405)
        .when(F.col("gate_error") == "payload_too_large", 413)
        .when(F.col("gate_error").isNotNull(), 400)
    )
    return (
        parsed.withColumn("gate_error", error)
        .withColumn("gate_status", status)
        .withColumn(
            "prompt",
            F.when(
                F.col("gate_error").isNull() & ~F.col("path").isin(*V.OPEN_ROUTES),
                _variant_string(F.col("_json"), "$.prompt"),
            ),
        )
        .select(*keep, "gate_status", "gate_error", "prompt")
    )


def _frames(raw: Column) -> Column:
    """Payloads of the data lines before the end mark, in order."""
    lines = F.split(F.regexp_replace(raw, r"\r\z", ""), r"\r?\n", -1)
    end = F.array_position(lines, F.lit(V.DATA_PREFIX + V.DONE))
    before = F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
    return F.transform(
        F.filter(before, lambda line: line.startswith(V.DATA_PREFIX)),
        lambda line: F.substring(line, len(V.DATA_PREFIX) + 1, 2**31 - 1),
    )


def parse_sse_frames(raw_streams: DataFrame) -> DataFrame:
    """(stream_id, frame_idx, payload) of each raw event stream."""
    return raw_streams.select(
        "stream_id", F.posexplode(_frames(F.col("raw"))).alias("frame_idx", "payload")
    ).withColumn("frame_idx", F.col("frame_idx").cast("long"))


def extract_deltas(raw_streams: DataFrame) -> DataFrame:
    """(stream_id, chunk_idx, delta) of each raw stream of JSON frames.

    Malformed frames, frames without choices and empty deltas are skipped.
    """
    parsed = F.transform(_frames(F.col("raw")), F.try_parse_json)  # each frame once
    deltas = F.filter(
        F.transform(parsed, lambda frame: _variant_string(frame, "$.choices[0].delta.content")),
        lambda delta: delta.isNotNull() & (delta != ""),
    )
    return raw_streams.select(
        "stream_id", F.posexplode(deltas).alias("chunk_idx", "delta")
    ).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


_COMPLETION = (
    "model STRING, choices ARRAY<STRUCT<message: STRUCT<content: STRING>>>, "
    "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>"
)


def parse_completions(raw: DataFrame, raw_col: str, keep: list[str]) -> DataFrame:
    """Text, token counts and model of each completion document."""
    doc = F.from_json(F.col(raw_col), _COMPLETION)
    parsed = raw.select(*keep, doc.alias("_doc"))
    zero, empty = F.lit(0).cast("long"), F.lit("")
    return parsed.select(
        *keep,
        F.coalesce(F.get(F.col("_doc.choices"), F.lit(0))["message"]["content"], empty).alias("text"),
        F.coalesce(F.col("_doc.usage.prompt_tokens"), zero).alias("input_tokens"),
        F.coalesce(F.col("_doc.usage.completion_tokens"), zero).alias("output_tokens"),
        F.coalesce(F.col("_doc.model"), empty).alias("model"),
    )
