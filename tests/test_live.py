import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardspark.functions import output as O
from wardspark.operators import admission, intercept, quota
from wardspark.sources import tables
from wardspark.streaming import live

BASE = 1_700_000_000_000_000


def requests(spark):
    rng = random.Random(9)
    rows, us = [], BASE
    for rid in range(300):
        us += rng.choice([0, 1, 300_000, 1_000_000, 4_000_000])
        rows.append((rng.choice(["a", "b", "hot", "hot"]), us, rid, rng.choice([0, 3, 9])))
    df = spark.createDataFrame(rows, "tenant_id string, us long, request_id long, tokens long")
    return df.withColumn("ts", F.timestamp_micros("us"))


def as_files(df, folder, part_of, parts):
    """A table folder of `parts` files, written one after the other."""
    for part in range(parts):
        df.filter(part_of == part).coalesce(1).write.mode("append").parquet(folder)


def as_rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(params=["in order", "shuffled"])
def parts(request, spark, tmp_path):
    """Requests over six files, so that state and disorder cross micro-batches."""
    df = requests(spark)
    by = (F.col("request_id") / 50).cast("int") if request.param == "in order" else F.pmod("request_id", F.lit(6))
    as_files(df, f"{tmp_path}/requests.parquet", by, 6)
    stream = tables.stream_table(spark, str(tmp_path), "requests", 1)
    kept, late = tables.split_late(stream, "parts", "1 hour", files_per_trigger=1)
    assert late.count() == 0
    return df, kept


def test_live_limit_equals_batch(parts):
    batch, source = parts
    columns = ("request_id", "admitted", "remaining")
    got = tables.run_available(live.live_rate_limit(source, 3, 10.0, "1 hour"), "limit")
    assert as_rows(got, *columns) == as_rows(admission.admit(batch, 3, 10.0), *columns)


def test_live_quota_equals_batch(parts):
    batch, source = parts
    got = tables.run_available(live.live_daily_quota(source, 200, "1 hour"), "quota")
    want = quota.daily_quota(batch, 200)
    assert as_rows(got.filter("quota_ok"), "request_id", "used_before") == as_rows(
        want.filter("quota_ok"), "request_id", "used_before")
    assert got.count() == want.count()


def test_a_request_is_not_judged_against_later_ones(spark, tmp_path):
    rows = spark.createDataFrame([("t", 100, 0), ("t", 101, 1), ("t", 95, 2)], "tenant_id string, s long, request_id long")
    df = rows.withColumn("ts", F.timestamp_seconds("s"))
    as_files(df, f"{tmp_path}/r.parquet", F.col("request_id"), 3)
    kept, _ = tables.split_late(tables.stream_table(spark, str(tmp_path), "r", 1), "r", "1 minute", files_per_trigger=1)
    got = tables.run_available(live.live_rate_limit(kept, 2, 10.0, "1 minute"), "r")
    assert as_rows(got, "request_id", "admitted") == [(0, True), (1, False), (2, True)]


def test_late_rows_are_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1000, 0), ("t", 2000, 1), ("t", 1500, 2), ("u", 1990, 3)], "tenant_id string, s long, request_id long")
    df = rows.withColumn("ts", F.timestamp_seconds("s"))
    as_files(df, f"{tmp_path}/r.parquet", F.col("request_id"), 4)
    kept, late = tables.split_late(tables.stream_table(spark, str(tmp_path), "r", 1), "r", "60 seconds", files_per_trigger=1)
    assert as_rows(late, "request_id") == [(2,)]
    counts = tables.run_available(live.live_counters(kept, ["tenant_id"], watermark="60 seconds"), "counts")
    assert sum(r.n for r in counts.collect()) == 3


def test_a_batch_of_many_part_files_loses_no_rows(spark, tmp_path):
    """Two batches of 12 files; within a batch the times fall from file to file."""
    hours = F.when(F.col("file") < 12, 40 - F.col("file")).otherwise(70 - F.col("file") * 2)
    df = spark.range(240).select(
        F.lit("t").alias("tenant_id"), F.col("id").alias("request_id"), F.lit(1).cast("long").alias("tokens"),
        F.lit(0.1).alias("seconds"), F.pmod("id", F.lit(24)).cast("int").alias("file"),
    ).withColumn("ts", F.timestamp_seconds(1_700_000_000 + hours * 3600 + F.col("request_id")))
    for batch in (df.filter("file < 12"), df.filter("file >= 12")):
        batch.repartitionByRange(12, "file").write.mode("append").parquet(f"{tmp_path}/r.parquet")
    source = tables.stream_table(spark, str(tmp_path), "r", 12)
    kept, late = tables.split_late(source, "many", "1 hour", files_per_trigger=2)
    forms = {
        "counters": live.live_counters(kept, ["tenant_id"], "ts", "1 hour", "1 hour"),
        "histogram": live.live_histogram(kept, "seconds", ["tenant_id"], window="1 hour", watermark="1 hour")
        .filter("le = double('inf')").withColumnRenamed("cumulative", "n"),
        "limit": live.live_rate_limit(kept, 3, 10.0, "1 hour").withColumn("n", F.lit(1)),
        "quota": live.live_daily_quota(kept, 200, "1 hour").withColumn("n", F.lit(1)),
    }
    got = {
        name: tables.run_available(form.select("tenant_id", "n"), name).filter("tenant_id = 't'").agg(F.sum("n")).first()[0]
        for name, form in forms.items()
    }
    assert late.count() == 80 and got == dict.fromkeys(forms, 160)


def test_the_last_window_is_closed(spark, tmp_path):
    df = requests(spark)
    as_files(df, f"{tmp_path}/r.parquet", F.lit(0), 1)
    kept, _ = tables.split_late(tables.stream_table(spark, str(tmp_path), "r"), "r", "1 hour")
    counts = tables.run_available(live.live_counters(kept, ["tenant_id"], watermark="1 hour"), "counts")
    want = df.groupBy(F.window("ts", "1 minute").start.alias("w"), "tenant_id").count()
    assert as_rows(counts, "window_start", "tenant_id", "n") == as_rows(want, "w", "tenant_id", "count")


def test_a_table_folder_streams_all_its_rows(spark, tmp_path):
    df = requests(spark)
    as_files(df, f"{tmp_path}/r.parquet", F.pmod("request_id", F.lit(3)), 3)
    df.limit(5).write.parquet(f"{tmp_path}/r2.parquet")
    assert tables.run_available(tables.stream_table(spark, str(tmp_path), "r"), "all").count() == 300


@pytest.mark.parametrize("marked", [True, False])
def test_live_interception_equals_batch(spark, tmp_path, marked):
    rng = random.Random(3)
    words = ["a", "me@mail.com", "ſk-" + "x" * 24, "sk-", "AbCdEfGhIjKlMnOpQrStUvWxYz1234", "555-123-", "4567", "tell", "é", "b c"]
    rows = []
    for stream in range(40):
        n = rng.randint(1, 12)
        picked = [rng.choice(words) for _ in range(n)] + (["[DONE]"] if marked else [])
        rows += [(stream, i, BASE + i, f"data: {w}\n\n", rng.randrange(3)) for i, w in enumerate(picked)]
    df = spark.createDataFrame(rows, "stream_id long, chunk_idx long, us long, raw string, file int").withColumn(
        "ts", F.timestamp_micros("us"))
    as_files(df, f"{tmp_path}/c.parquet", F.col("file"), 3)
    kept, _ = tables.split_late(tables.stream_table(spark, str(tmp_path), "c", 1), "c", "1 hour", files_per_trigger=1)
    sent = tables.run_available(live.live_intercept(kept, 32, watermark="1 hour"), "sent")
    out = sent.groupBy("stream_id").agg(
        F.sum(F.octet_length("payload").cast("long")).alias("forwarded_bytes"),
        F.max(F.col("event").isin("abort", "drain_abort")).alias("aborted"),
    )
    want = intercept.stream_abort(df.drop("us", "file"), 32)
    assert as_rows(out, "stream_id", "forwarded_bytes", "aborted") == as_rows(want, "stream_id", "forwarded_bytes", "aborted")


def test_long_s_is_judged_alike(spark):
    text = "ſk-" + "x" * 24
    row = spark.range(1).select(O.stream_unsafe(F.lit(text)).alias("b")).first()
    rows, _, _ = live._let_through(b"", [(0, text.encode())], 512, True)
    assert row.b == (rows[0][1] == "abort")


def test_rules_in_force_when_a_batch_starts(spark, tmp_path):
    from wardspark import workload as W

    as_files(requests(spark), f"{tmp_path}/r.parquet", (F.col("request_id") / 100).cast("int"), 3)
    source = tables.stream_table(spark, str(tmp_path), "r", 1)
    scored = source.select(
        F.lit("click").alias("tenant_id"), "request_id", F.lit(0.7).alias("score"),
        F.lit("small-chat").alias("model"), F.lit(0.0).alias("daily_tokens"),
    )
    seen = []

    def write(df, batch_id):
        seen.append((batch_id, {r.action for r in df.select("action").distinct().collect()}))

    def rules():
        table = W.policy_rules(spark)
        return table.filter("rule_order > 0") if seen else table

    query = live.live_decisions(scored, rules, write).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [(0, {"BLOCK"}), (1, {"TAG"}), (2, {"TAG"})]


def test_late_rows_of_an_input_that_goes_on(spark, tmp_path):
    """The query ends and starts again; a batch that runs twice changes nothing."""
    base, rows = f"{tmp_path}/routed", [(0, 1000), (1, 2000), (2, 1939), (3, 1940), (4, None), (5, 2100), (6, 2039), (7, 1990)]
    batches = [rows[:1], rows[1:2], rows[2:6], [], rows[6:]]

    def frame(part):
        df = spark.createDataFrame(part, "request_id long, s long")
        return df.select("request_id", F.timestamp_seconds("s").alias("ts"))

    schema = frame(rows).schema
    writers = []
    for part in batches:
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        writers.append(tables.route_late(source, base, "60 seconds"))
        writers[-1].trigger(availableNow=True).start().awaitTermination()
    kept, late = tables.routed(spark, base, schema)
    assert as_rows(late, "request_id") == [(2,), (6,), (7,)]
    assert as_rows(kept, "request_id") == [(0,), (1,), (3,), (4,), (5,)]
    # Two rows of the newest time would show up as a second part file.
    assert {r.newest.timestamp() for r in spark.read.parquet(f"{base}/newest").collect()} == {1000, 2000, 2100}


def test_a_batch_routed_again_gives_the_same_files(spark, tmp_path, monkeypatch):
    caught = []
    source = spark.readStream.schema("request_id long, ts timestamp").parquet(str(tmp_path))
    monkeypatch.setattr("pyspark.sql.streaming.DataStreamWriter.foreachBatch", lambda self, f: caught.append(f) or self)
    tables.route_late(source, f"{tmp_path}/routed", "60 seconds")
    (split,) = caught

    def frame(*seconds):
        return spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "request_id long, s long").select(
            "request_id", F.timestamp_seconds("s").alias("ts"))

    split(frame(1000), 0)
    for _ in range(2):
        split(frame(5000, 900, 960), 1)
    kept, late = tables.routed(spark, f"{tmp_path}/routed", frame(1).schema)
    assert (kept.count(), late.count()) == (3, 1)


def test_json_lines_with_a_schema(spark, tmp_path):
    lines = ['{"id": 1, "text": "é \\u0000 x", "more": 1}', '{"id": "x", "text": "a"}', "[1", '{"text": null}', "{}"]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    rows, bad = tables.read_json(spark, str(tmp_path / "lines.json"), "id long, text string")
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, "é \x00 x"), (None, None), (None, None)]
    assert {r.line for r in bad.collect()} == {lines[1], lines[2]}
    (tmp_path / "none.json").write_text("")
    assert [df.count() for df in tables.read_json(spark, str(tmp_path / "none.json"), "id long")] == [0, 0]


def test_a_batch_judged_again_has_its_first_rules(spark, tmp_path, monkeypatch):
    """A failure after the rules were read and before the batch was done."""
    from wardspark import workload as W

    scored = requests(spark).select(
        F.lit("click").alias("tenant_id"), "request_id", F.lit(0.7).alias("score"),
        F.lit("small-chat").alias("model"), F.lit(0.0).alias("daily_tokens"),
    )
    scored.coalesce(1).write.parquet(f"{tmp_path}/in")
    state = {"fails": True, "now": W.policy_rules(spark)}

    def write(decided, batch_id):
        if state["fails"]:
            raise RuntimeError("lost")
        decided.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")

    def run():
        source = spark.readStream.schema(scored.schema).parquet(f"{tmp_path}/in")
        query = live.live_decisions(source, lambda: state["now"], write, f"{tmp_path}/rules")
        query.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    state.update(fails=False, now=W.policy_rules(spark).filter("rule_order > 0"))
    run()
    scored.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    out = spark.read.parquet(f"{tmp_path}/out").select("batch", "action").distinct()
    assert as_rows(out, "batch", "action") == [(0, "BLOCK"), (1, "TAG")]


class _State:
    def __init__(self):
        self.exists, self.get, self.watermark, self.wake = False, None, 0, None

    def update(self, value):
        self.exists, self.get = True, value

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        self.wake = at


def test_waiting_rows_are_packed_and_leave_in_parts():
    """Rows that wait are a few bytes each, and decided ones leave a part at a time."""
    schema, state, n = pa.schema([("us", pa.int64()), ("request_id", pa.int64())]), _State(), 50_000
    held = live._Held(state, schema)
    held.add([pd.DataFrame({"us": range(n, 0, -1), "request_id": range(n)})])
    assert not list(held.due())
    held.keep([], None)
    assert len(state.get[0]) < 20 * n
    state.watermark = 40
    held = live._Held(state, schema)
    parts = list(held.due())
    held.keep([7], None)
    assert [len(p) for p in parts] == [10_000] * 4
    assert parts[0][:2] == [(1, n - 1), (2, n - 2)]
    assert state.get[1] == [7] and state.wake == 41
    state.watermark = 100
    assert [len(p) for p in live._Held(state, schema).due()] == [10_000]
