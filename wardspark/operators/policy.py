"""Policy evaluation, rule checks and policy versions."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions import rules as R
from ..session import broadcast_if_small, write_stage


def evaluate_policy(
    requests: DataFrame,
    rules: list[R.Rule],
    score: str = "score",
    model: str = "model",
    tokens: str = "daily_tokens",
    force_model: str | None = None,
) -> DataFrame:
    """Add matched, rule_name, action, reason for one fixed list of rules.

    The rules become a CASE expression: no join and no shuffle.  `force_model`
    evaluates every request as that model.
    """
    model_col = F.lit(force_model) if force_model else F.col(model)
    hit = R.compiled_first_match(rules, F.col(score), model_col, F.col(tokens))
    return _with_verdict(requests.withColumn("_hit", hit))


def evaluate_tenant_policies(
    requests: DataFrame,
    rules: DataFrame,
    score: str = "score",
    model: str = "model",
    tokens: str = "daily_tokens",
    force_model: str | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Add matched, rule_name, action, reason from the rules of each row's tenant.

    The newest accepted version of a tenant's rules is in force, or with `as_of`, the
    version in force at the time in that column.  The join brings each request that
    version's rules as one array, so there is no row per (request, rule) and nothing to
    aggregate afterwards.
    """
    if as_of:
        joined = with_rules_of_the_time(requests, rules, as_of)
    else:
        joined = requests.join(broadcast_if_small(bundles_in_force(rules)), "tenant_id", "left")
    model_col = F.lit(force_model) if force_model else F.col(model)
    hit = R.first_match(F.col("rules"), F.col(score), model_col, F.col(tokens))
    return _with_verdict(joined.withColumn("_hit", hit).drop("rules")).select(
        *requests.columns, "matched", *R.VERDICT_FIELDS
    )


def _with_verdict(df: DataFrame) -> DataFrame:
    hit = F.col("_hit")
    return df.select(
        "*",
        hit.isNotNull().alias("matched"),
        *[hit[name].alias(name) for name in R.VERDICT_FIELDS],
    ).drop("_hit")


def rules_in_force(rules: DataFrame) -> DataFrame:
    """The rows of each tenant's newest version that has no faulty rule."""
    live = live_versions(rules).select("tenant_id", F.col("live_version").alias("version"))
    return rules.join(live, ["tenant_id", "version"], "left_semi")


def bundles_in_force(rules: DataFrame) -> DataFrame:
    """(tenant_id, rules) of the versions in force."""
    return R.bundles(rules_in_force(rules))


_WRITING = ("tenant_id", "version", "written_at")


def _dated(rules: DataFrame) -> DataFrame:
    """Rules without a time are as old as can be."""
    first = F.lit("0001-01-01 00:00:00").cast("timestamp")
    return rules.withColumn("written_at", F.coalesce(F.col("written_at").cast("timestamp"), first))


def accepted_writings(rules: DataFrame) -> DataFrame:
    """(tenant_id, version, written_at) of each time a version without a faulty rule was written."""
    return _dated(rules).groupBy(*_WRITING).agg(F.count_if(_rule_fault().isNotNull()).alias("_faulty")).filter(
        "_faulty = 0"
    ).drop("_faulty")


def with_rules_of_the_time(
    requests: DataFrame, rules: DataFrame, ts: str = "ts", tenant: str = "tenant_id",
    bundles: DataFrame | None = None,
) -> DataFrame:
    """Add `in_force` (written_at, version) and `rules` as they were at the time of each request.

    A version is in force from when it was written until the next accepted one of its
    tenant; a faulty version changes nothing, one written again is in force again.
    Before a tenant's first there are no rules; a version without a time was always there.  A tenant's times form one short array, in
    which a request finds its version; a second join on tenant and version brings the
    rules.  Both are joins on equal keys, so no request meets a version that it does not use.

    Times and rules are written before, so that Spark knows how small they are and need not
    bring all requests of a tenant together.  `bundles` are `writing_bundles(rules)` if a
    caller has them written already.
    """
    bundles = write_stage(writing_bundles(rules), "rules") if bundles is None else bundles
    entry = F.struct("written_at", "version")
    times = write_stage(
        accepted_writings(rules).groupBy(F.col("tenant_id").alias("_of")).agg(
            F.sort_array(F.collect_list(entry)).alias("_times")
        ), "rule-times",
    )
    earlier = F.filter("_times", lambda t: t["written_at"] <= F.col(ts))
    placed = requests.join(broadcast_if_small(times), F.col(tenant) == F.col("_of"), "left").withColumn(
        "in_force", F.get(earlier, F.size(earlier) - 1)
    ).drop("_of", "_times")
    return placed.join(
        broadcast_if_small(bundles),
        (F.col(tenant) == F.col("_of")) & (F.col("in_force") == F.col("_writing")), "left",
    ).drop("_of", "_writing")


def writing_bundles(rules: DataFrame) -> DataFrame:
    """(_of, _writing, rules): the rules of each accepted writing of each tenant."""
    kept = _dated(rules).join(accepted_writings(rules), list(_WRITING), "left_semi")
    return R.bundles(kept, _WRITING).select(
        F.col("tenant_id").alias("_of"), F.struct("written_at", "version").alias("_writing"), "rules"
    )


def rule_hits(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule in force: how often it held, was the first to hold, and was shadowed."""
    rules = rules_in_force(rules)
    joined = requests.join(broadcast_if_small(R.bundles(rules)), "tenant_id")
    held = F.filter(
        F.col("rules"),
        lambda rule: R.rule_holds(rule, F.col("score"), F.col("model"), F.col("daily_tokens")),
    )
    orders = F.transform(held, lambda rule: rule["rule_order"])
    hits = joined.select("tenant_id", F.posexplode(orders).alias("_pos", "rule_order"))
    counts = hits.groupBy("tenant_id", "rule_order").agg(
        F.count(F.lit(1)).alias("_held"), F.count_if(F.col("_pos") == 0).alias("_won")
    )
    return rules.select("tenant_id", "rule_order", "rule_name").join(
        counts, ["tenant_id", "rule_order"], "left"
    ).select(
        "tenant_id",
        "rule_order",
        "rule_name",
        F.coalesce("_held", F.lit(0)).alias("n_held"),
        F.coalesce("_won", F.lit(0)).alias("n_won"),
        (F.coalesce("_held", F.lit(0)) - F.coalesce("_won", F.lit(0))).alias("n_shadowed"),
    )


def _atom_fault(atom: Column) -> Column:
    numeric = atom["field"].isin(*V.NUMERIC_FIELDS)
    text = atom["field"].isin(*V.STRING_FIELDS)
    return (
        F.when(~(numeric | text) | atom["field"].isNull(), "unknown_field")
        .when(atom["op"].isNull(), "unsupported_op")
        .when((atom["op"] == "NOT_IN") & numeric, "not_in_on_number")
        .when(atom["op"] == "NOT_IN", None)
        .when(numeric & ~atom["op"].isin(">", "<", "=="), "unsupported_op")
        .when(numeric & atom["num_value"].isNull(), "not_a_number")
        .when(text & (atom["op"] != "=="), "unsupported_op")
        .when(text & F.get(atom["str_values"], F.lit(0)).isNull(), "no_value")
    )


def _rule_fault() -> Column:
    """The first fault of a rule: its atoms, how they are joined, its action."""
    faults = F.filter(F.transform(F.col("atoms"), _atom_fault), lambda fault: fault.isNotNull())
    joins = F.transform(F.slice("atoms", 2, F.greatest(F.size("atoms"), F.lit(1))), lambda a: a["connective"])
    known = F.forall(joins, lambda c: F.coalesce(c.isin("AND", "OR"), F.lit(False)))
    return F.coalesce(
        F.when(F.coalesce(F.size("atoms") < 1, F.lit(True)), "no_condition"),
        F.get(faults, F.lit(0)),
        F.when(~known, "unknown_connective"),
        F.when(~F.coalesce(F.upper("action").isin(*V.ACTIONS), F.lit(False)), "unknown_action"),
    )


def rule_table_check(rules: DataFrame) -> DataFrame:
    """Faulty rules with the first fault of each."""
    return (
        rules.withColumn("fault", _rule_fault())
        .filter(F.col("fault").isNotNull())
        .select("tenant_id", "version", "rule_order", "rule_name", "fault")
    )


def live_versions(rules: DataFrame) -> DataFrame:
    """Newest version of each tenant without a faulty rule.

    `rules` has written_at; a faulty version leaves the one before it in force.
    """
    faulty = _rule_fault().isNotNull()
    versions = rules.groupBy("tenant_id", "version").agg(
        F.max("written_at").alias("written_at"),
        F.count(F.lit(1)).alias("n_rules"),
        F.count_if(faulty).alias("n_faulty"),
    )
    newest = F.struct("written_at", "version")
    return versions.groupBy("tenant_id").agg(
        F.max(F.when(F.col("n_faulty") == 0, newest))["version"].alias("live_version"),
        F.max(newest)["version"].alias("newest_version"),
        F.count_if(F.col("n_faulty") > 0).alias("n_rejected"),
    )


def content_version(source: Column) -> Column:
    """Content address of a policy source."""
    return F.substring(F.sha2(source.cast("binary"), 256), 1, V.VERSION_HEX_CHARS)


def register_policy_versions(
    sources: DataFrame, as_of: Column | None = None, ttl_hours: int = V.POLICY_TTL_HOURS
) -> DataFrame:
    """Content-addressed versions: one row per (tenant, version) ever written.

    Writing the same source again renews the entry; entries end `ttl_hours` after
    their last write.  `is_live` tells those there at `as_of`, by default the time of
    the newest write; `is_latest` marks each tenant's newest live version.
    """
    if as_of is None:
        as_of = F.lit(sources.agg(F.max("written_at")).first()[0])
    # Only the hash, not the source text, is shuffled.
    versions = (
        sources.select("tenant_id", content_version(F.col("source")).alias("version"), "written_at")
        .groupBy("tenant_id", "version")
        .agg(F.max("written_at").alias("written_at"), F.count(F.lit(1)).alias("n_writes"))
        .withColumn("expires_at", F.col("written_at") + F.expr(f"INTERVAL {ttl_hours} HOURS"))
        .withColumn("is_live", (F.col("written_at") <= as_of) & (F.col("expires_at") > as_of))
    )
    latest = versions.groupBy("tenant_id").agg(
        F.max(F.when(F.col("is_live"), F.struct("written_at", "version")))["version"].alias("_latest")
    )
    return versions.join(latest, "tenant_id").select(
        "tenant_id", "version", "written_at", "n_writes", "expires_at", "is_live",
        F.coalesce(F.col("version") == F.col("_latest"), F.lit(False)).alias("is_latest"),
    )
