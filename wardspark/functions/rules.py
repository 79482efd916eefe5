"""Policy rules as data: conditions, first match, bundles per tenant.

A rule row is (tenant_id, version, rule_order, rule_name, atoms, action, reason, written_at).
An atom is (connective, field, op, num_value, str_values); AND and OR rank equally
and associate to the left.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as V

ATOM_TYPE = (
    "struct<connective:string,field:string,op:string,num_value:double,str_values:array<string>>"
)
RULE_SCHEMA = (
    "tenant_id string, version string, rule_order int, rule_name string, "
    f"atoms array<{ATOM_TYPE}>, action string, reason string, written_at timestamp"
)
VERDICT_FIELDS = ("rule_name", "action", "reason")


@dataclass(frozen=True)
class Atom:
    field: str
    op: str
    num_value: float | None = None
    str_values: tuple[str, ...] = ()
    connective: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_name: str
    atoms: tuple[Atom, ...] = field(default=())
    action: str = "BLOCK"
    reason: str = ""


def _literal_atom(atom: Atom, score: Column, model: Column, tokens: Column) -> Column:
    if atom.op == "NOT_IN":
        listed = [v.lower() for v in atom.str_values]
        return ~F.lower(model).isin(*listed) if listed else F.lit(True)
    if atom.field in V.STRING_FIELDS:
        return F.lower(model) == atom.str_values[0].lower()
    value = score if atom.field == "input.risk_score" else tokens
    bound = F.lit(float(atom.num_value))
    return {">": value > bound, "<": value < bound, "==": value == bound}[atom.op]


def compiled_first_match(
    rules: list[Rule], score: Column, model: Column, tokens: Column
) -> Column:
    """First matching rule of a fixed list, as one CASE expression.

    A struct of rule_name, action and reason; null if no rule matches.
    """
    result = None
    for rule in rules:
        holds = None
        for atom in rule.atoms:
            value = _literal_atom(atom, score, model, tokens)
            if holds is None:
                holds = value
            else:
                holds = (holds & value) if atom.connective == "AND" else (holds | value)
        outcome = F.struct(
            F.lit(rule.rule_name).alias("rule_name"),
            F.lit(rule.action.upper()).alias("action"),
            F.lit(rule.reason).alias("reason"),
        )
        result = F.when(holds, outcome) if result is None else result.when(holds, outcome)
    return result if result is not None else F.lit(None)


def _atom_holds(atom: Column, score: Column, model: Column, tokens: Column) -> Column:
    value = F.when(atom["field"] == "input.risk_score", score).when(
        atom["field"] == "tenant.daily_tokens", tokens
    )
    return (
        F.when(atom["op"] == "NOT_IN", ~F.array_contains(atom["str_values"], F.lower(model)))
        .when(atom["field"] == "request.model", F.get(atom["str_values"], F.lit(0)) == F.lower(model))
        .when(atom["op"] == ">", value > atom["num_value"])
        .when(atom["op"] == "<", value < atom["num_value"])
        .otherwise(value == atom["num_value"])
    )


def rule_holds(rule: Column, score: Column, model: Column, tokens: Column) -> Column:
    """Left fold over the atoms of one rule."""

    def step(acc, atom):
        holds = _atom_holds(atom, score, model, tokens)
        return (
            F.when(acc.isNull(), holds)
            .when(atom["connective"] == "AND", acc & holds)
            .otherwise(acc | holds)
        )

    return F.aggregate(rule["atoms"], F.lit(None).cast("boolean"), step)


def first_match(rules: Column, score: Column, model: Column, tokens: Column) -> Column:
    """First rule of an ordered array that holds, null if none does."""
    return F.get(
        F.filter(rules, lambda rule: rule_holds(rule, score, model, tokens)), F.lit(0)
    )


def first_match_index(rules: Column, score: Column, model: Column, tokens: Column) -> Column:
    """Place of the first rule that holds, -1 if none does."""
    held = F.transform(rules, lambda rule: rule_holds(rule, score, model, tokens))
    return F.coalesce(F.array_position(held, True).cast("int") - 1, F.lit(-1))


def bundles(rules: DataFrame, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """(tenant_id, rules): the rules of one version per tenant in order, values in lower case.

    `by` names the columns that tell versions apart, where there are several.

    A bundle is one policy file's worth of rules, so the array is small.
    """
    atoms = F.transform(
        F.col("atoms"),
        lambda a: a.withField(
            "str_values",
            F.transform(
                F.coalesce(a["str_values"], F.array().cast("array<string>")), lambda v: F.lower(v)
            ),
        ),
    )
    entry = F.struct(
        "rule_order", "rule_name", F.upper("action").alias("action"), "reason",
        atoms.alias("atoms"),
    )
    return rules.groupBy(*by).agg(
        F.array_sort(F.collect_list(entry), lambda a, b: a["rule_order"] - b["rule_order"]).alias("rules")
    )


def token_bounds(rules: Column) -> Column:
    """Sorted distinct constants that the rules compare the day's tokens with."""
    atoms = F.flatten(F.transform(rules, lambda rule: rule["atoms"]))
    reading = F.filter(atoms, lambda a: a["field"] == "tenant.daily_tokens")
    return F.array_sort(F.array_distinct(F.transform(reading, lambda a: a["num_value"])))


def token_samples(bounds: Column) -> Column:
    """One token total from each range: below a bound, at it, ..., above the last."""
    inner = F.flatten(
        F.transform(
            bounds,
            lambda bound, i: F.array(
                F.when(i == 0, bound - 1).otherwise((F.get(bounds, i - 1) + bound) / 2), bound
            ),
        )
    )
    last = F.coalesce(F.get(bounds, F.size(bounds) - 1) + 1, F.lit(0.0))
    return F.concat(inner, F.array(last))
