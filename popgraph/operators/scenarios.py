"""Profiles of entities across scenarios, their contrasts, and descriptions of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features of the exposure scenarios, and all scenarios with their features.
EXPOSURE = ["avg_adjustment_factor", "contact_avoidance_proxy", "tool_usage_intensity", "adjustment_volatility", "isolation_decision_prob", "response_speed"]
SCENARIOS = {
    "household_exposure": EXPOSURE,
    "workplace_exposure": EXPOSURE,
    "community_exposure": EXPOSURE,
    "infection_recovery": ["recovery_adjustment_factor", "symptom_monitoring_intensity", "adjustment_volatility", "tool_usage_intensity"],
    "post_recovery": ["reinfection_risk_adjustment", "immunity_confidence_score", "tool_usage_intensity"],
}
#: Suffixes of the compared scenarios and the prefixes kept for clustering.
PAIRS = {"hw": ("household_exposure", "workplace_exposure"), "hc": ("household_exposure", "community_exposure"), "wc": ("workplace_exposure", "community_exposure")}
CONTRASTED = {"avg": "avg_adjustment_factor", "contact": "contact_avoidance_proxy", "adjustment": "adjustment_volatility", "response": "response_speed"}
KEPT_PREFIXES = ("rel_adjustment_", "rel_response_", "delta_response_", "gate_adjustment_", "rel_contact_", "gate_response_")
MICRO = 1000000
#: How descriptions name the compared scenarios.
VERSUS = {"hw": "home vs work", "hc": "home vs community", "wc": "work vs community"}


def profile_names() -> list[str]:
    return [f"{s}:{x}" for s, features in SCENARIOS.items() for x in features]


def conditional_profile(traces: DataFrame, key: str, order: str, motifs: str = "motifs") -> DataFrame:
    """(key, profile): 25 entries of an entity's first trace, in the order of ``profile_names``.

    ``motifs`` is map<scenario, map<feature, double>>; traces without it are passed over,
    ties of ``order`` go to the smaller text of the map, absent entries are 0.
    """
    at = F.when(F.col(motifs).isNotNull(), F.struct(order, F.to_json(motifs)))
    first = traces.groupBy(key).agg(F.min_by(motifs, at).alias("_m"))
    return first.select(key, F.array(*[F.coalesce(F.col("_m")[s][x], F.lit(0.0)) for s, features in SCENARIOS.items() for x in features]).alias("profile"))


def contrasts(motifs: Column) -> dict[str, Column]:
    """delta, rel and gate of every contrasted feature and pair of scenarios; null where one side is absent.

    delta = a - b; rel = delta / (|a| + |b| + 1e-6); gate = delta (1 + mean volatility of both).
    """
    out = {}
    for suffix, (one, two) in PAIRS.items():
        volatility = (F.coalesce(motifs[one]["adjustment_volatility"], F.lit(0.0)) + F.coalesce(motifs[two]["adjustment_volatility"], F.lit(0.0))) / 2
        for name, feature in CONTRASTED.items():
            a, b = motifs[one][feature], motifs[two][feature]
            out[f"delta_{name}_{suffix}"] = a - b
            out[f"rel_{name}_{suffix}"] = (a - b) / (F.abs(a) + F.abs(b) + 1e-6)
            out[f"gate_{name}_{suffix}"] = (a - b) * (1 + volatility)
    return out


def contrastive_names() -> list[str]:
    """The kept contrasts in order of name: 18 of 36."""
    every = [f"{kind}_{name}_{suffix}" for kind in ("delta", "rel", "gate") for name in CONTRASTED for suffix in PAIRS]
    return sorted(x for x in every if x.startswith(KEPT_PREFIXES))


def contrastive_profile(traces: DataFrame, key: str, motifs: str = "motifs") -> DataFrame:
    """(key, profile, contrasted): mean of each kept contrast over an entity's traces, 0 where it has none.

    A contrast counts in millionths, rounded, so that the sum does not depend on the order of the traces.
    """
    c = contrasts(F.col(motifs))
    mean = lambda x: F.sum(F.round(x * MICRO).cast("long")) / (F.count(x) * MICRO)
    g = traces.groupBy(key).agg(*[F.coalesce(mean(c[x]), F.lit(0.0)).alias(x) for x in contrastive_names()])
    p = g.select(key, F.array(*contrastive_names()).alias("profile"))
    return p.withColumn("contrasted", F.exists("profile", lambda x: x != 0))


def top_entries(df: DataFrame, key: str, name: str, value: str, k: int = 5) -> DataFrame:
    """(key, top): the ``k`` entries of largest absolute value (six places) as an array of (name, value), ties by name.

    Entries are summed per key and name first, so a group has one row per name.
    """
    g = df.groupBy(key, name).agg(F.sum(F.col(value).cast("double")).alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.round(F.abs("_v"), 6)).alias("o"), F.col(name).alias("name"), F.col("_v").alias("value"))))
    return g.groupBy(key).agg(F.transform(F.slice(ordered, 1, k), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))).alias("top"))


def _cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def _dominated(top: Column, longest: int | None, each: int | None, sep: str) -> Column:
    total = F.aggregate(top, F.lit(0.0), lambda s, e: s + e["value"])
    first = F.get(top, F.lit(0))
    one = F.coalesce(F.try_divide(first["value"], total) > 0.5, F.lit(False)) & (total > 0)
    name = _cut(first["name"], longest) if longest else first["name"]
    names = F.transform(F.slice(top, 1, 3), lambda e: _cut(e["name"], each) if each else e["name"])
    return F.when((F.size(top) == 1) | one, F.concat(F.lit("Dominated by: "), name)).otherwise(F.concat(F.lit("Mixed: "), F.array_join(names, sep)))


def _first_of_groups(top: Column, groups: int) -> Column:
    """Of entries named group:item, the first of each of the first ``groups`` groups."""
    named = F.filter(top, lambda e: F.contains(e["name"], F.lit(":")))
    group = lambda e: F.split_part(e["name"], F.lit(":"), F.lit(1))
    seen = F.array_distinct(F.transform(named, group))
    return F.transform(F.slice(seen, 1, groups), lambda g: F.get(F.filter(named, lambda e: group(e) == g), F.lit(0)))


def _item(e: Column) -> Column:
    return F.regexp_replace(e["name"], "^[^:]*:", "")


def _contrast(e: Column) -> Column:
    where, kind = F.lit("unknown"), F.lit("behavior")
    for suffix, words in reversed(VERSUS.items()):
        where = F.when(F.contains(e["name"], F.lit("_" + suffix)), words).otherwise(where)
    for word in ("contact", "adjustment", "response"):
        kind = F.when(F.contains(e["name"], F.lit(word)), word).otherwise(kind)
    return F.concat(kind, F.when(e["value"] > 0, " higher (").otherwise(" lower ("), where, F.lit(")"))


def _two_places(x: Column) -> Column:
    """Rounded by the exact binary value, as other engines do; format_string rounds the shortest decimal."""
    return F.call_function("format_number", x, F.lit("0.00"))


def _percent(e: Column) -> Column:
    return F.concat(F.round(e["value"] * 100).cast("long").cast("string"), F.lit("%"))


STYLES = ("archetypes", "discovery", "structured", "conditional", "contrastive", "primary")


def describe_cluster(top: Column, style: str) -> Column:
    """A cluster's description from its ``top`` array of (name, value), largest first.

    archetypes and discovery: one name above half, else up to three; structured and
    conditional read names as group:item; contrastive tells directions; primary gives
    shares. Null and empty arrays give "Mixed behavioral patterns".
    """
    if style == "archetypes":
        text = _dominated(top, 50, 30, " + ")
    elif style == "discovery":
        text = _dominated(top, None, None, " | ")
    elif style == "structured":
        text = F.array_join(F.transform(_first_of_groups(top, 3), _item), " + ")
    elif style == "conditional":
        part = lambda e: F.concat(F.substring_index(F.split_part(e["name"], F.lit(":"), F.lit(1)), "_", 1), F.lit(":"), F.substring_index(_item(e), "_", 1), F.lit("="), _two_places(e["value"]))
        text = F.array_join(F.transform(_first_of_groups(top, 2), part), " + ")
    elif style == "contrastive":
        text = F.array_join(F.transform(F.slice(top, 1, 3), _contrast), " + ")
    elif style == "primary":
        a, b = F.get(top, F.lit(0)), F.get(top, F.lit(1))
        alone = F.concat(a["name"], F.lit(" ("), _percent(a), F.lit(")"))
        both = F.concat(F.lit("Primarily "), a["name"], F.lit(" ("), _percent(a), F.lit("), with "), b["name"], F.lit(" tendencies"))
        text = F.when(F.size(top) == 1, alone).otherwise(both)
    else:
        raise ValueError(f"unknown style: {style}")
    empty = F.coalesce(F.size(top), F.lit(0)) <= 0
    return F.when(empty, "Mixed behavioral patterns").otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("Mixed patterns")))
