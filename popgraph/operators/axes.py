"""Behavioural axes of texts: keyword rules, multi-hot profiles, names and perception lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgraph.operators.retrieval import top_per_group

#: Per axis the rules in order, each a label and its words, and the label without any.
AXES = {
    "exposure_reasoning": (
        [
            ("contact_counting", ["contact_count", "infected_contact", "exposure_count", "contact_track", "high_contact", "infected_neighbors"]),
            ("household_transmission", ["household", "family", "home", "domestic", "children", "spouse"]),
            ("workplace_network", ["workplace", "work", "occupation", "job", "office", "healthcare_worker", "teacher", "retail_worker", "service_worker", "professional", "employee"]),
            ("community_prevalence", ["community", "public", "social", "neighborhood", "local", "area"]),
            ("contact_counting", ["exposure", "contact", "transmission", "spread"]),
        ],
        "minimal_exposure_reasoning",
    ),
    "information_seeking": (
        [
            ("heavy_tool_user", ["tracker", "heavy", "vigilant", "monitor", "constant", "frequent", "intensive", "thorough"]),
            ("moderate_tool_user", ["check", "assess", "review", "examine", "periodic", "regular"]),
            ("light_tool_user", ["explorer", "curious", "browse", "scan", "occasional", "casual"]),
            ("moderate_tool_user", ["tool", "info", "data", "knowledge", "query"]),
        ],
        "tool_avoider",
    ),
    "protection_priority": (
        [
            ("household_focused", ["household", "family", "home", "children", "child", "parent", "spouse", "domestic"]),
            ("occupation_focused", ["healthcare", "teacher", "worker", "employee", "professional", "occupation", "job", "work", "career", "service", "retail", "office"]),
            ("community_focused", ["community", "public", "social", "neighbor", "society", "collective"]),
        ],
        "self_focused",
    ),
    "temporal_style": (
        [
            ("calendar_planner", ["calendar", "planner", "schedule", "plan", "future", "upcoming"]),
            ("symptom_monitor", ["symptom", "health", "status", "condition", "feeling", "signs"]),
            ("duration_tracker", ["duration", "timeline", "days", "time", "track", "count"]),
        ],
        "present_focused",
    ),
    "vaccine_reasoning": (
        [
            ("vaccine_reliant", ["full_vaccine", "fully_vaccinated", "complete_vaccine", "boosted"]),
            ("vaccine_aware", ["partial_vaccine", "one_dose", "vaccinated", "first_dose", "second_dose"]),
            ("vaccine_skeptical", ["unvaccinated", "no_vaccine", "not_vaccinated", "anti_vax"]),
            ("vaccine_aware", ["vaccine", "vaccination", "immuniz"]),
        ],
        "vaccine_irrelevant",
    ),
}
#: Words of the risk posture, which compares how many of them occur.
AVERSE = ["anxious", "cautious", "worried", "afraid", "terrified", "concerned", "vigilant", "careful", "nervous", "fearful", "scared", "panic"]
MINIMIZING = ["optimistic", "confident", "minimiz", "downplay", "unconcerned", "relaxed", "unworried", "dismiss"]
IGNORING = ["ignor", "careless", "reckless", "uncaring", "negligent"]
WATCHING = ["monitor", "check", "aware", "track"]
#: The 25 options of a structured profile, axis by axis.
OPTIONS = {
    "exposure_reasoning": ["contact_counting", "household_transmission", "workplace_network", "community_prevalence", "minimal_exposure_reasoning"],
    "risk_posture": ["risk_averse", "risk_neutral", "risk_minimizing", "risk_ignoring"],
    "information_seeking": ["heavy_tool_user", "moderate_tool_user", "light_tool_user", "tool_avoider"],
    "protection_priority": ["self_focused", "household_focused", "community_focused", "occupation_focused"],
    "temporal_style": ["duration_tracker", "symptom_monitor", "calendar_planner", "present_focused"],
    "vaccine_reasoning": ["vaccine_reliant", "vaccine_aware", "vaccine_skeptical", "vaccine_irrelevant"],
}
#: Words that name no archetype.
PLAIN_WORDS = ["young", "old", "middle", "aged", "teen", "senior", "student", "worker", "healthcare", "office", "retail", "service", "manual", "teacher", "professional", "high", "low", "partial", "full"]


def axis_labels(text: str) -> tuple[str, ...]:
    """Labels of a lower-cased text, in the order of ``AXES`` and the risk posture last."""
    has = lambda words: any(w in text for w in words)
    count = lambda words: sum(w in text for w in words)
    out = [next((label for label, words in rules if has(words)), default) for rules, default in AXES.values()]
    averse, less = count(AVERSE), count(MINIMIZING)
    if has(IGNORING):
        posture = "risk_ignoring"
    elif averse != less:
        posture = "risk_averse" if averse > less else "risk_minimizing"
    else:
        posture = "risk_averse" if has(WATCHING) else "risk_neutral"
    return (*out, posture)


def keyword_axes(lowered: Column) -> dict[str, Column]:
    """One label per axis of a lower-cased text column; null counts as empty.

    The some 150 words are looked for in Arrow batches: Python's search takes a fraction of
    the time of as many ``contains``. All labels come from one call a row.
    """
    names = (*AXES, "risk_posture")

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def told(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([axis_labels(t or "") for t in text], columns=list(names))

    labels = told(F.coalesce(lowered, F.lit("")))
    return {n: labels[n] for n in names}


def structured_profile(df: DataFrame, key: str) -> DataFrame:
    """(key, profile): which of the 25 options the rows of an entity show, from columns named as the axes."""
    seen = [F.max(F.when(F.col(axis) == o, 1.0).otherwise(0.0)) for axis, options in OPTIONS.items() for o in options]
    return df.groupBy(key).agg(F.array(*seen).alias("profile"))


def archetype_names(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name) from the two most frequent words that tell something, ties by word; a key without any gets the mixed name."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0))
    w = df.select(key, F.explode(words).alias("word")).where(~F.col("word").isin(PLAIN_WORDS))
    c = w.groupBy(key, "word").agg(F.count(F.lit(1)).alias("_c"))
    top = top_per_group(c, [key], [F.desc("_c"), "word"], 2)
    named = top.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("word"))).alias("_a"), F.max(F.when(F.col("rank") == 2, F.col("word"))).alias("_b"))
    every = df.select(F.col(key).alias("_key")).distinct()
    j = every.join(named, F.col("_key").eqNullSafe(F.col(key)), "left")
    name = F.when(F.col("_b").isNotNull(), F.concat("_a", F.lit("_"), "_b", F.lit("_archetype"))).when(F.col("_a").isNotNull(), F.concat("_a", F.lit("_pattern"))).otherwise("mixed_behavioral_pattern")
    return j.select(F.col("_key").alias(key), name.alias("name"))


def pattern_name(text: Column) -> Column:
    """``pattern_<state>_<transition>`` from the markers in a text, S and unknown without them."""
    found = lambda p, d: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")), F.lit(d))
    return F.concat(F.lit("pattern_"), found(r"State:\s*([^;]*[^;\s])", "S"), F.lit("_"), found(r"Transition:\s*(\S+)", "unknown"))


def perception_text(agents: DataFrame, panel: DataFrame, nb: DataFrame, recent: int = 10) -> DataFrame:
    """(agent_id, day, text): own state and which contacts are infected or dead for at most ``recent`` days, in order of id."""
    rows = panel.select("agent_id", "day", "state", "days_in_state")
    told = rows.where((F.col("state") == "I") | ((F.col("state") == "D") & (F.col("days_in_state") <= recent)))
    other = told.select(F.col("agent_id").alias("other_id"), "day", F.col("state").alias("_s"))
    name = F.concat(F.lit("#"), F.col("other_id").cast("string"))
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("_s") == s, F.struct("other_id", name.alias("n"))))), lambda x: x["n"])
    near = nb.select("agent_id", "other_id").join(other, "other_id").groupBy("agent_id", "day").agg(listed("I").alias("_sick"), listed("D").alias("_dead"))
    own = agents.select("agent_id").join(rows, "agent_id").join(near, ["agent_id", "day"], "left")
    days = F.col("days_in_state").cast("string")
    self_line = F.when(F.col("state") == "I", F.concat(F.lit("infected for "), days, F.lit(" days"))).when(F.col("state") == "R", F.concat(F.lit("recovered "), days, F.lit(" days ago"))).otherwise("healthy")
    line = lambda c, said: F.when(F.size(c) > 0, F.concat(F.lit(said), F.array_join(c, ", ")))
    return own.select("agent_id", "day", F.concat_ws("; ", self_line, line("_sick", "infected contacts: "), line("_dead", "mourned contacts: ")).alias("text"))
