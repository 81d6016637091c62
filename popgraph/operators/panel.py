"""Entity-by-day panels: states, transitions, incidence, phases and rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.functions.rounding import round6

STATES = ("S", "E", "I", "R", "D")
#: The five transitions of a forecast.
TRANSITIONS = (("S", "E"), ("E", "I"), ("I", "R"), ("I", "D"), ("R", "S"))
#: A labelling of event types, for exercise only.
EVENT_STATES = {"view": "S", "click": "E", "error": "I", "purchase": "R", "signup": "D"}


def by_agent():
    """Days of one entity in order."""
    return W.partitionBy("agent_id").orderBy("day")


def daily_states(events: DataFrame, origin: str = "2024-01-01") -> DataFrame:
    """(agent_id, day, state) for every day between the first and last, days without events filled forward."""
    day = F.datediff(F.to_date("ts"), F.lit(origin).cast("date"))
    state = F.create_map(*[F.lit(x) for kv in EVENT_STATES.items() for x in kv])[F.max_by("event_type", F.struct("ts", "event_id"))]
    seen = events.groupBy(F.col("user_id").alias("agent_id"), day.alias("day")).agg(state.alias("_seen"))
    span = seen.agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    grid = seen.select("agent_id").distinct().crossJoin(F.broadcast(span)).select("agent_id", F.explode(F.sequence("_a", "_b")).alias("day"))
    filled = F.coalesce(F.last("_seen", True).over(by_agent().rowsBetween(W.unboundedPreceding, 0)), F.lit("S"))
    return grid.join(seen, ["agent_id", "day"], "left").select("agent_id", "day", filled.alias("state"))


def days_in_state(panel: DataFrame) -> DataFrame:
    """``days_in_state``: days since the state last changed, 0 on the day of the change."""
    new = F.when(F.col("state").eqNullSafe(F.lag("state").over(by_agent())), 0).otherwise(1)
    islands = panel.withColumn("_c", new).withColumn("_g", F.sum("_c").over(by_agent()))
    run = F.row_number().over(W.partitionBy("agent_id", "_g").orderBy("day")) - 1
    return islands.withColumn("days_in_state", run).drop("_c", "_g")


def transitions(panel: DataFrame) -> DataFrame:
    """(agent_id, day, from_state, to_state) of every change."""
    p = panel.withColumn("from_state", F.lag("state").over(by_agent()))
    return p.where("from_state is not null and from_state <> state").select("agent_id", "day", "from_state", F.col("state").alias("to_state"))


def state_sequences(panel: DataFrame) -> DataFrame:
    """(agent_id, sequence): states in order of days, arrow-joined without repeats."""
    e = transitions(panel).select("agent_id", "day", F.col("to_state").alias("state"))
    first = panel.groupBy("agent_id").agg(F.min("day").alias("day"), F.min_by("state", "day").alias("state"))
    ordered = F.array_sort(F.collect_list(F.struct("day", "state")))
    return first.unionByName(e).groupBy("agent_id").agg(F.array_join(F.transform(ordered, lambda x: x["state"]), "->").alias("sequence"))


def state_counts(panel: DataFrame, keys: list[str]) -> DataFrame:
    """S, E, I, R and D per key; states that do not occur are zero."""
    return panel.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def state_distribution(panel: DataFrame) -> DataFrame:
    c = panel.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    rows = c.unpivot(["_n"], list(STATES), "state", "count")
    return rows.select("state", "count", F.round(100 * F.col("count") / F.col("_n"), 6).alias("percent"))


def incidence(panel: DataFrame, keys: list[str]) -> DataFrame:
    """New E and new I per key."""
    before = F.lag("state").over(by_agent())
    p = panel.withColumn("_b", before)
    new = lambda s: F.count_if((F.col("state") == s) & (F.col("_b").isNotNull()) & (F.col("_b") != s))
    return p.groupBy(*keys).agg(new("E").alias("new_exposed"), new("I").alias("new_infected"))


def attack_rate(panel: DataFrame) -> DataFrame:
    """(day, attack_rate): share of entities that have left S by that day."""
    first = panel.groupBy("agent_id").agg(F.min(F.when(F.col("state") != "S", F.col("day"))).alias("day"))
    hit = first.where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("_h"))
    days, n = panel.select("day").distinct(), first.agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum(F.coalesce("_h", F.lit(0))).over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))  # one row a day
    return days.join(hit, "day", "left").withColumn("_u", upto).crossJoin(F.broadcast(n)).select("day", F.round(F.col("_u") / F.col("_n"), 6).alias("attack_rate"))


def cumulative(daily: DataFrame, value: str, order: str = "day") -> DataFrame:
    return daily.withColumn(f"cumulative_{value}", F.sum(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


#: Shares of active people that part the phases, and the rises and the fall over two days that tell within them.
PHASE_SHARES = (0.01, 0.05, 0.20, 0.40)
RISES, FALL = (1.5, 1.2, 1.1), 0.8


def derived_deaths(daily: DataFrame, value: str, order: str = "day", rate: float = 0.001) -> DataFrame:
    """``daily`` with ``cumulative_<value>`` and ``deaths``: ``rate`` of the cumulated cases, cut to integers."""
    c = cumulative(daily, value, order)
    return c.withColumn("deaths", F.floor(F.col(f"cumulative_{value}") * F.lit(rate)).cast("long"))


def phase_rule(active: Column, before: Column, population: Column) -> Column:
    """Phase of a day with two days before it in its history."""
    p = active / population
    rising = lambda f: active > before * f
    low, some, many, most = PHASE_SHARES
    return (
        F.when(p < low, "PRE_EPIDEMIC")
        .when(p < some, F.when(rising(RISES[0]), "EXPONENTIAL_GROWTH").otherwise("PRE_EPIDEMIC"))
        .when(p < many, F.when(rising(RISES[1]), "EXPONENTIAL_GROWTH").when(active < before * FALL, "DECLINE").otherwise("PEAK"))
        .when(p < most, F.when(rising(RISES[2]), "PEAK").otherwise("DECLINE"))
        .otherwise("DECLINE")
    )


def phase_of(share: float, active: int, before: int | None) -> str:
    """``phase_rule`` of one day, for streams; without a day two before it PRE_EPIDEMIC."""
    low, some, many, most = PHASE_SHARES
    if before is None or share < low:
        return "PRE_EPIDEMIC"
    if share < some:
        return "EXPONENTIAL_GROWTH" if active > before * RISES[0] else "PRE_EPIDEMIC"
    if share < many:
        return "EXPONENTIAL_GROWTH" if active > before * RISES[1] else "DECLINE" if active < before * FALL else "PEAK"
    return "PEAK" if share < most and active > before * RISES[2] else "DECLINE"


def epidemic_phase(history: DataFrame) -> DataFrame:
    """(day, active, phase, growth) from daily S, E, I, R, D; the first two days are PRE_EPIDEMIC."""
    order = W.orderBy("day")  # a table of days
    h = history.withColumn("active", F.col("E") + F.col("I")).withColumn("_p", F.col("S") + F.col("E") + F.col("I") + F.col("R") + F.col("D")).withColumn("_b", F.lag("active", 2).over(order))
    phase = F.when(F.col("_b").isNull(), "PRE_EPIDEMIC").otherwise(phase_rule(F.col("active"), F.col("_b"), F.col("_p")))
    growth = F.when(F.col("_b").isNotNull(), F.round((F.col("active") - F.col("_b")) / F.greatest("_b", F.lit(1)), 6))
    return h.select("day", "active", phase.alias("phase"), growth.alias("growth"))


#: Multipliers of S->E, E->I and I->R by phase.
PHASE_MULTIPLIERS = {
    "PRE_EPIDEMIC": (1.0, 1.0, 1.0),
    "EXPONENTIAL_GROWTH": (3.0, 1.2, 0.9),
    "PEAK": (2.5, 1.1, 1.0),
    "DECLINE": (1.5, 1.0, 1.2),
    "ENDEMIC": (0.8, 1.0, 1.1),
}


def phase_multipliers(phases: DataFrame) -> DataFrame:
    rows = [(p, t, m) for p, ms in PHASE_MULTIPLIERS.items() for t, m in zip(("S->E", "E->I", "I->R"), ms, strict=True)]
    table = phases.sparkSession.createDataFrame(rows, "phase string, transition string, multiplier double")
    return phases.join(F.broadcast(table), "phase").select("day", "phase", "transition", "multiplier")


def transition_rates(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Share of entities in a state that take each transition to the next day, per key."""
    p = panel.withColumn("_next", F.lead("state").over(by_agent())).where("_next is not null")
    rate = lambda a, b: F.coalesce(round6(F.count_if((F.col("state") == a) & (F.col("_next") == b)) / F.nullif(F.count_if(F.col("state") == a), F.lit(0))), F.lit(0.0))
    return p.groupBy(*keys).agg(*[rate(a, b).alias(f"{a}_{b}".lower()) for a, b in TRANSITIONS])


def trend(counts: DataFrame, keys: list[str], lag: int = 3) -> DataFrame:
    """Change of E + I over ``lag`` days over the size of the group, clipped to half and moved to [0, 1]; 0.5 where no such day is."""
    active = F.col("E") + F.col("I")
    before = F.lag(active, lag).over(W.partitionBy(*keys).orderBy("day"))
    t = (active - before) / (F.col("S") + F.col("E") + F.col("I") + F.col("R") + F.col("D"))
    clipped = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), t)) + 0.5
    return counts.select(*keys, "day", F.round(F.when(before.isNull(), 0.5).otherwise(clipped), 6).alias("trend"))


def lookback(counts: DataFrame, keys: list[str], days: int = 7) -> DataFrame:
    """The last ``days`` + 1 shares of I per key and day, zero-padded on the left."""
    share = F.round(F.col("I") / (F.col("S") + F.col("E") + F.col("I") + F.col("R") + F.col("D")), 6)
    seq = F.collect_list(share).over(W.partitionBy(*keys).orderBy("day").rowsBetween(-days, 0))
    return counts.select(*keys, "day", seq.alias("_s")).select(*keys, "day", F.concat(F.array_repeat(F.lit(0.0), days + 1 - F.size("_s")), "_s").alias("sequence"))


def recent_states(panel: DataFrame, n: int = 7) -> DataFrame:
    """The last ``n`` states per entity and day, padded in front with the first."""
    s = F.collect_list("state").over(by_agent().rowsBetween(1 - n, 0))
    p = panel.select("agent_id", "day", s.alias("_s"))
    return p.select("agent_id", "day", F.array_join(F.concat(F.array_repeat(F.element_at("_s", 1), n - F.size("_s")), "_s"), "->").alias("recent"))


def state_history_matrix(panel: DataFrame, neighbor_states: DataFrame, n: int = 7) -> DataFrame:
    """(agent_id, day, history): ``n`` rows of seven entries, the state of each of the last days and, for the day itself, days in state and infected contacts.

    ``panel`` has days_in_state; ``neighbor_states`` has agent_id, day and infected. Days
    before the first repeat its state.
    """
    near = neighbor_states.select("agent_id", "day", F.col("infected").alias("_i"))
    s = F.collect_list("state").over(by_agent().rowsBetween(1 - n, 0))
    p = panel.select("agent_id", "day", "days_in_state", s.alias("_s")).join(near, ["agent_id", "day"], "left")
    states = F.concat(F.array_repeat(F.element_at("_s", 1), n - F.size("_s")), "_s")
    now = F.array(F.round(F.least(F.col("days_in_state") / 20.0, F.lit(1.0)), 6), F.round(F.least(F.coalesce("_i", F.lit(0)) / 5.0, F.lit(1.0)), 6))
    rest = lambda i: F.when(i == n - 1, now).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    hot = lambda x: F.array(*[F.when(x == c, 1.0).otherwise(0.0) for c in STATES])
    return p.select("agent_id", "day", F.transform(states, lambda x, i: F.concat(hot(x), rest(i))).alias("history"))


def head_and_last(df: DataFrame, key: str, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows and the last row per key, with ``is_last``."""
    of = W.partitionBy(key)
    r = df.withColumn("_r", F.row_number().over(of.orderBy(*order))).withColumn("_l", F.row_number().over(of.orderBy(*[F.desc(c) for c in order])))
    return r.where((F.col("_r") <= n) | (F.col("_l") == 1)).withColumn("is_last", F.col("_l") == 1).drop("_r", "_l")


def count_out_of_order(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value is less than that of the row before it in order of the key.

    Neighbours are compared within ranges of the key; the last row of each range meets
    the first of the next in a table with one row per range.
    """
    ranged = df.select(F.col(key).alias("_k"), F.col(value).alias("_v")).repartitionByRange("_k").withColumn("_p", F.spark_partition_id())
    by = W.partitionBy("_p").orderBy("_k", "_v")
    inside = ranged.withColumn("_b", F.lag("_v").over(by)).groupBy("_p").agg(
        F.count_if(F.col("_v") < F.col("_b")).alias("n"), F.min(F.struct("_k", "_v")).alias("_f"), F.max(F.struct("_k", "_v")).alias("_l")
    )
    seam = inside.withColumn("_before", F.lag("_l").over(W.orderBy("_p")))
    return seam.agg(F.sum(F.col("n") + F.when(F.col("_f._v") < F.col("_before._v"), 1).otherwise(0)).alias("out_of_order"))


def systematic_sample(df: DataFrame, key: str, order: list[str], k: int, even: bool = False) -> DataFrame:
    """At most ``k`` rows per key, evenly spaced in order: every n-th row, or with ``even`` the rows at the whole parts of i * n / k."""
    of = W.partitionBy(key)
    r = df.withColumn("_r", F.row_number().over(of.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(of))
    step = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    kept = (F.col("_r") % step == 0) & (F.col("_r") / step < k)
    if even:
        places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") / k)).cast("int"))
        kept = (F.col("_n") <= k) | F.array_contains(places, F.col("_r"))
    return r.where(kept).drop("_r", "_n")


def rolling_windows(series: DataFrame, value: str, back: int = 28, ahead: int = 7) -> DataFrame:
    """(origin, lookback, horizon) of every day with a full horizon and at least one day behind it."""
    order = W.orderBy("day")  # a table of days
    s = series.select(F.col("day").alias("origin"), F.collect_list(value).over(order.rowsBetween(1 - back, 0)).alias("lookback"), F.collect_list(value).over(order.rowsBetween(1, ahead)).alias("horizon"))
    return s.where(F.size("horizon") == ahead)


def reset_accumulator(items: DataFrame, key: str, order: list[str], value: str, threshold: float, min_items: int = 1) -> DataFrame:
    """(key, n, total): places where the running sum reaches ``threshold`` and starts again.

    Where a sum starts depends on all before it, so a key is one task's work; its rows
    stream past in order and are never held together.
    """
    rows = items.select(F.col(key), *order, F.col(value).cast("double").alias("_v")).repartition(key).sortWithinPartitions(key, *order).select(key, "_v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, count, place = None, 0.0, 0, 0
        for b in batches:
            out = []
            for k, v in zip(b[key].tolist(), b["_v"].tolist(), strict=True):
                if k != now:
                    now, total, count, place = k, 0.0, 0, 0
                total, count, place = total + v, count + 1, place + 1
                if total >= threshold and count >= min_items:
                    out.append((k, place, total))
                    total, count = 0.0, 0
            yield pd.DataFrame(out, columns=[key, "n", "total"])

    kind = items.schema[key].dataType.simpleString()
    return rows.where(F.col(key).isNotNull() & F.col("_v").isNotNull()).mapInPandas(run, f"`{key}` {kind}, n int, total double").withColumn("total", F.round("total", 6))


def reflection_inputs(items: DataFrame, key: str, order: list[str], id_col: str, value: str, observed: Column, threshold: float, top: int = 10, least: int = 3) -> DataFrame:
    """(key, n, rank, id, value): at every firing of the summed importance, the ``top`` observations so far.

    The sum of ``value`` over all items fires where it reaches ``threshold`` while there
    are ``least`` observations (rows for which ``observed`` holds), and starts again; with
    fewer it goes on. ``n`` is the place of the item that fires. Of equal values the
    earlier comes first. A key is one task's work, as for ``reset_accumulator``; no more
    than ``top`` rows of it are held. Null keys and values are left out.
    """
    v = F.col(value).cast("double")
    rows = items.select(F.col(key), *order, F.col(id_col).alias("_id"), v.alias("_v"), F.coalesce(observed, F.lit(False)).alias("_o")).where(F.col(key).isNotNull() & F.col("_v").isNotNull())
    rows = rows.repartition(key).sortWithinPartitions(key, *order).select(key, "_id", "_v", "_o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, place, seen, best = None, 0.0, 0, 0, []
        for b in batches:
            out = []
            for k, i, x, o in zip(b[key].tolist(), b["_id"].tolist(), b["_v"].tolist(), b["_o"].tolist(), strict=True):
                if k != now:
                    now, total, place, seen, best = k, 0.0, 0, 0, []
                total, place = total + x, place + 1
                if o:
                    seen += 1
                    best = sorted([*best, (-x, place, i)])[:top]
                if total >= threshold and seen >= least:
                    out += [(k, place, r, i, -x) for r, (x, _, i) in enumerate(best, 1)]
                    total = 0.0
            yield pd.DataFrame(out, columns=[key, "n", "rank", id_col, value])

    kind = lambda c: items.schema[c].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind(key)}, n int, rank int, `{id_col}` {kind(id_col)}, `{value}` double")
