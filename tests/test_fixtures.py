"""Hand fixtures and properties of the panel, network and text operators."""

import pytest
from pyspark.sql import functions as F

from popgraph.operators import clusters, entities, evaluation, network, panel, risk, text
from popgraph.plans.components import connected_components

TEXTS = [("3 infected contacts, day 4, I am worried", 3, 0, 4, 0.6), ("5 out of 10 people; household members are fine", 5, 2, 3, 0.4), ("", 5, 0, 3, 0.5)]


def test_text(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TEXTS)], "i int, t string").orderBy("i")
    t = F.col("t")
    got = df.select(text.contact_count(t), text.household_infections(t), text.days_mention(t), F.round(text.risk_perception(t), 6)).collect()
    assert [tuple(r) for r in got] == [x[1:] for x in TEXTS]


def test_leakage(spark):
    df = spark.createDataFrame([("Wash hands. On 2020-03-15 it rose. There were 1000 cases! Stay home currently.",)], "t string")
    assert df.select(text.remove_leakage(F.col("t"))).first()[0] == "Wash hands. Stay home ."


def test_graph(spark):
    agents = spark.createDataFrame([(i,) for i in range(5)], "agent_id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "agent_1 long, agent_2 long").withColumn("edge_type", F.lit("work")).withColumn("contact_rate", F.lit(1.0))
    s = network.graph_stats(agents, edges).first()
    assert (s.nodes, s.edges, s.density, s.transitivity, s.avg_clustering) == (5, 4, 0.4, 0.6, 0.466667)
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "agent_id long, cluster_id long")
    assert clusters.modularity(edges, labels).first()[0] == -0.03125
    c = {r.cluster_id: r.conductance for r in clusters.conductance(edges, labels).collect()}
    assert c == {0: 0.142857, 1: 1.0}
    assert network.connected_components(agents, edges).select("component").distinct().count() == 2


def test_panel(spark):
    p = spark.createDataFrame([(0, i, s) for i, s in enumerate("SSEEIIIR")], "agent_id long, day int, state string")
    assert [r.days_in_state for r in panel.days_in_state(p).orderBy("day").collect()] == [0, 1, 0, 1, 0, 1, 2, 0]
    assert [tuple(r)[1:] for r in panel.transitions(p).orderBy("day").collect()] == [(2, "S", "E"), (4, "E", "I"), (7, "I", "R")]
    assert [r.attack_rate for r in panel.attack_rate(p).orderBy("day").collect()] == [0, 0, 1, 1, 1, 1, 1, 1]


def test_phase(spark):
    active = [5, 8, 9, 20, 60, 110, 115, 300, 310]
    h = spark.createDataFrame([(i, 1000 - a, 0, a, 0, 0) for i, a in enumerate(active)], "day int, S long, E long, I long, R long, D long")
    assert [r.phase for r in panel.epidemic_phase(h).orderBy("day").collect()] == ["PRE_EPIDEMIC"] * 3 + ["EXPONENTIAL_GROWTH"] * 4 + ["PEAK"] * 2


def test_fuse_and_accumulate(spark):
    one = spark.createDataFrame([(0.10, 0.04, 0.8, 0.5)], "s double, n double, cs double, cn double")
    p, c = risk.fuse(F.col("s"), F.col("n"), F.col("cs"), F.col("cn"), F.lit(1.0))
    assert tuple(one.select(F.round(p, 6), F.round(c, 6)).first()) == (0.076923, 0.615385)
    items = spark.createDataFrame([(1, i, v) for i, v in enumerate([80.0, 60.0, 20.0, 100.0, 60.0])], "k long, o int, v double")
    assert [tuple(r)[1:] for r in panel.reset_accumulator(items, "k", ["o"], "v", 150).orderBy("n").collect()] == [(3, 160.0), (5, 160.0)]


def test_evaluation(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.6, 0)], "p double, y int")
    assert tuple(evaluation.brier_nll(df, "p", "y").first()) == (0.136667, 0.414932)
    for b, want in (((1, 1, 0, 0), 1.0), ((0, 1, 0, 1), -0.5)):
        rows = spark.createDataFrame(list(zip((0, 0, 1, 1), b, strict=True)), "a int, b int")
        assert clusters.ari(rows, "a", "b").first()[0] == want


def test_age_groups(spark):
    df = spark.createDataFrame([(66,), (18,), (0,)], "a int")
    assert [r[0] for r in df.select(entities.age_group(F.col("a"))).collect()] == ["60-69", "0-17", None]
    assert [r[0] for r in df.select(entities.age_group(F.col("a"), corrected=True)).collect()] == ["60-69", "18-29", "0-17"]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 0 for i in range(60)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_draws_do_not_depend_on_partitions(spark, n):
    df = spark.range(200).withColumnRenamed("id", "agent_id").withColumn("age", F.col("agent_id") % 90)
    job = entities.infer_occupation(F.col("age"), F.col("agent_id"))
    same = lambda d: sorted(map(tuple, d.select("agent_id", job).collect()))
    assert same(df) == same(df.repartition(n))


def test_large_households_keep_their_edges(spark):
    from popgraph.operators import network

    homes = [(i, 1) for i in range(51)] + [(i, 2) for i in range(100, 230)] + [(i, 3) for i in range(300, 303)] + [(400, 4), (500, None), (501, None)]
    got = [(r.agent_1, r.agent_2) for r in network.household_edges(spark.createDataFrame(homes, "agent_id long, household_id long")).collect()]
    want = [(a, b) for a, h in homes for b, k in homes if h is not None and h == k and a < b]
    assert sorted(got) == sorted(want)


def test_first_cases_in_one_task_and_in_ranges(spark, monkeypatch):
    cases = spark.createDataFrame([(k, f"2020-01-{1 + k % 9:02d}") for k in range(60)], "`case` long, date string")
    few = [tuple(r) for r in entities.select_chronological(cases, 25).orderBy("agent_id").collect()]
    assert [i for *_, i in few] == list(range(25)) and few == [(*r, i) for i, r in enumerate(sorted((tuple(c) for c in cases.collect()), key=lambda c: c[::-1])[:25])]
    monkeypatch.setattr(entities, "ONE_TASK", 5)
    assert [tuple(r) for r in entities.select_chronological(cases, 25).orderBy("agent_id").select("case", "date", "agent_id").collect()] == few
