"""Edge cases of training samples, scenario profiles and cluster descriptions."""

from pyspark.sql import functions as F

from popgraph.operators import archetypes as T
from popgraph.operators import clusters as K
from popgraph.operators import risk as R
from popgraph.operators import samples as S
from popgraph.operators import scenarios as C

AGENT = "agent_id int, age int, vaccination_status int, comorbidity_count int, occupation string, compliance_score double, mobility_score double, gender string, is_imported boolean, quarantined boolean, cluster string, household_id int, cluster_id int"


def people(spark):
    rows = [
        (1, 10, 0, 0, "student", 0.5, 0.5, "m", False, False, "dorm A", 1, 0),
        (2, 70, 2, 5, "teacher", 0.7, None, "f", True, True, None, 1, 0),
        (3, 40, 1, 1, "office_worker", None, 0.2, None, False, False, "", 2, 1),
        (4, 30, 0, 0, "teacher", 0.9, 0.9, "m", False, False, "", 2, None),
        (5, 30, 0, 0, "teacher", 0.9, 0.9, "m", False, False, "", 2, 1),
    ]
    panel = [(a, d, st, k) for a, course in {1: "SEI", 2: "SSE", 3: "IIR", 4: "SSS"}.items() for d, (st, k) in enumerate(zip(course, (0, 1, 2), strict=True))]
    links = [(1, 2), (2, 1), (1, 3), (3, 1), (3, 4), (4, 3), (3, 5), (5, 3)]
    return (
        spark.createDataFrame(rows, AGENT), spark.createDataFrame(panel, "agent_id int, day int, state string, days_in_state int"),
        spark.createDataFrame(links, "agent_id int, other_id int"), spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0])], "agent_id int, embedding array<double>"),
    )


def test_tabular_by_hand(spark):
    got = {(r.cluster_id, r.day): r.features for r in S.cluster_tabular(*people(spark)).collect()}
    assert sorted(got) == [(c, d) for c in (0, 1) for d in range(3)]  # without a cluster or a panel: no part
    f = got[0, 1]
    assert len(f) == 37 and f[:5] == [0.5, 0.5, 0, 0, 0]
    assert f[5:16] == [0.4, 0.6, 0.5, 0.5, 0.5, 0.6, 0.6, 0.5, 0.5, 0.5, 1.0]
    # degrees 2 and 1; both links inside of two possible; one sick contact outside
    assert f[16:23] == [0.03, 0.02, 1.0, 0.5, 3.0, round(2**0.5, 6), 0.5]
    assert f[23:33] == [0.5, round(1 / 30, 6), 0.1, 0, 0, 0.1, 0.5, 0.5, 0.005, 0]
    # two of three links in the household, one of two links of the young to the old, one well contact of the sick
    assert f[33:] == [round(2 / 3, 6), 0.5, 0.1, 0.5]
    alone = got[1, 0]
    assert alone[18] == 0 and alone[20:23] == [0, 0, 0.5] and alone[2] == 1.0


def test_samples_have_every_part(spark):
    rows = {(r.cluster_id, r.day): r for r in S.training_samples(*people(spark)).collect()}
    assert sorted(rows) == [(c, d) for c in (0, 1) for d in (0, 1)]
    r = rows[0, 1]
    assert len(r.temporal) == 8 and all(x == [0.0] * 10 for x in r.temporal[:6])
    assert r.temporal[7] == [0.5, 0.5, 0, 0, 0, 0.5, 0, 0.5, 0.75, 0.3]
    assert r.graph == [2.0, 4.0] and rows[1, 1].graph is None
    assert r.labels == [1.0, 1.0, 0, 0, 0]


def test_samples_of_empty_tables(spark):
    a, p, n, e = people(spark)
    assert S.training_samples(a, p.limit(0), n, e).count() == 0
    assert S.training_samples(a, p, n.limit(0), e.limit(0)).count() == 4


def test_profiles_take_the_first_trace_and_the_mean_contrast(spark):
    m = lambda h, w: {"household_exposure": {"response_speed": h, "adjustment_volatility": 1.0}, "workplace_exposure": {"response_speed": w, "adjustment_volatility": 0.0}}
    rows = [(1, 2, m(9.0, 9.0)), (1, 1, m(3.0, 1.0)), (1, 0, None), (2, 0, None), (3, 0, {"post_recovery": None})]
    df = spark.createDataFrame(rows, "e int, t int, motifs map<string,map<string,double>>")
    got = {r.e: dict(zip(C.profile_names(), r.profile, strict=True)) for r in C.conditional_profile(df, "e", "t").collect()}
    assert got[1]["household_exposure:response_speed"] == 3.0 and sum(got[1].values()) == 5.0
    assert len(got[2]) == 25 and sum(got[2].values()) == sum(got[3].values()) == 0
    names = C.contrastive_names()
    assert len(names) == 18
    out = {r.e: r for r in C.contrastive_profile(df, "e").collect()}
    p = dict(zip(names, out[1].profile, strict=True))
    assert p["delta_response_hw"] == 1.0 and p["gate_response_hw"] == 1.5 and abs(p["rel_response_hw"] - 0.25) < 1e-6 and p["rel_response_hc"] == 0
    assert out[1].contrasted and not out[2].contrasted and not out[3].contrasted


def test_descriptions(spark):
    def told(style, *top):
        df = spark.createDataFrame([(list(top),)], "top array<struct<name:string,value:double>>")
        return df.select(C.describe_cluster(F.col("top"), style)).first()[0]

    long = "x" * 60
    assert told("archetypes", (long, 9.0), ("b", 1.0)) == "Dominated by: " + "x" * 47 + "..."
    assert told("archetypes", (long, 1.0), ("b", 1.0)) == "Mixed: " + "x" * 27 + "... + b"
    assert told("discovery", ("a", 2.0), ("b", 2.0), ("c", 1.0), ("d", 1.0)) == "Mixed: a | b | c"
    assert told("discovery", ("a", 0.0)) == "Dominated by: a"
    assert told("structured", ("p:one", 3.0), ("p:two", 2.0), ("q:three", 1.0), ("plain", 1.0)) == "one + three"
    assert told("structured", ("plain", 1.0)) == "Mixed patterns"
    assert told("conditional", ("household_exposure:response_speed", 2.5), ("post_recovery:immunity_score", -1.0)) == "household:response=2.50 + post:immunity=-1.00"
    assert told("contrastive", ("rel_response_hw", 0.5), ("gate_adjustment_wc", -0.5), ("odd", 0.0)) == "response higher (home vs work) + adjustment lower (work vs community) + behavior lower (unknown)"
    assert told("primary", ("a", 0.7)) == "a (70%)" and told("primary", ("a", 0.6), ("b", 0.4)) == "Primarily a (60%), with b tendencies"
    assert all(told(s) == "Mixed behavioral patterns" for s in C.STYLES)
    null = spark.createDataFrame([(None,)], "top array<struct<name:string,value:double>>")
    assert all(null.select(C.describe_cluster(F.col("top"), s)).first()[0] == "Mixed behavioral patterns" for s in C.STYLES)


def test_death_floor(spark):
    rows = [(6.9, 1.0), (7.0, 1.0), (10.0, 10.0), (14.0, 35.0), (14.1, 35.0)]
    df = spark.createDataFrame(rows, "avg_days_infected double, death double").withColumns({"infected": F.lit(0), "size": F.lit(1), "mean_infected_contacts": F.lit(0.0), "avg_days_exposed": F.lit(0.0)})
    p = R.calibrated({k: F.lit(0.004) for k in ("s_e", "e_i", "i_r", "i_d")}, F.lit(False), F.lit(1.0), F.lit(1.0), F.col("death"))
    assert [round(r[0], 6) for r in df.select(p["i_d"]).collect()] == [0.0, 0.004, 0.018, 0.147, 0.004]


def test_archetypes_join_like_descriptions(spark):
    bird, fish = ["red bird flies", "red bird sings", "red bird eats"], ["blue fish swims", "blue fish dives", "blue fish sleeps"]
    rows = [(i, 0, (bird + fish)[i % 6]) for i in range(60)] + [(60, 0, None), (61, 1, "blue fish dives"), (61, 0, "red bird sings"), (61, 0, "zebra")]
    df = T.first_descriptions(spark.createDataFrame(rows, "e int, t int, text string"), "e", "t", "text")
    entities, catalogue = T.archetypes(df, "e", k=2, terms=64, dims=3)
    got = {r.e: r for r in entities.collect()}
    assert sorted(got) == [*range(60), 61] and all(len(r.profile) == 3 and sum(r.one_hot) == 1 and r.one_hot[r.archetype] == 1 for r in got.values())
    first = got[0].archetype
    assert all((got[i].archetype == first) == (i % 6 < 3) for i in range(60)) and got[61].archetype == first
    told = {r.archetype: r for r in catalogue.collect()}
    assert told[first].entities == 31 and told[first].example == "red bird sings" and told[1 - first].descriptions == 3


def test_archetypes_of_few_and_none(spark):
    one = spark.createDataFrame([(1, "calm"), (2, "calm"), (3, "")], "e int, description string")
    entities, catalogue = T.archetypes(one, "e")
    assert entities.count() == 3 and {r.entities for r in catalogue.collect()} == {1, 2}
    single = T.archetypes(one.where("e < 3"), "e")
    assert {(r.e, r.archetype, tuple(r.one_hot)) for r in single[0].collect()} == {(1, 0, (1.0,)), (2, 0, (1.0,))}
    assert [x.count() for x in T.archetypes(one.limit(0), "e")] == [0, 0]


def test_power_iteration_drops_foreign_links_early(spark, monkeypatch):
    """Links of entities without a vector are gone before links are told apart."""
    plans = []
    monkeypatch.setattr(K, "stage", lambda t, label: plans.append(t._jdf.queryExecution().optimizedPlan().toString()) or t.limit(0))
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id long, v array<double>")
    links = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (2, 99)], "src long, dst long")
    assert K.power_iteration(df, links, "v", "id", 2).count() == 0
    assert len(plans) == 1 and plans[0].count("LeftSemi") == 2 and plans[0].rindex("LeftSemi") > plans[0].index("Aggregate [")


def test_power_iteration_parts_two_groups(spark):
    df = spark.createDataFrame([(i, [float(i // 4) * 9, i % 4 * 0.1]) for i in range(8)] + [(8, [0.0, 0.0])], "id int, v array<double>")
    links = spark.createDataFrame([(a, b) for g in (0, 4) for a in range(g, g + 4) for b in range(g, g + 4)] + [(3, 4)], "src int, dst int")
    got = {r.id: r.cluster_id for r in K.power_iteration(df, links, "v", "id", 2).collect()}
    assert sorted(got) == list(range(8)) and len({got[i] for i in range(4)}) == len({got[i] for i in range(4, 8)}) == 1 and got[0] != got[7]
    assert K.power_iteration(df, links.limit(0), "v", "id", 2).count() == 0
