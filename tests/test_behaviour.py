"""Small fixtures for operators that SQL can't express, and edge cases of the newer ones."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.functions import extend
from popgraph.operators import axes as A
from popgraph.operators import clusters as K
from popgraph.operators import evaluation, features, panel, refinement, reports, risk, text, ward
from popgraph.operators import features as X
from popgraph.operators import motifs as M


def test_merge_keeps_two_and_relabels(spark):
    c = spark.createDataFrame([(i, i % 4) for i in range(8)], "e int, cluster_id int")
    d = spark.createDataFrame([(0, 2, 0.001), (2, 3, 0.002), (0, 1, 0.003), (1, 3, 0.004)], "a int, b int, divergence double")
    got = {r.e: r.cluster_id for r in M.merge_clusters(c, d, "e", 0.01).collect()}
    # 2 joins 0; (2, 3) is gone with 2; 1 joins 0; two are left, so (1, 3) stays apart
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1}
    same = {r.e: r.cluster_id for r in M.merge_clusters(c, d.where("divergence < 0"), "e", 0.01).collect()}
    assert same == {i: i % 4 for i in range(8)}


def test_divergence_is_zero_for_equal_and_ln2_for_disjoint(spark):
    p = spark.createDataFrame([(0, "x", 1.0), (1, "x", 1.0), (2, "y", 1.0)], "e int, m string, share double")
    c = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "e int, cluster_id int")
    got = {(r.a, r.b): r.divergence for r in M.cluster_divergence(p, c, "e", "m").collect()}
    assert got == {(0, 1): 0.0, (0, 2): 0.693147181, (1, 2): 0.693147181}


def test_axes_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "my family is careful; ignored, fully_vaccinated")], "id int, l string")
    rows = {r.id: r for r in df.select("id", *[c.alias(a) for a, c in A.keyword_axes(F.col("l")).items()]).collect()}
    assert rows[1][1:] == rows[2][1:]
    assert rows[3].exposure_reasoning == "household_transmission" and rows[3].risk_posture == "risk_ignoring" and rows[3].vaccine_reasoning == "vaccine_reliant"


def test_archetype_names(spark):
    df = spark.createDataFrame([("a", "Old cat cat dog"), ("b", "worker"), (None, "bird"), ("c", None)], "k string, t string")
    got = {r.k: r.name for r in A.archetype_names(df, "k", "t").collect()}
    assert got == {"a": "cat_dog_archetype", "b": "mixed_behavioral_pattern", None: "bird_pattern", "c": "mixed_behavioral_pattern"}


def test_oversample_keeps_the_total_and_favours_transitions(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 200, 0.5).otherwise(0.0).alias("r"))
    n = X.oversample(df, ["r"], F.col("id")).groupBy((F.col("id") < 200).alias("hot")).count().collect()
    n = {r.hot: r["count"] for r in n}
    assert abs(n[True] + n[False] - 2000) < 100 and abs(n[True] / 2000 - 900 / 2700) < 0.05


def test_scale_initial_counts(spark):
    c = "S long, E long, I long, R long, D long"
    one = lambda row, target: tuple(X.scale_initial_counts(spark.createDataFrame([row], c), target).first())
    assert one((70, 20, 10, 0, 0), 1000) == (700, 200, 100, 0, 0)
    assert one((5, 0, 0, 5, 0), 100) == (80, 10, 10, 0, 0)
    assert one((5, 0, 0, 5, 0), 10) == (2, 4, 4, 0, 0)


def test_refinement_finds_two_groups_and_keeps_its_stages(spark):
    rng = np.random.default_rng(2)
    group = lambda i: i % 2
    rows = [(i, (rng.normal(0, 0.1, 4) + 5 * group(i)).tolist(), [1.0 - group(i), float(group(i))]) for i in range(60)] + [(99, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>, m array<double>")
    profile = spark.createDataFrame([(i, "ab"[group(i)], 1.0) for i in range(60)], "id long, pattern string, share double")
    edges = spark.createDataFrame([(i, i + 2, "work", 1.0) for i in range(58)], "agent_1 long, agent_2 long, edge_type string, contact_rate double")
    told = refinement.refine_clusters(df, profile, edges, "id", "v", "m", "pattern", 3, 2, threshold=0.7, rounds=2)
    got = {r.id: r.cluster_id for r in told.labels.collect()}
    assert set(got) == set(range(60)) and len({(group(i), c) for i, c in got.items()}) == 2
    # two groups without links between them: modularity 0.5, coherence 1, silhouette near 1
    assert 0.75 < told.score < 0.78 and told.scores == [told.score] and told.best == 0
    assert set(told.stages[0]) == set(refinement.STAGES) and all(t.count() > 0 for n, t in told.stages[0].items() if n != "boundary")
    again = refinement.refine_clusters(df, profile, edges.limit(0), "id", "v", "m", "pattern", 3, 2, threshold=0.8, rounds=1)
    assert again.scores == [again.score] and 0.5 < again.score < 0.6
    with pytest.raises(ValueError, match="no rows"):
        refinement.refine_clusters(df.limit(0), profile, edges, "id", "v", "m", "pattern", 3, 2, 0.7)


def plain_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        i, j = min(((i, j) for j in range(len(groups)) for i in range(j)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("k", [1, 2, 3, 7, 40, 60])
def test_ward_equals_the_plain_method(spark, k):
    x = np.random.default_rng(k).normal(size=(40, 3))
    df = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "i long, v array<double>")
    got = defaultdict(set)
    for r in K.ward_cluster(df, "v", "i", k).collect():
        got[r.cluster_id].add(r.i // 10)
    assert {frozenset(g) for g in got.values()} == plain_ward(x, k) and set(got) == set(range(min(k, 40)))


def test_ward_weighs_points_and_works_on_micro_clusters(spark):
    rng = np.random.default_rng(1)
    points, sizes = rng.normal(size=(12, 2)), rng.integers(1, 6, 12)
    spread = np.repeat(np.arange(12), sizes)
    same = plain_ward(points[spread], 4)
    labels = ward.ward_labels(points, sizes, 4)
    assert {frozenset(np.nonzero(labels[spread] == c)[0].tolist()) for c in range(4)} == same
    far = np.concatenate([rng.normal(size=(100, 2)) + c for c in (0, 40, 80)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(far)], "i long, v array<double>")
    got = {r.i: r.cluster_id for r in K.ward_cluster(df, "v", "i", 3, micro=20).collect()}
    assert len(got) == 300 and len({(i // 100, c) for i, c in got.items()}) == 3
    assert K.ward_cluster(df.limit(0), "v", "i", 3).count() == 0


def test_too_many_clusters_raise(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_CLUSTERS", 3)
    p = spark.createDataFrame([(i, "x", 1.0) for i in range(4)], "e int, m string, share double")
    c = spark.createDataFrame([(i, i) for i in range(4)], "e int, cluster_id int")
    with pytest.raises(ValueError, match="4 clusters"):
        M.cluster_divergence(p, c, "e", "m")
    with pytest.raises(ValueError, match="4 clusters"):
        M.merge_clusters(c, spark.createDataFrame([], "a int, b int, divergence double"), "e", 0.1)


def test_pca_projects_on_the_long_axis(spark):
    rows = [(i, [float(i), 0.0, 0.001 * (i % 3)]) for i in range(30)]
    got = M.shared_pca(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v").collect()
    assert all(abs(abs(r.pc1) - r.id) < 0.01 for r in got)


def test_split_divides_only_flagged_clusters(spark):
    rows = [(i, 0, [float(i % 2) * 9]) for i in range(10)] + [(i, 1, [float(i % 2) * 9]) for i in range(10, 20)] + [(20, 2, [1.0])]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    got = {r.id: r.label for r in M.split_clusters(df, spark.createDataFrame([(1,), (2,)], "label int"), "label", "v", "id").collect()}
    assert len(got) == 21 and all(got[i] == 0 for i in range(10)) and got[20] == 2
    assert {got[i] for i in range(10, 20, 2)} != {got[i] for i in range(11, 20, 2)} and {got[i] for i in range(10, 20)} == {1, 3}
    same = {r.id: r.label for r in M.split_clusters(df, df.where("id < 0"), "label", "v", "id").collect()}
    assert same == {r[0]: r[1] for r in rows}
    both = {r.id: r.label for r in M.split_clusters(df, df.select("label").distinct(), "label", "v", "id").collect()}
    assert {both[i] for i in range(0, 10, 2)} == {0} and {both[i] for i in range(1, 10, 2)} == {3} and {both[i] for i in range(11, 20, 2)} == {4}
    equal = spark.createDataFrame([(i, 0, [1.0]) for i in range(4)], df.schema)
    assert {r.label for r in M.split_clusters(equal, equal, "label", "v", "id").collect()} == {0}


def test_table_functions_in_sql(spark):
    extend.register_pattern_rows(spark)
    df = spark.createDataFrame([(1, "a 1, b x2; c 99999999999999999999"), (2, None), (3, "none")], "i int, t string")
    ask = lambda p, c: [tuple(r) for r in spark.sql(f"SELECT d.i, r.* FROM {{d}} d, LATERAL pattern_rows(d.t, '{p}', '{c}') r", d=df).collect()]
    assert sorted(ask("([a-c]) ([0-9]+)?", "w string, n double"), key=str) == [(1, "a", 1.0), (1, "b", None), (1, "c", 1e20)]
    assert ask("(zz)", "w string") == []
    for bad in (("([a-c])", "w string, n long"), ("(a)", "w text")):
        with pytest.raises(Exception, match="columns for|not a name"):
            ask(*bad)
    with pytest.raises(Exception, match="constants"):
        spark.sql("SELECT r.* FROM {d} d, LATERAL pattern_rows(d.t, d.t, 'w string') r", d=df).collect()
    extend.register_rows(spark, "counted", lambda n: [(k, str(k)) for k in range(n or 0)], "k int, s string")
    assert sorted(tuple(r) for r in spark.sql("SELECT d.i, c.* FROM {d} d, LATERAL counted(d.i) c", d=df).collect()) == [(i, k, str(k)) for i in (1, 2, 3) for k in range(i)]


def test_partial_states_equal_the_coherence_of_profiles(spark):
    """A group spread over many tasks, and more groups than a task holds at once."""
    rng = np.random.default_rng(4)
    rows = [(i, int(c), str(m), float(rng.random())) for i, (c, m) in enumerate(zip(rng.integers(0, 30, 3000) * (rng.random(3000) < 0.6), rng.choice(list("abcdef"), 3000)))]
    df = spark.createDataFrame(rows, "id long, cluster_id int, m string, share double")
    want = {r.cluster_id: r.coherence for r in M.motif_coherence(df.select("id", "m", "share"), df.select("id", "cluster_id"), "id", "m").collect()}

    def fold(state, part):
        out = dict(state or {})
        for m, s in part.groupby("m")["share"].sum().items():
            out[m] = out.get(m, 0.0) + float(s)
        return out

    def merge(a, b):
        a, b = dict(a), dict(b)
        return {m: a.get(m, 0.0) + b.get(m, 0.0) for m in a.keys() | b.keys()}

    def coherence(state):
        p = np.array([v for v in dict(state).values() if v > 0])
        p = p / p.sum()
        return 1.0 if len(p) < 2 else 1 + (p * np.log(p)).sum() / np.log(len(p))

    for held in (10_000, 3):
        got = {r.cluster_id: r.metric for r in extend.aggregate_with(df.repartition(16), ["cluster_id"], "map<string,double>", fold, merge, coherence, held=held).collect()}
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-6 for c in want)
    # a null key is a group; no rows, no groups
    null = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, 5.0)], "k int, x double")
    total = lambda d: {r.k: r.metric for r in extend.aggregate_with(d, ["k"], "double", lambda s, r: (s or 0.0) + float(r["x"].sum()), lambda a, b: a + b, float).collect()}
    assert total(null) == {None: 3.0, 1: 5.0} and total(null.limit(0)) == {}


def test_scaling_and_audit_of_arrays(spark):
    rows = [(1, [1.0, 5.0, None], [[1.0, 2.0], [3.0, 2.0]], [7.0]), (2, [3.0, 5.0, 2.0], [[5.0, 2.0], [7.0, 2.0]], [7.0]), (3, None, None, None)]
    df = spark.createDataFrame(rows, "i int, tab array<double>, seq array<array<double>>, g array<double>")
    parts = ["tab", "seq", "g"]
    fit = {(r.field, r.pos): (r.mean, round(r.std, 6)) for r in evaluation.fit_array_scaler(df, parts).collect()}
    assert fit == {("tab", 0): (2.0, 1.414214), ("tab", 1): (5.0, 1.0), ("tab", 2): (2.0, 1.0), ("seq", 0): (4.0, 2.581989), ("seq", 1): (2.0, 1.0), ("g", 0): (7.0, 1.0)}
    got = {r.i: r for r in evaluation.apply_array_scaler(df, parts, evaluation.fit_array_scaler(df, parts)).collect()}
    assert np.allclose(got[1].seq, [[-1.161895, 0], [-0.387298, 0]]) and got[1].g == [0.0] and got[1].tab[1:] == [0.0, None] and abs(got[2].tab[0] - 0.707107) < 1e-6
    assert got[3].tab is None and got[3].seq is None
    odd = spark.createDataFrame([([1.0, float("nan"), None, float("inf"), -3.0],)], "x array<double>")
    assert tuple(evaluation.audit_arrays(odd, ["x"], 0.0, 2.0).first()) == ("x", 5, 1, 1, 1, 2)


def test_json_in_texts(spark):
    texts = ['say {"a": {"b": [1, {"c": "}"}]}, "k": 2} end', '{"k": "3"', "no", '{"k": 1} or {"k": 2}', 'x {"k": null, "a": 5}', None, "}{"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    cols = features.extract_json(F.col("t"), {"k": "long", "a": "json"}, {"k": -1, "a": "-"}, {"k": -2, "a": ""})
    got = {r.i: (r.k, r.a) for r in df.select("i", *cols).collect()}
    assert got == {0: (2, '{"b":[1,{"c":"}"}]}'), 1: (-2, ""), 2: (-2, ""), 3: (-1, "-"), 4: (-1, "5"), 5: (-2, ""), 6: (-1, "-")}
    lists = spark.createDataFrame([(1, 'so [{"d": "x", "n": 1}, {"n": 2}, {"d": "y", "more": [1]}] ok'), (2, "[broken"), (3, "[]")], "i int, t string")
    assert sorted(tuple(r) for r in features.extract_json_rows(lists, "t", "d", {"n": "long"}).collect()) == [(1, "x", 1), (1, "y", None)]


def test_fusion_without_confidence(spark):
    df = spark.createDataFrame([(0.5, 0.1, 0.0, 0.0, 1.0, "none"), (0.5, 0.1, 0.0, 0.4, 1.0, "none"), (0.5, 0.1, 0.4, 0.4, 9.0, "none"), (0.5, 0.1, 0.4, 0.4, 1.0, "I->D"), (0.02, 0.0, 0.0, 0.0, 1.0, "I->D")], "s double, n double, cs double, cn double, m double, t string")
    p, c = risk.fuse(*[F.col(x) for x in ("s", "n", "cs", "cn", "m", "t")])
    got = [tuple(r) for r in df.select(F.round(p, 6), F.round(c, 6)).collect()]
    assert got == [(0.34, 0.0), (0.1, 0.4), (0.95, 0.4), (0.02, 0.4), (0.012, 0.0)]


def test_reasoning_between_markers(spark):
    long = "because of many contacts at work"
    texts = [f"x REASONING: {long}\n ADJUSTMENT: 1", "Intro REASONING: short ADJUSTMENT: 1.0", "a" * 300, "b" * 20, f"REASONING:{long}", None, "REASONING: " + "c" * 20 + " ADJUSTMENT:"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[1] for r in df.select("i", text.reasoning_text(F.col("t"))).orderBy("i").collect()]
    assert got == [long, None, "a" * 200, None, long, None, None]


def test_reflection_takes_the_best_observations_so_far(spark):
    rows = [(1, i, float(v), o) for i, (v, o) in enumerate([(60, True), (90, True), (10, False), (5, True), (100, True), (60, True), (40, False)])] + [(2, 0, 500.0, True), (None, 1, 500.0, True)]
    items = spark.createDataFrame(rows, "k int, i int, v double, obs boolean")
    got = sorted((r.k, r.n, r["rank"], r.i, r.v) for r in panel.reflection_inputs(items, "k", ["i"], "i", "v", F.col("obs"), 150.0, top=3).collect())
    # the sum reaches 150 with two observations only, goes on to the third, and starts again
    assert got == [(1, 4, 1, 1, 90.0), (1, 4, 2, 0, 60.0), (1, 4, 3, 3, 5.0), (1, 6, 1, 4, 100.0), (1, 6, 2, 1, 90.0), (1, 6, 3, 0, 60.0)]


def test_tool_usage_counts_conversations_without_tools(spark):
    rows = [(1, "a", ["x", "y"]), (1, "b", None), (1, "b", ["x"]), (1, "b", []), (2, "a", None)]
    got = {r.k: r for r in reports.tool_usage(spark.createDataFrame(rows, "k int, s string, t array<string>"), "k", "s", "t", {"g": ["x"]}).collect()}
    assert (got[1].calls, got[1].decisions, got[1].scenarios, got[1].per_decision, got[1].g_ratio, got[1].breakdown) == (3, 4, 2, 0.75, 0.667, {"x": 2, "y": 1})
    assert (got[2].calls, got[2].decisions, got[2].per_decision, got[2].diversity, got[2].breakdown) == (0, 1, 0.0, 0.0, {})


COHORT = "agent_id long, household_id long, work_network int, cluster string, occupation string, is_imported boolean"


def test_scenarios_begin_with_roles(spark):
    rows = [(i, i // 6, None if i % 4 == 0 else i % 2, "Dorm A" if 60 <= i < 90 else None, "service_worker" if i in (7, 19, 33, 40, 58) else "x", i % 20 == 3) for i in range(120)]
    drawn = lambda rows: {s: {r.agent_id: (r.role, r.days_in_state) for r in got if r.scenario == s} for got in [features.scenario_cohorts(spark.createDataFrame(rows, COHORT)).collect()] for s in features.SCENARIOS}
    got = drawn(rows)
    n = {s: (sum(v[0] == "I" for v in g.values()), sum(v[0] == "E" for v in g.values())) for s, g in got.items()}
    assert n["imported_cases"] == (3, 2) and all(i % 20 == 3 for i in got["imported_cases"])
    assert n["dormitory_cluster"] == (8, 15) and all(60 <= i < 90 for i in got["dormitory_cluster"])
    # two infected and two exposed in each of three households, three infected of the largest workplace
    assert n["community_clusters"] == (9, 6) and sum(i < 18 for i in got["community_clusters"]) >= 12
    ill = {i for i, (role, _) in got["circuit_breaker"].items() if role == "I"}
    assert len(ill) == 4 and ill < {7, 19, 33, 40, 58} and {i // 6 for i in got["circuit_breaker"]} == {i // 6 for i in ill} and n["circuit_breaker"][1] == 2 * len({i // 6 for i in ill})
    assert n["community"] == (3, 2)
    assert all(2 <= days <= 6 if role == "I" else 1 <= days <= 3 for g in got.values() for role, days in g.values())
    # too few to draw from: some of all
    few = drawn([(i, h, w, None, "x", i == 0) for i, h, w, *_ in rows])
    assert [len(few[s]) for s in features.SCENARIOS[:2]] == [3, 8] and all(r == "I" for s in features.SCENARIOS[:2] for r, _ in few[s].values())
    assert sum(r == "I" for r, _ in few["circuit_breaker"].values()) == 3
    assert all(not g for g in drawn(rows[:0]).values()) and len(drawn(rows[:1])["community"]) == 1


def test_axes_take_one_search(spark):
    """All labels of a text come from one call of one Python function, and null is the empty text."""
    df = spark.createDataFrame([(1, "worried at work, will check"), (2, None)], "id long, l string")
    told = df.select("id", *[c.alias(a) for a, c in A.keyword_axes(F.col("l")).items()])
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan[plan.index("ArrowEvalPython [") :].split("]")[0].count("told(") == 1
    rows = [tuple(r)[1:] for r in told.orderBy("id").collect()]
    assert rows == [A.axis_labels("worried at work, will check"), A.axis_labels("")] and rows[0][-1] == "risk_averse" and rows[1][-1] == "risk_neutral"


def test_fused_vectors_stay_whole(spark):
    rows = [(1, [1.0, 2.0, None], [1.0]), (1, [0.5, 2.0], None), (2, None, [3.0, 4.0]), (3, [], None), (4, None, None), (None, [1.0], [2.0]), (5, [1.0, 2.0, 3.0, 4.0], []), (6, [2.0, 2.0, 1.0, 9.0], [0.0, 1.0]), (7, [None, None], None)]
    df = spark.createDataFrame(rows, "id int, graph array<double>, motif array<double>")
    told = M.fuse_embeddings(df, "id", {"graph": 0.6, "motif": 0.4}, 5)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 2 and "Join Inner, (" not in plan  # entries are not joined back to their rows
    got = {r.id: r.fused for r in told.collect()}
    assert set(got) == {1, 2, 5, 6, 7} and all(len(v) == 5 for v in got.values()) and got[7] == [0.0] * 5
    graph, motif = [[1.0, 0.5, 1.0, 1.0, 2.0], [2.0, 2.0, 2.0, 2.0], [3.0, 1.0], [4.0, 9.0]], [[1.0, 3.0, 0.0, 2.0], [4.0, 1.0]]
    scaled = lambda v, dims: [(x - np.mean(d)) / (np.std(d) if np.std(d) > 1e-9 else 1.0) for x, d in zip(v, dims, strict=False)]
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    six = 0.6 * unit(scaled([2.0, 2.0, 1.0, 9.0], graph))
    six[:2] += 0.4 * unit(scaled([0.0, 1.0], motif))
    np.testing.assert_allclose(got[6][:4], unit(six), atol=1e-5)
    one = np.array(scaled([1.0, 2.0], graph)), np.array(scaled([0.5, 2.0], graph)), np.array(scaled([1.0], motif))  # rows of one id are added up
    both = 0.6 * (one[0] + one[1]) / np.linalg.norm(np.concatenate(one[:2]))
    both[:1] += 0.4 * unit(one[2])
    np.testing.assert_allclose(got[1][:2], unit(both), atol=1e-5)


def test_kmeans_is_dealt_to_tasks(spark):
    df = spark.range(20000).coalesce(1)
    dealt = K._spread(df, "id", 1024)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 20000
    assert K._spread(df, "id", 8).rdd.getNumPartitions() == 1
