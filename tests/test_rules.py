"""Fixed rules worked by hand, and operators against plain Python."""

import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.operators import clusters, entities, evaluation, network, panel, reports, retrieval, risk, samples, text
from popgraph.plans.ranks import dealt_in_ranges, exact_percentiles, global_rank, rank_in_groups
from popgraph.streaming import daily, history, stateful


def col(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[1] for r in df.select("i", f(F.col("t"))).orderBy("i").collect()]


LEAKY = {
    "Cases rose in March 2020 sharply. Wash hands.": "Wash hands.",
    "The rate is 18.3% today. Wash hands.": "Wash hands.",
    "Wash hands. It fell by 40 since May. Then 2.5 times higher! Stay home": "Wash hands. Stay home",
    "TraceTogether began. Phase 2 too? Safe": "Safe",
    "Masks help currently.\n\n \n\nNext week  wash hands. ": "Masks help .\n\n wash hands.",
    "no end 20% of it": "no end 20% of it",
    "": "",
}


def test_leakage_rules(spark):
    assert col(spark, list(LEAKY), "string", text.remove_leakage) == list(LEAKY.values())
    assert col(spark, [None], "string", text.remove_leakage) == [None]


def test_leakage_takes_time_in_proportion(spark):
    long = "word 12 on and on 7 " * 40000 + "20% of it"
    assert col(spark, [long], "string", text.remove_leakage) == [long]


def test_audit_and_confidence(spark):
    docs = spark.createDataFrame([(1, "In March 2020 and May 2021."), (2, "Phase 2, Circuit Breaker; 50%"), (3, "may 2018")], "d int, t string")
    got = {(r.d, r.issue) for r in text.audit_leakage(docs, "d", "t").collect()}
    assert got == {(1, "year 2020"), (1, "year 2021"), (1, "date"), (2, "event phase 2"), (2, "event circuit breaker")}
    assert col(spark, ["CONFIDENCE: HIGH x", "CONFIDENCE: LOW", "CONFIDENCE: ?", "none"], "string", text.parse_confidence) == [0.95, 0.6, 0.8, 0.8]


def found(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [tuple(r)[1:] for r in text.extract_sections(df).orderBy("page_id", F.col("section").desc()).collect()]


def test_sections(spark):
    body, more = "x" * 60, "y" * 60
    # paragraphs without end, scripts and comments inside them, text outside paragraphs
    assert found(spark, f'<div class="Content">{body}<p>A<p>B <b>c</b></p>d</div>') == [("section_0", None, f"{body}\nA\nB\nc\nd")]
    assert found(spark, f'<article class="x article"><p>{body}<script>var a="<p>";</script>e<!-- n -->f') == [("section_0", None, f"{body}\ne\nf")]
    # containers in one another, the first heading inside, a short one that counts but gives nothing
    page = f'<section class="my-section"><div class="guidelines"><h3> On <i>tests</i> </h3>{body}</div><div class="content">z</div><h2>Late</h2></section><div class="content">{more}</div>'
    assert sorted(found(spark, page)) == [("section_0", "Ontests", f"On\ntests\n{body}\nz\nLate"), ("section_1", "Ontests", f"On\ntests\n{body}"), ("section_3", None, more)]
    # other classes count only where no section is
    assert found(spark, f'<div class="">{body}</div><div>{more}</div><p class="content">{more}</p>') == [("section_0", None, body)]
    assert found(spark, f'<div class="a">{body}</div><article class="content">s</article>') == []
    assert found(spark, None, "", "plain " * 20) == []


def test_sections_from_lists(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    assert found(spark, f"<ul><li>{a}<li><p>{b}</p> {b}<li>{c}</ul>") == [("list_0", "Guidelines", f"- {a}\n- {b}{b}\n- {c}")]
    # nested items count for both lists; short lists and two items don't
    nested = f"<ol><li>{a}<ul><li>{b}</li><li>{c}</li></ul></li></ol>"
    assert found(spark, nested) == [("list_0", "Guidelines", f"- {a}{b}{c}\n- {b}\n- {c}")]
    assert found(spark, "<ul><li>a<li>b<li>c</ul>", f"<ul><li>{a * 3}<li>{b}</ul>") == []
    assert found(spark, f"<ul><li>1<li>2<li>3</ul><ul><li>{a}<li>{b}<li>{c}</ul>")[0][0] == "list_1"


class _Tree(HTMLParser):
    """A whole tree, for comparison: nodes are [tag, class, children]; pages must end their lists and containers."""

    def __init__(self, html):
        super().__init__()
        self.root = ["", None, []]
        self.path = [self.root]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class"), []]
        self.path[-1][2].append(node)
        if tag not in ("br", "meta"):
            self.path.append(node)

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.path]:
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.path[-1][0] not in ("script", "style"):
            self.path[-1][2].append(data)


def _walk(node):
    for x in node[2]:
        if isinstance(x, list):
            yield x
            yield from _walk(x)


def _said(node):
    return [t for x in node[2] for t in (_said(x) if isinstance(x, list) else [x.strip()]) if t]


def test_sections_of_all_pages_equal_a_tree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("html", F.replace("html", F.lit("<article>"), F.lit('<article class="content"><div class="k">')))
    want = set()
    for r in pages.collect():
        nodes = list(_walk(_Tree(r.html).root))
        for no, n in enumerate([x for x in nodes if x[0] in ("section", "article", "div") and "content" in (x[1] or "")]):
            content = "\n".join(_said(n))
            heads = ["".join(_said(x)) for x in _walk(n) if x[0] in ("h1", "h2", "h3", "h4")]
            want |= {(r.page_id, f"section_{no}", (heads + [None])[0], content)} if len(content) >= 50 else set()
        for no, n in enumerate([x for x in nodes if x[0] in ("ul", "ol")]):
            items = ["- " + "".join(_said(x)) for x in _walk(n) if x[0] == "li"]
            want |= {(r.page_id, f"list_{no}", "Guidelines", "\n".join(items))} if len(items) >= 3 and len("\n".join(items)) > 100 else set()
    assert len(want) > 200 and {tuple(r) for r in text.extract_sections(pages).collect()} == want


def test_filter_sections(spark):
    good = "You should wash hands and wear a mask to prevent spread of it among all."
    rows = [(1, "0", "h", good + " Of 300 cases 20% fell."), (1, "1", None, "nothing of use " * 9), (2, "0", "h", good + " cookie"), (2, "1", "h", "Should avoid risk. " + "9% of it. " * 9), (3, "list_0", None, good)]
    kept = text.filter_sections(spark.createDataFrame(rows, "page_id long, section string, heading string, content string"))
    assert [tuple(r) for r in kept.collect()] == [("prevention_1_0", "prevention", "h", good), ("prevention_3_list_0", "prevention", None, good)]
    kept = kept.where("heading is not null")
    known = spark.createDataFrame([("prevention_1_0", "x", "y", "z")], kept.schema)
    assert text.insert_if_absent(known, kept.union(kept.withColumn("id", F.lit("new")))).select("id").orderBy("id").collect() == [("new",), ("prevention_1_0",)]


def test_links(spark):
    rows = [(1, "family of 2"), (2, "linked to S3, 3b and 4, work"), (3, "case 4 and 5, colleague"), (4, "1"), (5, "5 and 3")]
    got = {tuple(r) for r in network.link_edges(spark.createDataFrame(rows, '`case` long, link string')).collect()}
    assert got == {(1, 2, "household", 0.95), (2, 4, "work", 0.70), (3, 4, "contact", 0.60), (3, 5, "contact", 0.60), (1, 4, "contact", 0.60)}


def test_drawn_contacts(spark):
    of = [(i, 0 if i < 60 else 1 if i < 75 else 2 if i < 77 else 3) for i in range(78)]
    agents = spark.createDataFrame(of, "agent_id long, g long")
    group = dict(of)
    peers = defaultdict(set)
    for r in network.network_edges(agents, ["g"], "work", 0.70).collect():
        assert r.agent_1 < r.agent_2 and group[r.agent_1] == group[r.agent_2]
        peers[r.agent_1].add(r.agent_2), peers[r.agent_2].add(r.agent_1)
    assert all(len(peers[i]) >= min(2, sum(g == group[i] for g in group.values()) - 1) for i in group)
    edges = network.group_edges(agents, ["g"]).collect()
    rates = {(group[r.agent_1], r.contact_rate) for r in edges}
    assert rates <= {(0, 0.5), (1, 0.6), (2, 0.6)} and len({(r.agent_1, r.agent_2) for r in edges}) == len(edges)
    assert 25 <= sum(group[r.agent_1] == 1 for r in edges) <= 60  # 0.4 of 105 pairs
    ranked = rank_in_groups(agents.union(spark.createDataFrame([(99, None)], agents.schema)), ["g"], "agent_id", "r", "n").collect()
    assert all(r.r == sum(j < r.agent_id for j in group if group[j] == r.g) and r.n == sum(g == r.g for g in group.values()) for r in ranked)


def test_a_hot_group_is_ranked_in_many_tasks(spark):
    """Ids far apart, two thirds of them in one group; small partitions are not put together."""
    rows = spark.range(20000).select(F.xxhash64("id").alias("agent_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = dealt_in_ranges(rows, ["g", "agent_id"]).where("g = -1").groupBy("_range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) >= 2 and max(r["count"] for r in ranges) < 8000
    want = {i: k for k, i in enumerate(sorted(r.agent_id for r in rows.where("g = -1").collect()))}
    got = rank_in_groups(rows, ["g"], "agent_id", "r", "n").where("g = -1").collect()
    assert {r.agent_id: r.r for r in got} == want and {r.n for r in got} == {len(want)}


def test_repair_isolated(spark):
    agents = spark.createDataFrame([(i,) for i in range(9)], "agent_id long")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "agent_1 long, agent_2 long").withColumn("edge_type", F.lit("work")).withColumn("contact_rate", F.lit(1.0))
    repaired = lambda e, a=agents: {(r.agent_1, r.agent_2) for r in network.repair_isolated(a, e).where("contact_rate = 0.4").collect()}

    def want(order, lone):
        """The r-th of ``order``, of which the first ``lone`` are isolated, takes those at places 2r + 1 and 2r + 2."""
        pairs = {tuple(sorted((order[r], order[(2 * r + k) % len(order)]))) for r in range(lone) for k in (1, 2)}
        return {p for p in pairs if p[0] != p[1]}

    assert repaired(edges) == want([3, 4, 5, 6, 7, 8, 0, 2, 1], 6)
    # without any edge all are isolated; one alone stays so
    assert repaired(edges.limit(0)) == want(list(range(9)), 9)
    assert repaired(edges.limit(0), agents.limit(1)) == set()


def test_contact_network_in_layers(spark):
    """A pair has the edge of the first layer that holds it, and nobody is left alone."""
    rows = [(i, i // 3, "dorm" if i < 12 else None, "w" if i % 2 else None, 7 if i in (40, 41, 43) else None) for i in range(48)] + [(100, 100, None, None, None), (101, 101, None, None, None)]
    agents = spark.createDataFrame(rows, "agent_id long, home long, cluster string, work_network string, school_network int")
    links = spark.createDataFrame([(0, 1, "contact", 0.6), (0, 4, "work", 0.7), (46, 47, "contact", 0.6), (1, 100, "contact", 0.6)], "agent_1 long, agent_2 long, edge_type string, contact_rate double")
    net = network.build_contact_network(agents, links, "home")
    got = {(r.agent_1, r.agent_2): (r.edge_type, r.contact_rate) for r in net.collect()}
    assert len(got) == net.count() and all(a < b for a, b in got)
    assert all(got[a, b] == ("household", 0.95) for a in range(48) for b in range(a + 1, 48) if a // 3 == b // 3)
    assert got[0, 1][0] == "household" and got[0, 4] == ("work", 0.7) and got[1, 100] == ("contact", 0.6) and got[46, 47][0] == "household"
    kinds = defaultdict(set)
    for (a, b), (kind, rate) in got.items():
        kinds[kind].add((a, b))
        assert rate == {"household": 0.95, "contact": 0.6, "cluster": 0.6, "work": 0.7, "school": 0.65, "community": 0.4}[kind]
    assert kinds["cluster"] and all(b < 12 and a // 3 != b // 3 for a, b in kinds["cluster"])
    assert all(a % 2 and b % 2 for a, b in kinds["work"] - {(0, 4)}) and kinds["school"] == {(40, 43)} | ({(41, 43)} - kinds["work"] - kinds["household"])
    alone = {i for i in [r[0] for r in rows] if not any(i in p for k, ps in kinds.items() if k != "community" for p in ps)}
    assert alone == {101} and len(kinds["community"]) == 2 and all(101 in p for p in kinds["community"])
    assert network.build_contact_network(agents.limit(0), links.limit(0), "home").count() == 0
    bare = network.build_contact_network(agents, links, "home", repair=False)
    assert {(r.agent_1, r.agent_2) for r in bare.collect()} == set(got) - kinds["community"]


def test_ranks_and_percentiles(spark):
    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.integers(0, 50, 997)]
    df = spark.createDataFrame(list(enumerate(x)), "id long, x double").repartition(7)
    got = {r.id: r.at for r in global_rank(df, ["x", "id"], "at").collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(997), key=lambda i: (x[i], i)))}
    points = [0.0, 0.25, 0.4, 0.5, 0.999, 1.0]
    assert np.allclose(list(exact_percentiles(df, "x", points).first()), np.percentile(x, [100 * p for p in points]))


def test_policy_and_vector(spark):
    assert col(spark, [0, 49, 50, 109, 110], "int", samples.stringency) == [0.3, 0.3, 0.9, 0.9, 0.6]
    a = spark.createDataFrame([(7, 50, "teacher", 2, 3, 0.4, 0.5, 0.6)], "agent_id long, age int, occupation string, vaccination_status int, comorbidity_count int, mobility_score double, compliance_score double, risk_awareness double")
    assert [float(x) for x in entities.entity_features(a, F.lit("I")).first().features] == [0.5, 0, 0, 0, 1, 0, 0, 0.1, 0, 0, 1, 0.6, 0.4, 0.5, 0.6, 0, 0, 1, 0, 0]
    job = spark.createDataFrame([(30, 45, "City Hospital"), (30, 45, "Dorm A"), (30, 45, None), (10, 60, "Dorm A"), (70, 1, None)], "age int, i long, c string")
    w, s = entities.infer_networks(F.col("age"), F.col("i"), F.col("c"), F.lit("H"))
    got = [tuple(r) for r in job.select(w, s).collect()]
    assert 500 <= got[0][0] < 550 and 1000 <= got[1][0] < 1100 and got[2][0] == 2 and got[3] == (-1, 2) and got[4] == (-1, -1)


def test_trend_and_history(spark):
    h = spark.createDataFrame([(0, i, 100 - a, a, 0, 0, 0) for i, a in enumerate([0, 10, 20, 30, 90, 20])], "c int, day int, S long, E long, I long, R long, D long")
    assert [r.trend for r in panel.trend(h, ["c"]).orderBy("day").collect()] == [0.5, 0.5, 0.5, 0.8, 1.0, 0.5]
    p = spark.createDataFrame([(1, i, s, d) for i, (s, d) in enumerate(zip("SEE", (0, 0, 1)))], "agent_id long, day int, state string, days_in_state int")
    near = spark.createDataFrame([(1, 2, 7)], "agent_id long, day int, infected long")
    last = panel.state_history_matrix(p, near).where("day = 2").first().history
    s, e = [1.0, 0, 0, 0, 0], [0.0, 1, 0, 0, 0]
    assert last == [s + [0, 0]] * 5 + [e + [0, 0], e + [0.05, 1.0]]


def test_samples_in_steps(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0)], "k int, o int")
    at = lambda even: sorted((r.k, r.o) for r in panel.systematic_sample(df, "k", ["o"], 4, even).collect())
    assert at(False) == [(1, 0), (1, 2), (1, 4), (1, 6), (2, 0)] and at(True) == [(1, 0), (1, 2), (1, 5), (1, 7), (2, 0)]


def test_losses_weights_and_r0(spark):
    df = spark.createDataFrame([(0.5, 0.0, 1.0), (0.5, 1.0, 2.0)], "p double, y double, w double")
    assert tuple(evaluation.weighted_losses(df, F.col("w"), 2.0, "p", "y").first()) == (0.375, 0.875)
    rates = spark.createDataFrame([(0.2, 0.1), (0.2, 0.3)], "a double, b double")
    for method in ("inverse_freq", "balanced"):
        assert {r.transition: r.weight for r in evaluation.class_weights(rates, ["a", "b"], method).collect()} == {"a": 1.0, "b": 1.0}
    assert {r.weight for r in evaluation.class_weights(rates.withColumn("a", F.lit(0.1)), ["a", "b"]).collect()} == {1.333333, 0.666667}
    r0 = spark.range(1).select(evaluation.r0_from_network(F.lit(3.0), F.lit(4.0))).first()[0]
    assert math.isclose(r0, 2 * (1 - math.exp(-0.18)) + 0.035 * 4 * 10)
    h = spark.createDataFrame([(0, 50, 25, 25, 0, 0)], "day int, S long, E long, I long, R long, D long")
    assert evaluation.r_eff(h).first().r_eff == 1.25


PEOPLE = "agent_id long, k int, cluster string, occupation string, is_imported boolean, household_id long, age int, vaccination_status int, quarantined boolean"


def people(spark):
    rows = []
    for i in range(60):
        k = i % 6
        rows.append((i, k, "Dorm" if k == 0 and i < 24 else None, "manual_worker" if k == 1 and i < 42 else f"job{i}" if k != 4 or i > 40 else "teacher", k == 2 and i < 40, 9 if k == 3 and i < 50 else i, 75, i % 3, i % 5 == 0))
    return spark.createDataFrame(rows, PEOPLE)


def test_cluster_types_and_flags(spark):
    a = people(spark)
    assert {r.k: r.cluster_type for r in reports.cluster_type(a, "k").collect()} == {0: "dormitory", 1: "dormitory", 2: "imported", 3: "household", 4: "workplace", 5: "community"}
    p = spark.createDataFrame([(i, 3, "I" if i // 6 < 2 else "E" if i // 6 < 5 else "R" if i // 6 < 8 else "D") for i in range(60)], "agent_id long, day int, state string")
    got = {r.k: r for r in reports.monitor_clusters(a, p, "k").collect()}
    assert got[0].flags == "dormitory_outbreak,elevated,exposure_wave,recovery,deaths" and got[5].flags == "elevated,exposure_wave,recovery,deaths"
    assert (got[5].I, got[5].E, got[5].R, got[5].D, got[5].elderly_infected, got[5].mean_age_dead) == (2, 3, 3, 2, 2, 75.0)


def test_profiles(spark):
    a = spark.createDataFrame([(0, 1, 0, 5), (1, 9, 1, 3), (1, 2, 2, 8)], "agent_id long, disease_status int, vaccination_status int, days_since_start int")
    got = {r.check: (r.value, r.passed) for r in reports.validate_profiles(a, ["agent_id", "name"]).collect()}
    assert got == {"missing_fields": (1, False), "duplicate_ids": (1, False), "dense_ids": (1, False), "invalid_states": (1, False), "infected_seed": (2, True), "adequate_seed": (2, False), "vaccinated_share": (0.666667, None), "days_out_of_order": (1, None)}


def test_transitions_and_stages(spark):
    c = F.col
    rows = [("S", 0, 40, 0, 0, 1.0, False, 1, 2, False), ("S", 0, 40, 0, 0, 1.0, True, 1, 2, True), ("I", 8, 40, 1, 1, 1.0, False, 0, 0, False), ("R", 179, 40, 0, 0, 1.0, False, 0, 3, False), ("R", 400, 40, 1, 0, 1.0, False, 1, 1, False)]
    df = spark.createDataFrame(rows, "s string, d int, a int, v int, m int, p double, crowded boolean, h int, o int, q boolean")
    t = risk.transition_probability(c("s"), c("d"), c("a"), c("v"), c("m"), c("p"), c("crowded"), c("h"), c("o"), c("q"))
    got = [{k: round(r[k], 9) for k in t} for r in df.select(*[e.alias(k) for k, e in t.items()]).collect()]
    assert math.isclose(got[0]["s_e"], 0.028 * 0.7) and math.isclose(got[1]["s_e"], 0.028 * 2.5 * 0.2 * 0.7)
    assert math.isclose(got[2]["i_r"], 0.07 * 1.3 * 1.2) and math.isclose(got[2]["i_d"], (1 - (1 - 0.00015) ** 0.1) * 1.5 * 1.5 * 0.5, abs_tol=1e-9)
    assert got[3]["r_s"] == 0 and math.isclose(got[4]["r_s"], 0.005 * 3 * 0.5)
    days = [("E", 2), ("E", 3), ("I", 4), ("I", 9), ("I", 10), ("R", 89), ("R", 179), ("R", 180), ("D", 1)]
    told = spark.createDataFrame(days, "s string, d int").select(risk.progression(c("s"), c("d"), F.lit(0), F.lit(40), F.lit(0))["stage"]).collect()
    assert [r[0] for r in told] == ["early_incubation", "late_incubation", "early_infection", "active_infection", "prolonged_infection", "strong_immunity", "waning_immunity", "weak_immunity", "deceased"]


def test_neighbour_counts(spark):
    agents = spark.createDataFrame([(0, 1, "x"), (1, 1, "Dorm 1"), (2, 2, "x"), (3, 1, "x")], "agent_id long, household_id long, cluster string")
    nb = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "agent_id long, other_id long")
    p = spark.createDataFrame([(1, 5, "I", 0), (2, 5, "D", 10), (3, 5, "D", 11), (3, 6, "D", 12)], "agent_id long, day int, state string, days_in_state int")
    got = {r.day: tuple(r)[2:] for r in risk.neighbor_states(nb, p, agents).collect()}
    assert got == {5: (3, 1, 1, 1, 1, 0, 0.333333), 6: (1, 0, 0, 0, 0, 0, 0.0)}


@pytest.mark.parametrize("block", [3, 2000])
def test_similar_pairs(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 24))
    x = np.concatenate([x, x[:100] + 0.25 * rng.normal(size=(100, 24)), x[:5], x[:5]])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(900, None, 1), (901, [0.0] * 24, 1), (902, [1.0, 2.0], 1), (5, rows[5][1], 2)], "vec_id long, embedding array<double>, home long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j): i % 3 == j % 3 for i in range(len(x)) for j in range(i + 1, len(x)) if u[i] @ u[j] > 0.9}
    assert {(r.a, r.b): r.same_home for r in retrieval.similar_pairs(df, 0.9, flags=("home",), block=block).collect()} == want
    assert retrieval.similar_pairs(df, 0.9, k=3).count() == 3 and retrieval.similar_pairs(df.limit(0), 0.9).count() == 0


def test_db_index_and_density(spark):
    df = spark.createDataFrame([(0, "a", [0.0, 0.0]), (1, "a", [2.0, 0.0]), (2, "b", [10.0, 0.0]), (3, "b", [14.0, 0.0])], "i long, l string, v array<double>")
    assert clusters.db_index(df, "l", "v", "i").first()[0] == round(3 / 11, 6)
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "agent_1 long, agent_2 long, contact_rate double")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "agent_id long, cluster_id long")
    assert {tuple(r) for r in clusters.edge_density(edges, labels).collect()} == {(0, 1.0, 0.25), (1, 0.0, 0.25)}


def test_fine_cluster(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) + 9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    got = {r.i: r.cluster_id for r in clusters.fine_cluster(df, "v", "i", 2).collect()}
    assert len({got[i] for i in range(60)}) == 1 and got[0] != got[60]
    assert clusters.fine_cluster(df.limit(0).union(spark.createDataFrame([(i, [1.0, 1.0, 1.0]) for i in range(4)], df.schema)), "v", "i", 2).count() == 4
    assert {r.balance for r in clusters.with_balance(spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "i long, cluster_id int")).collect()} == {0.5}


EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"


def cast(spark, rows, shape="event_id long, user_id long, ts string, event_type string, value double"):
    return spark.createDataFrame(rows, shape).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def shuffled(spark, tmp_path):
    """Events of three entities in files that aren't in order of time, one file a batch, and a last event far behind them."""
    rng = np.random.default_rng(9)
    kinds = ["view", "click", "error", "purchase"]
    rows = [(i, int(rng.integers(0, 3)), f"2024-01-{1 + i // 5:02d} 0{i % 5}:00:00", kinds[rng.integers(0, 4)], float(rng.integers(10, 90))) for i in range(60)]
    end = (-1, -1, "2025-01-01 00:00:00", "view", 0.0)
    order = rng.permutation(60)
    path = str(tmp_path / "events")
    for k in range(0, 60, 10):
        cast(spark, [rows[i] for i in order[k : k + 10]]).coalesce(1).write.mode("append").parquet(path)
    source = stateful.session(spark).readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)

    def run(build):
        for _ in range(2):
            q = build(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            q.awaitTermination()
            cast(spark, [end]).write.mode("append").parquet(path)
        return spark.read.parquet(str(tmp_path / "out")).collect()

    return rows, run, source


def test_tracker_over_unordered_batches(shuffled):
    rows, run, _ = shuffled
    got = sorted((r.agent_id, r.event_id, r.from_state, r.to_state) for r in run(lambda e: stateful.state_tracker(e, "300 days")))
    want, last = [], defaultdict(lambda: "S")
    for i, u, _, kind, _ in rows:
        now = panel.EVENT_STATES[kind]
        if now != last[u]:
            want.append((u, i, last[u], now))
            last[u] = now
    assert got == sorted(want)


def test_accumulator_over_unordered_batches(shuffled):
    rows, run, _ = shuffled
    got = sorted((r.agent_id, r.event_id, r.total) for r in run(lambda e: stateful.accumulator(e, 150.0, "300 days")))
    want, total = [], Counter()
    for i, u, _, _, v in rows:
        total[u] += v
        if total[u] >= 150:
            want.append((u, i, total[u]))
            total[u] = 0
    assert got == sorted(want)


def streamed(spark, tmp_path, batches, shape, build):
    """Output of a stream that gets ``batches`` one by one, run to its end after each."""
    path, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    none = cast(spark, batches[0], shape).limit(0)
    none.write.parquet(path)
    source = stateful.session(spark).readStream.schema(none.schema).parquet(path)
    for b in batches:
        cast(spark, b, shape).coalesce(1).write.mode("append").parquet(path)
        build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


def test_dormant_entities_are_forgotten(spark, tmp_path):
    """An entity without events for longer than the span starts anew; one with events in between keeps its state; what waits outlives the span."""
    shape = "event_id long, user_id long, ts string, event_type string, value double"
    day = lambda n, u, i, kind="error": (i, u, f"2024-{1 + n // 28:02d}-{1 + n % 28:02d} 00:00:00", kind, 60.0)
    batches = [[day(0, 1, 1), day(0, 2, 2)], [day(8, 2, 3)], [day(16, 2, 4)], [day(24, 1, 5), day(24, 2, 6)], [day(40, 9, 7)]]
    got = sorted((r.agent_id, r.event_id, r.from_state) for r in streamed(spark, tmp_path, batches, shape, lambda e: stateful.state_tracker(e, "1 day", "10 days")))
    assert got == [(1, 1, "S"), (1, 5, "S"), (2, 2, "S")]


def test_infections_count_once(spark, tmp_path):
    """Repeated links, later sources of one infected and links that come late or out of order."""
    shape = "source long, infected long, ts string"
    at = lambda n: f"2024-01-{n:02d} 00:00:00"
    batches = [[(1, 2, at(3)), (1, 2, at(3)), (5, 2, at(2))], [(5, 3, at(1)), (5, 2, at(4)), (1, 4, at(3))], [(5, 3, at(6)), (9, 9, at(30))]]
    first = streamed(spark, tmp_path / "a", batches, shape, lambda e: stateful.infection_sources(e, "20 days"))
    assert sorted((r.infected, r.source, r.ts.day) for r in first) == [(2, 5, 2), (3, 5, 1)] + [(4, 1, 3)]
    again = [[(r.infected, r.source, str(r.ts)) for r in first], [(3, 5, at(1)), (7, 5, at(9))]]
    tree = streamed(spark, tmp_path / "b", again, "infected long, source long, ts string", stateful.infection_tree)
    assert sorted((r.source, r.infected, r.n) for r in tree) == [(1, 4, 1), (5, 2, 2), (5, 3, 1), (5, 7, 3)]


def test_phases_over_unordered_batches(spark, tmp_path):
    """Two populations of one size, their days in any order, from events to phases in one stream; equal to the phases of whole tables."""
    rng = np.random.default_rng(6)
    size, rows, want = 40, [], {}
    for population in (1, 2):
        active = rng.integers(0, 14, 20)
        for day, n in enumerate(active):
            rows += [(population, f"2024-01-{day + 1:02d} 0{k % 9}:00:00", "I" if k < n else "S") for k in range(size)]
        h = spark.createDataFrame([(d, size - int(n), 0, int(n), 0, 0) for d, n in enumerate(active)], "day int, S long, E long, I long, R long, D long")
        want |= {(population, r.day): (r.active, r.phase) for r in panel.epidemic_phase(h).collect()}
    rng.shuffle(rows)
    rows = [(int(p), str(t), str(s)) for p, t, s in rows]
    batches = [rows[k::5] for k in range(5)] + [[(9, "2024-06-01 00:00:00", "S")], [(9, "2024-12-01 00:00:00", "S")]]
    got = streamed(spark, tmp_path, batches, "population long, ts string, state string", lambda e: stateful.phases_of_events(e, "30 days"))
    assert {(r.population, r.day.day - 1): (r.active, r.phase) for r in got if r.population < 9} == want


def test_daily_counts_over_unordered_batches(shuffled):
    rows, run, _ = shuffled
    got = Counter({(str(r.day), r.event_type): r.n for r in run(lambda e: daily.daily_counts(e, "100 days"))})
    assert got == Counter((t[:10], kind) for _, _, t, kind, _ in rows)


def test_history_comes_in_whole_versions(spark, shuffled, tmp_path, monkeypatch):
    rows, _, source = shuffled
    path = str(tmp_path / "history")
    counts = daily.daily_counts(source, "100 days")
    start = lambda: history.start_history_sink(counts, path, str(tmp_path / "history-log"), ["day", "event_type"]).awaitTermination()
    read = lambda: Counter({(str(r.day), r.event_type): r.n for r in history.read_history(spark, path, counts.schema).collect()})
    assert read() == Counter()
    start()
    want = Counter((t[:10], kind) for _, _, t, kind, _ in rows)
    assert read() == want
    cast(spark, [(500, 1, "2024-01-01 00:00:00", "view", 1.0)]).write.mode("append").parquet(str(tmp_path / "events"))
    held = set((tmp_path / "history").rglob("*.parquet"))

    # the files are written, the version is not: the old history stays and the batch runs again
    with monkeypatch.context() as m:
        m.setattr(history, "_commit", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            start()
    assert read() == want and set((tmp_path / "history").rglob("*.parquet")) > held
    start()
    want["2024-01-01", "view"] += 1
    assert read() == want

    # the version is there, the stream has not noted its batch: it comes again and changes nothing
    version = history._version(spark, path)
    for f in (tmp_path / "history-log" / "commits").iterdir():
        if f.name.strip(".").removesuffix(".crc") == str(max(version[1]["batches"].values())):
            f.unlink()
    start()
    assert history._version(spark, path) == version and read() == want

    # a second writer of one version fails; what no version names can go
    with pytest.raises(RuntimeError, match="another writer"):
        history._commit(spark, path, version[0], {})
    assert history.vacuum(spark, path) > 0 and read() == want
    # another stream with batches of the same numbers is taken in
    history.merge_batch(spark.createDataFrame([("2024-01-01", "view", 7)], "d string, event_type string, n long").select(F.to_date("d").alias("day"), "event_type", "n"), path, ["day", "event_type"], "day", "other", 0)
    want["2024-01-01", "view"] = 7
    assert read() == want


def test_a_part_that_can_not_be_read_fails_its_batch(spark, tmp_path):
    row = lambda n: spark.createDataFrame([(1, "a", n)], "day int, k string, n long")
    path = str(tmp_path / "history")
    history.merge_batch(row(1), path, ["day", "k"], "day", "s", 0)
    for f in (tmp_path / "history").rglob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        history.merge_batch(row(2), path, ["day", "k"], "day", "s", 1)
    assert history._version(spark, path)[0] == 1


@pytest.mark.parametrize("n", [1, 4])
def test_top_documents_against_all_pairs(spark, n):
    rng = np.random.default_rng(n)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    odds = 1 / np.arange(1, 61)
    draw = lambda k: " ".join(rng.choice(words, k, p=odds / odds.sum()))
    docs = [(i, draw(rng.integers(0, 60))) for i in range(120)]
    asked = [(i, draw(rng.integers(0, 8)) if i % 4 else docs[i][1]) for i in range(30)]
    counts = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for c in counts.values() for w in c)
    want = []
    for q, t in asked:
        score = {}
        for i, c in counts.items():
            hit = [w for w in set(t.split()) if w in c]
            if hit:
                score[i] = round(sum((1 + math.log(c[w])) * math.log(121 / (df[w] + 1)) for w in hit), 6)
        want += [(q, i, s, r) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:n], 1)]
    got = retrieval.top_k_documents(spark.createDataFrame(asked, "q int, text string"), spark.createDataFrame(docs, "d int, text string"), n, "q", "d")
    assert sorted((r["query"], r.doc, round(r.score, 5), r["rank"]) for r in got.collect()) == sorted((q, i, round(s, 5), r) for q, i, s, r in want)


def test_top_documents_are_dealt_by_document(spark, monkeypatch):
    """Tasks are as many as the counted pairs need, and no pair is taken apart into the terms of its query."""
    monkeypatch.setattr(retrieval, "TASK_ROWS", 40)
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else f"alpha word{'abcdefghij'[i % 10]}") for i in range(100)], "d int, text string")
    asked = spark.createDataFrame([(0, "alpha beta"), (1, "wordc alpha"), (2, "none")], "q int, text string")
    told = retrieval.top_k_documents(asked, docs, 2, "q", "d")
    assert [(r["query"], r.doc, r["rank"]) for r in told.orderBy("query", "rank").collect()] == [(0, 1, 1), (0, 3, 2), (1, 2, 1), (1, 12, 2)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc" in plan and "(doc" in plan
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("doc" in line and "term" in line for line in joins)
    parts = max(int(x) for x in re.findall(r"RepartitionByExpression \[doc#\d+\w*\], (\d+)", plan))
    assert parts > 3


def test_waiting_events_are_packed(monkeypatch):
    """Waiting events take an entry of the list state for each pack, not for each event."""
    monkeypatch.setattr(stateful, "PACK", 3)
    rows = [(k, None if k == 2 else k, "view", None) for k in range(7)]
    packs = stateful._packed(rows)
    assert len(packs) == 3 and [r for (p,) in packs for r in stateful.pickle.loads(p)] == rows
    assert stateful._plain(stateful.pd.Series([1.0, None])) == [1.0, None] and stateful._plain(stateful.pd.Series(["a", None], dtype=object)) == ["a", None]


def test_bucket_of_one_block_is_sent_once():
    """Rows that are held and compared at once give each near pair once, also over several batches."""
    import numpy as np
    import pyarrow as pa

    vectors = {5: [1.0, 0.0], 2: [1.0, 0.1], 9: [0.0, 1.0], 1: [1.0, 0.0]}
    batch = lambda ids: pa.RecordBatch.from_pydict({"t": [0] * len(ids), "key": [7] * len(ids), "wide": [4] * len(ids), "at": [0] * len(ids), "side": [2] * len(ids), "id": ids, "half": [np.array(vectors[i], np.float16).tobytes() for i in ids]})
    for parts in ([[5, 2, 9, 1]], [[5, 2], [9, 1]], [[5], [2], [9], [1]]):
        got = [tuple(r.values()) for b in retrieval._meetings(0.9)(iter([batch(p) for p in parts])) for r in b.to_pylist()]
        assert sorted(got) == [(1, 2), (1, 5), (2, 5)]
