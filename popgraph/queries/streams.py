"""Queries of streams, sources, sinks and extensions (A, K, L), each run to its end over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from popgraph.functions import extend
from popgraph.operators import panel as P
from popgraph.plans.stage import new_path
from popgraph.operators.text import page_sections
from popgraph.queries.base import agents, edges, query, read, states
from popgraph.queries.entities import _SECTIONS, marked_pages
from popgraph.queries.panels import _TR
from popgraph.sources import sinks, tables
from popgraph.streaming import daily, history, stateful


def page_sections_of(html):
    return page_sections(html or "")


def stream(s, d, table="events"):
    schema = read(s, d, table).schema
    # a pattern, since a table is one file or a folder of files
    df = s.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{d}/{table}.parque[t]")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def finished(df, out=None, log=None):
    """All that a stream in append mode has to say, as a table."""
    out, log = out or new_path(df.sparkSession, "stream"), log or new_path(df.sparkSession, "stream-log")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def span(s, d):
    """(delay, end): a delay that no event of the table exceeds, whatever the order of its files, and a time after all of them."""
    first, last = read(s, d, "events").agg(F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))).first()
    days = (last - first).days + 1 if first else 1
    return f"{days} days", F.lit(last or "2024-01-01").cast("timestamp") + F.make_interval(days=F.lit(days + 30))


def closed(s, rows, ts, end, build, keys=(), files=16):
    """What the stream ``build`` makes of ``rows`` in append mode, with a row after all others that lets the watermark pass them.

    The closing row, at time ``end`` and with -1 in ``keys``, can't be put among the given
    files, so the rows are written anew, run ``files`` a batch, and run on from the same
    checkpoint when it has been added.
    """
    path, out, log = (new_path(s, x) for x in ("events", "stream", "stream-log"))
    rows.write.parquet(path)
    own = stateful.session(s)
    source = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    finished(build(source), out, log)
    value = lambda f: end if f.name == ts else F.lit(-1) if f.name in keys else F.lit(None)
    s.range(1).select(*[value(f).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(path)
    told = finished(build(source), out, log)
    return s.read.schema(told.schema).parquet(out)


def closed_events(s, d, build):
    delay, end = span(s, d)
    events = read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return closed(s, events, "ts", end, lambda e: build(e, delay), ("user_id", "event_id"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def k1_daily_counts(s, d):
    return closed_events(s, d, daily.daily_counts)


@query("SELECT CAST(CAST(ts AS DATE) + CAST(k AS INTEGER) AS DATE) AS until, event_type, count(*) AS n FROM events, range(1, 8) t(k) GROUP BY ALL")
def k2_lookback_counts(s, d):
    return closed_events(s, d, daily.lookback_counts)


@query("SELECT DISTINCT event_id, user_id FROM events")
def k3_dedupe(s, d):
    twice = stream(s, d)
    return finished(daily.dedupe(twice.unionByName(twice), ["event_id"], span(s, d)[0]).select("event_id", "user_id"))


@query(", o AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'S' WHEN 'click' THEN 'E' WHEN 'error' THEN 'I' WHEN 'purchase' THEN 'R' WHEN 'signup' THEN 'D' END AS st FROM events), l AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'S') AS f FROM o) SELECT user_id AS agent_id, event_id, f AS from_state, st AS to_state FROM l WHERE f <> st")
def k4_state_tracker(s, d):
    return closed_events(s, d, stateful.state_tracker).select("agent_id", "event_id", "from_state", "to_state")


@query(", ha AS (SELECT day, E + I AS active, S + E + I + R + D AS n, lag(E + I, 2) OVER (ORDER BY day) AS b FROM hist) SELECT day, active, CASE WHEN b IS NULL OR active / n < 0.01 THEN 'PRE_EPIDEMIC' WHEN active / n < 0.05 THEN CASE WHEN active > b * 1.5 THEN 'EXPONENTIAL_GROWTH' ELSE 'PRE_EPIDEMIC' END WHEN active / n < 0.2 THEN CASE WHEN active > b * 1.2 THEN 'EXPONENTIAL_GROWTH' WHEN active < b * 0.8 THEN 'DECLINE' ELSE 'PEAK' END WHEN active / n < 0.4 THEN CASE WHEN active > b * 1.1 THEN 'PEAK' ELSE 'DECLINE' END ELSE 'DECLINE' END AS phase FROM ha")
def k5_phase_tracker(s, d):
    h = P.state_counts(states(s, d), ["day"])
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("timestamp")
    size = F.col("S") + F.col("E") + F.col("I") + F.col("R") + F.col("D")
    rows = h.select(F.lit(1).cast("long").alias("population"), size.alias("size"), day.alias("day"), (F.col("E") + F.col("I")).alias("active"))
    # files of days in no order, one a batch
    told = closed(s, rows.repartition(6, F.xxhash64("day")), "day", F.lit("2034-01-01"), lambda x: stateful.phase_tracker(x, "3000 days"), ("population",), 1)
    return told.select(F.datediff("day", F.lit("2024-01-01").cast("date")).alias("day"), "active", "phase")


@query(""", it AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
acc AS (SELECT user_id, list_reduce(list_prepend({'s': 0.0::DOUBLE, 'i': 0::BIGINT, 'out': []::STRUCT(n BIGINT, total DOUBLE)[]}, list({'s': value, 'i': event_id, 'out': []::STRUCT(n BIGINT, total DOUBLE)[]} ORDER BY i)),
  lambda a, x: {'s': CASE WHEN a.s + x.s >= 150 THEN 0.0 ELSE a.s + x.s END, 'i': x.i, 'out': CASE WHEN a.s + x.s >= 150 THEN list_append(a.out, {'n': x.i, 'total': a.s + x.s}) ELSE a.out END}) AS r FROM it GROUP BY user_id)
SELECT user_id AS agent_id, u.n AS event_id, round(u.total, 6) AS total FROM (SELECT user_id, unnest(r.out) AS u FROM acc)""")
def k6_accumulator(s, d):
    return closed_events(s, d, lambda e, delay: stateful.accumulator(e, 150.0, delay)).withColumn("total", F.round("total", 6))


@query(""", lk AS (SELECT o_custkey AS source, o_orderkey % 1000 AS infected, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders),
fi AS (SELECT infected, source, ts FROM lk QUALIFY row_number() OVER (PARTITION BY infected ORDER BY ts, source) = 1)
SELECT source, infected, row_number() OVER (PARTITION BY source ORDER BY ts, infected) AS n FROM fi""")
def k7_secondary(s, d):
    o = read(s, d, "orders")
    links = o.select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 1000).alias("infected"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    first = closed(s, links, "ts", F.lit("2034-01-01"), lambda x: stateful.infection_sources(x, "9000 days"), ("source", "infected"), 4)
    path = new_path(s, "sources")
    first.write.parquet(path)
    tree = stateful.infection_tree(stateful.session(s).readStream.schema(first.schema).parquet(path))
    return finished(tree).select("source", "infected", "n")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def k8_history_sink(s, d):
    out, counts = new_path(s, "history"), daily.daily_counts(stream(s, d), span(s, d)[0])
    history.start_history_sink(counts, out, new_path(s, "history-log"), ["day", "event_type"]).awaitTermination()
    return history.read_history(s, out, counts.schema)


@query(_TR + " SELECT agent_id, day, from_state, to_state FROM tr")
def a7_write_logs(s, d):
    path = new_path(s, "logs")
    sinks.write_logs(P.transitions(states(s, d)), path)
    return s.read.schema("agent_id long, from_state string, to_state string, day int").json(f"{path}/transitions").select("agent_id", "day", "from_state", "to_state")


@query(_TR + " SELECT day, from_state, to_state, count(*) AS n FROM tr GROUP BY ALL")
def a7_daily_summary(s, d):
    path = new_path(s, "logs")
    sinks.write_logs(P.transitions(states(s, d)), path)
    return s.read.schema("from_state string, to_state string, n long, day int").json(f"{path}/daily").select("day", "from_state", "to_state", "n")


def results(s, d):
    path = new_path(s, "results")
    sinks.write_results({"edges": edges(s, d), "history": P.state_counts(states(s, d), ["day"])}, path)
    return path


@query("SELECT agent_1, agent_2, edge_type, contact_rate FROM edges")
def a6_write_results(s, d):
    return s.read.parquet(f"{results(s, d)}/edges")


@query("SELECT day, S, E, I, R, D FROM hist")
def a6_written_history(s, d):
    return s.read.parquet(f"{results(s, d)}/history").select("day", "S", "E", "I", "R", "D")


@query("SELECT agent_1, agent_2, edge_type, contact_rate FROM edges")
def a2_read_edges(s, d):
    path = new_path(s, "edges-json")
    edges(s, d).write.json(path)
    return tables.read_edges(s, path, multi_line=False)


@query("SELECT * FROM hist")
def a8_merge_history(s, d):
    h = P.state_counts(states(s, d), ["day"])
    return sinks.merge_history(h.where("day < 20").withColumn("S", F.lit(0).cast("long")), h.where("day >= 0"), ["day"])


@query("SELECT agent_id, max(day) AS day, arg_max(state, day) AS state FROM panel GROUP BY agent_id")
def a8_latest_snapshot(s, d):
    p = states(s, d).withColumn("o", F.col("day"))
    return sinks.latest_snapshot(p, ["agent_id"], "o").select("agent_id", "day", "state")


@query("SELECT agent_id, cluster_id FROM agents")
def a5_normalize_assignments(s, d):
    a = agents(s, d).groupBy("cluster_id").agg(F.collect_list("agent_id").alias("m"))
    return tables.normalize_assignments(a.select(F.create_map(F.col("cluster_id").cast("string"), "m").alias("assignments")))


@query("SELECT vec_id, label, len(embedding) AS size FROM embeddings")
def a4_read_embeddings(s, d):
    return tables.read_embeddings(s, f"{d}/embeddings.parquet", 64).select("vec_id", "label", F.size("embedding").alias("size"))


@query("""SELECT o_orderkey AS "case", CAST(o_orderdate AS DATE) AS date, (o_orderkey % 90)::DOUBLE AS age, CASE WHEN o_orderstatus = 'F' THEN 'I' ELSE 'S' END AS day_0 FROM orders WHERE o_orderkey % 7 <> 0""")
def a1_read_cases(s, d):
    o, path = read(s, d, "orders"), new_path(s, "cases")
    date = F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.select(F.col("o_orderkey").alias(" Case"), date.alias("DATE "), (F.col("o_orderkey") % 90).alias("Age"), F.when(F.col("o_orderstatus") == "F", " i ").otherwise("X").alias("day_0"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_cases(s, path).select("case", "date", "age", "day_0")


def nested_traces(s, d):
    """Conversations as nested JSON, written and read with the schema of traces."""
    c = read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))
    talk = F.transform("t", lambda x: F.struct(x["turn"].cast("int").alias("timestep"), x["role"].alias("state"), F.lit("").alias("transition"), x["text"].alias("response"), F.array(x["role"], F.lit("ask")).alias("tools_used")))
    motifs = F.create_map(F.lit("turns"), F.size("t").cast("string"), F.lit("first"), F.col("t")[0]["role"])
    one = F.struct(F.col("conv_id").alias("agent_id"), F.lit(1).alias("age"), F.lit("").alias("occupation"), talk.alias("conversations"), motifs.alias("behavioral_motifs"))
    nested = c.select(F.array(F.struct(F.col("conv_id").cast("string").alias("scenario_id"), F.lit("").alias("scenario_name"), F.array(one).alias("traces"))).alias("scenarios"))
    path = new_path(s, "traces")
    nested.write.json(path)
    return s.read.schema(tables.TRACES).json(path)


@query("SELECT CAST(conv_id AS VARCHAR) AS scenario_id, conv_id AS agent_id, CAST(turn AS INTEGER) AS timestep, unnest([role, 'ask']) AS tool FROM conversations")
def a3_tool_calls(s, d):
    return tables.flatten_traces(nested_traces(s, d))[1]


@query(""", cv AS (SELECT conv_id, count(*) AS n, arg_min(role, (turn, text, role)) AS first FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS scenario_id, conv_id AS agent_id, axis, CASE axis WHEN 'turns' THEN CAST(n AS VARCHAR) ELSE first END AS motif FROM cv, (VALUES ('turns'), ('first')) v(axis)""")
def a3_motifs(s, d):
    return tables.flatten_traces(nested_traces(s, d))[2]


@query("SELECT CAST(conv_id AS VARCHAR) AS scenario_id, conv_id AS agent_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS turn, text AS response FROM conversations")
def a3_flatten_traces(s, d):
    return tables.flatten_traces(nested_traces(s, d))[0].select("scenario_id", "agent_id", "turn", "response")


@query("SELECT o_orderkey AS id, CAST(u AS BIGINT) AS part FROM (SELECT o_orderkey, unnest(range(o_orderkey % 4)) AS u FROM orders)")
def l1_explode_with(s, d):
    return extend.explode_with(read(s, d, "orders").select("o_orderkey"), lambda r: [(r["o_orderkey"], k) for k in range(r["o_orderkey"] % 4)], "id long, part long")


@query(_SECTIONS + " SELECT page_id, section, heading, content FROM sec")
def l1_sections_in_sql(s, d):
    extend.register_rows(s, "page_sections", page_sections_of, "section string, heading string, content string")
    return s.sql("SELECT p.page_id, t.* FROM {pages} p, LATERAL page_sections(p.html) t", pages=marked_pages(s, d))


@query("SELECT doc_id, m[1] AS word, TRY_CAST(m[2] AS BIGINT) AS number FROM (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '([a-z]+) ([0-9]+)', 1), regexp_extract_all(text, '([a-z]+) ([0-9]+)', 2))) AS m FROM documents)")
def l1_pattern_rows(s, d):
    extend.register_pattern_rows(s)
    return s.sql("SELECT d.doc_id, t.* FROM {docs} d, LATERAL pattern_rows(d.text, '([a-z]+) ([0-9]+)', 'word string, number long') t", docs=read(s, d, "documents"))


@query("SELECT label, round(avg(sqrt(list_dot_product([x::DOUBLE FOR x IN embedding], [x::DOUBLE FOR x IN embedding]))), 6) AS metric FROM embeddings GROUP BY label")
def l2_grouped_metric(s, d):
    """Mean norm of the vectors of a label, from sums and counts."""

    def fold(state, rows):
        norms = np.linalg.norm(np.stack(rows["embedding"].to_numpy()).astype(float), axis=1)
        return [(state[0] if state is not None else 0.0) + float(norms.sum()), (state[1] if state is not None else 0.0) + len(norms)]

    e = read(s, d, "embeddings").select("label", "embedding")
    m = extend.aggregate_with(e, ["label"], "array<double>", fold, lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda t: t[0] / t[1])
    return m.withColumn("metric", F.round("metric", 6))
