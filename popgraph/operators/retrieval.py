"""Top-k retrieval: similar pairs, documents for queries, memories of an entity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.plans.stage import counted_broadcast, stage


#: What a query built from context asks about, by state, age and work.
CONTEXT = {
    "S": "prevention transmission exposure risk",
    "E": "incubation testing quarantine",
    "I": "symptoms isolation treatment recovery",
    "R": "immunity reinfection vaccination",
    "D": "",
}
CONTEXT_ELDERLY = "elderly vulnerable severe"
CONTEXT_CARE = "healthcare protective equipment"


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def recent_context(df: DataFrame, key: str, order: list[str], text: str, n: int, sep: str = " | ") -> DataFrame:
    """The last ``n`` texts per key, newest first, joined."""
    top = top_per_group(df, [key], [F.desc(c) for c in order], n)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("_t"))))
    return top.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), sep).alias("context"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: What a cosine of unit vectors in half precision can be off by, amply.
HALF_ERROR = 0.002


def _buckets(tables: int, bits: int, seed: int):
    """Of each vector its keys, one a table, and its unit vector in half precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                keys, halves = [], []
                for x in part.column(1).to_pylist():
                    v = np.asarray(x)
                    v = v / np.abs(v).max()  # so that no square is out of range
                    if len(v) not in planes:
                        planes[len(v)] = np.random.default_rng([seed, len(v)]).normal(size=(len(v), tables * bits))
                    keys.append(((v @ planes[len(v)] > 0).reshape(tables, bits) @ weights).tolist())
                    halves.append((v / np.linalg.norm(v)).astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(halves, pa.binary())], ["id", "keys", "half"])

    return run


def _meetings(least: float):
    """Rows sorted by bucket, block and side to pairs a < b whose half-precision cosine is over ``least``.

    The block (side 0) is held, the whole bucket (side 1) streams past it. Rows of side 2
    are both: a bucket that is one block is sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, block = None, [], [], None
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                places = list(zip(*(c.to_pylist() for c in b.columns[:4]), strict=True))
                sides, own, halves = (b.column(c).to_pylist() for c in ("side", "id", "half"))
                k = 0
                while k < len(places):
                    end = k
                    while end < len(places) and places[end] == places[k] and sides[end] == sides[k]:
                        end += 1
                    if places[k] != now:
                        now, ids, held, block = places[k], [], [], None
                    vectors = [np.frombuffer(h, np.float16) for h in halves[k:end]]
                    if sides[k] != 1:
                        ids += own[k:end]
                        held += vectors
                        block = None
                    if sides[k] != 0 and held:
                        if block is None:
                            block, left = np.stack(held).astype(np.float32), np.array(ids)
                        near = np.stack(vectors).astype(np.float32) @ block.T > least
                        right = np.array(own[k:end])
                        # of two rows of side 2, the one that came first is held when the other comes; of those that come together each sees the other
                        both = np.arange(len(left))[None, :] < (len(left) - len(right) if sides[k] == 2 else 0)
                        y, x = np.nonzero(near & ((left[None, :] < right[:, None]) | both & (left[None, :] > right[:, None])))
                        if len(x):
                            a, b = left[x], right[y]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                    k = end

    return run


def similar_pairs(
    emb: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "embedding", flags: tuple = (), k: int | None = None, miss: float = 1e-5, block: int = 2000, seed: int = 3
) -> DataFrame:
    """(a, b, cosine, same_<flag>...) of pairs with cosine above ``threshold``, a < b; the ``k`` most similar ones if given.

    Rows meet in buckets of random half-spaces; their bits grow with the table, and as
    many bucketings are made as leave a pair at the threshold out with a chance of at
    most ``miss``. Cosines are looked at inside the buckets, on unit vectors in half
    precision, and only pairs that may be above the threshold leave them, to be checked
    exactly. A bucket of more than ``block`` rows is compared in blocks, in full; only those
    are counted out beforehand, and rows of the others are sent once. Null,
    zero and non-finite vectors take no part; rows that repeat an id meet by their
    smallest vector; vectors of unlike length are no pairs. Ids are integers.
    """
    doubles = F.col(vec).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = emb.select(F.col(id_col).cast("long").alias("id"), doubles.alias("x"), *flags).where("id is not null and size(x) > 0")
    rows = rows.where(~F.exists("x", bad) & F.exists("x", lambda x: x != 0))
    rows = stage(rows.groupBy("id").agg(F.min(F.struct("x", *flags)).alias("r")).select("id", "r.*"), "pairs-rows")
    n = rows.count()
    bits = min(max(math.ceil(math.log2(max(n / 100, 2))), 4), 40)
    meet = (1 - math.acos(max(min(threshold, 1.0), -1.0)) / math.pi) ** bits
    tables = max(math.ceil(math.log(miss) / math.log1p(-meet)), 1) if meet < 1 else 1
    keyed = rows.select("id", "x").mapInArrow(_buckets(tables, bits, seed), "id long, keys array<long>, half binary").select("id", "half", F.octet_length("half").alias("wide"), F.posexplode("keys").alias("t", "key"))
    bucket = ["t", "key", "wide"]
    size = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > block).select(*bucket, F.ceil(F.col("_c") / block).cast("int").alias("_n"))
    sized = keyed.join(counted_broadcast(size, label="pairs-crowded"), bucket, "left")
    own = F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")
    place = lambda at, side: F.struct(at.alias("at"), F.lit(side).alias("side"))
    crowded = F.concat(F.array(place(own, 0)), F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: place(k, 1)))
    places = F.when(F.col("_n").isNull(), F.array(place(F.lit(0), 2))).otherwise(crowded)
    dealt = sized.select(*bucket, F.explode(places).alias("p"), "id", "half").select(*bucket, "p.at", "p.side", "id", "half").repartition(*bucket, "at").sortWithinPartitions(*bucket, "at", "side")
    met = dealt.mapInArrow(_meetings(threshold - HALF_ERROR), "a long, b long").distinct()
    side = lambda name: rows.select(F.col("id").alias(name), F.col("x").alias(f"_{name}"), *[F.col(f).alias(f"_{f}_{name}") for f in flags])
    pairs = met.join(side("a"), "a").join(side("b"), "b")
    same = [F.coalesce(F.col(f"_{f}_a") == F.col(f"_{f}_b"), F.lit(False)).alias(f"same_{f}") for f in flags]
    found = pairs.select("a", "b", cosine("_a", "_b").alias("cosine"), *same).where(F.col("cosine") > threshold)
    return found if k is None else found.orderBy(F.desc(F.round("cosine", 9)), "a", "b").limit(k)


def tokens(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda t: F.length(t) > 3)


#: Terms of documents and pairs of documents and queries that a task is dealt, about.
TASK_ROWS = 2**18


def top_k_documents(queries: DataFrame, docs: DataFrame, n: int, query_id: str, doc_id: str, text: str = "text") -> DataFrame:
    """(query, doc, score, rank): TF-IDF overlap through an inverted index of the queries' terms.

    The best documents of each single term are scored in full, which gives a score that the
    n-th result surely has.
    Terms whose largest weights together stay below it can't bring a document in: only
    documents with some other term are met, so that frequent terms don't pair every query
    with every document, and only to those that can still reach it the other terms are added.
    Documents without a term of the query are no results.
    """
    qt = stage(queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens(text))).alias("term")), "retrieval-queries")
    dt = docs.select(F.col(doc_id).alias("doc"), F.explode(tokens(text)).alias("term"))
    dt = stage(dt.join(qt.select("term").distinct(), "term", "left_semi").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")), "retrieval-terms")
    total = docs.agg(F.count(F.lit(1)).alias("_n"))
    df = stage(dt.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "retrieval-frequencies")
    idf = df.crossJoin(F.broadcast(total)).select("term", F.log((F.col("_n") + 1) / (F.col("df") + 1)).alias("idf"))
    weighed = stage(dt.join(idf, "term").select("doc", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")), "retrieval-weights")
    heads = stage(top_per_group(weighed, ["term"], [F.desc("w"), "doc"], n), "retrieval-heads")
    full = lambda pairs: pairs.join(qt, "query").join(weighed, ["doc", "term"]).groupBy("query", "doc")
    known = full(qt.join(heads, "term").select("query", "doc").distinct()).agg(F.sum("w").alias("_s"))
    floor = top_per_group(known, ["query"], [F.desc("_s"), "doc"], n).where(F.col("rank") == n).select("query", F.col("_s").alias("_floor"))
    bound = qt.join(heads.where("rank = 1").select("term", F.col("w").alias("_most")), "term").join(floor, "query", "left")
    together = F.sum("_most").over(W.partitionBy("query").orderBy("_most", "term").rowsBetween(W.unboundedPreceding, 0))
    bound = stage(bound.withColumn("_in", F.coalesce("_floor", F.lit(0.0)) - 1e-5).withColumn("_needed", together >= F.col("_in")), "retrieval-bounds")
    # all that a document takes part in meets in one task; the pairs are counted first, since equal rows shrink so far in a shuffle that its bytes tell little
    needed = bound.where("_needed").select("query", "term")
    asked = needed.groupBy("term").agg(F.count(F.lit(1)).alias("_k"))
    held = df.agg(F.sum("df")).first()[0] or 0
    pairs = df.join(asked, "term").agg(F.sum(F.col("df") * F.col("_k"))).first()[0] or 0
    dealt = weighed.repartition(max(math.ceil((held + pairs) / TASK_ROWS), 1), "doc")
    part = dealt.join(needed, "term").groupBy("doc", "query").agg(F.sum("w").alias("_part"))
    less = F.when(~F.col("_needed"), F.struct("term", "_most"))
    rest = bound.groupBy("query").agg(F.first("_in").alias("_in"), F.collect_list(less["term"]).alias("_others"), F.sum(F.coalesce(less["_most"], F.lit(0.0))).alias("_rest"))
    met = part.join(rest, "query").where("_part + _rest >= _in")
    terms = dealt.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("_w"))
    more = F.aggregate(F.array_intersect("_others", F.map_keys("_w")), F.lit(0.0), lambda s, t: s + F.col("_w")[t])
    score = met.join(terms, "doc").select("query", "doc", F.round(F.col("_part") + more, 6).alias("score"))
    return top_per_group(score, ["query"], [F.desc("score"), "doc"], n)


def context_query(age: Column, occupation: Column, state: Column, decision: Column) -> Column:
    """A query text from an entity's context: decision, state and, by age and work, who is at risk."""
    about = F.create_map(*[F.lit(x) for kv in CONTEXT.items() for x in kv])[state]
    who = F.concat_ws(" ", about, F.when(age >= 60, CONTEXT_ELDERLY), F.when(occupation == "healthcare_worker", CONTEXT_CARE), F.translate(occupation, "_", " "))
    return F.concat_ws(" ", F.translate(decision, "_", " "), who)


def context_documents(entities: DataFrame, docs: DataFrame, n: int, entity_id: str, doc_id: str, text: str = "text") -> DataFrame:
    """(query, doc, score, rank) as ``top_k_documents`` gives them; entities with one query text are asked for once."""
    asked = stage(entities.select(F.col(entity_id).alias("_e"), F.col(text).alias("_q")), "context-queries")
    kinds = asked.select(F.col("_q").alias(text)).distinct().withColumn("_id", F.xxhash64(text))
    found = stage(top_k_documents(kinds, docs, n, "_id", doc_id, text), "context-found")
    return asked.withColumn("_id", F.xxhash64("_q")).join(found.withColumnRenamed("query", "_id"), "_id").select(F.col("_e").alias("query"), "doc", "score", "rank")


def retrieve_memories(memories: DataFrame, now: Column, n: int, query: Column | None = None) -> DataFrame:
    """Top ``n`` per entity by 0.995^hours + importance / 10 + relevance.

    Relevance is the cosine of the memory's ``embedding`` and ``query``, a vector of each
    row, zero where one is null or zero; without ``query`` it is the column ``relevance``.
    """
    hours = (F.unix_timestamp(now) - F.unix_timestamp("timestamp")) / 3600
    relevance = F.col("relevance") if query is None else F.when(F.exists("embedding", lambda x: x != 0) & F.exists(query, lambda x: x != 0), cosine("embedding", query))
    score = F.pow(F.lit(0.995), hours) + F.col("importance") / 10 + F.coalesce(relevance, F.lit(0.0))
    return top_per_group(memories.withColumn("score", F.round(score, 6)), ["agent_id"], [F.desc("score"), "node_id"], n)


def incremental_map(keys: DataFrame, cache: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, value) for all keys: cached ones as they are, the others computed once per distinct key."""
    new = keys.select(key).distinct().join(cache.select(key), key, "left_anti").select(key, value.alias("value"))
    return cache.select(key, "value").unionByName(new)
