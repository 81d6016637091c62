"""Mixing sources to target weights by Sainte-Laguë apportionment.

DataFrame functions only. Documents of a source are dealt to shards and laid end to
end in a seeded order; a shard is cut into blocks of equal tokens. Blocks are seats:
first the sources and then the shards of each source get theirs by the highest
quotients votes / (2k - 1). The quota of a shard says how many of its blocks the mix
takes; whole rounds take every block, and a seeded systematic draw takes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.llm.common import WORD
from popgraph.plans.ranks import global_rank
from popgraph.plans.stage import small_enough, stage

BLOCK = 64
SHARD_WORDS = 1 << 17
SHARD_DOCS = 256
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Sources that are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Shards that are broadcast; more are joined by a shuffle to the tasks that lay them out.
BROADCAST_SHARDS = 200_000


def apportion(parties: DataFrame, within: list[str], party: list[str], votes: str, seats: str, out: str, order: list | None = None) -> DataFrame:
    """``parties`` with ``out``: integer seats by highest quotients votes / (2k - 1).

    ``within``: columns of one allocation (none: all rows are one); ``seats``: its column
    with the seats to give; ``party``: the key of a party; ``order``: among equal quotients
    (the key, unless given). Keys must not be null. Rounding at a divisor that surely
    gives too few seats and at one that surely gives enough leaves about two open
    quotients per party, and only those are ranked, in ranges, so that no allocation is
    one task's work. Parties without votes get none. An empty table gives an empty result.
    """
    p = parties.withColumn("_v", F.coalesce(F.col(votes).cast("double"), F.lit(0.0)))
    keyed = lambda df, side: df.join(side, within) if within else df.crossJoin(F.broadcast(side))  # noqa: E731  one row for all
    p = keyed(p, p.groupBy(*within).agg(F.sum("_v").alias("_sum"), F.count(F.lit(1)).alias("_n")))
    few, enough = F.col(seats) - F.col("_n") / 2 - 1, F.col(seats) + F.col("_n") / 2 + 1
    at = lambda m: F.floor(F.col("_v") * m / F.col("_sum") + 0.5)
    some = (F.col("_sum") > 0) & (F.col(seats) > 0)
    p = p.withColumn("_low", F.when(some & (few > 0), at(few)).otherwise(0).cast("long"))
    p = p.withColumn("_high", F.when(some & (F.col("_v") > 0), F.greatest(at(enough), "_low")).otherwise(F.col("_low")).cast("long"))
    p = stage(p.drop("_sum", "_n"), "mix-parties")
    given = p.groupBy(*within).agg((F.first(seats) - F.sum("_low")).alias("_open"))
    tries = p.where("_high > _low").withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    tries = tries.withColumn("_q", F.col("_v") / (2 * F.col("_k") - 1))
    ranked = global_rank(tries, [*within, F.desc("_q"), *(order or party), "_k"], "_at")
    ranked = keyed(keyed(ranked, ranked.groupBy(*within).agg(F.min("_at").alias("_first"))), given)
    won = ranked.where("_at - _first < _open").groupBy(*within, *party).agg(F.count(F.lit(1)).alias("_won"))
    joined = p.join(won, [*within, *party], "left").withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0)))
    return joined.drop("_v", "_low", "_high", "_won")


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``, in double precision.

    Sources by code point, null last, weigh ``weights`` in turn. A target is the
    weight times one common level, or ``most`` times the size where that is less; the
    level rises as sources fill up, until no more do. ``source_no`` counts the sources from 1.
    """
    w = global_rank(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_i").drop("_null")
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("_i", F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("_cap", F.col("source_size") * most).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    w = stage(w.withColumn("source_no", F.col("_i") + 1).drop("_i"), "mix-weights")
    full, filled, level = F.lit(False), -1, None
    while True:
        total = (F.sum("source_size") * F.lit(share) - F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0))) / F.sum(F.when(~full, F.col("_w")))
        now, level = w.agg(F.count_if(full), F.try_divide(total, F.lit(1.0))).first()  # one row
        if now == filled or level is None:
            break
        filled, full = now, F.col("_ratio") <= F.lit(level)
    own = F.col("_cap").cast("double")
    target = own if level is None else F.when(F.col("_ratio") <= F.lit(level), own).otherwise(F.col("_w") * F.lit(level))
    return w.withColumn("target", target).drop("_w", "_cap", "_ratio")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: bool = False,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the draw's columns, per row.

    ``keep``: carry the row of ``docs`` as a struct ``row``. ``taken`` is the words that
    the mix takes of the document, repeats counted: ``rounds`` times the whole and the
    words of the drawn blocks (see ``drawn``). A null text has no words; a null source is
    a source; rows that repeat one id are rows of their own, in the order of size and,
    with ``keep``, of the row's hash. A source without words has target zero. An empty
    table gives an empty result. Columns but the three named ones are not looked at.
    """
    text = F.col(text_col).cast("string")
    cols = [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ]
    order = ["_md5", "size"]
    if keep:
        hashable = [docs[f"`{name}`"] for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        cols += [F.struct("*").alias("row"), F.xxhash64(*hashable).alias("_tie")]
        order.append("_tie")
    d = docs.select(*cols)
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("_md5", hashed).withColumn("_draw", F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long"))

    # sources and shards are planned on narrow rows; a row that is kept moves once, to its shard
    sizes = stage(d.select("source", "size", "_draw") if keep else d, "mix-sizes")
    if not keep:
        d = sizes
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    sources = source_targets(sources).withColumn(
        "_shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_docs") / shard_docs)).cast("long")
    )
    s = stage(sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target", "_shards"), "mix-sources")
    if small_enough(s, BROADCAST_SOURCES):
        s = F.broadcast(s)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(s, rows["source"].eqNullSafe(s["_s"])).drop("_s").withColumn("_shard", F.pmod("_draw", "_shards"))

    shards = dealt(sizes).groupBy("source_no", "_shard").agg(
        F.first("source").alias("source"), F.sum("size").alias("_words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    shards = shards.withColumn(
        "_blocks", F.when(F.col("_words") > 0, F.greatest(F.lit(1), F.floor(F.col("_words") / block + 0.5))).otherwise(0).cast("long")
    )
    shards = stage(shards, "mix-shards")
    of_source = shards.groupBy("source_no").agg(
        F.sum("_blocks").alias("_all"), F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("_all") / F.col("source_size")).otherwise(0.0)
    of_source = stage(of_source.withColumn("_votes", votes), "mix-votes")
    seats = of_source.agg(F.floor(F.coalesce(F.sum("_votes"), F.lit(0.0)) + 0.5).cast("long").alias("_seats"))
    of_source = of_source.crossJoin(F.broadcast(seats))  # one row
    of_source = apportion(of_source, [], ["source_no"], "_votes", "_seats", "_quota", order=["source"])
    of_source = of_source.select("source_no", F.least(F.col("_quota"), MOST * F.col("_all")).alias("_quota"))
    shards = apportion(shards.join(of_source, "source_no"), ["source_no"], ["_shard"], "_blocks", "_quota", "_take")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")), F.col("_shard").cast("string"))), 1, 8), 16, 10)
    shards = shards.select(
        "source_no", "_shard", F.col("_words").alias("words"), F.col("_blocks").alias("blocks"),
        F.when(F.col("_blocks") > 0, F.floor(F.col("_take") / F.col("_blocks"))).otherwise(0).cast("long").alias("rounds"),
        F.when(F.col("_blocks") > 0, F.pmod("_take", "_blocks")).otherwise(F.lit(0)).cast("long").alias("rest"),
        F.when(F.col("_blocks") > 0, F.pmod(start.cast("long"), F.col("_blocks"))).otherwise(F.lit(0)).cast("long").alias("turn"),
    )
    shards = stage(shards, "mix-quotas")
    if small_enough(shards, BROADCAST_SHARDS):
        shards = F.broadcast(shards)
    d = dealt(d).join(shards, ["source_no", "_shard"])
    line = W.partitionBy("source_no", "_shard").orderBy(*order)
    d = d.withColumn("until", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("since", F.col("until") - F.col("size"))
    d = d.withColumn("taken", F.expr(f"rounds * size + {drawn('until')} - {drawn('since')}"))
    return d.drop("_md5", "_draw", "_shards", "_shard", "source_no", "_tie")


def drawn(x: str, div: str = "div") -> str:
    """SQL for the tokens of drawn blocks among the first ``x`` tokens of a shard, in integers.

    Of n blocks over W tokens, block i is drawn if (i + 1 + turn) * rest div n is more
    than (i + turn) * rest div n, which draws exactly ``rest`` of any n in a row.
    ``div``: the engine's operator of integer division.
    """
    i = f"((({x} + 1) * blocks - 1) {div} words)"
    inner = f"({upto(i + ' + 1', div)} - {upto(i, div)}) * ({x} * blocks - {i} * words)"
    return f"CASE WHEN blocks > 0 THEN ({upto(i, div)} * words + {inner}) {div} blocks ELSE 0 END"


def upto(i: str, div: str = "div") -> str:
    """SQL for the number of drawn blocks among the first ``i``."""
    return f"((({i} + turn) * rest) {div} blocks - (turn * rest) {div} blocks)"


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, whose texts are what is taken.

    A document appears once whole for each whole round and once with the words of its
    drawn blocks, joined by one space, if there are any. Null texts, texts without a word
    and an empty table give no row of the second kind. Odd rows are dealt with as in ``mix``.
    """
    m = mix(docs, id_col, text_col, source_col, keep=True).withColumn("_text", F.col("row").getField(text_col).cast("string"))
    # the block of the i-th word; the words of drawn blocks stay
    block = "(((since + i + 1) * blocks - 1) div words)"
    part = f"array_join(filter(regexp_extract_all(_text, '({WORD})', 1), (x, i) -> {upto(block + ' + 1')} > {upto(block)}), ' ')"
    part = part.replace("\\", "\\\\")
    some = F.expr(f"CASE WHEN rest > 0 AND size > 0 THEN filter(array({part}), t -> t <> '') ELSE array() END")
    both = m.select("row", F.explode(F.concat(F.array_repeat("_text", F.col("rounds").cast("int")), some)).alias("_t"))
    return both.select(*[F.col("_t").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
