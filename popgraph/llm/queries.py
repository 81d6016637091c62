"""Queries opN_<name> over the driver's tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgraph.llm import bpe, exact_dedup, filter_audit, language, lines, mixing, neighbours, pii, simhash, substring, suffix_dedup, vector_codes, warc
from popgraph.plans.stage import new_path, passing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    n = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *n, F.sha2(pii.spans_text("spans", pii.BASE), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return told.select("doc_id", language.held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_bytes")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _token_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), decode=True))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.remove_common_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, passing(spark, path), payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.train_and_encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_earlier(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_neighbours, op2_pii, op3_language, op4_exact_dedup, op5_mixing, op6_bpe, op7_lines, op8_warc, op9_simhash, op10_substring,
        op11_vector_codes, op12_filter_audit, op13_suffix_array,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_EXACT = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def _apportion_sql(name: str, src: str, within: str, party: str, votes: str, seats: str) -> str:
    """CTEs of the allocation: ``name`` has the columns of ``src`` and ``won``."""
    return f"""
{name}_a AS (SELECT *, CAST({votes} AS DOUBLE) AS v, sum(CAST({votes} AS DOUBLE)) OVER w AS vs, count(*) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY {within})),
{name}_b AS (SELECT *, CASE WHEN vs > 0 AND {seats} > 0 AND {seats} - n / 2 - 1 > 0 THEN CAST(floor(v * ({seats} - n / 2 - 1) / vs + 0.5) AS BIGINT) ELSE 0 END AS low FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN vs > 0 AND {seats} > 0 AND v > 0 THEN greatest(CAST(floor(v * ({seats} + n / 2 + 1) / vs + 0.5) AS BIGINT), low) ELSE low END AS high,
  {seats} - sum(low) OVER (PARTITION BY {within}) AS still FROM {name}_b),
{name}_d AS (SELECT {within}, {party}, still, row_number() OVER (PARTITION BY {within} ORDER BY v / (2 * k - 1) DESC, {party} NULLS FIRST, k) AS r
  FROM (SELECT *, unnest(range(low + 1, high + 1)) AS k FROM {name}_c)),
{name}_e AS (SELECT {within} AS ww, {party} AS pp, count(*) AS c FROM {name}_d WHERE r <= still GROUP BY ALL),
{name} AS (SELECT {name}_c.*, low + coalesce(c, 0) AS won FROM {name}_c LEFT JOIN {name}_e
  ON {name}_c.{within} IS NOT DISTINCT FROM ww AND {name}_c.{party} IS NOT DISTINCT FROM pp)"""


_DRAW = "CAST('0x' || substr({}, 1, 8) AS BIGINT)"
_MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][(i - 1) % 3 + 1] AS w, source_size * {mixing.MOST} AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * CAST({mixing.SHARE} AS DOUBLE) - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s2 WINDOW before AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT level AS l FROM s3 WHERE level < ratio ORDER BY ratio, i LIMIT 1),
s AS (SELECT source, source_size, docs, CASE WHEN l IS NULL OR ratio <= l THEN CAST(cap AS DOUBLE) ELSE w * l END AS target,
    greatest(CAST(ceil(source_size / {mixing.SHARD_WORDS}) AS BIGINT), CAST(ceil(docs / {mixing.SHARD_DOCS}) AS BIGINT)) AS shards
  FROM s3 LEFT JOIN lv ON true),
x AS (SELECT d.*, s.source_size, s.target, {_DRAW.format("m")} % s.shards AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
h AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, any_value(source_size) AS source_size, any_value(target) AS target FROM x GROUP BY ALL),
hb AS (SELECT *, CASE WHEN words > 0 THEN greatest(1, CAST(floor(words / {mixing.BLOCK} + 0.5) AS BIGINT)) ELSE 0 END AS blocks FROM h),
o0 AS (SELECT source, CAST(sum(blocks) AS BIGINT) AS blocks_all, any_value(source_size) AS source_size, any_value(target) AS target FROM hb GROUP BY source),
o1 AS (SELECT *, 0 AS one, CASE WHEN source_size > 0 THEN target * blocks_all / source_size ELSE 0.0 END AS votes FROM o0),
o2 AS (SELECT *, CAST(floor(sum(votes) OVER () + 0.5) AS BIGINT) AS seats FROM o1),
{_apportion_sql("oq", "o2", "one", "source", "votes", "seats")},
hq AS (SELECT hb.*, least(oq.won, {mixing.MOST} * oq.blocks_all) AS quota FROM hb JOIN oq ON hb.source IS NOT DISTINCT FROM oq.source),
{_apportion_sql("ht", "hq", "source", "shard", "blocks", "quota")},
z AS (SELECT source, shard, words, blocks, CASE WHEN blocks > 0 THEN won // blocks ELSE 0 END AS rounds, CASE WHEN blocks > 0 THEN won % blocks ELSE 0 END AS rest,
    CASE WHEN blocks > 0 THEN {_DRAW.format(f"md5('{mixing.SEED}:' || coalesce(source, '') || ':' || CAST(shard AS VARCHAR))")} % blocks ELSE 0 END AS turn FROM ht),
y AS (SELECT x.*, z.* EXCLUDE (source, shard), CAST(sum(size) OVER (PARTITION BY x.source, x.shard ORDER BY m, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until
  FROM x JOIN z ON x.source IS NOT DISTINCT FROM z.source AND x.shard = z.shard)
SELECT doc_id, size, source_size, target, CAST(rounds * size + {mixing.drawn("until", "//")} - {mixing.drawn("(until - size)", "//")} AS BIGINT) AS taken FROM y
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
r AS (SELECT p.page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS x, f.first FROM p JOIN f ON p.h = f.h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, (k // 8) * 10 + 1, 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM r
"""

_SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT id, s, array_to_string(w[s:s + {substring.LENGTH - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {substring.LENGTH - 2})) AS s FROM d)),
rep AS (SELECT id, s FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
cov AS (SELECT DISTINCT id, s + k AS i FROM rep, range({substring.LENGTH}) t(k)),
word AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d),
keep AS (SELECT word.id, string_agg(t, ' ' ORDER BY word.i) AS kept, count(*) AS n FROM word ANTI JOIN cov ON word.id = cov.id AND word.i = cov.i GROUP BY word.id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN keep ON d.id = keep.id
"""



def _codes_sql() -> str:
    """Rounds one after another: assignments ``a``k to the entries ``c``k, and the entries moved to their means."""
    near = "(SELECT r, part, entry, sum((x - y) * (x - y)) AS d FROM p JOIN {c} USING (part, i) GROUP BY ALL)"
    assign = "{a} AS (SELECT r, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM " + near + " GROUP BY ALL)"
    move = """{n} AS (SELECT {c}.part, {c}.entry, {c}.i, coalesce(m, y) AS y FROM {c} LEFT JOIN
  (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM p JOIN {a} USING (r, part) GROUP BY ALL) USING (part, entry, i))"""
    steps = []
    for k in range(vector_codes.ROUNDS):
        steps += [assign.format(a=f"a{k}", c=f"c{k}"), move.format(n=f"c{k + 1}", c=f"c{k}", a=f"a{k}")]
    last = vector_codes.ROUNDS
    steps.append(assign.format(a=f"a{last}", c=f"c{last}"))
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
v AS (SELECT r, len(e) // {parts} AS w, unnest(range(len(e))) AS j, unnest(e) AS z FROM k),
p AS (SELECT r, j // w AS part, j % w AS i, CAST(floor({vector_codes.SCALE} * z) AS BIGINT) AS x FROM v),
c0 AS (SELECT part, r - 1 AS entry, i, x AS y FROM p WHERE r <= {entries}),
{", ".join(steps)},
t AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, i)) FROM c{last}) AS codebooks_sha256
FROM k JOIN t USING (r)
"""


_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < {filter_audit.MIN_WORDS}, 100 * len(list_distinct(w)) < {filter_audit.MIN_DISTINCT_PERCENT} * len(w),
     100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MAX_UPPER_PERCENT} * len(t), regexp_matches(t, '{filter_audit.MARKS}'),
     d.doc_id > min(d.doc_id) OVER (PARTITION BY t)] AS f
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS v),
o AS (SELECT [a.v, b.v, c.v, e.v, h.v] AS o FROM x a, x b, x c, x e, x h WHERE len(list_distinct([a.v, b.v, c.v, e.v, h.v])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
k AS (SELECT part, o, step,
    sum(CASE WHEN NOT list_bool_or(list_transform(o[:step], lambda z: f[z])) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda z: f[z])), false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN f[o[step]] THEN n ELSE 0 END) AS failing,
    sum(CASE WHEN f[o[step]] AND len(list_filter(f, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda z: f[z])), false) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda z: f[z])), false) THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda z: substr('{filter_audit.FILTERS}', z, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(failing - removed AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM k
"""

_SUFFIX = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * suffix_dedup.LENGTH})) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {suffix_dedup.LENGTH - 1})) AS s FROM d)),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {suffix_dedup.LENGTH} THEN 0 ELSE 1 END AS fresh FROM r),
j AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS no FROM i),
k AS (SELECT doc_id, min(s) AS b, max(s) + {suffix_dedup.LENGTH} AS e FROM j GROUP BY doc_id, no),
n AS (SELECT d.doc_id, d.h, k.b, k.e, lead(k.b) OVER (PARTITION BY d.doc_id ORDER BY k.b) AS nb FROM d JOIN k ON d.doc_id = k.doc_id),
z AS (SELECT doc_id, min(b) AS b, sum(e - b) AS gone, count(*) AS spans, string_agg(substr(h, 2 * e + 1, 2 * (coalesce(nb, len(h) // 2) - e)), '' ORDER BY b) AS tail FROM n GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN z.b IS NULL THEN d.h ELSE substr(d.h, 1, 2 * z.b) || z.tail END)) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id
"""

ORACLE_SQL = {
    "op4_exact_dedup": _EXACT,
    "op5_mixing": _MIX,
    "op8_warc": _WARC,
    "op10_substring": _SUBSTRING,
    "op11_vector_codes": _codes_sql(),
    "op12_filter_audit": _AUDIT,
    "op13_suffix_array": _SUFFIX,
}
