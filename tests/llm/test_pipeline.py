"""The pipeline on odd rows: every stage keeps columns and copes with any table."""

import hashlib
import json
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest
from popgraph.llm import language, mixing, queries
from pyspark.sql import functions as F

from .test_operators import brute_hash, components, fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, extra string"


def test_stages(spark):
    words = "the and of that with from this have are not".split()
    rows = [(i, " ".join(words[(i * 7 + k * k) % 10] + str(i) * (k % 3 == 0) for k in range(60)), "en" if i % 2 else "de", None if i == 3 else f"s{i % 2}", 9, 1, "e") for i in range(12)]
    rows += [(20, rows[0][1].upper(), "en", "s0", 1, 1, "e"), (21, None, None, None, None, None, None), (22, "123", "en", "s0", 3, 1, "e"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, DOCS)
    seen = []
    for name, step in cp.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, "").collect(), DOCS)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert 21 not in seen[0] and 22 not in seen[0] and len(seen[0]) == len(rows) - 2
    assert seen[1] == sorted([*range(1, 12), 20])
    out = cp.STAGES[-1][1](spark, docs, "").collect()
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)


@pytest.mark.parametrize("stage", cp.STAGES, ids=lambda s: s[0])
def test_empty(spark, stage):
    assert stage[1](spark, spark.createDataFrame([], DOCS), "").count() == 0


def _ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


def test_repeated_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg"}
    rows = [(5, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["b"]), (7, text["c"]), (9, text["c"].upper()), (7, text["d"]), (9, text["e"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, "e") for i, t in rows], DOCS)
    want = [(-1, text["b"]), (5, text["a"]), (7, text["d"]), (9, text["c"].upper()), (9, text["e"])]
    assert _ids(cp.without_copies(spark, docs, "")) == want


def test_repeated_ids_of_near_copies(spark):
    # equal but for white space: one fingerprint
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg"}
    near = {k: t.replace(" ", "  ") for k, t in text.items()}
    rows = [(3, text["a"]), (5, near["a"]), (5, text["b"]), (None, near["b"]), (None, text["c"]), (5, text["d"]), (8, near["d"]), (8, text["e"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, "e") for i, t in rows], DOCS)
    want = [(-1, text["c"]), (3, text["a"]), (5, text["b"]), (5, text["d"]), (8, text["e"])]
    assert _ids(cp.without_near_copies(spark, docs, "")) == want
    # one id, two near copies: one stays
    twice = spark.createDataFrame([(i, t, "en", "s", 1, 1, "e") for i, t in [(4, text["f"]), (4, near["f"]), (4, text["g"])]], DOCS)
    assert len(got := _ids(cp.without_near_copies(spark, twice, ""))) == 2 and (4, text["g"]) in got


def test_clashing_names(spark):
    """Columns named like every helper of the stages are carried along."""
    names = ["_lang_pred", "_score", "_gone", "_again", "_folded", "_mark", "_of", "_id", "row", "mark", "id", "doc", "component", "least", "_md5", "size", "_t", "_text", "_words", "rounds", "since", "_LANG_PRED_"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    text = " ".join(f"word{i}" for i in range(70))
    rows = [(1, text, "en", "s", 9, *names), (2, text + " more", "en", "s", 9, *names), (3, text.upper(), "en", "s", 9, *names), (3, text.upper(), "en", "s", 9, *names)]
    docs = spark.createDataFrame(rows, schema)
    for _, step in cp.STAGES[:-1]:
        out = step(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() and all(tuple(r)[5:] == tuple(names) for r in docs.collect())
    assert sum(r.n_tokens for r in cp.tokens(spark, docs, "").collect()) > 0


def quotients(votes, seats):
    """Seats of each party (in order) by the highest quotients votes / (2k - 1), ties to the earlier party."""
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def brute_mix(rows, block=mixing.BLOCK):
    """Rows (doc_id, text, source, ...) as the mix takes them, in plain Python."""
    draw = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    of = defaultdict(list)
    for r in rows:
        of[r[2]].append(r)
    sources = sorted((s for s in of if s is not None)) + [None] * (None in of)
    size = {s: sum(len(r[1].split()) for r in of[s]) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    full, total = set(), mixing.SHARE * sum(size.values())
    while True:
        left = [s for s in sources if s not in full]
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * size[s] if s in full else weight[s] * level for s in sources}
    shards = {}
    for s in sources:
        n = max(-(-size[s] // mixing.SHARD_WORDS), -(-len(of[s]) // mixing.SHARD_DOCS))
        for r in of[s]:
            shards.setdefault((s, draw(f"{mixing.SEED}:{r[0]}") % n), []).append(r)
    words = {k: sum(len(r[1].split()) for r in v) for k, v in shards.items()}
    blocks = {k: max(1, int(w / block + 0.5)) if w else 0 for k, w in words.items()}
    every = {s: sum(b for k, b in blocks.items() if k[0] == s) for s in sources}
    order = [None] * (None in of) + [s for s in sources if s is not None]
    votes = [target[s] * every[s] / size[s] if size[s] else 0.0 for s in order]
    quota = {s: min(q, 2 * every[s]) for s, q in zip(order, quotients(votes, int(sum(votes) + 0.5)))}
    out = []
    for s in sources:
        mine = sorted(k for k in shards if k[0] == s) if s is not None else sorted((k for k in shards if k[0] is None), key=lambda k: k[1])
        for k, take in zip(mine, quotients([blocks[k] for k in mine], quota[s])):
            n = blocks[k]
            rounds, rest = divmod(take, n) if n else (0, 0)
            turn = draw(f"{mixing.SEED}:{s or ''}:{k[1]}") % n if n else 0
            taken = lambda b: ((b + 1 + turn) * rest) // n > ((b + turn) * rest) // n
            since = 0
            for r in sorted(shards[k], key=lambda r: (hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest(), len(r[1].split()))):
                w = r[1].split()
                out += [r] * rounds
                if rest and (part := " ".join(x for i, x in enumerate(w) if taken(((since + i + 1) * n - 1) // words[k]))):
                    out.append((r[0], part, *r[2:]))
                since += len(w)
    return out


@pytest.mark.parametrize("bound", [None, 0])
def test_pipeline_by_brute_force(spark, tmp_path, monkeypatch, bound):
    """All stages over documents against plain Python; with bound 0 every side that may be broadcast is shuffled."""
    if bound is not None:
        monkeypatch.setattr(cp, "BROADCAST_IDS", bound)
        monkeypatch.setattr(language, "BROADCAST_LANGUAGES", bound)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
        monkeypatch.setattr(mixing, "BROADCAST_SHARDS", bound)
    rng = np.random.default_rng(6)
    word = {"en": [f"the{i}ing" for i in range(400)], "de": [f"der{i}ung" for i in range(400)]}
    rows = []
    for i in range(700):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(word[lang], rng.integers(3, 40))), lang if i % 5 else None, None if i % 50 == 0 else f"s{i % 7 % 4}"))
    rows += [(1000 + i, rows[i][1].upper(), "en", "s1") for i in range(0, 60, 2)]
    rows += [(2000 + i, rows[i][1].replace(" ", "  "), "en", "s0") for i in range(0, 90, 3)]
    rows += [(3000, None, "en", "s0"), (3001, "12 34", "en", "s0"), (3002, "", "de", None), (5, rows[5][1], "en", "s2"), (7, "another text of number seven", "en", "s2")]
    docs = spark.createDataFrame([(i, t, lg, s, 1) for i, t, lg, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r, p in zip(rows, language.predictions(language.fit(docs), [r[1] for r in rows])[0]) if p != "und"]
    assert len(kept) == len(rows) - 3
    groups = defaultdict(list)
    for r in kept:
        groups[fold(r[1])].append(r)
    told = lambda r: json.dumps({"doc_id": r[0], "text": r[1], "lang": r[2], "source": r[3], "n_chars": 1}, separators=(",", ":"), ensure_ascii=False)
    exact = [min((r for r in g if r[0] == max(x[0] for x in g)), key=told) for g in groups.values()]
    comp = components([brute_hash(r[1]) for r in exact], lambda a, b: (a ^ b).bit_count() <= 2)
    near = defaultdict(list)
    for r, c in zip(exact, comp):
        near[c].append(r)
    single = [min((r for r in g if r[0] == min(x[0] for x in g)), key=lambda r: hashlib.sha256(fold(r[1])).digest()) for g in near.values()]
    mix = brute_mix([(i, t, s) for i, t, _, s in single])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation(), t.no_padding()
    want = Counter()
    for i, text, _ in mix:
        ids = t.encode(text, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    got = cp.run(spark, str(tmp_path)).select("doc_id", "n_tokens", F.col("ids_sha256"), "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want
