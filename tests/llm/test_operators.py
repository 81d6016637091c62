"""Corpus operators against brute force on small tables with odd rows."""

import hashlib
import json
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from popgraph.llm import bpe, exact_dedup, language, lines, mixing, neighbours, pii, queries, simhash, substring, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, size string, marks string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def rows():
    texts = [
        None, "", "  \n ", "Hello World", "hello world", "HELLO WORLD", "É è", "é è", LONG, LONG.upper(), "a " * 80, "one two", "12345 67",
        "intro one " + PASSAGE + " tail one", "other start " + PASSAGE + " another end", "x " + PASSAGE[:150],
        "mail a.b@c.de, card 4111 1111 1111 1111, ip 10.0.0.255 and 1.2.3.4.5.6.7.8, +49 (30) 123-4567, https://x.org/a?b. IBAN: DE44500105175407324931",
    ]
    out = [(i, t, "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 3}", 1, 7, "k", "z", "m") for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, "null id", None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def fold(t):
    return (t or "").encode().lower()


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r[1])].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t).hexdigest())] += 1
    return want


# small moduli collide at once: only the comparison of chunks tells texts apart
@pytest.mark.parametrize(("moduli", "huge"), [(exact_dedup.MODULI, exact_dedup.HUGE), ((2, 3), 100), ((1, 1), exact_dedup.HUGE)])
def test_exact_groups(docs, empty, spark, moduli, huge):
    groups = lambda df: Counter(map(tuple, exact_dedup.exact_groups(df, moduli=moduli, huge=huge).drop("n_bytes").collect()))
    assert groups(docs) == brute_groups(rows())
    assert groups(empty) == Counter()
    # equal lengths; the last two differ in their second chunk alone
    long = "Ab é" * 30000
    odd = [(1, "ab"), (2, "cd"), (3, "AB"), (4, "ef"), (5, "cd"), (6, long), (7, long[:-1] + "x"), (8, long.upper().replace("É", "é"))]
    assert groups(spark.createDataFrame(odd, "doc_id long, text string")) == brute_groups(odd)


def test_fingerprints_combine():
    poly, cut = exact_dedup.Polynomials(), exact_dedup.CHUNK
    data = bytes(range(256)) * 700
    parts = [data[k : k + cut] for k in range(0, len(data), cut)]
    assert len(parts) == 3 and poly.combine(poly.fingerprint(data[: 2 * cut]), poly.chunk_hash(parts[2]), len(parts[2])) == poly.fingerprint(data)
    shares = [poly.shifted(poly.chunk_hash(p), len(data) - k * cut - len(p)) for k, p in enumerate(parts)]
    assert tuple(sum(x) % m for x, m in zip(zip(*shares), exact_dedup.MODULI)) == poly.fingerprint(data)


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mixing(docs, empty, spark):
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert Counter((r[0], r[2]) for r in got) == Counter((r[0], size(r[1])) for r in rows())
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r.text) for r in mixed.select("text").collect()) == sum(taken.values())


def test_highest_quotients(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0, "e": 7}
    for seats in (0, 1, 2, 5, 17, 100):
        df = spark.createDataFrame([(1, k, v, seats) for k, v in votes.items()], "one int, p string, v long, s long")
        got = {r.p: r.out for r in mixing.apportion(df, ["one"], ["p"], "v", "s", "out").collect()}
        q = sorted(((-v / (2 * k - 1), p) for p, v in votes.items() if v for k in range(1, seats + 1)))[:seats]
        assert got == {p: sum(x == p for _, x in q) for p in votes}


def brute_hash(t):
    words = fold(t).split()
    sh = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    comp = {i: i for i in range(len(items))}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                comp[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_simhash(docs, empty):
    prints = [brute_hash(r[1]) for r in rows()]
    comp = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {c: min((r[0] for r, x in zip(rows(), comp) if x == c and r[0] is not None), default=None) for c in comp}
    want = Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows(), prints, comp))
    assert Counter(map(tuple, simhash.near_groups(docs).collect())) == want
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("heavy", [512, 3])
def test_simhash_links_span_components(spark, heavy):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(30):
            fps.add(int(b) ^ sum({1 << int(x) for x in rng.integers(0, 64, rng.integers(1, 5))}))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), heavy=heavy).collect()
    at = {f: i for i, f in enumerate(signed)}
    pairs = {frozenset((at[r.a], at[r.b])) for r in links}
    assert all((fps[min(p)] ^ fps[max(p)]).bit_count() <= 60 for p in pairs)
    want = components(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = components(list(range(len(fps))), lambda i, j: frozenset((i, j)) in pairs)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def brute_strip(texts, n=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("heavy", [400, 1])
def test_substring(docs, empty, heavy, spark):
    want = Counter((r[0], *x) for r, x in zip(rows(), brute_strip([r[1] for r in rows()])))
    assert Counter(map(tuple, substring.remove_repeats(docs, heavy=heavy).collect())) == want
    assert substring.remove_repeats(empty).count() == 0
    rng = np.random.default_rng(heavy)
    pool = [" ".join(f"v{x}" for x in rng.integers(0, 50, 70)) for _ in range(4)]
    texts = []
    for i in range(60):
        p = pool[rng.integers(0, 4)].split()
        a, b = sorted(rng.integers(0, 70, 2))
        texts.append(" ".join([f"u{i}_{k}" for k in range(rng.integers(0, 6))] + p[a:b] + [f"t{i}"] + pool[rng.integers(0, 4)].split()[: rng.integers(0, 70)]))
    got = substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), heavy=heavy).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_strip(texts)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute_pii(t):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m[0]))


def test_pii(docs, empty):
    got = pii.find_pii(docs).collect()
    order = {k: i for i, k in enumerate(pii.KINDS)}
    base = Counter((r.doc_id, tuple((s.start, order[s.kind], s.end) for s in r.spans if s.kind in pii.BASE)) for r in got)
    assert base == Counter((r[0], tuple(brute_pii(r[1]))) for r in rows())
    kinds = {s.kind for r in got for s in r.spans}
    assert kinds == set(pii.KINDS)
    assert pii.find_pii(empty).count() == 0
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = "".join(rng.choice(list("0123456789 -.+()@ab"), 40))
        assert [x for x in pii.spans(t) if x[1] < 4] == brute_pii(t), t


def test_pii_cues_in_any_case():
    for said in ("iban: DE44500105175407324931", "IbAn DE44500105175407324931", "İ my iBaN: DE44500105175407324931", "uSer Id 1234567"):
        assert [said[a:b] for a, k, b in pii.spans(said) if pii.KINDS[k] == "account"] == [said.split()[-1]]
    assert [k for _, k, _ in pii.spans("see hTTps://x.org/a and wWw.y.org")] == [4, 4]


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    codec = bpe.Codec(open(path, "rb").read(), bpe.library_unicode())
    odd = ["Σας ΟΔΟΣ İ ǅ ﬁ ½ Ⅷ é", "a<|endoftext|>b <|startoftext|>X", "it's they'll I'D", "日本語 12345 x\x00y\x1c", "a" * 999, "नमस्ते 🙂👩‍👩‍👧"]
    for x in odd + [r[1] or "" for r in rows()]:
        e = t.encode(x, add_special_tokens=False)
        ids = codec.encode([x])[0]
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert codec.decode(ids) == t.decode(e.ids, skip_special_tokens=False)
    coded = bpe.encode(docs, path)
    back = {(r.doc_id, r.decoded) for r in bpe.decode(coded, path).collect()}
    assert back == {(r.doc_id, r.decoded) for r in bpe.encode(docs, path, decode=True).collect()}
    assert bpe.encode(empty, path).count() == 0


def test_bpe_of_every_code_point(spark, tmp_path):
    """Alone, in a row with others, and marks beside marks, as the library encodes them; other families are refused."""
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    codec = bpe.Codec(open(path, "rb").read(), bpe.library_unicode())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["a" + " ".join(points[k : k + 64]) + "Z" for k in range(0, len(points), 64)]
    rng = np.random.default_rng(8)
    odd = [c for c in points if unicodedata.combining(c)] + list(bpe.library_unicode().fixed_marks) + [chr(c) for c in bpe.library_unicode().lower] + list("aZé\u1100\u1161\u11a8ΣΣ ς'sIİ")
    for few in (np.array(odd), np.array(points)):
        texts += ["".join(few[k]) for k in rng.integers(0, len(few), (2000, 12))]
    for e, ids, x in zip(t.encode_batch(texts, add_special_tokens=False), codec.encode(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, ascii(x)
    other = json.loads(open(path).read())
    other["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="normalizer"):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id int, text string"), str(tmp_path / "other.json"))


def test_language(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(d)
    told = language.identify(d, model).withColumn("held", language.held_out())
    held = told.where("held and _lang_pred <> 'und'").select("lang", "_lang_pred", "_score").collect()
    assert sum(r.lang == r._lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r._score <= 1 for r in held)
    odd = {r.doc_id: r._lang_pred for r in language.identify(docs, model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[12] == "und"
    none = language.fit(empty)
    assert none.languages == [] and language.identify(docs, none).where("_lang_pred <> 'und'").count() == 0
    assert language.identify(empty, model).columns == [*empty.columns, "_lang_pred", "_score"]


def test_language_scores_by_kernels(spark):
    """Scores against the definition: means of set cosines with each landmark, by plain Python sets."""
    model = language.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), landmarks=12)
    edges = np.cumsum([0, *language.BINS])
    sets = lambda flags: [set(np.nonzero(flags[a:b])[0].tolist()) for a, b in zip(edges, edges[1:])]
    marks = [sets(f) for f in np.unpackbits(model.bits, axis=1)[:, : language.WIDTH]]
    texts = ["the quick brown fox", "der schnelle Fuchs und das Haus", "é", "a" * 500]
    langs, scores = language.predictions(model, [*texts, None, "12 !"])
    assert langs[4:] == ["und", "und"] and not scores[4:].any()
    for t, lang, score in zip(texts, langs, scores):
        own = sets(language.grams(t))
        k = np.array([sum(len(a & b) / np.sqrt(len(a) * len(b)) for a, b in zip(own, m) if a and b) / len(own) for m in marks])
        f = np.exp(k @ model.coef.astype(float) * language.SHARPNESS)
        assert lang == model.languages[int(f.argmax())] and abs(score - f.max() / f.sum()) < 1e-3


def test_language_sample_of_repeated_ids(spark):
    rows = [(i % 5, f"text {'abc'[k]}{i} of it", "en" if k else "de") for i in range(40) for k in range(3)]
    fits = [language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n), per_language=7, at_most=11) for n in (1, 5)]
    assert fits[0].languages == fits[1].languages == ["de", "en"] and (fits[0].coef == fits[1].coef).all() and (fits[0].bits == fits[1].bits).all()


def test_warc(spark, tmp_path):
    fake = "<p>\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n</p>"
    data = [(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", fake), (6, "u", fake), (7, "u", "é" * 9000), (2, None, "x"), (None, "u", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w").collect()
    first = {}
    for i, _, h in sorted((r for r in data if r[0] is not None)):
        first.setdefault(h or "", i)
    want = Counter((i, "response" if i is None or first[h or ""] == i else "revisit", None if i is None or first[h or ""] == i else first[h or ""], len((h or "").encode())) for i, _, h in data)
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == want
    assert all(r.sound for r in got)
    assert all(bytes(r.payload).decode() in (fake, "x", "", "é" * 9000) for r in got if r.record_type == "response")
    warc.write_warc(pages.limit(0), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").count() == 0


def test_warc_repeated_ids(spark, tmp_path):
    data = [(1, "u", "x"), (2, "u", "x"), (2, "u", "y"), (3, "u", "y"), (3, "u", "z")]
    warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read_warc(spark, f"{tmp_path}/w").collect())
    assert got == Counter([(1, "response", None, b"x"), (2, "revisit", 1, b""), (2, "response", None, b"y"), (3, "revisit", 2, b""), (3, "response", None, b"z")])


def brute_records(data):
    """(page_id, type, payload bytes, sound) by one pass over a whole file."""
    out, at = [], 0
    while data.startswith(warc.MAGIC, at):
        stop = data.find(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x) if stop >= 0 else {}
        if not head.get("Content-Length", "").isdigit():
            return [*out, (None if not head.get("WARC-Record-ID") else int(head["WARC-Record-ID"][10:-1]), 0, False)]
        end = stop + 4 + int(head["Content-Length"])
        body = data[stop + 4 : end].partition(b"\r\n\r\n")[2]
        whole = data[end : end + 4] == b"\r\n\r\n"
        out.append((int(head["WARC-Record-ID"][10:-1]), len(body) if whole else None, whole))
        at = end + 4
    return out


@pytest.mark.parametrize("broadcast", [0, warc.BROADCAST_PARTS])
def test_warc_parts_do_not_move_between_scans(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_PARTS", broadcast)
    data = [(i, f"https://x.org/{i}", f"page {i} " * 300) for i in range(900)]
    warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    follow = warc.chains
    settings = {"spark.sql.files.maxPartitionBytes": "300000", "spark.sql.leafNodeDefaultParallelism": "3", "spark.sql.files.minPartitionNum": "5"}

    def chains(parts):
        for k, v in settings.items():
            spark.conf.set(k, v)
        return follow(parts)

    monkeypatch.setattr(warc, "chains", chains)
    try:
        got = warc.read_warc(spark, f"{tmp_path}/w").collect()
        # parts that no chain was followed in, and files that grew: no silent loss
        monkeypatch.setattr(warc, "chains", lambda parts: follow(parts.where("block < 500000")))
        with pytest.raises(Exception, match="was not there"):
            warc.read_warc(spark, f"{tmp_path}/w").collect()
        monkeypatch.setattr(warc, "chains", lambda parts: follow(parts.withColumn("size", F.col("size") + 1)))
        with pytest.raises(Exception, match="changed while"):
            warc.read_warc(spark, f"{tmp_path}/w").collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert Counter((r.page_id, r.sound) for r in got) == Counter((i, True) for i in range(900))


@pytest.mark.parametrize(("part", "broadcast"), [(3000, 0), (1 << 27, warc.BROADCAST_PARTS)])
def test_warc_parts(spark, tmp_path, monkeypatch, part, broadcast):
    """Archives cut into many parts and read whole; payloads full of records, of lone magic lines, larger than parts; a broken chain."""
    monkeypatch.setattr(warc, "BROADCAST_PARTS", broadcast)
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", broadcast)
    rng = np.random.default_rng(4)
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 9\r\n\r\nHTTP\r\n\r\nx\r\n\r\n"
    texts = [inner * k for k in (1, 7, 40)] + ["WARC/1.0\r\n" * 300, "a" * 9000, "", "WARC/1.0", "é\r\n\r\n" * 5] + ["".join(rng.choice(["x", "\r\n", "WARC/1.0\r\n", "\r\n\r\n", inner], 30)) for _ in range(12)]
    data = [(i, "http://u/WARC/1.0" if i % 3 == 0 else "u", t) for i, t in enumerate(texts)] + [(100, "u", texts[1])]
    warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3), f"{tmp_path}/w")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = warc.read_warc(spark, f"{tmp_path}/w").collect()
        assert all(r.sound for r in got)
        assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter((i, "revisit" if i == 100 else "response", 1 if i == 100 else None, len(t.encode())) for i, _, t in data)
        assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: "" if i == 100 else t for i, _, t in data}
        # lengths that lead nowhere, past the end, into the middle; a file that doesn't start with a record
        files = sorted(tmp_path.glob("w/part-*"))
        whole = [f.read_bytes() for f in files]
        broken = tmp_path / "b"
        broken.mkdir()
        cuts = []
        for k, w in enumerate(whole):
            at = w.find(b"\r\nContent-Length: ", len(w) // 2) + 18
            cuts += [w[:at] + b"9" + w[at:], w[:at] + b"x" + w[at:], w[: len(w) - 3], b" " + w, w]
        for k, w in enumerate(cuts):
            (broken / f"{k}.warc").write_bytes(w)
        got = Counter((r.page_id, r.sound) for r in warc.read_warc(spark, str(broken)).collect())
        assert got == Counter((i, ok) for w in cuts for i, _, ok in brute_records(w))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines(docs, empty, spark):
    block = "alpha line\nbeta line\ngamma line"
    texts = ["first\n" + block + "\nend", "second\n" + block + "\nother", "alone", "first\n" + block + "\nend", None, "", "beta line\nalone?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.remove_common_lines(df).collect()}
    assert got == {0: (5, 0, texts[0]), 1: (5, 3, "second\nother"), 2: (1, 0, "alone"), 3: (5, 5, ""), 4: (0, 0, ""), 5: (0, 0, ""), 6: (2, 0, texts[6])}
    assert lines.remove_common_lines(docs).count() == docs.count() and lines.remove_common_lines(empty).count() == 0
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 4, 1]) == [(1, 1), (2, 2), (3, 3)]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    data = [(i, x[i].tolist()) for i in range(1500)] + [(1500 + i, x[0].tolist()) for i in range(40)]
    odd = [(2000, None), (2050, [0.0] * 16), (2051, [float("nan")] * 16), (2052, [None] * 16), (None, [1.0] * 16), (2100, [1.0, 2.0]), (3, x[3].tolist())]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumnRenamed("x", "x")
    got = defaultdict(list)
    for r in neighbours.nearest(df, every=50, shard=600).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i, _ in data])
    v = np.array([e for _, e in data], np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1540, 50):
        s = v @ v[ids.tolist().index(q)] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[ids.tolist().index(q)]))
        want = sorted((-round(a, 9), i) for a, i in zip(s.tolist(), ids.tolist()) if i != q)[:5]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in want} & {i for _, i, _ in found})
        total += 5
    assert hits / total >= 0.9 and u.shape == v.shape
    assert [i for _, i, _ in sorted(got[0])] == [1500, 1501, 1502, 1503, 1504]
    assert neighbours.nearest(df.limit(0), every=50).count() == 0


def nearest_by_brute_force(data, every, k=5):
    v = np.array([e for _, e in data], np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for n, (q, _) in enumerate(data):
        if q % every == 0:
            s = np.round(u @ u[n], 9)
            out[q] = [i for _, i in sorted((-a, i) for a, (i, _) in zip(s.tolist(), data) if i != q)[:k]]
    return out


def test_neighbours_of_two_full_shards(spark):
    rng = np.random.default_rng(11)
    data = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(5000, 64)).astype(np.float32))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, every=50, shard=2500).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = nearest_by_brute_force(data, 50)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_neighbours_ties_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_SHARDS", 0)
    # powers of two of one vector have equal cosines; tiny and huge ones neither vanish nor overflow
    data = [(50 - i, [2.0**-i, 2.0**-i, 0.0]) for i in range(30)] + [(100, [1e-200, 1e-200, 0.0]), (101, [1e300, 1e300, 0.0]), (102, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in neighbours.nearest(df, every=50).orderBy("query_id", "rank").collect()]
    assert got == [(q, i) for q in (50, 100) for i in range(21, 26)]
    # an id with two vectors asks with the least of them and is found with both
    twice = spark.createDataFrame([(50, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [2.0, 0.1])], "vec_id long, embedding array<double>")
    for parts in (1, 3):
        assert [r.vec_id for r in neighbours.nearest(twice.repartition(parts), every=50).orderBy("rank").collect()] == [1, 2]


def test_lines_of_frequent_passages(spark):
    # documents 4 to 7 share a rarer line with one that lacks the passage
    texts = {0: "rare\nzero", 1: "p1\np2\np3", **{i: f"rare\nown {i}\np1\np2\np3" for i in range(4, 8)}}
    # two frequent passages of unlike frequency
    texts |= {10: "q1\nq2", 11: "r1\nr2", 12: "q1\nq2\nx12", 13: "r1\nr2\nx13", 14: "r1\nr2\nx14", 15: "q1\nq2\nx15\nr1\nr2"}
    # the lines of the passage come singly before they come together
    texts |= {20: "a1\nx20", 21: "a2\nx21", 22: "a3\nx22", 23: "x23\na1\n\na2\na3", 24: "a1\na2\n\na3\nx24"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in lines.remove_common_lines(df).collect()}
    want = texts | {i: f"rare\nown {i}" for i in range(4, 8)} | {12: "x12", 13: "x13", 14: "x14", 15: "x15", 24: "\nx24"}
    assert kept == want


@pytest.mark.parametrize("size", [1, 2, 3])
def test_lines_runs_find_every_block(spark, size):
    rng = np.random.default_rng(size)
    bound = ["\n".join(f"{k} {j}" for j in range(3)) for k in range(9)]
    texts = ["\n".join(bound[k] if rng.random() < 0.7 else f"own {i} {k}" for k in range(9)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        ls = t.split("\n")
        runs = [tuple(ls[k : k + size]) for k in range(len(ls) - size + 1)]
        gone = {k + j for k, r in enumerate(runs) if r in seen for j in range(size)}
        want[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        seen |= set(runs)
    assert {r.doc_id: r.kept_text for r in lines.remove_common_lines(df, min_lines=size).collect()} == want


@pytest.mark.parametrize("size", [1, 2, 3])
def test_lines_against_all_pairs(spark, size):
    """70 tables of random documents, moved and repeated blocks among them: as if every pair of a table were aligned."""
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for t in range(70):
        pool = [[f"{t} {x}" for x in rng.integers(0, 300, rng.integers(1, 6))] for _ in range(8)]
        few = int(rng.integers(4, 40))
        seen = []
        for _ in range(rng.integers(4, 20)):
            if t % 2:
                d = [x for k in rng.integers(0, 8, rng.integers(1, 6)) for x in (pool[k] if rng.random() < 0.8 else [f"{t} own {len(rows)}", ""])]
            else:
                d = [f"{t} {x}" if x else "" for x in rng.integers(0, few, rng.integers(1, 20))]
            hashes = lines.line_hashes("\n".join(d))
            full = [x for x in hashes if x]
            gone = {i for e in seen for i in lines.common_blocks(e, hashes, size)}
            if full and any([x for x in e if x] == full for e in seen):
                gone = {i for i, x in enumerate(hashes) if x}
            want[len(rows)] = "\n".join(x for i, x in enumerate(d) if i not in gone)
            rows.append((len(rows), "\n".join(d)))
            seen.append(hashes)
    got = lines.remove_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=size).collect()
    assert {r.doc_id: r.kept_text for r in got} == want


def test_common_blocks():
    assert lines.common_blocks([1, 2, 3, 4], [9, 2, 3, 4, 1], 2) == [1, 2, 3]
    assert lines.common_blocks([1, 2, 3, 4, 5, 6], [4, 5, 6, 0, 1, 2], 2) == [0, 1, 2, 4, 5]  # moved
    assert lines.common_blocks([1, 2], [1, 2, 7, 1, 2], 2) == [0, 1, 3, 4]  # repeated
    assert lines.common_blocks([1, 2, 3], [3, 2, 1], 2) == lines.common_blocks([], [1], 1) == []
