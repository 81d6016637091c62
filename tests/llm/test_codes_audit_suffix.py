"""Vector codes, the audit of filters and suffix-array deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from popgraph.llm import filter_audit, suffix_array, suffix_dedup, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, x binary, slot long"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd rounds over Python integers; ``rows``: sorted (vec_id, vector, label)."""
    import math

    ints = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    w = len(ints[0]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for v in ints] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def assign():
        out = []
        for p in range(parts):
            d = [[sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]] for x in cut[p]]
            out.append([(min(range(len(r)), key=lambda k: (r[k], k)), min(r)) for r in d])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x for x, (k, _) in zip(cut[p], got[p]) if k == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    got = assign()
    errors = [sum(got[p][i][1] for p in range(parts)) for i in range(len(rows))]
    by = Counter()
    for (_, _, label), e in zip(rows, errors):
        by[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = ["".join(f"{got[p][i][0]:02x}" for p in range(parts)) for i in range(len(rows))]
    return Counter((r[0], c, e, by[r[2]]) for r, c, e in zip(rows, codes, errors)), sha


def coded(df, **how):
    rows, books = vector_codes.train_and_encode(df, **how)
    return Counter((r.vec_id, r.code, r.error, r.label_error) for r in rows.collect()), vector_codes.books_sha256(books)


@pytest.mark.parametrize(("n", "scale"), [(300, 0.2), (90, 3000.0), (40, 1.0)])
def test_vector_codes(spark, n, scale):
    rng = np.random.default_rng(n)
    # coarse values: many equal distances and entries that coincide
    v = (np.round(rng.normal(0, 2, (n, 32))) * np.float32(scale) / 4).astype(np.float32)
    rows = [(i * 3, v[i].tolist(), [None, 1, 2, 7][i % 4]) for i in range(n)]
    rows += [(5, rows[2][1], None), (5, rows[2][1], None), (None, rows[4][1], 1)]
    whole = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    bad = [(1, None, 1), (2, [], 1), (4, [None] + v[0].tolist()[1:], 1), (7, [float("nan")] * 32, 2), (8, [float("inf")] + v[0].tolist()[1:], 2), (10, [1.0] * 16, 1)]
    df = spark.createDataFrame([(i, x, y, "c", b"x", 1) for i, x, y in rows + bad], VECTORS).repartition(7)
    assert coded(df) == brute_codes(whole)


def test_vector_codes_of_odd_tables(spark):
    df = spark.createDataFrame([], VECTORS)
    assert coded(df) == (Counter(), hashlib.sha256(b"").hexdigest())
    one = spark.createDataFrame([(1, [0.5] * 16, None, "", b"", 0)] * 3, VECTORS)
    assert coded(one)[0] == Counter({(1, "00" * 16, 0, 0): 3})
    with pytest.raises(ValueError, match="equal parts"):
        coded(spark.createDataFrame([(1, [0.5] * 17, 1, "", b"", 0)], VECTORS))
    with pytest.raises(Exception, match="64 bits"):
        coded(spark.createDataFrame([(1, [1e30] * 16, 1, "", b"", 0)], VECTORS))


def test_active_entries_equal_a_full_scan():
    rng = np.random.default_rng(3)
    for top in (3, 1 << 28):
        x, old = rng.integers(-top, top, (500, 3)), rng.integers(-top, top, (20, 3))
        old[7] = old[3]
        new = old.copy()
        new[[2, 3, 11]] += rng.integers(-2, 3, (3, 3))
        code, dist = vector_codes.nearest(x, old)
        got, want = vector_codes.reassign(x, code, dist, old, new), vector_codes.nearest(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


DOCS = "doc_id long, text string, lang string, source string, mask int, part string, w string"


def brute_audit(docs, labels):
    said = {}
    for i, quality, toxic in labels:
        if i is not None:
            q, t = said.get(i, (0, 0))
            said[i] = (int(q or quality == 1), int(t or toxic == 1))
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    masks = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > smallest[t])
        masks.append((lang or "", {"ABCDE"[k] for k in range(5) if fails[k]}, *said.get(i, (0, 0))))
    want = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                fails, only = sum(f in m[1] for m in own), sum(m[1] == {f} for m in own)
                want[part, "".join(order), k + 1] = [len(left), len(gone), fails - len(gone), only, sum(m[2] for m in gone), sum(m[3] for m in gone), f]
        for key, row in want.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in want.items()}


def test_filter_audit(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t ", "Q" * 50, "é" * 10 + "A", "a # b", " ".join(words), " ".join(words[:90] * 3), " ".join(w.upper() for w in words), " ".join(words) + " 5%", "x " * 250]
    docs = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["en", "fr", "", None])) for _ in range(300)] + [(900, " ".join(words), "xx")]
    labels = [(rng.choice([*range(50), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    df = spark.createDataFrame([(*d, "s", 1, "p", "w") for d in docs], DOCS).repartition(5)
    lf = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(df, lf).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * 4
    assert filter_audit.audit(df.limit(0), lf).count() == 0
    assert {r.good_lost for r in filter_audit.audit(df, lf.limit(0)).collect()} == {0}


def test_swaps_reach_every_order():
    for n in range(1, 6):
        order = list(range(n))
        seen = [tuple(order)]
        for at in filter_audit.plain_changes(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def test_diagrams_share_and_keep_functions():
    rng = random.Random(2)
    counts = {m: (rng.randint(0, 2), 0, 1) for m in rng.sample(range(32), 20)}
    d = filter_audit.Diagram(5, counts)
    for at in [*filter_audit.plain_changes(5)]:
        d.swap(at)
        assert all(len({(id(n.passes), id(n.fails)) for n in level.values()}) == len(level) for level in d.levels)
        for mask in range(32):
            node = d.root
            for v in d.order:
                node = None if node is None else node.fails if mask >> v & 1 else node.passes
            assert d.weight(node) == counts.get(mask, (0, 0, 0))


def test_suffix_array():
    rng = random.Random(1)
    cases = [b"", b"a", b"aaaa", b"banana", b"mississippi", b"abcabcabc", bytes(range(256)), bytes(range(255, -1, -1)), b"\xff\xff\x00\xff"]
    cases += [bytes(rng.randrange(97, 97 + k) for _ in range(n)) for n in range(1, 60) for k in (1, 2, 3, 26) for _ in range(5)]
    cases += [(c * 9)[: rng.randint(1, 120)] for c in cases[9:200]]
    for c in cases:
        assert suffix_array.suffix_array(c) == sorted(range(len(c)), key=lambda i: c[i:])


def brute_spans(docs, length):
    """Cut documents; the order of rows with one id is passed in by the order of ``docs``."""
    first, out = {}, []
    seen = set()
    for row, (i, t) in enumerate(docs):
        b = (t or "").encode()
        if (i, t) not in seen:
            for s in range(len(b) - length + 1):
                first.setdefault(b[s : s + length], ((i, t), s))
        seen.add((i, t))
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] != ((i, t), s):
                gone[s : s + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


def cut(df, **how):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_earlier(df, **how).collect())


@pytest.mark.parametrize(("length", "gram", "heavy", "shard"), [(5, 2, 4096, 1 << 17), (6, 3, 2, 8), (8, 8, 3, 40)])
def test_suffix_dedup(spark, length, gram, heavy, shard):
    rng = random.Random(length)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["é" * 30, "a" * 200, "ab" * 90, None, ""]
    docs = [(None, texts[0])] + [(k, rng.choice(texts)) for k in range(120)] + [(500, texts[3] + texts[4])] * 3
    df = spark.createDataFrame([(*d, None, "s", 1, "p", "w") for d in docs], DOCS).repartition(5)
    assert cut(df, length=length, gram=gram, heavy=heavy, shard=shard) == brute_spans(docs, length)


def test_suffix_dedup_of_odd_tables(spark):
    passage = "".join(f"{k} words that repeat, " for k in range(12))
    docs = [(1, "start " + passage + "end"), (2, "other " + passage + "close"), (3, passage), (4, passage[:99]), (5, passage[:100]), (6, None), (7, "")]
    df = spark.createDataFrame([(*d, None, "s", 1, "p", "w") for d in docs], DOCS)
    assert cut(df) == brute_spans(docs, 100)
    assert cut(df.limit(0)) == Counter()
    # rows of one id that differ: each is cut against the other in one order, whatever it is
    two = [(1, "x" + passage), (1, "y" + passage)]
    got = cut(spark.createDataFrame([(*d, None, "s", 1, "p", "w") for d in two], DOCS))
    assert got in (brute_spans(two, 100), brute_spans(two[::-1], 100))


def test_segments_hold_every_window(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choice(b"abc") for _ in range(3000)) + b"a" * 500
    whole = {}
    for block in (64, 1000, suffix_dedup._BLOCK):
        monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
        at = {}
        for anchor, first, n, into in suffix_dedup.segments(data, 20, 7):
            for a, f, c in zip(anchor.tolist(), first.tolist(), n.tolist()):
                at |= dict.fromkeys(range(f, f + c), a)
        assert sorted(at) == list(range(len(data) - 19))
        for s, a in at.items():
            assert whole.setdefault(data[s : s + 20], a) == a
