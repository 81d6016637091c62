"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary file names its own normalizer and pre-tokenizer; the family handled here
is lower-case NFC text, words by a fixed pattern, byte-level symbols and a suffix that
ends a word, and a file of another family is refused. Which code points are letters and
numbers, how they are lower-cased and which marks are reordered depends on the version of
Unicode; the tables are taken from the tokenizers library once, on the driver, and sent
along. Within a word the tree's root holds the lowest rank of any adjacent pair and its
leftmost place; a merge changes at most three leaves, each in logarithmic time. The trees
of many words stand side by side in one array and take each step together.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import slices

#: Words that a Python worker remembers; then it starts afresh.
REMEMBER = 100_000


# Normalizer and pre-tokenizer of the family, as its files state them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FAMILY = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


class Unicode(NamedTuple):
    """Tables of one version of Unicode: runs of letters and numbers, lower case where Python has another, marks that are not reordered."""

    letters: tuple[tuple[int, int], ...]
    numbers: tuple[tuple[int, int], ...]
    lower: dict[int, str]
    fixed_marks: str


@cache
def library_unicode() -> Unicode:
    """The tables of the tokenizers library, by asking it about every code point."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(points)

    def runs(kind: str) -> tuple[tuple[int, int], ...]:
        """What is left of all code points when those outside the class are removed."""
        left = pre_tokenizers.Split(Regex(f"[^{kind}]+"), "removed").pre_tokenize_str(text)
        out: list[tuple[int, int]] = []
        for _, (a, b) in left:
            for c in map(ord, text[a:b]):
                if out and out[-1][1] == c - 1:
                    out[-1] = (out[-1][0], c)
                else:
                    out.append((c, c))
        return tuple(out)

    lower, nfc = normalizers.Lowercase().normalize_str, normalizers.NFC().normalize_str
    other = {ord(c): lower(c) for c in points if lower(c) != c.lower()}
    # a mark that the library takes for a plain character stays where it is among others
    known = lambda x: nfc(x) == unicodedata.normalize("NFC", x)
    probes = "\u0334\u3099\u0327\u0315"
    marks = [c for c in points if unicodedata.combining(c) and not all(known("a" + m + c) and known("a" + c + m) for m in probes)]
    return Unicode(runs(r"\p{L}"), runs(r"\p{N}"), other, "".join(marks))


def _pattern(tables: Unicode, end: int) -> re.Pattern:
    """The split pattern for code points below ``end``."""
    body = lambda runs: "".join(f"\\U{a:08x}-\\U{min(b, end - 1):08x}" for a, b in runs if a < end)
    letters, numbers = body(tables.letters), body(tables.numbers)
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^\t-\r a-zA-Z0-9]+", re.ASCII)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: its own, or one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def check_family(spec: dict) -> None:
    """Raises if a vocabulary file is of another family."""
    wrong = [k for k, v in FAMILY.items() if spec.get(k) != v] + [f"model {k}" for k, v in PLAIN_MODEL.items() if spec["model"].get(k, v) != v]
    if wrong:
        raise ValueError(f"this vocabulary differs in {', '.join(wrong)}")


class Codec:
    """Vocabulary, merges and caches; made once in each Python worker."""

    def __init__(self, spec: bytes, tables: Unicode):
        t = json.loads(spec)
        model = t["model"]
        check_family(t)
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in t["added_tokens"]}
        named = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.base = max(named) + 1
        self.tokens = [named.get(i, "") for i in range(self.base)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        self.ranks = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.ranks]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # the smallest class that holds a text is the fastest to search
        self.patterns = [(end, _pattern(tables, end)) for end in (0x250, 0x10000, sys.maxunicode + 1)]
        self.lower = tables.lower
        self.marks = re.compile(f"([{tables.fixed_marks}])") if tables.fixed_marks else None
        self.known: dict[str, bytes] = {}

    def merge(self, words: list[str]) -> None:
        """Adds words to ``known``: the leftmost pair of lowest rank merges until none is left."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            n = len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass"))
            by_size.setdefault(1 << max(n - 1, 1).bit_length(), []).append(w)
        for size, group in by_size.items():
            step = max((1 << 17) // size, 1)
            for k in range(0, len(group), step):
                self._merge_group(group[k : k + step], size)

    def _merge_group(self, words: list[str], size: int) -> None:
        """Words of at most ``size`` bytes, a power of two; a column each, a row per place."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        n = np.array([len(d) for d in data], np.int64)
        wide, bits, none = len(words), size.bit_length() - 1, np.int64(1 << 62)
        cols = np.arange(wide)
        ids = np.full((size + 1, wide), -1, np.int64)
        ids[:size] = np.frombuffer(b"".join(d.ljust(size, b"\0") for d in data), np.uint8).reshape(wide, size).T
        ids[:size] = np.where(np.arange(size)[:, None] < n - 1, self.inner[ids[:size]], np.where(np.arange(size)[:, None] == n - 1, self.last[ids[:size]], -1))
        after = np.repeat(np.arange(1, size + 2)[:, None], wide, axis=1)
        before = np.repeat(np.arange(-1, size)[:, None], wide, axis=1)
        tree = np.full((2 * size, wide), none, np.int64)
        for i in range(size - 1):
            tree[size + i] = self._keys(ids[i], ids[i + 1], i, bits, none)
        for k in range(size - 1, 0, -1):
            tree[k] = np.minimum(tree[2 * k], tree[2 * k + 1])
        ids, after, before, tree = (x.ravel() for x in (ids, after, before, tree))
        while True:
            c = np.nonzero(tree[wide : 2 * wide] < none)[0]
            if not len(c):
                break
            root = tree[wide + c]
            i = root & (size - 1)
            j = after[i * wide + c]
            k = after[j * wide + c]
            h = before[i * wide + c]
            new = self.made[root >> bits]
            ids[i * wide + c] = new
            ids[j * wide + c] = -1
            after[i * wide + c] = k
            before[np.minimum(k, size) * wide + c] = i
            tree[(size + j) * wide + c] = none
            right = np.where(k < size, ids[np.minimum(k, size) * wide + c], -1)
            tree[(size + i) * wide + c] = self._keys(new, right, i, bits, none)
            there = h >= 0
            ch, hh = c[there], h[there]
            tree[(size + hh) * wide + ch] = self._keys(ids[hh * wide + ch], new[there], hh, bits, none)
            nodes = [(size + j, c), (size + i, c), (size + hh, ch)]
            for _ in range(bits):
                nodes = [(at >> 1, x) for at, x in nodes]
                for at, x in nodes:
                    left = 2 * at * wide + x
                    tree[at * wide + x] = np.minimum(tree[left], tree[left + wide])
        table = ids.reshape(size + 1, wide)[:size].T
        there = table >= 0
        flat = table[there].astype("<u4").tobytes()
        stops = (4 * np.cumsum(there.sum(axis=1))).tolist()
        for w, a, b in zip(words, [0, *stops[:-1]], stops, strict=True):
            self.known[w] = flat[a:b]

    def _keys(self, left: np.ndarray, right: np.ndarray, place, bits: int, none: np.int64) -> np.ndarray:
        """Rank and place of pairs in one number; ``none`` where a pair has no rank."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), (self.ranks[at] << bits) + place, none)

    def _words(self, text: str | None) -> list[tuple[bool, list[str]]]:
        """Parts of a text: (special, strings)."""
        if not text:
            return []
        out = []
        for part in self.split.split(text) if self.split and "<" in text else [text]:
            if part in self.special:
                out.append((True, [part]))
            elif part.isascii():
                out.append((False, _ASCII.findall(part.lower())))
            else:
                part = self._normal(part)
                pattern = next(p for end, p in self.patterns if end > sys.maxunicode or ord(max(part)) < end)
                out.append((False, pattern.findall(part)))
        return out

    def _normal(self, text: str) -> str:
        """NFC and lower case, as the library has them."""
        rare = ord(max(text)) > 0x2FF  # no mark and no other lower case below
        if rare and self.marks and self.marks.search(text):
            text = "".join(unicodedata.normalize("NFC", x) for x in self.marks.split(text))
        else:
            text = unicodedata.normalize("NFC", text)
        if rare:
            # one code point at a time: a final capital sigma is a plain small one
            text = text.replace("\u03a3", "\u03c3")
            if not self.lower.keys().isdisjoint(map(ord, set(text))):
                return "".join(self.lower.get(ord(c)) or c.lower() for c in text)
        return text.lower()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self._words(t) for t in texts]
        new = set().union(*(w for p in parts for special, w in p if not special)).difference(self.known)
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = set().union(*(w for p in parts for special, w in p if not special))
        if new:
            self.merge(list(new))
        known = self.known.__getitem__
        return [b"".join([b"".join(self.special[x].to_bytes(4, "little") for x in w) if special else b"".join(map(known, w)) for special, w in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, special tokens included."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[int, Codec] = {}


def _codec(spec) -> Codec:
    if spec.id not in _CODECS:
        _CODECS.clear()
        _CODECS[spec.id] = Codec(*spec.value)
    return _CODECS[spec.id]


class _Spec:
    """The vocabulary file and the tables of Unicode, read by the driver and sent once to each executor."""

    def __init__(self, df: DataFrame, path: str):
        data = Path(path).read_bytes()
        check_family(json.loads(data))
        self.id = hash(data)
        self.shared = df.sparkSession.sparkContext.broadcast((data, library_unicode()))

    @property
    def value(self) -> tuple[bytes, Unicode]:
        return self.shared.value


def _run(spec, encode: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for whole in batches:
            for b in slices(whole, 256):
                values = b.column(1).to_pylist()
                ids = codec.encode(values) if encode else [x or b"" for x in values]
                cols, names = [b.column(0)], ["row"]
                if encode:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                if decode:
                    cols.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids binary[, decoded string]), one row per row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers; null text encodes as empty.
    Strings of special tokens in a text become their ids. Repeated rows and rows with a
    null id are rows of their own; an empty table gives an empty result; columns but the
    id and the text are not looked at. A vocabulary of another family raises.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = f"row {kind}, ids binary" + ", decoded string" * decode
    return source.mapInArrow(_run(_Spec(docs, vocabulary), True, decode), schema).withColumnRenamed("row", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string) from the ids of ``encode``; null ids decode as empty."""
    kind = encoded.schema[id_col].dataType.simpleString()
    source = encoded.select(F.col(id_col).alias("row"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(_run(_Spec(encoded, vocabulary), False, True), f"row {kind}, decoded string").withColumnRenamed("row", id_col)
