"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, plus signs before digits, digits,
schemes and identifier cues. From each anchor a local parser expands to the left and
right and validates what it has found. Base kinds are email, ip, card and phone; url and
account are added by schemes and cues and never displace a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import slices

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("account", "acct", "iban", "passport", "ssn", "user id", "userid", "customer id", "member id", "licence no", "license no")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_URL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'`{}|\\^]*)?")
_ACCOUNT = re.compile(r"(?: ?(?:no\.?|number|nr\.?|id))?[ ]?[:=#]?[ ]?([A-Za-z0-9](?:[ -]?[A-Za-z0-9])*)")
_GROUP = re.compile(r"[A-Za-z0-9]+")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    for d in "0123456789":
        a.add_word(d, ("d", 1))
        a.add_word("+" + d, ("+", 2))
    for kind, words in (("s", SCHEMES), ("c", CUES)):
        for word in words:
            a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    doubled = sum(2 * int(c) - 9 * (c > "4") for c in even)
    return (sum(map(int, odd)) + doubled) % 10 == 0


def _account(text: str, at: int) -> tuple[int, int] | None:
    """An identifier of 6 to 34 letters and digits with 4 digits at least, right of a cue."""
    m = _ACCOUNT.match(text, at, min(len(text), at + 80))
    if not m:
        return None
    start, end = m.span(1)
    stop, digits, chars = None, 0, 0
    for g in _GROUP.finditer(text, start, end):  # groups count as long as they hold digits
        if not any(c in "0123456789" for c in g[0]) and not (g.start() == start and g[0].isupper()):
            break
        digits += sum(c in "0123456789" for c in g[0])
        chars += len(g[0])
        stop = g.end()
    return (start, stop) if stop and digits >= 4 and 6 <= chars <= 34 else None


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, sorted; kind is a place in ``KINDS``."""
    if not text:
        return []
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    found: list[tuple[int, int, int]] = []
    email = ip = card = phone = url = account = 0  # where each kind may begin again
    # anchors are searched in lower case, whose places are those of the text
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_FOLD)
    for last, (kind, length) in _AUTOMATON[0].iter(low):
        at = last - length + 1
        if kind == "d":
            if at >= card:
                m = _CHAIN.match(text, at)
                card = m.end()
                if card - at >= 12:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, 2, card))
            if at >= ip:
                m = _DOTTED.match(text, at)
                ip = m.end()
                if ip - at >= 7:
                    parts = m[0].split(".")
                    start = at
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = start + sum(map(len, four)) + 3
                        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                            found.append((start, 1, end))
                        start = end + 1
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                found.append((start, 0, email))
        elif kind == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                end = m.end()
                while not "0" <= text[end - 1] <= "9":
                    end -= 1
                if end - at >= 4:
                    phone = end
                    if 9 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
                        found.append((at, 3, end))
        elif kind == "s":
            if at >= url and not (at and (text[at - 1].isalnum() or text[at - 1] == ".")):
                named = text[last] == "."
                m = _URL.match(text, at if named else last + 1)
                if m and (end := at + len(text[at : m.end()].rstrip(".,;:!?)]"))) > last + 1:
                    url = end
                    found.append((at, 4, end))
        elif at >= account and not (at and text[at - 1].isalnum()) and (got := _account(text, last + 1)):
            account = got[1]
            found.append((got[0], 5, got[1]))
    found.sort()
    return found


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            got = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(SPAN))], ["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), one row per row of ``docs``.

    Positions are code points, ends exclusive, by start and then kind. A null or empty
    text has no spans; repeated rows are rows of their own; an empty table gives an
    empty result; columns but the id and the text are not looked at.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_find, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def spans_text(column: str, kinds: tuple = KINDS):
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    kept = F.filter(column, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
