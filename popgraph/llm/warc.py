"""WARC archives: writing with revisit records, and reading by boundary chains.

A reader that trusts every ``WARC/1.0`` line also trusts those inside payloads. Here each
such line is only a candidate: its header names a length and so the offset of its
successor. Tasks read parts of files, emit candidates with successor offsets and follow
chains inside their part by pointer jumping; the links that lead from part to part are
few and are followed from the files' starts by pointer jumping over a table. What is in
reach of a file's start is a record, and nothing else is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.llm.common import slices, with_group
from popgraph.plans.stage import new_path, passing, small_enough, stage

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
#: Revisits that are broadcast to the writers; more are joined by a shuffle.
BROADCAST_REVISITS = 100_000
#: Parts of files whose places are broadcast to the readers; more are joined by a shuffle.
BROADCAST_PARTS = 200_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes."""
    h = F.sha1(text)
    out = []
    for group in range(4):
        v = F.conv(F.substring(h, 10 * group + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(_BASE32), (F.shiftright(v, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*out)


def payload_key() -> tuple[Column, Column]:
    return F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("n")


def revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """(page_id, digest, n, refers_to) of the pages whose payload, of n bytes, a smaller page_id has too.

    ``pages``: page_id and html without nulls. Null ids take no part; repeated rows are
    one; rows of one id and unlike payloads are told apart by digest; an empty table gives
    none.
    """
    rows = pages.select("page_id", *payload_key())
    rows = stage(rows.where(F.col("page_id").isNotNull() & (F.col("n") >= at_least)), "warc-digests")
    more = stage(rows.groupBy("digest", "n").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "warc-more")
    of_groups = rows.join(more.drop("c"), ["digest", "n"], "left_semi")
    first = with_group(of_groups, ["digest", "n"], "page_id", {"refers_to": ("min", "page_id")})
    return first.where("page_id <> refers_to").select("page_id", "digest", "n", "refers_to").distinct()


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: int = 0
) -> None:
    """Writes a record per row of ``pages`` into archives under ``path``.

    Of rows with equal payloads of at least ``at_least`` bytes, those with the smallest
    page_id are responses and the others revisit it. A null html is an empty payload, a
    null url is left out, white space in a url is percent-encoded. Rows without a
    page_id are responses; rows that repeat the smallest page_id are responses too. Rows
    of one page_id and unlike payloads are told apart by the payload's digest. An empty
    table gives no record; columns but the three named ones are not looked at. The last
    digit of a url that ends like the magic is percent-encoded, so that no header line
    ends so. Archives may be of any size, since they are read in parts.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    again = stage(revisits(p, at_least), "warc-revisits")
    few = small_enough(again, BROADCAST_REVISITS)
    p = p.select("*", *payload_key()).join(F.broadcast(again) if few else again, ["page_id", "digest", "n"], "left")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    seen = F.col("refers_to").isNotNull()
    block_bytes = F.octet_length(http) + F.when(seen, 0).otherwise(F.octet_length("html"))
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(seen, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.regexp_replace("url", r"\s", "%20"), r"WARC/1\.0$", "WARC/1.%30"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), sha1_base32(F.col("html")),
        F.when(seen, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.when(seen, "\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest").otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block_bytes.cast("string"), F.lit(END),
    )
    record = F.concat(head, http, F.when(seen, "").otherwise(F.col("html")))
    p.select(record.alias("value")).write.option("lineSep", END).text(path)


def header(segment: bytes) -> tuple[int, dict[str, str]]:
    """Where the block of a segment (what follows a magic line) starts, -1 if it has no header end, and its header fields."""
    stop = segment.find(b"\r\n\r\n")
    head: dict[str, str] = {}
    if stop >= 0:
        for line in segment[:stop].decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(":")
            head.setdefault(name.strip().lower(), value.strip())
    return (stop + 4 if stop >= 0 else -1), head


def span(segment: bytes) -> int:
    """Bytes from the magic line of a segment to its successor, 0 if the header does not tell."""
    start, head = header(segment)
    length = head.get("content-length", "")
    told = start >= 0 and length.isascii() and length.isdigit() and len(length) < 16
    return len(MAGIC) + start + int(length) + 4 if told else 0


def follow(offsets: np.ndarray, after: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(last, exit) of the chain from every candidate of a part: its last record and the offset past the part that it leads to.

    ``after``: successor offsets (0: none); ``stop``: where the next part begins. exit is
    -1 where the chain ends inside the part. By pointer jumping: links double until none moves.
    """
    n = len(offsets)
    place = np.searchsorted(offsets, after)
    hit = (after > 0) & (place < n)
    hit[hit] &= offsets[place[hit]] == after[hit]
    jump = np.where(hit, place, np.arange(n))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    out = after[jump]
    return jump, np.where((out > 0) & (out >= stop), out, -1)


#: Of each part: its bytes. Of each candidate: its offset in the part, where its chain leaves it (-1: nowhere) and the chain's last record.
PARTS = "file string, block long, size long, at long, exit long, last long"
#: Stands for the part itself.
_NONE = -(1 << 62)


class _Part:
    """Candidates of one part of a file, in order."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.size, self.rows = file, block, 0, []

    def add(self, segment: bytes) -> None:
        if self.size or self.block:  # before the first magic of a file is no candidate
            self.rows.append((self.size - len(MAGIC), span(segment)))
        self.size += len(segment) + len(MAGIC)

    def table(self) -> pa.RecordBatch:
        offsets, spans = (np.array(c, np.int64) for c in (zip(*self.rows, strict=True) if self.rows else ((), ())))
        last, out = follow(offsets, np.where(spans > 0, offsets + spans, 0), self.size - len(MAGIC))
        n = len(offsets) + 1
        numbers = [[self.block] * n, [self.size] * n, np.append(offsets, _NONE), np.append(out, -1), np.append(offsets[last], _NONE)]
        return pa.RecordBatch.from_arrays([pa.array([self.file] * n, pa.string()), *[pa.array(c, pa.int64()) for c in numbers]], [c.split()[0] for c in PARTS.split(", ")])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = None
    for whole in batches:
        for b in slices(whole, 64):
            for file, block, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if part is None or (file, block) != (part.file, part.block):
                    if part is not None:
                        yield part.table()
                    part = _Part(file, block)
                part.add(segment)
    if part is not None:
        yield part.table()


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, segment): the files under ``path`` cut at magic lines, in order within each part (block) of a file."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("segment"))


def chains(parts: DataFrame) -> DataFrame:
    """(file, block, size, base, entry, owner): of every part, its bytes, its offset, the first record in it (null: none) and the record that reaches into it from before (null: none).

    Links between parts are followed from offset 0 of each file by pointer jumping.
    """
    sizes = parts.groupBy("file", "block").agg(F.first("size").alias("size"))
    of_file = W.partitionBy("file").orderBy("block")  # a row per part
    base = stage(sizes.select("file", "block", "size", F.coalesce(F.sum("size").over(of_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")), "warc-parts")
    found = parts.where(F.col("at") > _NONE).join(base, ["file", "block"])
    moved = [(F.col("at") + F.col("base")).alias("at"), F.when(F.col("exit") >= 0, F.col("exit") + F.col("base")).alias("exit"), (F.col("last") + F.col("base")).alias("last")]
    nodes = stage(found.select("file", "block", *moved), "warc-candidates")
    exits = nodes.where("exit is not null").select("file", F.col("exit").alias("at")).distinct()
    entries = stage(nodes.join(exits, ["file", "at"], "left_semi").unionByName(nodes.where("at = 0")), "warc-entries")
    jump = entries.where("exit is not null").select("file", F.col("at").alias("of"), F.col("exit").alias("to"))
    jump = stage(jump.join(entries.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi"), "warc-jumps")
    reach = entries.where("at = 0").select("file", "at")
    while not jump.isEmpty():
        step = reach.join(jump.withColumnRenamed("of", "at"), ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = stage(reach.unionByName(step).distinct(), "warc-reach")
        jump = stage(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.of"))).select("a.file", "a.of", "b.to"), "warc-jumps")
    real = entries.join(reach, ["file", "at"]).select("file", "block", F.col("at").alias("entry"), F.when(F.col("exit").isNotNull(), F.struct("last", "exit")).alias("into"))
    j = base.join(real, ["file", "block"], "left")
    owner = F.last("into", True).over(of_file.rowsBetween(W.unboundedPreceding, -1))
    j = j.withColumn("_o", owner)
    return j.select("file", "block", "size", "base", "entry", F.when(F.col("_o.exit") > F.col("base") - len(MAGIC), F.col("_o")).alias("owner"))


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, sound boolean"
#: Pieces of records that reach over parts: of what record, at what offset, bytes.
PIECE = "file string, record long, piece long, bytes binary"


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def parse(record: bytes, payload: bool) -> tuple:
    """A row of RECORD from what follows a record's magic line up to its successor or the end of the file."""
    start, head = header(record)
    size = span(record)
    whole = size > 0 and len(record) >= size - len(MAGIC) and record[size - len(MAGIC) - 4 : size - len(MAGIC)] == b"\r\n\r\n"
    block = record[start : size - len(MAGIC) - 4] if whole else b""
    http, _, body = block.partition(b"\r\n\r\n")
    sizes = [x[15:] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    told = sizes[0].strip() if sizes else b""
    n = int(told) if told.isdigit() and len(told) < 19 else len(body)
    digest, kind = head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("warc-type", "")
    good = whole and (kind == "revisit" or (n == len(body) and base64.b32encode(hashlib.sha1(body).digest()).decode() == digest))
    return (_number(head.get("warc-record-id")), head.get("warc-target-uri"), kind, _number(head.get("warc-refers-to")), n, digest, good, *[body] * payload)


def _schema(payload: bool) -> str:
    return RECORD + ", payload binary" * payload


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class _Reader:
    """Follows the chain of one part and collects the segments of the record at hand."""

    def __init__(self, file: str, block: int, base: int, entry: int | None, owner: dict | None):
        self.file, self.block, self.at, self.next = file, block, base - len(MAGIC), entry
        self.owner, self.held, self.start = owner, None, None
        self.done: list[bytes] = []
        self.pieces: list[tuple] = []

    def add(self, segment: bytes) -> None:
        here = self.at
        self.at += len(segment) + len(MAGIC)
        if here == self.next:
            self.finish()
            size = span(segment)
            self.held, self.start, self.next = [segment], here, here + size
            if not size:
                self.finish()
                self.next = None
        elif self.held is not None:
            if here < self.next:
                self.held += [MAGIC, segment]
            else:  # the length leads between two candidates
                self.finish()
                self.next = None
        elif self.owner is not None and here < self.owner["exit"]:
            self.pieces.append((self.file, self.owner["last"], here, MAGIC + segment))

    def mark(self) -> None:
        """Tells that the part was read, and up to where."""
        self.pieces.append((self.file, self.block, self.at + len(MAGIC), None))

    def finish(self, end: bool = False) -> None:
        """Ends the record at hand; at the end of a part it may go on in the next."""
        if self.held is None:
            return
        record, self.held = b"".join(self.held), None
        if end and self.next > self.at:
            self.pieces.append((self.file, self.start, self.start, record))
        else:
            self.done.append(record)


def _read(payload: bool):
    both = _schema(payload) + ", " + PIECE
    width = len(both.split(", ")) - 4

    def out(reader: _Reader) -> Iterator[pa.RecordBatch]:
        rows = [(*parse(r, payload), None, None, None, None) for r in reader.done] + [(*[None] * width, *p) for p in reader.pieces]
        reader.done, reader.pieces = [], []
        if rows:
            yield _batch(rows, both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for whole in batches:
            for b in slices(whole, 64):
                for file, block, base, entry, owner, segment in zip(*[b.column(c).to_pylist() for c in ("file", "block", "base", "entry", "owner", "segment")], strict=True):
                    if reader is None or (file, block) != (reader.file, reader.block):
                        if reader is not None:
                            reader.finish(end=True)
                            reader.mark()
                            yield from out(reader)
                        if base is None:
                            raise ValueError(f"part {block} of {file} was not there when the chains were followed")
                        reader = _Reader(file, block, base, entry, owner)
                    reader.add(segment)
                yield from out(reader)
        if reader is not None:
            reader.finish(end=True)
            reader.mark()
            yield from out(reader)

    return run


def _fixed_parts(spark: SparkSession) -> SparkSession:
    """A session of its own, in which the size of the parts of files can not change between scans.

    Spark cuts files by its settings and by the number of cores that it knows of when a
    scan is planned; here both are taken down once.
    """
    own = spark.newSession()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")}
    kept |= {"spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism)}
    for k, v in kept.items():
        own.conf.set(k, v)
    return own


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``; ``sound``: end, length and digest hold.

    Files are read in parts (spark.sql.files.maxPartitionBytes), whatever their size. What
    follows a record whose length leads nowhere is not in reach and gives no rows; that
    record itself has ``sound`` false. A record that reaches over parts is put together
    from its pieces. Repeated records are rows of their own; empty files give none. A
    record of more than 2 GB or with a header line that ends like the magic is not read.
    Both scans see the same parts; if a file changes between them, the read raises.
    """
    at = segments(_fixed_parts(spark), path)
    told = stage(chains(stage(at.mapInArrow(_scan, PARTS), "warc-scan")), "warc-chains")
    if small_enough(told, BROADCAST_PARTS):
        placed = at.join(F.broadcast(told), ["file", "block"], "left")
    else:
        placed = at.withColumn("_n", F.monotonically_increasing_id()).join(told, ["file", "block"], "left").sortWithinPartitions("file", "block", "_n").drop("_n")
    done = new_path(spark, "warc-records")
    placed.mapInArrow(_read(payload), shape := _schema(payload) + ", " + PIECE).write.parquet(done)
    read = spark.read.schema(shape).parquet(passing(spark, done))
    sizes = told.select("file", "block", (F.col("base") + F.col("size")).alias("piece"))
    seen = read.where("record is not null and bytes is null").select("file", F.col("record").alias("block"), "piece")
    if not sizes.join(seen, ["file", "block", "piece"], "left_anti").isEmpty():
        raise ValueError(f"files under {path} changed while they were read")
    read = read.where("record is null or bytes is not null")
    names = [f.split()[0] for f in _schema(payload).split(", ")]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("bytes").alias("x")))), lambda p: p["x"]), "")
    pieces = read.where("record is not null").groupBy("file", "record").agg(F.unhex(joined).alias("bytes"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield _batch([parse(x, payload)], _schema(payload))

    return read.where("record is null").select(*names).unionByName(pieces.select("bytes").mapInArrow(whole, _schema(payload)))
