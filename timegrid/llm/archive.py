"""WARC archives with a two-level capture index.

Writing: each task writes one archive of records compressed one by one, and returns a capture line per record: the
reversed-host key of its address, the archive, the record's offset and length. Captures are sorted by key over ranges
and cut into compressed blocks; the blocks lie in one file per range, and a sparse directory keeps the first key, the
place and the length of every block, each range's part in order.

Reading: a key is looked up by binary search in the directory, the block is read by its range and searched in turn,
and the record is read by its range. For many keys at once: a key finds its index file by bisection in the files' ends,
at most RANGES rows; the keys of a file are dealt over tasks with the file's part of the directory; records are then read
in tasks of equal bytes, in the order of their archives.

Records of equal payloads of 1000 bytes or more are stored once, with the largest page_id; the others are revisits
that keep their HTTP head, whose Content-Length still states the whole payload's size.

Files lie in the shared folder and are named by task attempt; only files that a finished attempt has returned are
ever read. Defined cases: a null payload is empty; a null address becomes urn:page:<page_id>; a null
page_id is an empty one, and such a page is always a response; an address that can't be parsed is its own key; addresses and rows may
repeat, a capture each; of equal page_ids with equal payloads one is the response, the others revisit it; an empty
table gives empty archives and results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.llm.common import fresh_dir, release, save, slices

LEAST_PAYLOAD = 1000
BLOCK_LINES = 1000
#: Index files at most, captures for each below that, asked keys for each task, and bytes of records that a task reads.
RANGES = 4096
RANGE_LINES = 8000
TASK_KEYS = 20_000
TASK_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, copy int, file string, offset long, length long"
BLOCKS = "first_key string, first_page long, last_key string, last_page long, file string, offset long, length long, lines int"
RECORDS = "page_id long, copy int, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def reversed_key(url: str) -> str:
    """Sort key of an address: host labels from the last to the first, then port, path and query; scheme and www don't count.

    An address without a host, or that can't be parsed, is its own key in lower case. Tabs and line ends are blanks.
    """
    url = re.sub(r"[\t\r\n]", " ", url.strip())
    try:
        parts = urlsplit(url)
    except ValueError:
        return url.lower()
    if not parts.netloc:
        return url.lower()
    host, _, port = parts.netloc.rpartition("@")[2].lower().partition(":")
    labels = re.sub(r"^www\d*\.", "", host.rstrip(".")).split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def _read(uri: str, offset: int, length: int, opened: dict) -> bytes:
    """A range of a file; opened keeps the last few files open."""
    if uri not in opened:
        if len(opened) >= 16:
            opened.pop(next(iter(opened))).close()
        system, path = _place(uri)
        opened[uri] = system.open_input_file(path)
    return opened[uri].read_at(length, offset)


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{copy}>"


def capture(page_id: int | None, copy: int, url: str, payload: bytes, digest: str, refers_to: int | None, refers_copy: int | None) -> bytes:
    """One compressed response or revisit record."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, refers_copy))]
    return _record(head, http if revisit else http + payload)


def opening(name: str) -> bytes:
    """The record that an archive starts with."""
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(head, b"software: timegrid\r\nformat: WARC File Format 1.1\r\n")


def parse(data: bytes) -> dict:
    """The fields of one compressed record; a response's digest is computed from what was read."""
    raw = zlib.decompress(data, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page, copy = head["WARC-Record-ID"][1:-1].split(":")[2:]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = head["WARC-Type"]
    if kind == "response" and (size != len(payload) or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"record {head['WARC-Record-ID']} doesn't hold the payload that it states")
    refers = head["WARC-Refers-To"][1:-1].split(":")[2] if kind == "revisit" else None
    return {"page_id": int(page) if page else None, "copy": int(copy), "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": refers and int(refers), "url": head["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def decide(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """The pages with payload, digest, copy (number among equal page_ids) and the page and copy they refer to (null: a response)."""
    html, url = F.encode(F.coalesce("html", F.lit("")), "UTF-8"), address()
    copy = (F.row_number().over(Window.partitionBy("page_id").orderBy("digest", "url")) - 1).cast("int")
    rows = pages.select("page_id", url.alias("url"), html.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("copy", copy)
    rows = rows.withColumn("first", F.min("copy").over(Window.partitionBy("page_id", "digest")))
    # who leads each payload is told without the payloads
    seen = pages.select("page_id", url.alias("url"), F.sha1(html).alias("digest"), F.length(html).alias("size")).withColumn("copy", copy).where(F.col("size") >= least)
    leaders = seen.groupBy(F.col("digest").alias("same_digest")).agg(F.max("page_id").alias("leader"), F.max_by("copy", F.struct("page_id", -F.col("copy"))).alias("leader_copy"), F.count(F.lit(1)).alias("n"))
    seen = seen.select(F.col("page_id").alias("same_id"), F.col("digest").alias("same_digest")).join(leaders.where("n > 1").drop("n"), "same_digest").distinct()
    # payloads stay where the window has put them: the join's only key is the page, the digests are compared after
    same = (F.col("page_id") == F.col("same_id")) & ~(F.col("digest") < F.col("same_digest")) & ~(F.col("digest") > F.col("same_digest"))
    rows = rows.join(seen, same, "left")
    # of equal page_ids with that payload the first row is the response; the others revisit it
    revisit = F.col("leader").isNotNull() & ~((F.col("page_id") == F.col("leader")) & (F.col("copy") == F.col("first")))
    return rows.select("page_id", "copy", "url", "payload", "digest", F.when(revisit, F.col("leader")).alias("refers_to"), F.when(revisit, F.col("leader_copy")).alias("refers_copy"))


def address() -> Column:
    """A page's address; without one, urn:page:<page_id>."""
    return F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns the captures as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/archive-{task.stageId()}-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        system, path = _place(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        out, at = None, 0
        for batch in batches:
            for part in slices(batch, "payload"):
                if not out:
                    out, info = system.open_output_stream(path, compression=None), opening(path.rpartition("/")[2])
                    out.write(info)
                    at = len(info)
                rows = []
                for r in part.to_pylist():
                    data = capture(r["page_id"], r["copy"], r["url"], r["payload"], r["digest"], r["refers_to"], r["refers_copy"])
                    out.write(data)
                    rows.append({"key": reversed_key(r["url"]), "page_id": r["page_id"], "copy": r["copy"], "file": uri, "offset": at, "length": len(data)})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, _arrow(CAPTURES))
        if out:
            out.close()

    return save(decided.mapInArrow(run, CAPTURES), "captures")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.strip().split(" ") for f in ddl.split(","))])


def index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the capture index; returns its sparse directory, a row per block, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/index-{task.stageId()}-{task.partitionId():06d}-{task.taskAttemptId()}.cdx.gz"
        system, path = _place(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        out, at, held = None, 0, []

        def block() -> dict:
            nonlocal at
            data = zlib.compress("\n".join("\t".join(map(str, r)) for r in held).encode(), 6)
            out.write(data)
            row = {"first_key": held[0][0], "first_page": held[0][1], "last_key": held[-1][0], "last_page": held[-1][1], "file": uri, "offset": at, "length": len(data), "lines": len(held)}
            at += len(data)
            held.clear()
            return row

        for batch in batches:
            found = []
            out = out or system.open_output_stream(path, compression=None)
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((re.sub(r"[\t\n]", " ", r[0]), *r[1:]))
                if len(held) >= lines:
                    found.append(block())
            yield pa.RecordBatch.from_pylist(found, _arrow(BLOCKS))
        if held:
            yield pa.RecordBatch.from_pylist([block()], _arrow(BLOCKS))
        if out:
            out.close()

    files = min(RANGES, max(1, -(-captures.count() // RANGE_LINES)))
    ranged = captures.select("key", "page_id", "copy", "file", "offset", "length").repartitionByRange(files, "key", "page_id", "copy").sortWithinPartitions("key", "page_id", "copy")
    return save(ranged.mapInArrow(run, BLOCKS), "directory")


def _lines(data: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]


def read(directory: DataFrame) -> DataFrame:
    """All records that the index lists, found by its blocks and read by their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            for b in batch.to_pylist():
                rows, size = [], 0
                for _, _, _, file, offset, length in _lines(_read(b["file"], b["offset"], b["length"], opened)):
                    rows.append(parse(_read(file, int(offset), int(length), opened)))
                    size += len(rows[-1]["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _arrow(RECORDS))
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _arrow(RECORDS))

    blocks = directory.select(*_arrow(BLOCKS).names).repartition(F.xxhash64("file", "offset"))
    return blocks.mapInArrow(run, RECORDS)


def _page(number: int | str | None) -> float:
    """A page's place in the order of the index: no id comes first."""
    return float("-inf") if number in (None, "None") else int(number)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with `key`, the key of url (no nulls)."""
    kept = [f for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([reversed_key(u) for u in batch.column("url").to_pylist()], pa.string())], [*batch.schema.names, "key"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "key string"]))


def located(directory: DataFrame, asked: DataFrame) -> DataFrame:
    """Where the captures of the asked keys lie: key, page_id, file, offset, length.

    asked: key, page_id, any; with `any` all captures of the key, else those of the page too. First level: the index
    files' ends, at most RANGES rows, and in a file its part of the directory; second level: the block's lines. Both are
    searched by bisection.
    """
    ends = directory.groupBy("file").agg(F.min(F.struct("first_key", "first_page")).alias("low"), F.max(F.struct("last_key", "last_page")).alias("high")).collect()
    ranges = sorted(((r["low"][0], _page(r["low"][1])), (r["high"][0], _page(r["high"][1])), r["file"]) for r in ends)
    lows, highs, files = ([r[i] for r in ranges] for i in range(3))
    parts = max(1, -(-asked.count() // (TASK_KEYS * max(1, len(files)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page, any_ in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "any")), strict=True):
                first, last = (key, float("-inf") if any_ else _page(page)), (key, float("inf") if any_ else _page(page))
                i = bisect.bisect_left(highs, first)
                while i < len(lows) and lows[i] <= last:
                    rows.append({"range": files[i], "part": zlib.crc32(f"{key} {page}".encode()) % parts, "key": key, "page_id": page, "any": any_})
                    i += 1
            yield pa.RecordBatch.from_pylist(rows, _arrow(DEALT))

    def run(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        opened, rows = {}, []
        level = sorted(blocks.to_pylist(), key=lambda b: b["offset"])
        firsts = [(b["first_key"], _page(b["first_page"])) for b in level]
        at, lines, keys = -1, [], []
        for want in sorted(wanted.to_pylist(), key=lambda w: (w["key"], _page(w["page_id"]))):
            page = _page(want["page_id"])
            first, last = (want["key"], float("-inf") if want["any"] else page), (want["key"], float("inf") if want["any"] else page)
            b = max(0, bisect.bisect_left(firsts, first) - 1)
            while b < len(level) and firsts[b] <= last:
                if b != at:
                    lines = _lines(_read(level[b]["file"], level[b]["offset"], level[b]["length"], opened))
                    at, keys = b, [(line[0], _page(line[1])) for line in lines]
                i = bisect.bisect_left(keys, first)
                while i < len(lines) and keys[i] <= last:
                    rows.append({"key": want["key"], "page_id": None if lines[i][1] == "None" else int(lines[i][1]), "file": lines[i][3], "offset": int(lines[i][4]), "length": int(lines[i][5])})
                    i += 1
                b += 1
        return pa.Table.from_pylist(rows, _arrow(LOCATED))

    dealt = asked.select("key", "page_id", "any").mapInArrow(deal, DEALT)
    repeated = directory.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.groupBy("range", "part").cogroup(repeated.groupBy("file", "part")).applyInArrow(run, LOCATED)


DEALT = "range string, part int, key string, page_id long, any boolean"
LOCATED = "key string, page_id long, file string, offset long, length long"


def records_at(places: DataFrame) -> DataFrame:
    """The records at the places (key, file, offset, length): key and the record's columns.

    As many tasks as the records' bytes want; each reads its part of an archive in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            rows, size = [], 0
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                rows.append({"key": key} | parse(_read(file, offset, length, opened)))
                size += len(rows[-1]["payload"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _arrow(f"key string, {RECORDS}"))
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _arrow(f"key string, {RECORDS}"))

    places = save(places, "places")
    tasks = max(1, -(-(places.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    dealt = places.repartition(tasks, F.col("file"), F.floor(F.col("offset") / TASK_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, f"key string, {RECORDS}")


def lookup(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """The records of the addresses in urls (a column url): `asked`, the address, and the record's columns."""
    asked = save(_keyed(urls.select("url").where("url IS NOT NULL").distinct()), "asked")
    wanted = asked.select("key", F.lit(None).cast("long").alias("page_id"), F.lit(True).alias("any")).distinct()
    found = records_at(located(directory, wanted))
    return asked.withColumnRenamed("url", "asked").join(found, "key").drop("key")


def round_trip(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Archives every page and indexes the archives; then looks every page up by its address and reads it by its range."""
    folder = fresh_dir(pages.sparkSession, "warc")
    captures = write(decide(pages, least), folder)
    directory = index(captures, folder)
    release(captures)
    asked = _keyed(pages.select("page_id", address().alias("url"))).select("key", "page_id", F.lit(False).alias("any")).distinct()
    found = records_at(located(directory, save(asked, "asked")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
