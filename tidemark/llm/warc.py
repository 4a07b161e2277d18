"""WARC archives of pages: a deterministic sharded writer and a splitting reader, as a Spark data source.

Writing. Pages are dealt into shards by ranges of (id, payload digest). The ranges' borders
come from a sample that the keys' own hashes choose, so they depend on the rows alone; each
shard is sorted and written by one task, record by record, into files that are closed once
their compressed size would pass ``roll_bytes``. Nothing but the current record is held. Record
headers, ids and digests are made anew from the rows, so equal tables give equal bytes. Tasks
write under temporary names that no other attempt uses. When all have ended, the driver gives
the files of the attempts that counted their final names, writes the manifest under a temporary
name and renames it last. A reader trusts the manifest alone: what a lost or repeated task
left behind is never seen, and is removed.

Of records with the same payload of at least ``LEAST_REVISIT`` bytes the one with the smallest id is
a response, the others are revisits that refer to it and hold no payload. Who revisits whom is
found on ids and digests; the pages themselves are shuffled once.

Reading. Every record is a gzip member of its own; the manifest names borders of members
every ``SPLIT_BYTES``, so one file feeds many tasks. Block and payload digests are recomputed
and a difference raises.

A null html is an empty payload, a null url no WARC-Target-URI. Null ids come last; a group of
equal payloads without any id has its first record as response and revisits refer to nothing.
Of rows with the same id and payload, one (by url, nulls first) is the response. An empty table gives an
archive without files. Very long payloads are compressed alone. Other columns are dropped.
Control characters and blanks in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import materialize, python_tasks, shared_folder

FORMAT = "tidemark-warc"
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 100
#: Payload bytes that make a shard, and most shards; beyond them shards grow and roll over several files.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 8192
#: Compressed bytes of a file, and compressed bytes between two borders that a reader may split at.
ROLL_BYTES, SPLIT_BYTES = 1 << 30, 64 << 20
#: Sampled keys for each shard.
SAMPLE = 64
MANIFEST, TEMPORARY = "manifest.json", "_temporary"
#: Stated in every record: pages carry no date of their own.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, page_id string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, payload binary"
_NAMES = ("record_id", "record_type", "page_id", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload")
_KINDS = (pa.string(),) * 5 + (pa.int64(), pa.string(), pa.binary())


# ---- records -------------------------------------------------------------------------


def record_id(page_id: str | None, digest: str, nth: int) -> str:
    """The same for the same row on every run; ``nth`` tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([page_id, digest, nth]))}>"


def _member(headers: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """One record as a gzip member without a time stamp."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))] if v is not None]
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + out.flush()


def page_record(page_id: str | None, url: str | None, payload: bytes, digest: str, nth: int, refers: tuple[str | None, str] | None, level: int) -> bytes:
    """``refers``: id and record id of the response that holds the payload; None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    named = lambda x: None if x is None else quote(x)
    headers = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, digest, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Page-ID", named(page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), *([("WARC-Profile", _PROFILE), ("WARC-Refers-To", refers[1]), ("Refers-To-Page-ID", named(refers[0]))] if refers else []), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(headers, http if refers else http + payload, level)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    if not first.startswith("WARC/") or len(rest) != int(headers["Content-Length"]) + 4:
        raise ValueError("not a whole WARC record")
    return headers, rest[:-4]


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    told = lambda name: headers[name].removeprefix("sha256:")
    http, _, payload = block.partition(b"\r\n\r\n")
    response = headers["WARC-Type"] == "response"
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if hashlib.sha256(block).hexdigest() != told("WARC-Block-Digest") or response and (len(payload) != n or hashlib.sha256(payload).hexdigest() != told("WARC-Payload-Digest")):
        raise ValueError(f"digest mismatch in record {headers['WARC-Record-ID']}")
    named = lambda name: unquote(headers[name]) if name in headers else None
    return headers["WARC-Record-ID"], headers["WARC-Type"], named("Page-ID"), named("Refers-To-Page-ID"), headers.get("WARC-Target-URI"), n, told("WARC-Payload-Digest"), payload if response and payloads else None


# ---- files ---------------------------------------------------------------------------


def _at(path: str) -> tuple[Any, str]:
    """File system and path of a folder that driver and executors share (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _File:
    """A file under its temporary name, and its line of the manifest."""

    temporary: str
    name: str
    records: int = 0
    bytes: int = 0
    splits: list[int] = field(default_factory=list)
    first: str | None = None
    last: str | None = None
    sha256: str = ""


class _Roller:
    """Writes members of one shard after the other, and starts a new file where the next member would pass the limit."""

    def __init__(self, path: str, attempt: str, roll: int, level: int):
        (self._fs, root), self._roll, self._level = _at(path), roll, level
        self._folder = f"{root}/{TEMPORARY}/{attempt}"
        self._fs.create_dir(self._folder, recursive=True)
        self.files: list[_File] = []
        self._shard, self._out = -1, None

    def add(self, shard: int, page_id: str | None, member: bytes) -> None:
        if shard != self._shard or self.files[-1].records and self.files[-1].bytes + len(member) > self._roll:
            self._next(shard)
        f = self.files[-1]
        if f.bytes >= SPLIT_BYTES * (len(f.splits) + 1):
            f.splits.append(f.bytes)
        f.first, f.last = (page_id if not f.records else f.first), page_id
        f.records += 1
        self._put(member)

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self._hash.update(data)
        self.files[-1].bytes += len(data)

    def _next(self, shard: int) -> None:
        self.close()
        n = int(self.files[-1].name[6:11]) + 1 if shard == self._shard else 0
        name = f"{shard:05d}-{n:05d}.warc.gz"
        self._shard, self._hash = shard, hashlib.sha256()
        self.files.append(_File(f"{TEMPORARY}/{self._folder.rpartition('/')[2]}/{name}", name))
        self._out = self._fs.open_output_stream(f"{self._folder}/{name}", compression=None)  # members are compressed already
        info = f"software: {FORMAT}\r\nformat: WARC File Format 1.1\r\n".encode()
        self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, 0)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info, self._level))

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self.files[-1].sha256, self._out = self._hash.hexdigest(), None


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    files: list[_File]


class _Writer(DataSourceArrowWriter):
    """Takes rows sorted by shard, id, digest; a row without ``digest_of_page`` tells who holds a payload, and precedes its page."""

    def __init__(self, options: Mapping[str, str]):
        self._path, self._roll, self._level = options["path"], int(options.get("rollBytes", ROLL_BYTES)), int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt = uuid.uuid4().hex
        out = _Roller(self._path, attempt, self._roll, self._level)
        key: tuple | None = None
        nth, told = 0, None
        for batch in iterator:
            for shard, page_id, digest, is_page, first, url, payload in zip(*[batch[c].to_pylist() if c != "payload" else batch[c] for c in ("shard", "page_id", "digest", "is_page", "first", "url", "payload")]):
                if (page_id, digest) != key:
                    key, nth, told = (page_id, digest), 0, None
                if not is_page:
                    told = (first, record_id(first, digest, 0))
                    continue
                content = payload.as_py() or b""
                refers = told or ((page_id, record_id(page_id, digest, 0)) if nth and len(content) >= LEAST_REVISIT else None)
                out.add(shard, page_id, page_record(page_id, url, content, digest, nth, refers, self._level))
                nth += 1
        out.close()
        return _Written(attempt, out.files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _at(self._path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f.name)
        for f in files:
            store.move(f"{root}/{f.temporary}", f"{root}/{f.name}")
        lines = [{k: v for k, v in vars(f).items() if k != "temporary"} for f in files]
        with store.open_output_stream(f"{root}/{TEMPORARY}-{MANIFEST}") as out:
            out.write(json.dumps({"format": FORMAT, "files": lines}, indent=1).encode())
        store.move(f"{root}/{TEMPORARY}-{MANIFEST}", f"{root}/{MANIFEST}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_at(self._path))

    @staticmethod
    def _clear(store: Any, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{TEMPORARY}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{TEMPORARY}")


@dataclass
class _Stretch(InputPartition):
    name: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self._path, self._payloads = options["path"], options.get("payloads", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        """Stretches between borders of members, of the files that the manifest names."""
        return [_Stretch(f["name"], lo, hi) for f in manifest(self._path)["files"] for lo, hi in zip([0, *f["splits"]], [*f["splits"], f["bytes"]])]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are none
            return
        store, root = _at(self._path)
        rows, held = [], 0
        with store.open_input_file(f"{root}/{partition.name}") as f:
            for data in members(f, partition.start, partition.end):
                headers, block = parse(data)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                rows.append(_row(headers, block, self._payloads))
                held += len(block) if self._payloads else 0
                if len(rows) == 1000 or held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _KINDS)], list(_NAMES))


def members(f: Any, start: int, end: int) -> Iterator[bytes]:
    """Uncompressed gzip members between two places of a file, one after the other."""
    f.seek(start)
    left, data = end - start, b""
    while left or data:
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if not data:
                data = f.read(min(left, 1 << 20))
                left -= len(data)
                if not data:
                    raise ValueError("a record is cut off")
            parts.append(one.decompress(data))
            data = one.unused_data
        yield b"".join(parts)


class WarcSource(DataSource):
    """Options: ``path``; to write ``rollBytes``, ``level``; to read ``payloads`` (false leaves them out)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


# ---- plans ---------------------------------------------------------------------------


def manifest(path: str) -> dict[str, Any]:
    """The committed files of an archive: name, records, bytes, splits, first and last id, SHA-256."""
    store, root = _at(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def _key(page_id: str, digest: str) -> Column:
    """Orders by id, nulls last, then digest."""
    return F.struct(F.col(page_id).isNull().alias("no_id"), F.col(page_id).alias("page_id"), F.col(digest).alias("digest"))


def _shard(bounds: str, key: Column, most: int) -> Column:
    """How many of the sorted ``bounds`` are not above the key, by halving."""
    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
    open_ = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(F.col(bounds), mid) <= key
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(steps, open_, halve, lambda s: s["lo"])


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES, most_shards: int = MOST_SHARDS, roll_bytes: int = ROLL_BYTES, level: int = 6) -> None:
    """Writes an archive into the new folder ``path``, which driver and executors share."""
    spark = pages.sparkSession
    python_tasks(spark)
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    keyed = pages.select(F.col(page_id).alias("page_id"), F.sha2(payload, 256).alias("digest"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    facts = materialize(keyed.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "page-facts")
    total = facts.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    n_shards = max(1, min(most_shards, math.ceil(total["bytes"] / shard_bytes)))
    # keys that their own hash picks: about SAMPLE a shard, whatever the table's size and partitions
    picked = facts.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(max(1, total["n"] // (SAMPLE * n_shards)))) == 0).select(_key("page_id", "digest").alias("k")).distinct()
    sample = picked.agg(F.array_sort(F.collect_list("k")).alias("s"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(max(1, n_shards - 1))), lambda i: F.floor(i * F.size("s") / n_shards).cast("int")))
    bounds = sample.select(F.filter(F.transform(places, lambda i: F.get("s", i)), lambda k: k.isNotNull() & F.lit(n_shards > 1)).alias("bounds"))  # one row
    groups = facts.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    told = facts.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    markers = told.select("page_id", "digest", F.lit(False).alias("is_page"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    rows = keyed.select("page_id", "digest", F.lit(True).alias("is_page"), F.lit(None).cast(pages.schema[page_id].dataType).alias("first"), "url", "payload").unionByName(markers)
    dealt = rows.join(F.broadcast(bounds)).withColumn("shard", _shard("bounds", _key("page_id", "digest"), n_shards)).drop("bounds").repartitionById(n_shards, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "is_page", "url")
    texts = ordered.withColumns({"page_id": F.col("page_id").cast("string"), "first": F.col("first").cast("string")})
    texts.write.format(FORMAT).mode("append").options(path=path, rollBytes=str(roll_bytes), level=str(level)).save()


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of an archive, as in SCHEMA; payloads only of responses."""
    python_tasks(spark)
    spark.dataSource.register(WarcSource)
    return spark.read.format(FORMAT).options(path=path, payloads=str(payloads).lower()).load()


def apply(pages: DataFrame, path: str | None = None, **how: Any) -> DataFrame:
    """Writes an archive (by default into the cluster's shared folder) and returns its records without payloads, ids in the type of the pages'."""
    spark = pages.sparkSession
    at = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, at, **how)
    kind = pages.schema[how.get("page_id", "page_id")].dataType
    return read(spark, at, payloads=False).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "record_id", "target_uri")
