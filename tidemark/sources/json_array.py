"""Records of exports that hold them in one large JSON array, read in byte ranges (inventory S2, S5 at scale).

A byte range does not tell whether it starts inside a string, behind a backslash, or how deep.
So each range first states where it would lead from every possible start (:func:`transitions`);
composing these from range to range gives each range's true start (:func:`starts`), and with it
every range cuts out, by itself, the records that begin in it, reading on past its end for
the last one. No task holds more than a range and a record. Between the steps only a small row a range moves.

Ranges are read by the workers, from any file system that Arrow knows (local, HDFS, S3, GCS).
An empty file, an absent collection, or a collection that is no array has no records. Items
that are no objects are dropped before records are numbered. A file that ends inside a
string, or with brackets left open or closed too often, or with a record that does not parse, is a row of
:func:`faults`; what stands between records is not judged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

#: Bytes of a range, and most tasks of a pass.
RANGE_BYTES, TASKS = 16 << 20, 20_000
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_REST = rb'[^"\\]*+(?:\\.[^"\\]*+)*+"'  # of a string, to its closing quote
_STRING = re.compile(b'"' + _REST, re.S)
_END = re.compile(_REST, re.S)
_TOKEN = re.compile(rb"[{}\[\]]|" + b'"' + rb"(?:" + _REST + rb")?+", re.S)
_BLANK = b" \t\n\r"
_BOM = b"\xef\xbb\xbf"


# ---- bytes ---------------------------------------------------------------------------


def _escaped(tail: bytes) -> int:
    """State at the end of an open string: behind an odd number of backslashes the next byte is escaped."""
    return ESCAPED if (len(tail) - len(tail.rstrip(b"\\"))) % 2 else INSIDE


def transition(data: bytes, state: int) -> tuple[int, int]:
    """The state after ``data`` that starts in ``state``, and by how much it gets deeper."""
    if not data:
        return state, 0
    if state == ESCAPED:
        return transition(data[1:], INSIDE)
    if state == INSIDE:
        end = _END.match(data)
        return transition(data[end.end() :], OUTSIDE) if end else (_escaped(data), 0)
    plain = _STRING.sub(b"", data)
    plain, quote, tail = plain.partition(b'"')
    return _escaped(tail) if quote else OUTSIDE, plain.count(b"{") + plain.count(b"[") - plain.count(b"}") - plain.count(b"]")


class _Bytes:
    """A range of a file that can be read on past its end."""

    def __init__(self, f: Any, lo: int, hi: int, length: int):
        self._f, self.lo, self.length = f, lo, length
        self.data = f.read_at(hi - lo, lo)
        self.n = len(self.data)

    def more(self) -> bool:
        """Appends as much again; False at the end of the file."""
        at = self.lo + len(self.data)
        if at >= self.length:
            return False
        self.data += self._f.read_at(max(4096, min(len(self.data), 1 << 20)), at)
        return True

    def skip(self, state: int) -> int | None:
        """The place behind the string in which the range starts; None if it covers the range."""
        if state == OUTSIDE:
            return 0
        end = _END.match(self.data, 1 if state == ESCAPED else 0)
        return end.end() if end and end.end() <= self.n else None

    def tokens(self, at: int) -> Iterator[tuple[int, int, bytes]]:
        """Place, end and first byte of every bracket and string from ``at`` on, to the end of the file as far as it is asked for."""
        while True:
            data = self.data
            for m in _TOKEN.finditer(data, at):
                if m.end() - m.start() == 1 and m[0] == b'"':  # an open string: read on and look again
                    at = m.start()
                    break
                at = m.end()
                yield m.start(), m.end(), m[0][:1]
            else:
                at = len(data)
            if len(self.data) == len(data) and not self.more():
                return


def cut(b: _Bytes, state: int, depth: int, level: int) -> Iterator[tuple[int, bytes]]:
    """Offset and text of the objects that begin in the range, as items of an array that is ``level`` brackets deep."""
    if (at := b.skip(state)) is None:
        return
    begun = None
    for start, end, kind in b.tokens(at):
        if begun is None and start >= b.n:
            return
        if kind in b"{[":
            if kind == b"{" and depth == level:
                begun = start
            depth += 1
        elif kind in b"}]":
            depth -= 1
            if begun is not None and depth == level:
                yield b.lo + begun, b.data[begun:end]
                begun = None


def marks(b: _Bytes, state: int, depth: int, collection: str) -> Iterator[tuple[int, bool]]:
    """Offsets, in the range, of brackets under the root object: where an array named ``collection`` opens (True), and where any list closes (False)."""
    if (at := b.skip(state)) is None:
        return
    for start, end, kind in b.tokens(at):
        if start >= b.n:
            return
        if kind == b'"':
            if depth == 1 and len(b.data) - end < 4096:
                b.more()
            if depth == 1 and (follows := re.compile(rb"[ \t\n\r]*:[ \t\n\r]*\[").match(b.data, end)) and json.loads(b.data[start:end]) == collection:
                yield b.lo + follows.end() - 1, True
        elif kind in b"{[":
            depth += 1
        else:
            depth -= 1
            if kind == b"]" and depth == 1:
                yield b.lo + start, False


# ---- plans ---------------------------------------------------------------------------


def _open(path: str) -> Any:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(at)


def ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """``path, length, lo, hi`` of every range of the files at ``path``, dealt over tasks. Files are listed, not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    out = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("lo"))
    tasks = files.agg(F.sum(F.ceil(F.col("length") / size)).alias("n")).first()["n"] or 1
    return out.withColumn("hi", F.least(F.col("lo") + size, "length")).repartition(int(min(tasks, TASKS)), "path", "lo")  # a fixed number, as rows this small would be put together


def transitions(parts: DataFrame) -> DataFrame:
    """Adds ``end0, deeper0`` to ``end2, deeper2``: state and depth gained from each start state, and ``first``: the first byte that is not blank."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    data = f.read_at(r["hi"] - r["lo"], r["lo"])
                found = {k: v for s in (OUTSIDE, INSIDE, ESCAPED) for k, v in zip((f"end{s}", f"deeper{s}"), transition(data, s))}
                rows.append(r | found | {"first": chr(x[0]) if (x := data.lstrip(_BLANK + (_BOM if r["lo"] < len(_BOM) else b""))[:1]) else None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    numbers = [f"{x}{s}" for s in (OUTSIDE, INSIDE, ESCAPED) for x in ("end", "deeper")]
    schema = pa.schema([("path", pa.string()), *[(x, pa.int64()) for x in ("length", "lo", "hi", *numbers)], ("first", pa.string())])
    return parts.mapInArrow(told, "path string, length long, lo long, hi long, " + ", ".join(f"{x} long" for x in numbers) + ", first string")


def starts(steps: DataFrame) -> DataFrame:
    """``path, length, lo, hi, state, depth`` at which each range starts, ``root`` (the file's first byte) and whether the file ends ``balanced``: transitions composed in order. A file's rows are one small group: one a range."""

    def compose(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["lo"])
        root, state, depth, sunk = next((r["first"] for r in rows if r["first"]), None), OUTSIDE, 0, False
        for r in rows:
            r |= {"state": state, "depth": depth, "root": root}
            state, depth = r[f"end{state}"], depth + r[f"deeper{state}"]
            sunk |= depth < 0
        ok = state == OUTSIDE and depth == 0 and not sunk
        return pa.Table.from_pylist([{k: v for k, v in r.items() if k in names} | {"balanced": ok} for r in rows], schema=schema)

    names = ("path", "length", "lo", "hi", "state", "depth", "root")
    schema = pa.schema([("path", pa.string()), *[(x, pa.int64()) for x in names[1:6]], ("root", pa.string()), ("balanced", pa.bool_())])
    return steps.groupBy("path").applyInArrow(compose, "path string, length long, lo long, hi long, state long, depth long, root string, balanced boolean")


def _located(found: DataFrame, collection: str) -> DataFrame:
    """``path, open, close``: the offsets between which records of the root object's collection stand; of repeated names the last counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    rows += [(r["path"], at, opens) for at, opens in marks(_Bytes(f, r["lo"], r["hi"], r["length"]), r["state"], r["depth"], collection)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.bool_()))], ["path", "at", "opens"])

    seen = written(found.where("root = '{'").mapInArrow(scan, "path string, at long, opens boolean"), "marks")
    opened = seen.where("opens").groupBy("path").agg(F.max("at").alias("open"))
    return opened.join(seen.where("not opens"), "path").where("at > open").groupBy("path", "open").agg(F.min("at").alias("close"))


def _texts(spark: SparkSession, path: str, collection: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The ranges with their true starts, and ``path, lo, nth, at, text`` of the records; both written once."""
    found = written(starts(transitions(ranges(spark, path, size))), "starts")
    if collection == "$":
        todo = found.where("root = '['").withColumns({"level": F.lit(1), "open": F.lit(-1).cast("long"), "close": F.col("length")})
    else:
        todo = found.join(_located(found, collection), "path").withColumn("level", F.lit(2))
    todo = todo.where("hi > open and lo < close").repartition(max(1, min(TASKS, found.count())), "path", "lo")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with _open(r["path"]) as f:
                    whole = ((at, text) for at, text in cut(_Bytes(f, r["lo"], r["hi"], r["length"]), r["state"], r["depth"], r["level"]) if r["open"] < at < r["close"])
                    for nth, (at, text) in enumerate(whole):
                        rows.append((r["path"], r["lo"], nth, at, text.decode("utf-8", "replace")))
                        held += len(text)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "lo", "nth", "at", "text"])
    return found, written(todo.mapInArrow(scan, "path string, lo long, nth long, at long, text string"), "records")


def read(spark: SparkSession, path: str, collection: str = "$", size: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Records as ``path, idx, body`` (VARIANT), numbered in the file's order, and ``path, error`` of faulty files, whose records are left out.

    ``collection``: ``$`` for a root array, else the name of an array in the root object.
    """
    found, texts = _texts(spark, path, collection, size)
    before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = texts.groupBy("path", "lo").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    bodies = texts.join(counts, ["path", "lo"]).select("path", (F.col("start") + F.col("nth")).alias("idx"), F.try_parse_json("text").alias("body"))
    faulty = found.where("not balanced or root not in ('{', '[')").select("path").union(bodies.where("body is null").select("path")).distinct()
    faults = faulty.select("path", F.lit("not valid JSON").alias("error"))
    return bodies.join(faulty, "path", "left_anti"), faults
