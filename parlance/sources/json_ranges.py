"""One huge JSON file, read by byte ranges and written by byte offsets (SC5, SC6, SK5).

Reading.  Where a range starts, two things are unknown: whether it lies inside
a string (and behind a backslash there), and how deep it is nested.  A first
pass gives, for each range and each of the three string states it may start in,
the state it ends in and the change of depth; these maps are composed along
the file, which leaves the true state at every start.  The second pass cuts
each range into elements.  A range owns the elements whose delimiter before
them it holds, and reads on past its end for the last of them, so every
element comes out once, and a lost task is simply read again.

Writing.  Entries are range-partitioned in their order and saved; byte sizes
give every entry its offset, and the tasks write the entries at their offsets
into one file of the final size.  A task that runs twice writes the same bytes
at the same places.  The file gets its name when all bytes are there.

Bounds: the driver holds nothing of the data.  Composing takes one narrow row a
range (``range_bytes``, 32 MB by default) of one file in one task.  An element
is one value and has to fit one task.

Defined cases: nulls in a written value are JSON null, a null key is an error;
no entries give the empty object; repeated keys stay repeated (at two levels
they share one array); an empty file has no elements; what is not JSON at the
levels that are cut raises.  Compressed files are not split and not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import carry_forward
from ..session import fresh_path, written

RANGE_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20        # bytes a task scans at once
PARENT_BLOCK = 4 << 20       # bytes of a file whose elements look their parent up together
MAX_TASKS = 20_000
PREFIX = 128                 # characters of a value that tell written ranges apart
STARTS = ((0, 0), (1, 0), (1, 1))   # (inside a string, behind an open backslash)
RANGE_SCHEMA = "path string, length long, block long"

_QUOTE, _BACKSLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_KEY = re.compile(r'\s*("(?:[^"\\]|\\.)*")\s*:\s*', re.S)
_HEADER = re.compile(r'[\s{}\[\],]*(?:("(?:[^"\\]|\\.)*")\s*:\s*)?', re.S)
_BOM = b"\xef\xbb\xbf"


def local_path(path: str) -> str | None:
    """The path on a mounted file system, None for any other kind of URI."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if re.match(r"[A-Za-z][\w+.-]*://", path) else path


def _open(path: str):
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _chunks(file, start: int, end: int | None, size: int):
    """(offset, bytes) from ``start`` to ``end`` (None: the end of the file)."""
    file.seek(start)
    while end is None or start < end:
        data = file.read(size if end is None else min(size, end - start))
        if not data:
            return
        yield start, data
        start += len(data)


def marks(data: bytes, inside: int, pending: int):
    """Places of the brackets and commas outside strings, their bytes, and the string state at the end."""
    b = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(b == _QUOTE)
    slashes = np.flatnonzero(b == _BACKSLASH)
    escaped, after = np.zeros(0, dtype=np.int64), 0
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        begin, length = slashes[first], np.diff(np.append(first, len(slashes)))
        odd = (length - ((begin == 0) & bool(pending))) % 2 == 1
        escaped = (begin + length)[odd]
        after = int(len(escaped) > 0 and escaped[-1] == len(b))
    if pending and b[0] != _BACKSLASH:
        escaped = np.append(0, escaped)
    elif pending and len(b) == 1:
        after = 0
    quotes = quotes[~np.isin(quotes, escaped)]
    folded = b | 0x20                      # [ and {, ] and } differ by this bit
    at = np.flatnonzero((folded == ord("{")) | (folded == ord("}")) | (b == _COMMA))
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    return at, b[at], (inside + len(quotes)) % 2, after


def _steps(kinds: np.ndarray) -> np.ndarray:
    return np.where(kinds == _COMMA, 0, np.where((kinds | 0x20) == ord("{"), 1, -1))


def _summaries(range_bytes: int, chunk: int):
    """Pass 1: end state (index into STARTS) and change of depth for each start state of a range."""
    def run(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                with _open(r.path) as f:
                    states, depth = list(STARTS), [0, 0, 0]
                    for _, data in _chunks(f, r.block * range_bytes, min(r.length, (r.block + 1) * range_bytes), chunk):
                        for i, (inside, pending) in enumerate(states):
                            _, kinds, inside, pending = marks(data, inside, pending)
                            states[i] = (inside, pending if inside else 0)
                            depth[i] += int(_steps(kinds).sum())
                yield pd.DataFrame({"path": [r.path], "length": [r.length], "block": [r.block],
                                    "ends": [[STARTS.index(s) for s in states]], "depths": [depth]})
    return run


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    """The state at each range's start, for one file: its ranges' maps composed in order."""
    rows = rows.sort_values("block")
    state, depth, at = 0, 0, []
    for ends, depths in zip(rows["ends"], rows["depths"]):
        at.append((state, depth))
        state, depth = int(ends[state]), depth + int(depths[state])
    if state or depth:
        raise ValueError(f"{rows['path'].iloc[0]}: JSON ends inside a string or with {depth} open brackets")
    return rows[["path", "length", "block"]].assign(state=[a[0] for a in at], depth=[a[1] for a in at])


def cut(file, start: int, end: int, state: int, depth: int, level: int, chunk: int):
    """(offset, is element, bytes) of each stretch between delimiters of ``level`` that the range owns."""
    inside, pending = STARTS[state]
    owned, element, begin, held = start == 0, False, 0, []
    for at, data in _chunks(file, start, None, chunk):
        places, kinds, inside, pending = marks(data, inside, pending)
        steps = _steps(kinds)
        after = depth + np.cumsum(steps)
        depth = int(after[-1]) if len(after) else depth
        if len(after) and after.min() < 0:
            raise ValueError(f"JSON closes a bracket that is not open before byte {at + len(data)}")
        hit = ((steps == 1) & (after == level)) | ((steps == -1) & (after == level - 1)) | ((steps == 0) & (after == level))
        last = 0
        for place, step in zip(places[hit].tolist(), steps[hit].tolist()):
            if owned:
                yield begin, element, b"".join(held) + data[last:place], step
            if at + place >= end:
                return
            owned, element, begin, held, last = True, step >= 0, at + place + 1, [], place + 1
        if owned:
            held.append(data[last:])
        elif at + len(data) >= end:
            return
    if owned:
        yield begin, element, b"".join(held), -1


def _elements(range_bytes: int, chunk: int, level: int):
    """Pass 2: rows (path, at, header, key, value); a header row opens a container of the level above."""
    def parsed(path, begin, element, raw, closes):
        text = (raw[len(_BOM):] if begin == 0 and raw.startswith(_BOM) else raw).decode("utf-8")
        if not element:
            ok = _HEADER.fullmatch(text) if level > 1 else not text.strip()
            if not ok:
                raise ValueError(f"{path}: no container at byte {begin}")
            name = json.loads(ok.group(1)) if level > 1 and ok.group(1) else None
            return (path, begin, name, None, None) if level > 1 else None
        if not text.strip():
            if closes >= 0:
                raise ValueError(f"{path}: no value at byte {begin}")
            return None
        key = _KEY.match(text)
        return (path, begin, None, json.loads(key.group(1), strict=False) if key else None,
                (text[key.end():] if key else text).strip())

    def run(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                out, size = [], 0
                with _open(r.path) as f:
                    for piece in cut(f, r.block * range_bytes, min(r.length, (r.block + 1) * range_bytes), r.state,
                                     r.depth, level, chunk):
                        row = parsed(r.path, *piece)
                        if row:
                            out.append(row)
                            size += len(piece[2])
                        if size > chunk:
                            yield pd.DataFrame(out, columns=["path", "at", "header", "key", "value"])
                            out, size = [], 0
                yield pd.DataFrame(out, columns=["path", "at", "header", "key", "value"])
    return run


def read_json_elements(spark: SparkSession, path: str, level: int = 1, range_bytes: int = RANGE_BYTES,
                       chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The elements of the top arrays or objects of JSON files of any size, indented or not.

    ``path`` (byte offset order: ``at``), ``key`` (null in an array) and ``value`` (JSON text) of each element.
    ``level=2`` gives the elements of the containers inside, with ``parent``, the key of their container.
    """
    if level not in (1, 2):
        raise ValueError("level is 1 or 2")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(
        (F.col("length") - 1) / F.lit(range_bytes)).cast("long"))))
    tasks = min(MAX_TASKS, max(1, files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1))
    seen = blocks.repartition(tasks).mapInPandas(
        _summaries(range_bytes, chunk_bytes), RANGE_SCHEMA + ", ends array<int>, depths array<long>")
    starts = seen.groupBy("path").applyInPandas(_compose, RANGE_SCHEMA + ", state int, depth long")
    rows = written(starts, "json-ranges").repartition(tasks).mapInPandas(
        _elements(range_bytes, chunk_bytes, level), "path string, at long, header string, key string, value string")
    if level == 1:
        return rows.drop("header")
    # array containers have no key: their header is null, so containers are carried as structs
    rows = rows.withColumn("opened", F.when(F.col("value").isNull(), F.struct("header")))
    rows = carry_forward(rows, ["path"], "at", "opened", "container", block_size=PARENT_BLOCK)
    return rows.where("value is not null").select("path", "at", F.col("container.header").alias("parent"), "key", "value")


# ------------------------------------------------------------------ writing

def _json_string(c: Column) -> Column:
    as_array = F.to_json(F.array(c.cast("string")))
    return F.substring(as_array, F.lit(2), F.length(as_array) - 2)


def write_json_object(df: DataFrame, key: str, value: str, order: list[str] | None = None, arrays: bool = False,
                      path: str | None = None) -> str:
    """SK5: one JSON file, one object: ``{key: value, ...}`` in the order of ``order`` (default: the key).

    ``value`` holds JSON text.  ``arrays``: ``{key: [value, ...], ...}``, keys in order, a key's values in the order of
    ``order``.  The folder must be mounted by all executors (a shared ``spark.checkpoint.dir`` is).
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "object") + ".json"
    target = local_path(path)
    if target is None:
        raise ValueError(f"{path}: offsets can be written on a mounted folder only")
    order = list(order or [])
    k = F.coalesce(F.col(key).cast("string"), F.raise_error(F.lit("a JSON key is null")).cast("string"))
    by = ["k", "o", "v"] if arrays or not order else ["o", "k", "v"]
    rows = df.select(k.alias("k"), F.struct(*[F.col(c) for c in order] or [F.lit(0)]).alias("o"),
                     F.coalesce(F.col(value).cast("string"), F.lit("null")).alias("v"))
    # a range's rows get their number where they lie sorted; equal rows may change places.  The driver sees a sample of
    # what the ranges go by: a value's beginning, whose order is the values' own, never whole values
    ranges = [F.substring("v", 1, PREFIX) if c == "v" else F.col(c) for c in by]
    parts = written(rows.repartitionByRange(*ranges).withColumn("p", F.spark_partition_id()), "object-rows")
    w = Window.partitionBy("p").orderBy(*by)
    nth = parts.select("p", "k", "v", F.row_number().over(w).alias("nth"), F.lag("k").over(w).alias("before"))
    ends = parts.groupBy("p").agg(F.max_by("k", F.struct(*by)).alias("last"))
    prior = ends.select("p", F.lag("last").over(Window.orderBy("p")).alias("last_before"))   # one row a range
    x = nth.join(prior, "p").withColumn("before", F.coalesce("before", "last_before"))
    name = _json_string(F.col("k"))
    if arrays:
        lead = (F.when(F.col("before").isNull(), F.concat(F.lit("{\n"), name, F.lit(": [\n")))
                .when(F.col("before") != F.col("k"), F.concat(F.lit("\n],\n"), name, F.lit(": [\n"))).otherwise(F.lit(",\n")))
    else:
        lead = F.concat(F.when(F.col("before").isNull(), F.lit("{\n")).otherwise(F.lit(",\n")), name, F.lit(": "))
    pieces = written(x.select("p", "nth", F.concat(lead, "v").alias("piece")), "object-pieces")
    size = F.octet_length("piece").cast("long")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("p").agg(F.sum(size).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0]
    tail = b"{}" if total is None else (b"\n]\n}" if arrays else b"\n}")
    total = total or 0
    offsets = sizes.select("p", F.coalesce(F.sum("size").over(until(Window.orderBy("p"))), F.lit(0)).alias("off"))
    placed = pieces.withColumn("inner", F.coalesce(F.sum(size).over(until(Window.partitionBy("p").orderBy("nth"))), F.lit(0)))
    placed = placed.join(offsets, "p").select((F.col("off") + F.col("inner")).alias("at"), "piece")
    part = f"{target}.{uuid.uuid4().hex[:8]}.part"
    os.makedirs(os.path.dirname(part), exist_ok=True)
    with open(part, "wb") as f:
        f.truncate(total + len(tail))
        f.seek(total)
        f.write(tail)

    def put(batches):
        done = 0
        with open(part, "r+b", buffering=1 << 20) as f:
            for rows in batches:
                for at, piece in zip(rows["at"], rows["piece"]):
                    raw = piece.encode("utf-8")
                    if f.tell() != at:
                        f.seek(at)
                    done += f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        yield pd.DataFrame({"bytes": [done]})

    got = placed.mapInPandas(put, "bytes long").agg(F.sum("bytes")).first()[0] or 0
    if got != total:
        raise IOError(f"{path}: {got} of {total} bytes written")
    os.replace(part, target)
    return path
