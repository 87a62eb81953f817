"""One large JSON object keyed by id, read in splits of its bytes.

Where a split begins, neither the depth nor whether a string is open can be seen from its bytes alone.  So every split is
first scanned under each state that it may begin in; the states that they end in, a small row a split, are chained on the
driver, and then each split knows how it begins.  An entry belongs to the split that holds the brace or comma before it,
whose task reads on behind its end as far as the entry goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a split, unless said otherwise.
SPLIT = 64 << 20
#: What changes the state, outside UTF-8 sequences; a backslash takes the byte behind it along.
_MARKS = re.compile(rb"\\(?:.|$)|[\"{}\[\],]", re.DOTALL)

State = tuple[bool, bool, int]  # the next byte is escaped, a string is open, depth


def _steps(data: bytes, state: State) -> Iterator[tuple[int, bytes, State]]:
    """(place, mark, state behind it) of the marks in ``data`` outside strings, and of its end with an empty mark."""
    escaped, string, depth = state
    at = 1 if escaped and data else 0
    escaped = escaped and not data
    for m in _MARKS.finditer(data, at):
        mark = m.group()
        if mark[:1] == b"\\":
            escaped = len(mark) == 1
        elif mark == b'"':
            string = not string
        elif not string:
            depth += (mark in b"{[") - (mark in b"}]")
            yield m.start(), mark, (False, False, depth)
    yield len(data), b"", (escaped, string, depth)


def _read(path: str, at: int, size: int) -> bytes:
    system, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    with system.open_input_file(name) as file:
        file.seek(at)
        return file.read(size)


def _entries(path: str, at: int, size: int, state: State) -> Iterator[str]:
    """The entries whose brace or comma is in the ``size`` bytes from ``at``."""
    held, begun, base = b"", None, at
    while True:
        data = _read(path, base, size if base == at else 1 << 16)
        end = state
        for place, mark, end in _steps(data, state):
            closes, parts = mark == b"}" and end[2] == 0, mark == b"," and end[2] == 1
            if begun is not None and (closes or parts):
                entry = (held + data[begun:place]).decode()
                if entry.strip():
                    yield entry
                held, begun = b"", None
            if (parts or mark == b"{" and end[2] == 1) and base == at:
                begun = place + 1
            elif begun is None and base > at:
                return
        if begun is None:
            return
        if not data:
            raise ValueError(f"{path} ends inside an object")
        held, begun, base, state = held + data[begun:], 0, base + len(data), end


def read_in_splits(spark: SparkSession, path: str, value: str, key: str = "track_id", split: int = SPLIT) -> DataFrame:
    """A JSON object keyed by id as rows: the id as ``key``, then the fields of ``value`` (a struct type), as
    ``readers.read_keyed_document`` gives them, with the file read in splits by as many tasks.

    The path is one that Arrow's file systems read.  Braces, quotes and backslashes in strings are part of them; a value that
    does not fit, an object that does not end, and a file that holds none are errors.
    """
    system, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    length = system.get_file_info(name).size
    places = spark.createDataFrame([(at,) for at in range(0, length, split)], "at long").repartition(max(1, -(-length // split)), "at")
    starts = list(product((False, True), (False, True)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["at"]:
                data = _read(path, at, split)
                for escaped, string in starts:
                    end = (escaped, string, 0)
                    for _, _, end in _steps(data, end):
                        pass
                    yield pd.DataFrame({"at": [at], "e": [escaped], "s": [string], "end_e": [end[0]], "end_s": [end[1]], "depth": [end[2]]})

    scanned = {(r["at"], r["e"], r["s"]): (r["end_e"], r["end_s"], r["depth"]) for r in places.mapInPandas(scan, "at long, e boolean, s boolean, end_e boolean, end_s boolean, depth long").collect()}
    state, known = (False, False, 0), []
    for at in range(0, length, split):
        known.append((at, *state))
        escaped, string, more = scanned[at, state[0], state[1]]
        state = (escaped, string, state[2] + more)
    if state != (False, False, 0) or not re.match(rb"\s*\{", _read(path, 0, 1 << 16)):
        raise ValueError(f"{path} does not hold one JSON object")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, escaped, string, depth in batch.itertuples(index=False):
                yield pd.DataFrame({"entry": ["{" + e + "}" for e in _entries(path, at, split, (bool(escaped), bool(string), int(depth)))]}, dtype=object)

    dealt = spark.createDataFrame(known, "at long, escaped boolean, string boolean, depth long").repartition(max(1, len(known)), "at")
    entries = dealt.mapInPandas(run, "entry string")
    rows = entries.select(F.explode(F.from_json("entry", f"map<string, {value}>", {"mode": "FAILFAST"})).alias(key, "label"))
    return rows.select(F.col(key).cast("long").alias(key), "label.*")
