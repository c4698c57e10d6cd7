"""Feature collections of any size: one JSON object whose member ``features`` is read by many tasks.

A collection is one value, so a place in its middle says nothing by itself: a brace may stand in a text, and depth is counted from the
file's beginning. So it is gone through twice. First every byte range tells, for each state it may begin in (outside a text, in one, after
a backslash in one), the state it ends in, by how much the depth changes, and where the member may begin; put together in order, a few
numbers a range, this gives the true state and depth of each. Then a data source, whose partitions are these ranges, emits the
features that begin in its range, the last of them read beyond the range's end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

OUTSIDE, TEXT, ESCAPED = 0, 1, 2
#: Bytes of a range, of a further read, and of the features of a batch.
RANGE_BYTES, READ_BYTES, BATCH_BYTES = 16 << 20, 1 << 20, 4 << 20
#: Bytes over which the member's name, its colon and its bracket may be spread.
LOOK_BEHIND = 4096
_SIGN = np.zeros(256, np.int8)
_SIGN[[ord("{"), ord("[")]], _SIGN[[ord("}"), ord("]")]] = 1, -1


def open_file(uri: str):
    """(file system, path) of a path or address as Spark lists it."""
    from pyarrow import fs

    uri = re.sub("^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if re.match("[a-z0-9]+:/", uri) else f"file://{uri}")


class Structure:
    """Braces and brackets of a stretch of JSON that begins in a state: ``at``, ``sign`` (1 opens, -1 closes) and ``depth`` after each, from 0; ``end`` is the state it ends in."""

    def __init__(self, data: np.ndarray, state: int):
        skip = 1 if state == ESCAPED and len(data) else 0
        quotes = np.flatnonzero(data == ord('"'))
        slashes = np.flatnonzero(data == ord("\\"))
        quotes, slashes = quotes[quotes >= skip], slashes[slashes >= skip]
        # the length of the run of backslashes that ends with each
        new = np.diff(slashes, prepend=-2) != 1
        run = np.arange(len(slashes)) - np.maximum.accumulate(np.where(new, np.arange(len(slashes)), 0)) + 1 if len(slashes) else slashes
        odd = slashes[run % 2 == 1] if len(slashes) else slashes
        self.quotes = quotes[~np.isin(quotes - 1, odd)]
        self.inside = int(state != OUTSIDE)
        signs = _SIGN[data]
        at = np.flatnonzero(signs)
        at = at[(at >= skip) & ~self.in_text(at)]
        self.at, self.sign = at, signs[at]
        self.depth = np.cumsum(self.sign, dtype=np.int64)
        within = (self.inside + len(self.quotes)) % 2 == 1
        self.end = OUTSIDE if not within else ESCAPED if len(odd) and odd[-1] == len(data) - 1 else TEXT
        if state == ESCAPED and not len(data):
            self.end = ESCAPED

    def in_text(self, at: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.quotes, at) + self.inside) % 2 == 1


def summary(data: np.ndarray, behind: bytes, member: str) -> list[dict]:
    """For each state a range may begin in: end, depth it adds, least depth, and ``found``: where the member's list may begin, the depth before it, and the least depth after.

    behind are the bytes before the range, in which the member's name may stand.
    """
    raw = behind + data.tobytes()
    brackets = []
    for m in re.finditer(rf'"{re.escape(member)}"\s*:\s*\['.encode(), raw):
        slashes = m.start() - len(raw[: m.start()].rstrip(b"\\"))
        if m.end() > len(behind) and slashes % 2 == 0:
            brackets.append(m.end() - 1 - len(behind))
    out = []
    for state in (OUTSIDE, TEXT, ESCAPED):
        s = Structure(data, state)
        places = [(at, int(np.searchsorted(s.at, at))) for at in brackets]
        found = [{"at": at, "depth": int(s.depth[n]) - 1, "low": int(s.depth[n:].min())} for at, n in places if n < len(s.at) and s.at[n] == at]
        out.append({"end": s.end, "adds": int(s.depth[-1]) if len(s.at) else 0, "low": int(s.depth.min()) if len(s.at) else 0, "found": found})
    return out


def ranges_of(lengths: list[tuple[str, int]], size: int) -> list[tuple[str, int, int]]:
    return [(path, a, min(a + size, length)) for path, length in lengths for a in range(0, length, size)]


def aligned(ranges: list[tuple[str, int, int]], summaries: list[list[dict]]) -> list[dict]:
    """The ranges with features, each with the state and depth it begins with and where the list begins. A file that does not end as it should gives none."""
    out: list[dict] = []
    done = 0
    while done < len(ranges):
        path = ranges[done][0]
        state, depth, begins, open_list, mine = OUTSIDE, 0, None, False, []
        while done < len(ranges) and ranges[done][0] == path:
            _, a, b = ranges[done]
            s = summaries[done][state]
            low = depth + s["low"]
            if begins is None:
                for f in s["found"]:
                    if depth + f["depth"] == 1:
                        begins, open_list, low = a + f["at"], True, depth + f["low"]
                        break
            if open_list:
                mine.append({"path": path, "start": a, "end": b, "state": state, "depth": depth, "from": begins})
                open_list = low >= 2
            state, depth, done = s["end"], depth + s["adds"], done + 1
        if state == OUTSIDE and depth == 0:
            out += mine
    return out


def features_in(stream, part: dict) -> Iterator[bytes]:
    """The features that begin in a range."""
    stream.seek(part["start"])
    raw = stream.read(part["end"] - part["start"])
    s = Structure(np.frombuffer(raw, np.uint8), part["state"])
    depth = s.depth + part["depth"]
    live = s.at > part["from"] - part["start"]
    closed = np.flatnonzero(live & (depth < 2))
    last = closed[0] if len(closed) else len(depth)
    index = np.arange(len(depth))
    opens = np.flatnonzero(live & (index < last) & (s.sign == 1) & (depth == 3))
    ends = np.flatnonzero((s.sign == -1) & (depth == 2))
    match = np.searchsorted(ends, opens)
    for n, m in zip(opens.tolist(), match.tolist()):
        if m < len(ends):
            if raw[s.at[n]] == ord("{"):
                yield raw[s.at[n] : s.at[ends[m]] + 1]
            continue
        text, state, now = [raw[s.at[n] :]], s.end, int(depth[-1])
        while more := stream.read(READ_BYTES):
            t = Structure(np.frombuffer(more, np.uint8), state)
            stop = np.flatnonzero(t.depth + now == 2)
            if len(stop):
                text.append(more[: t.at[stop[0]] + 1])
                if text[0][:1] == b"{":
                    yield b"".join(text)
                break
            text.append(more)
            state, now = t.end, now + (int(t.depth[-1]) if len(t.depth) else 0)
        return


class _Range(InputPartition):
    pass


class FeatureReader(DataSourceReader):
    def __init__(self, plan: str):
        self.plan = plan

    def partitions(self) -> list[InputPartition]:
        return [_Range(p) for p in json.loads(self.plan)] or [_Range(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, path = open_file(partition.value["path"])
        with fs.open_input_file(path) as stream:
            held, size = [], 0
            for text in features_in(stream, partition.value):
                held.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([t.decode("utf-8", "replace") for t in held])})
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pydict({"value": pa.array([t.decode("utf-8", "replace") for t in held])})


class FeatureSource(DataSource):
    """``value``: the text of each element of the member that the ranges of option ``plan`` have."""

    @classmethod
    def name(cls) -> str:
        return "cityloom_features"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeatureReader(self.options["plan"])


def plan(spark: SparkSession, path: str, member: str = "features", size: int = RANGE_BYTES) -> list[dict]:
    """The ranges of all collections under path (a file, a folder, a pattern), aligned. What comes to the driver is a few numbers for each range."""
    found = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()
    ranges = ranges_of([(r["path"], r["length"]) for r in found if r["length"]], size)
    if not ranges:
        return []

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, where, a, b in zip(*(batch.column(c).to_pylist() for c in ("n", "path", "a", "b"))):
                fs, file = open_file(where)
                with fs.open_input_file(file) as stream:
                    stream.seek(max(0, a - LOOK_BEHIND))
                    behind, data = stream.read(min(a, LOOK_BEHIND)), stream.read(b - a)
                yield pa.RecordBatch.from_pydict({"n": [n], "told": [json.dumps(summary(np.frombuffer(data, np.uint8), behind, member))]})

    asked = spark.createDataFrame([(n, *r) for n, r in enumerate(ranges)], "n long, path string, a long, b long").repartitionByRange(len(ranges), "n")
    told = {r["n"]: json.loads(r["told"]) for r in asked.mapInArrow(look, "n long, told string").collect()}
    return aligned(ranges, [told[n] for n in range(len(ranges))])


def read_features(spark: SparkSession, path: str, schema: str, member: str = "features", size: int = RANGE_BYTES) -> DataFrame:
    """``f``: the elements of the member ``features`` of all collections under path, as the struct that schema (DDL) tells.

    Files that are no such collection, or end too early, give no row. Elements that are no objects are left out; one that does not fit the schema has nulls.
    """
    spark.dataSource.register(FeatureSource)
    rows = spark.read.format(FeatureSource.name()).option("plan", json.dumps(plan(spark, path, member, size))).load()
    return rows.select(F.from_json("value", StructType.fromDDL(schema)).alias("f"))
