"""Remote stores as Spark data sources: paged and scrolled scans with pushed filters, streams of what is new, and writes in bounded requests."""

from __future__ import annotations

import json
import os
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from examloom.hooks import WAITS, with_retries

#: Fetchers by name: (cursor or None, options) to (rows, next cursor or None).
FETCHERS: dict[str, Callable[[str | None, dict], tuple[list[tuple], str | None]]] = {}


def pages(fetch: Callable[[str | None, dict], tuple[list[tuple], str | None]], options: dict) -> Iterator[tuple]:
    """Rows of all pages, until there is no next cursor; a null in place of a row ends the scan with a warning."""
    cursor = None
    while True:
        rows, cursor = fetch(cursor, options)
        for row in rows:
            if row is None:
                warnings.warn(f"the scan ends at a null row before {cursor}", stacklevel=2)
                return
            yield row
        if not cursor:
            return


class _Key(InputPartition):
    def __init__(self, key: str) -> None:
        self.key = key


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch) -> None:
        self.options, self.fetch = options, fetch

    def partitions(self):
        return [_Key(k) for k in self.options.get("keys", "").split(",")]

    def read(self, partition):
        yield from pages(self.fetch, dict(self.options) | {"key": partition.key})


def paged_source(name: str, schema: str, fetch) -> type[DataSource]:
    """A data source class to register; each of the option keys (comma-separated) is one partition."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return _Reader(dict(self.options), fetch)

    return Paged


# Scrolling: a store whose points have a whole number as key and are scrolled in its order.


class Store:
    """What a scrolled or written store does; a client of a real one has the same methods, and must be picklable."""

    def columns(self) -> str:
        """The points' schema as DDL."""
        raise NotImplementedError

    def bounds(self) -> tuple[int, int] | None:
        """Smallest and largest key, None of an empty store."""
        raise NotImplementedError

    def scroll(self, after: int, upto: int, size: int, where: list[tuple]) -> tuple[list[tuple | None], int | None]:
        """At most so many points with after < key <= upto, in order of the key, for which all (column, operator, value) hold; and the key to go on from, None at the end."""
        raise NotImplementedError


class ParquetStore(Store):
    """A stand-in for a remote store: a Parquet table that is read page by page."""

    def __init__(self, path: str, key: str) -> None:
        self.path, self.key = path, key

    def _data(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path.removeprefix("file:"))

    def columns(self) -> str:
        from pyspark.sql.pandas.types import from_arrow_schema

        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_arrow_schema(self._data().schema))

    def bounds(self) -> tuple[int, int] | None:
        import pyarrow.compute as pc

        keys = self._data().to_table(columns=[self.key]).column(0)
        least, most = pc.min_max(keys).values()
        return None if not least.is_valid else (least.as_py(), most.as_py())

    def scroll(self, after, upto, size, where):
        import pyarrow.compute as pc

        k = pc.field(self.key)
        keep = (k > after) & (k <= upto)
        compare = {"=": lambda c, v: c == v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}
        for column, op, value in where:
            keep &= compare[op](pc.field(column), value)
        data = self._data()
        keys = sorted(data.to_table(columns=[self.key], filter=keep).column(0).to_pylist())[: size + 1]
        more = len(keys) > size
        keys = keys[:size]
        if not keys:
            return [], None
        rows = data.to_table(filter=keep & (k >= keys[0]) & (k <= keys[-1])).sort_by(self.key)
        return [tuple(r.values()) for r in rows.to_pylist()], keys[-1] if more else None


@dataclass
class _Range(InputPartition):
    after: int
    upto: int


def _cut(after: int, upto: int, parts: int) -> list[_Range]:
    """Ranges of keys of about equal width."""
    width = max(1, -(-(upto - after) // parts))
    return [_Range(a, min(a + width, upto)) for a in range(after, upto, width)]


_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Scroll:
    """Reads ranges of keys, page by page, with retries."""

    def __init__(self, store: Store, size: int, where: list[tuple], waits: tuple[float, ...]) -> None:
        self.store, self.size, self.where, self.waits = store, size, where, waits

    def read(self, partition: _Range) -> Iterator[tuple]:
        def fetch(cursor, _options):
            after = partition.after if cursor is None else int(cursor)
            rows, end = with_retries(lambda: self.store.scroll(after, partition.upto, self.size, self.where), self.waits)
            return rows, None if end is None else str(end)

        yield from pages(fetch, {})


class _ScrollReader(DataSourceReader):
    def __init__(self, store: Store, key: str, parts: int, size: int, waits: tuple[float, ...]) -> None:
        self.store, self.key, self.parts, self.size, self.waits, self.where = store, key, parts, size, waits, []

    def pushFilters(self, filters):
        """Comparisons with constants go to the store; those on the key also narrow the ranges that are scrolled."""
        for f in filters:
            op = _OPERATORS.get(type(f))
            if op and len(f.attribute) == 1 and isinstance(f.value, int | float | str) and not isinstance(f.value, bool):
                self.where.append((f.attribute[0], op, f.value))
            else:
                yield f

    def partitions(self):
        found = self.store.bounds()
        if found is None:
            return [_Range(0, 0)]
        least, most = found
        for column, op, value in self.where:
            if column == self.key and isinstance(value, int):
                least = max(least, value + (op == ">")) if op in ("=", ">", ">=") else least
                most = min(most, value - (op == "<")) if op in ("=", "<", "<=") else most
        return _cut(least - 1, most, self.parts) or [_Range(0, 0)]

    def read(self, partition):
        return _Scroll(self.store, self.size, self.where, self.waits).read(partition)


class _ScrollStream(DataSourceStreamReader):
    """Offsets are keys: a batch is what has come with keys above the last one's."""

    def __init__(self, store: Store, parts: int, size: int, waits: tuple[float, ...]) -> None:
        self.store, self.parts, self.size, self.waits = store, parts, size, waits

    def initialOffset(self):
        found = self.store.bounds()
        return {"after": 0 if found is None else found[0] - 1}

    def latestOffset(self):
        found = self.store.bounds()
        return {"after": 0 if found is None else found[1]}

    def partitions(self, start, end):
        return _cut(start["after"], end["after"], self.parts) or [_Range(0, 0)]

    def read(self, partition):
        return _Scroll(self.store, self.size, [], self.waits).read(partition)

    def commit(self, end):
        pass


def scrolled_source(name: str, key: str, store: Callable[[dict], Store], waits: tuple[float, ...] = WAITS) -> type[DataSource]:
    """A data source class over a store made from the options; ranges says how many partitions there are, size how many points a page has."""

    class Scrolled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def _store(self) -> Store:
            return store(dict(self.options))

        def schema(self) -> str:
            return self._store().columns()

        def _sizes(self) -> tuple[int, int]:
            return int(self.options.get("ranges", 8)), int(self.options.get("size", 128))

        def reader(self, schema):
            return _ScrollReader(self._store(), key, *self._sizes(), waits)

        def streamReader(self, schema):
            return _ScrollStream(self._store(), *self._sizes(), waits)

    return Scrolled


# Writing: points are staged in requests of bounded bytes and published together.


class FolderSink:
    """A stand-in for a store that takes points: requests are files of JSON lines, staged by token and published by renaming."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.removeprefix("file:")

    def stage(self, token: str, number: int, body: bytes) -> None:
        os.makedirs(f"{self.folder}/staged/{token}", exist_ok=True)
        with open(f"{self.folder}/staged/{token}/{number:06d}.json", "wb") as f:
            f.write(body)

    def publish(self, tokens: list[str]) -> None:
        os.makedirs(f"{self.folder}/points", exist_ok=True)
        for token in tokens:
            if os.path.isdir(f"{self.folder}/staged/{token}"):
                os.rename(f"{self.folder}/staged/{token}", f"{self.folder}/points/{token}")

    def discard(self, tokens: list[str] | None) -> None:
        """Of all tokens, if None."""
        import shutil

        if os.path.isdir(f"{self.folder}/staged"):
            for token in os.listdir(f"{self.folder}/staged") if tokens is None else tokens:
                shutil.rmtree(f"{self.folder}/staged/{token}", ignore_errors=True)


@dataclass
class _Staged(WriterCommitMessage):
    token: str
    requests: int
    points: int


def requests(rows: Iterator[dict], budget: int) -> Iterator[tuple[bytes, int]]:
    """JSON lines of as many points as fit the budget of bytes; a larger single point is an error."""
    waiting, used = [], 0
    for row in rows:
        line = json.dumps(row, ensure_ascii=False, default=str).encode() + b"\n"
        if len(line) > budget:
            raise ValueError(f"a point of {len(line)} bytes exceeds the budget of {budget}")
        if used + len(line) > budget:
            yield b"".join(waiting), len(waiting)
            waiting, used = [], 0
        waiting.append(line)
        used += len(line)
    if waiting:
        yield b"".join(waiting), len(waiting)


class _PointWriter(DataSourceWriter):
    """Each attempt of a task stages under a token of its own; a commit publishes those that came through, so a retried task's points count once."""

    def __init__(self, sink, budget: int, waits: tuple[float, ...]) -> None:
        self.sink, self.budget, self.waits = sink, budget, waits

    def write(self, iterator):
        token, n, points = uuid.uuid4().hex, 0, 0
        for body, size in requests((r.asDict(recursive=True) for r in iterator), self.budget):
            with_retries(lambda n=n, body=body: self.sink.stage(token, n, body), self.waits, time.sleep)
            n, points = n + 1, points + size
        return _Staged(token, n, points)

    def commit(self, messages):
        tokens = [m.token for m in messages if m is not None and m.requests]
        with_retries(lambda: self.sink.publish(tokens), self.waits, time.sleep)
        self.sink.discard(None)

    def abort(self, messages):
        self.sink.discard(None)


def point_sink(name: str, sink: Callable[[dict], object], waits: tuple[float, ...] = WAITS) -> type[DataSource]:
    """A data source class that writes to a sink made from the options; budget is the most bytes of a request (30 MiB)."""

    class Points(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite):
            return _PointWriter(sink(dict(self.options)), int(self.options.get("budget", 30 << 20)), waits)

    return Points
