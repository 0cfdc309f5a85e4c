"""An archive listing as a data source of its own: a batch of what it names now, or a stream of what is new in it.

``spark.read.format("archive_listing").option("page", path)`` and ``spark.readStream...option("log", folder)``. A listing
is a page that changes under the same name. The stream's offsets are numbers of entries in its log: whenever the page
names archives that no entry has, they are written as the next one before that offset is handed out. A batch between two
offsets is thus always the same files, also when it is lost and asked for again after a restart, and no file comes twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from metaloom.session import ship_package

ROW = re.compile(r'href="([^"/]*_(?:Full_)?(\d{4})(\d\d)(\d\d)[^"/]*\.tar\.gz)"[^\n]*?([0-9.]+)([KMGT]?)\s*$', re.MULTILINE)
UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
FILES_A_PARTITION = 1000


def parse(html: str) -> list[tuple]:
    """``name, date, kind, size`` of each archive, in order of their dates; lines of another kind and impossible dates are passed over."""
    out = {}
    for name, y, m, d, number, unit in ROW.findall(html):
        try:
            out[name] = (name, date(int(y), int(m), int(d)), "monthly" if "Full" in name else "daily", int(float(number) * UNITS[unit]))
        except ValueError:
            continue
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _page(path: str) -> list[tuple]:
    store, at = _files(path)
    with store.open_input_stream(at) as f:
        return parse(f.read().decode("utf-8", "replace"))


class _Part(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


def _parts(rows: list[tuple]) -> list[_Part]:
    return [_Part(rows[i : i + FILES_A_PARTITION]) for i in range(0, len(rows), FILES_A_PARTITION)]


class _Batch(DataSourceReader):
    def __init__(self, page: str) -> None:
        self.page = page

    def partitions(self) -> list[_Part]:
        return _parts(_page(self.page)) or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from partition.rows


class _Stream(DataSourceStreamReader):
    def __init__(self, page: str, log: str) -> None:
        self.page, self.log = page, log

    def _entries(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        store, at = _files(self.log)
        store.create_dir(at, recursive=True)
        return sorted((int(f.base_name[:-5]), f.path) for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".json") and not f.base_name.startswith("."))

    def _entry(self, path: str) -> list[tuple]:
        store, _ = _files(self.log)
        with store.open_input_stream(path) as f:
            return [(n, date.fromisoformat(d), k, s) for n, d, k, s in json.loads(f.read())]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entry": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        entries = self._entries()
        seen = {r[0] for _, path in entries for r in self._entry(path)}
        last = entries[-1][0] if entries else 0
        new = [r for r in _page(self.page) if r[0] not in seen]
        if not new:
            return {"entry": last}
        # Written under another name first: an entry is there as a whole or not at all.
        store, at = _files(self.log)
        data = json.dumps([(n, d.isoformat(), k, s) for n, d, k, s in new]).encode()
        with store.open_output_stream(f"{at}/.{last + 1}.new") as f:
            f.write(data)
        store.move(f"{at}/.{last + 1}.new", f"{at}/{last + 1:012d}.json")
        return {"entry": last + 1}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        rows = [r for number, path in self._entries() if start["entry"] < number <= end["entry"] for r in self._entry(path)]
        return _parts(rows)

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Entries stay: they are what tells new names from old ones."""


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_listing"

    def schema(self) -> str:
        return "name string, date date, kind string, size long"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["page"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["page"], self.options["log"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ListingSource)
