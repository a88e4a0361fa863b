"""A data source of the entries in a folder's ZIP archives: ``spark.read.format("zip_entries").load(folder)``.

The driver reads the archives' directories only. Each partition is a range of entries, so a large archive is read by many tasks,
each of which goes straight to its entries. Filters on ``entry`` are pushed down: what they exclude is neither planned nor inflated.
The folder must be mounted on all executors; archives in a store that only Spark's readers reach go through
``archives.read_archives`` and ``archives.explode_entries``, which share the reading of entries.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from .archives import MAX_ENTRY_BYTES, Entry, inflate, listing

SCHEMA = "archive string, entry_seq int, entry string, content binary, error string"


@dataclass
class EntryRange(InputPartition):
    """Entries of an archive by their places in its directory; or what is wrong with the archive."""

    archive: str
    places: tuple[int, ...] = ()
    error: str | None = None


def _test(of: Filter) -> Callable[[str], bool] | None:
    """A pushed filter on ``entry`` as a test; None if it is another."""
    if getattr(of, "attribute", None) != ("entry",):
        return None
    tests = {
        EqualTo: lambda v: v == of.value, In: lambda v: v in of.value, StringStartsWith: lambda v: v.startswith(of.value),
        StringEndsWith: lambda v: v.endswith(of.value), StringContains: lambda v: of.value in v,
    }
    return tests.get(type(of))


class ZipReader(DataSourceReader):
    def __init__(self, folder: str, entries: int, compressed: int, limit: int) -> None:
        self.folder, self.entries, self.compressed, self.limit = folder, entries, compressed, limit
        self.tests: list[Callable[[str], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - the interface's name
        for one in filters:
            if test := _test(one):
                self.tests.append(test)
            else:
                yield one

    def _fits(self, path: str) -> bool:
        return all(test(path) for test in self.tests)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for top, folders, names in os.walk(self.folder):
            folders.sort()
            for name in sorted(names):
                if name.lower().endswith(".zip"):
                    out += self._ranges(os.path.join(top, name))
        return out or [EntryRange("")]

    def _ranges(self, archive: str) -> Iterator[EntryRange]:
        try:
            with zipfile.ZipFile(archive) as file:
                rows = [(i, r.compress_size) for i, path, r in listing(file) if self._fits(path)]
                empty = not file.infolist()
        except Exception as e:  # noqa: BLE001 - a damaged directory raises errors of many kinds
            yield EntryRange(archive, error=f"Invalid or corrupted ZIP file: {e}")
            return
        if empty:
            yield EntryRange(archive, error="ZIP file is empty")
        own, size = [], 0
        for place, compressed in rows:
            if own and (len(own) >= self.entries or size + compressed > self.compressed):
                yield EntryRange(archive, tuple(own))
                own, size = [], 0
            own.append(place)
            size += compressed
        if own:
            yield EntryRange(archive, tuple(own))

    def read(self, partition: EntryRange) -> Iterator[tuple]:
        if not partition.archive:
            return
        if partition.error:
            if self._fits(""):
                yield (partition.archive, *Entry(0, "", None, partition.error))
            return
        with zipfile.ZipFile(partition.archive) as file:
            wanted = set(partition.places)
            for seq, path, record in listing(file):
                if seq in wanted:
                    yield (partition.archive, *inflate(file, seq, path, record, self.limit))


class ZipEntries(DataSource):
    """Options: ``entries`` and ``compressed`` (most entries, and compressed bytes, of a partition), ``limit`` (most bytes of an entry)."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:  # noqa: ANN001 - the interface's type
        number = lambda name, default: int(self.options.get(name, default))
        return ZipReader(self.options["path"], number("entries", 1000), number("compressed", 64 << 20), number("limit", MAX_ENTRY_BYTES))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipEntries)
