"""Projects from ZIP archives: checks, entries, project roots and source files. Nothing is unpacked to disk."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as E
from ..functions import fixed


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives in a folder: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def project_id(path: Column) -> Column:
    """PROJECT- and 32 upper-case hexadecimal digits that follow from the path: the key of all tables."""
    return F.concat(F.lit("PROJECT-"), F.upper(F.substring(F.sha2(path, 256), 1, 32)))


def shown_id(project: Column) -> Column:
    """A project's key as responses show it: its first eight digits."""
    return F.substring(project, 1, 16)


def reject_reason(name: Column, length: Column) -> Column:
    """Why an archive is refused by its name and size, the first reason that holds; null if it isn't."""
    return (
        F.when(length.isNull(), "File is missing")
        .when(length == 0, "File is empty")
        .when(name.isNull() | E.is_blank(name), "File name is missing")
        .when(~F.lower(E.trim_java(name)).endswith(".zip"), "Only ZIP files are supported")
        .when(length > fixed.MAX_ARCHIVE_BYTES, "File is larger than 500 MB")
    )


def admitted(archives: DataFrame) -> DataFrame:
    """Archives with project_id, project_name and reject_reason. The reason needs path and length only, so a filter on it comes
    before any content is read."""
    name = F.substring_index("path", "/", -1)
    return archives.withColumns({"project_id": project_id(F.col("path")), "project_name": name, "reject_reason": reject_reason(name, F.col("length"))})


#: Entries whose content is read: build files and sources.
WANTED = r"(^|/)pom\.xml$|(^|/)src/main/java/.*\.java$"
#: Most bytes that an entry, and all read entries of an archive, may inflate to; what is beyond gives an error, not memory.
MAX_ENTRY_BYTES, MAX_INFLATED_BYTES = 64 << 20, 8 * fixed.MAX_ARCHIVE_BYTES


class Entry(NamedTuple):
    """A file in an archive; ``content`` is null for what isn't wanted or cannot be read."""

    seq: int
    path: str
    content: bytes | None
    error: str | None


def listing(archive: zipfile.ZipFile) -> list[tuple[int, str, zipfile.ZipInfo]]:
    """Files of an archive's directory: place, normalized path, record. Of entries with one path the last holds."""
    rows = [(i, posixpath.normpath(e.filename.replace("\\", "/")), e) for i, e in enumerate(archive.infolist()) if not e.is_dir()]
    last = {path: i for i, path, _ in rows}
    return [row for row in rows if last[row[1]] == row[0]]


def inflate(archive: zipfile.ZipFile, seq: int, path: str, record: zipfile.ZipInfo, limit: int) -> Entry:
    """One entry, read up to ``limit`` bytes. Whatever is wrong with it is an error of this entry alone."""
    if path.startswith(("/", "../")) or path == "..":
        return Entry(seq, path, None, "Entry leaves the archive")
    try:
        with archive.open(record) as file:
            content = file.read(limit + 1)
    except Exception as e:  # noqa: BLE001 - a damaged entry raises errors of many kinds
        return Entry(seq, path, None, f"Entry cannot be read ({type(e).__name__})")
    return Entry(seq, path, content, None) if len(content) <= limit else Entry(seq, path, None, f"Entry is larger than {limit} bytes")


def read_entries(file: BinaryIO, wanted: str = WANTED, entry_limit: int = MAX_ENTRY_BYTES, archive_limit: int = MAX_INFLATED_BYTES) -> Iterator[Entry]:
    """Entries of one archive, one at a time. Only paths that ``wanted`` matches are inflated; an archive that cannot be read gives
    one entry without a path, and never raises."""
    matches = re.compile(wanted).search
    try:
        archive = zipfile.ZipFile(file)
        rows = listing(archive)
    except Exception as e:  # noqa: BLE001 - as above
        yield Entry(0, "", None, f"Invalid or corrupted ZIP file: {e}")
        return
    if not archive.infolist():
        yield Entry(0, "", None, "ZIP file is empty")
    left = archive_limit
    for seq, path, record in rows:
        if matches(path) or path.startswith(("/", "../")) or path == "..":
            entry = inflate(archive, seq, path, record, min(entry_limit, left)) if left > 0 else Entry(seq, path, None, "Entry is beyond what an archive may hold")
            left -= len(entry.content or b"")
            yield entry
        else:
            yield Entry(seq, path, None, None)


def explode_entries(archives: DataFrame, wanted: str = WANTED, entry_limit: int = MAX_ENTRY_BYTES, archive_limit: int = MAX_INFLATED_BYTES) -> DataFrame:
    """Files in admitted archives: project_id, entry_seq, path, content (bytes), error.

    Of entries with one path the last holds. The content of paths that ``wanted`` doesn't match is null. Entries that would leave the
    archive's root, cannot be read or are too large, and archives that cannot be read or have no entries, give a row with an error
    instead of content. An archive is one row of at most 500 MB; of what it holds, a task has a few entries at a time.
    """
    columns = ["project_id", "entry_seq", "path", "content", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for pid, content in zip(batch["project_id"], batch["content"]):
                for entry in read_entries(io.BytesIO(content or b""), wanted, entry_limit, archive_limit):
                    rows.append((pid, *entry))
                    size += len(entry.content or b"") + 200
                    if size > 1 << 23:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)

    slim = archives.filter("reject_reason IS NULL").select("project_id", "content")
    return slim.mapInPandas(run, "project_id string, entry_seq int, path string, content binary, error string")


def project_roots(entries: DataFrame) -> DataFrame:
    """project_id and root: the folder of the pom.xml nearest to the top, the first in path order of equals."""
    pom = entries.filter(F.substring_index("path", "/", -1) == "pom.xml")
    parent = F.regexp_replace("path", "/?pom\\.xml$", "")
    depth = F.size(F.split("path", "/"))
    return pom.groupBy("project_id").agg(F.min_by(parent, F.struct(depth, F.lower("path"), "path")).alias("root"))


def java_sources(entries: DataFrame) -> DataFrame:
    """Java files under src/main/java of each project's root, numbered in path order: project_id, file_seq, path, content."""
    main = F.concat(F.when(F.col("root") == "", F.lit("")).otherwise(F.concat("root", F.lit("/"))), F.lit("src/main/java/"))
    rows = entries.join(project_roots(entries), "project_id").filter(F.col("path").startswith(main) & F.col("path").endswith(".java"))
    order = Window.partitionBy("project_id").orderBy(F.lower("path"), "path")
    return rows.select("project_id", F.row_number().over(order).cast("long").alias("file_seq"), "path", F.col("content").cast("string").alias("content"))


def errors(archives: DataFrame, entries: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """project_id, kind, http_status, message of everything that was refused, of ``extracted`` Java files too; other projects go
    on. An archive that cannot be read also has no root."""
    row = lambda df, kind, message: df.select("project_id", F.lit(kind).alias("kind"), F.lit(fixed.ERRORS[kind]).alias("http_status"), message.alias("message"))
    good = entries.filter("error IS NULL")
    rooted = project_roots(good)
    no_root = entries.select("project_id").distinct().join(rooted, "project_id", "left_anti")
    no_source = rooted.join(java_sources(good).select("project_id").distinct(), "project_id", "left_anti")
    found = (
        row(archives.filter("reject_reason IS NOT NULL"), "InvalidZip", F.col("reject_reason"))
        .union(row(entries.filter("error LIKE '%ZIP file%'"), "InvalidZip", F.col("error")))
        .union(row(entries.filter("error LIKE 'Entry%'"), "ProjectExtraction", F.concat("error", F.lit(": "), "path")))
        .union(row(no_root, "InvalidProjectStructure", F.lit("No pom.xml found")))
        .union(row(no_source, "SourceCodeNotFound", F.lit("No Java source under src/main/java")))
    )
    if extracted is None:
        return found
    return found.union(row(extracted.filter("error IS NOT NULL"), "JavaParsing", F.concat("source_file", F.lit(": "), "error")))
