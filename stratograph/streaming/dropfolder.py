"""A folder that archives are dropped into, analyzed as they come. Projects don't share state, so micro-batches are enough.

Each micro-batch is written once, whatever fails: its tables go to places of its own number, which a retry overwrites, and count only
when the batch's one commit has been written after all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import analysis, graph, modules
from ..operators.lineage import checkpoint
from ..sources import archives, java

TABLES = ("classes", "nodes", "edges", "violations", "mappings", "errors")
COMMITS = "_commits"


def analyze(archive_rows: DataFrame) -> dict[str, DataFrame]:
    """All TABLES of the archives in ``archive_rows`` (path, length, content). What several tables follow from is written once, so an
    archive is opened once and a file read once."""
    admitted = archives.admitted(archive_rows)
    entries = checkpoint(archives.explode_entries(admitted))
    extracted = checkpoint(java.extract(archives.java_sources(entries.filter("error IS NULL"))))
    classes = checkpoint(analysis.classify(java.parsed(extracted)))
    found = checkpoint(graph.resolved(classes, graph.type_references(classes)))
    nodes, edges = checkpoint(graph.nodes(classes, found)), checkpoint(graph.edges(found))
    return {
        "classes": classes,
        "nodes": nodes,
        "edges": edges,
        "violations": analysis.violations(edges),
        "mappings": modules.mappings(checkpoint(modules.discover(nodes, edges))),
        "errors": archives.errors(admitted.drop("content"), entries, extracted),
    }


def write_batch(archive_rows: DataFrame, batch_id: int, out: str) -> None:
    """Write the tables of one micro-batch, then its commit. Doing it again, also after a failure half-way, changes nothing."""
    for name, table in analyze(archive_rows).items():
        table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
    done = archive_rows.sparkSession.range(1).select(F.lit(len(TABLES)).alias("tables"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{out}/{COMMITS}/batch={batch_id}")


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of TABLES over all committed micro-batches, with the number of its ``batch``."""
    batches = spark.read.option("basePath", f"{out}/{COMMITS}").parquet(f"{out}/{COMMITS}/batch=*").select("batch").distinct()
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/batch=*").join(F.broadcast(batches), "batch", "left_semi")


def watch(spark: SparkSession, folder: str, out: str, state: str) -> StreamingQuery:
    """Write the tables of every archive that comes into ``folder`` to Parquet under ``out``, to be read by ``committed``; ``state`` keeps
    what was seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select("path", "length", "content"), batch_id, out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
