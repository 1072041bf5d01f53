"""Several output tables published as one.

Tables are written beside their final places first. Once all are whole, and a last check has passed, a journal names what
has to be moved; from then on the publication counts. A job that dies before the journal leaves the tables of the run
before; one that dies later leaves a journal that the next writer or reader carries out to its end, which may be done
any number of times. One job at a time publishes to a place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlane.sources.staging import delete_path, file_system

Write = Callable[[str], None]


def _split(path: str) -> tuple[str, str]:
    parent, slash, name = path.rstrip("/").rpartition("/")
    return parent + slash, name


def _journal(path: str) -> str:
    parent, name = _split(path)
    return f"{parent}{name}.publish"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, files = file_system(spark, path)
    return files.exists(hadoop_path)


def _move(spark: SparkSession, source: str, target: str) -> None:
    source_path, files = file_system(spark, source)
    target_path, _ = file_system(spark, target)
    files.mkdirs(target_path.getParent())
    if not files.rename(source_path, target_path):
        raise OSError(f"Could not move {source} to {target}")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    hadoop_path, files = file_system(spark, f"{path}.new")
    out = files.create(hadoop_path, True)
    out.write(bytearray(text.encode()))
    out.close()
    delete_path(spark, path)
    _move(spark, f"{path}.new", path)


def finish_publishing(spark: SparkSession, path: str) -> bool:
    """Carry out what a publication has left to do; ``path`` is its first table. False if there is none."""
    journal = _journal(path)
    if not _exists(spark, journal):
        return False
    text = "\n".join(r["value"] for r in spark.read.text(journal).collect())  # one short line
    for pending, final in json.loads(text):
        if _exists(spark, pending):
            delete_path(spark, final)
            _move(spark, pending, final)
    delete_path(spark, journal)
    return True


def publish(spark: SparkSession, tables: list[tuple[str, Write]], check: Callable[[], None] = lambda: None) -> None:
    """Write tables, each by a function of the path it is to write, and publish all of them or none.

    ``check`` runs after the last write; if it raises, nothing is published.
    """
    first = tables[0][0]
    finish_publishing(spark, first)
    moves = []
    for path, _ in tables:
        parent, name = _split(path)
        # What a job that died before its journal has left.
        hadoop_path, files = file_system(spark, f"{parent}_pending-*-{name}")
        for left in files.globStatus(hadoop_path) or ():
            files.delete(left.getPath(), True)
        moves.append((f"{parent}_pending-{uuid.uuid4().hex}-{name}", path))
    for (pending, _), (_, write) in zip(moves, tables):
        write(pending)
    check()
    _write_text(spark, _journal(first), json.dumps(moves))
    finish_publishing(spark, first)


def read_published(spark: SparkSession, paths: list[str], read: Callable[[str], DataFrame]) -> list[DataFrame]:
    """The tables of one publication, in the order in which they were published."""
    finish_publishing(spark, paths[0])
    return [read(path) for path in paths]
