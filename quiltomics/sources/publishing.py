"""Publishing a product as an immutable generation: stage, validate, record, flip, recheck.

A product is a set of named tables below one folder::

    generations/gen=3/<table>/...   the tables, written once
    manifests/gen=3                 name, size and SHA-256 of every file of the generation
    pointer/gen=3                   empty; the largest number is the generation in force

Tables are staged first, read back and validated; a finding of severity ``error`` removes the stage and
nothing is published.  The manifest is recorded before the pointer is set, and the pointer is one atomic
file creation: readers see the old generation or the new one.  ``finalise`` compares every file with the
manifest again before older generations go; until then ``roll_back`` returns to the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltomics.sources.sinks import file_manifest, manifest_differences
from quiltomics.sources.store import Store

Tables = Mapping[str, DataFrame]
#: Findings of the staged tables, with at least ``severity`` and ``code``.
Checks = Callable[[Tables], DataFrame]


class PublishRefused(ValueError):
    """A generation that must not be published or kept, with the first findings."""


class Publication:
    """The generations of one product below a folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def current(self) -> int | None:
        """Number of the generation in force."""
        numbers = [int(n.split("=")[1]) for n in self.store.names("pointer")]
        return max(numbers, default=None)

    def tables(self, generation: int | None = None) -> dict[str, DataFrame]:
        """Tables of a generation, by default the one in force."""
        number = self.current() if generation is None else generation
        if number is None:
            return {}
        folder = f"generations/gen={number}"
        return {n: self.spark.read.parquet(self.store.path(f"{folder}/{n}")) for n in self.store.names(folder)}

    def manifest(self, generation: int) -> DataFrame:
        """Recorded files of a generation."""
        return self.spark.read.schema("name string, size long, sha256 string").parquet(self.store.path(f"manifests/gen={generation}"))

    def publish(self, tables: Tables, checks: Checks, partitions: Mapping[str, list[str]] | None = None) -> int:
        """Stage, validate, record and flip; returns the new generation, or raises ``PublishRefused`` and leaves no trace."""
        taken = [int(n.split("=")[1]) for folder in ("generations", "manifests", "pointer") for n in self.store.names(folder)]
        number = max(taken, default=0) + 1
        folder = f"generations/gen={number}"
        try:
            for name, table in tables.items():
                table.write.partitionBy(*(partitions or {}).get(name, [])).parquet(self.store.path(f"{folder}/{name}"))
            staged = {name: self.spark.read.schema(table.schema).parquet(self.store.path(f"{folder}/{name}")) for name, table in tables.items()}
            bad = [r.asDict() for r in checks(staged).where(F.col("severity") == "error").limit(20).collect()]
            if bad:
                raise PublishRefused(f"generation refused: {bad}")
            file_manifest(self.spark, self.store.path(folder)).write.parquet(self.store.path(f"manifests/gen={number}"))
        except BaseException:
            self.store.delete(folder)
            self.store.delete(f"manifests/gen={number}")
            raise
        if not self.store.mark(f"pointer/gen={number}"):
            raise PublishRefused(f"generation {number} was published by another writer")
        return number

    def changed_files(self, generation: int) -> DataFrame:
        """Files that differ from the generation's manifest, are missing from it or are new."""
        found = file_manifest(self.spark, self.store.path(f"generations/gen={generation}"))
        return manifest_differences(found, self.manifest(generation))

    def finalise(self) -> int:
        """Recheck the files of the generation in force and remove the older ones; refused if any file changed."""
        number = self.current()
        if number is None:
            raise PublishRefused("nothing is published")
        changed = [r.asDict() for r in self.changed_files(number).limit(20).collect()]
        if changed:
            raise PublishRefused(f"files of generation {number} changed: {changed}")
        for folder in ("pointer", "generations", "manifests"):  # pointers first: none is left without its tables
            for name in self.store.names(folder):
                if int(name.split("=")[1]) < number:
                    self.store.delete(f"{folder}/{name}")
        return number

    def roll_back(self) -> int | None:
        """Take the generation in force back; the one before it is in force again."""
        number = self.current()
        if number is not None:
            for folder in ("pointer", "generations", "manifests"):
                self.store.delete(f"{folder}/gen={number}")
        return self.current()
