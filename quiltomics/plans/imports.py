"""Catalogue imports behind a gate: nothing is published that a rule refuses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from quiltomics.operators.catalogue import import_append, import_replace
from quiltomics.operators.rules import findings
from quiltomics.sources.publishing import Publication, Tables

_MODES = {"append": import_append, "replace": import_replace}


def import_datasets(publication: Publication, incoming: Tables, codes: Iterable[str], mode: str = "append") -> int:
    """Add or replace catalogue rows of a publication, and publish the result if no rule finds an error in it.

    ``incoming`` holds ``datasets`` and the other tables the rules ``codes`` look at, each with ``dataset_id``; of
    these the rows of datasets that are in the catalogue after the import are kept.  Returns the new generation.
    """
    if mode not in _MODES:
        raise ValueError(f"unknown import mode: {mode}")
    held = publication.tables()
    existing = held.get("datasets", incoming["datasets"].limit(0))
    datasets = _MODES[mode](existing, incoming["datasets"])
    tables: dict[str, DataFrame] = {"datasets": datasets}
    for name, rows in incoming.items():
        if name != "datasets":
            # A dataset's rows come from the import if the catalogue took it over, else from what is held.
            taken = incoming["datasets"].join(existing.select("dataset_id"), "dataset_id", "left_anti" if mode == "append" else "left_semi")
            taken = taken.select("dataset_id").distinct()
            new = rows.join(taken, "dataset_id", "left_semi")
            tables[name] = held[name].join(taken, "dataset_id", "left_anti").unionByName(new) if name in held else new
    wanted = list(codes)
    return publication.publish(tables, lambda staged: findings(staged, wanted))
