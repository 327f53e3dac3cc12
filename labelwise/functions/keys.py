"""Run keys and path segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_segment(path: Column, index: int) -> Column:
    """``path.split('/')[index]`` (0-based); under ANSI mode a missing segment fails, as a list index would."""
    return F.element_at(F.split(path, "/"), index + 1)


def run_key(filename: Column, model_name: Column) -> Column:
    """``<dataset>-<model>`` from ``data/<dataset>/...`` and ``<org>/<model>``: the per-run folder name."""
    return F.concat(path_segment(filename, 1), F.lit("-"), path_segment(model_name, 1))


def dataset_path(dataset: Column, file: str = "data.csv") -> Column:
    return F.concat(F.lit("data/"), dataset, F.lit("/" + file))
