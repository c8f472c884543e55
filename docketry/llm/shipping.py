"""Read-only arrays that every task memory-maps."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession


def ship_arrays(spark: SparkSession, label: str, arrays: dict[str, np.ndarray], limit: int) -> dict[str, str]:
    """Send arrays of ``limit`` bytes in total at most to all executors; gives their names there."""
    size = sum(a.nbytes for a in arrays.values())
    if size > limit:
        raise ValueError(f"{label}: {size} bytes, more than the {limit} that may go to every executor")
    folder = tempfile.mkdtemp(prefix="docketry-")
    names = {}
    for key, array in arrays.items():
        names[key] = f"{label}-{key}-{uuid.uuid4().hex}.npy"
        np.save(os.path.join(folder, names[key]), array)
        spark.sparkContext.addFile(os.path.join(folder, names[key]))
    return names


def mapped(names: dict[str, str]) -> dict[str, np.ndarray]:
    """The shipped arrays inside a task, mapped from the executor's copy of the files."""
    return {key: np.load(SparkFiles.get(name), mmap_mode="r") for key, name in names.items()}
