"""Cutting lineage where a cluster's tasks can all read, and names that no column has."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names.

    Without that setting a local session gets a temporary folder, which goes when Python ends; on a cluster its lack is an error, as other
    machines couldn't read a folder of this one.
    """
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        folder = tempfile.mkdtemp(prefix="siltworks-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def unused(name: str, *frames: DataFrame) -> str:
    """name, or name with more underscores, so that no column of the frames is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name
