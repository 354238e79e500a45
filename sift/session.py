"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings only: cluster sizing stays with whoever submits the job.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key in a payload object keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the library needs to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder every executor can reach, as named by the cluster, if any."""
    return spark.conf.get("spark.checkpoint.dir", None)


def working_folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where all work is done on this machine.

    On a cluster executors would write to disks of their own, so there the setting must be
    there.
    """
    folder = shared_folder(spark)
    if folder is None:
        # "local" and "local[...]", but not "local-cluster[...]".
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="sift-")
    return folder.rstrip("/")
