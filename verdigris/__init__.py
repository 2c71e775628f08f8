"""Feedback-corpus analytics and training-data operators on Spark."""

from __future__ import annotations

from pathlib import Path


def reachable(spark) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started; clusters ship it by --py-files."""
    root, held = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(":"):
        held["PYTHONPATH"] = ":".join(x for x in (root, held.get("PYTHONPATH", "")) if x)


def shared_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a local master gets a folder
    of its own below the temporary one; a cluster raises, for no other machine would see such a folder."""
    import tempfile

    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="verdigris-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")
