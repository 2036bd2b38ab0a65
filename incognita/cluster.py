"""What a session needs before the library's jobs run on it: the package in executors, and a folder for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Ships this package to executors once a session, and sets the checkpoint folder that the session names.

    Only a local session, which is one machine, may do without a named one: it gets a temporary folder.
    """
    context = spark.sparkContext
    if not getattr(context, "_incognita_shipped", False):
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"incognita_{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "incognita").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(archive))
        context._incognita_shipped = True
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch("local(\\[.*\\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="incognita-"))
