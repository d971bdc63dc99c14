"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def own_folder() -> str:
    """A new folder of this process, gone when it ends."""
    path = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the context's Python files, once for each context."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(own_folder()) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc)
