"""Make this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from functools import wraps
from pathlib import Path

import arcweave

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Send the package's sources to the executors, once per application, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(arcweave.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="arcweave-")) / "arcweave_sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shipped(query):
    """The query, preceded by ship()."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
