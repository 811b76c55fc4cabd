"""The package on the executors: queries send it along, so that no executor needs it installed."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from harrow.plans.registry import Query

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's files to the session's context, once for each application; the driver serves them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="harrow-package-")) / "harrow.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def with_package(query: Query) -> Query:
    """The query, with the package sent before it runs."""

    @functools.wraps(query)
    def run(spark, folder):
        ship(spark)
        return query(spark, folder)

    return run
