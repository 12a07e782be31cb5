"""Tessera: a PySpark-native engine for packaged archives and analytics tables."""

import os


def reach(spark) -> None:
    """Lets Python workers of this session import the package where it lies.

    Clusters whose machines don't have it at that path get it by ``--py-files``.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)
