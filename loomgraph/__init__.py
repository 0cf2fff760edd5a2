"""A Spark-native engine for typed, weighted, multi-relation graphs."""

from __future__ import annotations

import os
from pathlib import Path


def attach(spark):
    """Let Python workers import this package where it was started from a plain source folder.

    On a cluster ship it with --py-files; the path then is absent there and harmless.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))
    return spark
