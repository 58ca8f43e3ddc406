"""Session helpers: a tuned builder for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from pipeops.files import emptied

_LOCAL_ROOT: str | None = None
#: Scratch paths given out in this process and not released yet.
_GIVEN: list[str] = []


def build_session(app_name: str = "pipeops", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators count on; a cluster passes no master."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local folder would lose data with the machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", str(spark.conf.get("spark.master", ""))):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    global _LOCAL_ROOT
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="pipeops-")
    return _LOCAL_ROOT


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder; :func:`release` empties it."""
    path = os.path.join(shared_root(spark), "pipeops", f"{label}-{uuid.uuid4().hex[:12]}")
    _GIVEN.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove what lies in all scratch paths given out so far, and tell how many there were.

    Results that were not yet read or written elsewhere read from there, so this belongs after
    the last use of them. An empty folder stays of each.
    """
    count = len(_GIVEN)
    while _GIVEN:
        emptied(spark, _GIVEN.pop())
    return count
