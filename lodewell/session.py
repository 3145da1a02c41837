"""Session factory: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Typed parameters of a session; values may come as text, as from an environment."""

    app_name: str = "lodewell"
    master: str | None = None
    shuffle_partitions: int = 200
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "shuffle_partitions", int(self.shuffle_partitions))

    def conf(self) -> dict[str, str]:
        return {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.ansi.enabled": "true",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        } | self.extra


def jdbc_url(database: str, host: str = "localhost", port: int | str = 5432) -> str:
    """The address of a PostgreSQL database, for spark.read.jdbc; a port may come as text. Users and passwords go into the connection's properties."""
    return f"jdbc:postgresql://{host}:{int(port)}/{database}"


def session(settings: Settings | None = None) -> SparkSession:
    settings = settings or Settings()
    builder = SparkSession.builder.appName(settings.app_name).config(map=settings.conf())
    return (builder.master(settings.master) if settings.master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which all executors share.

    Where it is unset, a temporary folder serves if driver and executors are one process (tests); a cluster must name one.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = context._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodewell-')}"
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lodewell-{uuid.uuid4().hex}"


def healthy(spark: SparkSession) -> dict[str, str]:
    """A liveness probe: status ok or degraded, and what answered."""
    try:
        return {"status": "ok" if spark.range(1).count() == 1 else "degraded", "spark": spark.version}
    except Exception as e:  # any failure means degraded
        return {"status": "degraded", "spark": type(e).__name__}
