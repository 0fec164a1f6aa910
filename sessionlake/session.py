"""Spark session settings and the folder layout of a memory tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


def get_spark(app: str = "sessionlake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC and adaptive execution; master and partitions only for local runs."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


@dataclass(frozen=True)
class Layout:
    """Where things lie under a root, which is any URI that Spark reads."""

    root: str

    @property
    def memory(self) -> str:
        return f"{self.root}/memory"

    @property
    def daily(self) -> str:
        return f"{self.memory}/daily"

    @property
    def project_memory(self) -> str:
        return f"{self.memory}/project-memory"

    @property
    def global_memory(self) -> str:
        return f"{self.memory}/global-long-term-memory.md"

    @property
    def projects(self) -> str:
        return f"{self.root}/projects"

    @property
    def projects_index(self) -> str:
        return f"{self.memory}/projects-index.json"

    @property
    def captured(self) -> str:
        return f"{self.memory}/.captured"

    @property
    def settings(self) -> str:
        return f"{self.memory}/settings.json"

    @property
    def archive(self) -> str:
        return f"{self.memory}/.decay-archive.md"

    @property
    def last_synthesis(self) -> str:
        return f"{self.memory}/.last-synthesis"

    @property
    def backups(self) -> str:
        return f"{self.memory}/.backups"

    @property
    def history(self) -> str:
        return f"{self.root}/history.jsonl"
