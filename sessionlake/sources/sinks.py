"""Sinks: single documents go out staged and renamed, so readers see the old or the new."""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import ledger, pending
from sessionlake.scratch import Scratch
from sessionlake.sources.text import read_ledger


def _store(spark: SparkSession, path: str) -> tuple[Any, str | None]:
    """(Hadoop path, the same as a local path if the file system is this machine's)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return where, uri.getPath() if uri.getScheme() == "file" else None


def write_document(spark: SparkSession, path: str, text: str) -> bool:
    """One small file, staged and put in place by one rename that replaces; False if it can't be written."""
    where, local = _store(spark, path)
    mark = uuid.uuid4().hex
    if local:
        target = Path(local)
        stage = target.with_name(f".{target.name}.{mark}.stage")
        try:
            target.parent.mkdir(parents=True, exist_ok=True)
            stage.write_bytes(text.encode("utf-8"))
            target.with_name(f".{target.name}.crc").unlink(missing_ok=True)
            os.replace(stage, target)
        except OSError:
            stage.unlink(missing_ok=True)
            return False
        return True
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stage = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{mark}.stage")
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    try:
        out = where.getFileSystem(conf).create(stage, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(stage, where, over)
    except Exception as e:  # the JVM's IO errors
        if "IOException" in str(e) or "FileNotFound" in str(e):
            return False
        raise
    return True


class _Mark:
    """A file that only one writer can create, with the writer's token in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.where, self.local = _store(spark, path)
        self.fs = self.where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.jvm = spark.sparkContext._jvm

    def create(self, token: str) -> bool:
        try:
            if self.local:
                os.makedirs(os.path.dirname(self.local), exist_ok=True)
                made = os.open(self.local, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(made, token.encode())
                os.close(made)
            else:
                out = self.fs.create(self.where, False)
                out.write(bytearray(token.encode()))
                out.close()
        except FileExistsError:
            return False
        except Exception as e:  # the JVM's
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def owner(self) -> str | None:
        """The token, or None if the file has gone."""
        try:
            if self.local:
                return Path(self.local).read_text()
            stream = self.fs.open(self.where)
            try:
                return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
        except Exception:  # it has gone meanwhile
            return None

    def older(self, seconds: float) -> bool:
        try:
            at = os.stat(self.local).st_mtime if self.local else self.fs.getFileStatus(self.where).getModificationTime() / 1000
        except Exception:  # it has gone meanwhile
            return False
        return time.time() - at > seconds

    def renew(self) -> None:
        now = time.time()
        if self.local:
            os.utime(self.local, (now, now))
        else:
            self.fs.setTimes(self.where, int(now * 1000), -1)

    def delete(self) -> None:
        self.fs.delete(self.where, False)


@contextmanager
def locked(spark: SparkSession, path: str, wait: float = 10.0, stale: float = 60.0) -> Iterator[None]:
    """Holds path + ".lock", a file that only one writer can create; TimeoutError after wait seconds.

    The file holds its writer's token and is renewed as long as the writer lives and holds it, however
    long that is; only its own writer deletes it in the end. One that was not renewed for stale
    seconds was left behind: who holds path + ".unlock" may take it away, if its token is still the one
    that was seen to be stale.
    """
    token = f"{socket.gethostname()} {os.getpid()} {uuid.uuid4().hex}"
    lock, breaker = _Mark(spark, path + ".lock"), _Mark(spark, path + ".unlock")
    until = time.monotonic() + wait
    while not lock.create(token):
        seen = lock.owner()
        if lock.older(stale) and breaker.create(token):
            try:
                if lock.older(stale) and lock.owner() == seen:
                    lock.delete()
            finally:
                breaker.delete()
            continue
        if breaker.older(stale):
            breaker.delete()
        if time.monotonic() > until:
            raise TimeoutError(f"{path} is locked by {seen}")
        time.sleep(0.05)
    done = threading.Event()

    def keep() -> None:
        while not done.wait(stale / 4):
            if lock.owner() != token:
                return
            lock.renew()

    keeper = threading.Thread(target=keep, daemon=True)
    keeper.start()
    try:
        yield
    finally:
        done.set()
        keeper.join()
        if lock.owner() == token:
            lock.delete()


@contextmanager
def dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Overwrites replace only the partitions that they write; the session's own setting comes back."""
    name = "spark.sql.sources.partitionOverwriteMode"
    was = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def replace_partitions(rows: DataFrame, table: str, by: list[str]) -> None:
    """Writes rows to a Parquet table in place of the partitions that they have; others stay, and a table without rows is none."""
    with dynamic_overwrite(rows.sparkSession):
        rows.write.mode("overwrite").partitionBy(*by).parquet(table)


def save_json(spark: SparkSession, path: str, value: object, indent: int = 2) -> bool:
    return write_document(spark, path, json.dumps(value, indent=indent, ensure_ascii=False))


def save_settings(spark: SparkSession, path: str, settings: dict) -> bool:
    return save_json(spark, path, settings)


def write_ledger(spark: SparkSession, path: str, held: DataFrame) -> bool:
    """The ledger file, one id a line. Very large ledgers belong in a table instead."""
    ids = [r[0] for r in held.select("session_id").distinct().orderBy("session_id").toLocalIterator()]
    return write_document(spark, path, "".join(f"{i}\n" for i in ids))


def change_ledger(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> bool:
    """Reads the ledger, changes it and writes it, under its lock, so that no concurrent change is lost."""
    with locked(spark, path):
        return write_ledger(spark, path, change(read_ledger(spark, path)))


def add_captured(spark: SparkSession, path: str, ids: DataFrame) -> bool:
    return change_ledger(spark, path, lambda held: ledger.add(held, ids))


def remove_captured(spark: SparkSession, path: str, ids: DataFrame) -> bool:
    """Whether any of the ids was in the ledger, and so is taken out."""
    with locked(spark, path):
        held = read_ledger(spark, path)
        gone = not ledger.removed(held, ids).isEmpty()
        return gone and write_ledger(spark, path, ledger.remove(held, ids))


def write_documents(texts: DataFrame, folder: str, key: str = "file", text: str = "text") -> None:
    """Many documents, as one text folder for each key, written by the executors; each ends in a newline."""
    texts.select(F.col(key), F.regexp_replace(F.col(text), "\n$", "").alias("value")).repartition(F.col(key)).write.mode("overwrite").partitionBy(key).text(folder)


def write_files(files: DataFrame) -> int:
    """Files (path, text, mtime) written by the executors under their own names, each staged and renamed; their number.

    mtime: milliseconds, or null for now; only file systems that are mounted can set it. A task that
    is repeated writes the same files again; of rows that share a path any one counts. Null texts are empty.
    """

    def run(batches):
        import os as system
        import uuid as ids

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path, text, at in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), batch.column("mtime").to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
                folder, _, name = where.rpartition("/")
                stage = f"{folder}/.{name}.{ids.uuid4().hex}.stage"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(stage) as out:
                    out.write((text or "").encode())
                if at is not None:
                    if store.type_name != "local":
                        raise NotImplementedError(f"times can't be set on {path}")
                    system.utime(stage, (at / 1000, at / 1000))
                store.move(stage, where)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.select("path", "text", F.col("mtime").cast("bigint").alias("mtime"))
    return rows.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_extract(spark: SparkSession, extracted: DataFrame, path: str, sidecar: str, total: int | None = None, as_json: bool = False) -> int:
    """An extract as text or JSON and its session ids beside it; never marks anything.

    The number of sessions; 0, and nothing written, for an empty extract. The extract is worked out once.
    """
    extracted = Scratch(spark).save(extracted, "extract")
    ids = [r[0] for r in extracted.select("session_id").distinct().orderBy("session_id").collect()]  # the pending sessions of a day
    if not ids:
        return 0
    if as_json:
        days: dict[str, list] = {}
        for r in extracted.orderBy("date", F.desc("file_mtime"), "session_id").toLocalIterator():
            messages = [{"role": m["role"], "content": m["content"]} for m in r["messages"]]
            days.setdefault(r["date"], []).append({"session_id": r["session_id"], "filepath": r["transcript_path"], "project_path": r["project_path"], "message_count": r["message_count"], "messages": messages})
        text = json.dumps(days, indent=2, ensure_ascii=False)
    else:
        text = "\n".join(r["text"] for r in pending.format_extract(extracted, total).toLocalIterator())
    write_document(spark, path, text)
    write_document(spark, sidecar, "".join(f"{i}\n" for i in ids))
    return len(ids)
