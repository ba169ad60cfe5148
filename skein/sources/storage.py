"""Files of a collection: data folders of Parquet and commit records that name them.

A commit writes its rows to a folder of its own and then creates `_commits/<number>.json`; creation fails if the number
exists, so of two writers one wins and the other sees a conflict. A folder without a record is not part of the
collection. A record may replace all earlier ones (a compaction).
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from skein.errors import ConflictError, CorruptionError


class Files:
    """Small files in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def list(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file at once; False if it exists."""
        at = urlparse(self.at(name))
        if at.scheme in ("", "file"):  # Hadoop's local file system has no exclusive creation
            os.makedirs(os.path.dirname(at.path), exist_ok=True)
            draft = f"{os.path.dirname(at.path)}/.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, at.path)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        if self.exists(name):
            return False
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(draft), False)
        stream.write(text.encode("utf-8"))
        stream.close()
        done = self._fs.rename(self._path(draft), self._path(name))  # fails if the name exists
        if not done:
            self._fs.delete(self._path(draft), False)
        return done


class CommitLog:
    """The commit records of one collection."""

    def __init__(self, files: Files) -> None:
        self.files = files

    def records(self) -> list[dict]:
        """All records in order; those that a later one replaces are left out."""
        out: list[dict] = []
        for name in self.files.list("_commits"):
            if not name.endswith(".json"):
                continue
            try:
                record = json.loads(self.files.read(f"_commits/{name}"))
                record["number"] = int(name[:-5])
                record["seq"], record["folder"]  # noqa: B018
            except (ValueError, KeyError, TypeError) as e:
                raise CorruptionError(f"a commit record is unreadable: {name}") from e
            out = [record] if record.get("replaces") else [*out, record]
        return out

    def head(self) -> dict:
        found = self.records()
        return found[-1] if found else {"number": 0, "seq": 0, "folder": None}

    def batches(self) -> dict[str, int]:
        """The last micro-batch of each stream that is in the log, compactions passing it on."""
        out: dict[str, int] = {}
        for r in self.records():
            for name, batch in [*r.get("streams", {}).items(), *([(r["stream"], r["batch"])] if "stream" in r else [])]:
                out[name] = max(batch, out.get(name, batch))
        return out

    def stage(self, rows: DataFrame) -> str:
        """Writes rows to a new folder that no record names yet."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(self.files.at(folder))
        return folder

    def append(self, after: int, **record) -> int:
        """Adds the record numbered `after` + 1; a conflict if someone else has."""
        number = after + 1
        if not self.files.create(f"_commits/{number:020d}.json", json.dumps(record)):
            raise ConflictError(f"commit {number} was made by another writer")
        return number

    def orphans(self) -> list[str]:
        """Data folders that no record in force names: failed commits, and what compactions replaced."""
        named = {r["folder"] for r in self.records()}
        return [f"data/{d}" for d in self.files.list("data") if f"data/{d}" not in named]
