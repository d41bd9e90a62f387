"""Tables with numbered versions: a version is a manifest of written files, put in place by one rename."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Versions:
    """Versions of a set of tables under a folder that all executors share.

    A reader takes the newest manifest and sees its files whole, whatever is written meanwhile, as files are never
    changed. A write puts new files beside the others and its manifest in place at the end: if it fails before that, no
    reader ever sees a trace of it. Writing a version anew replaces it, so a repeated batch is not counted twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self._path("manifests"))] if fs.exists(self._path("manifests")) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v([0-9]+)\.json", n)))

    def manifest(self, version: int) -> dict[str, dict]:
        stream = self._fs().open(self._path(f"manifests/v{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def read(self, before: int | None = None) -> dict[str, DataFrame]:
        """The newest version, or the newest one below `before`; no table where there is none."""
        known = [v for v in self.versions() if before is None or v < before]
        found = self.manifest(known[-1]) if known else {}
        return {name: self.spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{self.root}/{t['path']}") for name, t in found.items()}

    def write(self, tables: Mapping[str, DataFrame], version: int) -> None:
        """All tables as that version. Tables are written one after the other; only then the version exists."""
        folder, found = f"data/{version:012d}-{uuid.uuid4().hex[:12]}", {}
        for name, rows in tables.items():
            rows.write.parquet(f"{self.root}/{folder}/{name}")
            found[name] = {"path": f"{folder}/{name}", "schema": rows.schema.jsonValue()}
        draft, fs = self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._fs()
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        options[0] = self._hadoop.fs.Options.Rename.OVERWRITE
        self._hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, self._path(f"manifests/v{version:012d}.json"), options)

    def forget(self, keep: int = 2) -> None:
        """Drops all but the newest versions, and files that no version names; not while another write is under way."""
        fs = self._fs()
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        for v in old:
            fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        used = {t["path"].split("/")[1] for v in kept for t in self.manifest(v).values()}
        for status in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)
