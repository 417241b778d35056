"""Files of any Hadoop file system: the scheme of the path decides which."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """Small files and folders through Spark's own file systems, so local, HDFS and object stores act alike."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def write_text(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_json(self, path: str, value: object) -> None:
        self.write_text(path, json.dumps(value, indent=1, ensure_ascii=False))

    def read_json(self, path: str) -> object:
        return json.loads(self.read_text(path))
