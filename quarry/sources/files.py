"""Small files in whatever store Spark reads, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, modification time in ms) of what is in a folder."""
        fs, where = self._at(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(where)] if fs.exists(where) else []

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        source = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def replace(self, path: str, text: str) -> None:
        """Writes beside the file and renames over it, so a reader sees the old text or the new."""
        fs, temporary = self._at(f"{path}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.getFileSystem(self._conf).getUri(), self._conf)
        over = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE.getClass(), 1)
        over[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, self._jvm.org.apache.hadoop.fs.Path(path), over)
