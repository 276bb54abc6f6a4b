"""Small files and folders of any store that Spark reads."""

from pyspark.sql import SparkSession


class Folder:
    """A folder in the file system of its path, whatever that is."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _system(self):
        return self._at().getFileSystem(self._conf)

    def names(self) -> list[str]:
        system = self._system()
        return sorted(status.getPath().getName() for status in system.listStatus(self._at())) if system.exists(self._at()) else []

    def size(self, name: str) -> int:
        system = self._system()
        return system.getContentSummary(self._at(name)).getLength() if system.exists(self._at(name)) else 0

    def read(self, name: str) -> str:
        stream = self._system().open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str, scratch: str) -> bool:
        """Write a file whole or not at all; False if there is one of this name already."""
        system = self._system()
        out = system.create(self._at(scratch), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if system.exists(self._at(name)) or not system.rename(self._at(scratch), self._at(name)):
            system.delete(self._at(scratch), False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._system().delete(self._at(name), True)
