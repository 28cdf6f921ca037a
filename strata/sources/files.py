"""The few file operations that a store's commit layer needs, on a local disk or through Hadoop."""

from __future__ import annotations

import os
import re
import shutil

from pyspark.sql import SparkSession


class LocalFiles:
    """Operations below a local folder; names are relative to it."""

    def __init__(self, root: str):
        self.root = re.sub("^file:(//)?(?=/)", "", root)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def list(self, folder: str) -> dict[str, int]:
        """Size of each visible file below a folder, by its name from the root."""
        out = {}
        for d, _, names in os.walk(self.path(folder)):
            for n in names:
                if not n.startswith((".", "_")):
                    out[os.path.relpath(os.path.join(d, n), self.root)] = os.path.getsize(os.path.join(d, n))
        return out

    def read(self, name: str) -> str:
        with open(self.path(name), encoding="utf-8") as f:
            return f.read()

    def create(self, name: str, text: str) -> bool:
        """Write a new file durably; False if the name is taken. Readers see all of it or nothing."""
        target = self.path(name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        staged = f"{target}.{os.getpid()}.tmp"
        with open(staged, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(staged, target)  # fails if the target exists
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)
        return True

    def delete(self, name: str) -> None:
        target = self.path(name)
        if os.path.isdir(target):
            shutil.rmtree(target)
        elif os.path.exists(target):
            os.unlink(target)


class HadoopFiles:
    """The same through Hadoop's FileContext, for stores on a shared file system; its rename doesn't overwrite."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, jvm = root.rstrip("/"), spark._jvm
        self.jvm, self.conf = jvm, spark._jsc.hadoopConfiguration()
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(self.root), self.conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path(name))

    def _fs(self):
        return self._p("").getFileSystem(self.conf)

    def list(self, folder: str) -> dict[str, int]:
        fs, out = self._fs(), {}
        if not fs.exists(self._p(folder)):
            return out
        base, found = fs.makeQualified(self._p("")).toString().rstrip("/"), fs.listFiles(self._p(folder), True)
        while found.hasNext():
            s = found.next()
            if not s.getPath().getName().startswith((".", "_")):
                out[s.getPath().toString()[len(base) + 1 :]] = s.getLen()
        return out

    def read(self, name: str) -> str:
        stream = self._fs().open(self._p(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        staged, fs = self._p(f"{name}.{os.getpid()}.tmp"), self._fs()
        out = fs.create(staged, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        try:
            none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            self.context.rename(staged, self._p(name), none)
        except Exception as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs().delete(self._p(name), True)


def files_for(spark: SparkSession, root: str) -> LocalFiles | HadoopFiles:
    return HadoopFiles(spark, root) if "://" in root and not root.startswith("file://") else LocalFiles(root)
