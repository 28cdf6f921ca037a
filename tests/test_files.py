"""Both kinds of file operations behave alike, and a store works on either."""

import pytest

from strata.sources.files import HadoopFiles, LocalFiles, files_for
from strata.store import open_store


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_operations(spark, tmp_path, kind):
    f = LocalFiles(str(tmp_path)) if kind == "local" else HadoopFiles(spark, f"file://{tmp_path}")
    assert f.list("a") == {}
    assert f.create("a/x.json", "é") and not f.create("a/x.json", "other")
    assert f.read("a/x.json") == "é" and f.list("a") == {"a/x.json": 2}
    f.delete("a/x.json")
    f.delete("a/x.json")
    assert f.list("a") == {} and f.create("a/x.json", "again")
    f.delete("a")
    assert f.list("a") == {}


def test_local_paths():
    assert {LocalFiles(p).path("a") for p in ("/x/y", "file:/x/y", "file:///x/y")} == {"/x/y/a"}


def test_store_through_hadoop(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    assert isinstance(files_for(spark, "hdfs://h/x".replace("hdfs://h", "file://h")), LocalFiles)
    s = open_store(spark, path, files=HadoopFiles(spark, path))
    s.put(b"a", b"1")
    s.flush()
    assert s.vacuum() and s.get(b"a") == b"1" and s.check().count() == 0
    s.close()
