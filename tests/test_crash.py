"""A writer killed at any moment: what it acknowledged is there, whole batches only, and the store opens by itself."""

import os
import signal
import subprocess
import sys
import time

import pytest

from strata import schema as S
from strata.store import open_store

OPTIONS = S.Options(memtable_bytes=6000, l0_trigger=2, target_file_bytes=4096)

CHILD = """
import sys
from pyspark.sql import SparkSession
from strata.store import Batch, open_store
from test_crash import OPTIONS
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
store = open_store(spark, sys.argv[1], OPTIONS)
for i in range(10_000):
    store.write(Batch().put(b"a%08d" % i, b"v%d" % i).put(b"b%08d" % i, b"v%d" % i).put(b"last", b"%d" % i))
    print("ack", i, flush=True)
"""


@pytest.mark.parametrize("acks, delay", [(5, 0.05), (9, 0.2)])
def test_killed_writer(spark, tmp_path, acks, delay):
    here = os.path.dirname(os.path.abspath(__file__))
    env = os.environ | {"PYTHONPATH": os.pathsep.join((os.path.dirname(here), here, os.environ.get("PYTHONPATH", "")))}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    child = subprocess.Popen([sys.executable, "-c", CHILD, str(tmp_path / "db")], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=env, start_new_session=True)
    done = -1
    try:
        for line in child.stdout:
            if line.startswith("ack"):
                done = int(line.split()[1])
            if done == acks:
                time.sleep(delay)
                break
    finally:
        os.killpg(child.pid, signal.SIGKILL)  # the child's own group: it and its JVM
    rest = child.stdout.read()
    child.wait()
    done = max([done, *(int(x.split()[1]) for x in rest.splitlines() if x.startswith("ack") and len(x.split()) == 2)])
    assert done >= acks
    store = open_store(spark, str(tmp_path / "db"), OPTIONS)
    got = {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in store.scan().collect()}
    n = int(got.pop("last"))  # at least what was acknowledged, and a whole number of batches
    assert n >= done and got == {f"{p}{i:08d}": f"v{i}" for p in "ab" for i in range(n + 1)}
    store.put(b"again", b"1")
    store.compact()
    store.vacuum()
    assert store.check().count() == 0 and store.get(b"again") == b"1"
    store.close()
