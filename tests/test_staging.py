"""The shared folder: named, unnamed, and without a scheme."""

import os
import subprocess
import sys

import pytest

from archloom.operators import staging

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = """
import sys
from pyspark.sql import SparkSession
from archloom.operators.graph import closure
from archloom.operators.staging import shared_dir
b = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
if len(sys.argv) > 1:
    b = b.config("spark.checkpoint.dir", sys.argv[1])
s = b.getOrCreate()
assert len(sys.argv) < 2 or shared_dir(s) == "file:" + sys.argv[1], shared_dir(s)
got = closure(s.createDataFrame([("a", "b")], "src string, dst string"), s.createDataFrame([("b",)], "path string")).collect()
assert [tuple(r) for r in got] == [("a", "b", "ok")], got
"""


@pytest.mark.parametrize("named", [False, True])
def test_a_session_of_its_own(tmp_path, named):
    """Without any setting, and with a path that has no scheme: the default file system's."""
    conf = tmp_path / "conf"
    conf.mkdir()
    args = [str(tmp_path / "work")] if named else []
    done = subprocess.run([sys.executable, "-c", PLAIN, *args], env={**os.environ, "PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(conf)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session)
