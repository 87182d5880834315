"""The shared folder, its stages, and a package that the workers can't import by themselves."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from towerfill import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_unset_folder_raises_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


CHILD = """
import sys
sys.path.insert(0, {root!r})
from towerfill import session
from towerfill.sources import archive
import os, zipfile
spark = session.get_spark("local[2]", "child")
with zipfile.ZipFile("a.zip", "w") as z:
    z.writestr("t.csv", "datetime,v\\n2024-01-01 00:00:00,1\\n")
session.ship_package(spark)
assert archive.read_table(spark, os.getcwd() + "/a.zip").first().v == 1
folder = session.stages_path(spark)
path = spark._jvm.org.apache.hadoop.fs.Path(folder)
files = path.getFileSystem(spark._jsc.hadoopConfiguration())
assert files.exists(path)
session.drop_stages(spark)
assert not files.exists(path)
print("shipped")
"""


def test_package_is_shipped_and_stages_go(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CHILD.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "shipped" in out.stdout, out.stderr[-2000:]
