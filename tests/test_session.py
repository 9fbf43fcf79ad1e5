"""The shared folder, without any Spark settings of the machine."""

import os
import subprocess
import sys

import pytest

from plumbline import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
from plumbline.session import local_session, remove_written, written
spark = local_session(2, "bare")
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = written(spark.range(10))
assert first.count() == 10 and written(first).count() == 10
assert remove_written(spark) == 2
print("fine")
"""


def test_bare_configuration(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-2000:]


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Fake:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("__", "."): v for k, v in conf.items()})


def test_folder_choice():
    assert session.shared_dir(Fake(spark__checkpoint__dir="s3://a/b/")).startswith("s3://a/b/plumbline-")
    assert session.shared_dir(Fake(spark__checkpoint__dir="x", plumbline__shared__dir="hdfs://y")).startswith("hdfs://y/")
    assert session.shared_dir(Fake(), "z").startswith("z/")
    with pytest.raises(ValueError, match="shared folder"):
        session.shared_dir(Fake(spark__master="spark://m:7077"))
