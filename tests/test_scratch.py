import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from crowdnet.scratch import Scratch, shared_dir

ROOT = Path(__file__).parent.parent
CODE = """
import sys
from pyspark.sql import SparkSession
from crowdnet.scratch import Scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
scratch = Scratch(spark)
kept, gone = scratch.cut(spark.range(5), "kept"), scratch.cut(spark.range(3), "gone")
scratch.drop(gone)
import os
print(sorted(os.listdir(scratch.root)), kept.count())
"""


def unset(master):
    conf = SimpleNamespace(get=lambda *_: None)
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master=master), conf=conf)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(unset(master))


def test_the_shared_folder_is_the_one_of_the_session(spark):
    assert Scratch(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_what_is_left_is_deleted_at_the_end(tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, check=True)
    assert out.stdout.strip().endswith("['001-kept'] 5") and not list(tmp_path.glob("crowdnet-*"))
