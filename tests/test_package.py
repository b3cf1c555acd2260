import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from rollspark.plans.catalog import QUERIES
assert set(QUERIES) <= set(e.queries()) and len(QUERIES) > 80
assert e.queries()["f14_distill_loss"](spark, {sf!r}).count() > 0
"""

BLOCKED = """
import sys
sys.path.insert(0, {root!r})
sys.modules[{name!r}] = None  # an import of it fails, as if it were not there
import __spark_entry__ as e
names = set(e.queries())
assert len([n for n in names if not n.startswith("op") and n != "pipeline"]) > 80
assert set(e.oracle_sql()) <= names
print(len([n for n in names if n.startswith("op") or n == "pipeline"]))
"""


@pytest.mark.parametrize(("name", "left"), [("xxhash", 0), ("rollspark.llm", 0)])
def test_entry_without_what_the_optional_folder_needs(name, left):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(root=ROOT, name=name)], capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) == left


def test_workers_do_not_need_the_package_on_their_path(tmp_path):
    code = CODE.format(root=ROOT, sf="/root/testdata/sf0.001")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
