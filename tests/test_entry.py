import os
import subprocess
import sys
import zipfile

import __spark_entry__ as entry
from harrow.plans import shipping

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.createDataFrame([(1, "a,1/2,5,x"), (2, "a")], "rec_id long, raw string").write.parquet({folder!r} + "/raw_records.parquet")
print("ROWS", entry.queries()["p7_found"](spark, {folder!r}).collect())
"""


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p5_found", "p7_found", "vector_space_search", "index_build"} <= set(entry.queries())


def test_package_is_sent_once(spark):
    shipping.ship(spark)
    shipping.ship(spark)
    assert spark.sparkContext._python_includes.count("harrow.zip") == 1
    path = next(p for p in sys.path if p.endswith("harrow.zip"))
    assert "harrow/sources/records.py" in zipfile.ZipFile(path).namelist()


def test_queries_run_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=str(tmp_path / "d"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS [Row(rec_id=2, reason='columns')]" in done.stdout, done.stderr[-2000:]
