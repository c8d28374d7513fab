import os
import subprocess
import sys
from pathlib import Path

CODE = """
import os, sys
from pyspark.sql import SparkSession
from lexirank.plans.index import build_index
from lexirank.operators import rank
from lexirank.storage import discard, materialize, shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_dir(spark).startswith(spark.conf.get("spark.sql.warehouse.dir"))
index = build_index(spark.createDataFrame([("a", "cat dog"), ("b", "dog fish")], "doc_id string, text string"))
asked = spark.createDataFrame([("q", "dog cat")], "query_id string, text string")
assert [r["doc_id"] for r in rank.rank(index, asked, "rm3", 5).orderBy("rank").collect()] == ["a", "b"]
table = materialize(spark.range(3), "t")
path = table._written_at.removeprefix("file:")
assert table.count() == 3 and os.path.isdir(path)
discard(table)
discard(table)
assert not os.path.exists(path)
print("LEFT", os.path.dirname(path))
"""


def test_without_a_configured_folder(tmp_path):
    """Intermediates go to the warehouse, and are gone when the driver is."""
    (tmp_path / "conf").mkdir()
    root = str(Path(__file__).resolve().parents[1])
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert not os.path.exists(run.stdout.split("LEFT ")[1].strip())
