"""The entry module must load, list and run its queries the way a cluster
driver does: pyspark from its zip, another working folder, no session yet."""
import glob
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 60 and len(o) > 60, (len(q), len(o))
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
     .config("spark.ui.enabled", "false").getOrCreate())
print("ROWS", len(q["naive_topk"](s, "/root/testdata/sf0.001").collect()))
"""


def test_queries_load_and_run_from_another_folder(tmp_path):
    import pyspark
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = glob.glob(os.path.join(lib, "pyspark.zip")) + glob.glob(os.path.join(lib, "py4j-*.zip"))
    env = dict(os.environ, PYTHONPATH=":".join(zips), SPARK_HOME=os.path.dirname(pyspark.__file__))
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stdout[-1000:] + out.stderr[-3000:]
    assert int(out.stdout.split("ROWS")[1]) > 0


def test_entry_works_without_the_llm_subpackage(tmp_path):
    """Without dualspace/llm and corpus_pipeline.py the other queries are all there."""
    import shutil
    shutil.copytree(os.path.join(REPO, "dualspace"), tmp_path / "dualspace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, llm, sql = out.stdout.split()
    assert int(n) > 70 and llm == "False" and int(sql) > 68, out.stdout + out.stderr[-2000:]
