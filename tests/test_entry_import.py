"""The entry module needs no session, JVM or jar to list queries and twins."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import pyspark, sys, os
zips = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
if os.path.isdir(zips):
    for m in [m for m in sys.modules if m.split(".")[0] in ("pyspark", "py4j")]:
        del sys.modules[m]
    sys.path[:0] = [os.path.join(zips, f) for f in sorted(os.listdir(zips)) if f.endswith(".zip")]
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "keywords_tfidf" in o and set(o) <= set(q) and len(q) >= 70
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
"""


def test_entry_lists_queries_without_a_session():
    env = dict(os.environ, PYTHONPATH=ROOT)
    done = subprocess.run([sys.executable, "-c", CODE], env=env, cwd="/", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
