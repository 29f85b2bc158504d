"""The driver loads PySpark from its zip, without a session: importing the
entry module and building the catalogue and the SQL must not need a JVM."""

import glob
import os
import subprocess
import sys

import pyspark

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_from_the_pyspark_zip():
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    path = [os.path.join(lib, "pyspark.zip"), *glob.glob(os.path.join(lib, "py4j-*.zip")), REPO]
    code = ("import pyspark, __spark_entry__ as e; assert 'pyspark.zip' in pyspark.__file__; "
            "q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) >= 48; print('fine')")
    r = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True,
                       env=os.environ | {"PYTHONPATH": os.pathsep.join(path)}, timeout=120)
    assert r.returncode == 0, r.stderr
    assert r.stdout.strip() == "fine"
