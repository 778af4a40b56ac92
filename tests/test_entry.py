"""The entry module needs no running JVM and no jars."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_reads_no_files():
    code = (
        "import pathlib, sys\n"
        "pathlib.Path.glob = lambda *a, **k: iter(())\n"
        f"sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as e\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 69\n")
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"SPARK_HOME": "/nonexistent"})
