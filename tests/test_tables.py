"""Written intermediate tables are deleted."""

import os
import subprocess
import sys
from pathlib import Path

from prefixloom.functions import tables


def test_release(spark):
    before = tables.tables()
    df = tables.materialised(spark.range(5))
    (path,) = (p for p in tables.tables() if p not in before)
    local = path.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(local)
    tables.release([path])
    assert not os.path.exists(local) and tables.tables() == before


def test_end_of_process(tmp_path):
    code = (
        "import sys; from pyspark.sql import SparkSession; from prefixloom.functions import tables\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[1]).getOrCreate()\n"
        "print(tables.materialised(spark.range(3)).count(), len(tables.tables()))\n" + "spark.stop()\n"
    )
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=180)
    assert out.stdout.split() == ["3", "1"], out.stderr[-500:]
    assert not list(tmp_path.rglob("*.parquet"))
