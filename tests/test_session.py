import subprocess
import sys
from pathlib import Path

from pagegraph import session

ROOT = Path(__file__).resolve().parent.parent


def test_staged_tables_lie_in_the_shared_folder(spark):
    df = spark.range(5).selectExpr("id", "cast(null as string) as s")
    out = session.stage(df, "x")
    assert out.dtypes == df.dtypes and out.count() == 5
    assert all(session.shared_dir(spark) in f for f in out.inputFiles())
    assert session.stage(df.where("false"), "x").count() == 0


def test_only_the_entry_knows_the_training_data_operators():
    for p in ROOT.glob("pagegraph/**/*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
