import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})
from strataloom.session import cut_lineage, get_spark
spark = get_spark("t", "local[1]", **{{"spark.ui.showConsoleProgress": "false"}})
assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
df = cut_lineage(spark.range(5))
assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()
print("SET", spark.sparkContext.getConf().get("spark.checkpoint.dir"))
print("FOLDER", spark.sparkContext._jsc.sc().getCheckpointDir().get())
"""


def test_lineage_is_cut_in_the_given_folder_or_in_one_that_goes_with_the_session():
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-800:]
    folder = out.stdout.rsplit("FOLDER ", 1)[1].strip().removeprefix("file:")
    given = out.stdout.rsplit("SET ", 1)[1].split("\n")[0]
    if given == "None":
        assert "strataloom-checkpoint-" in folder and not Path(folder).exists()
    else:
        assert folder.startswith(given.removeprefix("file:"))


def test_catalogue_names_and_sql_agree():
    sys.path.insert(0, str(ROOT))
    from strataloom.plans import catalogue

    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
    assert sum(len(m.QUERIES) for m in catalogue.MODULES) == len(catalogue.QUERIES)
