"""The session leaves to spark-submit what it set, and works without a preset folder."""

import os
import subprocess
import sys

import pyspark

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {here!r})
from broodline.session import ensure_checkpoint_dir, get_spark, stage
spark = get_spark()
conf = spark.sparkContext.getConf()
print("GOT", spark.sparkContext.master, conf.get("spark.driver.memory", "-"), spark.conf.get("spark.sql.shuffle.partitions"),
      spark.conf.get("spark.sql.session.timeZone"))
folder = ensure_checkpoint_dir(spark)
print("ROWS", stage(spark.range(5)).count(), spark.range(3).checkpoint().count(), ensure_checkpoint_dir(spark) == folder)
"""


def submitted(tmp_path, *args):
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(here=HERE))
    home = os.path.dirname(pyspark.__file__)
    empty = tmp_path / "conf"
    empty.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") and not k.startswith("PYSPARK_")}
    env |= {"SPARK_CONF_DIR": str(empty), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([os.path.join(home, "bin", "spark-submit"), *args, str(script)], env=env, cwd=tmp_path,
                          capture_output=True, text=True, timeout=240)
    return {x.split()[0]: x.split()[1:] for x in done.stdout.splitlines() if x.startswith(("GOT", "ROWS"))}, done.stderr


def test_submitted_settings_win(tmp_path):
    said, err = submitted(tmp_path, "--master", "local[2]", "--driver-memory", "1g", "--conf", "spark.sql.shuffle.partitions=4000",
                          "--conf", "spark.sql.session.timeZone=Europe/Berlin")
    assert said.get("GOT") == ["local[2]", "1g", "4000", "Europe/Berlin"], err[-2000:]


def test_works_without_a_checkpoint_folder(tmp_path):
    said, err = submitted(tmp_path, "--master", "local[1]")
    assert said.get("GOT", ["", "", "", ""])[3] == "UTC", err[-2000:]
    assert said.get("ROWS") == ["5", "3", "True"], err[-2000:]
