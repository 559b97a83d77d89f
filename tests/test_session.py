"""Settings that were submitted stay as they are."""
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = """
import sys
from scriptorium.session import get_spark
s = get_spark(*sys.argv[1:])
c = s.sparkContext.getConf()
print("ANSWER", s.conf.get("spark.sql.shuffle.partitions"), s.conf.get("spark.sql.session.timeZone"), c.get("spark.driver.memory", "none"), c.get("spark.master"), c.get("spark.ui.enabled", "none"))
"""
GIVEN = ("--master local[1] --driver-memory 777m --conf spark.sql.shuffle.partitions=777 --conf spark.sql.session.timeZone=Europe/Berlin "
         "--conf spark.ui.enabled=false --conf spark.checkpoint.dir={} pyspark-shell")


@pytest.mark.parametrize("args,submitted,want", [
    ([], True, "777 Europe/Berlin 777m local[1] false"),
    (["local[2]"], True, "777 Europe/Berlin 777m local[2] false"),
    (["local[2]"], False, "8 UTC 16g local[2] false"),
])
def test_submitted_settings(tmp_path, args, submitted, want):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_SUBMIT", "PYSPARK_GATEWAY"))} | {"PYTHONPATH": ROOT}
    if submitted:
        env["PYSPARK_SUBMIT_ARGS"] = GIVEN.format(tmp_path)
    out = subprocess.run([sys.executable, "-c", ASK, *args], env=env, capture_output=True, text=True, timeout=180).stdout
    assert [line[7:] for line in out.splitlines() if line.startswith("ANSWER ")] == [want]
