import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the workers
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodewell.session import Settings, session

    tmp = tmp_path_factory.mktemp("spark")
    made = session(Settings(app_name="tests", master="local[4]", shuffle_partitions=4, extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"file://{tmp}/warehouse", "spark.checkpoint.dir": f"file://{tmp}/shared", "spark.driver.memory": "4g"}))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
