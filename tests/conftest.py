import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    folder = tmp_path_factory.mktemp("shared")
    s = session("local[4]", 4, **{"spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    s.sparkContext.setCheckpointDir(f"file://{folder}/rdd")
    yield s
    s.stop()
