import os
import sys
from pathlib import Path

import pytest

TOP = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = f"{TOP}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import session, ship

    spark = session("tests", cores=4, partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
