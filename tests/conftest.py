from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
FIXTURES = ROOT / "tests" / "fixtures"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quarrygraph.session import make_importable

    s = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    make_importable(s)
    yield s


@pytest.fixture(scope="session")
def harbor(spark):
    """The lifted fixture project."""
    from quarrygraph.plans.lift import lift
    from quarrygraph.sources.files import read_project

    return lift(read_project(spark, str(FIXTURES / "harbor")).cache(), "harbor")
