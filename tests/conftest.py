from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sift.schema import POSTING
from sift.session import configure

TESTDATA = os.environ.get("SIFT_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    )
    session = configure(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf_small():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture
def make_posts(spark):
    """Posting rows from dictionaries; order of the list is order of arrival."""
    defaults = {
        "title": "Analyst", "company": "acme", "location": "Rome", "source": "greenhouse",
        "remote": None, "published_at": None, "description": "", "seniority": None,
        "contract_type": None, "salary_text": None, "tags": [], "raw": None,
    }

    def make(rows):
        full = []
        for pos, row in enumerate(rows):
            record = {**defaults, "url": f"https://example.test/{pos}", **row}
            record["ingest_seq"] = (0, 0, "test", pos, 0)
            full.append(tuple(record[name] for name in POSTING.fieldNames()))
        return spark.createDataFrame(full, POSTING)

    return make
