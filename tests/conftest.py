import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def partitions(spark):
    """Set the exact number of shuffle partitions for one test."""
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def fix(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set(merging, "false")

    yield fix
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set(merging, "true")
