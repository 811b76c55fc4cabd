import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


REVIEWS = "doc_id long, product_id string, helpfulness_num int, helpfulness_den int, score int, num_tokens int, text string, posted_at timestamp, received_at timestamp"


@pytest.fixture(scope="session")
def make_reviews(spark):
    """Reviews of (doc_id, product_id, num, den, score, text[, hour of receipt]) with a column the operators must ignore."""
    from datetime import datetime

    def make(rows):
        full = [(d, p, n, m, s, None, t, None, datetime(2024, 1, 1, *(h or [0]))) for d, p, n, m, s, t, *h in rows]
        return spark.createDataFrame(full, REVIEWS).selectExpr("*", "'x' AS term", "1 AS tf", "'y' AS weight", "0 AS mark", "doc_id AS rank")

    return make
