import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from review_insights.session import build_session

    ckpt = tempfile.mkdtemp(prefix="ri-test-ckpt-")
    logs = tempfile.mkdtemp(prefix="ri-test-events-")
    s = build_session("local[4]", app_name="review-insights-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt, "spark.eventLog.enabled": "true", "spark.eventLog.compress": "false",
                             "spark.eventLog.rolling.enabled": "false", "spark.eventLog.dir": "file://" + logs})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
