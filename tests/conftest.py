import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from checks.session import local_session

    session = local_session(app="tests")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_job_group_is_left():
    """The job group that a test sets stays with the session's thread; the next test starts without one."""
    yield
    from pyspark import SparkContext

    if SparkContext._active_spark_context:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            SparkContext._active_spark_context.setLocalProperty(name, None)
