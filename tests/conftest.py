import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sievekit.session import local_session

    s = local_session("4", shuffle_partitions=8, app="sievekit-tests")
    yield s
    s.stop()


@pytest.fixture
def contents(spark):
    def make(texts, extra=None):
        rows = [(i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "content_id long, text string")

    return make


def run(spark, texts, params, **kw):
    """detect() over a list of texts -> list (per text, in order) of lists of detection dicts."""
    from sievekit.plans.detect import detect

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "content_id long, text string")
    rows = detect(df, params, **kw).orderBy("content_id").collect()
    return [[d.asDict(recursive=True) for d in r["detections"]] for r in rows]
