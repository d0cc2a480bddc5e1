import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagegrove.session import checkpoint_dir, get_spark
    s = get_spark(4)
    checkpoint_dir(s)
    yield s
    s.stop()


def pages_df(spark, htmls, url="https://x.com/en/"):
    rows = [(i, url if isinstance(url, str) else url[i], h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")
