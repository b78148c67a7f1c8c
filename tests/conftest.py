import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import schemas  # noqa: E402
from tidemark.session import build_session, scratch_path  # noqa: E402

LOG = schemas.LOG + ", event_id bigint"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    return lambda label: scratch_path(spark, label)


@pytest.fixture
def pages(spark):
    """Page logs from ``(event_id, mid, ts, last_page_id, is_new)``; common fields by keyword."""

    def build(rows, **common):
        records = []
        for event_id, mid, ts, last_page_id, is_new in rows:
            records.append(
                {
                    "common": {"mid": mid, "is_new": is_new, "vc": "v1", "ch": "c1", "ar": "a1", **common},
                    "page": {"page_id": "home", "last_page_id": last_page_id, "during_time": 100},
                    "start": None,
                    "displays": None,
                    "actions": None,
                    "ts": ts,
                    "event_id": event_id,
                }
            )
        return spark.createDataFrame(records, LOG)

    return build


@pytest.fixture
def stream_of(spark, scratch):
    """A stream that reads the given DataFrames one per micro-batch, in order."""

    def build(*batches):
        path = scratch("stream-input")
        for batch in batches:
            batch.coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)

    return build


def ids(rows, column="event_id"):
    return sorted(row[column] for row in rows.select(column).collect())


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(repr(tuple(row)) for row in frame.select(*columns).collect())
