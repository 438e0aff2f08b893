import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from capsift.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_lines(spark):
    """Lines of one or more captures: ``{capture_id: text}``."""
    def make(texts, **extra):
        rows = [(cid, i, line) for cid, text in texts.items() for i, line in enumerate(text.split("\n"))]
        df = spark.createDataFrame(rows, "capture_id long, line_no long, line string")
        from pyspark.sql import functions as F
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df
    return make


@pytest.fixture
def make_captures(spark):
    def make(*rows):
        """``(capture_id, command, raw)`` rows."""
        return spark.createDataFrame(list(rows), "capture_id long, command string, raw string")
    return make


def dicts(df, *order):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(r[c] for c in order)) if order else rows
