"""Search judges each line on its own, whatever the pattern."""

import pytest

from capsift.operators.cut import search

TEXT = "bar foo\nfoo bar\r\nx\tfoo\n"


@pytest.mark.parametrize("pattern, lines", [
    ("foo", [0, 1, 2]), (r"\Afoo", [1]), (r"foo\z", [0, 2]), (r"foo\Z", [0, 2]), ("^foo", [1]), ("foo$", [0, 2]),
    (r"\r$", [1]), ("^$", [3]), (r"(?<!\s)foo", [1]), ("b[^f]*+$", [1]), ("no such", []), (r"r\nf", [])])
def test_search(spark, pattern, lines):
    captures = spark.createDataFrame([(1, TEXT), (2, None)], "capture_id long, raw string")
    assert [(r.capture_id, r.line_no) for r in search(captures, pattern).orderBy("line_no").collect()] == [(1, n) for n in lines]
