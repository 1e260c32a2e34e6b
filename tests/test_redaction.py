"""What a log may show."""

import json

from kairoscope.functions import redaction as R


def test_fields_are_masked_and_bounded():
    held = {"Authorization": "x", "api_key": [1], "note": "token: abc, and Bearer xyz", "long": "y" * 600, "list": list(range(50)), "many": {f"k{i}": i for i in range(80)}, "none": None, "yes": True}
    got = R.field("", held)
    assert got["Authorization"] == got["api_key"] == R.MASKED and "abc" not in got["note"] and "xyz" not in got["note"]
    assert (len(got["long"]), got["list"], len(got["many"]), got["none"], got["yes"]) == (512, list(range(32)), 64, None, True)
    deep = value = {}
    for _ in range(8):
        value["a"] = {}
        value = value["a"]
    assert json.dumps(R.field("", deep)) == '{"a": {"a": {"a": {"a": "[TRUNCATED]"}}}}'


def test_texts_that_are_no_json(spark):
    rows = [(None,), ("password=abc",), ("{",), ('"token=abc"',), ("[]",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "v string").coalesce(1).select(R.redact_json("v").alias("x")).collect()]
    assert got == [None, "password=[REDACTED]", "{", '"token=[REDACTED]"', "[]"]
