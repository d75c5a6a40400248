"""Table functions that a question may join laterally: ``json_each`` and ``split_text``.

``json_each`` is a table function in SQL, so Catalyst puts its generator into the plan and nothing leaves the JVM. ``split_text``
cuts texts with the chunker, which looks back for a border, so it is a table function in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import chunking

#: ``key`` and ``value`` of each member of a JSON object, or of each item of an array, with its place as key; nothing for other texts.
JSON_EACH = """
CREATE OR REPLACE TEMPORARY FUNCTION json_each(json STRING) RETURNS TABLE(key STRING, value STRING)
RETURN SELECT member.key, member.value FROM explode(CASE
  WHEN ltrim(json) LIKE '[%' THEN transform(from_json(json, 'array<string>'), (v, i) -> named_struct('key', CAST(i AS STRING), 'value', v))
  WHEN ltrim(json) LIKE '{%' THEN map_entries(from_json(json, 'map<string,string>')) END) AS members(member)
"""


@udtf(returnType="ordinal int, text string")
class SplitText:
    """``ordinal`` and ``text`` of each chunk of a text; no row for null and blank texts."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunking.split_text(text))


NAMES = ("json_each", "split_text")


def register(spark: SparkSession) -> None:
    spark.sql(JSON_EACH)
    spark.udtf.register("split_text", SplitText)
