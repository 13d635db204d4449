"""What the text operators share: row-wise work in Arrow batches, memos, and the tables they read."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.sources import fixtures

SLICE = 256  # rows whose results are Python objects at one time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; lets this machine's Python workers import the package from where it lies.

    On a cluster the package is installed or shipped with the job, and the path below is not there.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths]))
    return fixtures.table(spark, sf_dir, name)


# White_Space of Unicode, as the tokenizer patterns mean it (Python's \s has four more).
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def pieces_of(text: str) -> list[str]:
    """The text cut in front of each run of white space; together they are the text again.

    A pattern that takes white space only in front of other characters never matches across such a cut.
    """
    return CHUNK.findall(text)


class Memo(dict):
    """Answers by key. Beyond `limit` entries the older half goes, but for those that are asked for again."""

    def __init__(self, answer: Callable, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.answer, self.limit, self.longest, self.older = answer, limit, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.answer(key)
            if len(key) > self.longest:
                return value
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.older = {}  # let go before the copy is made
            self.older = dict(self)
            self.clear()
        self[key] = value


def with_columns_from_text(
    docs: DataFrame, make: Callable[[], Callable], fields: str, keep: list[str] | None = None, text: str = "text"
) -> DataFrame:
    """`docs` with the columns `fields`, computed row by row from the whole text (null counts as empty).

    `make()` runs once per task and returns the function from a text to the tuple of new values. Kept
    columns (default: all) that bear the name of a new one are replaced by it.
    """
    new = T._parse_datatype_string(fields)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    source = docs.select(*kept, docs[text].alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in kept), *new.fields])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = [work(t.as_py() or "") for t in part.column(len(kept))]  # one text at a time
                made = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)]
                fields = [*list(part.schema)[: len(kept)], *arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], schema=pa.schema(fields))

    return source.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
