"""Helpers shared by the operators: Arrow batches in and out, connected components, tables in the shared folder."""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from formline.session import cut_lineage

#: What counts as white space between words: space, and tab to carriage return. bytes.split() splits at just these.
WORD_SPACES = " \t\n\r\x0b\x0c"


def one_blas_thread() -> None:
    """Matrix products of this process in one thread, where numpy brings OpenBLAS: tasks are as many as the cores, and
    small products in several threads cost twice the CPU time for nothing."""
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if (limit := getattr(library, name, None)) is not None:
                limit(1)


def give_back() -> None:
    """What a task freed goes back to the system: workers stay for later tasks, which may run other operators."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


#: Setting of the session, and rows of about 4 MB of text.
ARROW_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1500


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts of `TEXT_ROWS` rows at most: at Spark's 10,000 each task holds tens of MB several times over,
    beside the heap. A smaller setting of the session stays."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, TEXT_ROWS)


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], ddl: str) -> DataFrame:
    """mapInArrow: `fn` gets the batches of a partition and yields columns by name, as lists or arrays."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in fn(batches):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], ddl: str) -> DataFrame:
    """mapInArrow with plain lists: `fn` gets the batches of a partition as {column: values} and yields the same form."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)
        try:
            for out in fn(plain):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[dict[str, list]], column: str, most: int) -> Iterator[dict[str, list]]:
    """Cut batches so that the texts in `column` have about `most` characters together; one long text stands alone."""
    for b in batches:
        start, total = 0, 0
        for i, text in enumerate(b[column]):
            n = len(text or "")
            if i > start and total + n > most:
                yield {k: v[start:i] for k, v in b.items()}
                start, total = i, 0
            total += n
        if b[column][start:]:
            yield {k: v[start:] for k, v in b.items()}


def keep_where(docs: DataFrame, text: str, passes: Callable[[list], list[bool]]) -> DataFrame:
    """The rows whose text passes, with all their columns; only the text goes to Python, and nothing is shuffled."""

    @F.pandas_udf("boolean")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([x for b in sliced(iter([{"t": texts.tolist()}]), "t", 1 << 22) for x in passes(b["t"])], dtype=bool)
        finally:
            give_back()

    return docs.filter(verdict(F.col(text)))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that extra columns of any name cannot clash."""
    return df.select(*names)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long, a != b). Returns node, component_id (the smallest node reachable).

    Every round a node takes the smallest label among its neighbours, then the label of its label; the number of rounds
    grows with the logarithm of the longest chain in practice. All work is joins and aggregates with partial sums, so a
    hub is split by AQE's skew join. Labels of a round are a table in the shared folder. Empty edges give no rows.
    """
    both = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), F.lit(True).alias("moved")))
    while labels.filter("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        above = labels.select(F.col("node").alias("l"), F.col("label").alias("up"))
        labels = cut_lineage(hooked.join(above, "l", "left").select("node", F.least("l", F.coalesce("up", "l")).alias("label"), (F.least("l", F.coalesce("up", "l")) != F.col("old")).alias("moved")))
    return labels.select("node", F.col("label").alias("component_id"))


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))
