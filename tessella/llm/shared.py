"""Helpers that the text operators share: table access, scratch tables, byte packing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

#: White space of every word rule here, as a Java/RE2/Python character class body.
SPACE = r"\x20\x09-\x0D"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: Bytes of a batch between Spark and a Python worker: with it a worker's memory is bounded.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a temporary one if
    all tasks run in the driver's process; on a cluster that is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(folder)
    return folder


def importable(spark: SparkSession) -> None:
    """Ships this package to Python workers, once per application, and has the session send
    them small batches, however long the texts are."""
    sc = spark.sparkContext
    spark.conf.set(BATCH, str(BATCH_BYTES))
    if any("tessella-package" in f for f in sc.listFiles):
        return
    archive = f"{tempfile.mkdtemp()}/tessella-package.zip"  # the driver serves it to executors from here
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(Path(ROOT, "tessella").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(archive)


def keep(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it back: recovery after a lost
    executor starts from there, and what reads it twice isn't computed twice. The write's own
    shuffle files go when it is done, not when the driver next collects its garbage. ``settings``
    hold for this write alone."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true", **(settings or {})}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``keep`` that nothing will read again: what was made of them is kept."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def text_of(column: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of several texts (None: empty) in one array, and the offset at which each
    starts, with the end as last offset."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch that gives tables, or dicts of columns,
    of ``schema``. Ids pass as Arrow columns: pandas would round long ids beside nulls."""
    types = to_arrow_schema(DataType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in run(batch):
                arrays = [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in types]
                yield from pa.table(arrays, schema=types).to_batches()

    return df.mapInArrow(each, schema)


def slices(texts, limit: int = 1 << 21):
    """(first, last) positions of consecutive texts that hold about ``limit`` characters
    together, at least one text each: bounds what is expanded at once."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads polynomial hashes over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
