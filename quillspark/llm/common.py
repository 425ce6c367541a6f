"""What the operators of this package share: tables, scratch storage, folds."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a local folder is set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_temporary: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


#: Rows of a text table that one Arrow batch holds at most (some megabytes), in place of Spark's 10,000.
BATCH_ROWS = 2000
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Holds Arrow batches small for the actions inside."""
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: the lineage is cut, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (paths := _temporary.get()) is not None:
        paths.append(path)
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary(spark: SparkSession):
    """Tables that are ``stored`` inside are deleted at the end, but for those given to the function that this yields."""
    paths: list[str] = []
    token = _temporary.set(paths)

    def keep(*frames: DataFrame) -> None:
        for df in frames:
            paths.remove(df._stored_at)

    try:
        yield keep
    finally:
        _temporary.reset(token)
        discard(spark, *paths)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text, mod 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn_below(drawn: Column, share: Column) -> Column:
    """Whether a 64-bit hash, taken as a number from 0 to 1, is below a share; right for any number of rows."""
    return F.shiftrightunsigned(drawn, 11) / F.lit(2.0**53) < share


def fit_in_a_task(rows: DataFrame, order: list, fit):
    """What ``fit`` (an iterator of Arrow batches in the given order -> a model) gives for a bounded sample of rows; None without rows.

    It runs in one task on an executor, which is started again elsewhere if that is lost; only the model reaches the driver.
    """
    import pickle

    import pyarrow as pa

    def run(batches):
        model = fit(batches)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(tidy(run), "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else None


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run):
    """``run`` for ``mapInArrow``, giving memory back when it is done."""

    def tidied(batches):
        from .textnp import release

        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def map_texts(df: DataFrame, make, fields: str, text: str = "text", drop_text: bool = True) -> DataFrame:
    """Adds columns computed from whole texts, a few megabytes at a time.

    ``make()`` runs once for each partition, on the executor, and gives a function
    (bytes, offsets) -> list of arrays, one value for each text.  ``fields``: DDL
    of the added columns; columns of ``df`` with those names are replaced.  A null text
    counts as empty.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from .textnp import pieces

    new = StructType.fromDDL(fields)
    names = {f.name.lower() for f in new.fields}
    df = df.select(*(c for c in df.columns if c.lower() not in names or c == text))
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text)]
    out = StructType(kept + list(new.fields))
    types = [f.type for f in to_arrow_schema(new)]
    keep = [f.name for f in kept]

    def run(batches):
        f = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            parts = [[] for _ in types]
            for _, _, raw, off in pieces(column):
                for part, value in zip(parts, f(raw, off), strict=True):
                    part.append(value if isinstance(value, pa.Array) else pa.array(value))
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.concat_arrays(p).cast(t) for p, t in zip(parts, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=keep + [x.name for x in new.fields])

    return df.mapInArrow(tidy(run), out)
