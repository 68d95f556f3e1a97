"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WS = "[\\x20\\x09-\\x0D]"
"""White space between words, as a Java class."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 4 << 20
"""Texts are handed to numpy in slices of about so many bytes (one text at least)."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the context's checkpoint folder.

    Only where neither is set, a temporary folder becomes the context's checkpoint folder, if the session runs in one process; a cluster needs
    a folder that driver and executors share, so there it is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: give a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-checkpoint-"))
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/barloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder and reads it again: its lineage ends there, so a lost executor costs a read, not the work."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of_id(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod, F.lit(-1))


def unit_hash(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``salt`` only; SQL engines with md5 can repeat it."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(salt))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def placeholders(df: DataFrame) -> dict[str, str]:
    """A placeholder for each column name, that no name of an operator can clash with."""
    return {c: f"__in{i}" for i, c in enumerate(df.columns)}


def filtered(df: DataFrame, judge: Callable[[DataFrame, Callable[[str], str]], DataFrame], condition: str | Column) -> DataFrame:
    """The rows that ``judge`` adds columns to and ``condition`` keeps, with their own columns only, whatever those are named.

    ``judge`` gets the rows with placeholder names, and a function from a column's name to its placeholder.
    """
    place = placeholders(df)
    judged = judge(df.toDF(*place.values()), place.__getitem__).where(condition)
    return judged.select(*[F.col(p).alias(c) for c, p in place.items()])


def named(df: DataFrame, column: str) -> str:
    """The column of ``df`` that Spark finds under this name, whose case may differ."""
    return next((c for c in df.columns if c == column), None) or next((c for c in df.columns if c.lower() == column.lower()), column)


def beside(df: DataFrame, new: Iterable[str], judge: Callable[[DataFrame, Callable[[str], str]], DataFrame]) -> DataFrame:
    """The columns of ``df`` and the ``new`` ones that ``judge`` adds, as in ``filtered``. Columns of the new names, in any case, give way."""
    place, new = placeholders(df), list(new)
    taken = {c.lower() for c in new}
    judged = judge(df.toDF(*place.values()), lambda c: place[named(df, c)])
    return judged.select(*[F.col(p).alias(c) for c, p in place.items() if c.lower() not in taken], *new)


def bounded_sample(df: DataFrame, n: int, key: Column, salt: str, total: int | None = None) -> DataFrame:
    """About ``n`` rows, the same for the same rows: a row stays if its hash is below n / count."""
    total = df.count() if total is None else total
    return df if total <= n else df.where(unit_hash(key, salt) < n / total)


SLOTS = 1 << 20


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("__slot")


FILTER_BITS = 24


def narrowed(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of ``df`` whose key may be among the wanted ones: a prefilter before an exact join, so that rows which can't match aren't shuffled.

    What is broadcast is a bitmap of the wanted keys' hashes, 2^FILTER_BITS bits in words of 64 however large the table is.
    """
    place = lambda k: F.shiftrightunsigned(F.xxhash64(k), 64 - FILTER_BITS)
    bits = wanted.select(F.shiftright(place(wanted_key), 6).alias("__word"), place(wanted_key).bitwiseAND(F.lit(63)).cast("int").alias("__bit"))
    words = bits.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__mask"))
    marked = df.withColumn("__place", place(key)).withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(words), "__word")
    return marked.where("shiftright(__mask, cast(__place & 63 AS INT)) & 1 = 1").drop("__place", "__word", "__mask")


def join_dealt(rows: DataFrame, table: DataFrame, keys: list[str], hot: int = 200_000) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has each key once: rows of a key that more than ``hot`` of them have are dealt to several tasks.

    The table's row goes to each of these. Hot keys are told by the slots they hash to, so what is broadcast has a fixed size.
    """
    slot = slot_of(F.struct(*keys))
    slots = rows.groupBy(*keys).count().where(F.col("count") > hot).groupBy(slot).agg(F.ceil(F.max("count") / hot).alias("__k"))
    dealt = rows.withColumn("__slot", slot).join(F.broadcast(slots), "__slot", "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__k", F.lit(1))))
    copies = table.withColumn("__slot", slot).join(F.broadcast(slots), "__slot", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__k", F.lit(1)) - 1)))
    return dealt.drop("__slot", "__k").join(copies.drop("__slot", "__k"), [*keys, "__salt"], "left").drop("__salt")


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of ``batch`` with their texts, each of about SLICE_BYTES, so that memory follows the slice and not the batch."""
    texts = batch.column(column)
    sizes = pc.binary_length(texts).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += (n or 0) + 64
        if held >= SLICE_BYTES or i == len(sizes) - 1:
            part = batch.slice(start, i + 1 - start)
            yield part, part.column(column).to_pylist()
            start, held = i + 1, 0


def with_columns_from_text(df: DataFrame, text: str, fields: str, make: Callable[[], Callable[[list[str | None]], list]], keep: Iterable[str]) -> DataFrame:
    """Appends columns (``fields``, a DDL string) computed from each whole text; narrow, no shuffle.

    ``make`` runs once per task and gives a function from texts to lists of values, one list per field.
    The columns ``keep`` pass through; a kept column named like a new one, in any case, gives way.
    """
    made = StructType.fromDDL(fields)
    arrow = to_arrow_schema(made)
    taken = {n.lower() for n in made.names}
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in taken]
    inner = [f"__in{i}" for i in range(len(keep))]
    # a text that is kept goes to Python once
    read = inner[keep.index(text)] if text in keep else "__text"
    carried = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], *([] if text in keep else [F.col(f"`{text}`").alias(read)]))
    schema = StructType(carried.schema.fields[: len(keep)] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for part, texts in text_slices(batch, read):
                columns = [part.column(c) for c in inner] + [pa.array(v, f.type) for f, v in zip(arrow, score(texts), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([part.schema.field(c) for c in inner] + list(arrow)))

    return carried.mapInArrow(run, schema).toDF(*keep, *made.names)


class Memo(dict):
    """A dict that computes what it lacks and is emptied by ``trim`` beyond ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
