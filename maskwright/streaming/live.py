"""Masking of streams: each line or row is a document.

Templates without a number are projections: they stream in append mode without state. Numbers need state, which is a
table of (label, value, number) in the shared folder, a part of it for each micro-batch: `mask_numbered` looks the
values of a batch up by a join and numbers those that are new after the ones before, so that no label and no value has
to live in one task. A batch that runs again writes its part again and gets the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskwright.operators import mask as M
from maskwright.plans.engine import Engine
from maskwright.plans.storage import stored

NUMBERS = "label string, norm_value string, n int"


def mask_stream(engine: Engine, stream: DataFrame, text_col: str = "value", out_col: str = "masked") -> DataFrame:
    """The stream with masked text; numbers, if a template has them, count within each row."""
    return M.mask(engine, stream, text_col, out_col).drop("replacements")


def span_stream(engine: Engine, stream: DataFrame, keys: list[str], text_col: str = "value") -> DataFrame:
    """A row for each span, for counts by window or alerts."""
    return M.span_rows(engine, stream, keys, text_col)


def windowed_counts(spans: DataFrame, time_col: str, length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Spans by detector in windows of event time; rows later than the watermark are left out."""
    return spans.withWatermark(time_col, late).groupBy(F.window(time_col, length), "id").agg(F.count("*").alias("n"))


def known_numbers(spark, folder: str, before: int) -> DataFrame:
    """label, norm_value, n of the batches before one."""
    table = spark.read.schema(NUMBERS + ", batch long").option("basePath", folder)
    parts = [f"{folder}/batch={b}" for b in _batches(spark, folder) if b < before]
    return (table.parquet(*parts) if parts else spark.createDataFrame([], NUMBERS + ", batch long")).select("label", "norm_value", "n")


def _batches(spark, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(int(x.getPath().getName()[6:]) for x in system.listStatus(path) if x.getPath().getName().startswith("batch="))


def number_batch(engine: Engine, df: DataFrame, batch: int, folder: str, seq_col: str, text_col: str = "value", out_col: str = "masked") -> DataFrame:
    """A micro-batch with masked text. New values get numbers after all earlier ones of their label, by seq_col (unique, ascending) and place."""
    spark = df.sparkSession
    rows = M.span_rows(engine, df, [seq_col], text_col).select(seq_col, "start", "end", "det_index", "label", "original", "norm_value")
    rows = stored(rows, "stream-spans")
    known = known_numbers(spark, folder, batch)
    fresh = M.numbering(rows.join(known, ["label", "norm_value"], "left_anti"), seq_col)
    last = known.groupBy("label").agg(F.max("n").alias("last"))
    fresh = fresh.join(last, "label", "left").select("label", "norm_value", (F.col("n") + F.coalesce("last", F.lit(0))).cast("int").alias("n"))
    fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    here = rows.select("label", "norm_value").distinct()
    numbers = known.join(here, ["label", "norm_value"], "left_semi").unionByName(spark.read.schema(NUMBERS).parquet(f"{folder}/batch={batch}"))
    return M.with_numbers(engine, df, rows, numbers, seq_col, text_col, out_col)


def mask_numbered(engine: Engine | Callable[[], Engine], stream: DataFrame, folder: str, seq_col: str, write: Callable[[DataFrame, int], None], text_col: str = "value") -> DataStreamWriter:
    """A writer of masked text whose numbers go on from batch to batch and from run to run: equal values have equal numbers in
    the whole stream. folder is shared by driver and executors; write gets each masked batch. engine may be asked for anew."""

    def step(df: DataFrame, batch: int) -> None:
        df = stored(df, "stream-batch")  # a source may not give the same rows twice
        own = engine() if callable(engine) else engine
        write(number_batch(own, df, batch, folder.rstrip("/"), seq_col, text_col), batch)

    return stream.writeStream.foreachBatch(step)


def reload_each_batch(stream: DataFrame, engine: Callable[[], Engine], write: Callable[[DataFrame, int], None], text_col: str = "value") -> DataStreamWriter:
    """A writer whose engine is asked for anew in each micro-batch, so that changed settings take effect."""
    return stream.writeStream.foreachBatch(lambda df, i: write(mask_stream(engine(), df, text_col), i))
