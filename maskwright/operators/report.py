"""Reports: counts, gates, JSON and CSV rows, listings and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.operators import mask as M
from maskwright.plans.engine import Engine


def counts_by_doc(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "id").agg(F.count("*").alias("n"))


def statistics(rows: DataFrame) -> DataFrame:
    """kind, name, n: totals by detector, by category and in all, from span rows in one pass."""
    sets = rows.groupingSets([("id",), ("category",), ()], "id", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(
        F.when(F.col("g") == 1, "detector").when(F.col("g") == 2, "category").otherwise("total").alias("kind"),
        F.coalesce("id", "category", F.lit("total")).alias("name"),
        "n",
    )


def gate(rows: DataFrame) -> DataFrame:
    """found boolean, exit_code int: a single row; stops at the first span."""
    return rows.limit(1).agg((F.count("*") > 0).alias("found")).select("found", F.col("found").cast("int").alias("exit_code"))


def batch_summary(files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """files, detections, errors: a single row. files: key and error (null: none), and seconds, if it has them: then their sum too."""
    n = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"))
    joined = files.join(n, files[key] == F.col("__key"), "left")
    more = [F.sum("seconds").alias("seconds")] if "seconds" in files.columns else []
    return joined.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"), F.count_if(F.col("error").isNotNull()).alias("errors"), *more)


def location_at(locations: Column, at: Column) -> Column:
    """The label of the last location at or before an offset. locations: array<struct<offset, label>>, ascending."""
    return F.try_element_at(F.filter(locations, lambda x: x["offset"] <= at), F.lit(-1))["label"]


def json_report(engine: Engine, df: DataFrame, key: str, text_col: str = "text", values: bool = False, locations_col: str | None = None) -> DataFrame:
    """key, report: the detections of a document with statistics, as JSON. values: with the originals."""
    masked = M.mask(engine, df, text_col).withColumn("__t", S.clean(F.col(text_col)))

    def row(x):
        meta = engine.meta(x["det"])
        cols = [
            meta["id"].alias("id"), meta["category"].alias("category"), meta["name"].alias("name"), F.round(x["conf"], 2).alias("confidence"),
            x["start"].alias("start"), x["end"].alias("end"), S.line_of(F.col("__t"), x["start"]).alias("line"), S.column_of(F.col("__t"), x["start"]).alias("column"),
            x["out_start"].alias("out_start"), x["out_end"].alias("out_end"), x["replacement"].alias("replacement"),
        ]
        if locations_col:
            cols.append(location_at(F.col(locations_col), x["start"]).alias("location"))
        return F.struct(*cols, *([x["original"].alias("original")] if values else []))

    found = F.transform(M.with_offsets(F.col("replacements")), row)
    tally = lambda field: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(F.col("__d"), lambda x: x[field]))), lambda k: F.struct(k, F.size(F.filter(F.col("__d"), lambda x: x[field] == k)))))
    masked = S.once(masked, "__d", found)
    stats = F.struct(F.size("__d").alias("total"), tally("id").alias("by_detector"), tally("category").alias("by_category"))
    return masked.select(key, F.to_json(F.struct(F.col("__d").alias("detections"), stats.alias("stats"))).alias("report"))


CSV_COLUMNS = ("file", "line", "column", "id", "category", "name", "confidence", "replacement")


def csv_rows(engine: Engine, df: DataFrame, file_col: str, text_col: str = "text", values: bool = False) -> DataFrame:
    """One row for each detection, in the columns of the CSV report."""
    masked = M.mask(engine, df, text_col).withColumn("__t", S.clean(F.col(text_col)))
    x = masked.select(F.col(file_col).alias("file"), "__t", F.explode("replacements").alias("x"))
    meta = engine.meta(F.col("x.det"))
    return x.select(
        "file", S.line_of(F.col("__t"), F.col("x.start")).alias("line"), S.column_of(F.col("__t"), F.col("x.start")).alias("column"), meta["id"].alias("id"),
        meta["category"].alias("category"), meta["name"].alias("name"), F.round("x.conf", 2).alias("confidence"), F.col("x.replacement").alias("replacement"),
        *([F.col("x.original").alias("original")] if values else []),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV parts with CRLF and a byte order mark, which Spark's writer has none of: lines are built and written as text."""
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in rows.columns)]
    line = F.concat_ws(",", *quoted)
    head = rows.sparkSession.createDataFrame([("﻿" + ",".join(rows.columns),)], "value string")
    head.coalesce(1).unionByName(rows.select(line.alias("value"))).write.option("lineSep", "\r\n").text(path)


def listing(rows: DataFrame, file_col: str, values: bool = False) -> DataFrame:
    """line_text: file:line:column: id [name] confidence and, if asked for, the value."""
    head = F.format_string("%s:%d:%d: %s [%s] %.2f", F.col(file_col).cast("string"), "line", "column", "id", "name", "confidence")
    return rows.select(file_col, "start", (F.concat(head, F.lit(" "), F.col("original")) if values else head).alias("line_text"))


BLOCKS = "array<struct<l:int,l_end:int,r:int,r_end:int>>"


def _blocks(text: Column, spans: Column) -> Column:
    """Runs of lines (from 0, end exclusive) that do not pair up one by one: those of a span whose replacement has another number of
    lines, together with all spans that begin in them."""
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n")))
    block = lambda l, l_end, r, r_end: F.struct(*[c.cast("int").alias(n) for c, n in ((l, "l"), (l_end, "l_end"), (r, "r"), (r_end, "r_end"))])
    none = block(*[F.lit(-1)] * 4)

    def step(acc, x):
        a, b = lines(x["original"]), lines(x["replacement"])
        l, open_ = S.line_of(text, x["start"]) - 1, acc["open"]
        r = l - acc["shift"]
        inside = l < open_["l_end"]
        grown = block(open_["l"], F.greatest(open_["l_end"], l + a + 1), open_["r"], F.greatest(open_["r_end"], r + b + 1))
        fresh = F.when(a == b, none).otherwise(block(l, l + a + 1, r, r + b + 1))
        done = F.when(inside | (open_["l"] < 0), acc["done"]).otherwise(F.array_append(acc["done"], open_))
        return F.struct((acc["shift"] + a - b).cast("int").alias("shift"), F.when(inside, grown).otherwise(fresh).alias("open"), done.cast(BLOCKS).alias("done"))

    first = F.struct(F.lit(0).alias("shift"), none.alias("open"), F.array().cast(BLOCKS).alias("done"))
    return F.aggregate(spans, first, step, lambda acc: F.when(acc["open"]["l"] < 0, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def aligned(text: Column, masked: Column, spans: Column) -> Column:
    """Rows of (left, right) lines, from 1: lines outside of blocks pair up, those of a block pair up from its top."""
    kind = "array<struct<left:int,right:int>>"
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1

    def pairs(l, l_end, r, r_end):
        n = F.greatest(l_end - l, r_end - r)
        row = lambda i: F.struct(F.when(l + i <= l_end, l + i).cast("int").alias("left"), F.when(r + i <= r_end, r + i).cast("int").alias("right"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), row)).otherwise(F.array().cast(kind))

    def rows(lines):
        blocks, left, right = lines["blocks"], lines["left"], lines["right"]  # counted once, not for each line
        before = lambda i, end: F.when(i == 0, 0).otherwise(F.get(blocks, i - 1)[end])
        own = F.transform(blocks, lambda x, i: F.concat(pairs(before(i, "l_end"), x["l"], before(i, "r_end"), x["r"]), pairs(x["l"], x["l_end"], x["r"], x["r_end"])))
        last = F.size(blocks)
        return F.concat(F.flatten(own), pairs(before(last, "l_end"), left, before(last, "r_end"), right))

    return S.let(F.struct(_blocks(text, spans).alias("blocks"), count(text).alias("left"), count(masked).alias("right")), rows)


def line_maps(masked: DataFrame, key: str, text_col: str = "text", out_col: str = "masked", spans_col: str = "replacements") -> DataFrame:
    """key, side (left or right), line, other: the line that stands beside each line; one without a partner has the partner of the
    last line above it that has one (null above the first)."""
    text, out = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(out_col), F.lit(""))
    rows = masked.select(key, F.posexplode(aligned(text, out, F.col(spans_col))).alias("pos", "x")).select(key, "pos", "x.left", "x.right")
    above = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.select(key, "left", "right", F.last("left", True).over(above).alias("l"), F.last("right", True).over(above).alias("r"))
    side = lambda name, line, other: carried.filter(F.col(line).isNotNull()).select(key, F.lit(name).alias("side"), F.col(line).alias("line"), F.col(other).alias("other"))
    return side("left", "left", "r").unionByName(side("right", "right", "l"))


def difference(masked: DataFrame, key: str, text_col: str = "text", out_col: str = "masked", spans_col: str = "replacements") -> DataFrame:
    """key, line, old, new: lines that masking changed."""
    text, out = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(out_col), F.lit(""))
    left, right = F.split(text, "\n", -1), F.split(out, "\n", -1)
    rows = masked.filter(F.size(spans_col) > 0).select(key, left.alias("a"), right.alias("b"), F.explode(aligned(text, out, F.col(spans_col))).alias("x"))
    old = F.when(F.col("x.left").isNotNull(), F.get("a", F.col("x.left") - 1))
    new = F.when(F.col("x.right").isNotNull(), F.get("b", F.col("x.right") - 1))
    return rows.select(key, F.coalesce("x.left", "x.right").alias("line"), old.alias("old"), new.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))
