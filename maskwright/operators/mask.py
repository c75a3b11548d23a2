"""Masking: numbering of values, rendering, and the masked text, all in the row; and numbers shared by all documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.plans.engine import Engine
from maskwright.plans.storage import stored

def _compatible() -> dict[str, str]:
    """Characters that compatibility normalisation (NFKC) turns into one other."""
    out = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000)]):
        n = unicodedata.normalize("NFKC", c)
        if len(n) == 1 and n != c:
            out[c] = n
    return out


COMPATIBLE = _compatible()
#: Half-width kana with a sound mark after them, and what they are together.
VOICED = {a + b: n for a in map(chr, range(0xFF66, 0xFF9E)) for b in "\uff9e\uff9f" if len(n := unicodedata.normalize("NFKC", a + b)) == 1}
WIDE, PLAIN = "".join(COMPATIBLE), "".join(COMPATIBLE.values())


def compatible(value: Column) -> Column:
    """Full-width and half-width forms and other variants in their plain form. ASCII stays without a look."""
    pairs = value
    for two, one in VOICED.items():
        pairs = F.replace(pairs, F.lit(two), F.lit(one))
    wide = F.when(value.rlike("[\uff9e\uff9f]"), pairs).otherwise(value)
    return F.when(F.octet_length(value) == F.length(value), value).otherwise(F.translate(wide, WIDE, PLAIN))


def normalized(value: Column) -> Column:
    """Equal values in other spellings: full-width forms, case and spaces don't matter; mostly digits: only they count."""

    def one(v):
        digits = F.regexp_replace(v, "[^0-9]", "")
        alnum = F.length(F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))
        return F.when((F.length(digits) >= 6) & (F.length(digits) * 10 >= alnum * 8), digits).otherwise(F.lower(F.regexp_replace(v, r"\s", "")))

    return S.let(compatible(value), one)


def described(engine: Engine, text: Column, spans: Column) -> Column:
    """Spans with label, original and norm_value."""

    def one(x):
        value = S.value_of(text, x)
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "conf", "det")], engine.meta(x["det"])["label"].alias("label"), value.alias("original"), normalized(value).alias("norm_value"))

    return F.transform(spans, one)


def numbered(described_: Column) -> Column:
    """With n: the place of the value among those of its label, by first appearance in the document."""
    key = lambda x: F.struct(x["label"].alias("label"), x["norm_value"].alias("norm_value"))
    distinct = F.array_distinct(F.transform(described_, key))

    def one(x):
        upto = F.slice(distinct, 1, F.greatest(F.array_position(distinct, key(x)).cast("int"), F.lit(1)))
        n = F.size(F.filter(upto, lambda y: y["label"] == x["label"]))
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "conf", "det", "label", "original", "norm_value")], n.cast("int").alias("n"))

    return F.transform(described_, one)


def replaced(engine: Engine, spans: Column) -> Column:
    """With replacement."""
    names = ("start", "end", "conf", "det", "label", "original", "norm_value", "n")
    return F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in names], engine.rendered(x["det"], x["original"], x["n"]).alias("replacement")))


def output(text: Column, spans: Column) -> Column:
    """The text with each span replaced; spans are disjoint and by start. Gaps and replacements are joined once."""
    last = F.size(spans) - 1
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    parts = F.transform(spans, lambda x, i: F.concat(F.substring(text, begin(i) + 1, x["start"] - begin(i)), x["replacement"]))
    tail = F.substring(text, F.get(spans, last)["end"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), tail))


def mask(engine: Engine, df: DataFrame, text_col: str = "text", out_col: str = "masked", spans_col: str = "replacements", extra_col: str | None = None) -> DataFrame:
    """df with the masked text and its replacements, numbered for each row on its own. No shuffle; null stays null."""
    found = engine.detect(df, text_col, extra_col, "__spans").withColumn("__clean", S.clean(F.col(text_col)))
    found = S.once(found, "__spans", described(engine, F.col("__clean"), F.col("__spans")))
    found = S.once(S.once(found, "__spans", numbered(F.col("__spans"))), spans_col, replaced(engine, F.col("__spans")))
    own = F.coalesce(F.col(text_col), F.lit(""))
    return found.withColumn(out_col, F.when(F.col(text_col).isNotNull(), output(own, F.col(spans_col)))).drop("__spans", "__clean")


def with_offsets(spans: Column) -> Column:
    """Replacements with out_start and out_end, their place in the masked text."""

    def step(acc, x):
        begin = x["start"] + acc["shift"]
        end = begin + F.length(x["replacement"])
        names = ("start", "end", "conf", "det", "label", "original", "norm_value", "n", "replacement")
        row = F.struct(*[x[c].alias(c) for c in names], begin.cast("int").alias("out_start"), end.cast("int").alias("out_end"))
        return F.struct((end - x["end"]).cast("int").alias("shift"), F.array_append(acc["out"], row).alias("out"))

    kind = "array<struct<start:int,end:int,conf:double,det:int,label:string,original:string,norm_value:string,n:int,replacement:string,out_start:int,out_end:int>>"
    return F.aggregate(spans, F.struct(F.lit(0).alias("shift"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def span_rows(engine: Engine, df: DataFrame, keys: list[str], text_col: str = "text", extra_col: str | None = None) -> DataFrame:
    """One row for each resolved span: keys, id, category, label, priority, det_index, offsets, line and column, values."""
    found = engine.detect(df, text_col, extra_col, "__spans").withColumn("__clean", S.clean(F.col(text_col)))
    text = F.col("__clean")
    x = found.select(*keys, "__clean", F.explode(described(engine, text, F.col("__spans"))).alias("x"))
    at = F.col("x.start")
    meta = engine.meta(F.col("x.det"))
    return x.select(
        *keys, meta["id"].alias("id"), meta["category"].alias("category"), F.col("x.label").alias("label"), meta["name"].alias("name"), meta["priority"].alias("priority"),
        F.col("x.det").alias("det_index"), at.alias("start"), F.col("x.end").alias("end"),
        S.bytes_before(text, at).alias("byte_start"), S.bytes_before(text, F.col("x.end")).alias("byte_end"),
        S.line_of(text, at).alias("line"), S.column_of(text, at).alias("column"),
        F.col("x.conf").alias("confidence"), F.col("x.original").alias("original"), F.col("x.norm_value").alias("norm_value"),
    )


def numbering(rows: DataFrame, order: str) -> DataFrame:
    """label, norm_value, n: numbers by first appearance over all documents, from span rows and the column that orders these.

    A label may hold a third of all values, so values are ranked without one task for each label: they are sorted by range,
    written, counted by part, and a row's number is its rank in its part plus what the parts before hold of its label."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = rows.groupBy("label", "norm_value").agg(F.min(F.struct(F.col(order).alias("o"), F.col("start").alias("s"), F.col("det_index").alias("d"))).alias("first"))
    parts = stored(first.repartitionByRange(n, "label", "first").withColumn("part", F.spark_partition_id()), "numbering")
    counts = parts.groupBy("label", "part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    rank = F.row_number().over(Window.partitionBy("part", "label").orderBy("first"))
    return parts.withColumn("rank", rank).join(offsets, ["label", "part"]).select("label", "norm_value", (F.col("rank") + F.col("offset")).cast("int").alias("n"))


def with_numbers(engine: Engine, df: DataFrame, rows: DataFrame, numbers: DataFrame, key: str, text_col: str = "text", out_col: str = "masked") -> DataFrame:
    """df with its masked text, from span rows (key, label, norm_value, start, end, det_index, original) and numbers of values."""
    done = rows.join(numbers, ["label", "norm_value"]).withColumn("replacement", engine.rendered(F.col("det_index"), F.col("original"), F.col("n")))
    by_doc = done.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("__spans"))
    joined = df.join(by_doc, F.col(key) == F.col("__key"), "left")
    own = F.coalesce(F.col(text_col), F.lit(""))
    masked = F.when(F.col("__spans").isNull(), own).otherwise(output(own, F.col("__spans")))
    return joined.withColumn(out_col, F.when(F.col(text_col).isNotNull(), masked)).drop("__key", "__spans")


def mask_shared(engine: Engine, df: DataFrame, key: str, order: str, text_col: str = "text", out_col: str = "masked") -> DataFrame:
    """key, masked text: equal values have equal numbers in all documents. key is unique; order sorts documents."""
    rows = span_rows(engine, df, list(dict.fromkeys([key, order])), text_col)
    rows = stored(rows.select(*dict.fromkeys([key, order]), "start", "end", "det_index", "label", "original", "norm_value"), "mask-spans")
    return with_numbers(engine, df, rows, numbering(rows, order), key, text_col, out_col)
