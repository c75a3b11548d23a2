"""Folders of files as tables of documents, and masked files back, spread over the executors."""

import fnmatch
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import mask as M
from maskwright.plans.config import Config
from maskwright.plans.engine import Engine
from maskwright.plans.storage import stored
from maskwright.sources import formats

DOCUMENT = "text string, kind string, encoding string, bom boolean, warnings array<string>, properties array<struct<label:string,value:string>>, locations array<struct<offset:int,label:string>>, error string"


def texts(spark: SparkSession, *values: str) -> DataFrame:
    """Literal texts: doc_id, text."""
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def globs(patterns: tuple[str, ...], name: Column) -> Column:
    """Whether a name, in lower case, matches one of the globs."""
    wanted = [p.strip().lower() for p in patterns if p.strip()]
    return name.rlike("|".join(fnmatch.translate(p).replace(r"\Z", r"\z").replace("(?s:", "(?s:") for p in wanted)) if wanted else F.lit(False)


def list_files(spark: SparkSession, root: str, config: Config | None = None, recursive: bool = True, out_dir: str | None = None) -> DataFrame:
    """path, rel, content of the files that the settings include, without earlier outputs, by rel."""
    c = config or Config()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", r"\A[a-z]+:/*", "/"), r"\A" + re.escape(base) + "/", "")
    name = F.lower(F.substring_index("rel", "/", -1))
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    suffix = c.suffix.lower()
    files = raw.select("path", rel.alias("rel"), "content", "length").filter(globs(c.include, name) & ~globs(c.exclude, name))
    if suffix:
        files = files.filter(~(stem.endswith(suffix) | name.contains(suffix + ".")))
    files = files.filter(~F.col("path").contains(out_dir.rstrip("/") + "/")) if out_dir else files
    return files.orderBy("rel")


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """path, rel, content, length of one file."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring_index("path", "/", -1).alias("rel"), "content", "length")


def read_documents(files: DataFrame, forced: str | None = None) -> DataFrame:
    """files with text, kind, encoding and the rest of DOCUMENT. A file that can't be read has an error and no text; the job goes on."""
    kind = pa.struct([
        ("text", pa.string()), ("kind", pa.string()), ("encoding", pa.string()), ("bom", pa.bool_()), ("warnings", pa.list_(pa.string())),
        ("properties", pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))), ("locations", pa.list_(pa.struct([("offset", pa.int32()), ("label", pa.string())]))), ("error", pa.string()),
    ])

    def read(paths: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for p, b in zip(paths.to_pylist(), contents.to_pylist(), strict=True):
            try:
                d = formats.open_document(p, b or b"", forced)
                out.append({"text": d.text, "kind": d.kind, "encoding": d.encoding, "bom": d.bom, "warnings": d.warnings, "properties": [{"label": k, "value": v} for k, v in d.properties], "locations": [{"offset": o, "label": v} for o, v in d.locations], "error": None})
            except Exception as e:  # noqa: BLE001  one bad file must not end the job
                out.append({"text": None, "kind": formats.kind_of(p), "encoding": None, "bom": None, "warnings": [], "properties": [], "locations": [], "error": str(e)[:500]})
        return pa.array(out, kind)

    opened = files.withColumn("__d", F.arrow_udf(read, f"struct<{', '.join(_fields())}>").asNondeterministic()("path", "content"))
    return opened.select(*files.columns, "__d.*")


def _fields() -> list[str]:
    parts, depth, now = [], 0, ""
    for c in DOCUMENT + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = now.strip().partition(" ")
            parts.append(f"{name}: {kind}")
            now = ""
        else:
            now += c
    return parts


def masked_files(files: DataFrame, engine: Engine, forced: str | None = None) -> DataFrame:
    """rel, source, out_rel, masked binary, n, error: the masked bytes of each file."""
    c = engine.config
    opened = read_documents(files, forced)
    if c.properties == "mask":  # values of properties go on behind the text, so that equal values have equal numbers
        own = F.array_join(F.transform("properties", lambda x: F.replace(x["value"], F.lit("\n"), F.lit(" "))), "\n")
        opened = opened.withColumn("text", F.when(F.size("properties") > 0, F.concat("text", F.lit("\n"), own)).otherwise(F.col("text")))
    found = M.mask(engine, opened)
    pieces = F.transform("replacements", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement")))
    properties = "clear" if c.properties == "ask" else c.properties

    def write(paths: pa.Array, contents: pa.Array, pieces_: pa.Array, errors: pa.Array) -> pa.Array:
        out = []
        for p, b, rs, e in zip(paths.to_pylist(), contents.to_pylist(), pieces_.to_pylist(), errors.to_pylist(), strict=True):
            try:
                got = None if e else formats.write_document(p, b or b"", [(r["start"], r["end"], r["replacement"]) for r in rs or []], forced, c.output_encoding, properties)
                out.append({"masked": got, "error": e})
            except Exception as x:  # noqa: BLE001
                out.append({"masked": None, "error": str(x)[:500]})
        return pa.array(out, pa.struct([("masked", pa.binary()), ("error", pa.string())]))

    def rename(paths: pa.Array) -> pa.Array:
        return pa.array([formats.output_name(p, c.suffix) for p in paths.to_pylist()])

    done = found.withColumn("__w", F.arrow_udf(write, "struct<masked: binary, error: string>").asNondeterministic()("path", "content", pieces, "error"))
    return done.select("rel", F.col("path").alias("source"), F.arrow_udf(rename, "string")("rel").alias("out_rel"), F.col("__w.masked").alias("masked"), F.size("replacements").alias("n"), F.col("__w.error").alias("error"))


def write_files(masked: DataFrame, out_dir: str) -> DataFrame:
    """Writes each masked file under out_dir, in any file system that Spark reads, and returns rel, out_path, n, error. The
    files are there when it returns; an error row has no file. A file that is read is never written over."""
    spark = masked.sparkSession
    root = out_dir.rstrip("/")
    placed = F.when(F.col("masked").isNotNull() & (F.col("error").isNull()), F.concat(F.lit(root + "/"), F.col("out_rel")))
    same = F.col("source").isNotNull() & (_plain(F.col("source")) == _plain(placed)) if "source" in masked.columns else F.lit(False)
    rows = masked.withColumn("out_path", F.when(~F.coalesce(same, F.lit(False)), placed))
    rows = rows.withColumn("error", F.coalesce("error", F.when(same, "the output would replace the input")))
    held = stored(rows.select("rel", "out_path", "n", "error", F.when(F.col("out_path").isNotNull(), F.col("masked")).alias("masked")), "masked-files")
    save(held.filter("out_path IS NOT NULL").select("out_path", "masked"))
    return held.select("rel", "out_path", "n", "error")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"\A[a-z]+:/*", "/")


def save(files: DataFrame) -> None:
    """An action that writes files (out_path, masked) from the executors. Each goes to a name of its own first, so that a
    task that runs again, or twice at once, leaves whole files."""
    import os
    import uuid

    from pyarrow import fs

    def write(rows) -> None:
        for path, data in rows:
            target = str(path)
            system, target = fs.FileSystem.from_uri(target if "://" in target else "file://" + target.removeprefix("file:"))
            part = f"{target}.{uuid.uuid4().hex}.part"
            system.create_dir(os.path.dirname(target), recursive=True)
            with system.open_output_stream(part) as f:
                f.write(bytes(data))
            system.move(part, target)

    files.foreachPartition(write)
