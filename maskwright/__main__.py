"""python -m maskwright mask|detect|check|list|config ...: the engine on files, folders, literal texts or standard input."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import mask as M
from maskwright.operators import report as R
from maskwright.plans import settings
from maskwright.plans.config import Config, load, resolve
from maskwright.plans.engine import Engine, list_detectors
from maskwright.sources import files


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="maskwright")
    p.add_argument("--config", help="settings file")
    p.add_argument("--profile", help="profile of the settings")
    what = p.add_subparsers(dest="what", required=True)
    for name in ("mask", "detect", "check"):
        c = what.add_parser(name)
        c.add_argument("path", nargs="?", help="file or folder; without one the text or standard input is read")
        c.add_argument("-t", "--text", action="append", default=[], help="a literal text")
        c.add_argument("--only", nargs="*", help="just these detectors")
        c.add_argument("--template")
        c.add_argument("--lines", action="store_true", help="each line is a document")
        c.add_argument("--per-document", action="store_true", help="numbers start anew in each document")
        c.add_argument("--values", action="store_true", help="show what was found")
        c.add_argument("-o", "--out", help="folder for masked files")
    what.add_parser("list")
    c = what.add_parser("config")
    c.add_argument("action", choices=("get", "set", "unset"))
    c.add_argument("key")
    c.add_argument("value", nargs="?")
    return p.parse_args(argv)


def configured(a: argparse.Namespace) -> Config:
    config = load(a.config, a.profile) if a.config else resolve({}, a.profile)
    if getattr(a, "only", None):
        config = config.only(*a.only)
    return config.changed(template=a.template, detectors={k: {x: y for x, y in v.items() if x != "template"} for k, v in config.detectors.items()}) if getattr(a, "template", None) else config


def documents(spark: SparkSession, a: argparse.Namespace, config: Config) -> DataFrame:
    """doc_id, file, text in the order of input."""
    if a.path:
        listed = files.read_documents(files.list_files(spark, a.path, config, out_dir=a.out)) if Path(a.path).is_dir() else files.read_documents(files.list_file(spark, a.path))
        return listed.withColumn("file", F.col("rel")).withColumn("doc_id", F.col("rel"))
    texts = a.text or [sys.stdin.read()]
    if a.lines:
        texts = [line for t in texts for line in t.splitlines()]
    return files.texts(spark, *texts).withColumn("file", F.lit("-"))


def run(spark: SparkSession, a: argparse.Namespace, out=None) -> int:
    """What is asked for; 1 if check finds something."""
    out = out or sys.stdout
    if a.what == "config":
        return edit(a, out)
    config = configured(a)
    if a.what == "list":
        for r in list_detectors(spark, config).orderBy("det_index").toLocalIterator():
            print(r["id"], r["category"], "on" if r["enabled"] else "off", r["name_en"], sep="\t", file=out)
        return 0
    engine = Engine(config)
    for w in engine.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if a.what == "mask" and a.path and a.out:
        listed = files.list_files(spark, a.path, config, out_dir=a.out) if Path(a.path).is_dir() else files.list_file(spark, a.path)
        for r in files.write_files(files.masked_files(listed, engine), a.out).toLocalIterator():
            print(r["out_path"] or f"{r['rel']}: {r['error']}", file=out if r["out_path"] else sys.stderr)
        return 0
    docs = documents(spark, a, config)
    if a.what == "mask":
        masked = M.mask(engine, docs) if a.per_document else M.mask_shared(engine, docs, "doc_id", "doc_id")
        for r in masked.orderBy("doc_id").select("masked").toLocalIterator():
            print(r["masked"] or "", file=out)
        return 0
    rows = M.span_rows(engine, docs, ["doc_id", "file"])
    if a.what == "check":
        found = R.gate(rows).first()
        print("found" if found["found"] else "nothing found", file=out)
        return found["exit_code"]
    for r in R.listing(rows, "file", a.values).orderBy("file", "start").toLocalIterator():
        print(r["line_text"], file=out)
    return 0


def edit(a: argparse.Namespace, out) -> int:
    path = Path(a.config or "maskwright.toml")
    text = path.read_text(encoding="utf-8") if path.exists() else ""
    if a.action == "get":
        print(settings.get(text, a.key), file=out)
        return 0
    new = settings.unset(text, a.key) if a.action == "unset" else settings.set_value(text, a.key, settings.parse_value(a.value or ""))
    path.write_text(new, encoding="utf-8")
    return 0


def main() -> int:
    a = arguments(sys.argv[1:])
    if a.what == "config":
        return edit(a, sys.stdout)
    root = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x)
    spark = SparkSession.builder.appName("maskwright").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
