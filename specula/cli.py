"""Command line: python -m specula {ingest,preprocess,gold,validate,build,analyse} --root FOLDER ..."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from specula.plans import pipeline
from specula.sources.adapters import yt_dlp
from specula.sources.tables import Layout


def _load(name: str | None):
    """package.module:function"""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="specula")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("ingest", "preprocess", "gold", "validate", "build", "analyse"):
        v = verbs.add_parser(name)
        v.add_argument("--root", required=name != "analyse")
        if name in ("ingest", "build"):
            v.add_argument("--source", help="CSV with the columns Media and Video Ground Truth")
            v.add_argument("--link", action="append", default=[])
            v.add_argument("--download", metavar="FOLDER", help="download what is new into this mounted folder")
            v.add_argument("--dedup-within-batch", action="store_true")
        if name in ("ingest", "preprocess", "gold", "build"):
            v.add_argument("--limit", type=int)
        if name in ("preprocess", "gold", "build", "analyse"):
            v.add_argument("--max-frames", type=int)
            v.add_argument("--decoder", help="module:function, e.g. specula.sources.adapters:opencv, else the raw container")
        if name in ("preprocess", "build", "analyse"):
            v.add_argument("--detector", help="module:function, e.g. specula.sources.adapters:retinaface")
            v.add_argument("--tracker", help="module:function, e.g. specula.sources.adapters:csrt")
            v.add_argument("--detect-every", type=int, default=1, help="detect on every n-th sample, track between")
        if name in ("preprocess", "build"):
            v.add_argument("--overwrite", action="store_true")
        if name in ("gold", "build", "analyse"):
            v.add_argument("--groups", default="abcde")
        if name in ("gold", "build"):
            v.add_argument("--train", type=float, default=0.7)
            v.add_argument("--validation", type=float, default=0.15)
            v.add_argument("--threshold", type=float, default=0.5)
        if name == "build":
            v.add_argument("--skip", action="append", default=[], choices=["ingest", "preprocess", "gold", "validate"])
        if name == "analyse":
            v.add_argument("video")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(argv))
    verb, root = given.pop("verb"), given.pop("root", None)
    spark = spark or SparkSession.builder.appName("specula").getOrCreate()
    given = {k: v for k, v in given.items() if v is not None}
    for k in ("decoder", "detector", "tracker"):
        if k in given:
            given[k] = _load(given[k])
    if verb == "analyse":
        _, row = pipeline.process_video(spark, given.pop("video"), **given)
        print(pipeline.to_json(row))
        return 0
    layout = Layout(root)
    if folder := given.pop("download", None):
        given["fetch"] = yt_dlp(folder)
    links = given.pop("link", [])
    if verb == "ingest":
        pipeline.run_ingest(spark, layout, given.pop("source", None), links, **given)
    elif verb == "build":
        print(pipeline.to_json(pipeline.run_build(spark, layout, given.pop("source", None), tuple(given.pop("skip")), **given)))
    elif verb == "validate":
        print(pipeline.to_json(pipeline.run_validate(spark, layout)))
    else:
        {"preprocess": pipeline.run_preprocess, "gold": pipeline.run_gold}[verb](spark, layout, **given)
    return 0
