"""python -m skein show LAYER ROOT: print a text layer as its files have it, scenes and digest as prose, or (--rows) the rows read from it."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import views
from .sources import layers

READERS = {n.removeprefix("read_"): getattr(layers, n) for n in dir(layers) if n.startswith("read_") and n not in ("read_kg",)}
#: one file a canticle, not a canto
WHOLE = ("registry", "topography", "cohort")


def as_text(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(canticle, [canto,] text) of a layer."""
    if a.layer == "scenes":
        return views.scene_view(layers.read_scenes(spark, a.root))
    if a.layer == "digest" and a.scenes and a.lock:
        langs = views.LANGUAGES if a.lang == "both" else (a.lang,)
        return views.digest_view(layers.read_digest(spark, a.root), layers.read_scenes(spark, a.scenes), layers.read_lock(spark, a.lock), langs)
    if a.layer == "kg" or a.layer in WHOLE:
        name = f"{a.part}.jsonl" if a.layer == "kg" else "*.txt"
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(a.root, wholetext=True)
        which = r"([^/]+)/[^/]+$" if a.layer == "kg" else r"([^/]+)\.txt$"
        return df.select(F.regexp_extract("_metadata.file_path", which, 1).alias("canticle"), F.col("value").alias("text"))
    return layers._files(spark, a.root, "toml" if a.layer == "lock" else "txt").withColumnRenamed("value", "text")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skein")
    sub = p.add_subparsers(dest="command", required=True)
    show = sub.add_parser("show")
    show.add_argument("layer", choices=sorted({*READERS, "kg"}))
    show.add_argument("root")
    show.add_argument("-u", "--unit", help="a canticle")
    show.add_argument("-c", "--canto", type=int)
    show.add_argument("--part", default="edges", choices=sorted(layers.KG_SCHEMAS), help="of the graph")
    show.add_argument("--scenes", help="root of the scenes, for a digest as prose")
    show.add_argument("--lock", help="root of the locks, for a digest as prose")
    show.add_argument("--lang", default="both", choices=(*views.LANGUAGES, "both"))
    show.add_argument("--rows", action="store_true", help="rows as JSON lines")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("skein").getOrCreate()
    n = 0
    try:
        df = as_text(spark, a) if not a.rows else layers.read_kg(spark, a.root, a.part) if a.layer == "kg" else READERS[a.layer](spark, a.root)
        for name, value in (("canticle", a.unit), ("canto", a.canto)):
            if value is not None and name in df.columns:
                df = df.where(F.col(name) == value)
        if not a.rows:
            df = df.orderBy(*[c for c in ("canticle", "canto") if c in df.columns])
        for n, row in enumerate(df.toLocalIterator(), 1):
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) if a.rows else row["text"].removesuffix("\n"))
    except Exception as e:  # a missing layer is an error of the caller's
        print(f"cannot read {a.layer} from {a.root}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    if not n:
        print(f"nothing of {a.layer} in {a.root}", file=sys.stderr)
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
