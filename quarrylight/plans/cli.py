"""Command line (U4, K3): ``python -m quarrylight.plans.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import CodeIndex


def rendered(results: DataFrame) -> DataFrame:
    """K3: one text a result: place, score, position, module and code."""
    dep = F.when(F.lower("origin") == "dependency", F.concat(F.lit(" [dep: "), "crate_name", F.lit("]"))).otherwise("")
    head = F.concat(F.format_string("#%d [score: %.4f]", "rank", "score"), dep, F.lit(" "), "file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    module = F.when(F.col("module_path") != "", F.concat(F.lit("// in "), "module_path"))
    return results.select("rank", F.concat_ws("\n", head, module, "display_text", F.lit("")).alias("text"))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrylight")
    parser.add_argument("--project", default=".")
    parser.add_argument("--folder")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("rebuild-index").add_argument("--source")
    search = commands.add_parser("search")
    search.add_argument("text")
    search.add_argument("--top-k", type=int, default=10)
    overview = commands.add_parser("overview")
    overview.add_argument("file", nargs="?")
    overview.add_argument("--dep")
    model = commands.add_parser("set-embedding-model")
    model.add_argument("name")
    add = commands.add_parser("add")
    add.add_argument("language")
    add.add_argument("root")
    add.add_argument("--dep", action="store_true")
    add.add_argument("--extensions", nargs="*")
    commands.add_parser("sources")
    commands.add_parser("remove").add_argument("index", type=int)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("quarrylight").getOrCreate()
    index = CodeIndex(spark, a.project, a.folder)
    if a.command == "rebuild-index":
        row = (index.rebuild_source(a.source) if a.source else index.index()).first()
        print(f"files indexed: {row['files_indexed']}, chunks created: {row['chunks_created']}")
    elif a.command == "search":
        for row in rendered(index.search(a.text, a.top_k)).orderBy("rank").collect():  # k rows
            print(row["text"])
    elif a.command == "overview":
        if (a.file is None) == (a.dep is None):
            parser.error("name a file or a dependency")
        print(index.overview(a.file) if a.file else index.dep_overview(a.dep))
    elif a.command == "set-embedding-model":
        index.set_embedding_model(a.name)
    elif a.command == "add":
        index.add_source(a.language, a.root, a.dep, a.extensions)
    elif a.command == "remove":
        index.remove_source(a.index)
    else:
        for row in index.list_sources().orderBy("source_ord").collect():
            print(f"{row['source_ord']}: {row['language']} {row['root']}{' (dependency)' if row['dep'] else ''}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
