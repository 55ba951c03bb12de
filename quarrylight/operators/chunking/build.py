"""Chunks from items (C1-C29, F10, M6-M7, P19-P21) as DataFrame plans.

``items`` turns files into one row an item; everything else is grouping by file
and type: the last definition of a type wins (``max_by``), impl blocks and
methods are put together in the order of the text, ranges are hulls of rows,
and items of more than five lines get chunks of their own.

Cases: a text that is null gives no chunk; an empty Rust file gives none, an
empty C++ file its skeleton; texts that cannot be scanned give none and are
listed by ``failures``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions import code_text as ct
from ...functions import paths
from ...plans.lineage import cut
from .scan import Item, scan

LARGE = 5  # fixed value: items of more lines get their own chunk
CHUNKERS = {"rust": scan, "cpp": scan}
_FIELDS = "ord int, item string, name string, kind string, scope string, owner string, header string, modifier string, block int, line_start int, line_end int, text string, body_at int, doc string"


def register_chunker(language: str, function) -> None:
    """``function(text, language)`` yields the items of a text."""
    CHUNKERS[language] = function


def items(files: DataFrame, keys: list[str], path: str, text: str, language: str) -> DataFrame:
    """One row an item; a file that fails gives one row with the error as its ``item``."""
    chunkers = dict(CHUNKERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            ids = list(zip(*[b[f"k{i}"] for i in range(len(keys))]))
            for id_, p, t, lang in zip(ids, b["p"], b["t"], b["l"]):
                try:
                    found = list(chunkers[lang](t, lang)) if lang in chunkers else []
                except Exception as e:  # noqa: BLE001 - a file must not end the job (C26)
                    found = [Item(0, f"error: {type(e).__name__}", *([None] * 7), 0, 0, "", None, None)]
                out += [(*id_, p, lang, *x) for x in found]
                if lang == "cpp":
                    out.append((*id_, p, lang, *Item(-1, "file", None, None, "", None, None, None, None, 0, 0, "", None, None)))
            frame = pd.DataFrame(out, columns=[*keys, "path", "language", *Item._fields])
            yield frame.astype({c: "Int64" for c in ("ord", "block", "line_start", "line_end", "body_at")})

    kinds = dict(files.dtypes)
    rows = files.where(F.col(text).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(path).alias("p"), F.col(text).alias("t"), F.col(language).alias("l"))
    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", path string, language string, {_FIELDS}")


def failures(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.where(F.col("item").startswith("error")).select(*keys, F.col("item").alias("error"))


def _bare(body: Column) -> Column:
    """The text without its body, with a semicolon."""
    cut = F.regexp_replace(F.substr(F.col("text"), F.lit(1), F.coalesce(body, F.length("text"))), r"\s+$", "")
    return F.concat(cut, F.lit(";"))


def _brief(doc: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" — "), doc), F.lit(""))


def _range(file: Column, start: Column, end: Column) -> Column:
    return F.concat(file, F.lit(":"), start.cast("string"), F.lit(".."), end.cast("string"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


_COLUMNS = "symbol_name kind chunk_type parent visibility line_start line_end signature doc_comment display_text embedding_text".split()


def _chunk(df: DataFrame, keys: list[str], order: list[Column], **columns: Column) -> DataFrame:
    order = [*order, *[F.lit(0)] * (3 - len(order))]
    return df.select(
        *keys, "path", "language", order[0].cast("int").alias("__a"), order[1].cast("string").alias("__b"), order[2].cast("int").alias("__c"), *[columns.get(c, F.lit(None).cast("int" if c.startswith("line") else "string")).alias(c) for c in _COLUMNS]
    )


def ordered(condition: Column, order: list[Column], *fields: Column) -> Column:
    """A3: the rows of a group that fit, as structs in their order."""
    return F.array_sort(F.collect_list(F.when(condition, F.struct(*order, *fields))))


def hull(condition: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """M7, A4: the first start and the last end of the rows of a group that fit."""
    return F.min(F.when(condition, start)), F.max(F.when(condition, end))


def _pieces(condition: Column, *fields: Column) -> Column:
    """The rows that fit, in the order of the text."""
    return ordered(condition, [F.col("ord")], *fields)


def rust_chunks(found: DataFrame, keys: list[str]) -> DataFrame:
    r = found.where(F.col("language") == "rust").withColumn("bare", _bare(body=F.col("body_at"))).withColumn("large", ct.line_count(F.col("line_start"), F.col("line_end")) > LARGE).withColumn("type", ct.base_type(F.when(F.col("item") == "type", F.col("name")).otherwise(F.col("owner"))))
    module, file = paths.module_path(F.col("path")), F.col("path")
    group = [*keys, "path", "language"]

    is_type, is_impl, is_method = (F.col("item") == x for x in ("type", "impl", "method"))
    piece = F.when(is_impl, F.concat(F.lit("\u0001"), F.col("header"), F.lit(" {"))).otherwise(F.concat(F.lit("\n    "), F.when(F.col("large"), F.col("bare")).otherwise(F.col("text"))))
    t = r.where(F.col("type").isNotNull()).groupBy(*group, "type").agg(
        F.max_by(F.when(is_type, F.struct("kind", "modifier", "text", "line_start", "line_end", "doc")), F.when(is_type, F.col("ord"))).alias("d"),
        _pieces(is_impl | is_method, piece.alias("piece")).alias("pieces"),
        *(x.alias(n) for x, n in zip(hull(is_impl, F.col("line_start"), F.col("line_end")), ("first", "last"))),
    )
    joined = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
    impls = F.when(F.size("pieces") > 0, F.concat(F.regexp_replace(F.substr(joined, F.lit(2)), "\u0001", "\n}\n\n"), F.lit("\n}")))
    t = t.withColumns({"display": F.concat_ws("\n\n", "d.text", impls), "s": F.least("d.line_start", "first"), "e": F.greatest("d.line_end", "last"), "v": ct.visibility(F.col("d.modifier"))})
    overview = _chunk(
        t, keys, [F.lit(0), F.col("type"), F.lit(-1)], symbol_name=F.col("type"), kind=F.coalesce("d.kind", F.lit("Impl")), chunk_type=F.lit("Overview"), visibility=F.col("v"), line_start=F.col("s"), line_end=F.col("e"),
        signature=ct.signature(F.col("d.text")), doc_comment=F.col("d.doc"), display_text=F.col("display"),
        embedding_text=_lines(F.concat(F.lit("// "), module, F.lit(" ("), _range(file, F.col("s"), F.col("e")), F.lit(")")), F.concat(F.lit("// "), ct.visibility_prefix(F.col("v")), F.col("type"), _brief(F.col("d.doc"))), F.col("display")),
    )

    v = ct.visibility(F.col("modifier"))
    m = r.where(is_method & F.col("large")).withColumns({"v": v, "symbol": F.concat("type", F.lit("::"), "name"), "display": F.concat("header", F.lit(" {\n    "), "text", F.lit("\n}"))})
    head = F.concat(F.lit("// "), module, F.lit(" ("), _range(file, F.col("line_start"), F.col("line_end")), F.lit(")"))
    methods = _chunk(
        m, keys, [F.lit(0), F.col("type"), F.col("ord")], symbol_name=F.col("symbol"), kind=F.lit("Function"), chunk_type=F.lit("Function"), parent=F.col("type"), visibility=F.col("v"), line_start=F.col("line_start"), line_end=F.col("line_end"),
        signature=ct.signature(F.col("text")), doc_comment=F.col("doc"), display_text=F.col("display"),
        embedding_text=_lines(head, F.concat(F.lit("// "), ct.visibility_prefix(F.col("v")), F.col("symbol"), _brief(F.col("doc"))), F.concat(F.lit("// "), F.col("header")), F.col("display")),
    )

    free = r.where(F.col("item") == "function").withColumn("module", ct.qualified(module, F.when(F.col("scope") != "", F.col("scope")))).withColumn("v", v)
    o = free.groupBy(*group).agg(_pieces(F.lit(True), F.when(F.col("large"), F.col("bare")).otherwise(F.col("text")).alias("piece")).alias("pieces"), F.min("line_start").alias("s"), F.max("line_end").alias("e"))
    o = o.withColumn("display", F.array_join(F.concat(F.array(F.concat(F.lit("// "), module)), F.transform("pieces", lambda x: x["piece"])), "\n\n"))
    module_overview = _chunk(
        o, keys, [F.lit(1)], symbol_name=ct.name_of(module), kind=F.lit("Module"), chunk_type=F.lit("Overview"), visibility=F.lit("Pub"), line_start=F.col("s"), line_end=F.col("e"), display_text=F.col("display"),
        embedding_text=_lines(F.concat(F.lit("// "), module, F.lit(" ("), _range(file, F.col("s"), F.col("e")), F.lit(")")), F.lit("// Module overview"), F.col("display")),
    )
    display = F.concat(F.lit("// "), F.col("module"), F.lit("\n"), F.col("text"))
    functions = _chunk(
        free.where("large"), keys, [F.lit(2), F.lit(""), F.col("ord")], symbol_name=F.col("name"), kind=F.lit("Function"), chunk_type=F.lit("Function"), visibility=F.col("v"), line_start=F.col("line_start"), line_end=F.col("line_end"),
        signature=ct.signature(F.col("text")), doc_comment=F.col("doc"), display_text=display,
        embedding_text=_lines(F.concat(F.lit("// "), F.col("module"), F.lit(" ("), _range(file, F.col("line_start"), F.col("line_end")), F.lit(")")), F.concat(F.lit("// "), ct.visibility_prefix(F.col("v")), F.col("name"), _brief(F.col("doc"))), display),
    )
    return overview.union(methods).union(module_overview).union(functions)


def cpp_chunks(found: DataFrame, keys: list[str]) -> DataFrame:
    owner = ct.owner_of(F.col("name"))
    is_free = (F.col("item") == "function") & owner.isNull()
    key = (
        F.when(F.col("item") == "type", F.col("name")).when(F.col("item").isin("method", "member"), F.col("owner"))
        .when((F.col("item") == "function") & owner.isNotNull(), F.when((F.col("scope") == "") | owner.contains("::"), owner).otherwise(F.concat_ws("::", "scope", owner)))
    )
    c = found.where(F.col("language") == "cpp").withColumn("bare", _bare(body=F.col("body_at"))).withColumn("large", ct.line_count(F.col("line_start"), F.col("line_end")) > LARGE).withColumn("class", key).withColumn("free", is_free)
    file, group = F.col("path"), [*keys, "path", "language"]
    is_type, out = F.col("item") == "type", (F.col("item") == "function") & ~F.col("free")
    name = ct.name_of(F.col("name"))

    member = F.when(F.col("kind") == "access", F.concat(F.lit("\n"), "name", F.lit(":"))).otherwise(
        F.concat(F.coalesce(F.concat(F.lit("\n    "), "header"), F.lit("")), F.lit("\n    "), F.when(F.col("item") == "method", F.col("bare")).otherwise(F.trim("text")))
    )
    t = c.where(F.col("class").isNotNull()).groupBy(*group, "class").agg(
        F.max_by(F.when(is_type, F.struct("text", "line_start", "line_end", "doc", "ord")), F.when(is_type, F.col("ord"))).alias("d"), F.min("ord").alias("at"),
        _pieces(F.col("item").isin("method", "member"), F.col("line_start"), F.col("line_end"), member.alias("piece")).alias("members"), _pieces(out, F.col("bare")).alias("outs"),
        *(x.alias(n) for x, n in zip(hull(out, F.col("line_start"), F.col("line_end")), ("first", "last"))),
    )
    listed = F.array_join(F.transform(F.filter("members", lambda x: (x["ord"] > F.col("d.ord")) & (x["line_start"] >= F.col("d.line_start")) & (x["line_end"] <= F.col("d.line_end"))), lambda x: x["piece"]), "")
    definition = F.when(F.col("d").isNotNull(), F.concat(ct.signature(F.col("d.text")), F.lit(" {"), listed, F.lit("\n};"))).otherwise(F.concat(F.lit("// (forward) class "), F.col("class"), F.lit(";")))
    outs = F.when(F.size("outs") > 0, F.concat(F.lit("// out-of-class definitions:\n"), F.array_join(F.transform("outs", lambda x: x["bare"]), "\n")))
    t = t.withColumns({"display": F.concat_ws("\n\n", definition, outs), "s": F.least("d.line_start", "first"), "e": F.greatest("d.line_end", "last"), "name": F.lpad(F.col("at").cast("string"), 10, "0")})
    t = t.where(F.col("s").isNotNull())
    overview = _chunk(
        t, keys, [F.lit(1), F.col("name"), F.lit(-1)], symbol_name=F.col("class"), kind=F.lit("Struct"), chunk_type=F.lit("Overview"), visibility=F.lit("Pub"), line_start=F.col("s"), line_end=F.col("e"), signature=ct.signature(F.col("d.text")), doc_comment=F.col("d.doc"), display_text=F.col("display"),
        embedding_text=_lines(F.concat(F.lit("// "), _range(file, F.col("s"), F.col("e"))), F.concat(F.lit("// class "), F.col("class"), _brief(F.col("d.doc"))), F.col("display")),
    )

    order = Window.partitionBy(*group, "class")
    m = c.where(F.col("class").isNotNull()).withColumn("at", F.lpad(F.min("ord").over(order).cast("string"), 10, "0")).where((out | (F.col("item") == "method")) & F.col("large"))
    m = m.withColumns({"symbol": F.concat("class", F.lit("::"), name), "display": F.concat(F.lit("// class "), "class", F.lit("\n"), "text"), "place": F.when(out, F.col("ord") + 1_000_000).otherwise(F.col("ord"))})
    head = F.concat(F.lit("// "), _range(file, F.col("line_start"), F.col("line_end")))
    methods = _chunk(
        m, keys, [F.lit(1), F.col("at"), F.col("place")], symbol_name=F.col("symbol"), kind=F.lit("Function"), chunk_type=F.lit("Function"), parent=F.col("class"), visibility=F.lit("Pub"), line_start=F.col("line_start"), line_end=F.col("line_end"),
        signature=ct.signature(F.col("text")), doc_comment=F.col("doc"), display_text=F.col("display"), embedding_text=_lines(head, F.concat(F.lit("// "), F.col("symbol"), _brief(F.col("doc"))), F.col("display")),
    )

    roster = F.when(F.col("free") & (F.col("scope") != ""), F.concat(F.lit("// in namespace "), "scope", F.lit("\n"), "bare")).otherwise(F.col("bare"))
    f = c.groupBy(*group).agg(
        _pieces(F.col("item") == "directive", F.col("block"), F.col("text")).alias("directives"), F.array_sort(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("ord", "class")))).alias("classes"), _pieces(F.col("free"), roster.alias("piece")).alias("frees"),
    )
    classes = F.transform(F.array_distinct(F.transform("classes", lambda x: x["class"])), lambda x: F.concat(F.lit("class "), x, F.lit(";")))
    symbols = F.concat(classes, F.transform("frees", lambda x: x["piece"]))
    blank = lambda a, text: F.when(F.size(a) > 0, text)
    display = F.concat_ws("\n\n", F.concat(F.lit("// "), file), blank(F.col("directives"), F.array_join(F.transform("directives", lambda x: x["text"]), "\n")), blank(symbols, F.array_join(symbols, "\n")))
    skeleton = _chunk(
        f.withColumn("display", display), keys, [F.lit(0)], symbol_name=paths.module_name(file), kind=F.lit("Module"), chunk_type=F.lit("Overview"), visibility=F.lit("Pub"), line_start=F.lit(0), line_end=F.lit(0), display_text=F.col("display"),
        embedding_text=_lines(F.concat(F.lit("// "), file), F.lit("// File skeleton — preprocessor directives and top-level symbols"), F.col("display")),
    )

    n = c.where(F.col("free") & F.col("large")).withColumns({"symbol": ct.qualified(F.col("scope"), name), "display": F.concat(F.when(F.col("scope") != "", F.concat(F.lit("// namespace "), "scope", F.lit("\n"))).otherwise(""), "text")})
    functions = _chunk(
        n, keys, [F.lit(2), F.lit(""), F.col("ord")], symbol_name=F.col("symbol"), kind=F.lit("Function"), chunk_type=F.lit("Function"), visibility=F.lit("Pub"), line_start=F.col("line_start"), line_end=F.col("line_end"),
        signature=ct.signature(F.col("text")), doc_comment=F.col("doc"), display_text=F.col("display"), embedding_text=_lines(head, F.concat(F.lit("// "), F.col("symbol"), _brief(F.col("doc"))), F.col("display")),
    )
    return skeleton.union(overview).union(methods).union(functions)


def chunk_items(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, language, chunk_ord`` and the chunk columns; ``chunk_ord`` counts from 0 in each file."""
    both = rust_chunks(found, keys).union(cpp_chunks(found, keys))
    order = Window.partitionBy(*keys).orderBy("__a", "__b", "__c", "line_start", "symbol_name")
    return both.withColumn("chunk_ord", F.row_number().over(order) - 1).select(*keys, "path", "language", "chunk_ord", *_COLUMNS)


def chunk_files(files: DataFrame, keys: list[str], path: str, text: str, language: str) -> DataFrame:
    """All chunks of the files; the items are scanned once and written to the shared folder, as several plans read them."""
    return chunk_items(cut(items(files, keys, path, text, language)), keys)
