"""Source files that do not parse.

Every file is parsed as the language of its extension (``rs`` is Rust, all else
C++).  Where the work happens: one pass of ``mapInPandas`` over the files, no
shuffle of text; the rates are an aggregate of its narrow result.

Cases: rows with a null key are left out; a null text counts as empty; brackets
may be nested to any depth; empty texts and texts of comments only are
valid.  A file that is delivered twice gives two equal rows here; ``rates``
counts each file once.  Columns of the input that clash with the result's names
are not read.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import Tokens, unbalanced_conditionals
from .cpp import CppParser
from .grammar import Parser
from .rust import RustParser

_MEMO: dict[bool, dict] = {True: {}, False: {}}


def is_rust(path: str | None) -> bool:
    return (path or "").lower().endswith(".rs")


_BRANCH = re.compile(r"#\s*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b")
_MACRO_NAME = re.compile(r"[A-Z][A-Z0-9_]+")


def _without(tokens: Tokens, gone: set[int]) -> Tokens:
    """The tokens with some parts as trivia."""
    out = copy.copy(tokens)
    out.codes = ["" if i in gone else c for i, c in enumerate(tokens.codes)]
    out.kinds = "".join(out.codes)
    return out


def _closed(words: list[str], at: int) -> int:
    """Behind the parenthesis that opens at ``at``."""
    depth = 0
    for i in range(at, len(words)):
        depth += (words[i] == "(") - (words[i] == ")")
        if not depth:
            return i + 1
    return len(words)


def _annotations(tokens: Tokens) -> set[int]:
    """Parts that compilers or modules add to declarations: attributes by keyword, export macros of classes, module and import lines."""
    places = tokens.places()
    words = [tokens.parts[i].strip() for i in places]
    gone: set[int] = set()
    modules = any(w == "module" and (i == 0 or words[i - 1] in (";", "export")) for i, w in enumerate(words))
    at = 0
    while at < len(words):
        w, end = words[at], at
        if w in ("__attribute__", "__declspec") and words[at + 1 : at + 2] == ["("]:
            end = _closed(words, at + 1)
        elif w in ("class", "struct") and at + 3 < len(words) and _MACRO_NAME.fullmatch(words[at + 1]) and tokens.codes[places[at + 2]] == "i" and words[at + 3] in ("{", ":", "final"):
            gone.add(places[at + 1])
        elif modules and w == "export":
            end = at + 1
        if modules and w in ("module", "import") and (at == 0 or words[at - 1] in (";", "export", "}")):
            end = words.index(";", at) + 1 if ";" in words[at:] else at
        gone.update(places[at:end])
        at = max(at + 1, end)
    return gone


def _branches(tokens: Tokens) -> list[set[int]]:
    """For each way through the conditionals the parts it leaves out: the first branches, the second ones, and so on."""
    open_: list[list[int]] = []  # group, branch
    most: list[int] = []
    inside: list[list[tuple[int, int]]] = []
    for p, c in zip(tokens.parts, tokens.codes):
        m = None if c else _BRANCH.match(p.lstrip())
        if m and m.group(1).startswith("if"):
            open_.append([len(most), 0])
            most.append(0)
        elif m and open_ and m.group(1) == "endif":
            open_.pop()
        elif m and open_:
            open_[-1][1] += 1
            most[open_[-1][0]] += 1
        inside.append([(g, b) for g, b in open_])
    ways = max(most, default=0) + 1
    return [{i for i, at in enumerate(inside) if any(b != min(way, most[g]) for g, b in at)} for way in range(ways)] if ways > 1 else []


def parse(text: str, rust: bool) -> tuple[Tokens, Parser]:
    """Tokens and the parser that has run over them; it remembers statement shapes for the life of the worker.

    A C++ text that doesn't parse as it stands is read again without annotations,
    and with each branch of its conditionals in turn: it is valid if all of these
    are.  ``parser.others`` has the tokens and parsers of the later branches.
    """

    def run(tokens: Tokens) -> tuple[Tokens, Parser]:
        parser = (RustParser if rust else CppParser)(tokens, _MEMO[rust])
        parser.run()
        return tokens, parser

    tokens, parser = run(Tokens(text, rust))
    parser.others = []
    if not rust and unbalanced_conditionals(tokens.parts):
        parser.errors.append((len(tokens.kinds), "preprocessor conditionals don't pair"))
    elif not rust and parser.errors:
        noted = _annotations(tokens)
        plain = run(_without(tokens, noted)) if noted else (tokens, parser)
        if not plain[1].errors:
            plain[1].others = []
            return plain
        ways = _branches(tokens)
        tried = []
        for gone in ways:
            tried.append(run(_without(tokens, gone | noted)))
            if tried[-1][1].errors:
                break
        else:
            if tried:
                tried[0][1].others = tried[1:]
                return tried[0]
    return tokens, parser


def errors_with_rows(tokens: Tokens, parser: Parser) -> list[dict]:
    """The errors in the order of the text, with 0-based rows."""
    if not parser.errors:
        return []
    rows, places = tokens.rows(), tokens.places()
    where = lambda at: rows[places[at]] if at < len(places) else rows[-1]
    return [{"line_no": where(at), "cause": why} for at, why in sorted(parser.errors)]


def check_files(files: DataFrame, key: str = "file_id", path: str = "file_path", text: str = "file_text", group: str = "repo") -> DataFrame:
    """One row a file: ``key, group, language, valid, n_errors, first_line, first_cause, errors``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, body in zip(b["p"], b["t"]):
                rust = is_rust(name)
                out.append((("rust" if rust else "cpp"), errors_with_rows(*parse(body or "", rust))))
            first = [e[0] if e else {"line_no": None, "cause": None} for _, e in out]
            yield pd.DataFrame(
                {
                    key: b["k"], group: b["g"], "language": [x for x, _ in out], "valid": [not e for _, e in out], "n_errors": [len(e) for _, e in out],
                    "first_line": pd.array([x["line_no"] for x in first], dtype="Int64"), "first_cause": [x["cause"] for x in first], "errors": [e for _, e in out],
                }
            )

    kinds = dict(files.dtypes)
    schema = f"`{key}` {kinds[key]}, `{group}` {kinds[group]}, language string, valid boolean, n_errors int, first_line bigint, first_cause string, errors array<struct<line_no:bigint,cause:string>>"
    return files.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(path).alias("p"), F.col(text).alias("t")).where(F.col("k").isNotNull()).mapInPandas(run, schema)


def rates(checked: DataFrame, key: str = "file_id", group: str = "repo") -> DataFrame:
    """Files, invalid files and the share that parses, by group and language."""
    once = checked.select(key, group, "language", "valid").dropDuplicates([key])
    return once.groupBy(group, "language").agg(
        F.count("*").alias("files"), F.sum(F.when(F.col("valid"), 0).otherwise(1)).alias("invalid_files"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("acceptance")
    )
