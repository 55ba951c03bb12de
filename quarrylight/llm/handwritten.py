"""Generated, minified or vendored source files.

Five kinds of evidence, strongest first:

1. declarations: repository attribute files (``attribute_rules``: the deepest
   directory and in it the last line whose glob fits decide, for each mark by
   itself) and registered sources (the first that holds the file wins, ``dep``
   marks foreign code);
2. notices in the comments before the first token, behind leading directives
   and attributes, or after the last token: generated by a tool, or copyright,
   origin or distribution of another project;
3. patterns: names and pairs of directories, file names and globs of their ends
   that carry such declarations elsewhere (``mined_names``), applied to files
   that nothing is declared about; conventional directory names serve where the
   declarations do not speak against them;
4. copies: files without a notice of their own that are near-duplicates (five
   words, similarity 0.8) of a file that 1 or 2 found to be foreign;
5. the text itself: minified, data, or lines whose shapes recur at one lag.

A mark that is unset (``-linguist-vendored``) rules out evidence of its own kind
only: copies, locations and notices of other projects for vendored, the rest for
generated.  One that is unspecified (``!linguist-vendored``) takes back less
precise lines.

Texts are read in one pass for the evidence (``text_evidence``) and two for the
n-grams of 4, of which only possible copies go on; else only narrow rows are joined, by repository and directory or by
name.

Cases: rows with a null key are left out; null or empty texts are hand-written unless their location says
otherwise; a null repo or path matches no declaration; repeated rows give
repeated rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import Tokens
from ..functions.paths import normal_path
from ..operators.ownership import with_owner
from ..plans.lineage import cut
from .docpairs import clean
from .leakage import bit_filter
from .neardup import NearDuplicates, ngrams
from .parsing import is_rust

# Directory names by convention for code from elsewhere or made by tools.
FOREIGN_NAMES = (
    "third_party third-party thirdparty 3rdparty 3rd_party 3rd-party vendor vendors vendored _vendor _vendored external externals extern "
    "deps _deps subprojects _imported imported node_modules bower_components godeps contrib bundled _bundled"
).split()
GENERATED_NAMES = "generated __generated__ autogen auto_generated codegen_out _generated".split()
# Notices of generators and of other projects.
_GENERATED = re.compile(
    r"(?i)(?<![\w.-])@generated\b|<auto-?generated\b|\b(?:code|file|source|header|module|bindings?)\s+(?:(?:is|was|has been)\s+)?(?:(?:automatically|auto|machine|mechanically)[\s-]*)?(?:generated|produced|created)\s+(?:by|from|with|using)\b"
    r"|\bauto-?generated\s+(?:by|from|with|file|code)\b|\b(?:automatically|mechanically)\s+(?:generated|produced)\s+(?:by|from|with)\b|\bmachine[\s-](?:generated|output|made)\b|\bdo not (?:edit|modify|change|touch)(?:\s+(?:this file|by hand|manually|directly|it))*\s*(?:[.!*;]|$)"
    r"|\bregenerate\s+(?:rather than|instead of)\s+edit|\b(?:changes?|edits?|modifications?)\s+(?:made\s+)?(?:here|to this file|in this file)\s+(?:will|may)\s+be\s+(?:lost|overwritten)\b|^\W*generated\s+(?:by|from|with)\b|\bedit\s+\S+\s+instead\b"
)
_FOREIGN = re.compile(
    r"(?i)\bvendored\s+(?:from|copy)\b|\bimported\s+(?:\w+\s+)?from\b|\bcopied\s+(?:\w+\s+)?from\s+(?:the\s+)?\S+\s+(?:project|library|repository)|\bupstream\s+(?:tarball|version|release|commit|revision|url|repository|project)\s*:|\bsingle[\s-](?:file|header)\s+(?:distribution|release|library)\b"
    r"|\bredistribution and use in source\b|\bSPDX-(?:FileCopyrightText|License-Identifier)\b|\bcopyright\b|\(c\)\s|\blicensed under\b|\bthis file is part of\b|\bsee (?:copying|license|licence)\b|\blocal patches\b"
)
_SHAPE = re.compile(r'"(?:[^"\\]|\\.)*"|\'[^\'\n]{1,4}\'|[A-Za-z_]\w*|\d[\w.]*')
_LIST = re.compile(r"(?:[-x]+,\s?){2,}")
MINIFIED_LINE, MINIFIED_SHARE, MINIFIED_SPACE = 300, 0.5, 0.14
DATA_NUMBERS, DATA_STRINGS, DATA_TOKENS, STRING_TOKENS = 0.27, 0.75, 60, 10
MOST_LAG, RECURRENCE, LEAST_LINES = 8, 0.7, 15


_SETTING = re.compile(r"""\[+[\w."' -]+\]+\s*|[\w.-]+\s*=\s*[^=\s][^;{]*""")


def notice_comments(tokens: Tokens) -> tuple[str, str]:
    """The comments before the first token, leading directives and inner attributes aside, and those after the last token."""
    head: list[str] = []
    foot: list[str] = []
    depth, begun = 0, False
    for p, c in zip(tokens.parts, tokens.codes):
        p = p.strip()
        if c:
            foot = []
            if not begun and (depth or p in ("#", "!", "[")):  # #![...]
                depth += (p == "[") - (p == "]")
                continue
            begun = True
        elif p.startswith(("//", "/*")):
            (foot if begun else head).append(clean(p))
    return "\n".join(head), "\n".join(foot)


def is_settings(text: str) -> bool:
    """True for a text that is objects or lists of values, or sections of settings, and no program."""
    text = text.strip()
    if text[:1] == "[":
        lines = [x.strip() for x in text.split("\n") if x.strip() and not x.strip().startswith(("#", ";"))]
        if len(lines) >= 3 and all(_SETTING.fullmatch(x) for x in lines):
            return True
    if text[:1] not in ("{", "["):
        return False
    at, read = 0, json.JSONDecoder()
    try:
        while at < len(text):
            _, at = read.raw_decode(text, at)
            at += len(text[at:]) - len(text[at:].lstrip())
    except (ValueError, RecursionError):
        return False
    return True


def line_shapes(text: str) -> list[str]:
    """Each line that isn't blank with its words, numbers and strings as x."""
    shapes = (_SHAPE.sub("x", line.strip()) for line in text.split("\n"))
    return [_LIST.sub("x,", s) for s in shapes if s]


def recurrence(shapes: list[str]) -> float:
    """The greatest share of lines that have the shape of the line a fixed lag before."""
    n = len(shapes)
    return max((sum(map(str.__eq__, shapes[lag:], shapes)) / (n - lag) for lag in range(1, MOST_LAG + 1) if n > lag), default=0.0)


def evidence(path: str | None, text: str, team: list[str]) -> dict:
    """What a file's text says; ``team`` are the names its own notices may bear."""
    tokens = Tokens(text, is_rust(path))
    k, n = tokens.kinds, len(tokens.kinds)
    head, foot = notice_comments(tokens)
    own = any(re.search(rf"(?i)(?<!\w){re.escape(x)}(?!\w)", head) for x in team if x)
    lines = [x for x in text.split("\n") if x.strip()]
    size = sum(map(len, lines)) or 1
    spaces = sum(x.count(" ") + x.count("\t") for x in lines)
    minified = sum(len(x) for x in lines if len(x) > MINIFIED_LINE) / size > MINIFIED_SHARE and spaces / size < MINIFIED_SPACE
    coded = k[:1] not in ("{", "[")  # no program begins so
    strings = sum(len(p) for p, c in zip(tokens.parts, tokens.codes) if c == "s") / size
    data = is_settings(text) if not coded else (n >= DATA_TOKENS and (k.count("n") + k.count("s")) / n > DATA_NUMBERS or n >= STRING_TOKENS and k.count("s") > 3 and strings > DATA_STRINGS)
    closed = sum(x.rstrip().endswith((";", "}", "{", ",", ")")) or x.lstrip().startswith("#") for x in lines)
    repeated = len(lines) >= LEAST_LINES and coded and closed > 0.8 * len(lines) and recurrence(line_shapes(text)) >= RECURRENCE
    return {
        "generated_notice": bool(_GENERATED.search(head) or _GENERATED.search(foot)), "foreign_notice": bool(_FOREIGN.search(head)) and not own, "own_notice": own,
        "minified": minified and coded, "data": data, "repeated": repeated,
    }


_EVIDENCE = ("generated_notice", "foreign_notice", "own_notice", "minified", "data", "repeated")


def text_evidence(files: DataFrame, key: str = "file_id", repo: str = "repo", path: str = "file_path", text: str = "file_text") -> DataFrame:
    """One narrow row a file: ``key, repo, path`` and the evidence of its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [evidence(p, t or "", (r or "").split("/")) for r, p, t in zip(b["r"], b["p"], b["t"])]
            yield pd.DataFrame({key: b["k"], "repo": b["r"], "path": b["p"]} | {e: [bool(x[e]) for x in found] for e in _EVIDENCE})

    schema = f"`{key}` {dict(files.dtypes)[key]}, repo string, path string, " + ", ".join(f"{e} boolean" for e in _EVIDENCE)
    return files.select(F.col(key).alias("k"), F.col(repo).alias("r"), F.col(path).alias("p"), F.col(text).alias("t")).where(F.col("k").isNotNull()).mapInPandas(run, schema)


def glob_regex(glob: str) -> str | None:
    """A glob of an attribute file as a regular expression over the path below its directory; None if it fits no file."""
    if not glob or glob.startswith("!") or glob.endswith("/"):
        return None
    body = glob[1:] if glob.startswith("/") else glob if "/" in glob else "**/" + glob
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif body.startswith("**", i) and i + 2 == len(body) and (i == 0 or body[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := body.find("]", i + 3 if body[i + 1 : i + 2] in ("!", "^") else i + 2)) > 0:
            inside = body[i + 1 : end]
            no = inside[:1] in ("!", "^")
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", inside[no:])
            out.append(f"(?!/)[{'^' if no else ''}{inside}]")
            i = end + 1
        else:
            c = body[i + 1 : i + 2] if c == "\\" else c
            i += 1 + (body[i] == "\\")
            out.append(re.sub(r"(\W)", r"\\\1", c) if c.isascii() else c)
    return "".join(out)


_LINE = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(\S+))(.*)')
_MARK = re.compile(r"(?<!\S)([-!]?)linguist-(generated|vendored)(?:=(\S*))?(?!\S)")


def attribute_rules(files: DataFrame, repo: str = "repo", path: str = "file_path", text: str = "file_text") -> DataFrame:
    """The generated and vendored marks of the attribute files among ``files``: ``repo, dir, line, pattern, mark, value``; a null value takes the mark back."""
    p = normal_path(F.col(path))
    lines = (
        files.where((F.regexp_extract(p, r"([^/]*)$", 1) == ".gitattributes") & F.col(repo).isNotNull())
        .select(F.col(repo).alias("repo"), F.regexp_replace(p, r"/?[^/]*$", "").alias("dir"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "body"))
        .where(F.col("body").contains("linguist-") & ~F.col("body").rlike(r"^\s*#"))
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, d, n, body in zip(b["repo"], b["dir"], b["line"], b["body"]):
                quoted, plain, marks = _LINE.fullmatch(body).groups()
                pattern = glob_regex(quoted if quoted is not None else plain)
                if pattern is not None:
                    rows += [(r, d, n, pattern, mark, None if sign == "!" else sign != "-" and value.lower() != "false") for sign, mark, value in _MARK.findall(marks)]
            yield pd.DataFrame(rows, columns=["repo", "dir", "line", "pattern", "mark", "value"]).astype({"value": object})

    return lines.mapInPandas(parse, "repo string, dir string, line int, pattern string, mark string, value boolean")


def declared_by_attributes(paths: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key, generated, vendored`` for the files that attribute lines speak of.

    A path meets the rules of the directories above it only, by equality, and all
    those of a directory in one row.
    """
    parts = F.split(normal_path(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = paths.where(F.col("repo").isNotNull() & F.col("path").isNotNull()).select(key, F.col("repo").alias("__repo"), normal_path(F.col("path")).alias("__path"), F.posexplode(above).alias("depth", "__dir"))
    lines = rules.groupBy("repo", "dir", "mark").agg(F.reverse(F.array_sort(F.collect_list(F.struct("line", "pattern", "value")))).alias("lines"))
    j = asked.join(lines, (F.col("__repo") == F.col("repo")) & (F.col("__dir") == F.col("dir")))
    below = F.when(F.col("dir") == "", F.col("__path")).otherwise(F.substr("__path", F.length("dir") + 2))
    fits = j.withColumn("below", below).withColumn("fit", F.get(F.filter("lines", lambda r: F.regexp_like(F.col("below"), F.concat(F.lit("^(?:"), r["pattern"], F.lit(")$")))), F.lit(0))).where(F.col("fit").isNotNull())
    marks = fits.groupBy(key, "mark").agg(F.max_by(F.col("fit.value"), F.col("depth")).alias("value"))
    return marks.groupBy(key).agg(*[F.max(F.when(F.col("mark") == m, F.col("value"))).alias(m) for m in ("generated", "vendored")])


def counted_names(declared: DataFrame) -> DataFrame:
    """How often files of each name pattern are declared, foreign or not: ``name, files, foreign, repos`` of ``repo, path, foreign``."""
    names = declared.select("repo", "foreign", F.explode(_patterns(F.col("path"))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("files"), F.sum(F.col("foreign").cast("int")).alias("foreign"), F.approx_count_distinct("repo").alias("repos"))


def mined_names(declared: DataFrame, least_files: int = 20, least_repos: int = 5, precision: float = 0.9) -> DataFrame:
    """Name patterns whose declared files (``repo, path, foreign``) are nearly always foreign, in several repositories: ``name``."""
    return counted_names(declared).where((F.col("files") >= least_files) & (F.col("repos") >= least_repos) & (F.col("foreign") >= precision * F.col("files"))).select("name")


def conventional_names(unset: DataFrame, least_files: int = 20) -> DataFrame:
    """The conventional names, without those that attribute files (``repo, path, foreign`` of the files they speak of) mostly call the project's own."""
    known = unset.sparkSession.createDataFrame([(n,) for n in [*FOREIGN_NAMES, *GENERATED_NAMES]], "name string")
    against = counted_names(unset).where((F.col("files") >= least_files) & (F.col("foreign") < 0.5 * F.col("files"))).select("name")
    return known.join(against, "name", "left_anti")


def _patterns(path: Column) -> Column:
    """The names of a path's directories, alone and with the one above, its file name, and ``*.x.y`` and ``*_x.y`` for the end of it."""
    parts = F.split(F.lower(normal_path(path)), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda a, b: F.concat(a, F.lit("/"), b))
    file = F.element_at(parts, -1)
    ends = F.array(*[F.concat(F.lit("*"), F.nullif(F.regexp_extract(file, end, 1), F.lit(""))) for end in (r"[^.](\.[^.]+\.[^.]+)$", r"[^_](_[^_.]+\.[^.]+)$")])
    return F.array_distinct(F.concat(folders, pairs, F.array(F.concat(F.lit("/"), file)), F.array_compact(ends)))


# Words of an n-gram, the similarity of copies, and the n-grams below which a file says too little to be told as one.
WORDS, ALIKE, LEAST_GRAMS = 5, 0.8, 20


def copies_of(files: DataFrame, foreign: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of near-duplicates of the files in ``foreign`` (``key``): ``key``, themselves included.

    A file can only be one if foreign files hold that share of its n-grams; a
    filter of bits tells, so few files are compared.
    """
    context = files.sparkSession.sparkContext
    texts = files.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(key).alias("h")).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    wanted = context.broadcast(bit_filter(foreign.select(F.xxhash64(key).alias("h")).distinct()))

    def grams_of_foreign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [ngrams(t, WORDS) for t in b["t"][wanted.value.has(b["h"].to_numpy(np.int64).view(np.uint64))]]
            yield pd.DataFrame({"gram": np.unique(np.concatenate([np.zeros(0, np.int64), *found]))})

    held = context.broadcast(bit_filter(cut(texts.mapInPandas(grams_of_foreign, "gram bigint").distinct())))

    def may_be_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [ngrams(t, WORDS) for t in b["t"]]
            yield b[[len(g) >= LEAST_GRAMS and int(held.value.has(g.view(np.uint64)).sum()) >= ALIKE * len(g) - 1e-6 for g in sets]][["k", "t"]]

    near = NearDuplicates(texts.mapInPandas(may_be_copies, f"k {dict(texts.dtypes)['k']}, t string"), "k", "t", WORDS, ALIKE)
    known = near.members.join(foreign.select(F.col(key).alias("key")), "key", "left_semi").select("doc").distinct()
    links = near.links.select(F.col("doc_a").alias("doc"), F.col("doc_b").alias("other")).union(near.links.select("doc_b", "doc_a"))
    reached = known.union(links.join(known, "doc", "left_semi").select("other")).distinct()
    return near.members.join(reached, "doc", "left_semi").select(F.col("key").alias(key)).distinct()


def label_files(files: DataFrame, sources: DataFrame, key: str = "file_id", repo: str = "repo", path: str = "file_path", text: str = "file_text") -> DataFrame:
    """One row a file: ``key, repo, path``, the evidence, ``declared``, ``located``, ``copied``, ``by_hand`` and the first ``reason``."""
    seen = cut(text_evidence(files, key, repo, path, text))
    places = with_owner(seen.select(F.col(key).alias("__key"), "repo", "path"), sources, "repo", "path").dropDuplicates(["__key"])
    marks = declared_by_attributes(places.select("__key", "repo", "path"), attribute_rules(files, repo, path, text), "__key")
    places = places.join(marks, "__key", "left")
    declared = F.when(F.col("generated") | F.col("vendored"), True).when(F.col("vendored").isNotNull(), F.col("vendored")).otherwise(F.coalesce(F.col("owner_dep"), F.col("generated")))
    places = places.withColumn("foreign", declared)
    told = places.where(F.col("foreign").isNotNull()).select("repo", "path", "foreign")
    marked = places.where(F.col("vendored").isNotNull()).select("repo", "path", F.col("vendored").alias("foreign"))
    names = places.select("__key", F.explode(_patterns(F.col("path"))).alias("name"))
    by_name = names.join(mined_names(told).union(conventional_names(marked)), "name", "left_semi").select("__key").distinct().withColumn("by_name", F.lit(True))
    places = places.join(by_name, "__key", "left").select("__key", "generated", "vendored", F.when(F.col("foreign"), True).alias("declared"), F.coalesce("vendored", "owner_dep", F.lit(False)).alias("not_own"), F.coalesce("by_name", F.lit(False)).alias("located"))
    j = cut(seen.join(places, F.col(key) == F.col("__key"), "left").drop("__key"))
    may_be_made, may_be_foreign = (F.coalesce(F.col(m), F.lit(True)) for m in ("generated", "vendored"))
    foreign = F.coalesce("not_own", F.lit(False)) | F.col("foreign_notice") & may_be_foreign
    copies = copies_of(files, j.where(foreign).select(key), key, text).withColumn("__copied", F.lit(True)).withColumnRenamed(key, "__key")
    j = j.join(copies, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("copied", F.coalesce("__copied", F.lit(False)) & ~F.col("own_notice"))
    reason = (
        F.when(F.col("declared"), "declared").when(F.col("generated_notice") & may_be_made, "generated notice").when(F.col("foreign_notice") & may_be_foreign, "foreign notice")
        .when(F.col("located") & may_be_foreign, "location").when(F.col("copied") & may_be_foreign, "copy")
        .when(F.col("minified") & may_be_made, "minified").when(F.col("data") & may_be_made, "data").when(F.col("repeated") & may_be_made, "repeated shapes")
    )
    return j.withColumn("reason", reason).withColumn("by_hand", F.col("reason").isNull()).select(
        key, "repo", "path", *_EVIDENCE, "declared", "located", "copied", "by_hand", "reason"
    )
