"""Path columns: normal form, extension, root prefix, keys and module paths.

All are Column expressions; a null path gives null, or false for predicates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions a language has when a source names none.
DEFAULT_EXTENSIONS = {"rust": ["rs"], "cpp": ["cpp", "cc", "cxx", "c", "h", "hpp", "hxx", "hh"]}


def normal_path(path: Column) -> Column:
    """Forward slashes, no doubled ones, no ``.`` parts, no slash at the end."""
    p = F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"(^|/)(\./)+", "$1")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)\.$", "$1"), r"(.)/$", "$1")


def normal_root(root: Column) -> Column:
    """as a path, with ``.`` as the empty root."""
    return F.when(normal_path(root) == "/", F.lit("/")).otherwise(normal_path(root))


def extension(path: Column) -> Column:
    """the final extension in lower case; null without one (a leading dot makes none)."""
    found = F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1)
    return F.when(found != "", F.lower(found))


def under_root(path: Column, root: Column) -> Column:
    """prefix by path components; the empty root holds every path."""
    return F.coalesce((root == "") | (path == root) | path.startswith(F.concat(root, F.lit("/"))), F.lit(False))


def default_extensions(language: Column) -> Column:
    """F2."""
    rust, cpp = (F.array(*map(F.lit, DEFAULT_EXTENSIONS[x])) for x in ("rust", "cpp"))
    return F.when(language == "rust", rust).when(language == "cpp", cpp)


def effective_extensions(language: Column, extensions: Column) -> Column:
    """the source's own extensions in lower case, else the language's."""
    return F.coalesce(F.transform(extensions, F.lower), default_extensions(language))


def path_language(path: Column) -> Column:
    """The language that has the path's extension by default; null if none has."""
    e = extension(path)
    return F.when(e.isin(DEFAULT_EXTENSIONS["rust"]), "rust").when(e.isin(DEFAULT_EXTENSIONS["cpp"]), "cpp")


def module_path(path: Column) -> Column:
    """The module of a Rust file by its path."""
    inner = F.regexp_replace(path, r"^src/", "")
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\.rs$", ""), r"/mod$", ""), "/", "::")
    return F.when(inner.isin("lib.rs", "main.rs"), F.lit("crate")).otherwise(F.concat(F.lit("crate::"), named))


def module_name(path: Column) -> Column:
    """A C++ file's stem, or ``_``."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.when(stem == "", "_").otherwise(stem)


def extract_module(embedding_text: Column) -> Column:
    """What the first line names as its module: between ``// `` and the last `` (``, or all the rest."""
    line = F.substring_index(embedding_text, "\n", 1)
    rest = F.substring(line, 4, 1 << 30)
    cut = F.regexp_extract(line, r"^// (.*) \(", 1)
    return F.when(~line.startswith("// "), "").when(rest.contains(" ("), cut).otherwise(rest)


def file_key(root: Column, path: Column, project: Column) -> Column:
    """A file of a git root as a key: relative to the project inside it, else absolute."""
    absolute = F.when(root == "", path).otherwise(F.concat_ws("/", root, path))
    prefix = F.concat(project, F.lit("/"))
    return F.when(absolute.startswith(prefix), F.substr(absolute, F.length(prefix) + 1)).otherwise(absolute)
