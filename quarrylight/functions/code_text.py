"""Scalar functions over code text as Column expressions.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Visibility names in the order of an overview, and their prefixes in embedding texts.
VISIBILITY_RANKS = {"Pub": 0, "PubCrate": 1, "PubSuper": 2, "Private": 3}
VISIBILITY_PREFIXES = {"Pub": "pub ", "PubCrate": "pub(crate) ", "PubSuper": "pub(super) ", "Private": ""}


def _choice(column: Column, values: dict) -> Column:
    out = F
    for name, value in values.items():
        out = out.when(column == name, F.lit(value))
    return out


def visibility(modifier: Column) -> Column:
    """``pub`` is Pub; ``pub(...)`` naming crate or super is PubCrate or PubSuper; anything else, also null, is Private."""
    m = F.trim(modifier)
    return F.when(m == "pub", "Pub").when(m.startswith("pub") & m.contains("crate"), "PubCrate").when(m.startswith("pub") & m.contains("super"), "PubSuper").otherwise("Private")


def visibility_prefix(v: Column) -> Column:
    """P5; an unknown or null visibility has no prefix."""
    return F.coalesce(_choice(v, VISIBILITY_PREFIXES), F.lit(""))


def visibility_rank(v: Column) -> Column:
    """P25; unknown and null come after Private."""
    return F.coalesce(_choice(v, VISIBILITY_RANKS), F.lit(len(VISIBILITY_RANKS)))


def signature(text: Column) -> Column:
    """Up to the first brace, else the first line; trimmed."""
    cut = F.when(text.contains("{"), F.substring_index(text, "{", 1)).otherwise(F.substring_index(text, "\n", 1))
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def first_line(text: Column) -> Column:
    """P28."""
    return F.trim(F.substring_index(text, "\n", 1))


def base_type(text: Column) -> Column:
    """The type without its generic arguments."""
    return F.trim(F.substring_index(text, "<", 1))


def owner_of(declarator: Column) -> Column:
    """What stands left of the last ``::``, leading ones dropped; null without one."""
    owner = F.regexp_extract(declarator, r"^(?:::)*(.*)::[^:]*$", 1)
    return F.when(owner != "", owner)


def name_of(declarator: Column) -> Column:
    """What stands right of the last ``::``."""
    return F.element_at(F.split(declarator, "::"), -1)


def qualified(namespace: Column, name: Column) -> Column:
    """P17; an empty or null namespace adds nothing."""
    return F.concat_ws("::", F.when(namespace != "", namespace), name)


def line_count(start: Column, end: Column) -> Column:
    """M6: rows of an inclusive range."""
    return end - start + 1


def status_changes(line: Column) -> Column:
    """One ``--name-status`` line as an array of (path, change); unknown and malformed lines give none, renames two."""
    f = F.split(line, "\t", 3)
    kind, first, second = F.substring(F.get(f, F.lit(0)), 1, 1), F.get(f, F.lit(1)), F.get(f, F.lit(2))
    one = lambda path, change: F.struct(path.alias("path"), F.lit(change).alias("change"))
    none = F.expr("cast(array() as array<struct<path:string,change:string>>)")
    return (
        F.when(first.isNull() | (first == ""), none)
        .when(kind == "A", F.array(one(first, "added"))).when(kind == "M", F.array(one(first, "modified"))).when(kind == "D", F.array(one(first, "deleted")))
        .when((kind == "R") & second.isNotNull(), F.array(one(first, "deleted"), one(second, "added"))).when((kind == "C") & second.isNotNull(), F.array(one(second, "added")))
        .otherwise(none)
    )


def porcelain_path(line: Column) -> Column:
    """The path of a ``status --porcelain`` line, of a rename the new one; null for lines under four characters."""
    rest = F.substr(line, F.lit(4))
    return F.when(F.length(line) >= 4, F.when(rest.contains(" -> "), F.substring_index(rest, " -> ", -1)).otherwise(rest))
