"""Functions paired with their documentation.

The parsers of ``parsing`` give every function with a body; what is attached
above it is read from the same tokens.  In Rust documentation is an outer doc
comment or a ``doc`` attribute, in C++ any comment that ends on the row above
the function or its template head.  One pass of ``mapInPandas``, no shuffle.

Cases: rows with a null key, null and empty texts and files that do not parse give no row; a file
delivered twice gives its rows twice (``distinct`` them on the key).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import RUST, Tokens
from .grammar import Parser
from .parsing import is_rust, parse

LEAST_WORDS = 4
# Words that mark a description still to be written, and words that add nothing to a name.
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:(?:todo|fixme|xxx|tbd|tba|hack|wip)\b|(?:(?:add|write|insert|put|fill in|needs?|missing|no)\b[\w\s]{0,24}?\b(?:doc|docs|documentation|description|comment|summary|docstring)\b"
    r"|(?:description|documentation|doc|docs|comment|summary)\b[\w\s,]{0,20}?\b(?:goes here|here|to do|todo|tbd|missing|pending|to be (?:written|added|done|filled in)|to come|later|needed)\b)"
    # nothing else in the sentence: what, when and by whom it is to be written
    r"(?:[\s(\[,:-]+(?:(?:for|of|on|to|about)\s+(?:this|the)\s+(?:function|method|fn|api|item|class|struct|type|helper|code)|here|yet|later|now|soon|please|available|provided|given|needed|required|missing|pending|todo|tbd|fixme|goes here|to come))*"
    r"[\s)\]]*(?:[.!?;…]|\n\s*\n|\Z)"
    r"|(?:to be (?:documented|written|described|done)\b|undocumented\b|not (?:yet )?documented\b|lorem ipsum\b|placeholder\b))"
)
_FILLER = frozenset("a an the this that these those of for to from in on at by with and or is are be it its returns return gets get sets set does do function functions method methods fn given value values result results param parameter parameters brief".split())
_TAG = re.compile(r"[@\\](?:param(?:\[[^\]]*\])?|tparam)\s+\w+|[@\\](?:brief|returns?|details|short|note|fn|file|summary)\b")
_PARAMETER = re.compile(r"[@\\]t?param\b")
_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")
_STRING = re.compile(r'(?s)#\s*!?\[\s*doc\s*=\s*(r#*)?"(.*)"#*\s*\]')


def clean(comment: str) -> str:
    """A comment's text without its marks."""
    comment = comment.strip()
    if comment.startswith("/*"):
        body = comment[2:-2] if comment.endswith("*/") and len(comment) >= 4 else comment[2:]
        body = body.lstrip("*!") if body[:1] in "*!" else body
        return "\n".join(re.sub(r"^\s*\*+(?!\w)", "", x).strip() for x in body.split("\n")).strip()
    return re.sub(r"^//[/!]*<?", "", comment).strip()


def parts_of(name: str) -> list[str]:
    return [x.lower() for x in _PART.findall(name)]


def trivial(doc: str, names: list[str]) -> bool:
    """Empty, only punctuation, a placeholder, fewer than four words, or nothing but the names given."""
    words = doc.split()
    said = [w for w in words if _WORD.search(w)]
    if len(said) < LEAST_WORDS or _PLACEHOLDER.search(_TAG.sub("\n\n", doc)):
        return True
    text = "\n".join(x for x in doc.split("\n"))
    known = {p for n in names for p in parts_of(n)} | {n.lower() for n in names}
    stems = {p.rstrip("s") for p in known}
    told = [p for w in _WORD.findall(_TAG.sub(" ", text).replace("_", " ")) for p in parts_of(w)]
    rest = [p for p in told if p not in _FILLER and p.rstrip("s") not in stems and not p.isdigit()]
    return not rest


def _rust_docs(parts: list[str], at: int, codes: list[str], first: int) -> list[str]:
    """The outer documentation above part ``at`` (comments) - attributes are found by the caller."""
    docs: list[str] = []
    k = at - 1
    while k >= first and not codes[k]:
        p = parts[k].strip()
        if p.startswith("///") and not p.startswith("////") or p.startswith("/**") and not p.startswith("/***") and p != "/**/":
            docs.append(clean(p))
        k -= 1
    return docs[::-1]


def functions_of(tokens: Tokens, parser: Parser) -> Iterator[dict]:
    """Every function with a body and a description: its name, rows, signature and the description."""
    functions = parser.functions
    if not functions:
        return
    parts, codes, k = tokens.parts, tokens.codes, tokens.kinds
    rows, places = tokens.rows(), tokens.places()
    for start, name, body in sorted({(f.start, f.name, f.body) for f in functions}):  # the function nodes of the tree
        begin, here = places[start], places[name]
        docs: list[str] = []
        if tokens.rust:
            lead = places[start - 1] + 1 if start else 0
            docs += _rust_docs(parts, begin, codes, lead)
            at = start
            while k[at] == "#":
                depth, end = 0, at + 1
                while True:
                    depth += (k[end] in "([{") - (k[end] in ")]}")
                    end += 1
                    if not depth:
                        break
                text = "".join(parts[places[at] : places[end - 1] + 1])
                m = _STRING.match(text)
                if m:
                    docs.append(m.group(2) if m.group(1) else re.sub(r'\\(["\\])', r"\1", m.group(2)))
                docs += _rust_docs(parts, places[end], codes, places[end - 1] + 1)
                at = end
            own = at
        else:
            own, row, at = start, rows[begin], begin - 1
            while at >= 0 and not codes[at]:
                p = parts[at]
                mark = p.lstrip()
                if not mark.startswith(("//", "/*")):
                    break
                lead_rows = p[: len(p) - len(mark)].count("\n")
                if rows[at] + lead_rows + mark.rstrip().count("\n") != row - 1:
                    break
                before = parts[at - 1] if at else "\n"
                if at and "\n" not in before[len(before.rstrip()) :] and not lead_rows and not (before.lstrip().startswith("#") and not codes[at - 1]):
                    break  # it follows other text on its row
                docs.insert(0, clean(mark))
                row = rows[at] + lead_rows
                at -= 1
        if not docs:
            continue
        opened = places[body]
        word = parts[here].strip()
        if k[name] == "~" or not tokens.rust and codes[here] != "i" and name + 1 < body:
            word += parts[places[name + 1]].strip()
        # names that a description may repeat: the function's, its owner's and its parameters'
        near = [parts[places[j]].strip() for j in range(name, body) if k[j] in "i" and (j == name or k[j + 1] in ":,)=[" )]
        owner = [parts[places[j]].strip() for j in range(max(own, name - 4), name) if k[j] == "i" and k[j + 1] not in "(" and not tokens.rust and parts[places[j + 1]].strip() == "::"]
        yield {
            "line_no": rows[here], "name": word, "line_start": rows[places[own]], "signature": " ".join("".join(parts[places[own] : opened]).split()),
            "doc": "\n".join(docs).strip(), "names": near + owner, "body": body, "begin": places[own],
        }


def _end(tokens: Tokens, body: int) -> int:
    """The token that closes the brace at ``body``."""
    depth, k = 0, tokens.kinds
    for at in range(body, len(k)):
        depth += (k[at] == "{") - (k[at] == "}")
        if not depth:
            return at
    return len(k) - 1


def pair_functions(files: DataFrame, key: str = "file_id", path: str = "file_path", text: str = "file_text", code: bool = True) -> DataFrame:
    """One row a function whose description is not trivial: ``key, line_no, language, name, signature, description[, line_start, line_end, code]``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, name, body in zip(b["k"], b["p"], b["t"]):
                tokens, parser = parse(body or "", is_rust(name))
                if parser.errors:
                    continue
                language, seen = "rust" if tokens.rust else "cpp", set()
                for tokens, f in ((t, f) for t, p in [(tokens, parser), *parser.others] for f in functions_of(t, p)):
                    if not trivial(f["doc"], f["names"]) and f["begin"] not in seen:
                        seen.add(f["begin"])
                        row = [k, f["line_no"], language, f["name"], f["signature"], f["doc"]]
                        if code:
                            last = tokens.places()[_end(tokens, f["body"])]
                            whole = "".join(tokens.parts[f["begin"] : last]) + tokens.parts[last].rstrip()
                            row += [f["line_start"], f["line_start"] + whole.count("\n"), whole]
                        out.append(row)
            yield pd.DataFrame(out, columns=names)

    names = [key, "line_no", "language", "name", "signature", "description", *(["line_start", "line_end", "code"] if code else [])]
    schema = f"`{key}` {dict(files.dtypes)[key]}, line_no bigint, language string, name string, signature string, description string" + (", line_start bigint, line_end bigint, code string" if code else "")
    return files.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("t")).where(F.col("k").isNotNull()).mapInPandas(run, schema)
