"""Finding the items of a source text: types, impls, functions, members, directives.

The only per-file Python of chunking.  It pairs brackets over the kinds of the
tokens and yields one flat record an item; what becomes of the items - merging
by type, ranges, signatures, texts, thresholds - is done by DataFrame plans.
The scan is tolerant: it takes what it knows and skips the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from ...functions.lexing import CPP, RUST, Rows, Tokens


class Item(NamedTuple):
    ord: int
    item: str  # type, impl, method, function, directive, member
    name: str | None
    kind: str | None  # of a type: Struct, Enum, Trait
    scope: str  # inner module path or namespace
    owner: str | None  # of a method or member: its type as written in the header
    header: str | None  # of a method: its impl's header
    modifier: str | None  # visibility as written
    block: int | None  # of a method or impl: the impl's number; of a member or method: where it stands
    line_start: int
    line_end: int
    text: str
    body_at: int | None  # where the body begins in the text
    doc: str | None


_OPEN = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


class Scan:
    def __init__(self, text: str, rust: bool) -> None:
        self.t = Tokens(text, rust)
        self.k = self.t.kinds + "\0"
        self.places = [*self.t.places(), len(self.t.parts)]
        self.rows = Rows(self.t.parts)
        self.at = self.rows.at
        self.text = "".join(self.t.parts)
        self.lines = self.text.splitlines()
        self.close = self._pairs()
        self.items: list[Item] = []
        self.blocks = 0

    def _pairs(self) -> dict[int, int]:
        close, open_ = {}, []
        for i, c in enumerate(self.k):
            d = _OPEN.get(c)
            if d == 1:
                open_.append(i)
            elif d == -1 and open_:
                close[open_.pop()] = i
        end = len(self.k) - 1
        return close | {i: end for i in open_}

    def word(self, i: int) -> str:
        return self.t.parts[self.places[i]].strip() if i < len(self.places) - 1 else ""

    def row(self, i: int) -> int:
        return self.rows[self.places[min(i, len(self.places) - 1)]] if self.places[0] < len(self.t.parts) else 0

    def span(self, i: int, j: int) -> str:
        """The text from token i to token j."""
        j = min(j, len(self.places) - 2)
        return self.text[self.at[self.places[i]] : self.at[self.places[j]] + len(self.t.parts[self.places[j]].rstrip())]

    def last_row(self, j: int) -> int:
        j = min(j, len(self.places) - 2)
        return self.row(j) + self.t.parts[self.places[j]].rstrip().count("\n")

    def until(self, i: int, stops: str, end: int) -> int:
        """The first token from i on, outside brackets, that is one of the kinds."""
        while i < end and self.k[i] not in stops:
            i = self.close[i] + 1 if self.k[i] in "([{" and i in self.close else i + 1
        return i

    def angles(self, i: int) -> int:
        """Behind generic arguments that begin at i, if any do."""
        if self.k[i] != "<":
            return i
        depth = 0
        while self.k[i] != "\0":
            depth += (self.k[i] == "<") - (self.k[i] == ">")
            i += 1
            if not depth:
                break
            if self.k[i] in "{;":
                break
        return i

    def add(self, item: str, i: int, j: int, body: int | None = None, **more) -> None:
        start = self.at[self.places[i]]
        fields = dict(name=None, kind=None, scope="", owner=None, header=None, modifier=None, block=None, doc=self.doc(self.row(i))) | more
        self.items.append(Item(ord=len(self.items), item=item, line_start=self.row(i), line_end=self.last_row(j), text=self.span(i, j), body_at=None if body is None else self.at[self.places[body]] - start, **fields))

    def doc(self, row: int) -> str | None:
        """The nearest comment line above that says something."""
        while row > 0:
            row -= 1
            line = self.lines[row].strip() if row < len(self.lines) else ""
            slashes = re.match(r"//[/!]?", line)
            if not line or self.t.rust and line.startswith(("//!", "#[")):
                continue
            if not slashes or self.t.rust and not line.startswith("///"):
                return None
            said = line[3 if line.startswith("///") else 2 :].strip()
            if said:
                return said
        return None


F_, IMPL, MOD, TRAIT, PUB, FOR, WHERE = RUST["fn"], RUST["impl"], RUST["mod"], RUST["trait"], RUST["pub"], RUST["for"], RUST["where"]
_TYPES = {RUST["struct"]: "Struct", RUST["enum"]: "Enum", TRAIT: "Trait"}
_LEADING = {RUST[x] for x in "const async unsafe extern".split()} | {"s"}


def scan_rust(text: str) -> list[Item]:
    s = Scan(text, True)
    _rust_items(s, 0, len(s.k) - 1, "", None)
    return s.items


def _rust_items(s: Scan, i: int, end: int, scope: str, impl: dict | None) -> None:
    k = s.k
    while i < end:
        c = k[i]
        if c == "#":
            i = s.close.get(s.until(i, "[", end), end) + 1
            continue
        start, modifier = i, None
        if c == PUB:
            i += 1
            if k[i] == "(":
                i = s.close[i] + 1
            modifier = s.span(start, i - 1)
        while k[i] in _LEADING:
            i += 1
        c, name = k[i], s.word(i + 1) if k[i + 1] == "i" else "_"
        facts = {"scope": scope, "modifier": modifier, "name": name}
        if c == F_:
            body = s.until(i, "{;", end)
            if k[body] == "{":
                j = s.close[body]
                if impl is None:
                    s.add("function", start, j, body, **facts)
                else:
                    s.add("method", start, j, body, **(facts | impl))
                i = j + 1
            else:
                i = body + 1
        elif c in _TYPES and impl is None:
            j = s.until(i, "{;", end)
            j = s.close[j] if k[j] == "{" else j
            s.add("type", start, j, None, kind=_TYPES[c], **facts)
            i = j + 1
        elif c == IMPL and impl is None:
            body = s.until(i, "{;", end)
            if k[body] == "{":
                header, at = s.span(start, body - 1), s.angles(i + 1)
                target = [at]
                depth = 0
                for x in range(at, body):
                    depth += (k[x] == "<") - (k[x] == ">")
                    if not depth and k[x] == FOR:
                        target.append(x + 1)
                stop = next((x for x in range(target[-1], body) if k[x] == WHERE), body)
                owner = s.span(target[-1], stop - 1) if stop > target[-1] else "_"
                s.blocks += 1
                mine = {"owner": owner, "header": header, "block": s.blocks}
                s.add("impl", start, s.close[body], body, scope=scope, name=owner, **mine)
                _rust_items(s, body + 1, s.close[body], scope, mine)
                i = s.close[body] + 1
            else:
                i = body + 1
        elif c == MOD and k[i + 2] == "{" and impl is None:
            _rust_items(s, i + 3, s.close[i + 2], f"{scope}::{name}" if scope else name, None)
            i = s.close[i + 2] + 1
        else:
            j = s.until(i, "{;", end)
            i = s.close[j] + 1 if k[j] == "{" else j + 1


_RECORDS = {CPP[x] for x in "class struct union".split()}
_ACCESS = {CPP[x] for x in "public private protected".split()}
NAMESPACE, TEMPLATE, ENUM, EXTERN, OPERATOR, SCOPE = (CPP[x] for x in ("namespace", "template", "enum", "extern", "operator", "::"))
_BRANCH = re.compile(r"#\s*(ifdef|ifndef|if|endif)\b")


def scan_cpp(text: str) -> list[Item]:
    """Directives count outside namespaces; what stands between a conditional and its end belongs to the directive."""
    s = Scan(text, False)
    hidden, depth = [], 0
    for p, (part, code) in enumerate(zip(s.t.parts, s.t.codes)):
        if code or "#" not in part or not part.lstrip().startswith("#"):
            continue
        m = _BRANCH.match(part.lstrip())
        if m and m.group(1) == "endif":
            depth = max(0, depth - 1)
            if not depth and hidden:
                hidden[-1][1] = p
            continue
        if not depth:
            at = next((i for i, x in enumerate(s.places) if x >= p), len(s.places) - 1)
            line = part.strip().split("\n")[0].strip()
            row = s.rows[p] + part[: len(part) - len(part.lstrip())].count("\n")
            s.items.append(Item(len(s.items), "directive", None, None, "", None, None, None, at, row, row, line, None, None))
        if m:
            if not depth:
                hidden.append([p, len(s.t.parts)])
            depth += 1
    _cpp_items(s, 0, len(s.k) - 1, "", None, hidden)
    return s.items


def _declarator(s: Scan, start: int, body: int) -> tuple[str, int] | None:
    """The qualified name before a function's parameter list, and where it begins."""
    k, i = s.k, start
    while i < body:
        if k[i] == "<":
            i = s.angles(i)
        elif k[i] == "(":
            break
        elif k[i] == OPERATOR:
            i = next((x for x in range(i + 1, body) if k[x] == "(" and (x > i + 1 or k[x + 1] == ")")), body)
            if k[i + 1] == ")" and k[i + 2] == "(":
                i += 2
            break
        else:
            i += 1
    if i >= body or i == start:
        return None
    first = i - 1
    if k[first] not in ("i", ">") and OPERATOR not in k[start:i]:
        return None
    if OPERATOR in k[start:i]:
        first = max(x for x in range(start, i) if k[x] == OPERATOR)
    while first > start:
        p = k[first - 1]
        if p in (SCOPE, "~") or k[first] in (SCOPE, "~") and p in ("i", ">"):
            first -= 1
        elif k[first] == ">":
            depth = 0
            while first > start:
                depth += (k[first] == ">") - (k[first] == "<")
                if not depth:
                    break
                first -= 1
            first -= 1
        else:
            break
    return "".join(s.word(x) for x in range(first, i)), first


def _cpp_items(s: Scan, i: int, end: int, scope: str, owner: str | None, hidden: list[list[int]]) -> None:
    k = s.k
    while i < end:
        place = s.places[i]
        skip = next((b for a, b in hidden if a < place < b), None) if owner is None else None
        if skip is not None:
            i = next((x for x in range(i, end + 1) if s.places[x] > skip), end)
            continue
        c, start = k[i], i
        if c == NAMESPACE or k[i : i + 2] == CPP["inline"] + NAMESPACE:
            body = s.until(i, "{;", end)
            if k[body] == "{":
                name = "".join(s.word(x) for x in range(i, body) if k[x] in ("i", SCOPE))
                _cpp_items(s, body + 1, s.close[body], f"{scope}::{name}" if scope and name else name or scope, None, hidden)
                i = s.close[body] + 1
            else:
                i = body + 1
            continue
        if c in _ACCESS and owner is not None:
            s.add("member", i, i, None, scope=scope, owner=owner, kind="access", name=s.word(i))
            i = s.until(i, ":", end) + 1
            continue
        outer = i
        while k[i] == TEMPLATE:
            i = s.angles(i + 1)
        if k[i] == EXTERN and k[i + 1] == "s" and k[i + 2] == "{":
            i = s.close[i + 2] + 1  # not descended into
            continue
        stop = s.until(i, "{;=", end)
        inner = i
        template = s.span(outer, inner - 1).split("\n")[0].strip() if outer != inner else None
        head = [x for x in range(i, stop) if k[x] in _RECORDS]
        if k[stop] == "{" and head and "(" not in k[i:stop]:
            at = head[0] + 1
            while at < stop and k[at] != "i":
                at = s.close[at] + 1 if k[at] in "([" else at + 1
            tail = s.angles(at + 1)
            name = s.span(at, tail - 1) if k[at] == "i" else "_"
            j = s.close[stop]
            full = f"{scope}::{name}" if scope else name
            if owner is None:
                s.add("type", inner, j, stop, scope=scope, name=full, kind="Struct")
                _cpp_items(s, stop + 1, j, scope, full, hidden)
            else:
                s.add("member", inner, s.until(j, ";", end), None, scope=scope, owner=owner, kind="field", name=None)
            i = s.until(j, ";", end) + 1
            continue
        if k[stop] == "{" and k[i] != ENUM and "(" in k[i:stop]:
            found = _declarator(s, i, stop)
            j = s.close[stop]
            if found and owner is not None:
                s.add("method", inner, j, stop, scope=scope, owner=owner, name=found[0], header=template, kind="inline")
            elif found:
                s.add("function", inner, j, stop, scope=scope, name=found[0])
            i = j + 1
            continue
        j = s.until(stop, ";", end)
        if owner is not None and k[start] not in ";}":
            s.add("member", inner, j, None, scope=scope, owner=owner, kind="field", name=None, header=template)
        i = j + 1


def scan(text: str, language: str) -> Iterator[Item]:
    yield from (scan_rust if language == "rust" else scan_cpp)(text)
