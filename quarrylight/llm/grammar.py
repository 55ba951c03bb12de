"""What the Rust and the C++ parser share.

Statements are parsed by recursive descent, expressions by precedence climbing,
both over the kinds of the tokens.  Files repeat the shapes of their statements
endlessly, so the parse of a statement without a body, or of the head before a
body, is remembered by its kinds: ``memo`` maps them to what was found.  After
an error the parser goes on behind the next ``;`` or the block it stands before
(panic mode) and keeps every error.  What it reads becomes a syntax tree.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

from ..functions.lexing import Tokens

END = "\0"
_STOP = re.compile(r"[;{}\0]")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
MEMO_KEYS, MEMO_LENGTH = 100_000, 300
CALLS = 40  # Python calls a level of nesting may take


def longest_run(kinds: str) -> int:
    """How many tokens in a row can each open a level without a bracket: prefixes, names and operators of one statement."""
    return max(map(len, re.split(r"[;{}]", kinds)), default=0)


class Wrong(Exception):
    """A syntax error at a token."""

    def __init__(self, at: int, why: str) -> None:
        super().__init__(at, why)
        self.at, self.why = at, why


class Node:
    """A node of the syntax tree, by token: what it is, where it begins, its name (of a function), where its body opens, where it ends, and the nodes within."""

    __slots__ = ("kind", "start", "name", "body", "end", "children")

    def __init__(self, kind: str, start: int, name: int = -1, body: int = -1, end: int = -1) -> None:
        self.kind, self.start, self.name, self.body, self.end = kind, start, name, body, end
        self.children: list[Node] = []

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and all(getattr(self, x) == getattr(other, x) for x in self.__slots__)

    def visit(self, kind: str) -> Iterator[Node]:
        """The nodes of a kind in the order of the text, however deep."""
        open_ = [self]
        while open_:
            node = open_.pop()
            if node.kind == kind:
                yield node
            open_ += [c for c in reversed(node.children) if c.children or c.kind == kind]


# What a statement turned out to be: whole, a function's head, the head of a plain body, or a named production.
WHOLE, FUNCTION, BODY, TAIL = "whole", "function", "body", "tail"


class Parser:
    """Base of both parsers; subclasses give ``statement(context, at) -> (what, extra, end)``."""

    top = "top"

    def __init__(self, tokens: Tokens, memo: dict) -> None:
        self.k = tokens.kinds + END * 4
        self.n = len(tokens.kinds)
        self.memo = memo
        self.errors: list[tuple[int, str]] = []
        self.tree = self.node = Node("file", 0, end=self.n)

    @property
    def functions(self) -> list[Node]:
        """The function nodes of the tree."""
        return list(self.tree.visit(FUNCTION))

    def run(self) -> None:
        before = sys.getrecursionlimit()
        deepest = level = 0
        for c in self.k:
            level += (c in "([{<") - (c in ")]}>")
            deepest = max(deepest, level)
        sys.setrecursionlimit(max(before, 2_000) + CALLS * (deepest + longest_run(self.k)))  # calls between Python functions take memory, no stack
        try:
            at = self.unit(self.top, 0)
            while at < self.n:
                self.errors.append((at, "closing bracket without an opening one"))
                at = self.unit(self.top, at + 1)
        except RecursionError:  # of the interpreter's own, far beyond what compilers take
            self.errors.append((0, "brackets nested too deeply"))
        finally:
            sys.setrecursionlimit(before)

    def unit(self, context: str, at: int) -> int:
        """Statements up to a closing brace, whose place is returned, or the end."""
        k, memo, here = self.k, self.memo, self.node
        while True:
            c = k[at]
            if c == "}":
                return at
            if c == END:
                if context != self.top:
                    self.errors.append((at, "the text ends within a block"))
                return at
            stop = _STOP.search(k, at).end()
            key = (context, k[at:stop])
            found = memo.get(key)
            try:
                if found is None:
                    what, extra, end = self.statement(context, at)
                    if end == stop and what != TAIL or what == TAIL and end == stop - 1 and k[end] == "}":
                        if stop - at <= MEMO_LENGTH:
                            if len(memo) > MEMO_KEYS:
                                memo.clear()
                            memo[key] = (what, extra)
                else:
                    what, extra = found
                    end = stop
                    if what is TAIL:
                        end -= 1
                node = Node(what, at, at + extra if what is FUNCTION else -1, -1 if what is WHOLE or what is TAIL else end - 1, end)
                here.children.append(node)
                if what is WHOLE or what is TAIL:
                    at = end
                    continue
                self.node = node
                if what is FUNCTION:
                    at = self.after_body(self.block("block", end))
                elif what is BODY:
                    at = self.block(extra, end)
                else:
                    at = self.produce(what, extra, end)
                node.end, self.node = at, here
            except Wrong as e:
                self.node = here
                self.errors.append((e.at, e.why))
                at = self.recover(max(at, e.at))

    def after_body(self, at: int) -> int:
        """Behind what may follow a function's body."""
        return at

    def block(self, context: str, at: int) -> int:
        """The rest of a block whose brace is read."""
        end = self.unit(context, at)
        return end + 1 if self.k[end] == "}" else end

    def recover(self, at: int) -> int:
        """Behind the next ``;`` or block, or before the brace that closes this one."""
        k = self.k
        while True:
            c = k[at]
            if c == ";":
                return at + 1
            if c == "}" or c == END:
                return at
            if c == "{":
                return self.balanced(at, soft=True)
            at += 1

    def balanced(self, at: int, soft: bool = False) -> int:
        """Behind the bracket that closes the one at ``at``."""
        k, open_ = self.k, []
        while True:
            c = k[at]
            if c in "([{":
                open_.append(_CLOSE[c])
            elif c in ")]}":
                if open_[-1] != c:
                    if not soft:
                        raise Wrong(at, "brackets don't pair")
                    while len(open_) > 1 and open_[-1] != c:
                        open_.pop()
                    if open_[-1] != c:
                        at += 1
                        continue
                open_.pop()
                if not open_:
                    return at + 1
            elif c == END:
                if soft:
                    return at
                raise Wrong(at, "the text ends within brackets")
            elif c == "E" and not soft:
                raise Wrong(at, "no token of the language")
            at += 1

    def need(self, at: int, kind: str, what: str) -> int:
        if self.k[at] != kind:
            raise Wrong(at, f"{what} is missing")
        return at + 1

    def statement(self, context: str, at: int) -> tuple[str, object, int]:
        raise NotImplementedError

    def produce(self, what: str, extra: object, at: int) -> int:
        raise NotImplementedError
