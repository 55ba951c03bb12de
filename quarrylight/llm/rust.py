"""Parser for Rust: items and statements by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

import re

from ..functions.lexing import RUST
from .grammar import BODY, END, FUNCTION, TAIL, WHOLE, Parser, Wrong

R = RUST
AS, ASYNC, AWAIT, BREAK, CONST, CONTINUE, DYN, ELSE, ENUM, EXTERN, FN, FOR = (R[x] for x in "as async await break const continue dyn else enum extern fn for".split())
IF, IMPL, IN, LET, LOOP, MATCH, MOD, MOVE, MUT, PUB, REF, RETURN, SELF = (R[x] for x in "if impl in let loop match mod move mut pub ref return self".split())
STATIC, STRUCT, TRAIT, TYPE, UNSAFE, USE, WHERE, WHILE, ANY = (R[x] for x in "static struct trait type unsafe use where while _".split())
PATH, ARROW, FAT, DOTS, DOTSEQ, OROR, ANDAND = (R[x] for x in ":: -> => .. ..= || &&".split())

# Binding powers of the language, weakest first: assignment, range, or, and, comparison, bit or, xor, bit and, shift, sum, product.
BINARY = {R[x]: 1 for x in "+= -= *= /= %= ^= &= |= <<=".split()} | {"=": 1, DOTS: 2, DOTSEQ: 2, OROR: 3, ANDAND: 4} | {R[x]: 5 for x in ("==", "!=", "<=", ">=")}
BINARY |= {"<": 5, ">": 5, "|": 6, "^": 7, "&": 8, R["<<"]: 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
UNARY, CAST = 13, 12
_NUMBERS = re.compile(r"(?:-?n,)*")
_STARTS = set("insclinl([{<-!*&|") | {SELF, PATH, ANDAND, OROR, DOTS, DOTSEQ, MOVE, ASYNC, UNSAFE, CONST, STATIC, IF, MATCH, LOOP, WHILE, FOR, RETURN, BREAK, CONTINUE, ANY, LET}
_BLOCKY = {IF, MATCH, LOOP, WHILE, FOR, UNSAFE, "{"}


class RustParser(Parser):
    # -- items and statements

    def statement(self, context: str, at: int) -> tuple[str, object, int]:
        k, start = self.k, at
        while k[at] == "#":
            at = self.attribute(at)
        if at > start and (k[at] == "}" or k[at] == END):
            if k[start + 1] == "!":
                return WHOLE, None, at
            raise Wrong(at, "an attribute belongs to nothing")
        if k[at] == ";" and context != "members":
            return WHOLE, None, at + 1
        item = self.item(context, start, at)
        if item:
            return item
        if context != "block":
            if at > start and k[start + 1] == "!":
                return WHOLE, None, at
            raise Wrong(at, "an item is expected")
        return self.local(at)

    def attribute(self, at: int) -> int:
        at += 1
        if self.k[at] == "!":
            at += 1
        if self.k[at] != "[":
            raise Wrong(at, "an attribute's bracket is missing")
        return self.balanced(at)

    def item(self, context: str, start: int, at: int) -> tuple[str, object, int] | None:
        k = self.k
        public = k[at] == PUB
        if public:
            at += 1
            if k[at] == "(" and (k[at + 1] in (IN, SELF) or k[at + 1] == "i" and k[at + 2] == ")"):
                at = self.balanced(at)
        first = at
        if k[at] == "i" and k[at + 1] in (FN, UNSAFE, CONST, ASYNC, TRAIT, IMPL, TYPE, EXTERN):
            at += 1  # default, auto
        while k[at] in (CONST, ASYNC, UNSAFE, EXTERN) and k[at + 1] in (FN, ASYNC, UNSAFE, EXTERN, "s", TRAIT, IMPL, "{", MOD, "i"):
            if k[at] == CONST and k[at + 1] in ("i", "{") or k[at] == EXTERN and k[at + 1] in ("{", "i"):
                break
            if k[at] in (ASYNC, UNSAFE) and k[at + 1] in ("{", "i"):
                break
            at += 2 if k[at] == EXTERN and k[at + 1] == "s" else 1
        c = k[at]
        if c == FN:
            name, at = at + 1, self.need(at + 1, "i", "a function's name")
            at = self.signature(self.generics(at), context)
            if k[at] == ";" and (context in ("members", "extern") or EXTERN in k[start:name]):
                return WHOLE, None, at + 1
            return FUNCTION, name - start, self.need(at, "{", "a function's body")
        if c == STRUCT or c == "i" and k[at + 1] == "i" and k[at + 2] in "{<" and context != "block":
            at = self.where(self.generics(self.need(at + 1, "i", "a name")))
            if k[at] == "(":
                at = self.where(self.fields(at + 1, ")"))
            elif k[at] == "{":
                return WHOLE, None, self.fields(at + 1, "}")
            return WHOLE, None, self.need(at, ";", "a semicolon")
        if c == ENUM:
            at = self.where(self.generics(self.need(at + 1, "i", "a name")))
            return WHOLE, None, self.variants(self.need(at, "{", "a brace"))
        if c == TRAIT:
            at = self.generics(self.need(at + 1, "i", "a name"))
            if k[at] == ":":
                at = self.bounds(at + 1)
            at = self.where(at)
            if k[at] == "=":
                return WHOLE, None, self.need(self.bounds(at + 1), ";", "a semicolon")
            return BODY, "members", self.need(at, "{", "a brace")
        if c == IMPL:
            at = self.generics(at + 1)
            if k[at] == CONST:
                at += 1
            if k[at] == "!":
                at += 1
            at = self.type_(at)
            if k[at] == FOR:
                at = self.type_(at + 1)
            return BODY, "members", self.need(self.where(at), "{", "a brace")
        if c == EXTERN and k[at + 1] == "{" or c == "{" and k[at - 1] == "s" and at > first:
            return BODY, "extern", at + 1 + (c == EXTERN)
        if c == EXTERN:
            at = self.need(at + 1, "i", "crate")
            at = self.need(at, SELF if k[at] == SELF else "i", "a name")
            if k[at] == AS:
                at += 2
            return WHOLE, None, self.need(at, ";", "a semicolon")
        if c == MOD:
            at = self.need(at + 1, "i", "a module's name")
            if k[at] == "{":
                return BODY, "top-inner", at + 1
            return WHOLE, None, self.need(at, ";", "a semicolon")
        if c == USE:
            return WHOLE, None, self.need(self.use_tree(at + 1), ";", "a semicolon")
        if c == CONST and k[at + 1] != "{" and k[at + 1] not in (MOVE, "|", OROR) or c == STATIC and k[at + 1] not in (MOVE, "|", OROR):
            at += 1
            if k[at] == MUT:
                at += 1
            at = at + 1 if k[at] == ANY else self.need(at, "i", "a name")
            at = self.generics(at)
            at = self.type_(self.need(at, ":", "a type"))
            if k[at] == "=":
                at = self.expr(at + 1)
            elif context not in ("members", "extern"):
                raise Wrong(at, "a value is missing")
            return WHOLE, None, self.need(at, ";", "a semicolon")
        if c == TYPE:
            at = self.generics(self.need(at + 1, "i", "a name"))
            if k[at] == ":":
                at = self.bounds(at + 1)
            at = self.where(at)
            if k[at] == "=":
                at = self.where(self.type_(at + 1))
            return WHOLE, None, self.need(at, ";", "a semicolon")
        if public or at > first:
            if c == "{" and k[at - 1] == UNSAFE:
                return None
            raise Wrong(at, "an item is expected")
        if c in ("i", PATH) and context != "block":
            at = self.simple_path(at)
            if k[at] == "!":
                at += 1
                if k[at] == "i":
                    at += 1
                if k[at] not in "([{":
                    raise Wrong(at, "a macro's bracket is missing")
                brace = k[at] == "{"
                at = self.balanced(at)
                return WHOLE, None, at if brace else self.need(at, ";", "a semicolon")
            raise Wrong(at, "an item is expected")
        if c == "i" and k[at + 1] == "!" and k[at + 2] == "i":
            return WHOLE, None, self.balanced(at + 3)
        return None

    def simple_path(self, at: int) -> int:
        if self.k[at] == PATH:
            at += 1
        while True:
            if self.k[at] not in ("i", SELF):
                raise Wrong(at, "a name is missing")
            at += 1
            if self.k[at] != PATH:
                return at
            at += 1

    def use_tree(self, at: int) -> int:
        k = self.k
        if k[at] == PATH:
            at += 1
        while True:
            c = k[at]
            if c == "*":
                return at + 1
            if c == "{":
                at += 1
                while k[at] != "}":
                    at = self.use_tree(at)
                    if k[at] == ",":
                        at += 1
                    elif k[at] != "}":
                        raise Wrong(at, "a comma is missing")
                return at + 1
            if c not in ("i", SELF):
                raise Wrong(at, "a name is missing")
            at += 1
            if k[at] == PATH:
                at += 1
                continue
            if k[at] == AS:
                at += 1
                return at + 1 if k[at] == ANY else self.need(at, "i", "a name")
            return at

    def signature(self, at: int, context: str) -> int:
        k = self.k
        at = self.need(at, "(", "a parameter list")
        while k[at] != ")":
            while k[at] == "#":
                at = self.attribute(at)
            if k[at] == R["..."]:
                at += 1
            else:
                at = self.parameter(at)
            if k[at] == ",":
                at += 1
            elif k[at] != ")":
                raise Wrong(at, "a comma is missing")
        at += 1
        if k[at] == ARROW:
            at = self.type_(at + 1)
        return self.where(at)

    def parameter(self, at: int) -> int:
        k, begin = self.k, at
        if k[at] == "&":
            at += 1
            if k[at] == "l":
                at += 1
        if k[at] == MUT:
            at += 1
        if k[at] == SELF and k[at + 1] != PATH:
            return self.type_(at + 2) if k[at + 1] == ":" else at + 1
        at = self.pattern(begin)
        return self.type_(self.need(at, ":", "a parameter's type"))

    def fields(self, at: int, close: str) -> int:
        k = self.k
        while k[at] != close:
            while k[at] == "#":
                at = self.attribute(at)
            if k[at] == PUB:
                at += 1
                if k[at] == "(" and (k[at + 1] in (IN, SELF) or k[at + 1] == "i" and k[at + 2] == ")"):
                    at = self.balanced(at)
            if close == "}":
                at = self.need(self.need(at, "i", "a field's name"), ":", "a colon")
            at = self.type_(at)
            if k[at] == ",":
                at += 1
            elif k[at] != close:
                raise Wrong(at, "a comma is missing")
        return at + 1

    def variants(self, at: int) -> int:
        k = self.k
        while k[at] != "}":
            while k[at] == "#":
                at = self.attribute(at)
            at = self.need(at, "i", "a variant's name")
            if k[at] in "({":
                at = self.fields(at + 1, ")" if k[at] == "(" else "}")
            if k[at] == "=":
                at = self.expr(at + 1)
            if k[at] == ",":
                at += 1
            elif k[at] != "}":
                raise Wrong(at, "a comma is missing")
        return at + 1

    def local(self, at: int) -> tuple[str, object, int]:
        """A statement of a block that is no item."""
        k, c = self.k, self.k[at]
        if c == LET:
            at = self.pattern(at + 1)
            if k[at] == ":":
                at = self.type_(at + 1)
            if k[at] == "=":
                at = self.expr(at + 1)
                if k[at] == ELSE:
                    at = self.body(at + 1)
            return WHOLE, None, self.need(at, ";", "a semicolon")
        if c == "l" and k[at + 1] == ":" and k[at + 2] in (LOOP, WHILE, FOR, "{"):
            at += 2
            c = k[at]
        if c in _BLOCKY or c == CONST and k[at + 1] == "{":
            head = self.head(at)
            if head[0] == BODY:
                return head
            return head
        at = self.expr(at)
        if k[at] == ";":
            return WHOLE, None, at + 1
        if k[at] == "}":
            return TAIL, None, at
        if k[at - 1] == "}" and k[at - 2] != ")":
            return WHOLE, None, at  # a macro with braces
        raise Wrong(at, "a semicolon is missing")

    def head(self, at: int) -> tuple[str, object, int]:
        """The head of an expression that is a block, up to its brace."""
        k, c = self.k, self.k[at]
        if c == "{":
            return "block", None, at + 1
        if c in (UNSAFE, LOOP, CONST):
            return "block", None, self.need(at + 1, "{", "a block")
        if c == WHILE:
            return "block", None, self.need(self.expr(at + 1, 0, False), "{", "a loop's body")
        if c == FOR:
            at = self.need(self.pattern(at + 1), IN, "in")
            return "block", None, self.need(self.expr(at, 0, False), "{", "a loop's body")
        if c == IF:
            return "if", None, self.need(self.expr(at + 1, 0, False), "{", "a block")
        return "match", None, self.need(self.expr(at + 1, 0, False), "{", "a match's arms")

    def produce(self, what: str, extra: object, at: int) -> int:
        at = self.rest(what, at)
        k = self.k
        if k[at] == "." or k[at] == "?":  # the block was the first operand of a statement
            at = self.binary(self.postfix(at), 0, True)
            if k[at] == ";":
                at += 1
            elif k[at] != "}":
                raise Wrong(at, "a semicolon is missing")
        return at

    def rest(self, what: str, at: int) -> int:
        """The body of a head, and what follows it."""
        k = self.k
        if what == "match":
            return self.arms(at)
        at = self.block("block", at)
        while what == "if" and k[at] == ELSE:
            if k[at + 1] == IF:
                at = self.block("block", self.head(at + 1)[2])
            else:
                return self.body(at + 1)
        return at

    def body(self, at: int) -> int:
        return self.block("block", self.need(at, "{", "a block"))

    def arms(self, at: int) -> int:
        k = self.k
        while k[at] != "}":
            while k[at] == "#":
                at = self.attribute(at)
            at = self.pattern(at)
            if k[at] == IF:
                at = self.expr(at + 1)
            at = self.need(at, FAT, "an arrow")
            block = k[at] in _BLOCKY
            if block:
                what, _, at = self.head(at)
                at = self.rest(what, at)
                if k[at] not in (",", "}"):
                    if what == "block" and k[at] not in ".?":
                        continue
                    if k[at] in ".?" or k[at] in BINARY and k[at] not in ("|", "&", "-", "*", "<", OROR, ANDAND):
                        at = self.binary(self.postfix(at), 0, True)
                        block = False
            else:
                at = self.expr(at)
            if k[at] == ",":
                at += 1
            elif k[at] != "}" and not block:
                raise Wrong(at, "a comma is missing")
        return at + 1

    # -- types, paths, patterns

    def generics(self, at: int) -> int:
        k = self.k
        if k[at] != "<":
            return at
        at += 1
        while k[at] != ">":
            while k[at] == "#":
                at = self.attribute(at)
            if k[at] == CONST:
                at = self.type_(self.need(self.need(at + 1, "i", "a name"), ":", "a colon"))
                if k[at] == "=":
                    at = self.generic_value(at + 1)
            elif k[at] in "il":
                at += 1
                if k[at] == ":":
                    at = self.bounds(at + 1)
                if k[at] == "=":
                    at = self.type_(at + 1)
            else:
                raise Wrong(at, "a generic parameter is expected")
            if k[at] == ",":
                at += 1
            elif k[at] != ">":
                raise Wrong(at, "a comma is missing")
        return at + 1

    def generic_value(self, at: int) -> int:
        if self.k[at] == "{":
            return self.body(at)
        return at + 2 if self.k[at] == "-" else at + 1

    def where(self, at: int) -> int:
        k = self.k
        if k[at] != WHERE:
            return at
        at += 1
        while k[at] not in "{;=" and k[at] != END:
            if k[at] == "l":
                at += 1
            else:
                at = self.type_(self.for_all(at))
            at = self.bounds(self.need(at, ":", "a colon"))
            if k[at] == ",":
                at += 1
            else:
                break
        return at

    def for_all(self, at: int) -> int:
        return self.generics(at + 1) if self.k[at] == FOR else at

    def bounds(self, at: int) -> int:
        k = self.k
        while True:
            c = k[at]
            if c == "l":
                at += 1
            elif c == "(":
                at = self.need(self.bounds(at + 1), ")", "a parenthesis")
            elif c in ("i", "?", PATH, FOR, SELF, "<", CONST, "~"):
                if c == "?":
                    at += 1
                elif c == "~":
                    at += 2
                at = self.type_path(self.for_all(at))
            else:
                return at
            if k[at] != "+":
                return at
            at += 1

    def type_(self, at: int) -> int:
        k, c = self.k, self.k[at]
        if c == "i" or c == PATH or c == "<" or c == SELF:
            at = self.type_path(at)
            if k[at] == "!" and k[at + 1] in "([{":
                return self.balanced(at + 1)
            return at
        if c == "&" or c == ANDAND:
            at += 1
            if k[at] == "l":
                at += 1
            if k[at] == MUT:
                at += 1
            return self.type_(at)
        if c == "*":
            if k[at + 1] not in (CONST, MUT):
                raise Wrong(at + 1, "const or mut is missing")
            return self.type_(at + 2)
        if c == "[":
            at = self.type_(at + 1)
            if k[at] == ";":
                at = self.expr(at + 1)
            return self.need(at, "]", "a bracket")
        if c == "(":
            at += 1
            while k[at] != ")":
                at = self.type_(at)
                while k[at] == "+":
                    at = self.bounds(at + 1)
                if k[at] == ",":
                    at += 1
                elif k[at] != ")":
                    raise Wrong(at, "a comma is missing")
            return at + 1
        if c == "!" or c == ANY:
            return at + 1
        if c == IMPL or c == DYN:
            end = self.bounds(at + 1)
            if end == at + 1:
                raise Wrong(end, "a bound is missing")
            return end
        if c == FOR:
            return self.type_(self.for_all(at))
        if c in (UNSAFE, EXTERN, FN):
            while k[at] != FN:
                if k[at] not in (UNSAFE, EXTERN, "s"):
                    raise Wrong(at, "fn is missing")
                at += 1
            at = self.need(at + 1, "(", "a parameter list")
            while k[at] != ")":
                if k[at] == R["..."]:
                    at += 1
                else:
                    if k[at] in ("i", ANY) and k[at + 1] == ":":
                        at += 2
                    at = self.type_(at)
                if k[at] == ",":
                    at += 1
                elif k[at] != ")":
                    raise Wrong(at, "a comma is missing")
            at += 1
            return self.type_(at + 1) if k[at] == ARROW else at
        raise Wrong(at, "a type is expected")

    def type_path(self, at: int) -> int:
        k = self.k
        if k[at] == "<":
            at = self.type_(at + 1)
            if k[at] == AS:
                at = self.type_path(at + 1)
            at = self.need(self.need(at, ">", "an angle bracket"), PATH, "a path")
        elif k[at] == PATH:
            at += 1
        while True:
            if k[at] not in ("i", SELF):
                raise Wrong(at, "a type is expected")
            at += 1
            if k[at] == "<" or k[at] == PATH and k[at + 1] == "<":
                at = self.arguments(at + (k[at] == PATH))
            elif k[at] == "(" and k[at - 1] == "i":
                at = self.type_(at)
                if k[at] == ARROW:
                    at = self.type_(at + 1)
            if k[at] != PATH:
                return at
            at += 1

    def arguments(self, at: int) -> int:
        """Generic arguments, from their angle bracket."""
        k = self.k
        at += 1
        while k[at] != ">":
            c = k[at]
            if c == "l":
                at += 1
            elif c in "nsc-{":
                at = self.generic_value(at)
            elif c == "i" and k[at + 1] in "=:":
                at = self.type_(at + 2) if k[at + 1] == "=" else self.bounds(at + 2)
            else:
                at = self.type_(at)
                if k[at] == "=":
                    at = self.type_(at + 1)
            if k[at] == ",":
                at += 1
            elif k[at] != ">":
                raise Wrong(at, "a comma is missing")
        return at + 1

    def pattern(self, at: int) -> int:
        k = self.k
        if k[at] == "|":
            at += 1
        while True:
            at = self.single_pattern(at)
            if k[at] != "|":
                return at
            at += 1

    def single_pattern(self, at: int) -> int:
        k, c = self.k, self.k[at]
        if c in "nsc-":
            at += 2 if c == "-" else 1
            return self.pattern_range(at)
        if c in (ANY, DOTS):
            return at + 1
        if c == DOTSEQ:
            return self.single_pattern(at + 1)
        if c in (REF, MUT):
            while k[at] in (REF, MUT):
                at += 1
            at = self.need(at, "i", "a name")
            return self.single_pattern(at + 1) if k[at] == "@" else at
        if c == "&" or c == ANDAND:
            at += 1
            return self.single_pattern(at + (k[at] == MUT))
        if c in "([":
            close, at = ")" if c == "(" else "]", at + 1
            while k[at] != close:
                at = self.pattern(at)
                if k[at] == ",":
                    at += 1
                elif k[at] != close:
                    raise Wrong(at, "a comma is missing")
            return at + 1
        if c in ("i", PATH, "<", SELF):
            if c == "i" and k[at + 1] == "@":
                return self.single_pattern(at + 2)
            at = self.value_path(at)
            if k[at] == "!" and k[at + 1] in "([{":
                return self.balanced(at + 1)
            if k[at] == "(":
                return self.single_pattern(at)
            if k[at] == "{":
                at += 1
                while k[at] != "}":
                    while k[at] == "#":
                        at = self.attribute(at)
                    if k[at] == DOTS:
                        at += 1
                    else:
                        while k[at] in (REF, MUT):
                            at += 1
                        if k[at] not in "in":
                            raise Wrong(at, "a field is expected")
                        at += 1
                        if k[at] == ":":
                            at = self.pattern(at + 1)
                    if k[at] == ",":
                        at += 1
                    elif k[at] != "}":
                        raise Wrong(at, "a comma is missing")
                return at + 1
            return self.pattern_range(at)
        if c == CONST:
            return self.body(at + 1)
        raise Wrong(at, "a pattern is expected")

    def pattern_range(self, at: int) -> int:
        k = self.k
        if k[at] in (DOTS, DOTSEQ, R["..."]):
            at += 1
            if k[at] in "nc-":
                return at + (2 if k[at] == "-" else 1)
            if k[at] in ("i", PATH):
                return self.value_path(at)
        return at

    def value_path(self, at: int) -> int:
        k = self.k
        if k[at] == "<":
            at = self.type_(at + 1)
            if k[at] == AS:
                at = self.type_path(at + 1)
            at = self.need(self.need(at, ">", "an angle bracket"), PATH, "a path")
        elif k[at] == PATH:
            at += 1
        while True:
            if k[at] == "<" and k[at - 1] == PATH:
                at = self.arguments(at)
            elif k[at] in ("i", SELF):
                at += 1
            else:
                raise Wrong(at, "a name is missing")
            if k[at] != PATH:
                return at
            at += 1

    # -- expressions

    def expr(self, at: int, least: int = 0, struct: bool = True) -> int:
        return self.binary(self.prefix(at, struct), least, struct)

    def binary(self, at: int, least: int, struct: bool) -> int:
        """Precedence climbing: operators that bind at least so strongly, each with its right operand."""
        k = self.k
        compared = False
        while True:
            c = k[at]
            if c == AS:
                if CAST < least:
                    return at
                at = self.type_(at + 1)
                continue
            power = BINARY.get(c)
            if power is None:
                return at
            if c == ">" and k[at + 1] == ">":
                power, width = 9, 2
            elif c == ">" and k[at + 1] == R[">="]:
                power, width = 1, 2
            else:
                width = 1
            if power < least:
                return at
            if power == 5:
                if compared:
                    raise Wrong(at, "comparisons can't be chained")
                compared = True
            at += width
            if power == 2 and (k[at] not in _STARTS or k[at] == "{" and not struct):
                continue  # a range without an end
            at = self.binary(self.prefix(at, struct), power if power == 1 else power + 1, struct)

    def prefix(self, at: int, struct: bool) -> int:
        k, c = self.k, self.k[at]
        while c in "-!*&" or c == ANDAND:
            at += 1
            if c == "&" or c == ANDAND:
                if k[at] == "i" and k[at + 1] in (CONST, MUT):
                    at += 2
                elif k[at] == MUT:
                    at += 1
            c = k[at]
        return self.postfix(self.primary(at, struct), struct)

    def postfix(self, at: int, struct: bool = True) -> int:
        k = self.k
        while True:
            c = k[at]
            if c == ".":
                at += 1
                if k[at] == "i" or k[at] == SELF:
                    at += 1
                    if k[at] == PATH:
                        if k[at + 1] != "<":
                            raise Wrong(at + 1, "generic arguments are expected")
                        at = self.arguments(at + 1)
                elif k[at] in (AWAIT, "n"):
                    at += 1
                else:
                    raise Wrong(at, "a field or method is missing")
            elif c == "(":
                at = self.listed(at + 1, ")")
            elif c == "[":
                at = self.need(self.expr(at + 1), "]", "a bracket")
            elif c == "?":
                at += 1
            else:
                return at

    def listed(self, at: int, close: str) -> int:
        k = self.k
        while k[at] != close:
            while k[at] == "#":
                at = self.attribute(at)
            at = self.expr(at)
            if k[at] == ",":
                at = _NUMBERS.match(k, at + 1).end()
            elif k[at] != close:
                raise Wrong(at, "a comma is missing")
        return at + 1

    def primary(self, at: int, struct: bool) -> int:
        k, c = self.k, self.k[at]
        if c in ("i", SELF, PATH, "<"):
            at = self.value_path(at)
            if k[at] == "!" and k[at + 1] in "([{":
                return self.balanced(at + 1)
            if k[at] == "{" and struct:
                return self.struct_literal(at + 1)
            return at
        if c in "nsc" or c == ANY:
            return at + 1
        if c == "(":
            return self.listed(at + 1, ")")
        if c == "[":
            if k[at + 1] == "]":
                return at + 2
            end = self.expr(at + 1)
            if k[end] == ";":
                return self.need(self.expr(end + 1), "]", "a bracket")
            return self.listed(at + 1, "]")
        if c == "l" and k[at + 1] == ":":
            at += 2
            c = k[at]
        if c in _BLOCKY or c == CONST and k[at + 1] == "{":
            what, _, at = self.head(at)
            return self.rest(what, at)
        if c == "|" or c == OROR or c in (MOVE, ASYNC, STATIC):
            while k[at] in (MOVE, ASYNC, STATIC):
                at += 1
            if k[at] == "{":
                return self.body(at)
            if k[at] == OROR:
                at += 1
            else:
                at = self.need(at, "|", "a closure's parameters")
                while k[at] != "|":
                    at = self.single_pattern(at)
                    if k[at] == ":":
                        at = self.type_(at + 1)
                    if k[at] == ",":
                        at += 1
                    elif k[at] != "|":
                        raise Wrong(at, "a comma is missing")
                at += 1
            if k[at] == ARROW:
                return self.body(self.type_(at + 1))
            return self.expr(at, 0, struct)
        if c in (RETURN, BREAK, CONTINUE):
            at += 1
            if c != RETURN and k[at] == "l":
                at += 1
            if c != CONTINUE and k[at] in _STARTS and (k[at] != "{" or struct):
                return self.expr(at, 0, struct)
            return at
        if c == DOTS or c == DOTSEQ:
            if k[at + 1] in _STARTS and (k[at + 1] != "{" or struct):
                return self.expr(at + 1, 3, struct)
            if c == DOTSEQ:
                raise Wrong(at + 1, "a range's end is missing")
            return at + 1
        if c == LET:
            at = self.need(self.pattern(at + 1), "=", "a value")
            return self.expr(at, 5, False)
        raise Wrong(at, "no token of the language" if c == "E" else "an expression is expected")

    def struct_literal(self, at: int) -> int:
        k = self.k
        while k[at] != "}":
            while k[at] == "#":
                at = self.attribute(at)
            if k[at] == DOTS:
                at += 1
                if k[at] != "}":
                    at = self.expr(at)
                break
            if k[at] not in "in":
                raise Wrong(at, "a field is expected")
            at += 1
            if k[at] == ":":
                at = self.expr(at + 1)
            if k[at] == ",":
                at += 1
            elif k[at] != "}":
                raise Wrong(at, "a comma is missing")
        return self.need(at, "}", "a brace")
