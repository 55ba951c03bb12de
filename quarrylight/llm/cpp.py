"""Parser for C++ after preprocessing: declarations and statements by recursive descent, expressions by precedence climbing.

Directives are white space to it; ``parsing`` gives it one branch of conditionals at a time where both at once don't parse.  Where the language needs names to tell a
declaration from an expression or a template from a comparison, it tries the
first and takes the second if that fails.  Macros that stand for pieces of
declarations are not known and count as errors.
"""

from __future__ import annotations

import re

from ..functions.lexing import CPP, Tokens
from .grammar import BODY, END, FUNCTION, TAIL, WHOLE, Parser, Wrong

C = CPP
ALIGNAS, ASM, AUTO, CASE, CATCH, CLASS, CONCEPT_REQUIRES, CONST, CONSTEXPR, DECLTYPE, DEFAULT, DELETE, DO, ELSE, ENUM, EXPLICIT, EXTERN, FOR, FRIEND, GOTO, IF, INLINE, MUTABLE, NAMESPACE, NEW, NOEXCEPT, OPERATOR, RETURN, SIZEOF, STATIC_ASSERT, STRUCT, SWITCH, TEMPLATE, THIS, THROW, TRY, TYPEDEF, TYPEID, TYPENAME, UNION, USING, VOLATILE, WHILE = (
    C[x]
    for x in "alignas asm auto case catch class requires const constexpr decltype default delete do else enum explicit extern for friend goto if inline mutable namespace new noexcept operator return sizeof static_assert struct switch template this throw try typedef typeid typename union using volatile while".split()
)
SCOPE, ARROW, DOTS, ANDAND = C["::"], C["->"], C["..."], C["&&"]
BUILTIN = {C[x] for x in "auto bool char char8_t char16_t char32_t double float int long short signed unsigned void wchar_t".split()}
SPECIFIERS = {C[x] for x in "static extern inline virtual explicit constexpr consteval constinit mutable thread_local register friend typedef const volatile".split()}
CASTS = {C[x] for x in "static_cast const_cast dynamic_cast reinterpret_cast".split()}
RECORD = {CLASS, STRUCT, UNION}
ACCESS = {C[x] for x in "public private protected".split()}
BINARY = {C["||"]: 1, ANDAND: 2, "|": 3, "^": 4, "&": 5, C["=="]: 6, C["!="]: 6, "<": 7, ">": 7, C["<="]: 7, C[">="]: 7, C["<=>"]: 8, C["<<"]: 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, C[".*"]: 12, C["->*"]: 12}
ASSIGN = {"="} | {C[x] for x in "+= -= *= /= %= ^= &= |= <<=".split()}
UNARY = set("+-!~*&") | {C["++"], C["--"], ANDAND}
JUMPS = {C["break"], C["continue"]}
_AFTER_TEMPLATE = set("({)],;>}:.&*?=|+-[\0") | {SCOPE, ANDAND, C["||"], C["=="], C["!="], C[">="], DOTS, ARROW}
_AFTER_CAST = set("insc(!~[") | {THIS, SIZEOF, NEW, SCOPE, TYPENAME} | CASTS | BUILTIN
_NUMBERS = re.compile(r"(?:-?n,)*")


class CppParser(Parser):
    def __init__(self, tokens: Tokens, memo: dict) -> None:
        super().__init__(tokens, memo)
        self.angle = False

    def attempt(self, what, *args):
        """The result of a method, or None if it meets an error."""
        errors, node, children, angle = len(self.errors), self.node, len(self.node.children), self.angle
        try:
            got = what(*args)
            if len(self.errors) == errors:
                return got
        except Wrong:
            pass
        self.angle, self.node = angle, node
        del self.errors[errors:], node.children[children:]
        return None

    # -- statements

    def after_body(self, at: int) -> int:
        """Behind the handlers of a function whose body is tried."""
        while self.k[at] == CATCH and self.k[at + 1] == "(":
            at = self.block("block", self.need(self.balanced(at + 1), "{", "a handler's body"))
        return at

    def statement(self, context: str, at: int) -> tuple[str, object, int]:
        k, start = self.k, at
        while k[at] == "[" and k[at + 1] == "[":
            at = self.balanced(at)
        c = k[at]
        if context == "block":
            found = self.inner(at, c)
            if found:
                return found
        if c == ";":
            return WHOLE, None, at + 1
        if c == NAMESPACE or c == INLINE and k[at + 1] == NAMESPACE:
            at += 1 + (c == INLINE)
            while k[at] == "[":
                at = self.balanced(at)
            while k[at] in ("i", SCOPE, INLINE):
                at += 1
            if k[at] == "=":
                return WHOLE, None, self.need(self.named(at + 1), ";", "a semicolon")
            return BODY, "inner", self.need(at, "{", "a brace")
        if c == TEMPLATE and k[at + 1] == "<":
            at = self.parameters_of_template(at + 1)
            what, extra, end = self.statement("top" if context == "block" else context, at)
            return (what, extra + at - start, end) if what == FUNCTION else (what, extra, end)
        if c == TEMPLATE or c == EXTERN and k[at + 1] == TEMPLATE:
            at += 1 + (c == EXTERN)
        elif c == EXTERN and k[at + 1] == "s":
            if k[at + 2] == "{":
                return BODY, "inner", at + 3
            at += 2
        elif c == USING:
            return WHOLE, None, self.need(self.using(at + 1), ";", "a semicolon")
        elif c == STATIC_ASSERT or c == ASM:
            at += 1
            while k[at] in (VOLATILE, GOTO):
                at += 1
            if k[at] != "(":
                raise Wrong(at, "a parenthesis is missing")
            return WHOLE, None, self.need(self.balanced(at) if c == ASM else self.need(self.arguments(at + 1, ")") - 1, ")", "a parenthesis"), ";", "a semicolon")
        elif c in ACCESS and context == "members":
            at += 1
            if k[at] == "i":
                at += 1
            return WHOLE, None, self.need(at, ":", "a colon")
        elif c == "}" or c == END:
            raise Wrong(at, "a declaration is missing")
        if context == "block":
            declared = self.attempt(self.declaration, context, start, at)
            if declared:
                return declared
            end = self.attempt(self.expr, at)
            if end and k[end] == ";":
                return WHOLE, None, end + 1
            raise self.cause(context, start, at)
        return self.declaration(context, start, at)

    def cause(self, context: str, start: int, at: int) -> Wrong:
        """Why neither a declaration nor an expression is there: the error that lies further on."""
        found = []
        errors, node, children = len(self.errors), self.node, len(self.node.children)
        for what, args in ((self.declaration, (context, start, at)), (self.expr, (at,))):
            self.angle = False
            try:
                end = what(*args)
                found.append(Wrong(end if isinstance(end, int) else at, "a semicolon is missing"))
            except Wrong as e:
                found.append(e)
            found += [Wrong(*e) for e in self.errors[errors:]]
            self.node = node
            del self.errors[errors:], node.children[children:]
        self.angle = False
        return max(found, key=lambda e: e.at)

    def inner(self, at: int, c: str) -> tuple[str, object, int] | None:
        k = self.k
        if c == "{":
            return BODY, "block", at + 1
        if c == IF:
            at += 1
            if k[at] == CONSTEXPR:
                at += 1
            return self.opened("if", self.condition(at))
        if c == FOR:
            return self.opened("loop", self.for_head(self.need(at + 1, "(", "a parenthesis")))
        if c == WHILE or c == SWITCH:
            return self.opened("loop", self.condition(at + 1))
        if c == RETURN or c == C["co_return"]:
            at += 1
            if k[at] == "{":
                at = self.braced(at + 1)
            elif k[at] != ";":
                at = self.expr(at)
            return WHOLE, None, self.need(at, ";", "a semicolon")
        if c in JUMPS:
            return WHOLE, None, self.need(at + 1, ";", "a semicolon")
        if c == CASE:
            at = self.expr(at + 1)
            if k[at] == DOTS:
                at = self.expr(at + 1)
            return WHOLE, None, self.need(at, ":", "a colon")
        if c == DEFAULT:
            return WHOLE, None, self.need(at + 1, ":", "a colon")
        if c == GOTO:
            return WHOLE, None, self.need(self.need(at + 1, "i", "a label"), ";", "a semicolon")
        if c == DO:
            return self.opened("do", at + 1)
        if c == TRY:
            return "try", True, self.need(at + 1, "{", "a block")
        if c == "i" and k[at + 1] == ":":
            return WHOLE, None, at + 2
        return None

    def opened(self, what: str, at: int) -> tuple[str, object, int]:
        return (what, True, at + 1) if self.k[at] == "{" else (what, False, at)

    def produce(self, what: str, extra: object, at: int) -> int:
        k = self.k
        if what == "class":
            at = self.block("members", at)
            return self.declarators("members", at, at, False)[2]
        if what == "try":
            at = self.block("block", at)
            if k[at] != CATCH:
                raise Wrong(at, "catch is missing")
            while k[at] == CATCH:
                at = self.need(at + 1, "(", "a parenthesis")
                at = at + 1 if k[at] == DOTS else self.parameter(at)
                at = self.block("block", self.need(self.need(at, ")", "a parenthesis"), "{", "a block"))
            return at
        at = self.block("block", at) if extra else self.single(at)
        if what == "do":
            at = self.need(at, WHILE, "while")
            return self.need(self.condition(at), ";", "a semicolon")
        if what == "if" and k[at] == ELSE:
            return self.single(at + 1)
        return at

    def single(self, at: int) -> int:
        """One statement of a block."""
        what, extra, end = self.statement("block", at)
        if what == BODY:
            return self.block(extra, end)
        if what in (WHOLE, TAIL):
            return end
        return self.produce(what, extra, end)

    def condition(self, at: int) -> int:
        k = self.k
        at = self.need(at, "(", "a parenthesis")
        end = self.attempt(self.expr, at)
        if end is None or k[end] != ")":
            declared = self.attempt(self.declaration, "condition", at, at)
            if not declared:
                raise self.cause("condition", at, at)
            end = declared[2]
            if k[end] == ";":
                end += 1
            if k[end] != ")":
                end = self.expr(end)
        return self.need(end, ")", "a parenthesis")

    def for_head(self, at: int) -> int:
        k = self.k
        if k[at] == ";":
            at += 1
        else:
            declared = self.attempt(self.declaration, "condition", at, at)
            if declared:
                at = declared[2]
                if k[at] == ":":
                    at += 1
                    return self.need(self.braced(at + 1) if k[at] == "{" else self.expr(at), ")", "a parenthesis")
            else:
                at = self.expr(at)
            at = self.need(at, ";", "a semicolon")
        if k[at] != ";":
            at = self.expr(at)
        at = self.need(at, ";", "a semicolon")
        if k[at] != ")":
            at = self.expr(at)
        return self.need(at, ")", "a parenthesis")

    def using(self, at: int) -> int:
        k = self.k
        if k[at] == NAMESPACE:
            return self.named(at + 1)
        if k[at] == ENUM:
            at += 1
        if k[at] == "i" and k[at + 1] in "=[":
            at += 1
            while k[at] == "[":
                at = self.balanced(at)
            return self.type_id(self.need(at, "=", "a type"))
        while True:
            if k[at] == TYPENAME:
                at += 1
            at = self.named(at)
            if k[at] == DOTS:
                at += 1
            if k[at] != ",":
                return at
            at += 1

    # -- declarations

    def declaration(self, context: str, start: int, at: int) -> tuple[str, object, int]:
        at, typed, opened = self.specifiers(at, context)
        if opened:
            return opened
        return self.declarators(context, start, at, True, typed)

    def specifiers(self, at: int, context: str) -> tuple[int, bool, tuple | None]:
        """The place behind the specifiers and the type, whether there was a type, and the head of a class with a body."""
        k, typed = self.k, False
        while True:
            c = k[at]
            if c in SPECIFIERS:
                at += 1
                if c == EXPLICIT and k[at] == "(":
                    at = self.balanced(at)
            elif c in BUILTIN:
                if typed == "name":
                    raise Wrong(at, "a second type")
                typed = "builtin"
                at += 1
            elif c == ALIGNAS:
                at = self.balanced(self.need(at + 1, "(", "a parenthesis") - 1)
            elif c == "[" and k[at + 1] == "[":
                at = self.balanced(at)
            elif typed:
                return at, True, None
            elif c == DECLTYPE:
                at, typed = self.balanced(self.need(at + 1, "(", "a parenthesis") - 1), "name"
                if k[at] == SCOPE:
                    at = self.named(at + 1, True)
            elif c == TYPENAME:
                at, typed = self.named(at + 1, True), "name"
            elif c in RECORD or c == ENUM:
                at += 1
                if c == ENUM and k[at] in (CLASS, STRUCT):
                    at += 1
                while k[at] == "[" or k[at] == ALIGNAS:
                    at = self.balanced(at + (k[at] == ALIGNAS))
                if k[at] in ("i", SCOPE):
                    at = self.named(at, True)
                elif k[at] not in "{:":
                    raise Wrong(at, "a name is missing")
                typed = "name"
                if context in ("condition", "parameter"):
                    continue
                if c == ENUM:
                    if k[at] == ":":
                        at = self.type_id(at + 1)
                    if k[at] == "{":
                        return at, True, (WHOLE, None, self.declarators("members", at, self.enumerators(at + 1), False)[2])
                    continue
                if k[at] == "i" and k[at + 1] in ":{":
                    at += 1  # final
                if k[at] == ":" and context != "condition":
                    at = self.bases(at + 1)
                    if k[at] != "{":
                        raise Wrong(at, "a brace is missing")
                if k[at] == "{":
                    return at, True, ("class", None, at + 1)
            elif c == "i" or c == SCOPE:
                end = self.named(at, True)
                if k[end] == "(" and not (k[end + 1] in "*&" and k[end + 2] in ("i", "*", ")", CONST)) or k[end - 1] != "i" and k[end - 1] != ">" or k[end] == SCOPE:
                    return at, False, None  # a constructor, destructor or operator
                at, typed = end, "name"
            else:
                return at, False, None

    def bases(self, at: int) -> int:
        k = self.k
        while True:
            while k[at] in ACCESS or k[at] == C["virtual"]:
                at += 1
            at = self.named(at, True)
            if k[at] == DOTS:
                at += 1
            if k[at] != ",":
                return at
            at += 1

    def enumerators(self, at: int) -> int:
        k = self.k
        while k[at] != "}":
            at = self.need(at, "i", "an enumerator")
            while k[at] == "[":
                at = self.balanced(at)
            if k[at] == "=":
                at = self.assign(at + 1)
            if k[at] == ",":
                at += 1
            elif k[at] != "}":
                raise Wrong(at, "a comma is missing")
        return at + 1

    def declarators(self, context: str, start: int, at: int, function: bool, typed: bool = True) -> tuple[str, object, int]:
        k = self.k
        if k[at] == ";" and typed and context != "condition":
            return WHOLE, None, at + 1
        first = True
        while True:
            begin = at
            at, name, called = self.declarator(at, typed, context)
            if name < 0 and not (context == "members" and k[at] == ":"):
                raise Wrong(at, "a name is missing")
            if not typed and not called:
                raise Wrong(at, "a type is missing")
            c = k[at]
            if called and first and c in ("{", ":", TRY) and context not in ("block", "condition") and function:
                if c == TRY:
                    at += 1
                if k[at] == ":":
                    at = self.initialisers(at + 1)
                return FUNCTION, name - start, self.need(at, "{", "a function's body")
            if c == "=":
                at += 1
                if k[at] in (DEFAULT, DELETE):
                    at += 1
                else:
                    at = self.braced(at + 1) if k[at] == "{" else self.assign(at)
            elif c == "{" and not called:
                at = self.braced(at + 1)
            elif c == ":" and not called and context == "members":
                at = self.assign(at + 1)
                if k[at] == "=":
                    at = self.assign(at + 1)
            if k[at] == ",":
                at += 1
                first = False
                continue
            if context == "condition":
                return WHOLE, None, at
            if begin == at:
                raise Wrong(at, "a declaration is incomplete")
            return WHOLE, None, self.need(at, ";", "a semicolon")

    def initialisers(self, at: int) -> int:
        k = self.k
        while True:
            at = self.named(at, True)
            if k[at] == "(":
                at = self.arguments(at + 1, ")")
            elif k[at] == "{":
                at = self.braced(at + 1)
            else:
                raise Wrong(at, "an initialiser is missing")
            if k[at] == DOTS:
                at += 1
            if k[at] != ",":
                return at
            at += 1

    def pointers(self, at: int) -> int:
        k = self.k
        while True:
            c = k[at]
            if c in "*&" or c in (ANDAND, CONST, VOLATILE):
                at += 1
            elif c == "i" and k[at + 1] == SCOPE and k[at + 2] == "*":
                at += 3
            else:
                return at

    def declarator(self, at: int, typed: bool, context: str) -> tuple[int, int, bool]:
        """The place behind a declarator, its name's or -1, and whether it has a parameter list."""
        k, name, called = self.k, -1, False
        if typed:
            at = self.pointers(at)
        if k[at] == DOTS:
            at += 1
        c = k[at]
        if c == "(" and typed and (k[at + 1] in ("*", "&", ANDAND, "(") or k[at + 1] == "i" and (k[at + 2] == ")" and k[at + 3] in "([" or k[at + 2] == SCOPE and k[at + 3] == "*")):
            at, name, _ = self.declarator(at + 1, True, context)
            at = self.need(at, ")", "a parenthesis")
        elif c == "[" and typed and k[at + 1] == "i" and context in ("block", "condition"):
            at = name = at + 1  # structured binding
            while k[at] == "i":
                at += 1
                if k[at] == ",":
                    at += 1
            at = self.need(at, "]", "a bracket")
            return at, name, False
        elif c in ("i", SCOPE, "~", OPERATOR):
            end = self.named(at)
            name = self.last_name(at, end)
            at = end
        while True:
            c = k[at]
            if c == "(":
                end = self.attempt(self.parameters, at + 1)
                if end is None:
                    if context not in ("block", "condition", "top", "inner") or not typed:
                        self.parameters(at + 1)
                    at = self.arguments(at + 1, ")")
                    return at, name, False
                at, called = end, True
                if context == "block" and k[at] not in (";", ",", "(", "[", CONST, NOEXCEPT, ARROW, "="):
                    alone = self.attempt(self.arguments, self.opening(at), ")")
                    if alone != at:
                        raise Wrong(at, "a semicolon is missing" if k[at] != "{" else "a function within a function")
                while True:
                    c = k[at]
                    if c in (CONST, VOLATILE, "&", ANDAND, MUTABLE):
                        at += 1
                    elif c in (NOEXCEPT, THROW):
                        at += 1
                        if k[at] == "(":
                            at = self.balanced(at)
                    elif c == ARROW:
                        at = self.type_id(at + 1)
                    elif c == "i" and context == "members":
                        at += 1  # override, final
                    elif c == "[" and k[at + 1] == "[":
                        at = self.balanced(at)
                    elif c == CONCEPT_REQUIRES:
                        at = self.binary(self.unary(at + 1), 1)
                    else:
                        break
            elif c == "[":
                if k[at + 1] == "[":
                    at = self.balanced(at)
                elif k[at + 1] == "]":
                    at += 2
                else:
                    at = self.need(self.free_expr(at + 1), "]", "a bracket")
            else:
                return at, name, called

    def opening(self, at: int) -> int:
        """Behind the parenthesis that the one before ``at`` closes."""
        depth = 0
        while True:
            at -= 1
            if self.k[at] == ")":
                depth += 1
            elif self.k[at] == "(":
                depth -= 1
                if not depth:
                    return at + 1

    def last_name(self, at: int, end: int) -> int:
        """The token that names a qualified name's last part."""
        k, depth, name = self.k, 0, at
        while at < end:
            c = k[at]
            if c == "<" and k[at - 1] != OPERATOR and k[at - 1] != "<":
                depth += 1
            elif c == ">" and depth:
                depth -= 1
            elif not depth and c in ("i", "~", OPERATOR):
                name = at
                if c != "i":
                    return at
            at += 1
        return name

    def parameters(self, at: int) -> int:
        k = self.k
        while k[at] != ")":
            if k[at] == DOTS:
                at += 1
            else:
                at = self.unangled(self.parameter, at)
            if k[at] == ",":
                at += 1
                if k[at] == ")":
                    raise Wrong(at, "a parameter is missing")
            elif k[at] == DOTS and k[at + 1] == ")":
                at += 1
            elif k[at] != ")":
                raise Wrong(at, "a comma is missing")
        return at + 1

    def parameter(self, at: int) -> int:
        k = self.k
        if k[at] == THIS:
            at += 1
        at = self.type_specifiers(at)
        at, _, _ = self.declarator(at, True, "parameter")
        if k[at] == "=":
            at += 1
            at = self.braced(at + 1) if k[at] == "{" else self.assign(at)
        return at

    def type_specifiers(self, at: int) -> int:
        end, typed, opened = self.specifiers(at, "parameter")
        if opened or not typed:
            raise Wrong(end, "a type is expected")
        return end

    def type_id(self, at: int) -> int:
        at = self.pointers(self.type_specifiers(at))
        k = self.k
        if k[at] == "(":
            if k[at + 1] in "*&" or k[at + 1] == ANDAND:
                at = self.need(self.pointers(at + 1), ")", "a parenthesis")
            if k[at] == "(":
                at = self.parameters(at + 1)
                while k[at] in (CONST, NOEXCEPT, "&"):
                    at += 1
        while k[at] == "[" and k[at + 1] in "]n":
            at = self.need(at + 1 + (k[at + 1] != "]"), "]", "a bracket")
        if k[at] == DOTS:
            at += 1
        return at

    def parameters_of_template(self, at: int) -> int:
        k = self.k
        at = self.need(at, "<", "an angle bracket")
        while k[at] != ">":
            if k[at] == TEMPLATE:
                at = self.parameters_of_template(at + 1)
            if k[at] in (TYPENAME, CLASS) and k[at + 1] in ("i", ",", ">", "=", DOTS) and not (k[at + 1] == "i" and k[at + 2] == SCOPE):
                at += 1
                if k[at] == DOTS:
                    at += 1
                if k[at] == "i":
                    at += 1
                if k[at] == "=":
                    at = self.type_id(at + 1)
            else:
                at = self.angled(self.parameter, at)
            if k[at] == ",":
                at += 1
            elif k[at] != ">":
                raise Wrong(at, "a comma is missing")
        at += 1
        if k[at] == CONCEPT_REQUIRES:
            at = self.binary(self.unary(at + 1), 1)
        return at

    def angled(self, what, *args) -> int:
        """A method within angle brackets, where a greater-than sign ends an expression."""
        before, self.angle = self.angle, True
        try:
            return what(*args)
        finally:
            self.angle = before

    def free_expr(self, at: int) -> int:
        """An expression within brackets, where ``>`` compares."""
        before, self.angle = self.angle, False
        at = self.expr(at)
        self.angle = before
        return at

    def unangled(self, what, *args) -> int:
        if not self.angle:
            return what(*args)
        self.angle = False
        try:
            return what(*args)
        finally:
            self.angle = True

    def template_arguments(self, at: int) -> int:
        """Behind the closing angle bracket of the one at ``at``."""
        k = self.k
        at += 1
        while k[at] != ">":
            end = self.attempt(self.angled, self.type_id, at)
            if end is None or k[end] not in ",>":
                end = self.angled(self.assign, at)
                if k[end] == DOTS:
                    end += 1
            at = end
            if k[at] == ",":
                at += 1
            elif k[at] != ">":
                raise Wrong(at, "a comma is missing")
        return at + 1

    def named(self, at: int, type_: bool = False) -> int:
        """A qualified name, with template arguments."""
        k = self.k
        if k[at] == SCOPE:
            at += 1
        while True:
            c = k[at]
            if c == TEMPLATE:
                at += 1
                c = k[at]
            if c == "~":
                return self.need(at + 1, "i", "a destructor's name")
            if c == OPERATOR:
                return self.operator(at + 1)
            if c != "i":
                raise Wrong(at, "no token of the language" if c == "E" else "a name is expected")
            at += 1
            if k[at] == "<":
                end = self.attempt(self.template_arguments, at)
                if end and (type_ or k[end] in _AFTER_TEMPLATE):
                    at = end
            if k[at] != SCOPE or k[at + 1] == "*":
                return at
            at += 1

    def operator(self, at: int) -> int:
        k, c = self.k, self.k[at]
        if c in (NEW, DELETE):
            return at + 3 if k[at + 1] == "[" else at + 1
        if c in "([":
            return at + 2
        if c == "s":
            return at + 2 if k[at + 1] == "i" else at + 1
        if c == ">" and k[at + 1] in (">", C[">="]):
            return at + 2
        if c in "+-*/%^&|~!=<>," or c in BINARY or c in ASSIGN or c in UNARY or c in (ARROW, C["->*"]):
            return at + 1
        return self.pointers(self.type_specifiers(at))

    # -- expressions

    def expr(self, at: int) -> int:
        at = self.assign(at)
        while self.k[at] == ",":
            at = self.assign(at + 1)
        return at

    def assign(self, at: int) -> int:
        k = self.k
        c = k[at]
        if c == THROW:
            return at + 1 if k[at + 1] in ";)" else self.assign(at + 1)
        if c == C["co_yield"]:
            return self.assign(at + 1)
        at = self.binary(self.unary(at), 1)
        c = k[at]
        if c == "?":
            at = self.need(self.free_expr(at + 1), ":", "a colon")
            return self.assign(at)
        if c in ASSIGN or c == ">" and k[at + 1] == C[">="] and not self.angle:
            at += 1 + (c == ">")
            return self.braced(at + 1) if k[at] == "{" else self.assign(at)
        return at

    def binary(self, at: int, least: int) -> int:
        """Precedence climbing."""
        k = self.k
        while True:
            c = k[at]
            power = BINARY.get(c)
            if power is None:
                return at
            width = 1
            if c == ">":
                if self.angle:
                    return at
                if k[at + 1] == ">":
                    power, width = 9, 2
                elif k[at + 1] == C[">="]:
                    return at
            if power < least:
                return at
            if k[at + width] == DOTS:
                return at
            at = self.binary(self.unary(at + width), power + 1)

    def unary(self, at: int) -> int:
        k, c = self.k, self.k[at]
        while c in UNARY:
            at += 1
            c = k[at]
        if c == "(":
            if k[at + 1] in BUILTIN or k[at + 1] in ("i", SCOPE, CONST, STRUCT, TYPENAME, VOLATILE):
                end = self.attempt(self.unangled, self.type_id, at + 1)
                if end and k[end] == ")" and (k[end + 1] in _AFTER_CAST or k[end - 1] in "*&" and k[end + 1] in UNARY or k[at + 1] in BUILTIN and k[end + 1] in UNARY):
                    cast = self.attempt(self.unary, end + 1)
                    if cast:
                        return cast
                if end and k[end] == ")" and k[end + 1] == "{":
                    return self.postfix(self.braced(end + 2))
        elif c == SIZEOF or c == C["alignof"]:
            at += 1
            if k[at] == DOTS:
                at += 1
            if k[at] == "(":
                end = self.attempt(self.unangled, self.type_id, at + 1)
                if end and k[end] == ")":
                    return end + 1
            return self.unary(at)
        elif c == NEW or c == SCOPE and k[at + 1] == NEW:
            at += 1 + (c == SCOPE)
            if k[at] == "(":
                end = self.attempt(self.unangled, self.type_id, at + 1)
                if end and k[end] == ")" and k[end + 1] in ";,)({":
                    at = end + 1
                else:
                    at = self.pointers(self.type_specifiers(self.arguments(at + 1, ")")))
            else:
                at = self.pointers(self.type_specifiers(at))
            while k[at] == "[":
                at = at + 2 if k[at + 1] == "]" else self.need(self.free_expr(at + 1), "]", "a bracket")
            if k[at] == "(":
                at = self.arguments(at + 1, ")")
            elif k[at] == "{":
                at = self.braced(at + 1)
            return self.postfix(at)
        elif c == DELETE or c == SCOPE and k[at + 1] == DELETE:
            at += 1 + (c == SCOPE)
            if k[at] == "[":
                at = self.need(at + 1, "]", "a bracket")
            return self.unary(at)
        elif c == C["co_await"]:
            return self.unary(at + 1)
        elif c == NOEXCEPT:
            return self.need(self.expr(self.need(at + 1, "(", "a parenthesis")), ")", "a parenthesis")
        return self.postfix(self.primary(at))

    def postfix(self, at: int) -> int:
        k = self.k
        while True:
            c = k[at]
            if c == "(":
                at = self.arguments(at + 1, ")")
            elif c == "[":
                at = self.arguments(at + 1, "]")
            elif c == "." or c == ARROW:
                at = self.named(at + 1)
            elif c == C["++"] or c == C["--"]:
                at += 1
            elif c == DOTS and k[at + 1] in "),}>":
                at += 1
            else:
                return at

    def arguments(self, at: int, close: str) -> int:
        return self.unangled(self.listed, at, close)

    def listed(self, at: int, close: str) -> int:
        k = self.k
        while k[at] != close:
            at = self.braced(at + 1) if k[at] == "{" else self.assign(at)
            if k[at] == DOTS:
                at += 1
            if k[at] == ",":
                at = _NUMBERS.match(k, at + 1).end()
                if k[at] == close and close != "}":
                    raise Wrong(at, "an argument is missing")
            elif k[at] != close:
                raise Wrong(at, "a comma is missing")
        return at + 1

    def braced(self, at: int) -> int:
        """A braced initialiser, whose brace is read."""
        return self.unangled(self.clauses, at)

    def clauses(self, at: int) -> int:
        k = self.k
        while k[at] != "}":
            if k[at] == "." and k[at + 1] == "i":
                at += 2
                if k[at] == "=":
                    at += 1
            elif k[at] == "[":
                end = self.attempt(self.expr, at + 1)
                if end and k[end] == "]" and k[end + 1] == "=":
                    at = end + 2
            at = self.braced(at + 1) if k[at] == "{" else self.assign(at)
            if k[at] == DOTS:
                at += 1
            if k[at] == ",":
                at = _NUMBERS.match(k, at + 1).end()
            elif k[at] != "}":
                raise Wrong(at, "a comma is missing")
        return at + 1

    def primary(self, at: int) -> int:
        k, c = self.k, self.k[at]
        if c == "i" or c in (SCOPE, OPERATOR, "~"):
            at = self.named(at)
            return self.braced(at + 1) if k[at] == "{" else at
        if c in "nc" or c == THIS:
            return at + 1
        if c == "s":
            while k[at] in "si":
                if k[at] == "i" and k[at + 1] != "s":
                    break
                at += 1
            return at
        if c == "(":
            if k[at + 1] == DOTS and k[at + 2] in BINARY:
                return self.need(self.free_expr(at + 3), ")", "a parenthesis")
            if k[at + 1] == "{":
                return self.need(self.block("block", at + 2), ")", "a parenthesis")
            at = self.free_expr(at + 1)
            if k[at] in BINARY and k[at + 1] == DOTS:
                at += 2
                if k[at] in BINARY:
                    at = self.unangled(self.unary, at + 1)
            return self.need(at, ")", "a parenthesis")
        if c == "[":
            return self.unangled(self.closure, at)
        if c in BUILTIN:
            while k[at] in BUILTIN:
                at += 1
            if k[at] == "(":
                return self.arguments(at + 1, ")")
            return self.braced(self.need(at, "{", "an initialiser"))
        if c in CASTS:
            at = self.angled(self.type_id, self.need(at + 1, "<", "an angle bracket"))
            at = self.need(self.need(at, ">", "an angle bracket"), "(", "a parenthesis")
            return self.need(self.free_expr(at), ")", "a parenthesis")
        if c == TYPENAME:
            at = self.named(at + 1, True)
            if k[at] == "(":
                return self.arguments(at + 1, ")")
            return self.braced(self.need(at, "{", "an initialiser"))
        if c == TYPEID:
            at = self.need(at + 1, "(", "a parenthesis")
            end = self.attempt(self.unangled, self.type_id, at)
            if end is None or k[end] != ")":
                end = self.free_expr(at)
            return self.need(end, ")", "a parenthesis")
        if c == DECLTYPE:
            at = self.balanced(self.need(at + 1, "(", "a parenthesis") - 1)
            return self.named(at + 1) if k[at] == SCOPE else self.braced(at + 1) if k[at] == "{" else at
        if c == CONCEPT_REQUIRES:
            at += 1
            if k[at] == "(":
                at = self.parameters(at + 1)
            return self.balanced(self.need(at, "{", "a brace") - 1)
        raise Wrong(at, "no token of the language" if c == "E" else "an expression is expected")

    def closure(self, at: int) -> int:
        k = self.k
        at += 1
        while k[at] != "]":
            if k[at] in "&*=" and k[at + 1] in ",]":
                at += 1
            else:
                if k[at] in "&*":
                    at += 1
                if k[at] == DOTS:
                    at += 1
                at = at + 1 if k[at] == THIS else self.need(at, "i", "a capture")
                if k[at] == DOTS:
                    at += 1
                if k[at] == "=":
                    at = self.assign(at + 1)
                elif k[at] in "({":
                    at = self.balanced(at)
            if k[at] == ",":
                at += 1
            elif k[at] != "]":
                raise Wrong(at, "a comma is missing")
        at += 1
        if k[at] == "<":
            at = self.parameters_of_template(at)
        if k[at] == "(":
            at = self.parameters(at + 1)
        while k[at] in (MUTABLE, CONSTEXPR, NOEXCEPT, C["static"], C["consteval"]):
            at += 1
            if k[at] == "(":
                at = self.balanced(at)
        if k[at] == ARROW:
            at = self.type_id(at + 1)
        return self.block("block", self.need(at, "{", "a lambda's body"))
