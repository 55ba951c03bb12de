"""Tokenising Rust and C++ text inside tasks.

One regular expression per language cuts a text into tokens and trivia; every
token gets a one-character kind, so a file becomes a short string of kinds on
which scanners and parsers work.  Trivia (white space, comments, in C++ also
preprocessor lines) has the empty kind.

Kinds: ``i`` name, ``n`` number or boolean, ``s`` string, ``c`` character,
``l`` lifetime, ``E`` what is no token; punctuation of one character stands for
itself, keywords and longer operators have a character of their own
(``RUST[word]``, ``CPP[word]``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

# The keywords and operators of the two languages.
RUST_WORDS = (
    "as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref "
    "return self static struct trait type unsafe use where while _"
).split()
RUST_OPERATORS = "<<= ..= ... :: -> => == != <= >= && || += -= *= /= %= ^= &= |= .. <<".split()
CPP_WORDS = (
    "alignas alignof asm auto bool break case catch char char8_t char16_t char32_t class const consteval constexpr "
    "constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum "
    "explicit extern float for friend goto if inline int long mutable namespace new noexcept nullptr operator private "
    "protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast "
    "struct switch template this thread_local throw try typedef typeid typename union unsigned using virtual void "
    "volatile wchar_t while"
).split()
CPP_OPERATORS = "<<= <=> ->* ... :: -> ++ -- << <= >= == != && || += -= *= /= %= ^= &= |= .* ##".split()


def _table(words: list[str], operators: list[str]) -> dict[str, str]:
    return {w: chr(256 + k) for k, w in enumerate([*words, *operators])}


RUST = _table(RUST_WORDS, RUST_OPERATORS)
CPP = _table(CPP_WORDS, CPP_OPERATORS)

_FLAT_COMMENT = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/"
_RAW = "|".join(rf'{h}"(?:[^"]++|"(?!{h}))*+"{h}' if h else '"[^"]*+"' for h in ("", "#", "##", "###", "####"))
_PUNCT = r"[-+*/%^!&|=<>@.,;:#$?~(){}\[\]]"


def _any(operators: list[str]) -> str:
    return "|".join(re.escape(x) for x in sorted(operators, key=len, reverse=True))


#: Names and the commonest punctuation come first, and every token takes the white space after it along.
_NAME, _PLAIN = r"""[A-Za-z_]\w*+(?!["'#])""", r"[(){}\[\],;?~@$]"
_RUST = re.compile(
    rf"""(?:{_NAME}|{_PLAIN}"""
    r"""|\d\w*+(?:(?<=[eE])(?<!0x\w)[+-]\d[\d_]*+)?(?:\.(?:\d[\d_]*+(?:[eE][+-]?[\d_]++)?\w*+|(?![\w.])))?"""
    rf"""|(?:br|cr|r)(?:{_RAW})|r\#[A-Za-z_]\w*+|[bc]?"(?:[^"\\]++|\\[\s\S])*+\""""
    r"""|b?'(?:[^'\\\n\r]|\\(?:u\{{[0-9a-fA-F_]++\}}|x[0-9a-fA-F]{{2}}|[nrt\\0'"]))'|'[A-Za-z_]\w*+""".replace("{{", "{").replace("}}", "}")
    + rf"""|//[^\n]*+|{_FLAT_COMMENT}|/\*|{_any(RUST_OPERATORS)}|{_PUNCT}|[A-Za-z_]\w*+|\s|.)\s*+"""
)
_CPP_SPACE = r"(?:[^\S\n]++|\\\r?\n|\n(?!\s*+\#))*+"
_CPP_DIRECTIVE = r"\n\s*+\#(?:[^\n\\/]++|\\\r?[\s\S]|/(?![*/])|/\*(?:[^*]++|\*(?!/))*+\*/)*+(?://[^\n]*+)?"
_CPP_REST = (
    r"""|\.?\d(?:'?[\w.]|(?<=[eEpP])[+-])*+"""
    r"""|(?:u8|[uUL])?"(?:[^"\\\n]++|\\[\s\S])*+"(?:[A-Za-z_]\w*+)?|(?:u8|[uUL])?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]++|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|[^\n]))++'"""
    r"""|//(?:[^\n\\]++|\\\r?[\s\S])*+|/\*(?:[^*]++|\*(?!/))*+\*/|/\*"""
    rf"""|{_any(CPP_OPERATORS)}|{_PUNCT}|[A-Za-z_]\w*+|{_CPP_DIRECTIVE}|\s|\\\r?\n|.){_CPP_SPACE}"""
)
_CPP = re.compile(rf"(?:{_NAME}|{_PLAIN}{_CPP_REST}")
_CPP_RAW = re.compile(rf"""(?:{_NAME}|{_PLAIN}|(?:u8|[uUL])?R"(?P<d>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=d)"(?:[A-Za-z_]\w*+)?{_CPP_REST}""")
_CONDITIONAL = re.compile(r"#\s*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b(?:[^\S\n]*(\w+)[^\S\n]*$)?", re.M)


class _Kinds(dict):
    """Remembers the kind of each token text; what is too long or too many is not kept."""

    def __init__(self, table: dict[str, str], rust: bool) -> None:
        self.fixed = table | {x: x for x in "-+*/%^!&|=<>@.,;:#$?~(){}[]"} | {"true": "n", "false": "n", "/*": "E"}
        if not rust:
            self.fixed |= {"nullptr": "n"}
        self.rust = rust
        self.update(self.fixed)

    def __missing__(self, whole: str) -> str:
        token = whole.strip() or " "
        first, last = token[0], token[-1]
        if token in self.fixed:
            kind = self.fixed[token]
        elif (first.isalpha() or first == "_") and last != '"' and last != "'" and '"' not in token:
            kind = "i"
        elif first.isdigit() or first == "." and len(token) > 1:
            kind = "n"
        elif first.isspace() or first == "#" or token.startswith(("//", "/*")):
            kind = ""
        elif '"' in token and len(token) > 1 and first != "'":
            kind = "s"
        elif first == "'" or last == "'":
            kind = "l" if self.rust and last != "'" else "c" if len(token) > 2 else "E"
        else:
            kind = "E"
        if len(whole) < 80:
            if len(self) > 400_000:
                self.clear()
                self.update(self.fixed)
            self[whole] = kind
        return kind


_KINDS = {True: _Kinds(RUST, True), False: _Kinds(CPP, False)}


class Rows:
    """``rows[k]``: the row on which part k begins."""

    def __init__(self, parts: list[str]) -> None:
        self.at = [0, *accumulate(map(len, parts))]
        text = "".join(parts)
        self.ends, found = [], text.find("\n")
        while found >= 0:
            self.ends.append(found)
            found = text.find("\n", found + 1)

    def __getitem__(self, part: int) -> int:
        return bisect_left(self.ends, self.at[part])


class Tokens:
    """The tokens of one text. ``parts`` joined give the text; ``kinds`` has one character a token, without trivia."""

    def __init__(self, text: str, rust: bool) -> None:
        self.rust = rust
        self.parts = _cut_rust(text) if rust else _cut_cpp(text)
        self.codes = list(map(_KINDS[rust].__getitem__, self.parts))
        self.kinds = "".join(self.codes)

    def places(self) -> list[int]:
        """For each token its index in parts."""
        return [k for k, c in enumerate(self.codes) if c]

    def rows(self) -> Rows:
        """For each part the 0-based row on which it begins."""
        return Rows(self.parts)


def _cut_rust(text: str) -> list[str]:
    parts = _RUST.findall(text)
    if "/*" not in text or not any(p.rstrip() == "/*" for p in parts if p[:2] == "/*"):
        return parts
    parts, at = [], 0  # a comment within a comment: cut again, piece by piece
    while at < len(text):
        m = _RUST.match(text, at)
        if m.group().rstrip() != "/*":
            parts.append(m.group())
            at = m.end()
            continue
        depth, end = 0, at
        for x in re.finditer(r"/\*|\*/", text[at:]):
            depth += 1 if x.group() == "/*" else -1
            if not depth:
                end = at + x.end()
                break
        parts.append(text[at : end or at + 2] if end > at else "/*")
        at = end if end > at else at + 2
    return parts


def _cut_cpp(text: str) -> list[str]:
    if not text:
        return []
    text = "\n" + text  # a directive is known by the line end before it
    if 'R"' in text:
        parts = [m.group() for m in _CPP_RAW.finditer(text)]
    else:
        parts = _CPP.findall(text)
    if parts and parts[0].startswith("\n"):
        parts[0] = parts[0][1:]
        if not parts[0]:
            del parts[0]
    return parts


def unbalanced_conditionals(parts: list[str]) -> bool:
    """True if the preprocessor's conditionals of a C++ text don't pair."""
    depth = 0
    for p in parts:
        if "#" in p and p.lstrip()[:1] == "#":
            m = _CONDITIONAL.search(p)
            if m:
                word = m.group(1)
                depth += 1 if word in ("if", "ifdef", "ifndef") else -1 if word == "endif" else 0
                if depth < 0 or word.startswith("el") and depth == 0:
                    return True
    return depth != 0
