import math

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import code_text as ct
from quarrylight.functions import paths as p
from quarrylight.functions import vectors
from quarrylight.functions.lexing import Tokens


def one(spark, f, *values, types="string"):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {types}" for n in names))
    return df.select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (p.module_path, "src/main.rs", "crate"), (p.module_path, "src/a/mod.rs", "crate::a"), (p.module_path, "src/a/b.rs", "crate::a::b"), (p.module_path, "crates/x/src/lib.rs", "crate::crates::x::src::lib"),
        (p.extract_module, "// crate::a (src/a.rs:1..2)\nx", "crate::a"), (p.extract_module, "// f.cpp:3..9", "f.cpp:3..9"), (p.extract_module, "x", ""), (p.extract_module, "", ""), (p.extract_module, "// a (b) (f:1..2)", "a (b)"),
        (p.extension, "A.RS", "rs"), (p.extension, ".rs", None), (p.extension, "x.tar.gz", "gz"), (p.extension, "Makefile", None), (p.extension, "a.b/c", None),
        (p.module_name, "src/geo/shape.cpp", "shape"), (p.module_name, "x.tar.gz", "x.tar"), (p.normal_path, ".//a\\b/./c/", "a/b/c"), (p.normal_path, ".", ""), (p.normal_path, None, None),
        (ct.visibility, "pub", "Pub"), (ct.visibility, "pub(crate)", "PubCrate"), (ct.visibility, "pub(super)", "PubSuper"), (ct.visibility, "pub(in crate::x)", "PubCrate"), (ct.visibility, "pub(self)", "Private"), (ct.visibility, None, "Private"),
        (ct.visibility_rank, "Pub", 0), (ct.visibility_rank, "Private", 3), (ct.visibility_rank, None, 4), (ct.visibility_prefix, "PubSuper", "pub(super) "), (ct.visibility_prefix, None, ""),
        (ct.base_type, "Foo<T>", "Foo"), (ct.base_type, "&Foo", "&Foo"), (ct.owner_of, "::a::B::f", "a::B"), (ct.owner_of, "f", None), (ct.name_of, "::a::B::f", "f"), (ct.name_of, "f", "f"),
        (ct.signature, "fn a() -> u8 { 1 }", "fn a() -> u8"), (ct.signature, "struct A;\nx", "struct A;"), (ct.porcelain_path, "R  a -> b", "b"), (ct.porcelain_path, " M a b", "a b"), (ct.porcelain_path, " M", None),
    ],
)
def test_scalar(spark, f, given, expected):
    assert one(spark, f, given) == expected


def test_root_prefix(spark):
    for path, root, expected in [("src/a.rs", "src", True), ("src2/a.rs", "src", False), ("x", "", True), (None, "src", False)]:
        assert one(spark, p.under_root, path, root) is expected


def test_file_key(spark):
    assert one(spark, p.file_key, "/p/sub", "a.rs", "/p") == "sub/a.rs"
    assert one(spark, p.file_key, "/q", "a.rs", "/p") == "/q/a.rs"


@pytest.mark.parametrize(
    "line, expected",
    [
        ("M\ta", [("a", "modified")]), ("A\ta", [("a", "added")]), ("D\ta", [("a", "deleted")]), ("R90\ta\tb", [("a", "deleted"), ("b", "added")]), ("C75\ta\tb", [("b", "added")]), ("T\ta", []), ("R90\ta", []), ("", []), ("M", []),
    ],
)
def test_name_status(spark, line, expected):
    assert [tuple(x) for x in one(spark, ct.status_changes, line)] == expected


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(vectors.similarity(F.col("a"), F.col("b")).alias("s"), vectors.normalised(F.col("a")).alias("n")).collect()
    assert got[0]["s"] == pytest.approx(0.96) and got[1]["s"] == 0 and got[2]["s"] == 0
    assert got[0]["n"] == pytest.approx([0.6, 0.8]) and got[1]["n"] == [0, 0] and got[3]["n"] is None
    assert math.isclose(sum(x * x for x in got[0]["n"]), 1)


@pytest.mark.parametrize(
    "text, rust, words",
    [
        ("let s = r#\"a \"} b\"#; // }\nx", True, ["let", "s", "=", "r#\"a \"} b\"#", ";", "x"]),
        ("/* a /* b */ c */ fn f<'a>() { '{' }", True, ["fn", "f", "<", "'a", ">", "(", ")", "{", "'{'", "}"]),
        ("a >>= 1..=2; 1.5e-3 0x1f_u8 b'x' b\"y\"", True, ["a", ">", ">=", "1", "..=", "2", ";", "1.5e-3", "0x1f_u8", "b'x'", "b\"y\""]),
        ("#define A \\\n {\nint x = 1'000; auto s = R\"d(})\" )d\"; // {\n", False, ["int", "x", "=", "1'000", ";", "auto", "s", "=", "R\"d(})\" )d\"", ";"]),
        ("  # if X /* { */\nx->y <=> 'a' L\"b\"_u", False, ["x", "->", "y", "<=>", "'a'", "L\"b\"_u"]),
        ("", False, []), ("", True, []), ("\r\n", False, []),
    ],
)
def test_tokens(text, rust, words):
    t = Tokens(text, rust)
    assert "".join(t.parts) == text
    assert [p.strip() for p, c in zip(t.parts, t.codes) if c] == words
    assert len(t.kinds) == len(words) and "E" not in t.kinds


def test_rows():
    t = Tokens("a\n\nb /* x\ny */ c\n", True)
    rows, places = t.rows(), t.places()
    assert [rows[i] for i in places] == [0, 2, 3]


def test_what_is_no_token():
    assert "E" in Tokens('let s = "open', True).kinds and "E" in Tokens("/* open", True).kinds and "E" in Tokens("int a = `1`;", False).kinds
