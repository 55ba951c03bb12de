from quarrylight.operators.chunking import build

CART = """use std::fmt;

/// Holds line items.
/// Totals are in cents.
#[derive(Debug)]
pub struct Cart<T> {
    items: Vec<T>,
}

impl<T> Cart<T> {
    pub fn len(&self) -> usize {
        self.items.len()
    }

    /// Sums all prices.
    pub(crate) fn total(&self, price: fn(&T) -> u64) -> u64 {
        let mut sum = 0;
        for item in &self.items {
            sum += price(item);
        }
        sum
    }
}

impl<T> fmt::Display for Cart<T> {
    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result {
        write!(f, "cart")
    }
}

mod tax {
    pub fn rate() -> u32 { 7 }
}

const LIMIT: u32 = 9;"""

TRAPS = """impl Foreign for External {
    fn go(&self) -> &str { "}" }
}

fn big(a: i32) -> i32 {
    let s = "{ not a brace }";
    // } neither
    let c = '{';
    let _ = (s, c);
    a
}"""

SHAPE = """#include "shape.h"

namespace geo {

// Area helper.
int twice(int x) { return x * 2; }

class Shape {
public:
    int sides() const { return n; }
private:
    int n;
};

int Poly::area() const {
    int t = 0;
    t += 1;
    t += 2;
    t += 3;
    return t;
}

enum Color { Red };

}"""

GUARDED = "#ifndef X\n#define X\nclass Hidden {\n  int a;\n};\n#endif\n"
SPECIAL = "template <typename T>\nclass Box { T v; };\ntemplate <>\nclass Box<int> { int v; };\n"


def chunks(spark, *files):
    rows = [(i, path, text, "rust" if path.endswith(".rs") else "cpp") for i, (path, text) in enumerate(files)]
    df = spark.createDataFrame(rows, "id int, p string, t string, l string")
    return build.chunk_files(df, ["id"], "p", "t", "l").orderBy("id", "chunk_ord").collect()


def facts(rows):
    return [(r["chunk_ord"], r["symbol_name"], r["kind"], r["chunk_type"], r["parent"], r["visibility"], r["line_start"], r["line_end"], r["signature"]) for r in rows]


def test_rust_types_methods_and_module(spark):
    got = chunks(spark, ("src/shop/cart.rs", CART))
    assert facts(got) == [
        (0, "Cart", "Struct", "Overview", None, "Pub", 5, 28, "pub struct Cart<T>"),
        (1, "Cart::total", "Function", "Function", "Cart", "PubCrate", 15, 21, "pub(crate) fn total(&self, price: fn(&T) -> u64) -> u64"),
        (2, "cart", "Module", "Overview", None, "Pub", 31, 31, None),
    ]
    assert got[0]["embedding_text"].startswith("// crate::shop::cart (src/shop/cart.rs:5..28)\n// pub Cart — Totals are in cents.\npub struct Cart<T> {")
    assert "self.items.len()" in got[0]["display_text"] and "-> u64;" in got[0]["display_text"] and "sum += price" not in got[0]["display_text"]
    assert got[2]["display_text"] == "// crate::shop::cart\n\npub fn rate() -> u32 { 7 }"
    assert got[1]["doc_comment"] == "Sums all prices."


def test_rust_braces_in_texts(spark):
    got = chunks(spark, ("src/lib.rs", TRAPS))
    assert facts(got) == [
        (0, "External", "Impl", "Overview", None, "Private", 0, 2, None), (1, "crate", "Module", "Overview", None, "Pub", 4, 10, None), (2, "big", "Function", "Function", None, "Private", 4, 10, "fn big(a: i32) -> i32"),
    ]


def test_last_definition_wins_and_impls_add_up(spark):
    text = "struct A { x: u8 }\nmod m {\n pub enum A { One }\n}\nimpl A { fn a(&self) {} }\nimpl X for A { fn b(&self) {} }\n"
    first = chunks(spark, ("src/a.rs", text))[0]
    assert (first["kind"], first["visibility"]) == ("Enum", "Pub")
    assert first["display_text"] == "pub enum A { One }\n\nimpl A {\n    fn a(&self) {}\n}\n\nimpl X for A {\n    fn b(&self) {}\n}"


def test_size_threshold_and_traits(spark):
    five = "fn five() {\n    a();\n    b();\n    c();\n}\n"
    six = "fn six() {\n    a();\n    b();\n    c();\n    d();\n}\n"
    trait = "pub trait T {\n    fn d(&self) {\n        1;\n        2;\n        3;\n        4;\n    }\n}\n"
    got = chunks(spark, ("src/a.rs", five + six + trait))
    assert [r["symbol_name"] for r in got] == ["T", "a", "six"]
    assert got[0]["display_text"] == trait.strip()


def test_cpp(spark):
    got = chunks(spark, ("src/geo/shape.cpp", SHAPE))
    assert facts(got) == [
        (0, "shape", "Module", "Overview", None, "Pub", 0, 0, None), (1, "geo::Shape", "Struct", "Overview", None, "Pub", 7, 12, "class Shape"),
        (2, "geo::Poly", "Struct", "Overview", None, "Pub", 14, 20, None), (3, "geo::Poly::area", "Function", "Function", "geo::Poly", "Pub", 14, 20, "int Poly::area() const"),
    ]
    assert got[0]["display_text"] == '// src/geo/shape.cpp\n\n#include "shape.h"\n\nclass geo::Shape;\nclass geo::Poly;\n// in namespace geo\nint twice(int x);'
    assert got[1]["display_text"] == "class Shape {\npublic:\n    int sides() const;\nprivate:\n    int n;\n};"
    assert got[2]["display_text"] == "// (forward) class geo::Poly;\n\n// out-of-class definitions:\nint Poly::area() const;"


def test_cpp_guard_and_specialisation(spark):
    got = chunks(spark, ("include/guarded.h", GUARDED), ("include/box.h", SPECIAL))
    assert [(r["id"], r["symbol_name"]) for r in got] == [(0, "guarded"), (1, "box"), (1, "Box"), (1, "Box<int>")]


def test_empty_null_and_odd_texts(spark):
    got = chunks(spark, ("empty.rs", ""), ("empty.cpp", ""), ("null.cpp", None), ("odd.rs", "}}}} fn ( {{{ impl"), ("odd.cpp", "class ( { } }} template <"), ("unknown.py", "def f(): pass"))
    assert {r["id"] for r in got if r["id"] in (0, 1, 2)} == {1}
    assert not build.failures(build.items(spark.createDataFrame([(1, "odd.rs", "impl {{{", "rust")], "id int, p string, t string, l string"), ["id"], "p", "t", "l"), ["id"]).count()
    assert not chunks(spark)


def test_failing_chunker_is_reported(spark):
    def broken(text, language):
        raise ValueError("no")

    build.register_chunker("odd", broken)
    try:
        found = build.items(spark.createDataFrame([(1, "a.odd", "x", "odd")], "id int, p string, t string, l string"), ["id"], "p", "t", "l")
        assert [tuple(r) for r in build.failures(found, ["id"]).collect()] == [(1, "error: ValueError")]
    finally:
        build.CHUNKERS.pop("odd")
