import pytest
from pyspark.sql import functions as F

from quarrylight.llm import docpairs, parsing
from quarrylight.llm.parsing import errors_with_rows, parse

RUST_VALID = [
    "", "// only\n/* a /* b */ c */\n", "#![allow(dead_code)]\nuse a::{self, b::*, c as d};\nmod x;\npub mod y { fn f() {} }\nextern crate z;",
    "pub(in crate::a) struct S<'a, T: Clone + 'a = u8, const N: usize = 3>(pub &'a T, [u8; N]) where T: Fn(u8) -> u8;\nstruct U;\nunion V { a: u8, b: i8 }",
    "enum E { A, B(u8, String) , C { x: u8 }, #[x] D = 1 + 2, }\ntype T<X> = Vec<Option<X>>;\nstatic mut A: &'static [u8] = &[1, 2];\nconst _: () = ();",
    "trait T: A + ?Sized { const N: u8; type X: Clone; fn f(&self); fn g(self: Box<Self>) -> u8 { 1 } }\nunsafe impl<T> Send for S<T> where T: Send {}\nimpl !Sync for S {}",
    "pub async unsafe extern \"C\" fn f<'a>(mut x: u8, _: &'a mut [u8], (a, b): (u8, u8), c: impl Fn(u8) -> Box<dyn X + 'a>) -> Result<(), !> where for<'b> X: Y<'b> { Ok(()) }",
    "fn f() { let x = a.b::<u8>()?.c[1].0.1(2, |x, y: u8| x + y) as u64 as f32; let S { a, ref mut b, .. } = s else { return }; let [a, .., b] = v; }",
    "fn f() { if let Some(x) = y && x > 3 { 1 } else if a { 2 } else { 3 }; while let Ok(_) | Err(_) = g() { break; } 'a: loop { continue 'a; } for i in (0..n).rev() {} }",
    "fn f() -> u8 { match x { A | B if y => 1, C(1..=2, 'a'..='z', -1) => { 2 } D { x: 1, y } => return, &E => (), _ => unreachable!(\"{}\", 1) } }",
    "fn f() { x = y; x += 1 << 2 >> 3; a && b || !c; *p = &mut q; &&r; -1; a..b; ..; ..=3; x..; (1,); [0; 3]; [] ; {} ; async move { 1 }.await; unsafe { g() }; move || {}; || -> u8 { 1 }; }",
    "fn f() { if a { 1 } else { 2 }.foo(); match a {}?; S { a: 1, b, ..d }; if (S { a: 1 }).x {} ; <T as X>::f(); Vec::<u8>::new(); return; x.await?; }",
    "macro_rules! m { ($x:expr) => { $x }; }\nthread_local! { static A: u8 = 1; }\nlazy!(a, b);\nfn f() { m![1; 2]; vec!{a} println!() }",
    "impl S { #[inline] pub const fn f(&mut self, #[x] a: u8,) -> Self { Self { a } } pub const A: u8 = 1; type T = u8; m!(); }", "fn f() { r#type.r#fn(r#\"a \"} \"#, b'\\'', '\\u{1F600}', '\"', 1e5, 0b1_0, 1.); }",
]
RUST_INVALID = [
    "fn f() { let x = 1 let y = 2; }", "fn f() { g(1, , 2); }", "fn f() {", "}", "fn f() { let x: = 1; }", "fn f() { a b; }", "<<<<<<< ours\nfn f() {}", "fn f() { let = 1; }", "struct S { a u8 }", "fn f( { }", "fn f() { x + ; }", "def f(x):\n    return x\n", "# Title\n\nSome text.",
    "fn f() { \"open }", "fn f() { /* open }", "#include <a>\nint main() { return 0; }", "fn f() { if x { 1 }", "fn f() { match x { A => 1 B => 2 } }", "pub", "#[derive(A)]", "let x = 1;", "fn f() { a < b < c; }", "enum E { A B }", "use a::;", "impl X for { }", "\x00\x01",
]
CPP_VALID = [
    "", "// only\n/* x */", "#include <a>\n#define A(x) \\\n  { x\n#if A\n#elif B\n#else\n#endif\nint x = 1, *y = &x, z[] = {1, 2}, (*f)(int, char);", "namespace a::b { inline namespace c { } using namespace d; using e::f; using T = int*; namespace x = y; }\nextern \"C\" { int f(void); }\nextern \"C\" int g();",
    "class A final : public B<int>, private virtual c::D { public: A() : x(1), B{2} {} explicit A(int x = 3); virtual ~A() = default; A(const A&) = delete; int f() const noexcept override; operator bool() const; A& operator=(A&& o); bool operator()(int) { return true; } friend class X; static constexpr int n = 3; int bits : 3; protected: struct In { int a; } in; enum class E : int { P, Q = 2, }; };",
    "template <typename T, int N = 3, class... Ts> struct S { T v[N]; };\ntemplate <> struct S<int, 1> {};\ntemplate <typename T> T f(T&& x) { return std::forward<T>(x); }\ntemplate class std::vector<int>;",
    "void f() { for (int i = 0; i < 3; ++i) g(i); for (auto& [k, v] : m) { } while (x) --x; do { } while (y); if (auto p = q(); p) {} else if (z) r(); else { } switch (x) { case 1: case A::B: break; default: ; } goto end; end: return; }",
    "void f() { auto l = [&, x = 1](int a) mutable -> int { return a; }; std::vector<std::pair<int, int>> v{{1, 2}, {3, 4}}; a < b; a * b; T(x); T x(1); T y{2}; x->y.z[1](2)++; delete[] p; new T[3]; new (p) T{1}; (int)x; (T*)y; sizeof(int); sizeof x; static_cast<const T&>(x); throw X(); }",
    "int A::b::f(int x) const && { try { g(); } catch (const E& e) { } catch (...) { throw; } return x ? y : z, w; }\nA::A() : B(1) {}\nA::~A() {}\nbool operator<(const A& a, const A& b) { return a.x < b.x && c > d; }\nauto h() -> int { return 1; }",
    "struct P { int x, y; } p = {.x = 1, .y = 2};\ntypedef unsigned long long u64;\nstatic const char* s[] = {\"a\" \"b\", R\"d(})\" )d\", L\"x\"};\nenum { A, B };\nstatic_assert(sizeof(int) == 4, \"x\");\nunion U { int a; };\nclass F;\nlong long x = 1'000ull, y = 0x1.8p3;",
    "void f() { int a[3] = {1}, *p = a; unsigned n = x << 2 >> 1; x >>= 1; bool b = !x == ~y; const auto c = static_cast<std::string>(a % 3); std::function<void(int)> g; if (x) return; for (;;) {} A::B<C>::d(e); x = a ? b : c; }",
]
CPP_INVALID = [
    "void f() {", "}", "int f() { int x = ; }", "int f() { g(1,, 2); }", "class A { int x; }\nint y;", "void f() { if x > 1 { } }", "void f() { return a b; }", "void f() { x = y z(); }", "<<<<<<< ours\nint x;", "int f() { void g() { } }", "fn f() -> u8 { 1 }", "def f():\n    pass", "{\"a\": 1}", "[a]\nx = 1",
    "# T\nSome text.", "const char* s = \"open;\n", "/* open", "void f() { for (int i = 0; i < 3) {} }", "#if A\nint x;", "int x;\n#endif", "int x", "void f() { switch (x) { case 1 g(); } }", "class { public int x; };", "void f() { a.; }", "template <typename T struct X {};", "void f() { do { } (x); }", "int a = (1 + 2;", "\x00",
]


@pytest.mark.parametrize("text", RUST_VALID)
def test_valid_rust(text):
    assert parsing.parse(text, True)[1].errors == []


@pytest.mark.parametrize("text", RUST_INVALID)
def test_invalid_rust(text):
    assert parsing.parse(text, True)[1].errors


@pytest.mark.parametrize("text", CPP_VALID)
def test_valid_cpp(text):
    assert parsing.parse(text, False)[1].errors == []


@pytest.mark.parametrize("text", CPP_INVALID)
def test_invalid_cpp(text):
    assert parsing.parse(text, False)[1].errors


def test_recovers_and_keeps_every_error():
    tokens, parser = parsing.parse("fn a() { x y; ok(); }\nfn b() {}\nfn c() { let = 1; }\n", True)
    assert [e["line_no"] for e in parsing.errors_with_rows(tokens, parser)] == [0, 2] and len(parser.functions) == 3


def test_remembered_shapes_change_nothing():
    text = "fn f() { a.b(c, 1); if x { y(); } return z; }\n" * 3
    assert [parsing.parse(text, True)[1].functions for _ in range(3)].count(parsing.parse(text, True)[1].functions) == 3
    assert parsing.parse(text + "}", True)[1].errors


def test_deep_and_long_texts():
    assert parsing.parse("fn f() { " + "(" * 300 + "1" + ")" * 300 + " }", True)[1].errors == []
    assert parsing.parse("fn f() { " + "(" * 60000 + "1" + ")" * 60000 + " }", True)[1].errors == []  # depth is no error
    assert parsing.parse("fn f() { " + "(" * 60000 + "1" + ")" * 59999 + " }", True)[1].errors
    assert parsing.parse("fn f() { " + "x.y(1); " * 50000 + "}", True)[1].errors == []
    assert parsing.parse("int a[] = {" + "-1.5, " * 50000 + "};", False)[1].errors == []


FILES = "file_id long, repo string, file_path string, file_text string, language int, valid string"


def test_check_files(spark):
    rows = [(1, "r", "a.rs", "fn f() {}", 1, "x"), (2, "r", "b.RS", "fn f() {", 1, "x"), (2, "r", "b.RS", "fn f() {", 1, "x"), (3, None, "c.cc", None, 1, "x"), (4, "r", None, "int x", 1, "x"), (None, "r", "a.rs", "x", 1, "x")]
    df = spark.createDataFrame(rows, FILES)
    got = parsing.check_files(df)
    seen = {r["file_id"]: (r["language"], r["valid"], r["n_errors"], r["first_line"]) for r in got.collect()}
    assert seen == {1: ("rust", True, 0, None), 2: ("rust", False, 1, 0), 3: ("cpp", True, 0, None), 4: ("cpp", False, 1, 0)}
    assert sorted((str(r["repo"]), r["language"], r["files"], r["invalid_files"], r["acceptance"]) for r in parsing.rates(got).collect()) == [("None", "cpp", 1, 0, 1.0), ("r", "cpp", 1, 1, 0.0), ("r", "rust", 2, 1, 0.5)]
    assert parsing.check_files(df.limit(0)).count() == 0 and parsing.rates(parsing.check_files(df.limit(0))).count() == 0


DOCS_RUST = '''/// Adds two prices together carefully.

#[inline]
// ordinary
pub fn add(a: u8) -> u8 { a }
/// TODO: write this later on please
fn later() {}
/// The add price total.
fn add_price_total() {}
// An ordinary comment of many words here.
fn plain() {}
#[doc = "Written as an attribute for once."]
fn attributed() {}
/** Block comments count as well here. */
fn block() {}
//// Four slashes are no documentation at all.
fn slashes() {}
mod m {
    //! Inner comments belong to the module itself.
    fn inner() {}
}
impl S {
    /// Moves everything to the other side.
    pub fn go(&self) { let s = "/// fn fake() {}"; }
    /// ...
    fn dots() {}
}
trait T {
    /// Has no body so it is none.
    fn none(&self);
}
/// Describes the closing function of all.
fn last() { /* fn hidden() {} */ }'''
DOCS_CPP = """// Adds two prices together carefully.
int add(int a) { return a; }

// Too far away to count for anything.

int far() { return 1; }
int x; // trailing comment with many words
int trailing() { return 1; }
/* One comment of many words
   over two rows. */
template <typename T>
T both(T x) { return x; }
class A {
    /// Moves everything to the other side.
    void go() const { }
    /// Only declared and so it is none.
    void none();
    // FIXME add docs
    void fix() { }
};
/// @param a a
/// @param b b
void A::tags(int a, int b) { }
// ----------------
void line() { }
// Destroys whatever is left of it.
A::~A() { }
// The second of these operators compares.
bool operator==(const A& a, const A& b) { return true; }"""


def test_pairs(spark):
    df = spark.createDataFrame([(1, "a.rs", DOCS_RUST), (2, "b.cpp", DOCS_CPP), (2, "b.cpp", DOCS_CPP), (3, "c.rs", DOCS_RUST + "}"), (4, "d.rs", None), (5, "e.rs", ""), (6, "f.cpp", DOCS_CPP.replace("\n", "\r\n")), (None, "a.rs", DOCS_RUST)], "file_id long, file_path string, file_text string")
    got = docpairs.pair_functions(df).distinct().orderBy("file_id", "line_no").collect()
    names = {i: [(r["name"], r["line_no"]) for r in got if r["file_id"] == i] for i in (1, 2, 3, 4, 5, 6)}
    assert names[1] == [("add", 4), ("attributed", 12), ("block", 14), ("go", 23), ("last", 32)]
    assert names[2] == [("add", 1), ("both", 11), ("go", 14), ("~A", 26), ("operator==", 28)] and names[6] == names[2]
    assert names[3] == names[4] == names[5] == []
    go = next(r for r in got if r["name"] == "go" and r["file_id"] == 1)
    assert go["description"] == "Moves everything to the other side." and go["signature"] == "pub fn go(&self)" and go["code"].endswith("}") and (go["line_start"], go["line_end"]) == (23, 23)
    assert docpairs.pair_functions(df.limit(0), code=False).count() == 0


@pytest.mark.parametrize("doc, expected", [("", True), ("---- ....", True), ("TODO", True), ("Add a proper description here (todo).", True), ("See above.", True), ("Sums all prices.", True), ("Sums all the prices.", False), ("The cart total of items.", True), ("@param items the items", True), ("Returns the total of the cart.", True), ("Neither writer nor reader knows.", False)])
def test_trivial(doc, expected):
    assert docpairs.trivial(doc, ["cart_total", "items"]) is expected


@pytest.mark.parametrize("doc, expected", [
    ("Write the summary row to the report table.", False), ("Insert a comment above the matched line and return its row.", False), ("Write the summary\nrow to the report table.", False), ("Comment lines here are skipped by the reader.", False),
    ("Add documentation for this function.", True), ("Write a proper summary here, please", True), ("Documentation to be written later!", True), ("@brief Add description here\n@param items the items", True),
])
def test_placeholders_fill_their_sentence(doc, expected):
    assert docpairs.trivial(doc, ["cart_total", "items"]) is expected


def test_both_found_over_given_columns(spark):
    df = spark.createDataFrame([(1, "r", "a.rs", DOCS_RUST)], "file_id long, repo string, file_path string, file_text string").withColumn("k", F.lit(1)).withColumn("p", F.lit(2)).withColumn("t", F.lit(3))
    assert docpairs.pair_functions(df).count() == 5 and parsing.check_files(df).count() == 1


@pytest.mark.parametrize(
    "text",
    [
        "#ifdef A\nvoid f(int x) {\n#else\nvoid f(long x) {\n#endif\n  g(x);\n}\n", "void f() try { g(); } catch (...) { h(); }\nint x;", "struct A { A() try : b(1) {} catch (int e) {} int b; };",
        "module;\n#include <a>\nexport module foo;\nimport bar;\nexport int f(int a) { return a; }\n", "class EXPORT_API Foo { int a; };", "static inline int __attribute__((unused)) f(void) { return 1; }", "int f() {\n#if A\n return 1 +\n#elif B\n return 2 +\n#else\n return 3 -\n#endif\n 4;\n}",
        "int x = " + "(" * 30_000 + "1" + ")" * 30_000 + ";", "void f() " + "{" * 30_000 + "}" * 30_000,
    ],
)
def test_valid_cpp_that_is_not_plain(text):
    assert not errors_with_rows(*parse(text, False))


@pytest.mark.parametrize("text", ["int f() {\n#if A\n return 1;\n#else\n return 3 +;\n#endif\n}", "#if A\nint f( {\n#else\nint g();\n#endif\n", "catch (...) {}"])
def test_branches_with_errors(text):
    assert errors_with_rows(*parse(text, False))


def test_foreign_functions_without_bodies():
    assert not errors_with_rows(*parse('extern "C" fn f();\nfn g() {}', True)) and errors_with_rows(*parse("fn f();", True))


def test_tree_and_functions_of_every_branch():
    tokens, parser = parse("namespace a {\nstruct B {\n  int f() { if (x) { y(); } return 1; }\n};\n}\nint g() { return 2; }\n", False)
    nodes = list(parser.tree.visit("function"))
    assert [tokens.parts[tokens.places()[n.name]].strip() for n in nodes] == ["f", "g"] and all(n.start < n.body < n.end for n in nodes)
    assert nodes[0].children and nodes[0] not in parser.tree.children and nodes[1] in parser.tree.children
    text = "#if A\n// Adds one to the whole total.\nint f(int x) {\n#else\n// Takes one from the whole total.\nint g(long x) {\n#endif\n  return x;\n}\n"
    tokens, parser = parse(text, False)
    assert {f["name"] for t, p in [(tokens, parser), *parser.others] for f in docpairs.functions_of(t, p)} == {"f", "g"}
