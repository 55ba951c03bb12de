import re

import pytest

from quarrylight.llm import handwritten as hw

HAND = "// Part of shop, written by the acme team.\n\nuse a::b;\n\n/// Adds.\npub fn add(a: u8, b: u8) -> u8 {\n    let c = a + b;\n    if c > 3 {\n        return c;\n    }\n    loop_over(c);\n    c\n}\n\npub struct Cart {\n    items: Vec<u8>,\n    total: u64,\n}\n\nimpl Cart {\n    pub fn new() -> Self {\n        Self { items: vec![], total: 0 }\n    }\n}\n"
OPS = "".join(f"pub fn op_{i:03}(c: &mut Ctx) {{\n    c.r[{i}] = c.r[1] + {i};\n    c.pc += {i};\n}}\n" for i in range(20))
DATA = "pub const A: [f64; 90] = [\n" + "".join("    " + " ".join(f"{i}.{j}5," for j in range(9)) + "\n" for i in range(10)) + "];\n"
TEXTS = "pub const A: &str = concat!(\n" + '    "' + 'GjJwmWN3rYY4yTv' * 4 + '",\n' * 1 + ('    "' + "wBoZdZmFFUGUbOTJOyMB" * 3 + '",\n') * 20 + ");\n"
MINI = "pub fn a(b:&[u8])->usize{let mut c=0;for d in b{c+=*d as usize}c%7}" * 20
SOURCES = "repo string, source_ord int, source_language string, root string, dep boolean, extensions array<string>"
FILES = "file_id long, repo string, file_path string, file_text string, path string, declared int"


@pytest.mark.parametrize(
    "text, kind",
    [
        (HAND, None), ("", None), (OPS, "repeated"), (DATA, "data"), (TEXTS, "data"), (MINI, "minified"), ('{\n  "a": 1,\n  "b": 2\n}\n' * 10, "data"), ('[server]\nport = 80\nname = "x"\n', "data"), ("{\n  int a = 1;\n}\n", None), ("[[nodiscard]]\nint f();\nint g();\n", None),
        ("// Code generated by x from y.idl. DO NOT EDIT.\n" + HAND, "generated_notice"), ("/* AUTOGENERATED by x, edit y.tmpl instead */\n" + HAND, "generated_notice"), ("// @generated\nfn f() {}", "generated_notice"), ("// <auto-generated> x </auto-generated>\nfn f() {}", "generated_notice"),
        ("/*\n * a_b -- machine output, do not modify by hand.\n */\nfn f() {}", "generated_notice"), ("// Built with `x --emit y`. Regenerate rather than edit.\nfn f() {}", "generated_notice"), ("// This file was automatically produced by x 1.2;\n// any change made here will be lost.\nfn f() {}", "generated_notice"),
        ("// Skips every file that another tool marked as generated, so nobody has to edit them.\nfn f() {}", None), ('fn f() { let s = "// Code generated by x. DO NOT EDIT."; }', None), ("fn f() {}\n// @generated\n", "generated_notice"), ("#![allow(x)]\n// @generated\nfn f() {}", "generated_notice"), ("fn f() {}\n// @generated\nfn g() {}\n", None), ("// It helps to copy the macro by hand before filing a ticket.\nfn f() {}", None),
        ("// SPDX-FileCopyrightText: The other contributors\nfn f() {}", "foreign_notice"), ("/*\n * This file is part of other 5.1.\n * Copyright (c) the other authors. See COPYING for terms.\n */\nfn f() {}", "foreign_notice"), ("// other v1.2 - imported unchanged from upstream\nfn f() {}", "foreign_notice"),
        ("// Vendored from the other project, revision ab12; local patches: none\nfn f() {}", "foreign_notice"), ("/*\n * other: single-file distribution, release 4.1\n * Redistribution and use in source form are permitted.\n */\nfn f() {}", "foreign_notice"),
        ("/*\n * shop internal source. Copyright (c) the acme team.\n */\nfn f() {}", None),
    ],
)
def test_evidence(text, kind):
    got = {k for k, v in hw.evidence("src/a.rs", text, ["acme", "shop"]).items() if v}
    assert kind in got if kind else not got - {"own_notice"}


def test_notices_behind_directives():
    for head in ("#pragma once\n", "#ifndef A_H\n#define A_H\n"):
        assert hw.evidence("a.h", head + "// @generated\nint f();\n", [])["generated_notice"]
    assert not hw.evidence("a.h", "int g();\n// @generated\nint f();\n", [])["generated_notice"]


def test_labels(spark):
    files = [
        (1, "acme/shop", "src/a.rs", HAND), (2, "acme/shop", "vendor/x/a.rs", HAND), (3, "acme/shop", "src/vendor_portal/a.rs", HAND), (4, "acme/shop", "libs/x/a.rs", HAND), (5, "acme/shop", "libs/xy/a.rs", HAND), (6, "acme/shop", "src\\third_party\\a.rs", HAND),
        (7, "acme/shop", "src/gen_test.rs", HAND), (8, None, "src/a.rs", HAND), (9, "acme/shop", None, HAND), (10, "acme/shop", "src/b.rs", None), (11, "acme/shop", "src/c.rs", OPS), (11, "acme/shop", "src/c.rs", OPS), (None, "acme/shop", "src/c.rs", OPS),
        (12, "b/c", "vendor/own/a.rs", HAND), (13, "b/c", "vendor/a.rs", HAND), (14, "b/c", "src/made.rs", HAND), (15, "b/c", ".gitattributes", "# x\nsrc/made.rs linguist-generated\n*.rs !text\nvendor/** linguist-vendored\n"), (16, "b/c", "vendor/own/.gitattributes", "*.rs linguist-vendored=false\n"),
    ]
    df = spark.createDataFrame([(*f, "clash", 1) for f in files], FILES)
    sources = spark.createDataFrame([("acme/shop", 0, "rust", "src", False, None), ("acme/shop", 1, "rust", "./libs//x/", True, ["RS"]), ("acme/shop", 1, "rust", "./libs//x/", True, ["RS"])], SOURCES)
    got = {r["file_id"]: r["reason"] for r in hw.label_files(df, sources).collect()}
    assert got == {1: None, 2: "location", 3: None, 4: "declared", 5: None, 6: "location", 7: None, 8: "copy", 9: None, 10: None, 11: "repeated shapes", 12: None, 13: "declared", 14: "declared", 15: None, 16: "declared"}
    assert hw.label_files(df.limit(0), sources.limit(0)).count() == 0


def test_mined_names(spark):
    rows = [(f"r{i}", f"plugins_ext/{i}/{j}.rs", True) for i in range(8) for j in range(4)] + [(f"r{i}", f"libs/{i}/{j}.rs", j % 2 == 0) for i in range(8) for j in range(4)] + [("one", f"solo/{j}.rs", True) for j in range(40)]
    assert [r["name"] for r in hw.mined_names(spark.createDataFrame(rows, "repo string, path string, foreign boolean")).collect()] == ["plugins_ext"]


def test_names_are_mined_from_attribute_files(spark):
    many = " ".join(f"a{k}" for k in range(120))
    files = [(100 * i, f"r{i}", ".gitattributes", f"stubs_out/** {many} linguist-generated\n*.pb.rs linguist-generated\n*_own.rs -linguist-generated\n") for i in range(6)]
    files += [(100 * i + 10 * k + j, f"r{i}", path.format(j), HAND) for i in range(6) for k, path in enumerate(("stubs_out/{}.rs", "src/m{}.pb.rs", "src/m{}_own.rs"), 1) for j in range(4)]
    files += [(900, "plain", "a/stubs_out/z.rs", HAND), (901, "plain", "src/q.pb.rs", HAND), (902, "plain", "src/q_own.rs", HAND), (903, "plain", "src/q.rs", HAND)]
    df = spark.createDataFrame([(*f, "clash", 1) for f in files], FILES)
    got = {r["file_id"]: r["reason"] for r in hw.label_files(df, spark.createDataFrame([], SOURCES)).where("file_id >= 900 or file_id = 10").collect()}
    assert got == {10: "declared", 900: "location", 901: "location", 902: None, 903: None}


GLOBS = [
    ("*.rs", "a/b.rs", True), ("/*.rs", "a/b.rs", False), ("a/*.rs", "a/b.rs", True), ("a/*.rs", "a/b/c.rs", False), ("a/**", "a/b/c.rs", True), ("**/x/*.h", "a/x/b.h", True), ("**/x/*.h", "x/b.h", True), ("a?.rs", "ab.rs", True), ("a.rs", "axrs", False), ("a/**/z.rs", "a/z.rs", True), ("a/**/z.rs", "a/b/c/z.rs", True),
    ("vendor/**", "vendor_notes.rs", False), ("gen/**", "generator/x.rs", False), ("*.[ch]", "a.c", True), ("*.[ch]", "a.d", False), ("*.[!ch]", "a.d", True), ("*.[a-c]", "x/a.b", True), ("a\\*.rs", "a*.rs", True), ("a\\*.rs", "ab.rs", False), ("a/", "a/b.rs", False), ("!a.rs", "a.rs", False), ("a+b(1).rs", "a+b(1).rs", True), ("[]]x", "]x", True), ("a**b.rs", "axyb.rs", True), ("", "a", False),
]


@pytest.mark.parametrize("glob, path, hit", GLOBS)
def test_globs(glob, path, hit):
    pattern = hw.glob_regex(glob)
    assert bool(pattern is not None and re.fullmatch(pattern, path)) is hit


def test_marks_of_attribute_files(spark):
    hand = "fn f() {}\n"  # too short to be a copy
    root = 'vendor/** linguist-vendored\ngen/** linguist-generated\n"with space/*.rs" linguist-generated=true\n*.[ch] linguist-vendored\nlib/*.c !linguist-vendored\nsrc/own.rs -linguist-vendored\nsrc/not_made.rs linguist-generated=False\n[attr]x linguist-vendored\n'
    made = "// Code generated by x from y.idl. DO NOT EDIT.\n" + hand
    files = [
        (1, "r", "vendor/a.rs", hand), (2, "r", "vendor_notes.rs", hand), (3, "r", "gen/x.rs", hand), (4, "r", "generator/x.rs", hand), (5, "r", "with space/a.rs", hand), (6, "r", "x/a.c", hand), (7, "r", "lib/a.c", hand), (8, "r", "src/own.rs", made), (9, "r", "src/not_made.rs", made),
        (10, "r", "vendor/deep/er/a.rs", hand), (11, "r", "vendor/deep/own/a.rs", hand), (12, "s", "gen/x.rs", hand), (13, "r", "./vendor//b.rs", hand), (90, "r", ".gitattributes", root), (91, "r", "vendor/deep/.gitattributes", "own/* -linguist-vendored\n"), (92, None, ".gitattributes", "* linguist-vendored\n"), (93, "t", ".gitattributes", None),
    ]
    df = spark.createDataFrame([(*f, "clash", 1) for f in files], FILES)
    got = {r["file_id"]: r["reason"] for r in hw.label_files(df, spark.createDataFrame([], SOURCES)).where("file_id < 90").collect()}
    declared = {1, 3, 5, 6, 10, 13}
    assert got == {i: "declared" if i in declared else "generated notice" if i == 8 else None for i in range(1, 14)}


def test_copies_of_foreign_files(spark):
    body = "".join(f"pub fn step_{w}(cart: &Cart) -> usize {{\n    let {w} = cart.{w}_total({n});\n    {w} + {n} * {n % 7}\n}}\n\n" for n, w in enumerate("alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()))
    files = [(1, "a/x", "libs/y/a.rs", body), (2, "b/z", "src/b.rs", body.replace("alpha", "omega")), (3, "c/team", "src/c.rs", "// Part of c, written by the team team.\n" + body), (4, "d/d", "src/d.rs", HAND), (5, "b/z", "src/e.rs", body)]
    df = spark.createDataFrame([(*f, "clash", 1) for f in files], FILES)
    sources = spark.createDataFrame([("a/x", 0, "rust", "libs/y", True, None)], SOURCES)
    got = {r["file_id"]: r["reason"] for r in hw.label_files(df, sources).collect()}
    assert got == {1: "declared", 2: "copy", 3: None, 4: None, 5: "copy"}
