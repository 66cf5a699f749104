import random

import pytest

from tesselar.operators.codeparse import parse
from tesselar.operators.rustitems import items, tokens


def kinds(text):
    return [(x.kind, x.name, x.visibility) for x in items(text)]


CASES = [
    ("pub fn a() {}\nfn b() {}", [("function", "a", "pub"), ("function", "b", "")]),
    ("mod m { pub mod n { pub(crate) struct S<T: Fn(u8) -> Vec<Vec<u8>>>(T); } pub enum E { A { x: u8 }, B } }", [("struct", "S", "pub(crate)"), ("enum", "E", "pub")]),
    ("impl<const N: usize> Foo<{ N + 1 }> for Bar<'a, [u8; { 2 }]> where Self: Sized { pub const fn get(&self) -> [u8; { N }] { const IN: u8 = 1; [0; N] } }", [("impl", "", ""), ("function", "get", "pub"), ("const", "IN", "")]),
    ('pub fn r() -> &\'static str { r#"}"# } pub fn s() { let c = \'{\'; let l: &\'a str = "}\\"{"; }', [("function", "r", "pub"), ("function", "s", "pub")]),
    ("/* { /* nested } */ pub fn no() {} */ pub fn yes() { /* } */ }", [("function", "yes", "pub")]),
    ("// pub fn no() {}\n/// pub fn no() {}\npub unsafe extern \"C\" fn e(x: u8) -> u8 { x }", [("function", "e", "pub")]),
    ("trait T { fn declared(&self); fn given(&self) { const A: u8 = b'}'; } const C: u8; }", [("function", "given", ""), ("const", "A", ""), ("const", "C", "")]),
    ("macro_rules! m { () => { pub fn no() {} } } pub fn yes() { vec![{ const NO: u8 = 1; }]; call(|| { const YES: u8 = 2; }) }", [("function", "yes", "pub"), ("const", "YES", "")]),
    ("#[derive(Debug)]\n#[cfg(all(a, b))]\npub struct U;\npub struct W { a: HashMap<u8, Vec<u8>>, }\npub async fn f<T>(t: T) where T: Into<u8> {}", [("struct", "U", "pub"), ("struct", "W", "pub"), ("function", "f", "pub")]),
    ("pub const X: [u8; 2] = [1, { 2 }]; const _: () = (); pub const fn c() {}", [("const", "X", "pub"), ("const", "_", ""), ("function", "c", "pub")]),
    ("} } pub fn after() {} )", [("function", "after", "pub")]),
    ("pub fn open() { if a < b { x } ", [("function", "open", "pub")]),
    ("pub fn broken( { } pub struct Next { a: u8 }", []),
    ("pub fn r#match() {} let union = 1; union U { a: u8 } pub fn z() { struct Inner; }", [("function", "r#match", "pub"), ("union", "U", ""), ("function", "z", "pub"), ("struct", "Inner", "")]),
    ("", []), ("pub", []), ("fn", []), ("impl", []), ("const A", []), ("'", []), ('"open', []), ('r##"open"#', []), ("/* open", []), ("#[", []), ("pub fn f() -> impl Fn(u8) -> Vec<u8> { }", [("function", "f", "pub")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_items(text, want):
    got = kinds(text)
    assert got == want or not want and text.startswith("pub fn broken") and got in ([], [("struct", "Next", "pub")])


def test_parts_of_items():
    text = "    pub fn go<T>(a: T, b: (u8, u8)) -> Result<T, E>\n    where T: X\n    {\n        a\n    }\nimpl<T>  Tr for\n  S<T> { }\npub const K: Map<u8, u8> = f(1, 2);\n"
    a, b, c = items(text)
    assert a.head == "(a: T, b: (u8, u8)) -> Result<T, E>" and text[a.start : a.end].endswith("}") and b.head == "<T>  Tr for\n  S<T>" and (c.head, c.value) == ("Map<u8, u8>", "f(1, 2)")
    rows = parse(text, "rust_tree")
    assert [(r.kind, r.name, r.signature, r.line_number) for r in rows] == [("function", "go", "fn go(a: T, b: (u8, u8)) -> Result<T, E>", 1), ("impl", "Tr for S<T>", "impl <T> Tr for S<T>", 6), ("const", "K", "", 8)]
    assert rows[0].body == text[: a.end] and rows[0].visibility == "pub"


def made(r, depth):
    """A random source of items, and what should be found."""
    out, want = [], []
    for _ in range(r.randrange(1, 4)):
        n, kind = r.randrange(1000), r.choice(["fn", "struct", "enum", "const", "impl", "mod", "noise"])
        pub = r.choice(["pub ", "", "pub(crate) "])
        noise = r.choice(['let s = "}";', 'let r = r#"{"#;', "// }\n", "/* { /* } */ */", "let c = '}';", "m!{ fn no() {} }", ""])
        inner, found = made(r, depth - 1) if depth and kind in ("fn", "impl", "mod") else ("", [])
        if kind == "fn":
            out.append(f"{pub}fn f{n}<T: A<B>>(x: [u8; {{ 2 }}]) -> u8 {{ {noise} {inner} x < y }}")
            want += [("function", f"f{n}"), *found]
        elif kind in ("impl", "mod"):
            out.append(f"impl<'a> S{n}<'a> {{ {inner} }}" if kind == "impl" else f"{pub}mod m{n} {{ {inner} }}")
            want += [*([("impl", "")] if kind == "impl" else []), *found]
        elif kind == "noise":
            out.append(r.choice(["use a::{b, c};", "static S: u8 = 1;", "type A = B<C>;", "#[x] ", "/* fn no() {} */"]))
        else:
            out.append({"struct": f"{pub}struct S{n} {{ a: u8 }}", "enum": f"{pub}enum S{n} {{ A(u8), B }}", "const": f"{pub}const S{n}: u8 = {{ {n} }};"}[kind])
            want.append((kind, f"S{n}"))
    return "\n".join(out), want


def test_random_sources():
    for seed in range(400):
        text, want = made(random.Random(seed), 4)
        assert [(x.kind, x.name) for x in items(text)] == want, text
        for cut in (len(text) // 3, len(text) // 2):
            items(text[:cut])
            items(text[cut:])


def test_deep_and_long_sources():
    assert len(items("mod m { " * 4000 + "pub fn f() {}" + "}" * 4000)) == 1 and len(items("pub fn f() {}\n" * 5000)) == 5000
    assert tokens("a/*b*/c") == [("a", 0, 1), ("c", 6, 7)]
