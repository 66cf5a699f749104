import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselar.operators import chunking as K
from tesselar.operators.codeparse import parse
from tesselar.operators.pycode import python_rows
from tesselar.operators.splitting import by_headers, by_size

SPEC = """# Electra

Intro text.

## Constants

| Name | Value |
| - | - |
| `MAX_A` | `Gwei(2**5)` |
| `MIN_B` | `1` |

## Helpers

### first

```python
# not a header
def first(a: int) -> int:
    return a
```

### second

```python
def second(x):
    return x
```
"""


def test_headers():
    got = list(by_headers(SPEC))
    assert [(s.h1, s.h2, s.h3) for s in got] == [("Electra", None, None), ("Electra", "Constants", None), ("Electra", "Helpers", "first"), ("Electra", "Helpers", "second")]
    assert "# not a header" in got[2].content
    assert list(by_headers("")) == [] and [s.content for s in by_headers("plain\n# only")] == ["plain"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_sizes(text, size, overlap):
    pieces = by_size(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    assert set("".join(pieces).replace(" ", "").replace("\n", "")) == set(text.replace(" ", "").replace("\n", ""))
    at = 0
    squeezed = "".join(text.split())
    for p in pieces:  # in order, nothing lost, neighbours share at most the overlap
        q = "".join(p.split())
        found = max((i for i in range(max(0, at - overlap), at + 1) if squeezed.startswith(q, i)), default=None)
        assert found is not None
        at = max(at, found + len(q))
    assert at == len(squeezed)


def test_size_arguments():
    with pytest.raises(ValueError, match="overlap"):
        by_size("x", 5, 5)


def test_python_rows():
    code = '"""Doc."""\nA: int = 1\nB_C = 2\nlower = 3\n@dec\nclass K(Base, m.N):\n    """K doc."""\n    x: int\n    async def go(self, n: int, *rest) -> str:\n        """Go."""\n        return "x"\nX, Y = 1, 2\n'
    got = python_rows(code, "pkg/mod.py")
    assert [(s, t) for s, t, _, _ in got] == [("mod", "lean_doc"), ("A", "lean_constant"), ("B_C", "lean_constant"), ("K", "lean_class"), ("K.go", "lean_function")]
    assert got[3][2].startswith("class K") and got[3][3]["base_classes"] == "Base,m.N"
    assert got[4][3]["signature"] == "async def go(self, n: int) -> str:" and got[4][3]["is_method"] == "true"
    assert python_rows("def (", "x.py") == [] and python_rows("", "x.py") == []
    big = "class Big:\n" + "\n".join(f"    field_{i}: int = {i}" for i in range(400))
    assert len(python_rows(big, "b.py")[0][2]) <= 3000


RUST = """//! Module.

/// Signs.
/// Twice.
#[inline]
pub fn sign(key: &[u8]) -> u64 {
    if key.len() > 1 { 1 } else { 0 }
}

pub(crate) async fn later() { }
fn private() {}

/// A key.
#[derive(Clone)]
pub struct Key { a: u64 }
pub struct Unit;
struct Hidden { x: u8 }
pub enum Kind { A, B }
pub const SIZE: usize = 32;
const LOW: u8 = 1;

impl Key {
    /// New.
    pub fn new() -> Self { let s = "}"; Key { a: 0 } }
}
"""


def test_rust_rules():
    plain = parse(RUST, "rust_spec")
    assert [(x.kind, x.name) for x in plain] == [("function", "sign"), ("function", "new"), ("struct", "Key"), ("struct", "Unit"), ("enum", "Kind"), ("const", "SIZE")]
    sign = plain[0]
    assert sign.signature == "fn sign(key: &[u8]) -> u64" and sign.doc_comment == "Module.\nSigns.\nTwice." and sign.line_number == 6 and sign.body.startswith("pub fn sign") and sign.body.endswith("{ 0 }\n}") and sign.visibility == "pub"
    assert plain[3].body == "pub struct Unit;"
    client = parse(RUST, "rust")
    assert [(x.kind, x.name) for x in client] == [("function", "sign"), ("function", "later"), ("function", "new"), ("struct", "Key"), ("struct", "Unit"), ("const", "SIZE"), ("const", "LOW")]
    tree = parse(RUST, "rust_tree", aware=True)
    impl = next(x for x in tree if x.kind == "impl")
    assert impl.name == "Key" and impl.body.startswith("impl Key {") and impl.body.endswith("Key { a: 0 } }\n}")
    assert [x.name for x in tree if x.kind == "function"] == ["sign", "later", "new"] and next(x for x in tree if x.name == "sign").attributes == ["#[inline]"]


def test_aware_matching_differs():
    code = 'pub fn f() { let s = "}"; g() }\npub fn h() {}\n'
    assert parse(code, "rust")[0].body == 'pub fn f() { let s = "}' and parse(code, "rust", aware=True)[0].body == 'pub fn f() { let s = "}"; g() }'
    assert parse("pub fn f() { never closed", "rust")[0].body == "pub fn f() { never closed"
    assert parse("", "rust") == parse("", "go") == parse("", "java") == []


def test_go_and_java():
    go = parse("package x\n\n// Run runs.\nfunc (s *S) Run(a int) error {\n\treturn nil\n}\nfunc small() {}\ntype T struct {\n\tA int\n}\ntype I interface { F() }\nconst Max = 5\nconst (\n\tOne = 1 // c\n\tTyped int = 2\n\tlow = 3\n)\n", "go")
    assert [(x.kind, x.name, x.value) for x in go] == [("function", "Run", None), ("struct", "T", None), ("interface", "I", None), ("const", "Max", "5"), ("const", "One", "1 // c")]
    assert go[0].signature == "func Run(a int) error" and go[0].doc_comment == "Run runs."
    java = parse("/**\n * A class.\n */\npublic class A {\n  public static final int MAX = 3;\n  /** One line. */\n  public static <T> List<T> get(int a) {\n    return null;\n  }\n}\n", "java")
    assert [(x.kind, x.name) for x in java] == [("function", "get"), ("struct", "A"), ("const", "MAX")]
    assert java[0].signature == "public List<T> get(int a)" and java[1].body == "" and java[1].doc_comment == "A class." and java[2].type_annotation == "int"


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, file_type string, repo string, content string")


def test_chunk_files(spark):
    r = random.Random(0)
    long = "# Long\n\n" + " ".join("".join(r.choice("abc") for _ in range(6)) for _ in range(600))
    rows = [("specs/electra/beacon-chain.md", "spec", "consensus-specs", SPEC), ("EIPS/eip-4844.md", "eip", "EIPs", "---\neip: 4844\ntitle: Blobs\n---\n# A\n\ntext\n## B\nmore"), ("specs/b.md", "builder", "builder-specs", "# B\n\nPOST `/x`\n"), ("notes.md", "pm", "pm", "# N\n\nagenda"), ("src/lib.rs", "rust:leanSig", "leanSig", RUST), ("src/lib.rs", "rust:leanMultisig", "leanMultisig", RUST), ("m.py", "lean", "leanSpec", "MAX = 1\n"), ("bad.py", "lean", "leanSpec", "def ("), ("x.bin", "other", "r", "x"), ("specs/long.md", "spec", "consensus-specs", long), ("specs/none.md", "spec", "consensus-specs", "")]
    got = K.chunk_files(files(spark, rows)).collect()
    by = lambda s: sorted((x for x in got if x.source == s), key=lambda x: x.ordinal)
    spec = by("specs/electra/beacon-chain.md")
    assert [x.chunk_type for x in spec] == ["spec", "constant", "function", "function", "function"] and spec[-1].section == "second" and spec[-1].metadata["function_name"] == "second" and spec[0].fork == "electra"
    assert [int(x.chunk_id.rsplit("_", 2)[1]) for x in spec] == list(range(5))
    eip = by("EIPS/eip-4844.md")
    assert eip[0].metadata["title"] == "Blobs" and eip[0].metadata["status"] is None and {x.chunk_type for x in eip} == {"eip"}
    pieces = by("specs/long.md")
    assert len(pieces) > 3 and [x.metadata["sub_chunk"] for x in pieces] == [str(i) for i in range(len(pieces))] and all(len(x.content) <= 1000 for x in pieces)
    assert not by("x.bin") and not by("bad.py") and not by("specs/none.md") and by("notes.md")[0].chunk_type == "pm"
    assert len({x.chunk_id for x in got}) == len(got)
    assert {x.chunk_type for x in by("src/lib.rs")} == {"rust_function", "rust_struct", "rust_enum", "rust_impl", "rust_const"}
    records = K.to_records(spark.createDataFrame(got, K.chunk_files(files(spark, rows)).schema)).collect()
    assert all(x.fork is not None and x.section is not None for x in records) and next(x for x in records if x.chunk_id == spec[0].chunk_id).h2 is None


def test_a_section_leaves_python_once_and_in_small_batches(spark, monkeypatch):
    """A long section is not repeated for each of its pieces, and no batch holds a partition."""
    import pyarrow as pa

    from tesselar.functions.lineage import BATCH_BYTES

    files = spark.createDataFrame([("a.md", "r", "x")], "path string, repo string, content string")
    held, real = [], type(files).mapInArrow
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, *a, **k: held.append(f) or real(self, f, *a, **k))
    rows = K.spec_chunks(files)
    text = "# A\n" + "word and more words\n" * 20_000
    made = list(held[0](iter([pa.RecordBatch.from_pydict({"path": ["a.md"] * 20, "repo": ["r"] * 20, "content": [text] * 20})])))
    assert sum(len(p) for b in made for p in b.column("pieces").to_pylist()) > 20 * 400
    assert sum(b.nbytes for b in made) < 4 * 20 * len(text) and max(b.nbytes for b in made) < 3 * K.OUT + 4 * len(text)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    assert [r.chunk_type for r in rows.collect()] == ["spec"]
