import hashlib

import pytest
from pyspark.sql import functions as F

from tesselar.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_chunk_id(spark):
    got = one(spark, X.chunk_id(F.lit("p"), F.lit("spec"), F.col("f"), F.lit(7), F.col("c")), f="a/b.md", c="héllo")
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:8]
    assert got == f"p_spec_{h('a/b.md')}_0007_{h('héllo')}"
    assert one(spark, X.chunk_id(F.lit("p"), F.lit("x"), F.lit("f"), F.lit(12345), F.lit("c"))).split("_")[3] == "12345"


@pytest.mark.parametrize(("path", "rule"), [("a/../b", "traversal"), ("..", "traversal"), ("/etc", "absolute"), ("C:\\x", "drive"), ("C:x", "drive"), ("a\0b", "nul"), ("a\nb", "control"), ("a\rb", "control"), ("a\tb", "control"), ("a/b.md", None), ("ünï/cöde.md", None)])
def test_path_rules(spark, path, rule):
    from tesselar.plans.manifest import bad_path

    assert one(spark, X.path_error(F.col("p")), p=path) == rule == bad_path(path)


@pytest.mark.parametrize(("value", "ok"), [("abc_-9", True), ("a" * 200, True), ("a" * 201, False), ("a;b", False), ("a\n", False), ("", False), ('"x"', False)])
def test_chunk_id_rule(spark, value, ok):
    assert one(spark, X.is_chunk_id(F.col("v")), v=value) is ok


def test_checked_ids_raise(spark):
    with pytest.raises(Exception, match="bad path"):
        one(spark, X.checked_chunk_id(F.lit("p"), F.lit("t"), F.col("f"), F.lit(1), F.lit("c")), f="../x")


@pytest.mark.parametrize(("path", "fork"), [("specs/electra/x.md", "electra"), ("specs/ELECTRA/x.md", "electra"), ("specs/gloas/x.md", "gloas"), ("specs/electra.md", None), ("a/deneb/capella/x", "deneb")])
def test_fork_of_path(spark, path, fork):
    assert one(spark, X.fork_of_path(F.col("p")), p=path) == fork


@pytest.mark.parametrize(("text", "spec", "builder"), [("x\ndef f(a):", "function", "builder_spec"), ("| `MAX` | 1 |", "constant", "builder_spec"), ("| M | 1 |", "spec", "builder_spec"), ("class A(Container)", "type", "builder_type"), ("POST `/eth/v1`", "spec", "builder_api"), ("```python\nclass B:", "type", "builder_type"), ("prose", "spec", "builder_spec")])
def test_types(spark, text, spec, builder):
    assert one(spark, X.spec_chunk_type(F.col("t")), t=text) == spec
    assert one(spark, X.builder_chunk_type(F.col("t")), t=text) == builder


@pytest.mark.parametrize(("text", "want"), [("---\neip: 1\ntitle: a: b\n---\nx", {"eip": "1", "title": "a: b"}), ("no matter", {}), ("---\na: 1\na: 2\nnone\n---", {"a": "2"}), ("x\n---\na: 1\n---", {}), ("---\n---\n", {})])
def test_frontmatter(spark, text, want):
    assert one(spark, X.frontmatter(F.col("t")), t=text) == want


def test_small_rules(spark):
    assert one(spark, X.eip_number(F.col("f")), f="eip-4844.md") == "4844" and one(spark, X.eip_number(F.col("f")), f="x.md") == "unknown"
    assert one(spark, X.section(F.lit("a"), F.lit(""))) == "a" and one(spark, X.section(F.lit(None), F.lit(None))) == "unknown" and one(spark, X.section(F.lit("a"), F.lit("b"))) == "b"
    assert [one(spark, X.is_constant_name(F.col("n")), n=n) for n in ("MAX_1", "Max", "_1", "A")] == [True, False, False, True]
    assert one(spark, X.relative_path(F.col("p"), "/data/x"), p="/data/x/a/b") == "a/b" and one(spark, X.relative_path(F.col("p"), "/data/x"), p="/other") == "/other"
    assert one(spark, X.shown_share(F.lit(0.0), F.lit(33.0))) == 33.0 and one(spark, X.shown_share(F.lit(55.0), F.lit(None).cast("double"))) == 55.0
    assert one(spark, X.cut_class(F.col("t")), t="x" * 3001).endswith("(truncated)") and len(one(spark, X.cut_class(F.col("t")), t="x" * 9000)) <= 3000
    assert one(spark, X.client_constant_content(F.lit(None).cast("string"), F.lit("N"), F.lit(None).cast("string"), F.lit("1"))) == "const N = 1"
    assert one(spark, X.rust_item_content(F.lit("d"), F.array(F.lit("#[a]")), F.lit("fn f() {}"))) == "/// d\n#[a]\nfn f() {}"
    assert one(spark, X.score(F.lit(0.25))) == 0.75
