import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselar.operators import constants as C

ORDER = ["phase0", "altair", "deneb"]


@pytest.mark.parametrize(("text", "value", "kind"), [
    ("5", "5", None), ("2**5", "32", None), ("uint64(2**6)", "64", "uint64"), ("Gwei(2**0 * 10**9)", "1000000000", "Gwei"), ("-2**2", "-4", None), ("2**-0", "1", None), ("2**3**2", "512", None),
    ("(1 + 2) * 3 - 4 // 3 % 5", "8", None), ("0xFF | 1 << 8 ^ 3 & 1", str(0xFF | 1 << 8 ^ 3 & 1), None), ("Bytes4('0x01000000')", "0x01000000", "Bytes4"), ("6 / 3", "2", None), ("A * 2 + B", "23", None), ("1_000", "1000", None), ("~0", "-1", None), ("(-1)**99999999999", "-1", None), ("uint64(1) + 1", "2", "uint64"), ("''", "0x", None), ("0 ** 0", "1", None),
])
def test_values(text, value, kind):
    got = C.evaluate(text, {"A": 10, "B": 3})
    assert got["value"] == value and got["error"] is None and (got["type"] == kind or "+" in text)


@pytest.mark.parametrize(("text", "error"), [("", "empty"), ("1 +", "ends early"), ("(1", "no closing"), ("1 2", "unexpected"), ("5 / 2", "whole"), ("1 // 0", "zero"), ("2**99999", "too large"), ("1 << 99999", "too large"), ("X", "unknown X"), ("'ab' + 1", "of bytes"), ("'xyz'", "hexadecimal"), ("2 ** -1", "negative"), ("a $ b", r"unexpected \$"), ("(" * 5000 + "1" + ")" * 5000, "too deep"), ("-'00'", "of bytes")])
def test_errors(text, error):
    import re

    assert re.search(error, C.evaluate(text, {})["error"])


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.integers(0, 50).map(str), lambda x: st.tuples(x, st.sampled_from(["+", "-", "*", "//", "%", "|", "&", "^", "<<", ">>", "**"]), x).map(lambda t: f"({t[0]}) {t[1]} {t[2]}"), max_leaves=6))
def test_expressions_equal_pythons(text):
    got = C.evaluate(text, {})
    if got["error"] is None:
        assert got["value"] == str(eval(text))
    else:
        assert got["error"] in ("division by zero", "too large") or "negative" in got["error"]


def test_references():
    assert C.references("uint64(A * B + A)") == ["A", "B"] and C.references("Bytes4('0x00')") == [] and C.references("$") == []


def test_graph_over_forks(spark):
    rows = [
        ("phase0", "BASE", "uint64(2**5)"), ("phase0", "DOUBLE", "BASE * 2"), ("phase0", "LATER", "NEWER + 1"), ("phase0", "A", "B"), ("phase0", "B", "A + 1"), ("phase0", "C", "B * 2"), ("phase0", "SELF", "SELF"),
        ("altair", "BASE", "100"), ("altair", "NEWER", "BASE + DOUBLE"), ("altair", "BROKEN", "1 +"), ("altair", "NEEDS", "BROKEN + BASE"), ("altair", "NEEDS_TOO", "NEEDS"),
        ("deneb", "DEEP", "NEWER * DOUBLE"), ("deneb", "DOUBLE", "BASE * 3"), ("other", "OWN", "7"), ("other", "SUM", "OWN + BASE"), ("other", "FINE", "OWN * OWN"), ("deneb", "MARK", "DomainType('0x01')"), ("deneb", "COPY", "MARK"), ("deneb", "NULL", None),
    ]
    got = {(r.fork, r["name"]): (r.value, r.error) for r in C.values_of(spark.createDataFrame(rows, "fork string, name string, value string").repartition(3), ORDER).collect()}
    assert got == {
        ("phase0", "BASE"): ("32", None), ("phase0", "DOUBLE"): ("64", None), ("phase0", "LATER"): (None, "unknown NEWER"), ("phase0", "A"): (None, "cycle"), ("phase0", "B"): (None, "cycle"), ("phase0", "C"): (None, "cycle"), ("phase0", "SELF"): (None, "cycle"),
        ("altair", "BASE"): ("100", None), ("altair", "NEWER"): ("164", None), ("altair", "BROKEN"): (None, "ends early"), ("altair", "NEEDS"): (None, "needs BROKEN"), ("altair", "NEEDS_TOO"): (None, "needs NEEDS"),
        ("deneb", "DEEP"): ("49200", None), ("deneb", "DOUBLE"): ("300", None), ("other", "OWN"): ("7", None), ("other", "SUM"): (None, "unknown BASE"), ("other", "FINE"): ("49", None), ("deneb", "MARK"): ("0x01", None), ("deneb", "COPY"): ("0x01", None), ("deneb", "NULL"): (None, "empty"),
    }
    assert C.values_of(spark.createDataFrame([], "fork string, name string, value string"), ORDER).count() == 0


def test_from_files(spark):
    text = "# Constants\n\n| Name | Value |\n|-|-|\n| `SLOT` | `uint64(12)` |\n| `EPOCH` | `SLOT * 32` |\n"
    files = spark.createDataFrame([("phase0", "a.md", text), ("deneb", "b.md", "| `DAY` | `EPOCH * 225` |\n"), (None, "c.md", "| `LOST` | `1` |\n"), ("deneb", "d.md", None)], "fork string, path string, content string")
    assert sorted((r.fork, r["name"], r.value) for r in C.constant_values(files, ORDER).collect()) == [("deneb", "DAY", "86400"), ("phase0", "EPOCH", "384"), ("phase0", "SLOT", "12")]
