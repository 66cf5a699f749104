"""Values of constants: expressions of constants tables, evaluated in the order of their references.

An expression may name constants of its fork or, where its fork does not define
them, of the nearest earlier fork that does. References are edges of a graph over
all forks. Rounds of joins find the expressions whose references all have values
and evaluate them, so there are as many rounds as the longest chain; what is left
when nothing more can be evaluated refers to itself.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.lineage import cut
from .specs import constants

#: Bits of the largest number that an expression may make.
BITS = 4096
TOKENS = re.compile(r"\s*(?:(?P<hex>0[xX][0-9a-fA-F_]+)|(?P<number>\d[\d_]*)|(?P<name>[A-Za-z_]\w*)|(?P<text>'[^']*'|\"[^\"]*\")|(?P<sign>\*\*|//|<<|>>|[-+*/%&|^~(),])|(?P<odd>\S))")
#: Binary signs by how loosely they bind, loosest first.
LEVELS = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "//", "%"))
RESULT = T.StructType([T.StructField("value", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("type", T.StringType()), T.StructField("error", T.StringType())])


class ExpressionError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out = [(m.lastgroup, m[m.lastgroup]) for m in TOKENS.finditer(text)]
    if not out:
        raise ExpressionError("empty")
    for kind, token in out:
        if kind == "odd":
            raise ExpressionError(f"unexpected {token}")
    return out


def references(text: str) -> list[str]:
    """Names that an expression needs the values of: all that are not called. Texts that are no expression need none."""
    try:
        found = tokens(text)
    except ExpressionError:
        return []
    return sorted({t for i, (kind, t) in enumerate(found) if kind == "name" and found[i + 1 : i + 2] != [("sign", "(")]})


def _sized(value: int) -> int:
    if value.bit_length() > BITS:
        raise ExpressionError("too large")
    return value


class Expression:
    """A recursive-descent reading of one expression; ``**`` binds to the right and closer than a sign before it."""

    def __init__(self, text: str, known: Mapping[str, int | bytes]):
        self.left, self.known, self.type = tokens(text)[::-1], known, None

    def take(self, *signs: str) -> str | None:
        if self.left and self.left[-1][0] == "sign" and self.left[-1][1] in signs:
            return self.left.pop()[1]
        return None

    def value(self) -> int | bytes:
        called = self.left[-1][0] == "name" and len(self.left) > 1 and self.left[-2] == ("sign", "(")
        name = self.left[-1][1]
        out = self.binary(0)
        if self.left:
            raise ExpressionError(f"unexpected {self.left[-1][1]}")
        self.type = name if called else None
        return out

    def binary(self, level: int) -> int | bytes:
        if level == len(LEVELS):
            return self.unary()
        a = self.binary(level + 1)
        while sign := self.take(*LEVELS[level]):
            a = self.apply(sign, a, self.binary(level + 1))
        return a

    def unary(self) -> int | bytes:
        if sign := self.take("-", "+", "~"):
            a = self.unary()
            if isinstance(a, bytes):
                raise ExpressionError(f"{sign} of bytes")
            return -a if sign == "-" else a if sign == "+" else ~a
        a = self.atom()
        return self.apply("**", a, self.unary()) if self.take("**") else a

    @staticmethod
    def apply(sign: str, a: int | bytes, b: int | bytes) -> int:
        if isinstance(a, bytes) or isinstance(b, bytes):
            raise ExpressionError(f"{sign} of bytes")
        if sign in ("/", "//", "%"):
            if b == 0:
                raise ExpressionError("division by zero")
            if sign == "/" and a % b:
                raise ExpressionError("not a whole number")
            return a % b if sign == "%" else a // b
        if sign in ("**", "<<", ">>"):
            if b < 0:
                raise ExpressionError(f"{sign} by a negative number")
            if sign == "**" and abs(a) > 1 and b * (abs(a).bit_length() - 1) > BITS or sign == "<<" and a and b > BITS:
                raise ExpressionError("too large")
            return _sized(a**b if abs(a) > 1 or b < 2 else a ** (2 - b % 2)) if sign == "**" else _sized(a << b) if sign == "<<" else a >> min(b, 2 * BITS)
        return _sized({"+": a + b, "-": a - b, "*": a * b}[sign] if sign in "+-*" else {"|": a | b, "^": a ^ b, "&": a & b}[sign])

    def atom(self) -> int | bytes:
        if self.take("("):
            return self.closed()
        if not self.left:
            raise ExpressionError("ends early")
        kind, token = self.left.pop()
        if kind == "number":
            return _sized(int(token.replace("_", "")))
        if kind == "hex":
            return _sized(int(token.replace("_", ""), 16))
        if kind == "text":
            digits = token[1:-1].removeprefix("0x")
            if len(digits) % 2 or re.search(r"[^0-9a-fA-F]", digits):
                raise ExpressionError(f"{token} is no hexadecimal text")
            return bytes.fromhex(digits)
        if kind == "name":
            if self.take("("):  # a type's name says what its value is
                return self.closed()
            if token in self.known:
                return self.known[token]
            raise ExpressionError(f"unknown {token}")
        raise ExpressionError(f"unexpected {token}")

    def closed(self) -> int | bytes:
        out = self.binary(0)
        if not self.take(")"):
            raise ExpressionError("no closing bracket")
        return out


def evaluate(text: str, known: Mapping[str, int | bytes]) -> dict[str, str | None]:
    """Value (decimal, or 0x and digits), kind ('int' or 'bytes') and type of an expression, or its error."""
    try:
        e = Expression(text, known)
        value = e.value()
    except ExpressionError as error:
        return {"value": None, "kind": None, "type": None, "error": str(error)}
    except RecursionError:
        return {"value": None, "kind": None, "type": None, "error": "too deep"}
    return {"value": f"0x{value.hex()}" if isinstance(value, bytes) else str(value), "kind": "bytes" if isinstance(value, bytes) else "int", "type": e.type, "error": None}


def _references(text: Column) -> Column:
    return F.arrow_udf(lambda texts: pa.array([references(t or "") for t in texts.to_pylist()], pa.list_(pa.string())), T.ArrayType(T.StringType()))(text)


def _evaluated(text: Column, names: Column, values: Column) -> Column:
    def run(texts: pa.Array, names: pa.Array, values: pa.Array) -> pa.Array:
        read = lambda v: bytes.fromhex(v[2:]) if v.startswith("0x") else int(v)
        out = [evaluate(t or "", {n: read(v) for n, v in zip(ns or [], vs or [], strict=True)}) for t, ns, vs in zip(texts.to_pylist(), names.to_pylist(), values.to_pylist(), strict=True)]
        return pa.array(out, pa.struct([(f.name, pa.string()) for f in RESULT.fields]))

    return F.arrow_udf(run, RESULT)(text, names, values)


def resolved(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """(fork, name, ref, at): each reference of constants (fork, name, value) with the fork that defines it, null if none does.

    ``order`` lists forks from the earliest on; a fork that is not in it sees its own constants only.
    """
    spark = table.sparkSession
    forks = F.broadcast(spark.createDataFrame([(f, i) for i, f in enumerate(order)], "fork string, ordinal int"))
    placed = table.join(forks, "fork", "left")
    edges = placed.select("fork", "ordinal", "name", F.explode(_references(F.col("value"))).alias("ref"))
    defined = placed.select(F.col("fork").alias("at"), F.col("ordinal").alias("_o"), F.col("name").alias("ref"))
    sees = (F.col("at") == F.col("fork")) | (F.col("_o") < F.col("ordinal"))
    found = edges.join(defined, "ref").where(sees)  # a name has at most one definition a fork
    nearest = Window.partitionBy("fork", "name", "ref").orderBy((F.col("at") == F.col("fork")).desc(), F.desc("_o"))
    found = found.withColumn("_n", F.row_number().over(nearest)).where("_n = 1").select("fork", "name", "ref", "at")
    return edges.select("fork", "name", "ref").join(found, ["fork", "name", "ref"], "left")


def values_of(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """(fork, name, expression, value, kind, type, error) of constants (fork, name, value), each (fork, name) once.

    An error says why there is no value: a syntax error, an unknown name, a
    reference without a value (``needs``) or one that comes back to itself (``cycle``).
    """
    keys = ["fork", "name"]
    edges = cut(resolved(table, order))
    needs = edges.groupBy(keys).agg(F.count("*").alias("needs"), F.array_sort(F.collect_set(F.when(F.col("at").isNull(), F.col("ref")))).alias("unknown"))
    rows = table.select("fork", "name", F.col("value").alias("expression")).join(needs, keys, "left")
    lost = F.size(F.coalesce("unknown", F.array().cast("array<string>"))) > 0
    nothing = [F.lit(None).cast("string").alias(c) for c in ("value", "kind", "type")]
    names = [*keys, "expression", "value", "kind", "type", "error"]
    left = cut(rows.where(~lost).select(*keys, "expression", F.coalesce("needs", F.lit(0)).alias("needs")))
    done = cut(rows.where(lost).select(*keys, "expression", *nothing, F.concat(F.lit("unknown "), F.array_join("unknown", ", ")).alias("error")))
    while True:
        have = done.select(F.col("fork").alias("at"), F.col("name").alias("ref"), F.col("value").alias("_v"))
        ready = edges.join(left.select(keys), keys, "left_semi").join(have, ["at", "ref"]).groupBy(keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_v").isNull(), F.col("ref")))).alias("bad"), F.map_from_entries(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("ref", "_v")))).alias("known"))
        now = left.join(ready, keys, "left")
        bad = F.size(F.coalesce("bad", F.array().cast("array<string>"))) > 0
        full = F.coalesce("n", F.lit(0)) == F.col("needs")
        known = F.coalesce("known", F.create_map().cast("map<string,string>"))
        failed = now.where(bad).select(*keys, "expression", *nothing, F.concat(F.lit("needs "), F.array_join("bad", ", ")).alias("error"))
        made = now.where(~bad & full).withColumn("r", _evaluated(F.col("expression"), F.map_keys(known), F.map_values(known))).select(*keys, "expression", "r.value", "r.kind", "r.type", "r.error")
        new = cut(failed.unionByName(made))
        if not new.limit(1).count():
            break
        done = done.unionByName(new)
        left = cut(left.join(new.select(keys), keys, "left_anti"))
    return done.select(names).unionByName(left.select(*keys, "expression", *nothing, F.lit("cycle").alias("error")))


def constant_values(files: DataFrame, order: Sequence[str]) -> DataFrame:
    """The values of all constants of spec files (fork, path, content)."""
    return values_of(constants(files).where("fork is not null"), order)
