"""Request rules, for one request on the driver and for columns of requests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import FORK_NAMES
from .search import PQ_REPOS

# Limits of requests.
QUERY_MOST, LIMIT_LEAST, LIMIT_MOST, LIMIT_DEFAULT, NAME_MOST, TOPIC_MOST, CLIENT_MOST, EIP_MOST = 1000, 1, 50, 5, 100, 50, 50, 10
CONSTANT, FUNCTION, NUMBER = r"[A-Z][A-Z0-9_]*", r"[a-z_][a-z0-9_]*", r"\d+"
LAYERS = ("execution", "consensus")


class RequestError(ValueError):
    pass


def _length(name: str, value: str, most: int) -> str:
    if not 1 <= len(value) <= most:
        raise RequestError(f"{name} must have 1 to {most} characters")
    return value


def query(value: str) -> str:
    return _length("query", value, QUERY_MOST)


def limit(value: int = LIMIT_DEFAULT) -> int:
    if not LIMIT_LEAST <= value <= LIMIT_MOST:
        raise RequestError(f"limit must be {LIMIT_LEAST} to {LIMIT_MOST}")
    return value


def fork(value: str | None) -> str | None:
    if value is not None and value.lower() not in FORK_NAMES:
        raise RequestError(f"no fork is named {value!r}; there are {', '.join(FORK_NAMES)}")
    return value.lower() if value else None


def _pattern(name: str, value: str, pattern: str, most: int) -> str:
    if not re.fullmatch(pattern, _length(name, value, most)):
        raise RequestError(f"{name} must match {pattern}")
    return value


def constant(value: str) -> str:
    return _pattern("constant_name", value, CONSTANT, NAME_MOST)


def function(value: str) -> str:
    return _pattern("function_name", value, FUNCTION, NAME_MOST)


def eip(value: str | None) -> str | None:
    return None if value is None else _pattern("eip_number", value, NUMBER, EIP_MOST)


def topic(value: str) -> str:
    return _length("topic", value, TOPIC_MOST)


def client(value: str) -> str:
    return _length("name", value, CLIENT_MOST).lower().strip()


def layer(value: str | None) -> str | None:
    if value is None:
        return None
    found = value.lower().strip()
    if found not in LAYERS:
        raise RequestError(f"no layer is named {value!r}; there are {', '.join(LAYERS)}")
    return found


def pq_repo(value: str | None) -> str | None:
    if value is not None and value not in PQ_REPOS:
        raise RequestError(f"no repository of this search is named {value!r}; there are {', '.join(PQ_REPOS)}")
    return value


def search_error(text: Column, fork_name: Column, most: Column) -> Column:
    """The first rule a search request breaks (query, fork, limit), or null."""
    return (
        F.when(text.isNull() | ~F.length(text).between(1, QUERY_MOST), "query")
        .when(fork_name.isNotNull() & ~F.lower(fork_name).isin(*FORK_NAMES), "fork")
        .when(~most.between(LIMIT_LEAST, LIMIT_MOST), "limit")
    )


def name_error(value: Column, pattern: str, most: int = NAME_MOST) -> Column:
    return F.when(value.isNull() | ~F.length(value).between(1, most), "length").when(~value.rlike(rf"\A{pattern}\z"), "pattern")
