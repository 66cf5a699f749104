import hashlib
import random
import re
import zlib

import pytest

from tesselar.llm import prefixes
from tesselar.llm.common import Workspace

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, seq int, words string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[x] for x in below)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in nodes.items())


def rows(seed, n, turns=6, vocabulary=3):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(-n, 3 * n), n):
        for t in range(r.randrange(turns)):
            out.append((c, t, ("user", "assistant")[t % 2], " ".join(["w"] * r.randrange(vocabulary)), "x", 1, "y"))
    return out


AWKWARD = [
    (0, 0, "user", "hello there", "", 1, ""), (0, 1, "assistant", "hi", "", 1, ""), (1, None, None, None, "", 1, ""), (1, 0, "user", "hello there", "", 1, ""), (1, 0, "user", "a tie", "", 1, ""), (1, 0, "user", "a tie", "", 1, ""),
    (None, 0, "user", "lost", "", 1, ""), (None, None, None, None, None, None, None), (2, 0, "", "", "", 1, ""), (3, 0, None, "", "", 1, ""), (4, 0, "user", "x " * 30_000, "", 1, ""), (24, 7, "user", "x " * 30_000, "", 1, ""),
    (-1, 0, "user", "hello there", "", 1, ""), (-21, 0, "a", "b", "", 1, ""), (-20, 0, "user", "hello there", "", 1, ""), (9223372036854775807, 1, "user", "top", "", 1, ""), (-9223372036854775808, 1, "user", "low", "", 1, ""),
]


def run(spark, data, fan=2, parts=1):
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    ws = Workspace(spark, "t")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = prefixes.trie(prefixes.rebuilt(prefixes.sequences(frame, ws)), ws, fan)
        return sorted(map(tuple, got.collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("parts", "fan"), [(1, 64), (7, 64), (9, 2), (13, 3)])
def test_nodes_equal_brute_force(spark, parts, fan):
    data = rows(parts, 150) + AWKWARD
    assert run(spark, data, fan, parts) == brute(data)


@pytest.mark.parametrize("waiting", [1, 10_000])
def test_copies_and_deep_conversations_over_many_blocks(spark, monkeypatch, waiting):
    monkeypatch.setattr(prefixes, "WAITING", waiting)
    monkeypatch.setattr(prefixes, "IDS", 5)
    deep = [("user", f"turn {t}") for t in range(300)]
    data = [(c, t, role, text, "", 1, "") for c in range(100, 160) for t, (role, text) in enumerate(deep[:6])]
    data += [(c, t, role, text, "", 1, "") for c in range(200, 206) for t, (role, text) in enumerate(deep[: 40 * (c - 199)])]
    data += [(c, t, "user", "one first turn" if t == 0 else f"{c} {t}", "", 1, "") for c in range(300, 340) for t in range(4)]
    assert run(spark, data, 2, 8) == brute(data)


def test_sweeps_of_all_cuts():
    """Every way to cut sorted sequences into two blocks gives the tree of the whole."""
    letters = {x: digest("u", x) for x in "abc"}
    words = sorted(b"".join(letters[x] for x in w) for w in ("", "", "a", "a", "ab", "abc", "abca", "abcb", "abcb", "b", "bca", "bcab", "bcb", "c"))
    counts = {w: (1).to_bytes(4, "little") * (len(w) // 16) for w in words}
    def tree(parts):
        top, rows, last, c = prefixes.Sweep(True, True), [], (b"", b""), 0
        for part in parts:
            one, prev, first = prefixes.Sweep(False, False), None, None
            for w in part:
                node = prefixes.Node(len(w) // 16, 1, c, ids=[c])
                one.step(prefixes.common(prev, w) if prev is not None else 0, node, prev or b"", counts[prev or b""])
                prev, first, c = w, w if first is None else first, c + 1
            spine = one.summary(prev)
            lcp, path = prefixes.common(last[0], first), last
            for i, x in enumerate(spine):
                if i:
                    lcp, path = min(spine[i - 1]["depth"], x["depth"]), (first, counts[first])
                top.step(lcp, prefixes.Node(**x), *path)
            last = (prev, counts[prev])
            rows += one.rows
        top.finish(*last)
        return sorted((r[0], r[1], *r[4:8]) for r in rows + top.rows)
    whole = tree([words])
    assert len(whole) == len({w[: 16 * d] for w in words for d in range(len(w) // 16 + 1)})
    for i in range(1, len(words)):
        for j in range(i + 1, len(words)):
            assert tree([words[:i], words[i:j], words[j:]]) == whole


def test_empty_table_and_fan(spark):
    assert run(spark, []) == [] == run(spark, AWKWARD[6:8])
    with pytest.raises(ValueError, match="fan"):
        prefixes.trie(spark.createDataFrame([], "conv_id bigint, seq binary, words binary"), Workspace(spark, "t"), 1)


def test_query(spark, tmp_path):
    spark.createDataFrame(AWKWARD, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefixes.op13_conversation_trie(spark, str(tmp_path))
    assert got.dtypes[:2] == [("conv_id", "bigint"), ("depth", "bigint")] and {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect())) == brute(AWKWARD)
