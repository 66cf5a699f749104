import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselar.operators import longfiles as L
from tesselar.operators.splitting import by_headers, by_size
from tesselar.sources import tree as T


def plain(text, size, overlap):
    out = []
    for s in by_headers(text):
        if len(s.content) > L.SPLIT_ABOVE:
            out += [(*s[:3], i, piece) for i, piece in enumerate(by_size(s.content, size, overlap))]
        else:
            out.append((*s[:3], None, s.content))
    return out


TEXT = st.text("ab \n", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 40), st.integers(0, 39), st.lists(st.integers(0, 400), max_size=8))
def test_a_text_in_bits_is_cut_like_the_whole(text, size, overlap, cuts):
    overlap = min(overlap, size - 1)
    found, at = [], [0, *sorted(cuts), len(text)]
    cutter = L.Cutter(size, overlap)
    cutter.parts = L._Parts(size, 0, cutter._atom)  # as for a long text
    for a, b in zip(at, at[1:], strict=False):
        cutter.feed(text[a:b])
        found += cutter.take()
    found += cutter.end()
    assert [c for c, _ in found] == by_size(text.strip(), size, overlap) and [n for _, n in found] == list(range(len(found)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b", "### c", "```", "~~~", "text", "", "é 日本", "# ", "####"]), max_size=30), st.integers(1, 60))
def test_ranges_have_every_line_once(tmp_path_factory, lines, size):
    file = tmp_path_factory.mktemp("r") / "f"
    file.write_text("\n".join(lines), encoding="utf-8")
    n = file.stat().st_size
    parts = max(1, -(-n // size))
    got = [x for i in range(parts) for x in L.lines_of(str(file), i * size, min((i + 1) * size, n), i == parts - 1)]
    assert got == "\n".join(lines).split("\n")


def sample(r):
    out = []
    for _ in range(r.randrange(1, 60)):
        out.append(r.choice(["# One ü", "## Two", "### Three ##", "```python", "```", "~~~", "# in a fence?", "", "", "short line", "word " * r.randrange(400), "x" * r.randrange(3000), "日本語 " * r.randrange(80), "  # no header", "\t", "a\r"]))
    return "\n".join(out) + r.choice(["", "\n", "\n\n"])


@pytest.mark.parametrize("span", [37, 500, 8 << 20])
def test_files_equal_the_one_task_result(spark, tmp_path, span):
    texts = {f"f{i}.md": sample(random.Random(i)) for i in range(25)} | {"empty.md": "", "line.md": "one", "blank.md": "\n" * 90, "long.md": "word " * 9000, "giant.md": "# T\n" + "para one two\n\n" * 3000 + "# U\n" + "z" * 5000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for r in L.long_pieces(T.tree(spark, str(tmp_path)), 1000, 200, span).collect():
        got.setdefault(r.path, []).append((r.section, -1 if r.sub_chunk is None else r.sub_chunk, (r.h1, r.h2, r.h3, r.sub_chunk, r.content)))
    for name, text in texts.items():
        assert [x for _, _, x in sorted(got.get(name, []), key=lambda x: x[:2])] == plain(text, 1000, 200), name


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert L.long_pieces(T.tree(spark, f"{tmp_path}/none"), 1000, 200).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        L.Cutter(5, 5)


def test_a_block_without_fences_is_walked_once(monkeypatch):
    from tesselar.operators import longfiles

    calls, real = [], longfiles.walk
    texts = ["# A\nx\n## B\ny", "x\n~~~\n# A\n~~~\n# B", "```\n# A", ""]
    want = {t: {f: longfiles.effect(t.split("\n")) for f in [0]}[0] for t in texts}
    monkeypatch.setattr(longfiles, "walk", lambda *a: calls.append(a) or real(*a))
    assert longfiles.effect(texts[0].split("\n")) == want[texts[0]] and len(calls) == 1
    for t in texts:
        for fence, (end, titles, n) in longfiles.json.loads(longfiles.effect(t.split("\n"))).items():
            run, found = real(t.split("\n"), fence, [longfiles.KEEP] * 3), []
            while True:
                try:
                    found.append(next(run)[0])
                except StopIteration as stop:
                    assert (end, titles, n) == (stop.value, found[-1], len(found) - 1)
                    break
