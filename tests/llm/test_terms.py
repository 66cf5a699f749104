import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselar.llm import common, terms

from .helpers import thue_morse


def plain(text):
    """Terms of a text, one code point after another."""
    out, now = [], ""
    for c in text or "":
        if c >= "\x80" or c.isascii() and c.isalnum():
            now += c.lower() if c.isascii() else c
        elif now:
            out, now = [*out, now], ""
    return [*out, now] if now else out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(codec="utf-8"), max_size=40), st.text("aBz09_-/ :@[`{é\x7f\x80　", max_size=40)), max_size=6))
def test_terms_are_runs_of_letters_digits_and_other_code_points(texts):
    assert terms.terms_of(texts) == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=50))
def test_numbers_come_back(values):
    data, ends = terms.pack_numbers(np.array(values, np.int64))
    assert terms.unpack_numbers(data).tolist() == values and ends[-1] == len(data) and len(ends) == len(values) + 1


def test_words_are_grouped_by_their_bytes(monkeypatch):
    monkeypatch.setattr(terms, "word_hashes", lambda raw, a, b: np.zeros(len(a), np.uint64))  # all hashes are equal
    words = [random.Random(3).choice(["a", "b", "aa", thue_morse("ab"), thue_morse("ba")]) for _ in range(80)]
    raw, ends = common.text_bytes(pa.array([" ".join(words)]))
    starts, stops, _ = terms.term_spans(raw, ends)
    order, cuts = terms.grouped(raw, starts, stops)
    groups = [order[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    assert sorted(groups) == sorted([[i for i, w in enumerate(words) if w == x] for x in set(words)])


def test_slices_cut_no_term():
    texts = ["ab cd", "", "x" * 50, "e f g h", " "]
    raw, ends = common.text_bytes(pa.array(texts))
    got, n = [], np.zeros(len(texts), int)
    for part, cut in terms.slices(raw, ends, 4):
        starts, stops, at = terms.term_spans(part, cut)
        got += [part[a:b].tobytes().decode() for a, b in zip(starts, stops, strict=True)]
        n += np.diff(at)
    assert got == [w for t in texts for w in plain(t)] and n.tolist() == [2, 0, 1, 4, 0]


def test_segments_hold_whole_rows():
    rows = pa.table({"text": ["a" * 30, "b" * 30, None, "c" * 500, "d", "e" * 99, "f"]})
    got = [t["text"].to_pylist() for t in terms.segments(rows.to_batches(max_chunksize=2), 100, 4)]
    assert [x for t in got for x in t] == rows["text"].to_pylist() and all(sum(len(x or "") for x in t) <= 100 or len(t) == 1 for t in got)
