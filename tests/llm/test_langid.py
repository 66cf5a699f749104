import math

import numpy as np
import pytest

from tesselar.llm import langid

from .helpers import documents, nothing, rows, thue_morse

VOCABULARIES = {"en": "the and of that with this from have not are house water light".split(), "fr": "le la les des une pour dans que avec sur maison lumière eau".split(), "de": "der die das und nicht mit für auf ein haus wasser licht über".split()}


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    r = random.Random(2)
    table = [(i, " ".join(r.choice(VOCABULARIES[lang]) for _ in range(r.randrange(5, 60))), lang) for i in range(600) for lang in [("en", "fr", "de")[i % 3]]]
    return spark.createDataFrame(table + [(900, None, "en"), (901, "12 34 !", None), (902, "", "fr"), (None, "the house of light", None)], "doc_id bigint, text string, lang string")


def test_held_out_accuracy(labelled):
    import zlib

    got = langid.language_report(labelled, langid.vocabulary()).collect()
    truth = {r.doc_id: r.lang for r in labelled.collect() if r.doc_id is not None and r.doc_id < 600}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {900: "und", 901: "und", 902: "und"}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"]


def test_forward_sums_all_segmentations():
    found, raw = langid.pieces(langid.vocabulary())
    p = np.random.default_rng(0).random((len(found), 2))
    p /= p.sum(axis=0)
    at = {x: i for i, x in enumerate(found) if x}

    def total(word):
        w = langid.SPACE_MARK + word
        sums = [np.ones(2)] + [np.zeros(2) for _ in w]
        for end in range(1, len(w) + 1):
            for begin in range(end):
                if (i := at.get(w[begin:end])) is not None:
                    sums[end] = sums[end] + sums[begin] * p[i]
            if w[end - 1] not in at:
                sums[end] = sums[end] + sums[end - 1] * np.prod([p[raw[b]] for b in w[end - 1].encode()], axis=0)
        return np.log(sums[-1])

    words = ["a", "house", "überhaupt", "日本語x", "\x01", "the", "ab" * 20, "🦥z"]
    got = langid.WordScorer(langid.vocabulary(), p).score(words)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, total(w), rtol=1e-9)


def test_long_words_are_not_cut():
    """A word of 5,000 letters scores as the recurrence over all its segmentations, in logarithms."""
    import random

    found, raw = langid.pieces(langid.vocabulary())
    p = np.random.default_rng(1).random(len(found))
    p /= p.sum()
    at, r = {x: i for i, x in enumerate(found) if x}, random.Random(8)
    longest = max(map(len, at))
    for word in ("".join(r.choice("etaoinshrdlu") for _ in range(5000)), "日本語の文" * 700 + "\U0001f972" * 40 + "water" * 300):
        w = langid.SPACE_MARK + word
        logs = [0.0]
        for end in range(1, len(w) + 1):
            parts = [logs[begin] + math.log(p[at[w[begin:end]]]) for begin in range(max(0, end - longest), end) if w[begin:end] in at]
            if w[end - 1] not in at:
                parts.append(logs[end - 1] + sum(math.log(p[raw[b]]) for b in w[end - 1].encode()))
            top = max(parts)
            logs.append(top + math.log(sum(math.exp(x - top) for x in parts)))
        got = langid.WordScorer(langid.vocabulary(), p[:, None]).score([word, "the"])
        assert np.isclose(got[0, 0], logs[-1], rtol=1e-9)


def test_passes_over_languages_agree(spark, labelled):
    few = labelled.where("doc_id < 60")
    whole = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in langid.identify(few, langid.vocabulary(), langid.models(labelled, langid.vocabulary())).collect()}
    single = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in langid.identify(few, langid.vocabulary(), langid.models(labelled, langid.vocabulary(), most=1)).collect()}
    assert whole == single and {v[0] for v in whole.values()} == {"en", "fr", "de"}


def test_words_of_equal_hash_have_their_own_scores(spark, labelled, monkeypatch):
    texts = spark.createDataFrame([(1, f"{thue_morse()} the house"), (2, f"{thue_morse('ba')} the house"), (3, f"{thue_morse('ba')} {thue_morse()}")], "doc_id bigint, text string").coalesce(1)
    found = list(langid.models(labelled, langid.vocabulary()))
    each = [langid.identify(texts.where(f"doc_id = {i}"), langid.vocabulary(), iter(found)).first() for i in (1, 2, 3)]
    assert sorted(map(tuple, langid.identify(texts, langid.vocabulary(), iter(found)).collect())) == sorted(map(tuple, each))


def test_awkward_rows_and_stage(spark):
    got = langid.language_report(documents(spark), langid.vocabulary()).collect()
    assert len(got) == len(rows())
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 4, 7, 40}
    kept = langid.keep_identified(documents(spark), langid.vocabulary())
    assert kept.columns == documents(spark).columns and kept.count() == len(rows()) - 4


def test_nothing(spark):
    assert langid.language_report(nothing(spark), langid.vocabulary()).collect() == []
    unknown = spark.createDataFrame([(3, "words", None)], "doc_id bigint, text string, lang string")
    assert [tuple(r)[2:] for r in langid.language_report(unknown, langid.vocabulary()).collect()] == [("und", 0.0)]


def test_runs_outside_the_vocabulary(spark):
    path = langid.vocabulary()
    found, raw = langid.pieces(path)
    p = np.full((len(found), 3), 5e-7)
    for i, lang in enumerate(sorted(VOCABULARIES)):
        for w in VOCABULARIES[lang]:
            if langid.SPACE_MARK + w in found:
                p[found.index(langid.SPACE_MARK + w), i] = 0.02
    assert "\U0001f972" not in found and "\u3030" not in found
    text = " ".join(VOCABULARIES["fr"] * 20)
    table = [(1, text + " " + "\U0001f972" * 50), (2, text + " " + "\u3030" * 50), (3, ("\U0001f972" * 300 + " ") + text), (4, text + " la" + "\U0001f972" * 7)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    for r in langid.identify(docs, path, iter([(sorted(VOCABULARIES), p)])).collect():
        assert r.lang_pred == "fr" and 0.99 < r.score <= 1
    scorer = langid.WordScorer(path, p)
    assert np.allclose(scorer.score(["\U0001f972" * 50])[0], np.log(p[found.index(langid.SPACE_MARK)]) + 200 * np.log(5e-7))
    q = p * [1.0, 1e-3, 1.0]  # a language far behind all along stays finite
    assert np.isfinite(langid.WordScorer(path, q).score(["house" * 50])).all()


def test_whole_texts_equal_brute_force(spark, labelled, monkeypatch):
    """lang_pred and score of texts of several words, from the scores of each word alone; however words are sliced or kept."""
    path = langid.vocabulary()
    [(langs, p)] = list(langid.models(labelled, path))
    scorer = langid.WordScorer(path, p)
    texts = ["the house of light", "la maison lumière pour", "der die das wasser the", "house house house", "x" * 300 + " und das ist", "日本語 light", "a1 b2 c3"]
    want = {}
    for t in texts:
        total = sum(scorer.score([w])[0] for w in t.split())
        share = np.exp(total - total.max())
        want[t] = (langs[int(total.argmax())], 1 / share.sum())
    frame = spark.createDataFrame([(t,) for t in texts + [" ".join(texts)] * 2], "text string")
    for cache, size in ((langid.CACHE_BYTES, langid.SLICE), (0, 7), (1 << 30, 3)):
        monkeypatch.setattr(langid, "CACHE_BYTES", cache)
        monkeypatch.setattr(langid, "SLICE", size)
        got = {r.text: (r.lang_pred, r.score) for r in langid.identify(frame, path, iter([(langs, p)])).collect()}
        for t, (lang, score) in want.items():
            assert got[t][0] == lang and math.isclose(got[t][1], score, rel_tol=1e-6)


def test_words_are_sliced_by_code_points():
    assert list(langid.sliced(["ab", "c", "dddd", "e" * 50, "f"], 5)) == [["ab", "c"], ["dddd"], ["e" * 50], ["f"]] and list(langid.sliced([])) == []


def test_query_has_the_columns_asked_for(spark, labelled, tmp_path):
    labelled.write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op8_language_id(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")] and got.count() == labelled.count()
