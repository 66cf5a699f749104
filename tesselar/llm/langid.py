"""Operator 8: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
likelihood of a text is that of its words, and the likelihood of a word is the
sum over all ways to cut it into pieces, found by the forward algorithm. Words
repeat, so each worker scores a word once for all languages and keeps it. All
languages are learned; they are scored in passes of LANGUAGES, so that memory does
not grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Powers, Workspace, blocks, distinct_words, give_back, small_batches, table, text_bytes, word_spans

#: Documents of each language, by a seeded digest, that the probabilities are fitted on (about; all if there are fewer).
SAMPLE_DOCS = 1500
#: Languages that one pass over the texts scores.
LANGUAGES = 32
#: Added to every count.
SMOOTHING = 0.5
#: Values below which a run is scored in logarithms instead.
LOW = 1e-200
#: Bytes of words and their scores that a worker keeps.
CACHE_BYTES = 48 << 20
#: Code points, or words, that are scored at once.
SLICE = 1 << 17
SPACE_MARK = "▁"
UNKNOWN = "und"
POINTS = Powers(0x9E3779B97F4A7C15)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> tuple[list[str], dict[int, int]]:
    """The vocabulary's pieces by id ('' for control and byte pieces) and the ids of the 256 byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    found, raw = [], {}
    for i in range(sp.get_piece_size()):
        special = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        if sp.is_byte(i):
            raw[int(sp.id_to_piece(i)[3:5], 16)] = i
        found.append("" if special or sp.is_byte(i) else sp.id_to_piece(i))
    return found, raw


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(lang, piece, n): how often each piece stands in the tokenizer's own segmentation of the texts."""

    def count(batches):
        from sentencepiece import SentencePieceProcessor

        sp, total = SentencePieceProcessor(model_file=path), {}
        for block in blocks(batches):
            for lang, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, np.zeros(sp.get_piece_size(), np.int64))
                own += np.bincount(np.array(sp.encode(" ".join(text.split()), num_threads=1), np.int64), minlength=len(own))
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "piece", "n"])

    small_batches(docs.sparkSession)
    return docs.select("lang", "text").mapInArrow(count, "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def models(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS, most: int = LANGUAGES) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages and their piece probabilities (pieces x languages) from rows (doc_id, text, lang) that are not held out, ``most`` languages at a time.

    Counts of documents cover all rows; the probabilities are fitted on about ``sample`` documents of each language.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}  # a row for each language
    size, every = len(pieces(path)[0]), sorted(share)
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":lang"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    for first in range(0, len(every), most):
        langs = every[first : first + most]
        counted, at = np.full((size, len(langs)), SMOOTHING), {lang: i for i, lang in enumerate(langs)}
        rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, share[lang])])[F.col("lang")]
        for r in piece_counts(known.where(F.col("lang").isin(langs) & (draw < rate)), path).toLocalIterator():  # at most languages x pieces rows
            counted[r["piece"], at[r["lang"]]] += r["n"]
        yield langs, counted / counted.sum(axis=0, keepdims=True)


class WordScorer:
    """Log-likelihoods of words in every language."""

    def __init__(self, path: str, probabilities: np.ndarray):
        found, raw = pieces(path)
        self.p = np.vstack([probabilities, np.zeros((1, probabilities.shape[1]))])
        self.bytes = np.log(probabilities[[raw[i] for i in range(256)]])
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(found):
            if piece:
                by_length.setdefault(len(piece), []).append(i)
        self.tables = {}
        for k, ids in sorted(by_length.items()):
            code = np.frombuffer("".join(found[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(-1, k)
            h = self._sums(code.reshape(-1))
            h = ((h[k::k] - h[:-k:k]) * POINTS.to(len(h))[1][: len(h) - 1 : k]).view(np.uint64)
            order = np.argsort(h)
            hint = np.zeros(1 << 18, bool)
            hint[(h >> np.uint64(46)).astype(np.int64)] = True
            self.tables[k] = h[order], np.array(ids, np.int32)[order], hint
        self.none = len(found)

    @staticmethod
    def _sums(points: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * POINTS.to(len(points) + 1)[0][: len(points)], out=sums[1:])
        return sums

    def score(self, words: list[str]) -> np.ndarray:
        """(words x languages). A word begins with the mark of a space; code points outside the vocabulary count as their bytes.

        A word is cut where no piece of the vocabulary that stands in it lies across:
        all its segmentations cut there too, so its likelihood is its runs' product.
        """
        marked = [SPACE_MARK + w for w in words]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(w) for w in marked], np.int64)
        head = np.cumsum(length) - length
        place = np.arange(len(points)) - np.repeat(head, length)
        sums, down = self._sums(points), POINTS.to(len(points) + 1)[1]
        longest = max(self.tables)
        ids, across = np.full((longest + 1, len(points)), self.none, np.int32), np.zeros(len(points) + 1, np.int64)
        for k, (known, own, hint) in self.tables.items():
            end = np.flatnonzero(place >= k - 1)
            h = (sums[end + 1] - sums[end + 1 - k]) * down[end + 1 - k]
            maybe = hint[(h >> np.uint64(46)).astype(np.int64)]
            end, h = end[maybe], h[maybe]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            ids[k, end[hit]] = own[at[hit]]
            if k > 1:  # the piece lies across the borders before its second to its last code point
                np.add.at(across, end[hit] + 2 - k, 1)
                np.subtract.at(across, end[hit] + 1, 1)
        begin = np.flatnonzero((np.cumsum(across[:-1]) == 0) | (place == 0))
        size = np.diff(np.append(begin, len(points)))
        owner = np.searchsorted(head, begin, side="right") - 1
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        lost, rare = np.flatnonzero(ids[1] == self.none), {}
        forward = np.zeros((len(points) + 1, self.p.shape[1]))
        if len(lost):
            for c in np.unique(points[lost]).tolist():
                rare[c] = np.exp(sum(self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")))
        logs = np.zeros((len(size), self.p.shape[1]))
        low = np.zeros(len(size), bool)
        active = len(size)
        for t in range(int(size[0]) if len(size) else 0):
            while size[active - 1] <= t:
                active -= 1
            end = begin[:active] + t
            total = np.zeros((active, self.p.shape[1]))
            for k in range(1, min(t + 1, longest) + 1):
                own = ids[k, end]
                hit = np.flatnonzero(own != self.none)
                if len(hit):
                    before = 1.0 if t + 1 == k else forward[end[hit] - k]
                    total[hit] += self.p[own[hit]] * before
            if rare:
                hit = np.flatnonzero(ids[1, end] == self.none)
                if len(hit):
                    before = 1.0 if t == 0 else forward[end[hit] - 1]
                    total[hit] += np.array([rare[c] for c in points[end[hit]].tolist()]) * before
            weak = total.min(axis=1) < LOW
            if weak.any():
                low[:active] |= weak
                total[weak] = np.maximum(total[weak], LOW)
            forward[end] = total
            if t % 16 == 15:
                lo = max(0, t - longest + 1)
                near = end[:, None] - np.arange(t - lo + 1)
                top = forward[near].max(axis=1)
                forward[near] /= top[:, None, :]
                logs[:active] += np.log(top)
        logs += np.log(forward[begin + size - 1])
        if low.any():
            logs[low] = self._in_logs(points, begin[low], size[low], ids, longest)
        out = np.zeros((len(words), self.p.shape[1]))
        np.add.at(out, owner, logs)
        return out


    def _in_logs(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, longest: int) -> np.ndarray:
        """The forward algorithm on logarithms, for runs (longest first) whose likelihood no floating-point number holds."""
        p = np.log(self.p[:-1])
        forward = np.zeros((len(points) + 1, p.shape[1]))
        active = len(size)
        for t in range(int(size[0])):
            while size[active - 1] <= t:
                active -= 1
            end = begin[:active] + t
            total = np.full((active, p.shape[1]), -np.inf)
            for k in range(1, min(t + 1, longest) + 1):
                own = ids[k, end]
                hit = np.flatnonzero(own != self.none)
                if len(hit):
                    before = 0.0 if t + 1 == k else forward[end[hit] - k]
                    total[hit] = np.logaddexp(total[hit], p[own[hit]] + before)
            hit = np.flatnonzero(ids[1, end] == self.none)
            if len(hit):
                before = 0.0 if t == 0 else forward[end[hit] - 1]
                own = np.array([sum(self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in points[end[hit]].tolist()])
                total[hit] = np.logaddexp(total[hit], own + before)
            forward[end] = total
        return forward[begin + size - 1]


def identify(docs: DataFrame, path: str, found: Iterator[tuple[list[str], np.ndarray]]) -> DataFrame:
    """docs (text; all columns stay) with lang_pred and score, the posterior of lang_pred under equal priors.

    A text that is null or has no letter is ``und`` with score 0, as is every text if
    no language was learned; ties go to the language that sorts first. Each pass has
    the best language so far, its likelihood and the sum of all, relative to it.
    """
    state = docs.withColumn("_pred", F.lit(None).cast("string")).withColumn("_top", F.lit(None).cast("double")).withColumn("_sum", F.lit(0.0))
    kind, passes, ws = StructType([*state.schema.fields]), 0, None
    small_batches(docs.sparkSession)
    for langs, probabilities in found:
        if passes:  # passes do not share a worker's memory
            ws = ws or Workspace(docs.sparkSession, "languages")
            state = ws.put(state, f"pass-{passes}")
            ws.keep(f"pass-{passes}")
        state, passes = state.mapInArrow(_pass(path, langs, probabilities), kind), passes + 1
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.col("_pred").isNotNull()
    return state.withColumn("lang_pred", F.when(letter, F.col("_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(letter, 1 / F.col("_sum")).otherwise(0.0)).drop("_pred", "_top", "_sum")


def sliced(words: list[str], most: int = 0) -> Iterator[list[str]]:
    """Words in slices of about ``most`` code points, or one word."""
    most, first, size = most or SLICE, 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) > most:
            yield words[first:i]
            first, size = i, 0
        size += len(w) + 1
    if first < len(words):
        yield words[first:]


def _add(total: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of their owners, which ascend."""
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(new):
        total[owner[new]] += np.add.reduceat(rows, new, axis=0)


def _pass(path: str, langs: list[str], probabilities: np.ndarray):
    names = np.array(langs, object)

    def run(batches):
        scorer, known, scores, held = WordScorer(path, probabilities), {}, np.zeros((0, len(langs))), 0
        for block in blocks(batches):
            column = lambda name: block.column(block.schema.get_field_index(name))  # noqa: B023, E731
            raw, ends = text_bytes(column("text"))
            starts, stops, at = word_spans(raw, ends)
            _, first, which = distinct_words(raw, starts, stops)
            data = raw.tobytes()
            words = [data[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
            owner, total = np.repeat(np.arange(block.num_rows), np.diff(at)), np.zeros((block.num_rows, len(langs)))
            cost = lambda ws: sum(map(len, ws)) + len(ws) * (120 + 8 * len(langs))
            if cost(words) > CACHE_BYTES:  # a text of very many words: scored slice by slice, none is kept
                low = 0
                for part in sliced([w.decode() for w in words]):
                    own = scorer.score(part)
                    here = np.flatnonzero((which >= low) & (which < low + len(part)))
                    for i in range(0, len(here), SLICE):
                        _add(total, owner[here[i : i + SLICE]], own[which[here[i : i + SLICE]] - low])
                    low += len(part)
            else:
                if held > CACHE_BYTES:
                    known, scores, held = {}, scores[:0], 0
                fresh = [w for w in words if w not in known]
                if fresh:
                    known.update(zip(fresh, range(len(scores), len(scores) + len(fresh)), strict=True))
                    scores = np.concatenate([scores, *[scorer.score(part) for part in sliced([w.decode() for w in fresh])]])
                    held += cost(fresh)
                own = np.array([known[w] for w in words], np.int64)
                for i in range(0, len(which), SLICE):
                    _add(total, owner[i : i + SLICE], scores[own[which[i : i + SLICE]]])
            best = total.argmax(axis=1)
            top = total[np.arange(len(best)), best]
            sums = np.exp(total - top[:, None]).sum(axis=1)
            before = np.where(np.asarray(column("_top").is_null()), -np.inf, column("_top").fill_null(0.0).to_numpy(zero_copy_only=False))
            high = np.maximum(before, top)
            pred = np.where(top > before, names[best], np.array(column("_pred").to_pylist(), object))
            sums = np.exp(before - high) * column("_sum").to_numpy(zero_copy_only=False) + np.exp(top - high) * sums
            made = {"_pred": pa.array(pred, pa.string()), "_top": pa.array(high), "_sum": pa.array(sums)}
            yield pa.RecordBatch.from_arrays([made.get(f.name, block.column(i)) for i, f in enumerate(block.schema)], names=block.schema.names)
        give_back()

    return run


def language_report(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents (doc_id, text, lang).

    Learns from rows with text and lang whose crc32(doc_id as text) mod 3 is not 1
    (a null id is not held out); predicts from the text alone. Repeated rows give a
    row each; whole texts count, however long they or their words are; other columns
    are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return identify(texts, path, models(docs, path, sample)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that have a language, with the columns of docs; ``und`` is rejected.

    Null, empty and letterless texts go; repeated rows and null ids are judged by
    their texts like any other; texts are read whole; an empty table stays empty.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("_row"), "text")
    kept = identify(rows, path, models(docs, path, sample)).where(F.col("lang_pred") != UNKNOWN)
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"), vocabulary())
