"""Small tables with the awkward cases every operator must take, and plain versions of shared rules."""

import random
import re

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, bucket int, key string, rank int"


def words(text):
    return SPACE.findall((text or "").encode())


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'aeiou'[r.randrange(5)]}" for _ in range(n))


def thue_morse(letters="ab", n=1024):
    """A word that polynomial hashes modulo powers of two cannot tell from the one with swapped letters."""
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def rows(clash=True):
    """Null, empty, blank, one-word, long, repeated and equal texts, null ids, shared passages; columns whose names clash with inner ones."""
    passage = prose(99, 80)
    long = prose(7, 9000, 3000)
    texts = [
        None, "", " \t\n", "word", "two words", prose(1, 40), prose(1, 40), prose(2, 300), passage + " " + prose(3, 30), prose(4, 20) + "\n" + passage, prose(2, 299) + " changed",
        long, "ÀÉ ı ß Σας ﬁ é  x <|endoftext|> `a``b` ` it's 12 日本語 👍🏽", "!!! ???", passage, prose(5, 120), prose(6, 60) + " " + passage[: len(passage) // 2], "same same " * 60,
    ]
    out = [(i * 3 + 1, t, ("en", "de", None)[i % 3], (f"s{i % 4}", None)[i % 5 == 4], len(t or ""), "x", 7, "k", 1) for i, t in enumerate(texts)]
    out += [(1000, prose(2, 300), "en", "s0", 5, None, None, None, None), (1000, prose(2, 300), "en", "s0", 5, None, None, None, None), (None, prose(8, 70), "de", "s1", None, None, None, None, None)]
    return out if clash else [r[:5] for r in out]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
