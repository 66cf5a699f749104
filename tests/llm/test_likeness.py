import random

from tesselar.llm import likeness, simhash

from .helpers import documents, nothing, words


def grams(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


def brute(table):
    sets = [grams(t) for _, t in table]
    parent = list(range(len(table)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(table):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def test_pairs_that_four_bits_miss(spark):
    r = random.Random(11)
    table = []
    for i in range(60):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(120, 300))]
        table.append((10 * i, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randrange(1, 2 + len(copy) // 40)):
                copy[at] = f"x{r.randrange(9999)}"
            table.append((10 * i + k, " ".join(copy)))
    want = brute(table)
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    assert sorted(x.doc_id for x in likeness.keep_one(docs).collect()) == want
    assert simhash.keep_one(docs).count() > len(want)


def test_awkward_rows(spark):
    got = likeness.keep_one(documents(spark))
    assert got.columns == documents(spark).columns
    kept = [x.doc_id for x in got.collect()]
    assert sorted(x for x in kept if x is not None) == brute([(x.doc_id, x.text) for x in documents(spark).collect()]) and kept.count(None) == 1
    assert likeness.keep_one(nothing(spark)).collect() == []


def test_large_group_of_copies_and_chain(spark):
    r = random.Random(5)
    base = [f"v{r.randrange(5000)}" for _ in range(200)]
    table = [(0, " ".join(base))]
    for i in range(1, 120):  # each changes a word more: neighbours are alike, the ends are not
        base = list(base)
        base[r.randrange(200)] = f"y{i}"
        table.append((i, " ".join(base)))
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    assert [x.doc_id for x in likeness.keep_one(docs).collect()] == brute(table) == [0]


def test_chunks_of_cells_and_families_meet(spark, monkeypatch):
    monkeypatch.setattr(likeness, "CELL_ROWS", 7)
    monkeypatch.setattr(likeness, "FAMILY_SHINGLES", 3000)
    r = random.Random(6)
    base = [f"v{r.randrange(5000)}" for _ in range(150)]
    table = []
    for i in range(90):  # near copies of a text that is not there: some pairs are alike, others are not
        copy = list(base)
        for at in r.sample(range(150), r.randrange(1, 9)):
            copy[at] = f"y{i}-{at}"
        table.append((i, " ".join(copy)))
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(5)
    assert sorted(x.doc_id for x in likeness.keep_one(docs).collect()) == brute(table)


def test_the_trie_gives_candidates(spark, monkeypatch):
    """Near copies within four bits are linked by the trie self-join alone; what it puts together is still compared exactly."""
    monkeypatch.setattr(likeness, "families", lambda ws, least: spark.createDataFrame([], likeness.LINKS))
    r = random.Random(12)
    table = []
    for i in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(700)]
        table += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, "end"]))]
    table += [(100, "one two three"), (101, "one two four"), (102, ""), (103, None)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    assert sorted(x.doc_id for x in likeness.keep_one(docs).collect()) == brute(table)
