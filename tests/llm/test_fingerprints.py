import hashlib

import xxhash
from pyspark.sql import functions as F

from tesselar.llm import fingerprints as op

from .helpers import documents, nothing, prose, rows, words


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(value, seed=42):
    data = value if isinstance(value, bytes) else (value & (1 << 64) - 1).to_bytes(8, "little")
    return signed(xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1))


def chain(values):
    h = 42
    for v in values:
        h = xx(v, h)
    return h


def kept(text):
    h = [xx(w) for w in words(text)]
    limit, cut = (1 << 48) // op.SCALE, lambda g: (g & (1 << 64) - 1) >> 16
    if len(h) < 5:
        return {cut(chain([b"whole", " ".join(map(str, h)).encode()])) % limit} if h else set()
    return {x for x in (cut(chain(h[i : i + 5])) for i in range(len(h) - 4)) if x < limit}


def near(a, b, same):
    return 1.0 if same else len(a & b) / len(a | b) if a | b else 0.0


def test_against_brute_force(spark):
    table = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (doc_id, text) in enumerate(table):
        following = table[(i + 1) % len(table)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, e, f = kept(text), kept(edited), kept(following)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:012x}" for x in sorted(a)), round(near(a, e, text == edited), 9), round(near(a, f, text == following), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint.split(":")[1], round(r.near_edited, 9), round(r.near_next, 9)) for r in op.fingerprint_documents(documents(spark)).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_many_ranges_give_the_same_order(spark, monkeypatch):
    base = {r.doc_id: r.edited_sha256 for r in op.fingerprint_documents(documents(spark).where("doc_id <> 1000")).collect()}
    monkeypatch.setattr(op, "RANGE_ROWS", 2)
    monkeypatch.setattr(op, "CUTS", 3)
    assert {r.doc_id: r.edited_sha256 for r in op.fingerprint_documents(documents(spark).where("doc_id <> 1000")).collect()} == base


def test_ids_at_both_ends_of_bigint(spark, monkeypatch):
    ids = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**62, 2**63 - 2, 2**63 - 1]
    frame = spark.createDataFrame([(d, prose(i, 30)) for i, d in enumerate(ids)], "doc_id bigint, text string").repartition(3)
    for rows_, ranges in ((2000, 4096), (1, 2)):
        monkeypatch.setattr(op, "RANGE_ROWS", rows_)
        monkeypatch.setattr(op, "RANGES", ranges)
        got = {r.doc_id: r for r in op.fingerprint_documents(frame).collect()}
        for i, d in enumerate(ids):
            text, following = prose(i, 30), prose((i + 1) % len(ids), 30)
            half = len(text) // 2
            assert got[d].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


def test_sketches_merge_and_contain(spark):
    small, large, other = prose(1, 200, 3000), prose(2, 6000, 3000), prose(3, 200, 3000)
    whole = f"{large} {small}"
    frame = spark.createDataFrame([("s", small), ("l", large), ("o", other), ("w", whole), ("t", "two words"), ("n", None)], "name string, text string").select("name", op.sketch(F.col("text")).alias("kept"))
    kept_ = {r.name: r.kept for r in frame.collect()}
    assert len(kept_["t"]) == 1 and kept_["n"] == [] and 1000 < len(kept_["l"]) < 2000
    pairs = frame.alias("a").join(frame.alias("b")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), op.containment(F.col("a.kept"), F.col("b.kept"), F.lit(False)).alias("c"), op.merge(F.col("a.kept"), F.col("b.kept")).alias("m")).collect()
    found = {(r.a, r.b): r for r in pairs}
    assert found["s", "w"].c == 1.0 and found["l", "w"].c == 1.0 and found["o", "w"].c < 0.1 and found["w", "s"].c < 0.1
    assert found["s", "l"].m == sorted(set(kept_["s"]) | set(kept_["l"])) and set(found["s", "l"].m) <= set(kept_["w"])
    assert len(set(kept_["w"]) - set(found["s", "l"].m)) <= 4  # shingles across the seam
    all_ = op.merged(frame.withColumn("g", F.lit("x")), "g").first()
    assert all_.kept == sorted({x for k in kept_.values() for x in k})


def test_query_has_the_columns_asked_for(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op1_document_fingerprints(spark, str(tmp_path))
    kinds = [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields][:7] == kinds and got.count() == len(rows())


def test_equal_texts_and_decoding(spark):
    found = op.fingerprint_documents(documents(spark))
    back = found.select("doc_id", op.decode(F.col("fingerprint")).alias("k"), "fingerprint").collect()
    assert all("".join(f"{x:012x}" for x in r.k) == r.fingerprint.split(":")[1] for r in back)
    twice = [r.fingerprint for r in back if r.doc_id == 1000]
    assert twice[0] == twice[1]


def test_one_row_and_none(spark):
    one = op.fingerprint_documents(documents(spark).where("doc_id = 22")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert op.fingerprint_documents(nothing(spark)).collect() == []
