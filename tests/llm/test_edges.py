"""What every operator has to bear: null ids, repeated rows, very long and empty texts, ties, clashing names."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_near, brute_repeats
from veilframe.llm import bytebpe, embeddups, minhash, orcids, packing, sharding, suffixes, tokencount, topk, toxicity

#: Names that operators use for columns of their own.
CLASHES = "t u row node key piece length score rank shard slot bands n part ids tie size label word_no"
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES.split())


def made() -> list[tuple[int | None, str | None]]:
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    long = " ".join(word() for _ in range(30_000))  # about 180 KB
    same = " ".join(word() for _ in range(120))
    rows = [(1, long), (2, long[:150_000] + " other end"), (3, "x" * 50_000), (4, None), (5, ""), (6, " \n"), (7, same), (7, same), (7, same + " tail"), (8, "née 日本 😀 " * 40)]
    rows += [(None, same), (None, same), (None, None), (None, "alone it stands here")]
    return rows + [(i, f"common line of all {word()} {word()}") for i in range(20, 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["c"] * len(CLASHES.split())) for i, t in made()], SCHEMA).repartition(3)


def counted(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_op1(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in made())
    assert counted(tokencount.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens") == want


def test_op2(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk, want = Tokenizer.from_file(path), Counter()
    for i, t in made():
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048))
    got = packing.pack(docs, path)
    assert counted(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got.collect())
    for (s, at, n), (s2, at2, _) in zip(places[:-1], places[1:], strict=True):
        assert at2 == (at + n if s == s2 else 0)


def test_op3(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in (1, 7, 20, 21, 22, 23)] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, score string")
    got = toxicity.score_documents(docs, labels)
    assert got.count() == len(made()) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where("doc_id is null and held_out").count() in (0, 4)


def test_op4(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    want = Counter()
    for i, t in made():
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    orcids.write_token_files(docs, str(tmp_path / "ids"), path)
    got = orcids.digests(spark, str(tmp_path / "ids"))
    assert counted(got, "doc_id", "n_tokens", "ids_crc32") == want
    at = 0
    for r in sorted(got.collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got.collect(), key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_op4_files_have_indexes_that_skip(spark, tmp_path):
    from pyarrow import orc

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    orcids.write_token_files(docs, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    files = sorted((tmp_path / "ids").glob("*.orc"))
    data = b"".join(f.read_bytes() for f in files)
    assert files and data.startswith(b"ORC")
    assert sum(orc.ORCFile(str(f)).nrows for f in files) == 20_000
    plan = orcids.read_token_files(spark, str(tmp_path / "ids"), [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [7])]" in plan or "EqualTo(doc_id,7)" in plan.replace(" ", "")
    assert [r["doc_id"] for r in orcids.read_token_files(spark, str(tmp_path / "ids"), [7]).collect()] == [7]


def test_op5(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in made():
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert counted(bytebpe.round_trip_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op6(docs):
    data = made()
    sizes = Counter((i, n) for (i, _), (_, n, _, _) in zip(data, brute_near([t for _, t in data], 4, 80), strict=True))
    got = minhash.near_duplicates(docs, 4, 80)
    assert counted(got, "doc_id", "n_shingles") == sizes
    of = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got.collect()}
    label = {i: c for (i, n), c in of.items() if i in (1, 2, 3, 8)}
    assert label == {1: 1, 2: 1, 3: 3, 8: 8} and {r["component_id"] for r in got.where("doc_id = 7").collect()} == {7}


def test_op7(docs):
    got = sharding.shard_documents(docs, [1.0] * 16)
    assert counted(got, "doc_id", "size", "text_crc32") == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in made())
    by = got.groupBy("shard").agg(F.array_sort(F.collect_list("slot")).alias("s")).collect()
    assert all(r["s"] == list(range(len(r["s"]))) for r in by)
    assert got.select("doc_id", "shard").distinct().count() == got.select("doc_id").distinct().count()


def test_op10(docs):
    data = made()
    short = [(i, t) for i, t in data if t is None or len(t) < 5_000]
    want = Counter((i, *rest[1:]) for (i, _), rest in zip(short, brute_repeats([t for _, t in short], 400), strict=True))
    few = docs.where("text is null or length(text) < 5000")
    assert counted(suffixes.remove_repeats(few, 400), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    all_ = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, 400).where("doc_id in (1, 2, 3)").collect()}
    assert all_[1]["n_removed"] == all_[2]["n_removed"] == 150_000 and all_[3]["n_removed"] == 50_000


def test_vectors_with_clashing_names(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    data = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(5, base[5].tolist(), 1), (None, base[6].tolist(), 1), (40, (base[7] + 0.01).tolist(), 1)]
    df = spark.createDataFrame([(*r, "k", 0.5, "n") for r in data], "vec_id long, embedding array<double>, label int, key string, copies double, node string")
    got = {(r["vec_id"], r["component_id"], r["n_links"]) for r in embeddups.near_duplicates(df).collect()}
    assert {(5, 5, 1), (None, 6, 1), (6, 6, 1), (7, 7, 1), (40, 7, 1), (8, 8, 0)} <= got
    top = topk.top_k(df, every=10).collect()
    assert {r["query_id"] for r in top} == {0, 10, 20, 40} and all(r["vec_id"] != r["query_id"] for r in top)


def test_pairs_right_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(600, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(a)] + [(1000 + i, v.tolist(), 0) for i, v in enumerate(b)]
    got = embeddups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("vec_id >= 1000 and component_id = vec_id - 1000").count() >= 597
    assert embeddups.shape_of(10**9, 64, 0.93)[0] > embeddups.shape_of(10**5, 64, 0.93)[0]


def test_pipeline(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in made()]
    shape = "doc_id long, text string, lang string, source string, n_chars long, score string"
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    for name, data in (("some", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(data, shape).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        out = corpus_pipeline.run(spark, at)
        assert out.count() == 0 if not data else {r["doc_id"] for r in out.collect()} >= {1, 3, 4, 5, 8, None}


def test_a_cluster_has_to_name_its_folder(spark, monkeypatch):
    from veilframe.llm import common

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *_: None)})), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Elsewhere())


def test_toxicity_is_not_fitted_in_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"you are a {'vilest' if i % 3 else 'kindly'} person {i}") for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 <> 0 AS INT) AS toxic")
    monkeypatch.setattr(toxicity, "learn_lexicon", None)
    monkeypatch.setattr(type(docs), "toArrow", None)
    assert toxicity.fit(docs, labels).fitted
