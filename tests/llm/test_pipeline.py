"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_planted_cases(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(80) for _ in range(300)]
    toxic = [text(60) + " you " + rng.choice(["vermin", "fiend"]) + " you vermin " + text(10) for _ in range(120)]
    passage = text(60)
    shared = [text(50) + " " + passage + " " + text(50) for _ in range(6)]
    docs = [*clean, *toxic, *shared, clean[0], clean[1] + " tail", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(300 <= i < 420)) for i in range(420)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if i < 3:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({r["doc_id"]: r["text"] for r in at.collect()})
    first, second, third = seen
    assert not set(first) & set(range(300, 420)) and set(range(300)) <= set(first)
    assert set(first) - set(second) == {426, 427}
    assert set(third) == set(second) and all(third[i] == docs[i] for i in range(300))
    assert all(passage[20:300] not in third[i] and third[i].startswith(docs[i][:100]) for i in range(420, 426))
    packed = at.collect()
    assert {r["doc_id"] for r in packed} == set(third) and all(r["length"] <= 2048 for r in packed)


def test_near_duplicates_with_null_and_shared_ids(spark, rows):
    from veilframe.llm import minhash

    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    # under id 7 another text stands beside the near copies of ids 1 to 40; the others have no id
    data = [(7, text("x"))] + [(7, text("a") + " tail")] + [(i, text("a") + f" end{i}") for i in range(1, 41) if i != 7]
    data += [(None, text("a") + " other"), (None, text("b")), (None, text("b") + " tail"), (None, text("c"))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = minhash.near_duplicates(docs, 4, 80).groupBy("doc_id", "component_id", "kept").count()
    want = {(i, 1, i == 1): 1 for i in range(1, 41)} | {(7, 7, True): 1, (None, 1, False): 1, (None, None, True): 3}
    assert {tuple(r)[:3]: r["count"] for r in got.collect()} == want
    # one row of each group stays in the pipeline: x, the a of id 1, one b and c
    import corpus_pipeline

    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["text"][:2] for r in left.collect()) == ["a0", "b0", "c0", "x0"]


def test_passage_of_short_words_is_cut(spark):
    import random

    import corpus_pipeline

    rng = random.Random(5)
    words = lambda n, k: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(k)) for _ in range(n))
    passage = words(60, 2)  # 179 bytes
    data = [(i, f"{words(50, 6)} {passage} {words(50, 6)}") for i in range(4)] + [(9, words(80, 6))]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(data, "doc_id long, text string"), "").collect()}
    assert all(passage[10:170] not in got[i] and got[i].startswith(data[i][1][:300]) for i in range(4)) and got[9] == data[4][1]
