"""The corpus operators against brute force on small tables with nulls, ties, copies and long texts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import bytebpe, embeddups, minhash, orcids, packing, queries, sharding, suffixes, tokencount, topk, toxicity
from veilframe.llm.components import components
from veilframe.llm.mergetable import MergeTable
from veilframe.llm.tokenstream import LibraryVocabulary

WORDS = "the thing over banana ananas lorem ipsum don't it's naïve 日本 😀 1234 Σίσυφος == \t".split(" ")
SCHEMA = "doc_id long, text string, score double, row string, t long, node string"  # names that operators use within


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*made, None, "", " ", "  a  b \n\n c", "x" * 3000, "ab" * 2500, "<|endoftext|> <s> ▁", made[3], made[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, "r", i, "n") for i, t in enumerate(texts())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, nothing, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in enumerate(texts())]
    assert rows(tokencount.count_tokens(docs, P.path("piece_bpe_32k.model"), 100)) == sorted(want, key=repr)
    assert tokencount.count_tokens(nothing, P.path("piece_bpe_32k.model")).count() == 0


def test_counting_does_not_depend_on_chunks():
    data = open(P.path("piece_bpe_32k.model"), "rb").read()
    whole, cut = tokencount.CountingTransducer(data), tokencount.CountingTransducer(data, chunk=7, most_cells=1)
    some = [t or "" for t in texts(5)]
    assert whole.count(some).tolist() == cut.count(some).tolist() == [int(cut.count([t])[0]) for t in some]


def test_state_maps_compose():
    index = np.array([[1, 0], [0, -1], [1, 1], [0, 1], [1, 0]])
    heads = np.array([True, False, False, True, False])
    into = tokencount.compose(index, heads, 0)
    # 0 leads to 1 in the first chunk, 1 leads out of the map in the second; a new text begins at the fourth
    assert into.tolist() == [0, 1, -1, 0, 0]


def test_counts_of_runs_that_never_forget_their_beginning():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = tokencount.CountingTransducer(open(path, "rb").read(), chunk=16)
    texts = ["a" * n for n in (1, 15, 16, 17, 500, 3001)] + ["ab" * 700, "-" * 999, "e" * 300 + " the end" * 20 + "=" * 301, "", "the thing"]
    assert machine.count(texts).tolist() == [len(sp.encode(t)) for t in texts]


def test_packing_places_every_piece(docs, nothing, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, t in enumerate(texts()):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = rows(packing.pack(docs, P.path("word_bpe_49k.json"), 64, 0))
    assert [r[:5] for r in got] == sorted(want, key=repr)
    by: dict = {}
    for r in got:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= math.ceil(sum(w[3] for w in want) / 64) + 2
    assert packing.pack(nothing, P.path("word_bpe_49k.json")).count() == 0


def test_sequences_hold_the_ids(docs):
    path = P.path("word_bpe_49k.json")
    pieces = packing.assign(packing.written(packing.cut_pieces(docs, path, 64), "test"), 64)
    made = packing.sequences(docs, pieces, path, 64).collect()
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 64 for r in made)
    assert sum(len(r["ids"]) for r in made) == pieces.agg(F.sum("length")).first()[0]


def test_exact_complements():
    assert packing.plan({7: 2, 3: 2}, 10) == [((7, 3), 2)]
    assert packing.plan({6: 1, 2: 1, 1: 1, 5: 1}, 9) == [((6, 2, 1), 1), ((5,), 1)]
    assert packing.plan({5: 1, 2: 2, 1: 1}, 10) == [((5, 2, 2, 1), 1)]
    for seed in range(20):
        rng = random.Random(seed)
        counts = Counter(rng.randint(1, 50) for _ in range(300))
        used: Counter = Counter()
        for pattern, times in packing.plan(counts, 50):
            assert sum(pattern) <= 50
            for x in pattern:
                used[x] += times
        assert used == counts


def test_toxicity_learns_and_keeps_out_of_held_out_rows(spark, nothing):
    rng = random.Random(3)
    make = lambda bad: " ".join([rng.choice(WORDS[:8]) for _ in range(30)] + (["you", rng.choice(["vermin", "vermins", "fiend"])] * 2 if bad else []))
    labels = [(i, int(rng.random() < 0.3)) for i in range(800)]
    docs = spark.createDataFrame([(i, make(b), 0.0, "", 0, "") for i, b in labels] + [(9000, None, 0.0, "", 0, ""), (9001, "x " * 9000, 0.0, "", 0, "")], SCHEMA)
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, table, 0.3).collect()}
    assert len(got) == 802 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(i, b) for i, b in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in got.values()) - len(held) in (0, 1, 2)
    assert sum(got[i]["predicted"] == b for i, b in held) / len(held) > 0.97
    flipped = spark.createDataFrame([(i, 1 - b if zlib.crc32(str(i).encode()) % 4 == 2 else b) for i, b in labels], "doc_id long, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, flipped).collect()} == {i: r["score"] for i, r in got.items()}
    assert toxicity.score_documents(nothing, table).count() == 0
    assert {r["score"] for r in toxicity.score_documents(docs, table.limit(0)).collect()} == {0.0}


def test_token_files(spark, docs, nothing, rows, tmp_path):
    from tokenizers import Tokenizer

    tk, at, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    ids = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts())}
    for i, own in ids.items():
        want.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    orcids.write_token_files(docs, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    assert rows(orcids.digests(spark, str(tmp_path / "ids"))) == sorted(want, key=repr)
    assert {r["doc_id"]: r["ids"] for r in orcids.read_token_files(spark, str(tmp_path / "ids"), [3, 7]).collect()} == {3: ids[3], 7: ids[7]}
    assert orcids.write_and_read(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe(docs, nothing, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in enumerate(texts()):
        own = enc.encode_ordinary(t or "")
        want.append((i, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert rows(bytebpe.round_trip_digests(docs, path)) == sorted(want, key=repr)
    assert rows(bytebpe.decode(bytebpe.encode(docs, path), path)) == sorted([(i, t or "") for i, t in enumerate(texts())], key=repr)
    assert bytebpe.round_trip_digests(nothing, path).count() == 0


def test_streaming_encoder_equals_merging():
    rng = random.Random(2)
    ranks = {bytes([b]): b for b in range(97, 101)} | {x: 200 + i for i, x in enumerate((b"ab", b"bc", b"abc", b"cd", b"aab", b"aa", b"dd", b"ddd", b"abcd"))}
    machine = bytebpe.EmittingTransducer(ranks, most_states=20)
    table = MergeTable({k.decode(): float(v) for k, v in ranks.items()})
    for _ in range(300):
        piece = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 30)))
        assert machine.encode_piece(piece.encode()) == [ranks[x.encode()] for x in table.merge(piece)]


def test_ids_are_emitted_before_the_piece_ends():
    """The query's codec holds back no more bytes than a token can still grow out of."""
    codec = bytebpe.ByteBPE(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)
    piece = (" " + "internationalisation" * 40).encode()
    longest = max(map(len, codec.ranks))
    seen, read, late = [], 0, 0
    for ids in codec.encoder.emit(bytes([b]) for b in piece):
        read += 1
        seen += ids
        late = max(late, min(read, len(piece)) - sum(len(codec.vocabulary[i]) for i in seen))
    assert seen == codec.encode_text(piece.decode()) and b"".join(codec.vocabulary[i] for i in seen) == piece
    assert late <= 2 * longest and len(codec.encoder.states) > 20


def test_utf8_machine():
    rng = random.Random(4)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xC1, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(rng.randint(0, 8)))
        state, out = b"", ""
        for b in data:
            more, state = bytebpe.advance_utf8(state, bytes([b]))
            out += more
        assert out + ("�" if state else "") == data.decode("utf-8", "replace")


def test_vocabulary_with_spaces_and_specials():
    m = LibraryVocabulary(open(P.path("byte_bpe_50k.json"), "rb").read())
    some = ["it's 's ''s !'s \n's don't'd x'll", " \x1c\x85 a", "<|endoftext|>x", "a\n\nb  c "]
    ids, ends = m.encode(some)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [m.library.encode(x, add_special_tokens=False).ids for x in some]


def near_rows(seed: int = 7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out: list[str | None] = [None, "", " \n", "one two", "One  two", "a b c d", "a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + out[7:10]


def brute_near(rows_, width, percent):
    sets = []
    for t in rows_:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return [(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("crowd", [minhash.CROWD, 2])
def test_near_duplicates(spark, nothing, rows, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    data = near_rows()
    docs = spark.createDataFrame([(i, t, 0.0, "", 0, "") for i, t in enumerate(data)], SCHEMA).repartition(3)
    assert rows(minhash.near_duplicates(docs, 4, 80)) == sorted(brute_near(data, 4, 80), key=repr)
    assert minhash.near_duplicates(nothing).count() == 0


def test_components(spark, rows):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(5, 5), (1, 0), (1, 0)], "a long, b long")
    found = dict(rows(components(links)))
    assert len(set(found.values())) == 5 - 1 and all(found[i] == found[i - i % 10] for i in found)
    assert components(links.limit(0)).count() == 0


def test_sharding(spark, docs, nothing):
    got = sharding.shard_documents(docs, [1.0] * 16).collect()
    for s in range(16):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    more = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, [1.0] * 17).collect()}
    assert all(r["grown_shard"] == more[r["doc_id"]] and r["grown_shard"] in (r["shard"], 16) for r in got)
    assert all(r["text_crc32"] == zlib.crc32((texts()[r["doc_id"]] or "").encode()) and r["law"] == "key" for r in got)
    heavy = Counter(r["shard"] for r in sharding.shard_documents(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), [1.0, 3.0]).collect())
    assert 0.7 < heavy[1] / 4000 < 0.8
    assert sharding.shard_documents(nothing, [1.0] * 4).count() == 0


def test_vector_near_duplicates(spark, rows, monkeypatch):
    monkeypatch.setattr(embeddups, "BLOCK", 16)
    rng = np.random.default_rng(5)
    data = []
    for _ in range(40):
        base = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 9))):
            data.append((base + rng.normal(size=32) * 0.22).astype(np.float32).tolist())
    data += [data[0], data[0], data[1]]
    table = [(i, v, i % 2) for i, v in enumerate(data)] + [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, data[0], None), (904, [None] * 32, 0), (905, [1.0, 2.0], 0), (906, [], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    unit = np.array(data, np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.93) & (np.arange(len(data))[:, None] % 2 == np.arange(len(data))[None, :] % 2)
    np.fill_diagonal(close, False)
    label = np.arange(len(data))
    for _ in range(50):
        label = np.array([min(label[i], label[close[i]].min(initial=10**6)) for i in range(len(data))])
    got = {r[0]: r[1:] for r in rows(embeddups.near_duplicates(df))}
    found = sum(got[i][0] for i in range(len(data)))
    assert found <= close.sum() and found >= 0.97 * close.sum()
    assert np.mean([got[i][1] == label[i] for i in range(len(data))]) >= 0.97
    assert all(got[i] == (0, i, True) for i in range(900, 907))
    assert embeddups.near_duplicates(df.limit(0)).count() == 0


def brute_top(ids, whole, k=5):
    want = []
    for i, q in zip(ids, whole, strict=True):
        if i % 50 == 0:
            score = {j: sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for j, v in zip(ids, whole, strict=True) if j != i and len(v) == len(q)}
            best = sorted(score, key=lambda j: (-score[j], j))[:k]
            want += [(i, r, j, max(min(score[j], 2**63 - 1), -(2**63))) for r, j in enumerate(best, 1)]
    return sorted(want, key=repr)


@pytest.mark.parametrize("block", [40, 150, 8192])
def test_top_k(spark, rows, monkeypatch, block):
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(500, 8)).round(1), np.repeat(rng.normal(size=(1, 8)).round(1), 100, axis=0)])  # ties
    x[550:] += rng.normal(size=(50, 8)) * 0.01
    table = [(i, v.tolist(), "n", 0.5) for i, v in enumerate(x)]
    table += [(50 * 600, None, "n", 0.5), (50 * 601, [float("inf")] * 8, "n", 0.5), (7001, [1.0] * 3, "n", 0.5), (None, [1.0] * 8, "n", 0.5), (50 * 602, [], "n", 0.5)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, pivot string, score double").repartition(5)
    assert rows(topk.top_k(df, data_block=block, query_block=max(4, block // 10))) == brute_top(range(600), np.floor(256 * x).tolist())
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_answers_repeated_queries_once_and_lone_ones_with_what_there_is(spark, rows):
    df = spark.createDataFrame([(50, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [0.5, 0.5]), (100, [3.0])], "vec_id long, embedding array<double>")
    assert rows(topk.top_k(df)) == [(50, 1, 7, 256 * 128 + 512 * 128)]


def test_top_k_is_exact_for_components_of_any_size(spark, rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) * np.array([1, 1e3, 1e6, 1e9]).take(rng.integers(0, 4, 120))[:, None]
    x[100] = [1e9, 1.0, 0, 0]
    x[7] = [1e200, 1.0, 0, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(256 * c)) for c in v] for v in x.tolist()]
    got, want = rows(topk.top_k(df, data_block=30)), brute_top(range(120), whole)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g for g in got if abs(g[3]) < 2**62] == [w for w in want if abs(w[3]) < 2**62]


def test_cover_trees_prune():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 100
    data = np.concatenate([c + rng.normal(size=(300, 16)) * 0.1 for c in centres])
    tree = topk.CoverTree(data)
    assert len(tree.runs) > 20 and sorted(tree.order_of.tolist()) == list(range(len(data)))
    for (low, high), centre, radius in zip(tree.runs, tree.centres, tree.radii, strict=True):
        assert topk.distances(tree.points[low:high], centre).max() <= radius * (1 + 1e-9)


def brute_repeats(data, window):
    parts = [(t or "").encode() for t in data]
    seen = Counter(b[s : s + window] for b in parts for s in range(len(b) - window + 1))
    out = []
    for i, b in enumerate(parts):
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s + 1 : s + window + 1] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[1 : len(b) + 1]].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 1])
def test_repeated_strings(spark, nothing, rows, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "HOT", 64 if crowd > 1 else 1)
    rng = random.Random(9)
    junk = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passage, other = junk(70), junk(55)
    data = [None, "", "short", *[junk(rng.randint(0, 90)) + rng.choice([passage, other, passage[8:], passage[:52], ""]) + junk(rng.randint(0, 60)) for _ in range(40)]]
    data += ["xy" * 200, "é" * 120, data[5], data[5], passage + passage]
    docs = spark.createDataFrame([(i, t, 0.0, "", 0, "") for i, t in enumerate(data)], SCHEMA).repartition(3)
    assert rows(suffixes.remove_repeats(docs, 50)) == sorted(brute_repeats(data, 50), key=repr)
    assert suffixes.remove_repeats(nothing, 50).count() == 0


def test_passages_of_over_50_words_go_by_their_bytes(spark, tmp_path):
    """Operator 10's contract fixes strings of 400 bytes, however many words a passage has; shorter ones are the pipeline's."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("bcdfgklmnprstaeiou") for _ in range(n))
    apart = lambda: " ".join(word(6) for _ in range(30))
    sizes = (399, 400, 153)
    passages = [" ".join(["", *(word(n // 60) for _ in range(50)), word(n - 50 * (n // 60) - 52), ""]) for n in sizes]
    assert [len(p) for p in passages] == list(sizes) and all(len(p.split()) == 51 for p in passages)
    data = [f"{apart()}{edge}{p}{edge}{apart()}" for p in passages for edge in "xyz"] + [apart()]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r) for r in queries.op10_repeated_strings(spark, str(tmp_path)).collect()}
    assert sorted(got.values()) == brute_repeats(data, 400)
    assert [got[i][2] for i in range(10)] == [0] * 3 + [400] * 3 + [0] * 4
    shorter = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(df, corpus_pipeline.REPEAT).collect()}
    assert [shorter[i] for i in range(10)] == [399] * 3 + [400] * 3 + [153] * 3 + [0]


def test_family_finds_what_one_array_finds():
    rng = np.random.default_rng(3)
    blobs = [rng.integers(97, 99, 40).astype(np.uint8) for _ in range(9)]
    family, serial = suffixes.Family(8), 0
    for b in blobs:
        family.add(b, np.arange(33), np.arange(serial, serial + 33))
        serial += 33
    owners, repeated = family.finish()
    windows = [b[i : i + 8].tobytes() for b in blobs for i in range(33)]
    count = Counter(windows)
    assert {int(o) for o in owners[repeated]} == {i for i, w in enumerate(windows) if count[w] > 1}
