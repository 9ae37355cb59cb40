"""Registered queries on small tables: nothing of their job is left out."""

import hashlib
import json

import duckdb
import pytest

import __spark_entry__ as entry

TEXT = "Mob 0412 555 666, seen by Dr Peter Brown today. DOB: 14/03/1978, lives at 9 Ocean Pde, Coffs Harbour NSW 2450"
LABELLED = "Mob [PHONE 1], seen by Dr [NAME 1] today. DOB: [DATE OF BIRTH 1], lives at [ADDRESS 1], [PLACE 1] NSW [POSTCODE 1]"
TYPES = {"phone", "person", "date_of_birth", "street_address", "locality", "postcode"}


@pytest.fixture(scope="module")
def one(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("one"))
    spark.createDataFrame([(1, TEXT, None)], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


def test_all_rules_replace(spark, rows, one):
    from veilframe.plans.flow import deidentify

    assert rows(deidentify(spark.read.parquet(f"{one}/documents.parquet"))["output"]) == [(1, LABELLED)]
    every = entry.queries()["q_deidentify_all"](spark, one).collect()
    assert {(r["profile"], r["style"]) for r in every} == {(p, s) for p in ("broad", "client", "claimant_focused", "maximal") for s in ("label", "surrogate", "blackout")}
    assert {r["action"] for r in every if r["profile"] == "maximal" and r["entity_type"] == "date_of_birth"} == {"shift_date"}


def test_all_rules_reach_surrogates_and_manifest(spark, one):
    assert {r["entity_type"] for r in entry.queries()["q_surrogates"](spark, one).collect()} == TYPES
    (row,) = entry.queries()["q_manifest_canonical"](spark, one).collect()
    assert {m["entity_type"] for m in json.loads(row["manifest"])["mentions"]} == TYPES


def test_no_language_is_left_out(spark, rows, tmp_path):
    texts = ["TOKEN of MARY", "Le TOKEN de JEAN", "El token", "Der THEREIN, token"]
    data = list(zip(range(4), texts, ["en", "fr", None, "de"], strict=True))
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seeds = entry.queries()["q_seed_match"](spark, str(tmp_path))
    assert rows(seeds) == [(0, "token", 1), (1, "token", 1), (2, "token", 1), (3, "therein", 1), (3, "token", 1)]
    cased = ["Token of Mary", "Le Token de Jean", "El token", "Der Therein, token"]
    assert rows(entry.queries()["q_titlecase"](spark, str(tmp_path))) == [(i, hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(cased)]


def test_no_name_is_left_out(spark, rows, tmp_path):
    data = [(i, i % 3, f"Customer#{i:09d}") for i in range(1, 31)]
    spark.createDataFrame(data, "c_custkey long, c_nationkey int, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    assert rows(entry.queries()["q_propagate_exact"](spark, str(tmp_path))) == [(i, 10, 10) for i in range(3)]


def test_long_values_and_their_neighbours_are_found(spark, rows):
    from veilframe.operators import propagate

    long = "12 Ocean Street, Coffs Harbour NSW 2450"
    docs = spark.createDataFrame([(1, f"{long}\n12 Ocean Street , Coffs Harbour NSW 2450\n\n12 OceanStreet, Coffs Harbour NSW 2450\n12 O cean Street Coffs Harbour NSW 2450\n12 Ocean Street")], "doc_id long, text string")
    values = spark.createDataFrame([(1, "street_address", long)], "doc_id long, entity_type string, value string")
    # a token of punctuation isn't taken up into a longer run; the blank line has no place in the view
    assert set(rows(propagate.exact(docs, values), "start", "raw_start", "size")) == {(0, 0, 7), (81, 82, 6), (120, 121, 8)}


def test_flow_propagates(spark, rows):
    from veilframe.plans.flow import deidentify

    docs = spark.createDataFrame([(1, "seen by Dr Peter Brown today.\n\n Then Peter  Brown left; PETER BROWN slept"), (2, "Peter Brown")], "doc_id long, text string")
    assert rows(deidentify(docs)["output"]) == [(1, "seen by Dr [NAME 1] today.\n\n Then [NAME 1] left; [NAME 1] slept"), (2, "Peter Brown")]


def test_card_numbers_beside_other_digits(spark, rows, tmp_path):
    from veilframe.operators.detectors import detect

    card = "4451718024887799"
    texts = [f"{card} 27.65.93.188", f"99.114.106.61 {card}", card, f"x{card}", f"{card}_", "4111 1111 1111 1111", f"4111 1111 1111 1111 {card}", f"é{card}é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = detect(docs, ["card"]).where("view = 'line'")
    spaced = "4111 1111 1111 1111"
    assert rows(found, "doc_id", "value") == [*[(i, card) for i in range(5)], (5, spaced), (6, spaced), (6, card), (7, card)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(entry.queries()["q_card_luhn"](spark, str(tmp_path)), "n", "sum_start", "sum_end") == [(5, 35, 115)]


def test_seeds_are_counted_as_written_in_every_row(spark, rows, tmp_path):
    # three words aren't the value, even where two are; ids may repeat or be null; a mark is no letter
    data = [(1, "The rein is the re in"), (2, "token"), (2, "to ken\nlicense"), (None, "Token, to-ken"), (3, "tokén ｔoken"), (4, None), (5, "to . ken")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seeds = entry.queries()["q_seed_match"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = [(1, "therein", 1), (2, "token", 2), (2, "license", 1), (None, "token", 2), (3, "token", 1)]
    assert rows(seeds) == sorted(duck.sql(entry.oracle_sql()["q_seed_match"]).fetchall(), key=repr) == sorted(want, key=repr)


def test_equal_spans_are_in_one_island(spark, rows, tmp_path):
    # the SQL orders twice and leaves the order of equal rows open, so the islands are written out here
    parts = [(0, 1), (5, 1), (15, 2), (40, 1), (50, 1)]
    data = [(7, p, n, 10.0) for p, n in parts for _ in range(50)]
    spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = [(7, 1, 0, 15, 100), (7, 2, 15, 25, 50), (7, 3, 40, 50, 50), (7, 4, 50, 60, 50)]
    assert rows(entry.queries()["q_fusion_islands"](spark, str(tmp_path))) == want


def test_equal_names_are_compared_once(spark, rows, tmp_path):
    # copies of names count as often as they stand there, without a pair for each two of them
    data = [(i, i % 2, f"Customer#{i % 20:09d}") for i in range(60_000)] + [(1, None, "Customer#000000001"), (2, 1, None)]
    spark.createDataFrame(data, "c_custkey long, c_nationkey int, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.sql("CREATE TABLE customer AS SELECT i AS c_custkey, CAST(i % 2 AS INTEGER) AS c_nationkey, 'Customer#' || lpad(CAST(i % 20 AS VARCHAR), 9, '0') AS c_name FROM range(20) r(i)")
    want = [(nation, n * 3000 * 3000) for nation, n in duck.sql(entry.oracle_sql()["q_propagate_fuzzy"]).fetchall()]
    assert rows(entry.queries()["q_propagate_fuzzy"](spark, str(tmp_path))) == sorted(want, key=repr)


def test_profiles_and_styles_read_a_document_once(spark, rows):
    from unittest import mock

    from veilframe.operators import documents
    from veilframe.plans.flow import deidentify, deidentify_each

    key, wanted = bytes(32), [(p, s) for p in ("broad", "client", "claimant_focused", "maximal") for s in ("label", "surrogate", "blackout")]
    docs = spark.createDataFrame([(1, TEXT), (2, "seen by Dr Peter Brown, aged 93.\nBrown left on 14/03/2023"), (3, None)], "doc_id long, text string")
    done, _ = deidentify_each(docs, wanted, key)
    for profile, style in (("client", "label"), ("maximal", "surrogate"), ("maximal", "blackout")):
        alone = deidentify(docs, profile, style, key=key)["documents"]
        assert rows(done.where((done["profile"] == profile) & (done["style"] == style)), *alone.columns) == rows(alone)
    with mock.patch.object(documents, "_candidates", wraps=documents._candidates) as scans:
        known = {}
        for w in wanted:
            documents.deidentified(TEXT, documents.settings_of(*w), key, known=known)
    # the text once, and each output that differs from the others
    assert sum(c.args[0].text == TEXT for c in scans.call_args_list) == 1 and len(scans.call_args_list) <= 1 + len(wanted)


def test_windows_of_other_lengths_are_passed_over():
    from unittest import mock

    from veilframe.document.search import Target, Targets
    from veilframe.document.view import View

    targets = Targets([Target("peterbrownsmith", 3, "person")])
    view = View.of_text("a b c d e f g Peter Brown Smyth and PeterBrown Smith")
    with mock.patch.object(targets, "_fuzzy", wraps=targets._fuzzy) as fuzzy:
        assert [(h.first, h.last, h.rule) for h in targets.find(view)] == [(11, 12, "mention.exact"), (7, 9, "mention.fuzzy")]
    assert fuzzy.call_count < 10


def test_documents_of_one_task_are_dealt_to_all(spark, rows):
    from veilframe.plans.flow import deidentify

    docs = spark.createDataFrame([(i, f"Mob 0412 555 {i:03d}") for i in range(200)], "doc_id long, text string").coalesce(1)
    done = deidentify(docs)["output"]
    assert len(done.inputFiles()) > 4
    assert rows(done) == sorted([(i, "Mob [PHONE 1]") for i in range(200)], key=repr)


def test_outputs_that_read_alike_are_detected_once():
    from unittest import mock

    from veilframe.operators import documents

    settings = documents.settings_of("broad", "label")
    documents._output_candidates.cache_clear()
    with mock.patch.object(documents, "_candidates", wraps=documents._candidates) as scans:
        made = [documents.deidentified(f"seen by Dr {name}, aged 40, Mob 0412 555 {i:03d}", settings, None) for i, name in enumerate(("Peter Brown", "Mary Jones", "Anna Smith"))]
    assert {m["text"] for m in made} == {"seen by Dr [NAME 1], aged 40, Mob [PHONE 1]"}
    assert scans.call_count == 4 and not any(m["residual"] or m["leaks"] for m in made)
    seen, _ = documents._output_candidates(made[0]["text"])
    # an output that still holds a value isn't passed over, whatever was known of one that reads alike
    assert "brown" not in str(seen.known_hits) and "jones" not in str(seen.known_hits)


def test_names_meet_only_what_is_within_the_edits():
    import random
    from unittest import mock

    import numpy as np

    from veilframe.operators import propagate

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, x in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        return row[-1]

    def similar(a, b, floor):
        n, d = len(b), distance(a, b)
        return 0 < d <= (0 if n < 6 else 1 if n < 10 else 2 if n < 16 else 3) and 1 - d / max(len(a), n) >= floor

    r = random.Random(3)
    for least, most in ((0, 9), (8, 13), (14, 19), (24, 28)):
        base = "".join(r.choices("abé😀1", k=most))
        words = {base[: r.randint(least, most)] for _ in range(5)}
        words |= {w[:i] + r.choice(("", "x", "a", "xé")) + w[i + r.randint(0, 2) :] for w in sorted(words) for i in r.choices(range(len(w) + 1), k=9)}
        words = sorted(words)
        counts = [r.randint(1, 3) for _ in words]
        for floor in (0.8, propagate.FLOOR):
            want = sum(x * y for a, x in zip(words, counts, strict=True) for b, y in zip(words, counts, strict=True) if similar(a, b, floor))
            for propagate.PLACES in (8, 1 << 18):
                assert propagate.similar_pairs(words, counts, words, counts, floor) == want
    keys = [f"customer{i:09d}" for i in r.sample(range(100_000), 4000)]
    with mock.patch.object(propagate.np, "minimum", wraps=np.minimum) as steps:
        propagate.similar_pairs([k[:-1] + "x" for k in keys], [1] * 4000, keys, [1] * 4000)
    # of the table of each pair, of 17 by 5 entries, fewer than three
    assert sum(len(c.args[0]) for c in steps.call_args_list) < 3 * 4000 * 4000


def test_islands_of_unknown_places_and_parts_are_those_of_the_sql(spark, rows, tmp_path):
    import random

    r = random.Random(7)
    some = lambda values: r.choice([None, *values])
    data = {(r.choice([1, 2, 3, None]), some((0, 10, 11, 405, -3)), some((1.5, 2.5, 3.49, 9.51, 20.0)), some(range(5))) for _ in range(160)}
    # rows that an order by start, end and rule leaves equal are taken once
    data = sorted({(d, None if p is None else int(p % 400 if p >= 0 else -(-p % 400)), None if None in (p, q) else round((p % 400 if p >= 0 else p) + q), n): (d, p, q, n) for d, p, q, n in data}.values(), key=repr)
    spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.sql(f"SELECT doc_id, island, low, high, n FROM ({entry.oracle_sql()['q_fusion_islands']})").fetchall()
    assert rows(entry.queries()["q_fusion_islands"](spark, str(tmp_path)), "doc_id", "island", "low", "high", "n") == sorted(want, key=repr)
