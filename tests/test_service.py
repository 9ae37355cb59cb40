"""The service's edges: links, logs, errors, configurations, registries, the command line, model outputs, streams."""

import logging
import pickle

import pytest
from pyspark.sql import functions as F

from veilframe import service
from veilframe.document.view import View
from veilframe.sources import files as S

KEY = b"s" * 32


def test_links_are_for_one_file_until_a_time():
    token = service.signed(KEY, "download", "job1", "out.pdf", 1000)
    assert service.verified(KEY, "download", "job1", "out.pdf", token, now=999)
    wrong = [("upload", "job1", "out.pdf", token, 999), ("download", "job2", "out.pdf", token, 999), ("download", "job1", "in.pdf", token, 999), ("download", "job1", "out.pdf", token, 1001), ("download", "job1", "out.pdf", "9999." + token[5:], 999), ("download", "job1", "out.pdf", "x", 999)]
    assert not any(service.verified(KEY, p, j, n, t, now=now) for p, j, n, t, now in wrong)


def test_logs_and_errors_say_nothing_of_a_document():
    record = logging.LogRecord("other", logging.WARNING, "x", 1, "cannot read %s", ("John Smith",), None)
    assert "John" not in service.PlainFormatter().format(record)
    record.fields = {"documents": 3, "text": "John Smith", "job": "a\nb", "seconds": "John"}
    assert service.PlainFormatter().format(record) == "WARNING other documents=3"
    try:
        raise ValueError("John Smith")
    except ValueError as e:
        assert service.sanitised(e).startswith("ValueError test_logs") and "John" not in service.sanitised(e)
    assert pickle.loads(pickle.dumps(service.CodeError("too_large"))).code == "too_large"


def test_configurations():
    config = S.merged({"a": {"b": 1, "c": [1]}, "workers": 4}, {"a": {"c": [2]}})
    assert config == {"a": {"b": 1, "c": [2]}, "workers": 4} and S.override(config, ["a.b=7", "a.d=x"])["a"] == {"b": 7, "c": [2], "d": "x"}
    assert S.config_hash(config) == S.config_hash({**config, "workers": 9}) != S.config_hash({"a": {"b": 2, "c": [2]}})


def test_files(spark, rows, tmp_path):
    from veilframe.sources import lines as L

    (tmp_path / "pool.txt").write_text("# names\nAnn\n\n  Bob  \n")
    assert rows(L.pool(spark, str(tmp_path / "pool.txt"))) == [("Ann",), ("Bob",)]
    (tmp_path / "seeds.json").write_text('[{"type": "person", "value": "Ann"}]')
    assert rows(L.seeds(spark, str(tmp_path / "seeds.json"))) == [("person", "Ann")]
    for name, data in (("a.pdf", b"x%PDF-1.4"), ("b.png", b"\x89PNG\r\n\x1a\n.."), ("c.jpg", b"\xff\xd8\xff\xe0"), ("d.tif", b"II*\x00.."), ("e.txt", b"text"), ("f.bin", b"")):
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rpartition("/")[2]: r["format"] for r in L.files(spark, str(tmp_path)).collect()}
    assert {k: found[k] for k in ("a.pdf", "b.png", "c.jpg", "d.tif", "e.txt")} == {"a.pdf": "pdf", "b.png": "png", "c.jpg": "jpeg", "d.tif": "tiff", "e.txt": None} and "f.bin" not in found
    refused = spark.createDataFrame([("a", 0, 1, False), ("b", 10, 1, True), ("c", 10, 4000, False), ("d", 10, 1, False)], "path string, length long, n_pages int, encrypted boolean")
    assert rows(S.refused(refused)) == [("a", "empty"), ("b", "encrypted"), ("c", "too_many_pages")]


def test_command_line(spark, rows, tmp_path, capsys):
    spark.createDataFrame([(1, "write to a@b.org"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    assert service.main(["run", str(tmp_path / "in"), str(tmp_path / "out"), "--seed", "person=write"]) == service.QUARANTINED
    assert rows(spark.read.parquet(str(tmp_path / "out/released"))) == [(1, "[NAME 1] to [EMAIL 1]")]
    assert rows(spark.read.json(str(tmp_path / "out/quarantined")), "doc_id", "reasons") == [(2, ["no_text"])]
    assert service.main(["run", str(tmp_path / "nothing"), str(tmp_path / "out2")]) == service.FAILED and str(tmp_path) not in capsys.readouterr().err
    assert service.main(["profiles"]) == service.DONE


def test_models_are_providers(spark, rows):
    from veilframe.plans.flow import deidentify

    def load():
        return lambda texts: [[(t.find("Karloff"), t.find("Karloff") + 7, "person", 0.9)] if "Karloff" in t else [] for t in texts]

    docs = spark.createDataFrame([(1, "then Karloff went " + "on " * 400 + "and Karloff came"), (2, "Tinel's sign"), (3, "")], "doc_id long, text string")
    out = S.model_candidates(docs, load, "test", 300, 50)
    assert [len(r["candidates"]) for r in out.orderBy("doc_id").collect()] == [2, 0, 0]
    assert rows(deidentify(out)["output"])[0][1].count("[NAME 1]") == 2


def test_stream_of_documents(spark, rows, tmp_path):
    from veilframe.streaming.documents import deidentify_stream

    spark.createDataFrame([(1, "mail a@b.org"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    deidentify_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out/released")), "doc_id", "text") == [(1, "mail [EMAIL 1]")]
    assert rows(spark.read.json(str(tmp_path / "out/quarantined")), "doc_id") == [(2,)]


def test_biases_and_windows(spark, rows):
    import numpy as np

    from veilframe.operators.decoders import best_path, bias_matrix, stitched

    labels = ["O", "B-x", "I-x", "E-x", "S-x"]
    scores = np.array([[0.0, 0.1, 0.0, 0.0, 0.2], [0.0, 0.0, 0.0, 0.1, 0.0]])
    assert best_path(scores, labels, bias_matrix(labels, {"inside_to_end": 5.0})) == [1, 3] and best_path(scores, labels, bias_matrix(labels, {"outside_to_outside": 5.0})) == [0, 0]
    with pytest.raises(ValueError):
        bias_matrix(labels, {"none": 1.0})
    windows = spark.createDataFrame([(1, 0, 0, 2, [[1.0], [2.0], [9.0]]), (1, 1, 2, 3, [[9.0], [3.0]])], "doc_id long, first int, low int, high int, scores array<array<double>>")
    assert rows(stitched(windows)) == [(1, 0, [1.0]), (1, 1, [2.0]), (1, 2, [3.0])]


def test_readings(spark, rows):
    from veilframe.operators import readers as R

    chars = spark.createDataFrame([("t", 0, "O", [("0", 0.3)]), ("t", 1, "l", [("1", 0.4), ("I", 0.1)]), ("u", 0, "x", [])], "token string, position int, char string, alternatives array<struct<char: string, prob: double>>")
    assert rows(R.token_alternates(chars)) == [("t", ["O1", "0l", "OI", "01"]), ("u", [])]
    spans = spark.createDataFrame([(1, 0, 2, "a", 0.9), (1, 2, 3, "b", 0.95), (1, 4, 5, "a", 0.4), (1, 5, 6, "a", 0.4), (1, 7, 7, "a", 0.2)], "doc_id long, first int, last int, label string, score double")
    assert rows(R.decode_spans(spans)) == [(1, 2, 3, "b", 0.95), (1, 4, 5, "a", 0.4)]
    regions = spark.createDataFrame([(1, 0, "stamp", 20, 0, 0, 10, 10), (1, 0, "stamp", 20, 15, 0, 30, 10), (1, 0, "stamp", 20, 35, 0, 40, 10), (1, 0, "stamp", 20, 90, 0, 95, 10)], "doc_id long, page int, kind string, line_height int, x0 int, y0 int, x1 int, y1 int")
    assert rows(R.merge_regions(regions), "x0", "x1") == [(0, 40), (90, 95)]
    text = spark.createDataFrame([(0, "plain"), (1, "bad"), (2, "a^^^^"), (3, ""), (4, "né-1")], "i int, t string").select("i", R.plausible_text(F.col("t")))
    assert [r[1] for r in rows(text)] == [True, False, False, False, True]


def test_tokens_of_readers_keep_their_pages():
    rows = [{"text": w, "page": p, "line_no": line, "x0": 0, "y0": 0, "x1": 1, "y1": 1} for w, p, line in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0))]
    view = View.of_rows(rows)
    assert view.text == "a\nb\n\nc" and [view.text[t.start : t.end] for t in view.tokens] == ["a", "b", "c"]
