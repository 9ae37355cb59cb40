"""Persons and addresses."""

from veilframe.operators.people import detect_addresses, detect_persons


def test_persons(spark):
    lines = {
        1: "Dear Mrs Nguyen,", 2: "cc: Dr A. Wong, Orthopaedic Surgeon", 3: "Re: Mr John Andrew SMITH DOB: 14/03/1978", 4: "seen by Dr Peter Brown FRACS today",
        5: "Mr Ludwig van Beethoven attended", 6: "Kind regards,\n\nMary Anne O'Brien\nSolicitor", 7: "the doctor and mr nobody", 8: "",
    }
    docs = spark.createDataFrame(list(lines.items()), "doc_id long, text string")
    found = {}
    for r in detect_persons(docs).collect():
        assert lines[r["doc_id"]][r["start"] : r["end"]] == r["value"]
        found.setdefault(r["doc_id"], set()).add(r["value"])
    assert found == {1: {"Nguyen"}, 2: {"A. Wong"}, 3: {"John Andrew SMITH"}, 4: {"Peter Brown"}, 5: {"Ludwig van Beethoven"}, 6: {"Mary Anne O'Brien"}}


def test_addresses(spark):
    lines = ["Unit 3/45 Smith Street, Blacktown NSW 2148", "lives at 9 Ocean Pde, Coffs Harbour NSW 2450", "12 Smith St Parramatta NSW 2150", "office in Sydney NSW 2000", "nothing"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {(r["doc_id"], r["entity_type"], r["value"]) for r in detect_addresses(docs).collect()}
    assert found >= {
        (0, "street_address", "Unit 3/45 Smith Street"), (0, "locality", "Blacktown"), (0, "postcode", "2148"), (1, "street_address", "9 Ocean Pde"), (1, "locality", "Coffs Harbour"),
        (2, "street_address", "12 Smith St"), (2, "locality", "Parramatta"), (3, "postcode", "2000"),
    }
    assert not {f for f in found if f[1] == "locality" and f[0] in (3, 4)}
