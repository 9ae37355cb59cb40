"""Cases of single documents: detection, propagation, persons, addresses, dates, surrogates, verification."""

import random

import pytest

from veilframe.document import flow, rules
from veilframe.document.checks import Originals, fictional_phone, surrogate_problems, valid
from veilframe.document.cues import find_files
from veilframe.document.dates import canonical_date, date_delta, generalise_age, shift_date
from veilframe.document.persons import parse_name, resolve, split_token
from veilframe.document.search import Target, Targets, edit_budget, within
from veilframe.document.surrogates import Draws, Surrogates, forbidden_keys, project, scope_key
from veilframe.document.view import View, match_key
from veilframe.operators.documents import deidentified, settings_of

KEY = b"k" * 32


def mentions(text, profile="broad", **more):
    out = deidentified(text, settings_of(profile, "label"), None, **more)
    return [(m["entity_type"], m["value"]) for m in out["mentions"] if m["action"] != "keep"]


LINES = [
    ("Patient Name: SMITH, John Paul", "SMITH, John Paul", "person"),
    ("Surname: O'Brien  Given names: Mary Anne", "O'Brien", "person"),
    ("Next of Kin: Mrs Helen McDonald (wife)", "Helen McDonald", "person"),
    ("UR No: 00123456", "00123456", "clinical_id"),
    ("MRN: A1234567", "A1234567", "clinical_id"),
    ("D.O.B. 3/7/62", "3/7/62", "date_of_birth"),
    ("Born on 14 March 1978 in Dubbo", "14 March 1978", "date_of_birth"),
    ("Ph: 02 9999 1234", "02 9999 1234", "phone"),
    ("Mob 0412 555 666", "0412 555 666", "phone"),
    ("Contact +61 412 555 666 after hours", "+61 412 555 666", "phone"),
    ("IHI: 8003 6081 6669 0503", "8003 6081 6669 0503", "ihi"),
    ("ABN 51 824 753 556", "51 824 753 556", "abn"),
    ("TFN: 123 456 782", "123 456 782", "tfn"),
    ("Unit 3/45 Smith Street, Blacktown NSW 2148", "3/45 Smith Street", "street_address"),
    ("PO Box 77, Wagga Wagga NSW 2650", "PO Box 77", "street_address"),
    ("lives at 9 Ocean Pde, Coffs Harbour NSW 2450", "Coffs Harbour", "locality"),
    ("He was employed by Bunnings Warehouse in Penrith", "Bunnings Warehouse", "organisation"),
    ("Our Ref: JS:kl:20231187", "JS:kl:20231187", "reference"),
    ("Registration No: MED0001234567", "MED0001234567", "ahpra"),
    ("Specimen No 24-117733", "24-117733", "clinical_id"),
    ("Email: j.citizen@bigpond.com.au", "j.citizen@bigpond.com.au", "email"),
    ("Dear Mrs Nguyen,", "Nguyen", "person"),
    ("cc: Dr A. Wong, Orthopaedic Surgeon", "A. Wong", "person"),
]


@pytest.mark.parametrize(("line", "value", "entity"), LINES)
def test_value_is_found_with_its_type(line, value, entity):
    assert any(value in v and e == entity for e, v in mentions(line))


@pytest.mark.parametrize(
    "line",
    [
        "BP 120/80, HR 72, temperature 36.8 degrees.", "Range of motion was reduced to 50% of normal at L4-5 and C5/6.", "Ibuprofen 400mg three times daily; 12500IU vitamin D weekly.",
        "He was reviewed in 2019-2021 and again in March 2022.", "Tinel's sign and Phalen's test were negative; McMurray test positive.", "The claimant reports 7/10 pain.",
        "Software build 2.14.03.2023 installed", "Mr MRI scan", "", "  \n ",
    ],
)
def test_clinical_text_is_left(line):
    out = deidentified(line, settings_of("broad", "label"), None)
    assert out["text"] == line and not mentions(line)


@pytest.mark.parametrize(("line", "entity"), [("He was born on 14/03/1978.", "date_of_birth"), ("DOB 3.7.62. Seen today.", "date_of_birth")])
def test_dates_at_the_end_of_a_sentence(line, entity):
    assert [e for e, _ in mentions(line)] == [entity]


def test_labels_of_forms():
    text = "Patient name:\nJohn Andrew SMITH\nDate of birth:\n14/03/1978\nClaim No:\nWC1234567"
    assert mentions(text) == [("person", "John Andrew SMITH"), ("date_of_birth", "14/03/1978"), ("reference", "WC1234567")]
    assert not mentions("He attended the appointment today with his partner\nand they left at noon")
    cell = lambda line, text, x, y: [{"text": w, "page": 0, "line_no": line, "x0": x + 100 * i, "y0": y, "x1": x + 100 * i + 80, "y1": y + 50, "confidence": 0.99, "alternates": []} for i, w in enumerate(text.split())]
    rows = cell(0, "Surname:", 100, 100) + cell(1, "CITIZEN", 900, 100) + cell(2, "Medicare No:", 100, 220) + cell(3, "2953 70150 1", 900, 220)
    assert mentions("", tokens=rows) == [("person", "CITIZEN"), ("medicare", "2953 70150 1")]


def test_label_heads_lose_no_label():
    from veilframe.document import labels

    texts = [x[0] for x in LINES] + ["née Smith", "a.k.a. Bob: x", "Emergency contact: Al Jones", "D O B: 3/7/62", "d.o.d 1/2/2020", "P/code: 2000", "A/C No: 123", "Reg. No: AB12CD", "Hpi-i: 8003", "works for Acme Ltd"]
    for text in texts:
        low = text.lower()
        for rule, form, _, _ in labels._FORMS:
            assert not form.search(text) or any(h in low for h in labels._HEADS[rule]), (rule, text)


def test_propagation():
    text = "Claim No: WC1234567\nFurther to claim WC1234567 we enclose the report.\nRef WC 1234567 was reopened.\nThe file wc-1234567 is closed."
    assert [e for e, _ in mentions(text)] == ["reference"] * 4
    token = lambda i, w, line, alternates=(): {"text": w, "page": 0, "line_no": line, "x0": 100 + 100 * i, "y0": 100 + 60 * line, "x1": 190 + 100 * i, "y1": 150 + 60 * line, "confidence": 0.99, "alternates": list(alternates)}
    rows = [token(i, w, 0) for i, w in enumerate("Medicare No: 2953 70150 1".split())] + [token(i, w, 1, ["70150"] if w == "7O15O" else []) for i, w in enumerate("card 2953 7O15O 1 presented".split())]
    assert [e for e, _ in mentions("", tokens=rows)] == ["medicare", "medicare"]
    out = deidentified("Zelphinia attended with her sister.\nzelphinia was anxious.", settings_of("broad", "label", [("person", "Zelphinia")]), None)
    assert out["text"] == "[NAME 1] attended with her sister.\n[NAME 1] was anxious." and out["rounds"] == 1
    unsure = [{**token(i, w, 0), "confidence": 0.3 if w == "Sm?th" else 0.99} for i, w in enumerate("Re: Mr John Sm?th DOB 1/2/1980".split())]
    assert ("person", "John Sm?th") in mentions("", tokens=unsure)


def test_long_values_are_found_again():
    address = "12 Ocean Street, Coffs Harbour NSW 2450"
    assert sum(address in v for _, v in mentions(f"Address: {address}\nHe moved from {address} to town")) == 2


def test_fuzzy_search_equals_a_plain_one():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd1") for _ in range(n))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for _ in range(400):
        key = word(rng.randint(4, 30))
        other = list(key)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(other))
            other[i : i + 1] = rng.choice(["", "x", "xy"])
        other = "".join(other) or "q"
        d = distance(key, other)
        assert within(other, key, 3) == (d if d <= 3 else None)
        want = d <= edit_budget(len(key)) and 1 - d / max(len(key), len(other)) >= 0.88
        assert bool(Targets([Target(key, 1, "reference")]).find(View.of_text(other))) == (want or key == other)


def test_names_and_persons():
    roles = lambda words, title=None: [(p.core, p.role) for p in parse_name(words.split(), title)]
    assert roles("SMITH, John") == [("SMITH", "surname"), ("John", "given")]
    assert roles("John Andrew SMITH")[-1] == ("SMITH", "surname") and roles("J. Smith") == [("J.", "initial"), ("Smith", "surname")]
    assert roles("Ludwig van Beethoven")[1] == ("van", "surname") and roles("Smith", "Mr") == [("Smith", "surname")] and roles("John") == [("John", "given")]
    p = split_token("(Smith's,")
    assert (p.prefix, p.core, p.suffix) == ("(", "Smith", "'s,")
    text = "Re: Mr John Andrew SMITH DOB: 14/03/1978\nMr Smith attended with his wife Mrs Mary Smith.\nSmith reported that John was anxious; J. Smith signed the form.\nDr Peter Brown examined him."
    out = deidentified(text, settings_of("broad", "surrogate"), KEY)
    view = View.of_text(text)
    people = resolve(view, [(m["first"], m["last"]) for m in out["mentions"] if m["entity_type"] == "person"])
    of = {view.value(m.first, m.last): m for m in people.mentions}
    assert of["John"].cluster == of["John Andrew SMITH"].cluster == of["J. Smith"].cluster != of["Mary Smith."].cluster
    assert of["John Andrew SMITH"].gender == "m" and of["Mary Smith."].gender == "f"
    by = {m["value"]: m["by"] for m in out["mentions"]}
    surname = by["John Andrew SMITH"].split()[-1].title()
    assert by["Mary Smith."].split()[-1] == f"{surname}." and by["J. Smith"].split() == [by["John"][0] + ".", surname]


def test_professionals_are_kept_where_the_profile_says_so():
    text = "Re: Mr John SMITH\nDr Peter Brown FRACS, Orthopaedic Surgeon, examined him.\nCopy to: Ms Jane Citizen, Solicitor, for information.\nDr Alan Smith reviewed the scans."
    gone = {v for e, v in mentions(text, "claimant_focused") if e == "person"}
    assert "Peter Brown" not in gone and {"John SMITH", "Alan Smith"} <= gone
    assert "Peter Brown" in {v for e, v in mentions(text) if e == "person"}


@pytest.mark.parametrize(
    ("address", "place"),
    [
        ("12 Smith Street, Parramatta NSW 2150", 3), ("PO Box 77 Wollongong NSW 2500", 3), ("Parramatta NSW 2150", 0), ("12 Victoria Road, Gladesville NSW 2111", 3), ("8 Broadway, Ultimo NSW 2007", 2),
        ("3 Smith St, Castle Hill NSW 2154", 3), ("Unit 5, 12 Smith St Parramatta NSW", 5), ("8 Broadway Ultimo NSW", None), ("Unit 5, 8 Broadway Ultimo", None), ("12 Victoria Road, Ryde", None),
    ],
)
def test_places_of_addresses(address, place):
    assert flow.place_start(address.split()) == place


@pytest.mark.parametrize(
    ("value", "days", "moved"),
    [
        ("14/03/2023", 47, "30/04/2023"), ("3.7.62", 47, "19.8.62"), ("14-03-23", -14, "28-02-23"), ("2023-03-14", -40, "2023-02-02"), ("14th March 2023", 47, "30th April 2023"), ("14 SEPT 2021", 47, "31 OCT 2021"),
        ("March 14, 2023", 47, "April 30, 2023"), ("Mar 2023", 47, "May 2023"), ("28/02/2024", 1, "29/02/2024"), ("31/12/2023,", 1, "01/01/2024,"), ("2019", 200, "2019"), ("31/02/2023", 10, "[date]"), ("next Tuesday", 10, "[date]"), ("", 3, "[date]"),
    ],
)
def test_dates_move_in_their_layout(value, days, moved):
    assert shift_date(value, days) == moved
    if "/" in value and moved != "[date]":
        assert date_delta(value, moved) == days


def test_canonical_dates_and_ages():
    assert [canonical_date(x) for x in ("14/03/1978", "14 March 1978", "3.7.62", "14th Mar, 1978", "no")] == ["1978-03-14", "1978-03-14", "1962-07-03", "1978-03-14", None]
    assert [generalise_age(x) for x in ("aged 92", "101 years old", "a 45-year-old", "90yo")] == ["aged 90+", "90+ years old", "a 45-year-old", "90+yo"]


def test_offsets_avoid_what_looks_like_a_leak():
    from veilframe.document.dates import choose_offset, leak_needles

    draws = Draws(KEY)
    index = lambda purpose, size, attempt: draws.index("date_shift", purpose, size, attempt)
    days = choose_offset(index, ["14/03/2023", "1/2/2020"], [])
    assert 30 <= abs(days) <= 365 and days == choose_offset(index, ["14/03/2023"], ["x"])
    assert choose_offset(index, ["14/03/2023"], [shift_date("14/03/2023", days)]) not in (0, days)
    assert choose_offset(lambda purpose, size, attempt: 0, ["14/03/2023"], [shift_date("14/03/2023", -30)]) == 0  # none is left
    assert leak_needles(["a b", "wc-12", "12 34 56"]) == {"wc12", "123456"}


def test_long_documents_take_time_in_proportion():
    import time

    lines = [(f"Dr Mary Jon{i % 50}es attended on 14/03/2023.", f"Claim No: WC{i:06d}7 of Mr Bro{'abcdefgh'[i % 8] * 2}wn", f"Ph: 02 9999 {i:04d} and more words here")[i % 3] for i in range(1500)]
    began = time.time()
    out = deidentified("\n".join(lines), settings_of("maximal", "surrogate"), KEY)
    assert len(out["mentions"]) > 2000 and time.time() - began < 30


def test_allow_list_and_refinement():
    from veilframe.document.allowlist import allowlisted, refine

    yes = [("Tinel's sign", 0, "person"), ("Tinel and Phalen tests", 2, "person"), ("Colles fracture", 0, "person"), ("Panadeine Forte", 1, "organisation"), ("Targin 10 mg", 2, "person"), ("Medicare", 0, "organisation"), ("SIRA", 0, "organisation"), ("Sydney", 0, "locality")]
    no = [("Mr Baker", 1, "person"), ("Baker reported", 0, "person"), ("Blacktown", 0, "locality"), ("Bunnings Warehouse", 1, "organisation"), ("Tinel's sign", 0, "phone")]
    assert all(allowlisted(View.of_text(t), 0, last, e) for t, last, e in yes) and not any(allowlisted(View.of_text(t), min(0, last), last, e) for t, last, e in no)
    assert refine(View.of_text("Dr Peter Brown FRACS"), 0, 3, "person") == (1, 2, "person")
    assert refine(View.of_text("Westmead Hospital"), 0, 1, "ihi") == (0, 1, "organisation") and refine(View.of_text("nothing here"), 0, 1, "medicare") is None
    model = [{"start": 0, "end": 7, "entity_type": "person", "detector": "ner.model", "rule": "ner", "strength": 2, "score": 0.9}]
    assert not mentions("Tinel's sign was negative", rows=model) and mentions("Karloff went", rows=model) == [("person", "Karloff")]


def test_paths():
    found = lambda t: [(View.of_text(t).text[f.start : f.end], f.rule) for f in find_files(View.of_text(t))]
    assert ("S:\\Clients\\Smith J\\IME report.docx", "file.windows") in found("S:\\Clients\\Smith J\\IME report.docx and sent")
    assert ("C:\\Users\\John Smith", "file.windows") in found("in C:\\Users\\John Smith and sent")
    assert ("/Users/jsmith/Smith Family/report.pdf", "file.posix") in found("see /Users/jsmith/Smith Family/report.pdf.")
    assert ("notes_1.docx", "file.name") in found("see notes_1.docx, please")


def test_surrogates_are_safe():
    text = "\n".join(x[0] for x in LINES)
    settings = settings_of("maximal", "surrogate")
    out = deidentified(text, settings, KEY)
    assert out["leaks"] == out["unsafe"] == out["residual"] == out["changed"] == 0
    assert out == deidentified(text, settings, KEY) and out["text"] != deidentified(text, settings, scope_key(KEY, "other"))["text"]
    by = {(m["entity_type"], m["value"]): m["by"] for m in out["mentions"]}
    assert fictional_phone(by["phone", "02 9999 1234"]) and by["email", "j.citizen@bigpond.com.au"].endswith(("example.com", "example.org", "example.net"))
    for entity, value in (("ihi", "8003 6081 6669 0503"), ("abn", "51 824 753 556"), ("tfn", "123 456 782")):
        assert valid(entity, value) and not valid(entity, by[entity, value]) and len(by[entity, value]) == len(value)
    made = deidentified("Unit 3/45 Ocean Street, Blacktown NSW 2148", settings_of("broad", "surrogate"), KEY)["text"]
    assert made.startswith("Unit ") and " Street, " in made and made.split()[-2] == "NSW" and not {"Ocean", "Blacktown", "2148"} & set(made.split())


def test_surrogates_keep_layouts_and_differ():
    view = View.of_text("x")
    make = lambda: Surrogates(Draws(KEY), forbidden_keys(view, [], resolve(view, [])), resolve(view, []), view)
    s = make()
    a, b = s.identifier("reference", "WC1234567"), s.identifier("reference", "WC 1234567,")
    assert match_key(a) == match_key(b) and b[2] == " " and b[-1] == ","
    assert len({s.identifier("reference", f"WC{i}") for i in range(1000, 1200)}) == 200
    assert project("ab-12", "X9Y8") == "x9-Y8" and s.phone("+61 412 555 666").startswith("+61 4") and s.phone("(02) 9999 1234").startswith("(02) ")
    assert s.file_path("S:\\Clients\\Smith J\\report.docx").startswith("S:\\Clients\\") and s.file_path("S:\\Clients\\Smith J\\report.docx").endswith(".docx")
    assert s.organisation("Bunnings Warehouse Pty Ltd").endswith(" Warehouse Pty Ltd") and s.birth_date("14/03/1978").endswith("/1978")
    assert s.email("info@clinic.com.au").startswith("info@example.") and s.url("http://a.b/c").startswith("www.example.")


def test_near_originals():
    near = Originals(["smith", "john", "wc1234567"]).near
    assert all(map(near, ("smith", "smyth", "smiths", "wc123457", "wc1234568", "john"))) and not any(map(near, ("jon", "brown", "wc9934567", "smit")))


@pytest.mark.parametrize(
    ("items", "shifted", "ages", "problem"),
    [
        ([("person", "Smyth", ["Smyth"])], [], [], "collision"), ([("tfn", "123 456 782", [])], [], [], "checksum_valid"), ([("phone", "02 9999 1234", [])], [], [], "phone_not_reserved"),
        ([("email", "a@big.com", [])], [], [], "domain_not_reserved"), ([], [("14/03/2023", "15/03/2023"), ("14/03/2023", "16/03/2023")], [], "date_shift_inconsistent"),
        ([], [("14/03/2023", "14/03/1978")], [], "date_collision"), ([], [], ["aged 92"], "age_not_top_coded"),
    ],
)
def test_each_surrogate_check_fails_for_its_reason(items, shifted, ages, problem):
    found = surrogate_problems(items, {"smith", match_key("14/03/1978")}, shifted, ages)
    assert {k for k, n in found.items() if n} == {problem}


def test_residuals_and_leaks():
    settings = settings_of("broad", "label")
    seen = View.of_text("John Sm1th came. Mr Alan Karloff too")
    found = flow.residuals(seen, [], [("Alan Karlof", "person", 2)], [], [], [], settings)
    assert {seen.tokens[i].text for i in found} == {"Alan", "Karloff"}
    assert flow.residuals(seen, [(0, len(seen.text))], [("Alan Karlof", "person", 2)], [], [], [], settings) == set()
    strong = [flow.Candidate(0, 1, "person", flow.Evidence("d", "r", 2, 1.0))]
    assert flow.residuals(seen, [], [], strong, [], [], settings) == {0, 1} and not flow.residuals(seen, [], [], strong, ["John Sm1th"], [], settings) and not flow.residuals(seen, [], [], strong, [], ["John Sm1th"], settings)
    assert flow.text_leaks("a WC-1234567 b\nno", ["wc1234567"]) == 2 and flow.text_leaks("12 34\n56 x", ["123456"]) == 0


def test_rules_equal_the_column_expressions(spark):
    from veilframe.operators import detectors

    texts = [x[0] for x in LINES] + ["TFN 123 456 782 and 000000019 ok", "aged 92, 45 years old, 90yo", "ref A-123456 on 2023-03-14", "card 4111 1111 1111 1111; 10.0.0.1", "Mob O412 S55 666", "13 12 34 call 9999 1234", "died 3 March 2020; Mar 5, 2021 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for names in (["medicare", "ihi", "nine", "abn"], ["crn", "card", "ipv4", "ndis"], ["mobile", "landline", "thirteen", "local8", "international"], ["email", "numeric_date", "iso_date", "dmy_date", "mdy_date"], ["generic", "aged", "years_old", "yo"]):
        want = {(r["doc_id"], r["start"], r["end"], r["entity_type"], r["rule"], r["strength"]) for r in detectors.detect(docs, names).collect()}
        got = {(i, h.start, h.end, h.entity_type, h.rule, h.strength) for i, t in enumerate(texts) for h in rules.scan(View.of_text(t), names)}
        assert got == want, names


def test_values_one_by_one_are_those_of_all_windows():
    import random

    from veilframe.document import search

    r, words = random.Random(5), ["abab", "ab", "1ab", "cabc", "abcabcab", "b1", "-", "\n", ".\n", "aabbcc1"]
    for floor in (search.FLOOR, search.RESIDUAL_FLOOR):
        for _ in range(300):
            view = View.of_text(" ".join(r.choices(words, k=25)))
            values = [(k, size) for size in (1, 2, 3) if len(k := "".join(r.choices(words[:6], k=size))) > 3]
            targets = Targets([search.Target(k, size, "person") for k, size in values], floor)
            assert targets.find(view) == targets._find_by_windows(view)


def test_labels_are_tried_where_words_begin_like_one():
    from unittest import mock

    from veilframe.document import labels

    words = sorted(h for heads in labels._HEADS.values() for h in heads)
    texts = [" ".join(words), "\n".join(f"{w}: 1" for w in words).upper(), "ſubject: A\nİnsured: B\nDate of Birth 1/2/1990 d.o.b. Our ref: 12", "xxxx " * 99 + "Claim No: 12"]
    for text in texts:
        found = [[(m.span(), rule) for m, rule, *_ in labels._label_matches(text)] for labels._A_TRY in (0, 1 << 30)]
        assert sorted(found[0]) == sorted(found[1]) and found[0]
    labels._A_TRY = 6
    with mock.patch.object(labels, "_FORMS", [(rule, mock.Mock(wraps=form), entity, kind) for rule, form, entity, kind in labels._FORMS]):
        assert [rule for _, rule, *_ in labels._label_matches(texts[-1])] == ["label.claim"]
        assert not any(form.finditer.called for _, form, _, _ in labels._FORMS)
