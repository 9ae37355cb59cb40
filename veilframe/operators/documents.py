"""Documents de-identified one by one, each whole within a task; no shuffle but the count of equal ids."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from copy import copy
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..document import flow
from ..document.persons import SURNAME
from ..document.rules import scan, scan_addresses
from ..document.search import Targets
from ..document.surrogates import forbidden_keys
from ..document.view import View, match_key
from ..tables import bounded_batches
from .fusion import LOW_RISK, TYPES
from .policy import KEEP_PROFESSIONALS, LABELS, actions_of

#: Rows that are Python objects at a time.
ROWS = 128
EVIDENCE = "array<struct<detector: string, rule: string, strength: int, score: double>>"
MENTION = f"first: int, last: int, start: int, end: int, entity_type: string, value: string, strength: int, evidence: {EVIDENCE}"
#: One row a document: its output, what was found and done, the problems of each check, and an error's class.
ROW = (
    f"doc_id long, text string, rounds int, days int, mentions array<struct<{MENTION}, action: string, by: string, cluster: string>>, "
    f"low array<struct<{MENTION}>>, leaks int, residual int, replans int, unsafe int, changed int, error string"
)


def settings_of(profile: str, style: str, seeds: list[tuple[str, str]] | None = None) -> flow.Settings:
    ranks = {t: i for i, t in enumerate(TYPES)}
    return flow.Settings(actions_of(profile), style, profile in KEEP_PROFESSIONALS, ranks, frozenset(LOW_RISK), dict(LABELS), tuple(seeds or ()))


def _candidates(view: View, rules: list[str] | None, rows: list[dict]) -> list[flow.Candidate]:
    hits = scan(view, rules) + (scan_addresses(view) if rules is None else [])
    found = [flow.Candidate(*tokens, h.entity_type, flow.Evidence(h.detector, h.rule, h.strength, h.score)) for h in hits if (tokens := view.range(h.start, h.end))]
    return found + flow.given_candidates(view, rows) + (flow.own_candidates(view) if rules is None else [])


def _shown(view: View, m: flow.Mention) -> dict:
    tokens = view.tokens
    return {
        "first": m.first, "last": m.last, "start": tokens[m.first].raw_start, "end": tokens[m.last].raw_end, "entity_type": m.entity_type, "value": view.value(m.first, m.last),
        "strength": max(e.strength for e in m.evidence), "evidence": [{"detector": e.detector, "rule": e.rule, "strength": e.strength, "score": e.score} for e in m.evidence],
    }


#: Characters of an output up to which what is detected in it is kept for outputs that read alike, and how many are.
ALIKE, OUTPUTS = 256, 1 << 13


@lru_cache(maxsize=OUTPUTS)
def _output_candidates(output: str) -> tuple[View, list[flow.Candidate]]:
    view = View.of_text(output)
    return view, _candidates(view, None, [])


def _detected_again(output: str, rules: list[str] | None, style: str) -> tuple[View, list[flow.Candidate]]:
    """An output's view and what a detection finds in it; surrogates differ from document to document."""
    if rules is None and style != "surrogate" and len(output) <= ALIKE:
        seen, found = _output_candidates(output)
        seen.known_hits.clear()  # values don't stay behind their document
        return seen, found
    view = View.of_text(output)
    return view, _candidates(view, rules, [])


def _verified(text: str, output: str, places: list[tuple[int, int]], view: View, acted: list[flow.Mention], all_: list[flow.Mention], persons, settings, rules, shared) -> tuple[str, dict]:
    """The output, blacked out once more where something shows, and the problems each check has with it."""
    removed = [(view.value(m.first, m.last), m.entity_type, m.last - m.first + 1) for m in acted]
    kept = [view.value(m.first, m.last) for m in all_ if m.action == "keep"]
    replacements = [m.by for m in acted]
    # where nothing was replaced, a second detection can only say the same
    found = set()
    if acted:
        seen, again = shared(("found", output), lambda: _detected_again(output, rules, settings.style))
        found = flow.residuals(seen, places, removed, again, kept, replacements, settings)
    replans = 0
    if found:
        replans = 1
        output, blanks = flow.blanked(output, seen, found)
        seen = View.of_text(output)
        found = flow.residuals(seen, blanks, removed, _candidates(seen, rules, []), kept, replacements, settings)
    forbidden = forbidden_keys(view, [(m.first, m.last) for m in acted], persons) if settings.style == "surrogate" else set()
    items = [(m.entity_type, m.action, view.value(m.first, m.last), m.by, m.words or []) for m in acted]
    # what lies between the mentions has to be the same in both texts, but for what was blacked out afterwards
    between, at = [], 0
    for m in acted:
        between.append(text[at : view.tokens[m.first].raw_start])
        at = view.tokens[m.last].raw_end
    between.append(text[at:])
    pieces, at = [], 0
    for a, b in places:
        pieces.append(output[at:a])
        at = b
    pieces.append(output[at:])
    return output, {
        "leaks": flow.text_leaks(output, [v for v, _, _ in removed]), "residual": len(found), "replans": replans,
        "unsafe": flow.surrogate_check(items, forbidden, settings), "changed": 0 if replans else int(between != pieces),
    }


#: Characters of a text up to which what several settings share is kept for the next of them.
SHARED = 1 << 16


def sharing(known: dict | None, size: int) -> Callable:
    """What is asked for, made once if it may be kept in ``known``."""

    def shared(at: Hashable, make: Callable):
        if known is None or size > SHARED:
            return make()
        if at not in known:
            known[at] = make()
        return known[at]

    return shared


def deidentified(text: str, settings: flow.Settings, key: bytes | None, rules: list[str] | None = None, rows: list[dict] | None = None, tokens: list[dict] | None = None, known: dict | None = None) -> dict:
    """One document's row without its id; with ``tokens``, what readers found, the text is their line view.

    ``known``: empty at first; what the same document under other settings shares with this.
    """
    shared = sharing(known, len(text))
    view = shared("view", lambda: View.of_rows(tokens) if tokens else View.of_text(text))
    text = view.text if tokens else text
    found = shared("found", lambda: _candidates(view, rules, rows or []))
    # detection asks of the settings no more than which types are kept, and what is the same for all profiles
    acted_on = frozenset(t for t, action in settings.actions.items() if action != "keep")
    mentions, low, rounds = shared(("detected", acted_on, settings.seeds), lambda: flow.detect(view, found, settings))
    mentions = [copy(m) for m in mentions]
    mentions = flow.split_places(view, mentions, settings)
    persons = flow.decide(view, mentions, settings)
    acted = flow.without_overlaps(mentions)
    days = flow.replace(view, acted, persons, settings, key)
    output, places = flow.rebuilt(text, view, acted)
    output, problems = _verified(text, output, places, view, acted, mentions, persons, settings, rules, shared)
    shown = [{**_shown(view, m), "action": m.action, "by": m.by, "cluster": m.cluster} for m in sorted(mentions, key=lambda m: (m.first, m.last, m.entity_type))]
    return {"text": output, "rounds": rounds, "days": days, "mentions": shown, "low": [_shown(view, m) for m in low], "error": None, **problems}


def process(docs: DataFrame, settings: flow.Settings, key: bytes | None, rules: list[str] | None = None) -> DataFrame:
    """``ROW`` for each document; a document that fails has an error's class and no text.

    ``docs``: doc_id, text and, if there are such columns, candidates (array of view spans that models found) and
    tokens (array, in reading order).  Documents are independent and read once.
    """
    return process_each(docs, {("", ""): settings}, key, rules).drop("profile", "style")


def process_each(docs: DataFrame, wanted: dict[tuple[str, str], flow.Settings], key: bytes | None, rules: list[str] | None = None) -> DataFrame:
    """``ROW``, profile and style for each document and each of the settings, by profile and style; a document is read once."""
    more = [c for c in ("candidates", "tokens") if c in docs.columns]
    shape = docs.sparkSession.createDataFrame([], f"{ROW}, profile string, style string").schema
    arrow = to_arrow_schema(shape)

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for row in (r for at in range(0, batch.num_rows, ROWS) for r in batch.slice(at, ROWS).to_pylist()):
                known = {} if len(wanted) > 1 else None
                for (profile, style), settings in wanted.items():
                    try:
                        made = deidentified(row["text"] or "", settings, key, rules, row.get("candidates"), row.get("tokens"), known)
                    except Exception as e:  # the document is quarantined, and no value of it is in a message
                        made = {"text": None, "error": type(e).__name__}
                    out.append({"doc_id": row["doc_id"], "profile": profile, "style": style, **made})
                    size += len(made["text"] or "")
                    if size > 4 << 20 or len(out) >= 4 * ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(run, shape)


def known_values(docs: DataFrame, seeds: list[tuple[str, str]], key: Callable[[str], str] = match_key) -> DataFrame:
    """(doc_id, first, last, entity_type, key, rule, score): where seeds (type, value) stand, as the flow finds them
    before it looks for anything that resembles what was found.  Each row of ``docs`` is searched, whatever its id.

    ``key``: what a word and a value are compared by.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    columns = StructType([StructField("doc_id", rows.schema["doc_id"].dataType)]).add("first", "integer").add("last", "integer")
    for name in ("entity_type", "key", "rule"):
        columns = columns.add(name, "string")
    columns = columns.add("score", "double")
    names, arrow = columns.names, to_arrow_schema(columns)

    def run(batches):
        targets = Targets(flow.seed_targets(seeds, key))
        for batch in batches:
            for i in range(batch.num_rows):
                doc, view = batch.column(0)[i].as_py(), View.of_text(batch.column(1)[i].as_py())
                view.keys = [key(t.text) for t in view.tokens]
                found = [(doc, h.first, h.last, h.entity_type, "".join(view.keys[h.first : h.last + 1]), h.rule, h.score) for h in targets.find(view)]
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, f, strict=True)) for f in found], schema=arrow)

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(run, columns)


def spread(good: DataFrame) -> DataFrame:
    """Documents of different ids dealt to all cores: a file of many short ones may be read by a single task, and each
    costs far more to work on than to send."""
    spark = good.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return good.repartition(parts, "doc_id")


def with_unique_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose id no other has and whose text isn't null, and (doc_id, reason) of the rest."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("text").isNull()).alias("null_text"))
    bad = ids.select("doc_id", F.when(F.col("doc_id").isNull(), "no_id").when(F.col("n") > 1, "repeated_id").when(F.col("null_text"), "no_text").alias("reason")).where("reason is not null")
    good = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).join(ids.where("n > 1").select("doc_id"), "doc_id", "left_anti")
    return good, bad


def persons_table(docs: DataFrame, settings: flow.Settings) -> DataFrame:
    """(doc_id, first, last, value, surname, cluster, gender, title) of each document's mentions of persons."""
    shape = "doc_id long, first int, last int, value string, surname string, cluster string, gender string, title string"

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                view = View.of_text(text or "")
                mentions, _, _ = flow.detect(view, _candidates(view, None, []), settings)
                for p in flow.persons_of(view, mentions).mentions:
                    out.append((doc_id, p.first, p.last, view.value(p.first, p.last), "".join(p.keys(SURNAME)), p.cluster, p.gender, p.title))
            names = ["doc_id", "first", "last", "value", "surname", "cluster", "gender", "title"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, shape)
