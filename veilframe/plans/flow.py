"""The whole text flow: detect, fuse, propagate, resolve, decide, replace, verify, and the release gate.

Documents are independent, so each is worked on whole within a task; its row is written once to the shared folder, and
all other tables are read from there.  Each document ends as released or quarantined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import manifest, surrogates
from ..operators.documents import process, process_each, settings_of, spread, with_unique_ids
from ..tables import written


def deidentify(docs: DataFrame, profile: str = "broad", style: str = "label", rules: list[str] | None = None, seeds: list[tuple[str, str]] | None = None, key: bytes | None = None) -> dict[str, DataFrame]:
    """mentions, low_evidence, decisions, replaced, output, checks and gate of ``docs`` (doc_id, text).

    ``rules``: only these pattern rules; ``seeds``: (type, value) known beforehand; ``key``: of surrogates, else from the
    environment.  Documents without an id or text, and those that share an id, are quarantined unread.  ``docs`` may
    also have candidates (what models found) and tokens (what readers found).
    """
    good, bad = with_unique_ids(docs)
    secret = (key or surrogates.master_key()) if style == "surrogate" else None
    done = written(process(spread(good), settings_of(profile, style, seeds), secret, rules), "documents")
    return tables(done, bad)


def deidentify_each(docs: DataFrame, wanted: list[tuple[str, str]], key: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` for each profile and style, which read a document once together, and what wasn't read.

    Rows of one profile and style give their tables by ``tables``.
    """
    good, bad = with_unique_ids(docs)
    secret = (key or surrogates.master_key()) if any(style == "surrogate" for _, style in wanted) else None
    return written(process_each(spread(good), {w: settings_of(*w) for w in wanted}, secret), "documents"), bad


def tables(done: DataFrame, bad: DataFrame) -> dict[str, DataFrame]:
    decisions = done.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.*")
    checks = manifest.checks(done)
    return {
        "documents": done, "mentions": decisions, "decisions": decisions, "replaced": decisions.where("by is not null"),
        "low_evidence": done.select("doc_id", F.explode("low").alias("m")).select("doc_id", "m.*"),
        "output": done.select("doc_id", "text"), "checks": checks, "gate": manifest.gate(done, checks, bad),
    }
