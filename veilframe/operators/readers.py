"""Readings of pages: decoding, alternatives, a second reader's words, and regions of ink."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key
from .boxes import BOX, MATCHED, PAGE, area, box, overlap, shared

# Ink a word needs to be seen, confidences from which readers are believed, readings of a token, and gaps
# between boxes of one region in line heights.
VISIBLE, SURE, REPLACE_BELOW, MOST_ALTERNATES, LEAST_RUNNER_UP = 0.02, 0.9, 0.9, 4, 0.05
GAPS = {"signature": 2.0, "handwriting": 1.0, "faint_ink": 2.0, "stamp": 0.5}
_ORDINARY = r"[\p{L}\p{N}.,;:'\"()\[\]/\\\-–&@#%+*!?$_]"


def plausible_text(text: Column) -> Column:
    """Not what a broken font gives: no control, private or replacement characters, four fifths ordinary ones."""
    odd = text.rlike(r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}\x{FFFD}]")
    good = F.length(text) - F.length(F.regexp_replace(text, _ORDINARY, ""))
    return F.coalesce((F.length(text) > 0) & ~odd & (good >= 0.8 * F.length(text)), F.lit(False))


def visible(words: DataFrame) -> DataFrame:
    """Words of a text layer that have ink beneath (``ink``: its share of the box)."""
    return words.where(F.col("ink") >= VISIBLE)


def runner_ups(steps: DataFrame, most: int = 1, least: float = LEAST_RUNNER_UP, blank: int = 0) -> DataFrame:
    """``ctc_collapse`` with alternatives: (seq, position, cls, prob, alternatives [(cls, prob)]).

    ``steps``: (seq, step, cls, prob) with every class of a step.  A run is what the best classes of neighbouring steps
    share; it is read at its most confident step, the first of several.
    """
    best = Window.partitionBy("seq", "step").orderBy(F.desc("prob"), "cls")
    ranked = steps.withColumn("rank", F.row_number().over(best))
    order = Window.partitionBy("seq").orderBy("step")
    tops = ranked.where("rank = 1").withColumn("begins", F.when(F.lag("cls").over(order) == F.col("cls"), 0).otherwise(1))
    tops = tops.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    read = tops.groupBy("seq", "run", "cls").agg(F.max_by("step", F.struct("prob", -F.col("step"))).alias("step"), F.max("prob").alias("prob")).where(F.col("cls") != blank)
    others = ranked.where((F.col("rank") > 1) & (F.col("cls") != blank) & (F.col("prob") >= least)).select("seq", "step", F.col("cls").alias("other"), F.col("prob").alias("p"))
    alternatives = F.slice(F.array_sort(F.collect_list(F.when(F.col("other").isNotNull(), F.struct((-F.col("p")).alias("minus"), F.col("other").alias("cls"))))), 1, most)
    out = read.join(others, ["seq", "step"], "left").groupBy("seq", "run", "cls", "prob").agg(alternatives.alias("a"))
    place = F.row_number().over(Window.partitionBy("seq").orderBy("run")) - 1
    return out.select("seq", place.alias("position"), "cls", "prob", F.transform("a", lambda x: F.struct(x["cls"].alias("cls"), (-x["minus"]).alias("prob"))).alias("alternatives"))


def token_alternates(chars: DataFrame, most: int = MOST_ALTERNATES) -> DataFrame:
    """(token, alternates): a token's other readings, one character exchanged, likeliest first, then all exchanged.

    ``chars``: (token, position, char, alternatives [(char, prob)]).  A token's characters are few.
    """
    word = F.array_sort(F.collect_list(F.struct("position", "char", "alternatives")))
    rows = chars.groupBy("token").agg(word.alias("w"))
    text = lambda at, c: F.array_join(F.transform("w", lambda x, i: F.when(i == at, c).otherwise(x["char"])), "")
    subs = F.flatten(F.transform("w", lambda x, i: F.transform(x["alternatives"], lambda a: F.struct((-a["prob"]).alias("minus"), i.alias("at"), a["char"].alias("char")))))
    rows = rows.withColumn("subs", F.array_sort(subs)).withColumn("plain", F.array_join(F.transform("w", lambda x: x["char"]), ""))
    singles = F.transform("subs", lambda s: text(s["at"], s["char"]))
    every = F.array_join(F.transform("w", lambda x: F.coalesce(F.get(F.array_sort(F.transform(x["alternatives"], lambda a: F.struct((-a["prob"]).alias("minus"), a["char"].alias("char")))), F.lit(0))["char"], x["char"])), "")
    found = F.array_distinct(F.concat(singles, F.array(every)))
    return rows.select("token", F.slice(F.filter(found, lambda s: s != F.col("plain")), 1, most).alias("alternates"))


def fuse_reader(tokens: DataFrame, words: DataFrame, engine: str, replace_below: float = REPLACE_BELOW, least_new: float = 0.0) -> DataFrame:
    """A second reader's words beside the first one's tokens: (doc_id, page, line_no, word_no, text, alternates, engine, box).

    A word belongs to the token that it overlaps most, by half of the smaller one at least.  It replaces the token's
    text where that is uncertain and the word isn't, and is another reading of it else; confident words without a token
    become tokens of new lines.  ``tokens``: doc_id, page, line_no, word_no, text, confidence, alternates, box;
    ``words``: doc_id, page, word, text, confidence, line, box.
    """
    words = words.where(plausible_text(F.col("text")))
    t = tokens.select(*[F.col(c).alias(f"t_{c}") for c in (*PAGE, "line_no", "word_no", *BOX)])
    met = (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page") == F.col("t_page")) & (F.col("t_x0") < F.col("x1")) & (F.col("t_x1") > F.col("x0")) & (F.col("t_y0") < F.col("y1")) & (F.col("t_y1") > F.col("y0"))
    by = F.struct(overlap(box(), box(prefix="t_")).alias("overlap"), (-F.col("t_line_no")).alias("line"), (-F.col("t_word_no")).alias("word"))
    best = words.join(t, met).groupBy(*PAGE, "word").agg(F.max(by).alias("best")).where(F.col("best.overlap") >= MATCHED)
    best = best.select(*PAGE, "word", (-F.col("best.line")).alias("line_no"), (-F.col("best.word")).alias("word_no"))
    in_order = F.array_sort(F.collect_list(F.struct("x0", "y0", "word", "text")))
    read = words.join(best, [*PAGE, "word"]).groupBy(*PAGE, "line_no", "word_no").agg(F.array_join(F.transform(in_order, lambda w: w["text"]), "").alias("other"), F.min("confidence").alias("sure"))
    joined = tokens.join(read, [*PAGE, "line_no", "word_no"], "left")
    differs = F.col("other").isNotNull() & (match_key(F.col("other")) != match_key(F.col("text")))
    better = differs & (F.col("confidence") < replace_below) & (F.col("sure") >= SURE)
    alternates = F.when(better, F.array_distinct(F.concat(F.array("text"), "alternates"))).when(differs, F.array_distinct(F.concat("alternates", F.array("other")))).otherwise(F.col("alternates"))
    old = joined.select(*PAGE, "line_no", "word_no", F.when(better, F.col("other")).otherwise(F.col("text")).alias("text"), alternates.alias("alternates"), F.lit("first").alias("engine"), *BOX)
    last = tokens.groupBy(*PAGE).agg(F.max("line_no").alias("last"))
    new = words.where(F.col("confidence") >= least_new).join(best.select(*PAGE, "word"), [*PAGE, "word"], "left_anti").join(last, [*PAGE], "left")
    line_no = F.coalesce("last", F.lit(-1)) + F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("line"))
    word_no = F.row_number().over(Window.partitionBy(*PAGE, "line").orderBy("x0", "y0", "word")) - 1
    added = new.select(*PAGE, line_no.cast("int").alias("line_no"), word_no.cast("int").alias("word_no"), "text", F.array().cast("array<string>").alias("alternates"), F.lit(engine).alias("engine"), *BOX)
    return old.unionByName(added)


def without_ghosts(tokens: DataFrame, ghosts: DataFrame, reread: DataFrame) -> DataFrame:
    """Tokens without those that stand for no ink (doc_id, token), and the lines that were read again appended."""
    return tokens.join(ghosts, ["doc_id", "token"], "left_anti").unionByName(reread)


def decode_spans(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, first, last, label, score): of spans above the threshold the best that don't overlap a better one.

    ``scores``: (doc_id, first, last, label, score).  Greedy by score, then place and label; a document's spans are
    taken in that order within its task.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "first", "last", "label")))
    rows = scores.where(F.col("score") > threshold).groupBy("doc_id").agg(order.alias("s"))
    none = F.array().cast("array<struct<minus: double, first: int, last: int, label: string>>")
    free = lambda taken, s: ~F.exists(taken, lambda t: (t["first"] <= s["last"]) & (s["first"] <= t["last"]))
    kept = F.aggregate(F.col("s").cast("array<struct<minus: double, first: int, last: int, label: string>>"), none, lambda a, s: F.when(free(a, s), F.concat(a, F.array(s))).otherwise(a))
    return rows.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.first", "k.last", "k.label", (-F.col("k.minus")).alias("score"))


def word_windows(n_words: Column, size: int = 300, overlap_: int = 50) -> Column:
    """Array of (first, last) word windows of ``size`` that share ``overlap_`` words and cover all; the last one ends
    with the text."""
    step = size - overlap_
    count = F.greatest(F.lit(1), F.ceil((n_words - overlap_) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).cast("int").alias("first"), F.least(i * step + size, n_words).cast("int").alias("last")))
    return F.when(n_words > 0, windows).otherwise(F.array().cast("array<struct<first: int, last: int>>"))


def core_windows(n: Column, core: int, margin: int) -> Column:
    """Array of (first, low, high, last): cores [low, high) that tile the text, each with a margin on both sides."""
    count = F.ceil(n / core).cast("int")
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.greatest(i * core - margin, F.lit(0)).cast("int").alias("first"), (i * core).cast("int").alias("low"), F.least((i + 1) * core, n).cast("int").alias("high"), F.least((i + 1) * core + margin, n).cast("int").alias("last")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<first: int, low: int, high: int, last: int>>"))


def page_statistics(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, line_height, confidence): the upper median height of the tokens and their mean confidence."""
    heights = F.array_sort(F.collect_list(F.col("y1") - F.col("y0")))
    rows = tokens.groupBy(*PAGE).agg(heights.alias("h"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return rows.select(*PAGE, F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")).alias("line_height"), "confidence")


def merge_regions(regions: DataFrame) -> DataFrame:
    """Regions of a kind whose boxes lie within the kind's gap become one box, until none do.

    ``regions``: doc_id, page, kind, line_height, box.  A page's boxes of a kind are one group in a task.
    """

    def merged(batch: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return batch.select([*PAGE, "kind", *BOX])
        first = batch.slice(0, 1).to_pylist()[0]
        gap = GAPS.get(first["kind"], 0.0) * first["line_height"]
        boxes = sorted(tuple(r[c] for c in BOX) for r in batch.to_pylist())
        changed = True
        while changed:
            changed, out = False, []
            for b in boxes:
                near = next((i for i, o in enumerate(out) if b[0] - gap <= o[2] and o[0] - gap <= b[2] and b[1] - gap <= o[3] and o[1] - gap <= b[3]), None)
                if near is None:
                    out.append(b)
                else:
                    o = out[near]
                    out[near] = (min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]))
                    changed = True
            boxes = sorted(out)
        rows = [{**{c: first[c] for c in (*PAGE, "kind")}, **dict(zip(BOX, b, strict=True))} for b in boxes]
        return pa.Table.from_pylist(rows, schema=batch.select([*PAGE, "kind", *BOX]).schema)

    shape = ", ".join(f"`{c}` {regions.schema[c].dataType.simpleString()}" for c in (*PAGE, "kind", *BOX))
    return regions.select(*PAGE, "kind", "line_height", *BOX).groupBy(*PAGE, "kind").applyInArrow(merged, shape)


# The order in which a blob of ink is told, and bounds of its features.
def region_kind(blob: dict[str, Column]) -> Column:
    """What a blob of ink is, by its features (shares of the page, line heights, counts); null: nothing to act on.

    photo_share, near_signature, text_like, legible, coloured, round_, faint, band (top, bottom or null), margin,
    n_lines, height (line heights), stroke_variance.
    """
    b = blob
    return (
        F.when(b["photo_share"] >= 0.6, "photo")
        .when(b["near_signature"] & ~b["text_like"], "signature")
        .when(b["text_like"] & (b["legible"] >= 0.5), F.lit(None))
        .when(b["text_like"] & b["band"].isNotNull(), "logo")
        .when(b["text_like"], "handwriting")
        .when(b["coloured"] & b["round_"], "stamp")
        .when(b["faint"], "faint_ink")
        .when(b["band"].isNotNull(), "logo")
        .when(b["margin"], "handwriting")
        .when(b["height"] >= 8, "graphic")
        .otherwise("handwriting")
    )


def outside(tokens: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Tokens that no region covers by ``share``: what is read from a figure or a stamp isn't text."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, *BOX)])
    met = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page") == F.col("r_page")) & (shared(box(), box(prefix="r_")) >= share * area(*box()))
    return tokens.join(r, met, "left_anti")
