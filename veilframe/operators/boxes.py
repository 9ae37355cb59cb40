"""Boxes on pages: areas, nearest neighbours, coverage, blocks, planned operations and what reviewers see of them.

A box is x0, y0, x1, y1 in pixels, y downwards.  Joins of boxes have document and page as their keys, so no task holds
more than a page's boxes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
PAGE = ("doc_id", "page")
# Shares of a box that count as covered, distances and paddings as parts of a line's height or pixels.
COVERED, TEXT_COVERED, MATCHED = 0.5, 0.25, 0.5
PAD_PIXELS, PAD_SHARE = 2, 0.08
TILTED = 25.0
MOST_BLOCK_LINES, DENSE, DENSE_PAIR = 6, 0.4, 0.25
DESCENDERS = "[gjpqy,;()\\[\\]{}_]"
POINTS, DPI = 72.0, 300


def box(*names: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in names or BOX]


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0)) * F.greatest(y1 - y0, F.lit(0))


def shared(a: list[Column], b: list[Column]) -> Column:
    """The area of the intersection."""
    return area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def iou(a: list[Column], b: list[Column]) -> Column:
    both = shared(a, b)
    return both / F.greatest(area(*a) + area(*b) - both, F.lit(1))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """The intersection as a part of the smaller box."""
    return shared(a, b) / F.greatest(F.lit(1), F.least(area(*a), area(*b)))


def vertical_overlap(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))


def padded(pixels: Column, width: Column, height: Column) -> dict[str, Column]:
    """The box grown by ``pixels`` on each side and cut at the page."""
    return {"x0": F.greatest(F.col("x0") - pixels, F.lit(0)), "y0": F.greatest(F.col("y0") - pixels, F.lit(0)), "x1": F.least(F.col("x1") + pixels, width), "y1": F.least(F.col("y1") + pixels, height)}


def line_pad(height: Column) -> Column:
    return F.greatest(F.lit(PAD_PIXELS), F.round(height * PAD_SHARE)).cast("long")


def detection_pad(kind: Column, width: Column, height: Column, dpi: Column) -> Column:
    """How far a barcode's or a face's box is grown: 24 pixels at 300 dpi or 15 % of a barcode, 35 % of a face."""
    longest = F.greatest(width, height)
    return F.when(kind == "barcode", F.greatest(F.round(24 * dpi / DPI), F.round(0.15 * longest))).when(kind == "face", F.round(0.35 * longest)).otherwise(0).cast("long")


def to_points(boxes: DataFrame, width: Column, height: Column, points_w: Column, points_h: Column) -> DataFrame:
    """Boxes in points from the lower left corner, three decimals; ``width`` and ``height``: the page's pixels."""
    x, y = points_w / width, points_h / height
    made = {"px0": F.col("x0") * x, "py0": points_h - F.col("y1") * y, "px1": F.col("x1") * x, "py1": points_h - F.col("y0") * y}
    return boxes.select("*", *[F.round(v, 3).alias(k) for k, v in made.items()])


def covered(boxes: DataFrame, ops: DataFrame, key: str, share: float = COVERED) -> DataFrame:
    """The ``key`` of boxes whose intersections with ``ops`` together have ``share`` of their area; ops may overlap, what
    they share counts twice."""
    over = ops.select(*[F.col(c).alias(f"o_{c}") for c in (*PAGE, *BOX)])
    met = boxes.join(over, (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page") == F.col("o_page")) & (F.col("o_x0") < F.col("x1")) & (F.col("o_x1") > F.col("x0")) & (F.col("o_y0") < F.col("y1")) & (F.col("o_y1") > F.col("y0")))
    hit = met.groupBy(*PAGE, key, *BOX).agg(F.sum(shared(box(), box(prefix="o_"))).alias("hit"))
    return hit.where((area(*box()) > 0) & (F.col("hit") >= share * area(*box()))).select(*PAGE, key)


def label_values(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page, label, where, row): the nearest row to the right of a label, and the nearest one below it.

    ``labels`` and ``rows``: doc_id, page, label or row, box; a label's own row is row ``own``.
    """
    r = rows.select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, "row", *BOX)])
    high = F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    pairs = labels.join(r, (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page") == F.col("r_page")) & (F.col("own") != F.col("r_row")))
    beside = (F.col("r_x0") >= F.col("x1") - 0.5 * high) & (vertical_overlap(box(), box(prefix="r_")) >= 0.5 * F.least(F.col("r_y1") - F.col("r_y0"), high))
    below = (F.col("r_y0") >= F.col("y1") - 0.3 * high) & (F.col("r_y0") - F.col("y1") <= 1.8 * high) & (F.col("r_x1") > F.col("x0") - high) & (F.col("r_x0") < F.col("x1") + 4 * high)
    group = (*PAGE, "label")
    right = pairs.where(beside).groupBy(*group).agg(F.min(F.struct("r_x0", "r_row")).alias("best")).select(*group, F.lit("right").alias("where"), F.col("best.r_row").alias("row"))
    under = pairs.where(below).groupBy(*group).agg(F.min(F.struct("r_y0", "r_x0", "r_row")).alias("best")).select(*group, F.lit("below").alias("where"), F.col("best.r_row").alias("row"))
    return right.unionByName(under)


def segments(tokens: DataFrame) -> DataFrame:
    """One row for each mention and line: the union of its tokens' boxes, their texts in order, and what replaces them.

    ``tokens``: doc_id, page, line_no, word_no, mention, text, by (null: nothing is drawn), box.
    """
    words = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text", "by"))), lambda w: w)
    grouped = tokens.groupBy(*PAGE, "line_no", "mention").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), words.alias("w"))
    drawn = F.filter(F.transform("w", lambda w: w["by"]), lambda b: b.isNotNull() & (b != ""))
    return grouped.select(*PAGE, "line_no", "mention", *BOX, F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("source"), F.array_join(drawn, " ").alias("by"))


def plan_ops(parts: DataFrame) -> DataFrame:
    """One padded operation for each part of a mention; what can't be typeset is blacked out, never kept.

    ``parts``: a row of ``segments`` with kind (surrogate, label, blackout), angle of its line, and the page's width and
    height.
    """
    tilt = F.abs(F.col("angle"))
    flat = F.least(tilt, 180 - tilt) <= TILTED
    text = F.col("kind").isin("surrogate", "label")
    kind = F.when(text & (~flat | (F.col("by") == "")), F.lit("blackout")).otherwise(F.col("kind"))
    grown = padded(line_pad(F.col("y1") - F.col("y0")), F.col("width"), F.col("height"))
    ops = parts.select(*PAGE, "line_no", "mention", kind.alias("kind"), *[v.alias(k) for k, v in grown.items()], F.when(kind != "blackout", F.col("by")).alias("text"), F.col("source").rlike(DESCENDERS).alias("descends"))
    return ops.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def dense_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, page, line_no, box, n_tokens, n_found, n_mentions) with their block and whether it is set anew.

    A block is lines closely under each other that share a column; one of few lines is dense where much of it is found.
    """
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no")
    last = {c: F.lag(c).over(order) for c in BOX}
    gap, high = F.col("y0") - last["y1"], last["y1"] - last["y0"]
    column = F.least(F.col("x1"), last["x1"]) - F.greatest(F.col("x0"), last["x0"])
    joins = (gap >= -0.3 * high) & (gap <= 0.8 * high) & (column >= 0.3 * F.least(F.col("x1") - F.col("x0"), last["x1"] - last["x0"]))
    begun = lines.withColumn("begins", F.when(joins, 0).otherwise(1))
    blocks = begun.withColumn("block", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("begins")
    whole = Window.partitionBy(*PAGE, "block")
    share = F.sum("n_found").over(whole) / F.greatest(F.sum("n_tokens").over(whole), F.lit(1))
    dense = (F.count("*").over(whole) <= MOST_BLOCK_LINES) & ((share >= DENSE) | ((F.sum("n_mentions").over(whole) >= 2) & (share >= DENSE_PAIR)))
    return blocks.withColumn("dense", dense)


def retypeset(ops: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """``ops`` with one operation for each line that is set anew in place of those of its mentions.

    ``lines``: doc_id, page, line_no, box, dense; ``words``: doc_id, page, line_no, word_no, text, by (null: unchanged),
    mention.  Only lines all of whose operations are text are set anew.
    """
    able = ops.groupBy(*PAGE, "line_no").agg(F.bool_and(F.col("kind").isin("surrogate", "label")).alias("able")).where("able")
    chosen = lines.where("dense").join(able, [*PAGE, "line_no"], "left_semi")
    text = words.groupBy(*PAGE, "line_no").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.coalesce("by", "text").alias("w")))), lambda x: x["w"]), lambda w: w != ""), " ").alias("text"),
        F.array_sort(F.collect_set("mention")).alias("covers"),
    )
    anew = chosen.join(text, [*PAGE, "line_no"]).select(*PAGE, "line_no", F.lit(None).cast("string").alias("mention"), F.lit("retypeset").alias("kind"), *BOX, "text", "covers")
    rest = ops.join(chosen.select(*PAGE, "line_no"), [*PAGE, "line_no"], "left_anti")
    return rest.select(*PAGE, "line_no", F.col("mention").cast("string").alias("mention"), "kind", *BOX, "text", F.array("mention").cast("array<string>").alias("covers")).unionByName(anew.withColumn("covers", F.col("covers").cast("array<string>")))


def text_layer(tokens: DataFrame, ops: DataFrame) -> DataFrame:
    """What an output's text layer says: tokens that operations cover by less than a quarter, and the operations' texts,
    in reading order.  ``tokens``: doc_id, page, token, text, box; ``ops``: doc_id, page, text, box."""
    hidden = covered(tokens, ops, "token", TEXT_COVERED)
    left = tokens.join(hidden, [*PAGE, "token"], "left_anti").select(*PAGE, "text", *BOX)
    drawn = ops.where("text is not null and text <> ''").select(*PAGE, "text", *BOX)
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "text")
    return left.unionByName(drawn).withColumn("place", F.row_number().over(order).cast("int")).select(*PAGE, "place", "text")


def overlay(items: DataFrame) -> DataFrame:
    """One row for each distinct rounded box of a page with the items shown in it, in order.

    ``items``: doc_id, page, item, category, box.
    """
    rounded = items.select(*PAGE, "item", "category", *[F.round(c, 1).alias(c) for c in BOX])
    shown = F.array_sort(F.collect_set(F.struct("item", "category")))
    return rounded.groupBy(*PAGE, *BOX).agg(shown.alias("items")).select(*PAGE, *BOX, F.size("items").alias("n_items"), F.transform("items", lambda i: i["item"])[0].alias("first_item"))


def region_action(kind_action: Column, style: Column) -> Column:
    """What is done with a region: nothing that is kept, a stand-in only beside surrogates, else it is removed."""
    return F.when(kind_action == "keep", F.lit(None)).when((kind_action == "synthesise") & (style != "surrogate"), "remove").otherwise(kind_action)


def unplanned(ops: DataFrame, mentions: DataFrame, regions: DataFrame) -> DataFrame:
    """Operations that neither a mention nor a region asked for: what a second look added."""
    known = mentions.select("doc_id", F.col("mention").alias("ref")).unionByName(regions.select("doc_id", F.col("region").alias("ref")))
    return ops.join(known, ["doc_id", "ref"], "left_anti")


def page_kind(n_words: Column, n_images: Column, image_share: Column) -> Column:
    """empty, image_only, mixed or born_digital, by a page's own words and how much of it images cover."""
    return F.when((n_words == 0) & (n_images == 0), "empty").when(n_words == 0, "image_only").when(image_share >= 0.5, "mixed").otherwise("born_digital")


def effective_dpi(width_pt: Column, height_pt: Column, wanted: Column, most_pixels: int = 80_000_000, least: int = 150) -> Column:
    """The resolution a page is drawn at: less than wanted where it would have too many pixels, null below the least."""
    square = (width_pt / POINTS) * (height_pt / POINTS)
    dpi = F.least(wanted.cast("double"), F.floor(F.sqrt(most_pixels / square)).cast("double")).cast("int")
    return F.when(dpi >= least, dpi)


def limits(n_bytes: Column, n_pages: Column, encrypted: Column, most_bytes: int = 512 << 20, most_pages: int = 3000) -> Column:
    """Why a file isn't read; null: it is."""
    return F.when(n_bytes == 0, "empty").when(n_bytes > most_bytes, "too_large").when(encrypted, "encrypted").when(n_pages > most_pages, "too_many_pages").when(n_pages == 0, "no_pages")
