"""Queries of the operators on boxes and readings, over pages that are made from orders: a customer is a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import readers as R
from ..sources.tables import table

# One box for each order, in integers; the same expressions in Spark and in the checking SQL.
_X0, _Y0 = "(o_orderkey * 7919 % 60) * 10", "(o_orderkey * 104729 % 20) * 40"
_BOX = {"doc_id": "o_custkey", "page": "o_orderkey % 2", "token": "o_orderkey", "x0": _X0, "y0": _Y0, "x1": f"{_X0} + 40 + o_orderkey % 90", "y1": f"{_Y0} + 30 + o_orderkey % 15"}
_DX, _DY = "(o_orderkey % 7) * 15", "(o_orderkey % 3) * 10"
_OPS = {**_BOX, "x0": f"{_X0} + {_DX}", "y0": f"{_Y0} + {_DY}", "x1": f"{_BOX['x1']} + {_DX}", "y1": f"{_BOX['y1']} + {_DY}"}
#: Lines of a page: six rows of 60 pixels, three words in each at most.
_LINE, _WORD = "o_orderkey * 31 % 6", "o_orderkey"
_TOKENS = {
    "doc_id": "o_custkey", "page": "o_orderkey % 2", "line_no": _LINE, "word_no": _WORD, "mention": "o_orderkey % 3", "text": "concat('w', o_orderstatus, CAST(o_orderkey % 10 AS STRING))",
    "by": "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL ELSE concat('r', CAST(o_orderkey % 10 AS STRING)) END",
    "x0": "o_orderkey * 13 % 900", "y0": f"({_LINE}) * 60 + o_orderkey % 4", "x1": "o_orderkey * 13 % 900 + 80", "y1": f"({_LINE}) * 60 + o_orderkey % 4 + 40 + o_orderkey % 5",
}


def _made(spark: SparkSession, sf_dir: str, columns: dict[str, str], where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "orders").where(where).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def _sql(columns: dict[str, str], where: str = "true") -> str:
    return "SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in columns.items()) + f" FROM orders WHERE {where}"


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.covered(_made(spark, sf_dir, _BOX), _made(spark, sf_dir, _OPS, "o_orderkey % 3 <> 1"), "token")


def q_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _made(spark, sf_dir, {**_BOX, "text": "concat('t', CAST(o_orderkey AS STRING))"})
    return B.text_layer(tokens, _made(spark, sf_dir, {**_OPS, "text": "concat('op', CAST(o_orderkey AS STRING))"}, "o_orderkey % 5 = 0"))


def q_label_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, {**_BOX, "row": "o_orderkey"})
    return B.label_values(_made(spark, sf_dir, {**_BOX, "label": "o_orderkey", "own": "o_orderkey"}, "o_orderkey % 3 = 0"), rows)


def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.segments(_made(spark, sf_dir, _TOKENS))


_KIND = "CASE doc_id % 3 WHEN 0 THEN 'surrogate' WHEN 1 THEN 'label' ELSE 'blackout' END"


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.segments(_made(spark, sf_dir, _TOKENS)).selectExpr("*", f"{_KIND} AS kind", "CAST(line_no * 17 AS DOUBLE) AS angle", "1000L AS width", "380L AS height")
    return B.plan_ops(parts)


def q_plan_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir)


_LINES = {"doc_id": "o_custkey", "page": "0", "line_no": "o_orderkey", "x0": "o_orderkey * 13 % 200", "y0": "o_orderkey * 7 % 40 * 45", "x1": "o_orderkey * 13 % 200 + 300", "y1": "o_orderkey * 7 % 40 * 45 + 30", "n_tokens": "5 + o_orderkey % 4", "n_found": "o_orderkey % 6", "n_mentions": "o_orderkey % 3"}


def q_dense_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.dense_blocks(_made(spark, sf_dir, _LINES)).select("doc_id", "line_no", "block", "dense")


def q_retypeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _made(spark, sf_dir, _TOKENS)
    lines = words.groupBy("doc_id", "page", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.sum("mention") % 2 == 0).alias("dense"))
    made = B.retypeset(_planned(spark, sf_dir), lines, words.withColumn("mention", F.col("mention").cast("string")))
    return made.select("doc_id", "page", "line_no", "kind", "text", F.array_join("covers", ",").alias("covers"))


def q_overlay_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _made(spark, sf_dir, {**_BOX, "x0": "(o_orderkey % 4) * 0.04", "y0": "0.0", "x1": "10.0", "y1": "20.0", "item": "o_orderkey", "category": "o_orderstatus"})
    return B.overlay(items).select("doc_id", "page", F.col("x0").cast("double").alias("x0"), "n_items", "first_item")


def q_unplanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _made(spark, sf_dir, {"doc_id": "o_custkey", "op": "o_orderkey", "ref": "o_orderkey % 40"})
    mentions = _made(spark, sf_dir, {"doc_id": "o_custkey", "mention": "o_orderkey % 37"}, "o_orderstatus = 'F'")
    return B.unplanned(ops, mentions, _made(spark, sf_dir, {"doc_id": "o_custkey", "region": "o_orderkey % 11"}, "o_orderstatus = 'P'")).select("doc_id", "op", "ref")


def q_box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box with its shifted copy, in points, and how far a barcode's and a face's box is grown."""
    rows = _made(spark, sf_dir, _BOX).join(_made(spark, sf_dir, {"token": "o_orderkey", **{f"o_{c}": _OPS[c] for c in B.BOX}}), "token")
    a, b = B.box(), B.box(prefix="o_")
    rows = B.to_points(rows, F.lit(2481), F.lit(3508), F.lit(595.276), F.lit(841.89))
    size = (F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return rows.select(
        "token", B.shared(a, b).alias("shared"), F.round(B.iou(a, b), 6).alias("iou"), F.round(B.overlap(a, b), 6).alias("overlap"), B.vertical_overlap(a, b).alias("rows"),
        F.round("px0", 2).alias("px0"), F.round("py1", 2).alias("py1"), B.detection_pad(F.lit("barcode"), *size, F.lit(300)).alias("code_pad"), B.detection_pad(F.lit("face"), *size, F.lit(300)).alias("face_pad"),
    )


def q_page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pages, the resolution they are drawn at, and why files aren't read."""
    o = table(spark, sf_dir, "orders")
    kind = B.page_kind(F.col("o_orderkey") % 3, F.col("o_custkey") % 2, (F.col("o_orderkey") % 10) / 10)
    dpi = B.effective_dpi(500.0 + F.col("o_orderkey") % 5000, F.lit(842.0) + F.col("o_custkey"), F.lit(300))
    refused = B.limits((F.col("o_orderkey") % 7) * 100_000_000, F.col("o_custkey") * 5, F.col("o_orderstatus") == "P")
    return o.select("o_orderkey", kind.alias("kind"), dpi.alias("dpi"), refused.alias("refused"))


def q_page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_statistics(_made(spark, sf_dir, {**_BOX, "confidence": "CAST(o_orderkey % 100 AS DOUBLE) / 128"}))


def q_reader_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reader sees most boxes shifted, some of them in another spelling, and some that the first one missed."""
    first = {**_BOX, "line_no": "o_orderkey * 31 % 6", "word_no": "o_orderkey", "text": "concat('Wo', CAST(o_orderkey % 7 AS STRING))", "confidence": "CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.95 END"}
    tokens = _made(spark, sf_dir, first, "o_orderkey % 5 <> 0").drop("token").withColumn("alternates", F.array().cast("array<string>"))
    second = {**_OPS, "word": "o_orderkey", "line": "o_orderkey % 4", "text": "concat('wo', CAST(o_orderkey % 8 AS STRING))", "confidence": "CASE WHEN o_orderkey % 3 = 0 THEN 0.8 ELSE 0.97 END"}
    fused = R.fuse_reader(tokens, _made(spark, sf_dir, second).drop("token"), "second")
    return fused.select("doc_id", "page", F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), "text", F.array_join("alternates", "|").alias("alternates"), "engine")


def q_plausible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("o_orderpriority", F.repeat(F.lit("^"), (F.col("o_orderkey") % 6).cast("int")), F.when(F.col("o_orderkey") % 50 == 0, F.lit("�")).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.plausible_text(text).alias("plausible"))


def q_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 300 words with 50 shared, as the entity models read documents."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(R.word_windows(n)).alias("w")).select("doc_id", "w.*")


def q_core_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores of 512 words that tile a document, each with up to 128 words of context on both sides."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(R.core_windows(n, 512, 128)).alias("w")).select("doc_id", "w.*")


def q_runner_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a reader's steps: by user the classes of each step with their probabilities."""
    e = table(spark, sf_dir, "events")
    steps = e.selectExpr("user_id AS seq", "event_id AS step", "explode(array(struct(event_id % 3 AS cls, 0.5D + (event_id % 4) / 16.0D AS prob), struct(event_id % 3 + 3 AS cls, 0.25D - (event_id % 5) / 16.0D AS prob))) AS x").select("seq", "step", "x.*")
    return R.runner_ups(steps).select("seq", F.col("position").cast("long").alias("position"), "cls", "prob", F.get("alternatives", F.lit(0))["cls"].alias("other"))


def q_visible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _made(spark, sf_dir, {"doc_id": "o_custkey", "token": "o_orderkey", "ink": "CAST(o_orderkey % 50 AS DOUBLE) / 1000"})
    ghosts = _made(spark, sf_dir, {"doc_id": "o_custkey", "token": "o_orderkey"}, "o_orderkey % 11 = 0")
    again = _made(spark, sf_dir, {"doc_id": "o_custkey", "token": "o_orderkey + 1000000", "ink": "1.0D"}, "o_orderkey % 13 = 0")
    return R.without_ghosts(R.visible(words), ghosts, again).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token").alias("tokens"))


def q_region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    blob = {"photo_share": (k % 10) / 10, "near_signature": k % 4 == 0, "text_like": k % 3 == 0, "legible": (c % 4) / 4, "coloured": c % 5 == 0, "round_": k % 2 == 0, "faint": c % 7 == 0,
            "band": F.when(c % 6 == 0, "top"), "margin": c % 9 == 0, "height": k % 12}
    return table(spark, sf_dir, "orders").select(R.region_kind(blob).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def q_merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, {**_BOX, "kind": "CASE WHEN o_orderkey % 2 = 0 THEN 'stamp' ELSE 'signature' END", "line_height": "30"})
    return R.merge_regions(rows).groupBy("doc_id", "page", "kind").agg(F.count("*").alias("n"), F.sum("x0").alias("x0"), F.sum("y1").alias("y1"))


QUERIES = {f.__name__: f for f in (
    q_coverage, q_text_layer, q_label_geometry, q_segments, q_plan_ops, q_dense_blocks, q_retypeset, q_overlay_boxes, q_unplanned, q_box_measures, q_page_limits, q_page_statistics, q_reader_fusion,
    q_plausible_text, q_word_windows, q_core_windows, q_runner_ups, q_visible_words, q_region_kinds, q_merge_regions,
)}

_COVER = "greatest(least(t.x1, o.x1) - greatest(t.x0, o.x0), 0) * greatest(least(t.y1, o.y1) - greatest(t.y0, o.y0), 0)"
_HITS = f"SELECT t.doc_id, t.page, t.token, t.x0, t.y0, t.x1, t.y1, sum({_COVER}) AS hit FROM t JOIN o ON t.doc_id = o.doc_id AND t.page = o.page GROUP BY ALL"
_SEGMENTS = f"""
    SELECT doc_id, page, line_no, mention, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY word_no) AS source,
           coalesce(string_agg("by", ' ' ORDER BY word_no) FILTER (WHERE "by" <> ''), '') AS "by" FROM ({_sql(_TOKENS).replace(' AS by,', ' AS "by",')}) GROUP BY 1, 2, 3, 4
"""
_PLANNED = f"""
    SELECT doc_id, page, line_no, mention, k AS kind, greatest(x0 - p, 0) AS x0, greatest(y0 - p, 0) AS y0, least(x1 + p, 1000) AS x1, least(y1 + p, 380) AS y1, CASE WHEN k <> 'blackout' THEN "by" END AS text,
           regexp_matches(source, '[gjpqy,;()\\[\\]{{}}_]') AS descends
    FROM (SELECT *, CASE WHEN kind <> 'blackout' AND (least(line_no * 17, 180 - line_no * 17) > 25 OR "by" = '') THEN 'blackout' ELSE kind END AS k, CAST(greatest(2, round((y1 - y0) * 0.08::DOUBLE)) AS BIGINT) AS p FROM (SELECT *, {_KIND} AS kind FROM ({_SEGMENTS})))
"""
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
ORACLE_SQL = {
    "q_coverage": f"WITH t AS ({_sql(_BOX)}), o AS ({_sql(_OPS, 'o_orderkey % 3 <> 1')}) SELECT doc_id, page, token FROM ({_HITS}) WHERE 2 * hit >= (x1 - x0) * (y1 - y0) AND hit > 0",
    "q_text_layer": f"""
        WITH t AS ({_sql({**_BOX, 'text': "concat('t', CAST(o_orderkey AS STRING))"})}), o AS ({_sql({**_OPS, 'text': "concat('op', CAST(o_orderkey AS STRING))"}, 'o_orderkey % 5 = 0')}),
             h AS (SELECT doc_id, page, token FROM ({_HITS}) WHERE 4 * hit >= (x1 - x0) * (y1 - y0) AND hit > 0),
             u AS (SELECT doc_id, page, text, y0, x0 FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.token = t.token) UNION ALL SELECT doc_id, page, text, y0, x0 FROM o)
        SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, text) AS INTEGER) AS place, text FROM u
    """,
    "q_label_geometry": f"""
        WITH r AS ({_sql({**_BOX, 'row': 'o_orderkey'})}), l AS (SELECT *, greatest(1, y1 - y0) AS lh FROM r WHERE token % 3 = 0),
             p AS (SELECT l.doc_id, l.page, l.token AS label, r.row, r.x0, r.y0,
                          r.x0 >= l.x1 - 0.5 * lh AND least(r.y1, l.y1) - greatest(r.y0, l.y0) >= 0.5 * least(r.y1 - r.y0, lh) AS beside,
                          r.y0 >= l.y1 - 0.3 * lh AND r.y0 - l.y1 <= 1.8 * lh AND r.x1 > l.x0 - lh AND r.x0 < l.x1 + 4 * lh AS under
                   FROM l JOIN r ON l.doc_id = r.doc_id AND l.page = r.page AND l.token <> r.row)
        SELECT doc_id, page, label, 'right' AS "where", "row" FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x0, "row") AS n FROM p WHERE beside) WHERE n = 1
        UNION ALL SELECT doc_id, page, label, 'below', "row" FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY y0, x0, "row") AS n FROM p WHERE under) WHERE n = 1
    """,
    "q_segments": _SEGMENTS,
    "q_plan_ops": _PLANNED,
    "q_dense_blocks": f"""
        WITH l AS ({_sql(_LINES)}), p AS (SELECT *, lag(x0) OVER w AS a0, lag(y0) OVER w AS b0, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1 FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, line_no)),
             g AS (SELECT *, sum(CASE WHEN y0 - b1 >= -0.3 * (b1 - b0) AND y0 - b1 <= 0.8 * (b1 - b0) AND least(x1, a1) - greatest(x0, a0) >= 0.3 * least(x1 - x0, a1 - a0) THEN 0 ELSE 1 END)
                          OVER (PARTITION BY doc_id, page ORDER BY y0, x0, line_no ROWS UNBOUNDED PRECEDING) AS block FROM p)
        SELECT doc_id, line_no, CAST(block AS INTEGER) AS block, count(*) OVER b <= 6 AND (sum(n_found) OVER b >= 0.4 * sum(n_tokens) OVER b OR (sum(n_mentions) OVER b >= 2 AND sum(n_found) OVER b >= 0.25 * sum(n_tokens) OVER b)) AS dense
        FROM g WINDOW b AS (PARTITION BY doc_id, page, block)
    """,
    "q_retypeset": f"""
        WITH w AS ({_sql(_TOKENS).replace(' AS by,', ' AS "by",')}), p AS ({_PLANNED}),
             l AS (SELECT doc_id, page, line_no FROM w GROUP BY 1, 2, 3 HAVING sum(mention) % 2 = 0), a AS (SELECT doc_id, page, line_no FROM p GROUP BY 1, 2, 3 HAVING bool_and(kind <> 'blackout')),
             c AS (SELECT * FROM l JOIN a USING (doc_id, page, line_no))
        SELECT doc_id, page, line_no, kind, text, CAST(mention AS VARCHAR) AS covers FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND c.page = p.page AND c.line_no = p.line_no)
        UNION ALL SELECT doc_id, page, line_no, 'retypeset', coalesce(string_agg(coalesce("by", text), ' ' ORDER BY word_no) FILTER (WHERE coalesce("by", text) <> ''), ''), array_to_string(list_sort(list_distinct(list(CAST(mention AS VARCHAR)))), ',')
                  FROM w JOIN c USING (doc_id, page, line_no) GROUP BY 1, 2, 3
    """,
    "q_overlay_boxes": "SELECT o_custkey AS doc_id, o_orderkey % 2 AS page, CASE WHEN o_orderkey % 4 < 2 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS x0, CAST(count(*) AS INTEGER) AS n_items, min(o_orderkey) AS first_item FROM orders GROUP BY 1, 2, 3",
    "q_unplanned": """
        SELECT o_custkey AS doc_id, o_orderkey AS op, o_orderkey % 40 AS ref FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders m WHERE m.o_custkey = o.o_custkey AND m.o_orderstatus = 'F' AND m.o_orderkey % 37 = o.o_orderkey % 40)
          AND NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey = o.o_custkey AND r.o_orderstatus = 'P' AND r.o_orderkey % 11 = o.o_orderkey % 40)
    """,
    "q_box_measures": f"""
        WITH t AS ({_sql(_BOX)}), o AS ({_sql(_OPS)}), m AS (SELECT t.*, {_COVER} AS inter, (t.x1 - t.x0) * (t.y1 - t.y0) AS size, greatest(least(t.y1, o.y1) - greatest(t.y0, o.y0), 0) AS "rows" FROM t JOIN o ON t.token = o.token)
        SELECT token, inter AS shared, round(inter::DOUBLE / (2 * size - inter), 6) AS iou, round(inter::DOUBLE / size, 6) AS overlap, "rows", round(round(x0 * (595.276::DOUBLE / 2481), 3), 2) AS px0, round(round(841.89::DOUBLE - y0 * (841.89::DOUBLE / 3508), 3), 2) AS py1,
               CAST(greatest(24, round(0.15::DOUBLE * greatest(x1 - x0, y1 - y0))) AS BIGINT) AS code_pad, CAST(round(0.35::DOUBLE * greatest(x1 - x0, y1 - y0)) AS BIGINT) AS face_pad FROM m
    """,
    "q_page_limits": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'empty' ELSE 'image_only' END WHEN o_orderkey % 10 >= 5 THEN 'mixed' ELSE 'born_digital' END AS kind,
               CASE WHEN d >= 150 THEN d END AS dpi,
               CASE WHEN o_orderkey % 7 = 0 THEN 'empty' WHEN (o_orderkey % 7) * 100000000 > 536870912 THEN 'too_large' WHEN o_orderstatus = 'P' THEN 'encrypted' WHEN o_custkey * 5 > 3000 THEN 'too_many_pages' WHEN o_custkey = 0 THEN 'no_pages' END AS refused
        FROM (SELECT *, CAST(least(300, floor(sqrt(80000000 / (((500.0::DOUBLE + o_orderkey % 5000) / 72) * ((842.0::DOUBLE + o_custkey) / 72))))) AS INTEGER) AS d FROM orders)
    """,
    "q_page_statistics": f"""
        WITH t AS ({_sql(_BOX)}) SELECT doc_id, page, list_sort(list(y1 - y0))[CAST(count(*) // 2 + 1 AS INTEGER)] AS line_height, round(avg((token % 100)::DOUBLE / 128), 4) AS confidence FROM t GROUP BY 1, 2
    """,
    "q_reader_fusion": f"""
        WITH t AS (SELECT *, token * 31 % 6 AS line_no, 'Wo' || CAST(token % 7 AS VARCHAR) AS text, token % 2 = 0 AS unsure FROM ({_sql(_BOX)}) WHERE token % 5 <> 0), o AS (SELECT *, 'wo' || CAST(token % 8 AS VARCHAR) AS text, token % 3 <> 0 AS sure, token % 4 AS line FROM ({_sql(_OPS)})),
             m AS (SELECT o.token AS word, t.token, t.line_no, {_COVER} / greatest(1, least((t.x1 - t.x0) * (t.y1 - t.y0), (o.x1 - o.x0) * (o.y1 - o.y0)))::DOUBLE AS part, o.x0, o.y0, o.text, o.sure FROM o JOIN t ON t.doc_id = o.doc_id AND t.page = o.page),
             b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY part DESC, line_no, token) AS n FROM m) WHERE n = 1 AND part >= 0.5),
             r AS (SELECT token, string_agg(text, '' ORDER BY x0, y0, word) AS other, bool_and(sure) AS sure FROM b GROUP BY 1),
             l AS (SELECT doc_id, page, max(line_no) AS last FROM t GROUP BY 1, 2)
        SELECT t.doc_id, t.page, t.line_no, t.token AS word_no, CASE WHEN lower(t.text) <> other AND unsure AND sure THEN other ELSE t.text END AS text,
               CASE WHEN lower(t.text) <> other AND unsure AND sure THEN t.text WHEN lower(t.text) <> other THEN other ELSE '' END AS alternates, 'first' AS engine FROM t LEFT JOIN r ON r.token = t.token
        UNION ALL SELECT o.doc_id, o.page, coalesce(last, -1) + dense_rank() OVER (PARTITION BY o.doc_id, o.page ORDER BY line), row_number() OVER (PARTITION BY o.doc_id, o.page, line ORDER BY o.x0, o.y0, o.token) - 1, o.text, '', 'second'
                  FROM o LEFT JOIN l ON l.doc_id = o.doc_id AND l.page = o.page WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.word = o.token)
    """,
    "q_plausible_text": "SELECT o_orderkey, o_orderkey % 50 <> 0 AND length(replace(o_orderpriority, ' ', '')) >= 0.8 * (length(o_orderpriority) + o_orderkey % 6) AS plausible FROM orders",
    "q_word_windows": f"""
        WITH w AS (SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS n FROM documents)
        SELECT doc_id, CAST(f AS INTEGER) AS first, CAST(least(f + 300, n) AS INTEGER) AS last FROM (SELECT doc_id, n, unnest(range(0, greatest(n - 51, 0) + 1, 250)) AS f FROM w WHERE n > 0)
    """,
    "q_core_windows": f"""
        WITH w AS (SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, n, 512)) AS core FROM w WHERE n > 0)
        SELECT doc_id, CAST(greatest(core - 128, 0) AS INTEGER) AS first, CAST(core AS INTEGER) AS low, CAST(least(core + 512, n) AS INTEGER) AS high, CAST(least(least(core + 512, n) + 128, n) AS INTEGER) AS last FROM c
    """,
    "q_runner_ups": """
        WITH s AS (SELECT user_id AS seq, event_id AS step, event_id % 3 AS cls, 0.5::DOUBLE + (event_id % 4) / 16.0::DOUBLE AS prob, event_id % 3 + 3 AS o, 0.25::DOUBLE - (event_id % 5) / 16.0::DOUBLE AS q FROM events),
             b AS (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY seq ORDER BY step) = cls THEN 0 ELSE 1 END AS begins FROM s), r AS (SELECT *, sum(begins) OVER (PARTITION BY seq ORDER BY step) AS run FROM b),
             k AS (SELECT *, row_number() OVER (PARTITION BY seq, run ORDER BY prob DESC, step) AS n FROM r)
        SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY run) - 1 AS position, cls, prob, CASE WHEN q >= 0.05 THEN o END AS other FROM k WHERE n = 1 AND cls <> 0
    """,
    "q_visible_words": "SELECT doc_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT o_custkey AS doc_id, o_orderkey AS t FROM orders WHERE o_orderkey % 50 >= 20 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_custkey, o_orderkey + 1000000 FROM orders WHERE o_orderkey % 13 = 0) GROUP BY 1",
    "q_region_kinds": """
        SELECT CASE WHEN k % 10 >= 6 THEN 'photo' WHEN k % 4 = 0 AND k % 3 <> 0 THEN 'signature' WHEN k % 3 = 0 AND c % 4 >= 2 THEN NULL WHEN k % 3 = 0 AND c % 6 = 0 THEN 'logo' WHEN k % 3 = 0 THEN 'handwriting' WHEN c % 5 = 0 AND k % 2 = 0 THEN 'stamp'
                    WHEN c % 7 = 0 THEN 'faint_ink' WHEN c % 6 = 0 THEN 'logo' WHEN c % 9 = 0 THEN 'handwriting' WHEN k % 12 >= 8 THEN 'graphic' ELSE 'handwriting' END AS kind, count(*) AS n FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) GROUP BY 1
    """,
}
