"""Operator 3, toxicity: boosted trees over dense features, calibrated by isotonic regression.

Labels are learnt from at most ``MOST_ROWS`` labelled rows (those of lowest hash) with ``MOST_BYTES`` of text, in three parts: one gives the
lexicon, one the trees, one the calibration.  The lexicon holds whole words and word beginnings that are far more
frequent in toxic texts; it is chosen greedily so that each toxic text is covered by a few entries, which keeps out
the other words of texts that occur in many copies.  Features of a text: lexicon densities (whole words, beginnings,
words spelt with digits or signs), how near the hits stand to second-person words, capitals, punctuation and
obfuscation rates, and length.  The document's id, source and language are no features.

Defined results: null and empty texts have features of zero and get the score of such a text; repeated rows get
equal scores; without labelled rows of both kinds every score is the share of toxic labels, or 0; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, documents, now_doing, texts_of

#: Labelled rows that the model is fitted on, and bytes of text they may have together.
MOST_ROWS, MOST_BYTES = 12_000, 64 << 20
#: Lexicon entries at most, hits by entries that each toxic text should have, and what an entry has to be worth.
MOST_ENTRIES, COVER, LEAST_TEXTS, LEAST_ODDS = 400, 3, 4, 20.0
SHORTEST, LONGEST = 4, 8
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
NEAR = 6
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi vous votre vos ton ta tes tú ti usted ustedes vosotros tus".split())
#: Signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"\b(?=\w*[^\W\d_])\w*[\d@$!|][\w@$!|]*[^\W\d_]\w*")
FEATURES = ("log_words", "whole_hits", "begun_hits", "disguised_hits", "whole_density", "begun_density", "disguised_density", "distinct_hits",
            "second_person_density", "hits_near_second_person", "capitals", "capital_words", "exclamations", "punctuation", "signs", "digits", "obfuscation")
_UPPER, _PUNCT, _SIGNS, _DIGITS = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGITS[48:58] = True
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SIGNS[[ord(c) for c in "#$%&*@|~^_+=<>/\\"]] = True


def keys_of(text: str) -> set[str]:
    """Lexicon candidates of a text: its words, marked by a final "$", and their beginnings."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + "$")
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out.add(w[:n])
    return out


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Entries chosen greedily by how many toxic texts they cover that still lack cover."""
    bad, good = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        (bad if label else good).update(keys_of(text))
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic.astype(bool)).sum()))
    odds = {k: ((n + 0.5) / n_bad) / ((good.get(k, 0) + 0.5) / n_good) for k, n in bad.items() if n >= LEAST_TEXTS}
    found = {k: set() for k, o in odds.items() if o >= LEAST_ODDS}
    toxic_texts = [t for t, label in zip(texts, toxic, strict=True) if label]
    for i, text in enumerate(toxic_texts):
        for k in keys_of(text):
            if k in found:
                found[k].add(i)
    need = np.full(len(toxic_texts), COVER)
    chosen: list[str] = []
    while found and len(chosen) < MOST_ENTRIES:
        worth = {k: sum(need[i] > 0 for i in v) for k, v in found.items()}
        # of equal worth, the entry with the better odds, then the longer one, whole words first
        best = max(worth, key=lambda k: (worth[k], odds[k], len(k), k))
        if worth[best] < LEAST_TEXTS:
            break
        chosen.append(best)
        for i in found.pop(best):
            need[i] -= 1
        stem = best.rstrip("$")
        # what only says the same again
        found = {k: v for k, v in found.items() if worth[k] >= LEAST_TEXTS and not (k.startswith(best) or (k.rstrip("$") == stem) or stem.startswith(k.rstrip("$")))}
    return sorted(chosen)


class Lexicon:
    def __init__(self, entries: list[str]):
        self.whole = frozenset(e[:-1] for e in entries if e.endswith("$"))
        self.begun = tuple(e for e in entries if not e.endswith("$"))
        self.heads = frozenset(w[:SHORTEST] for w in (*self.whole, *self.begun))

    def features(self, text: str) -> list[float]:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = max(1, len(data))
        by = np.bincount(data, minlength=256)
        words = WORD.findall(text.lower())
        m = max(1, len(words))
        heads = self.heads
        hits = [(i, w) for i, w in enumerate(words) if w[:4] in heads]
        whole = [(i, w) for i, w in hits if w in self.whole]
        begun = [(i, w) for i, w in hits if w not in self.whole and w.startswith(self.begun)] if self.begun else []
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if you and (whole or begun):
            at, to = np.array(you), np.array([i for i, _ in (*whole, *begun)])
            where = np.searchsorted(at, to)
            near = int(((np.abs(at[np.minimum(where, len(at) - 1)] - to) <= NEAR) | (np.abs(at[np.maximum(where - 1, 0)] - to) <= NEAR)).sum())
        mixed = MIXED.findall(text) if by[48:58].sum() or by[33] or by[36] or by[64] or by[124] else []
        disguised = sum(1 for w in mixed if (x := w.lower().translate(LEET)) in self.whole or (self.begun and x.startswith(self.begun)))
        capitals = sum(map(str.isupper, WORD.findall(text))) if by[65:91].sum() > 0.3 * n else 0
        return [np.log1p(len(words)), len(whole), len(begun), disguised, len(whole) / m, len(begun) / m, disguised / m, len({w for _, w in (*whole, *begun)}),
                len(you) / m, near, float(by[_UPPER].sum()) / n, capitals / m, by[33] / n, float(by[_PUNCT].sum()) / n, float(by[_SIGNS].sum()) / n, float(by[_DIGITS].sum()) / n, len(mixed) / m]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


class Boosted:
    """Logistic gradient boosting with histogram trees of fixed depth; a tree is (feature, threshold) by node and leaf values."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        # a feature that is mostly zero still gets a cut right above zero
        cuts = [np.unique(np.append(c, [0.0, *np.quantile(col[col > 0], [0.25, 0.5, 0.75])])) if (col > 0).any() else c for c, col in zip(cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        self.trees, raw = [], np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(DEPTH):
                chosen = []
                for k in range(1 << level):
                    rows = np.flatnonzero(node == k)
                    chosen.append(self._split(binned[rows], g[rows], h[rows], cuts))
                f, b = np.array([c[0] for c in chosen]), np.array([c[1] for c in chosen])
                node = 2 * node + (binned[np.arange(len(y)), f[node]] > b[node])
                splits.append((f, np.array([cuts[i][j] if j < len(cuts[i]) else np.inf for i, j in zip(f, b, strict=True)])))
            leaf = np.array([RATE * g[node == k].sum() / (h[node == k].sum() + 1.0) for k in range(1 << DEPTH)])
            self.trees.append((splits, leaf))
            raw = raw + leaf[node]

    @staticmethod
    def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int]:
        best, gain = (0, 1 << 30), 1e-6
        if len(g) < 10:
            return best
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f, c in enumerate(cuts):
            sg, sh = (np.cumsum(np.bincount(binned[:, f], w, len(c) + 1))[:-1] for w in (g, h))
            if not len(sg):
                continue
            gains = sg**2 / (sh + 1.0) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1.0) - whole
            if gains.max() > gain:
                best, gain = (f, int(gains.argmax())), float(gains.max())
        return best

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, t in splits:
                node = 2 * node + (x[rows, f[node]] > t[node])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the middles of the blocks and their means, for linear interpolation between them."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # each block is pulled a little towards the mean of all, so that no score is certain
    mean = float(np.mean(y))
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + mean) / (b[1] + 1.0) for b in blocks])


class Model:
    """Lexicon, trees and calibration, fitted on texts and labels."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        toxic = toxic.astype(np.float64)
        self.constant = float(toxic.mean()) if len(toxic) else 0.0
        part = np.arange(len(texts)) % 4  # two quarters, one and one; the rows come in hash order
        parts = [np.flatnonzero(np.isin(part, p)) for p in ((0, 1), (2,), (3,))]
        self.fitted = all(0 < toxic[p].sum() < len(p) for p in parts)
        if not self.fitted:
            return
        take = lambda p: [texts[i] for i in p]
        self.lexicon = Lexicon(learn_lexicon(take(parts[0]), toxic[parts[0]]))
        self.trees = Boosted(self.lexicon.matrix(take(parts[1])), toxic[parts[1]])
        middle, mean = isotonic(self.trees.raw(self.lexicon.matrix(take(parts[2]))), toxic[parts[2]])
        self.middle, self.mean = middle, np.maximum.accumulate(mean)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.constant)
        return np.interp(self.trees.raw(self.lexicon.matrix(texts)), self.middle, self.mean)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Fit on labelled rows that aren't held out: at most ``most_rows``, those with the lowest hash of their id, one row
    for each id, and of them as many in that order as have ``most_bytes`` of text together."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most_rows)
    rows = documents(docs).join(F.broadcast(known), "doc_id").where(F.octet_length("text") <= most_bytes)  # most_rows ids
    first = F.row_number().over(Window.partitionBy("order", "doc_id").orderBy(F.xxhash64("text")))
    rows = rows.withColumn("first", first).where("first = 1")
    # most_rows rows at most are left, so their running size may be taken in one task
    size = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("size", size).where(F.col("size") <= most_bytes).select("order", "doc_id", "text", "toxic").coalesce(1)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)]
        got.sort(key=lambda r: (r[0], r[1]))
        model = Model([r[2] for r in got], np.array([r[3] > 0 for r in got], bool))
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # in a task, so that the sample's texts and words never are in the driver's memory
    bounded_batches(docs.sparkSession)
    made = rows.mapInArrow(fitted, "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else Model([], np.zeros(0, bool))


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text.  Only texts go to Python and only scores come back, in pieces of bounded size."""
    shipped = spark.sparkContext.broadcast(model)  # a few hundred entries and TREES small trees
    bounded_batches(spark)

    @F.arrow_udf("double")
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        now_doing(__name__)
        for part in parts:
            yield pa.array(shipped.value.scores(texts_of(part)), pa.float64())

    return scores(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  No shuffle but of the labels."""
    scored = documents(docs).withColumn("score", score(F.col("text"), fit(docs, labels), docs.sparkSession))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
