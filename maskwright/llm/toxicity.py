"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed lexicon, of learned words and of learned word beginnings; how often such words
stand near a second-person pronoun; rates of second-person pronouns, capitals, shouted words, exclamation marks,
punctuation, digits and obfuscation (a sign or digit between letters), and lexicon words after signs are read as letters.

Training uses at most SAMPLE labelled rows, those with the smallest hashes of doc_id (a documented bound); rows whose
crc32(doc_id as text) mod 5 is 0 are never learned from. The lexicon is learned in the executors from the sample's
toxic rows and LEXICON_CLEAN times as many others, and has at most LEXICON entries; only it and the sample's feature
rows (at most SAMPLE x 15 numbers) reach the driver. A quarter of the sample calibrates the trees' scores. Every row
and whole text is scored, about CHUNK bytes at a time; a score depends on its own text only.

Defined cases: null and empty texts have all features 0 and get the score of such a row; repeated labels of a doc_id
count once (toxic if any says so); labels without both classes give every row their mean (0.5 without labels). A null
doc_id counts as held out. Other columns are not read, so none can clash.
"""

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import lean, pieces, read, text_buffer

SAMPLE, LEXICON, LEXICON_CLEAN, LEXICON_ODDS, LEXICON_LEAST = 12_000, 2_000, 3, 12.0, 4
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 64
#: Bytes of text worked on at once.
CHUNK = 500_000

# Common insults and second-person words in English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb fool jerk ugly hate garbage vermin imbecile "
    "dumm dummkopf trottel abschaum versager widerlich wertlos hässlich arschloch "
    "idiote stupide imbécile ordure minable dégoûtant crétin connard raclure "
    "estúpido estúpida imbécil basura patético asqueroso inútil perdedor escoria tonto".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes su sus vosotros".split())
WORDS = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_]+(?:[@$!*013457|]+[^\W\d_]+)+")
PLAIN = str.maketrans("@$!*013457|", "asiioieasti")
PREFIXES = (4, 5, 6)
FEATURES = 15

UPPER_B, DIGIT_B, LETTER_B, SIGN_B, BANG_B, PUNCT_B = (np.zeros(256, np.int64) for _ in range(6))
UPPER_B[65:91] = 1
DIGIT_B[48:58] = 1
LETTER_B[65:91] = LETTER_B[97:123] = LETTER_B[128:] = 1
SIGN_B[[ord(c) for c in "@$!*013457|"]] = 1
BANG_B[ord("!")] = 1
PUNCT_B[33:48] = PUNCT_B[58:65] = PUNCT_B[91:97] = PUNCT_B[123:127] = 1


def trainable(c):
    """False for rows that are held out."""
    return F.coalesce(F.crc32(c.cast("string")) % 5 != 0, F.lit(False))


class Flags(dict):
    """Bits of a word: 1 fixed lexicon, 2 learned word, 4 learned beginning, 8 second person."""

    def __init__(self, words: frozenset, prefixes: frozenset):
        super().__init__()
        self.words, self.prefixes = words, prefixes

    def __missing__(self, w: str) -> int:
        bits = (w in INSULTS) | (w in self.words) << 1 | any(w[:k] in self.prefixes for k in PREFIXES if len(w) >= k) << 2 | (w in SECOND) << 3
        if len(self) > 500_000:
            self.clear()
        self[w] = bits
        return bits


def features(column, flags: Flags) -> np.ndarray:
    """One row of FEATURES numbers for each text of an Arrow column."""
    raw, offsets = text_buffer(column)
    sums = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[offsets])
    letter = LETTER_B[raw]
    odd = np.zeros(len(raw), np.int64)
    odd[1:-1] = letter[:-2] * SIGN_B[raw][1:-1] * letter[2:]
    some = np.flatnonzero(np.diff(offsets))  # the first and the last byte of a text have one neighbour only
    odd[offsets[:-1][some]] = odd[offsets[1:][some] - 1] = 0
    letters, odds = sums(letter), sums(odd)
    per = np.maximum(np.diff(offsets), 1)
    x = np.zeros((len(offsets) - 1, FEATURES))
    x[:, 0] = sums(UPPER_B[raw]) / np.maximum(letters, 1)
    x[:, 1] = sums(BANG_B[raw]) / per
    x[:, 2] = sums(PUNCT_B[raw]) / per
    x[:, 3] = sums(DIGIT_B[raw]) / per
    x[:, 4] = odds / per
    for i, text in enumerate(column.to_pylist()):
        if not text:
            continue
        words = WORDS.findall(text.lower())
        n = len(words)
        if not n:
            continue
        bits = np.fromiter(map(flags.__getitem__, words), np.int64, n)
        bad, you = np.flatnonzero(bits & 7), np.flatnonzero(bits & 8)
        if len(bad):
            for k in range(3):
                hit = np.count_nonzero(bits & (1 << k))
                x[i, 5 + k], x[i, 8 + k] = hit / n, min(hit, 20)
            if len(you):
                gap = np.minimum(np.abs(bad - you[np.minimum(np.searchsorted(you, bad), len(you) - 1)]), np.abs(bad - you[np.maximum(np.searchsorted(you, bad) - 1, 0)]))
                x[i, 11] = np.count_nonzero(gap <= 3) / n
        x[i, 12] = len(you) / n
        if odds[i]:
            plain = [w.translate(PLAIN) for w in OBFUSCATED.findall(text.lower())]
            x[i, 13] = sum(1 for w in plain if flags[w] & 7) / n
        x[i, 14] = np.log1p(n)
    return x


def tokens(text: str) -> set[str]:
    words = set(WORDS.findall((text or "").lower()))
    return {f"w{w}" for w in words if len(w) > 2} | {f"p{w[:k]}" for w in words for k in PREFIXES if len(w) >= k}


def learn_lexicon(sample: DataFrame) -> tuple[frozenset, frozenset]:
    """Words and word beginnings that toxic rows of the sample (text, toxic) hold far more often than others."""
    import pyarrow as pa

    def run(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in tokens(text):
                    held.setdefault(t, [0, 0])[toxic] += 1
        names = list(held)
        for a in range(0, len(names), 50_000):
            part = names[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([held[t][1] for t in part], pa.int64()), pa.array([held[t][0] for t in part], pa.int64())], ["token", "bad", "good"])

    bad, good = F.sum("bad").alias("bad"), F.sum("good").alias("good")
    totals = dict(sample.groupBy("toxic").count().collect())
    odds = (F.col("bad") / max(1, totals.get(1, 0))) / ((F.col("good") + 0.5) / max(1, totals.get(0, 0)))
    best = (
        sample.select("text", "toxic").mapInArrow(lean(run), "token string, bad long, good long").groupBy("token").agg(bad, good)
        .filter((F.col("bad") >= LEXICON_LEAST) & (odds >= LEXICON_ODDS)).orderBy(F.desc("bad"), "token").limit(LEXICON).select("token").collect()
    )
    return frozenset(t[1:] for (t,) in best if t[0] == "w"), frozenset(t[1:] for (t,) in best if t[0] == "p")


class Trees:
    """Boosted regression trees for the logistic loss, over at most BINS quantile bins of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        for j, c in enumerate(x.T):  # rare positive values get bins of their own
            if (some := c[c > 0]).size:
                self.edges[j] = np.unique(np.concatenate((self.edges[j][:: 2], [0.0], np.quantile(some, np.linspace(0, 1, BINS // 2)[:-1]))))
        b = self.binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees, f = [], np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._leaf(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    @staticmethod
    def _grow(b, g, h):
        node = np.zeros(len(g), np.int64)
        split = {}
        for _ in range(DEPTH):
            for k in np.unique(node):
                at = np.flatnonzero(node == k)
                best = (1e-3, None)
                for j in range(b.shape[1]):
                    sg, sh = np.cumsum(np.bincount(b[at, j], g[at], BINS * 2)), np.cumsum(np.bincount(b[at, j], h[at], BINS * 2))
                    n = np.cumsum(np.bincount(b[at, j], minlength=BINS * 2))
                    gain = sg**2 / (sh + 1) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + 1) - sg[-1] ** 2 / (sh[-1] + 1)
                    gain[(n < 10) | (n[-1] - n < 10)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), (j, int(gain.argmax())))
                if best[1]:
                    split[int(k)] = best[1]
            node = Trees._route(split, b, node)
        value = {int(k): RATE * g[node == k].sum() / (h[node == k].sum() + 1) for k in np.unique(node)}
        return split, value

    @staticmethod
    def _route(split, b, node):
        """One level down: node k goes to 2k+1 or 2k+2; nodes without a split stay."""
        out = node.copy()
        for k, (j, cut) in split.items():
            at = node == k
            out[at] = np.where(b[at, j] <= cut, 2 * k + 1, 2 * k + 2)
        return out

    def _leaf(self, tree, b):
        split, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            node = self._route(split, b, node)
        table = np.zeros(2 ** (DEPTH + 1))
        for k, v in value.items():
            table[k] = v
        return table[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + sum((self._leaf(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks that pooling of adjacent violators gives."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of score, rows
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, s, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            v2 = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], v2, strict=True)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the bounded sample."""
    marked = (
        labels.filter(F.col("toxic").isNotNull() & trainable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    return docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most SAMPLE rows of two numbers


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """What scoring needs: lexicon, trees and calibration."""
    import pyarrow as pa

    rows = training_rows(docs, labels)
    counts = dict(rows.groupBy("toxic").count().collect())
    if not counts.get(0) or not counts.get(1):
        return {"constant": counts.get(1, 0) / sum(counts.values()) if counts else 0.5}
    share = min(1.0, LEXICON_CLEAN * counts[1] / counts[0])
    lexicon = learn_lexicon(rows.filter((F.col("toxic") == 1) | (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) < int(1000 * share))))

    def run(batches):
        flags = Flags(*lexicon)
        for batch in pieces(batches, 1, CHUNK):
            x = features(batch.column(1), flags)
            fold = [zlib.crc32(f"fold:{d}".encode()) % 4 for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(fold, pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "fold", "x"])

    got = rows.select("doc_id", "text", "toxic").mapInArrow(lean(run), "toxic int, fold int, x array<double>").toArrow()
    x, y, fold = np.stack(got.column("x").to_numpy()), got.column("toxic").to_numpy().astype(float), got.column("fold").to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the order in which rows arrive doesn't matter
    x, y, fold = x[order], y[order], fold[order]
    if len(set(y[fold == 0])) < 2 or len(set(y[fold > 0])) < 2:
        fold = np.arange(len(y)) % 4
    trees = Trees(x[fold > 0], y[fold > 0])
    return {"lexicon": lexicon, "trees": trees, "calibration": isotonic(trees.score(x[fold == 0]), y[fold == 0])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row for each row of docs."""
    import pyarrow as pa

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if "constant" in model:
        return base.select("doc_id", F.lit(float(model["constant"])).alias("score"))

    def run(batches):
        flags = Flags(*model["lexicon"])
        at, value = model["calibration"]
        for part in pieces(batches, 1, CHUNK):
            raw = model["trees"].score(features(part.column(1), flags))
            # within a block of equal values the trees' own order stays, by less than a thousandth
            s = 0.999 * np.interp(raw, at, value) + 0.001 / (1 + np.exp(-raw))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])

    return base.mapInArrow(lean(run), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", (~trainable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
