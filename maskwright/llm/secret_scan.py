"""Operator 2: secret scans.

Three fixed patterns give the base spans. Two character Markov models, one of random strings and one of ordinary
identifiers, add spans: a token whose log-likelihood ratio is over a threshold, in all and for each character, is
reported as `markov` unless it overlaps a base span or has no letter (numbers are no keys).

The models are bigram counts over 66 symbols with additive smoothing, trained from labelled samples (text, label) by
one aggregation; they have 66 x 66 cells whatever the number of samples. The samples (2 x SAMPLES, a documented bound)
are made here: random strings over six alphabets, identifiers of two to six of 145 common words in six
spellings, and filling. Texts are read in Arrow batches. Vectorised
byte classes find the few rows that can hold a span at all (necessary conditions only), and the patterns then run over
the whole of those texts.

Defined cases: null and empty texts have no spans. Offsets are code points, end exclusive. Repeated rows are scanned
like any other. Other columns are not carried, so none can clash. The result has one row for each row of docs.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import lean, pieces, read, text_buffer

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Symbols of the models; index 0 is the start of a token.
SYMBOLS = "^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
SYMBOLS_ALL = SYMBOLS + "-"
INDEX = np.zeros(128, np.int64)
for _i, _c in enumerate(SYMBOLS_ALL):
    INDEX[ord(_c)] = _i
TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[[ord(c) for c in SYMBOLS_ALL[1:]]] = True
HEX_BYTE = np.zeros(256, bool)
HEX_BYTE[[ord(c) for c in "0123456789abcdef"]] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32

WORDS = (
    "get set put add remove delete create update read write open close load save find count list map key value name id user account group role item "
    "order price total amount index offset limit page size width height color style header footer body title content message error warning info debug log "
    "test case check build make run start stop begin end init config option param request response server client host port path file folder image video audio "
    "time date year month day hour minute second first last next previous current default public private static final class object type string number array "
    "buffer stream channel thread process memory cache table column row field record query result report chart graph node edge tree root parent child main "
    "version release branch commit merge review mail phone address city country street product customer supplier invoice payment license general international"
).split()


#: Samples of each label.
SAMPLES = 6000


def labelled_samples(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """n random strings (label 1) and n ordinary identifiers (label 0)."""
    rng = random.Random(seed)
    kinds = ["0123456789abcdef", "0123456789ABCDEF", SYMBOLS[1:63], SYMBOLS[1:63], SYMBOLS[1:65], SYMBOLS[1:63] + "_-"]
    out = [("".join(rng.choices(rng.choice(kinds), k=rng.randint(16, 64))), 1) for _ in range(n)]
    for i in range(n):
        parts = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        how = rng.randrange(6)
        text = (
            "_".join(parts) if how == 0 else "-".join(parts) if how == 1 else "/".join(parts) if how == 2
            else parts[0] + "".join(p.title() for p in parts[1:]) if how == 3 else "".join(p.title() for p in parts) if how == 4 else "".join(parts)
        )
        if rng.random() < 0.4:
            text += rng.choice(["", "_", "-"]) + str(rng.choice([rng.randrange(100), rng.randrange(1990, 2040), 2000_01_01 + rng.randrange(300_000)]))
        if i % 20 == 0:  # filling: one sign over and over
            out.append((SYMBOLS[1 + i // 20 % 62] * rng.randint(16, 40), 0))
            continue
        out.append((text.upper() if rng.random() < 0.1 else text, 0))
    return out


def train(samples: DataFrame, smoothing: float = 0.5) -> np.ndarray:
    """log P(next | symbol, random) - log P(next | symbol, identifier), from rows of text and label."""
    chars = F.concat(F.array(F.lit("^")), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9+/_=-]"), 0))
    pairs = samples.select("label", F.explode(F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = np.full((2, len(SYMBOLS_ALL), len(SYMBOLS_ALL)), smoothing)
    for label, pair, n in pairs.groupBy("label", "pair").count().collect():  # at most 2 x 66 x 66 rows
        counts[int(label), INDEX[ord(pair[0])], INDEX[ord(pair[1])]] += n
    logs = np.log(counts / counts.sum(2, keepdims=True))
    return logs[1] - logs[0]


def ratio(model: np.ndarray, token: str) -> float:
    at = INDEX[np.frombuffer(("^" + token).encode("ascii"), np.uint8)]
    return float(model[at[:-1], at[1:]].sum())


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover together, ascending."""
    begin: list[int] = []
    end: list[int] = []
    for s, e in sorted(spans):
        if end and s <= end[-1]:
            end[-1] = max(end[-1], e)
        else:
            begin.append(s)
            end.append(e)
    return begin, end


def spans_of(text: str, model: np.ndarray, least: float = 12.0, least_per_char: float = 0.5) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    begin, end = merged([s[1:] for s in found])
    for m in TOKEN.finditer(text):
        s, e = m.span()
        token = m[0]
        k = bisect_right(end, s)  # the first base span that ends behind s
        if k < len(begin) and begin[k] < e or not any(c.isalpha() for c in token):
            continue
        score = ratio(model, token)
        if score >= least and score >= least_per_char * len(token):
            found.append(("markov", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def long_runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], member.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


def worth_reading(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span: a keyword, AKIA, a long hex run, or a long token."""
    rows = np.zeros(len(offsets), np.int64)

    def mark(start, end):
        np.add.at(rows, np.searchsorted(offsets, start, "right") - 1, 1)
        np.add.at(rows, np.searchsorted(offsets, end - 1, "right"), -1)

    mark(*long_runs(TOKEN_BYTE[raw], 16))
    mark(*long_runs(HEX_BYTE[raw], 24))
    lower = LOWER_BYTE[raw].tobytes()
    for word in (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia"):
        at, hits = lower.find(word), []
        while at >= 0:
            hits.append(at)
            at = lower.find(word, at + 1)
        if hits:
            hits = np.array(hits)
            mark(hits, hits + 1)
    return np.cumsum(rows)[:-1] > 0 if len(offsets) > 1 else np.zeros(0, bool)


def secret_spans(docs: DataFrame, model: np.ndarray, least: float = 12.0, least_per_char: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>: one row for each row of docs."""
    import pyarrow as pa

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        for batch in pieces(batches, 1):
            text = batch.column(1)
            may = worth_reading(*text_buffer(text))
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(text[i].as_py() or "", model, least, least_per_char)] if may[i] else [] for i in range(len(may))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lean(scan), "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    )


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark.createDataFrame(labelled_samples(), "text string, label int"))
    spans = F.col("spans")
    n = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(read(spark, sf_dir, "documents", "doc_id", "text"), model).select(
        "doc_id", *map(n, KINDS), F.sha2(joined(F.filter(spans, lambda x: x["kind"] != "markov")), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
