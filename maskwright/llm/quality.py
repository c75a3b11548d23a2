"""Operator 7: quality classifier by an interpolated modified Kneser-Ney n-gram model.

The model is over bytes of the text with ASCII letters in lower case, order 5 by default, with four zero bytes before
each text, and trained on all trusted text (rows that `labels.quality` marks 1). A document's perplexity is exp of the
mean negative log-likelihood of its bytes; it is kept unless that is over the threshold of its language, a quantile
of the perplexities of that language's trusted texts. For thresholds, trusted texts are dealt into two
halves by a hash of the text (so copies leave together), and each is scored by a model of the other half only: scored
by a model that was trained on it, a text looks more usual than any new one can, so what the halves lie higher is the
margin. A language with fewer than `least_trusted` different trusted texts has no threshold: its documents are kept,
and a warning names it.

Each task counts the n-grams of its part of the corpus in numpy and sends one row for each distinct n-gram; counts,
continuation counts, discounts and interpolated probabilities are then aggregations and joins on n-grams. Every n-gram
that the corpus holds gets its log-probability by joins order by order (sharded by n-gram); what is gathered grows with
the different n-grams, of which ten times the text of the tables has 1.6 times as many at order 5, 2.9 at order 7.
Scoring reads the table of log-probabilities shard by shard: a shard is bounded by SHARD_ROWS rows
(12 bytes each), is broadcast, and every document sums what it finds in it; sums of all shards are added. One pass over
the texts is one shard, and the number of shards follows from the number of n-grams.

Defined cases: an empty or null text has perplexity null and is kept; null languages form a language of their own;
labels that are null or repeated count once (trusted if any row says so); without trusted text all documents are kept
with perplexity null and without threshold. Repeated rows are scored like any other; empty tables give no rows; long
texts are scored whole. `keep` carries all columns of docs.
"""

import logging
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import few, give_back, lean, mix, pieces, read, text_buffer, written

ORDER, QUANTILE = 5, 0.99
#: A new text like n others lies over all of them with a chance of 1 / (n + 1); with fewer than this that is over a tenth.
LEAST_TRUSTED = 9
#: The model of all trusted text, and those that leave out half 0 and half 1.
FULL, WITHOUT = 0, (1, 2)
#: Most rows of a table of labels that is broadcast, and most n-grams of a shard.
BROADCAST_ROWS, SHARD_ROWS = 1_000_000, 2_000_000
#: Bytes worked on at once.
CHUNK = 1_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
log = logging.getLogger(__name__)


def codes(raw: np.ndarray, offsets: np.ndarray, order: int, a: int = 0, b: int | None = None) -> np.ndarray:
    """The n-gram that ends at each byte from a to b, as a number; zero bytes stand before the start of a row."""
    b = len(raw) if b is None else b
    back = max(0, a - order + 1)
    low = LOWER[raw[back:b]].astype(np.int64)
    into = np.arange(a, b) - np.repeat(offsets[:-1], np.diff(np.clip(offsets, a, b)))  # the position in the row
    out = low[a - back :].copy()
    for k in range(1, order):
        part = np.zeros(b - a, np.int64)
        skip = max(0, k - (a - back))
        part[skip:] = low[a - back - k + skip : b - back - k]
        part[into < k] = 0
        out |= part << (8 * k)
    return out


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with __trusted and __half (0 or 1 by text, -1 if not trusted). Labels are broadcast only if they are few; else
    both sides are shuffled."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__good")).distinct()
    good = F.broadcast(good) if few(good, BROADCAST_ROWS) else good
    half = F.when(F.col("__good").isNotNull(), F.pmod(F.xxhash64("text"), F.lit(2))).otherwise(-1).cast("int")
    return docs.join(good, docs.doc_id == F.col("__good"), "left").withColumns({"__trusted": F.col("__good").isNotNull(), "__half": half}).drop("__good")


def count_ngrams(docs: DataFrame, order: int) -> DataFrame:
    """gram long, n0 long, n1 long (in each half of the trusted text): all n-grams of all text. docs: text, __half."""
    import pyarrow as pa

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros((0, 2), np.int64))]

        def merged():
            g = np.concatenate([x for x, _ in held])
            order_ = np.argsort(g, kind="stable")
            g, n = g[order_], np.concatenate([x for _, x in held])[order_]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
            return g[first], np.add.reduceat(n, first) if len(g) else n

        for batch in pieces(batches, 0, CHUNK):
            raw, offsets = text_buffer(batch.column(0))
            half = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(offsets))
            for a in range(0, len(raw), CHUNK):
                b = min(a + CHUNK, len(raw))
                part, own = codes(raw, offsets, order, a, b), half[a:b]
                for h in (-1, 0, 1):
                    g, times = np.unique(part[own == h], return_counts=True)
                    n = np.zeros((len(g), 2), np.int64)
                    if h >= 0:
                        n[:, h] = times
                    held.append((g, n))
            if len(held) > 8:
                held[:] = [merged()]
        held[:] = [merged()]
        g, n = held[0]
        for a in range(0, len(g), 100_000):
            end = a + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(g[a:end]), pa.array(n[a:end, 0].copy()), pa.array(n[a:end, 1].copy())], ["gram", "n0", "n1"])

    found = docs.select("text", "__half").mapInArrow(lean(run), "gram long, n0 long, n1 long")
    return found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def by_model(counts: DataFrame) -> DataFrame:
    """model, gram, n: what each model is asked for (the halves only n-grams of trusted text) and is trained on."""
    full = F.struct(F.lit(FULL).alias("model"), (F.col("n0") + F.col("n1")).alias("n"))
    without = [F.struct(F.lit(m).alias("model"), F.col(n).alias("n")) for m, n in zip(WITHOUT, ("n1", "n0"), strict=True)]
    models = F.when(F.col("n0") + F.col("n1") > 0, F.array(full, *without)).otherwise(F.array(full))
    return counts.select("gram", F.explode(models).alias("x")).select("x.model", "gram", "x.n")


def discounts(table: DataFrame) -> Column:
    """D1, D2 or D3+ of a model for n, from counts of counts (four numbers for each model)."""
    rows = table.filter("n BETWEEN 1 AND 4").groupBy("model", F.col("n").alias("c")).agg(F.count("*").alias("k")).collect()
    found = {(r["model"], r["c"]): r["k"] for r in rows}
    bound = lambda d, top: min(max(d, 0.05), top - 0.05)
    cuts = []
    for model in (FULL, *WITHOUT):
        n1, n2, n3, n4 = (max(found.get((model, i), 0), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts.append((bound(1 - 2 * y * n2 / n1, 1), bound(2 - 3 * y * n3 / n2, 2), bound(3 - 4 * y * n4 / n3, 3)))
    d1, d2, d3 = (F.get(F.array(*map(F.lit, d)), F.col("model")) for d in zip(*cuts, strict=True))
    return F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """model, gram, logp for each row of counts (model, gram, n): interpolated modified Kneser-Ney, down to a uniform distribution."""
    tables = {order: counts.filter("n > 0").select("model", "gram", "n")}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct bytes before the gram
        tables[k] = tables[k + 1].groupBy("model", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
        tables[k] = written(tables[k], f"kn-{k}")
    asked = {order: counts.select("model", "gram")}
    for k in range(order - 1, 0, -1):
        asked[k] = asked[k + 1].select("model", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")).distinct()
    p = None
    for k in range(1, order + 1):
        cut = discounts(tables[k])
        context = tables[k].groupBy("model", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"))
        q = asked[k].join(tables[k], ["model", "gram"], "left").withColumn("context", F.shiftright("gram", 8)).join(context, ["model", "context"], "left")
        if p is None:
            q = q.withColumn("lower", F.lit(1 / 256))
        else:
            q = q.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(p.select("model", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["model", "suffix"])
        own = F.when(F.col("n") > 0, (F.col("n") - cut) / F.col("total")).otherwise(0.0)
        p = q.select("model", "gram", F.when(F.col("total") > 0, own + F.col("freed") / F.col("total") * F.col("lower")).otherwise(F.col("lower")).alias("p"))
        p = written(p, f"kn-p{k}")
    return p.select("model", "gram", F.log("p").cast("float").alias("logp"))


class Lookup:
    """Open addressing: sums of log-probabilities by gram, 0 where a gram is not in this shard."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray):
        bits = max(4, int(4 * max(1, len(gram))).bit_length() - 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        rest = np.arange(len(gram))
        at = self.slot(gram)
        while len(rest):
            free = self.key[at] < 0
            self.key[at[free]] = gram[rest[free]]  # of several for one slot the last stays
            won = self.key[at] == gram[rest]
            self.value[at[won]] = logp[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & self.mask

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return (mix(gram.astype(np.uint64)) >> self.shift).astype(np.int64)

    def of(self, gram: np.ndarray) -> np.ndarray:
        at = self.slot(gram)
        held = self.key[at]
        out = np.where(held == gram, self.value[at], np.float32(0))
        rest = np.flatnonzero((held != gram) & (held >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            held = self.key[at]
            hit = held == gram[rest]
            out[rest[hit]] = self.value[at[hit]]
            more = ~hit & (held >= 0)
            rest, at = rest[more], at[more]
        return out


def shards(table: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The table in parts of at most about SHARD_ROWS rows, read one after the other."""
    n = -(-table.count() // SHARD_ROWS)
    for s in range(n):
        part = table.filter(F.pmod(F.xxhash64("gram"), F.lit(n)) == s).toArrow()
        yield part.column("gram").to_numpy(), part.column("logp").to_numpy()


def score(docs: DataFrame, tables: list[tuple[DataFrame, Column]], order: int = ORDER) -> DataFrame:
    """docs with __nll (null for empty text), the mean negative log-likelihood of a byte. Each table scores a column, which
    is the text or, where another table does, null. Each shard adds one narrow step."""
    import pyarrow as pa

    total = F.lit(0.0)
    for table, text in tables:
        for gram, logp in shards(table):
            shard = docs.sparkSession.sparkContext.broadcast((gram, logp))

            @F.arrow_udf("double")
            def summed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
                lookup = Lookup(*shard.value)  # noqa: B023
                for texts in parts:
                    raw, offsets = text_buffer(texts)
                    sums, at = np.zeros(len(texts)), 0
                    while at < len(texts):  # about CHUNK bytes at a time, whole rows
                        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
                        own = offsets[at : end + 1] - offsets[at]
                        found = lookup.of(codes(raw[offsets[at] : offsets[end]], own, order))
                        sums[at:end] = np.diff(np.concatenate(([0.0], np.cumsum(found, dtype=np.float64)))[own])
                        at = end
                    yield pa.array(sums)
                give_back()

            total = total + summed(text)
    bytes_ = F.octet_length("text")
    return docs.withColumn("__nll", F.when(bytes_ > 0, -total / bytes_))


def models(trusted: DataFrame, order: int) -> DataFrame | None:
    """model, gram, logp of all models; none without trusted text. trusted: text, __half."""
    counts = written(count_ngrams(trusted, order), "kn-counts")
    return None if counts.filter("n0 + n1 > 0").isEmpty() else log_probabilities(by_model(counts), order)


def of_model(table: DataFrame, model: int) -> DataFrame:
    return table.filter(F.col("model") == model).select("gram", "logp")


def scored(trusted: DataFrame, table: DataFrame | None, order: int) -> DataFrame:
    """trusted with __nll of the model of all trusted text."""
    if table is None:
        return trusted.withColumn("__nll", F.lit(None).cast("double"))
    return score(trusted, [(of_model(table, FULL), F.col("text"))], order)


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """docs with __trusted, __half and __nll."""
    trusted = with_trust(docs, labels)
    return scored(trusted, models(trusted, order), order)


def left_out(trusted: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """lang, __text (a hash), __nll of trusted documents by the model that leaves their half out."""
    own = trusted.filter("__trusted").select("lang", "text", "__half")
    by_half = [(of_model(table, m), F.when(F.col("__half") == h, F.col("text"))) for h, m in enumerate(WITHOUT)]
    return score(own, by_half, order).select("lang", F.xxhash64("text").alias("__text"), "__nll")


def thresholds(held: DataFrame, quantile: float, least_trusted: int) -> DataFrame:
    """__lang, __most: the perplexity over which a document of the language goes, null where trusted texts are too few. Copies count once."""
    texts = held.filter("__nll IS NOT NULL").groupBy("lang", "__text").agg(F.max("__nll").alias("__nll"))
    most = F.when(F.count("*") >= least_trusted, F.percentile_approx(F.exp("__nll"), quantile, 10000))
    return texts.groupBy(F.col("lang").alias("__lang")).agg(most.alias("__most"))


def warn(docs: DataFrame, limits: DataFrame) -> None:
    """Logs which languages have no threshold (twenty at most by name)."""
    open_ = docs.groupBy("lang").agg(F.count("*").alias("n")).join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left").filter("__most IS NULL")
    all_ = open_.agg(F.count("*").alias("langs"), F.sum("n").alias("n")).first()
    if all_["langs"]:
        named = ", ".join(f"{r['lang']} ({r['n']})" for r in open_.orderBy(F.desc("n"), "lang").limit(20).collect())
        log.warning("quality: too little trusted text for a threshold in %d languages; their %d documents are kept: %s", all_["langs"], all_["n"], named)


def limits_of(trusted: DataFrame, table: DataFrame | None, order: int, quantile: float, least_trusted: int) -> DataFrame:
    """thresholds of all languages with trusted text, written; languages without are reported."""
    none = trusted.sparkSession.createDataFrame([], "__lang string, __most double")
    limits = none if table is None else written(thresholds(written(left_out(trusted, table, order), "kn-held"), quantile, least_trusted), "kn-limits")
    warn(trusted.select("lang"), limits)
    return limits


def judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """scores with perplexity, threshold and kept."""
    joined = scores.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    ppl = F.exp("__nll")
    return joined.withColumns({"perplexity": ppl, "threshold": F.col("__most"), "kept": F.coalesce(ppl <= F.col("__most"), F.lit(True))})


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept: one row for each row of docs. The threshold is null where a language has none."""
    trusted = with_trust(docs.select("doc_id", "lang", "text"), labels)
    table = models(trusted, order)
    limits = limits_of(trusted, table, order, quantile, least_trusted)
    return judged(scored(trusted, table, order), limits).select("doc_id", "lang", "perplexity", "threshold", "kept")


def keep(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """The rows of docs that stay, with their columns, whatever their names."""
    trusted = with_trust(docs.select(F.struct("*").alias("row"), "doc_id", "lang", "text"), labels)
    table = models(trusted, order)
    limits = limits_of(trusted, table, order, quantile, least_trusted)
    return judged(scored(trusted, table, order), limits).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents", "doc_id", "lang", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
