"""Operator 8: n-gram Jaccard join.

A text's set holds the hashes (64 bits) of its distinct runs of `words` words, A-Z in lower case; a text with fewer
words has its whole sequence as one. Two texts link when 100 * intersection >= percent * union. The result has one row
for each document with its component, the smallest doc_id that links reach, and the number of other sets linked.

1. Order. Tokens are ordered by how often they occur, if that is often, and then by hash: any fixed order gives right
   results, this one puts passages that very many texts share last. Each task counts its tokens CHUNK at a time and
   reports those found LOCAL times; frequent are those whose reports add up to a SHARE of all tokens, so there are at
   most 1 / SHARE of them however large the corpus is.
2. Keys. Of sets that link, each misses at most (100 - percent) % of its own tokens in the other, so they share one of
   their first floor((100 - percent) % of n) + 1 tokens. Tokens that only one text has among its first are dropped.
   A key carries the size n of its set and its place i in the order. Sets that link differ in size by a factor of
   percent / 100 at most, so they are in the same or in neighbouring bands of sizes; and at the first token they share
   the overlap is at most min(n - i) of the two.
3. Bit counts. A set has a bitmap with at least a hashed bit for each token; bits of x that y lacks bound the overlap
   from above. Texts that share a key are compared by sizes, places and bitmaps: first each with one text of its key
   (the smallest doc_id, then the largest), which merges large groups of copies at linear cost; then, for keys that
   still hold more than one component, texts of different components band by band: a tile holds a band of a key
   and its next band. Small tiles give the pairs that sizes and places let link; large ones give
   spanning edges: the texts outside of a tile's largest component meet each other in blocks, and meet the members of
   that component, if their sizes agree, once for all keys. Bitmaps are sent last. What is connected now holds all links.
4. Exact. Each set that is left with company is sent once, to its component, and compared by intersecting sorted
   arrays. Components of over SMALL sets are cut into size-banded blocks of about BLOCK sets, and tiles of two blocks
   (of the same or the next band) are solved on their own and joined by their edges.

Equal sets are one node throughout, so thousands of copies cost one row each. Nothing is collected to the driver but
the frequent tokens. Tables between the steps are deleted as soon as nothing reads them.

Defined cases: texts that are null or without words have no set and link with nothing. Rows that share a doc_id are one
node. A null doc_id is larger than all others (2**63 - 1 stands for it, and comes back as null). Other columns are not
carried, so none can clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import Prefix, discard, lean, mix, pieces, read, text_buffer, text_of, written
from maskwright.llm.components import components

WORDS, PERCENT = 4, 85
BITS, PAIRS, TILE, GRID, SMALL, BLOCK, ROWS = 1024, 32, 64, 256, 64, 256, 8192
CHUNK, LOCAL, SHARE = 2_000_000, 4, 1e-6
NO_ID = 2**63 - 1
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def sets_of(column, words: int):
    """The sets of the rows of an Arrow string column, about half a megabyte of text and at most ROWS rows at a time: yields
    (first row, tokens, bounds); tokens[bounds[i]:bounds[i + 1]] are the sorted distinct hashes (uint64) of row first + i."""
    raw, offsets = text_buffer(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + 500_000, "right")) - 1), at + ROWS)
        own = offsets[at : end + 1] - offsets[at]
        data = LOWER[raw[offsets[at] : offsets[end]]]
        inside = ~SPACE_BYTE[data]
        first = np.zeros(len(data) + 1, bool)
        first[own] = True
        start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
        stop = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        word = mix(Prefix(data).of(start, stop)) if len(data) else np.zeros(0, np.uint64)
        bound = np.searchsorted(start, own)
        row = np.repeat(np.arange(end - at, dtype=np.uint16), np.diff(bound))
        n = max(0, len(word) - words + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(words):
            runs += word[k : n + k] * FACTORS[k]
        whole = np.flatnonzero(row[:n] == row[words - 1 : n + words - 1])
        tokens, row = mix(runs[whole]), row[whole]
        short = np.flatnonzero((np.diff(bound) > 0) & (np.diff(bound) < words))
        if len(short):  # fewer words than a run: the whole sequence is one
            few = [mix((word[x:y] * FACTORS[32 : 32 + y - x]).sum(keepdims=True) + np.uint64(y - x)) for x, y in zip(bound[short], bound[short + 1], strict=True)]
            tokens, row = np.concatenate((tokens, *few)), np.concatenate((row, short.astype(np.uint16)))
        order = np.argsort(tokens)
        order = order[np.argsort(row[order], kind="stable")]
        tokens, row = tokens[order], row[order]
        if len(tokens):
            new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])))
            tokens, row = tokens[new], row[new]
        yield at, tokens, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=end - at))))
        at = end


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n tokens: a power of two, n or more, from BITS on."""
    return np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def bitmaps(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the bitmaps of sets end to end, with a bit or more for each token, and where each begins. Half of one is its
    two halves or-ed."""
    size = widths(np.diff(bounds))
    begin = np.concatenate(([0], np.cumsum(size)))
    bits = np.zeros(begin[-1], np.uint8)
    n = np.diff(bounds)
    bits[np.repeat(begin[:-1], n) + ((tokens >> np.uint64(20)).astype(np.int64) & (np.repeat(size, n) - 1))] = 1
    return np.packbits(bits, bitorder="little").view(np.int64), begin // 64


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for the empty one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ FACTORS[0]), dtype=np.uint64)))
    n = np.diff(bounds).astype(np.uint64)
    return np.where(n > 0, (sums[bounds[1:]] - sums[bounds[:-1]]) * FACTORS[1] + n, np.uint64(0)).view(np.int64)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """did, n, sig, bits: one row for each row of docs (did, text)."""
    import pyarrow as pa

    def run(batches):
        for batch in pieces(batches, 1):
            for at, tokens, bounds in sets_of(batch.column(1), words):
                bits, begin = bitmaps(tokens, bounds)
                cols = [batch.column(0).slice(at, len(bounds) - 1), pa.array(np.diff(bounds).astype(np.int32)), pa.array(signatures(tokens, bounds))]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(bits))], ["did", "n", "sig", "bits"])

    return docs.select("did", "text").mapInArrow(lean(run), "did long, n int, sig long, bits array<long>")


def frequent(docs: DataFrame, words: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that hold a SHARE of all (their number is given), ascending, and how often they were found."""
    import pyarrow as pa

    def often(held):
        found, times = np.unique(np.concatenate(held), return_counts=True)
        many = times >= LOCAL
        found, times = found[many].view(np.int64), times[many]
        for a in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[a : a + 100_000]), pa.array(times[a : a + 100_000])], ["token", "n"])

    def run(batches):
        held, total = [], 0
        for batch in pieces(batches, 1):
            for _, tokens, _ in sets_of(batch.column(1), words):
                held.append(tokens)
                total += len(tokens)
                if total >= CHUNK:
                    yield from often(held)
                    held, total = [], 0
        if held:
            yield from often(held)

    least = max(LOCAL, int(np.ceil(SHARE * tokens)))
    got = docs.select("did", "text").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    token, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


class Levels:
    """How far back each token stands: 0 for all but the frequent, whose level grows with the logarithm of their number."""

    def __init__(self, tokens: np.ndarray, n: np.ndarray):
        self.tokens = tokens
        self.level = (1 + np.log2(np.maximum(n, 1) / max(1, n.min() if len(n) else 1)) * 4).astype(np.int16)
        self.may = np.zeros(1 << 22, bool)  # most tokens are left out by this table alone
        self.may[self.at(tokens)] = True

    def at(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens & np.uint64(len(self.may) - 1)).astype(np.int64)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int16)
        some = np.flatnonzero(self.may[self.at(tokens)])
        if len(some):
            place = np.minimum(np.searchsorted(self.tokens, tokens[some]), len(self.tokens) - 1)
            out[some] = np.where(self.tokens[place] == tokens[some], self.level[place], 0)
        return out


def first_tokens(docs: DataFrame, words: int, percent: int, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, did, place (n << 32 | i): the first tokens of each set in the common order."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(often)  # at most 1 / SHARE tokens

    def run(batches):
        levels = Levels(*shared.value)
        for batch in pieces(batches, 1):
            for at, tokens, bounds in sets_of(batch.column(1), words):
                n = np.diff(bounds)
                level = levels.of(tokens)
                row = np.repeat(np.arange(len(n), dtype=np.uint16), n)
                if level.any():  # by row, then level, then hash, which is the order they are in
                    order = np.argsort(level, kind="stable")
                    tokens = tokens[order[np.argsort(row[order], kind="stable")]]
                place = np.arange(len(tokens)) - bounds[:-1][row]
                take = np.flatnonzero(place < ((100 - percent) * n // 100 + 1)[row])
                did = batch.column(0).to_numpy()[at : at + len(n)][row[take]]
                key, place = tokens[take].view(np.int64), n[row[take]] << 32 | place[take]
                for a in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in (key, did, place)], ["key", "did", "place"])

    return docs.select("did", "text").mapInArrow(lean(run), "key long, did long, place long")


def close(n_u, n_v, percent: int):
    """Whether sizes let two sets link."""
    return 100 * F.least(n_u, n_v) >= percent * F.greatest(n_u, n_v)


def bounded(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v, n_u) that sizes and bit counts let link. Bitmaps of u go only where sizes agree."""
    side = lambda c: profile.select(F.col("did").alias(c), F.col("n").alias(f"m_{c}"), F.col("bits").alias(f"b_{c}"))
    fold = lambda b, n: F.when(F.size(b) > n, F.zip_with(F.slice(b, F.lit(1), n), F.slice(b, n + 1, n), lambda x, y: x.bitwiseOR(y))).otherwise(b)
    lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    j = pairs.join(side("v"), "v").filter(close(F.col("n_u"), F.col("m_v"), percent)).join(side("u"), "u")
    words = F.least(F.size("b_u"), F.size("b_v"))  # sizes this close differ by a factor of two at most
    j = j.withColumns({"b_u": fold(F.col("b_u"), words), "b_v": fold(F.col("b_v"), words)})
    most = F.least(F.col("m_u") - lacks("b_u", "b_v"), F.col("m_v") - lacks("b_v", "b_u"))
    return j.filter(100 * most >= percent * (F.col("m_u") + F.col("m_v") - most)).select("u", "v")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def groups(batches, key_column: int, rows_of):
    """Rows of one key after another, from batches sorted by key. rows_of(batch) gives a list of rows."""
    key, held = None, []
    for batch in batches:
        for k, row in zip(batch.column(key_column).to_pylist(), rows_of(batch), strict=True):
            if k != key and held:
                yield held
                held = []
            key = k
            held.append(row)
    if held:
        yield held


class Bitmaps:
    """Bitmaps of several lengths, each in a matrix with those of its length, as they are and folded once."""

    def __init__(self, rows: list[np.ndarray]):
        self.words = np.array([len(r) for r in rows])
        self.at = np.zeros(len(rows), np.int64)
        self.whole, self.half = {}, {}
        for w in set(self.words.tolist()):
            own = np.flatnonzero(self.words == w)
            self.at[own] = np.arange(len(own))
            self.whole[w] = np.stack([rows[i] for i in own]).view(np.uint64)
            self.half[w] = self.whole[w][:, : w // 2] | self.whole[w][:, w // 2 :]

    def lacking(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of i that each of others lacks, and bits of each that i lacks. Sizes are within a factor of two."""
        out = np.zeros((2, len(others)), np.int64)
        w = self.words[i]
        for v in set(self.words[others].tolist()):
            k = np.flatnonzero(self.words[others] == v)
            x = self.half[w][self.at[i]] if v < w else self.whole[w][self.at[i]]
            y = (self.half if v > w else self.whole)[v][self.at[others[k]]]
            out[0, k] = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
            out[1, k] = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
        return out[0], out[1]


def may_link(n: np.ndarray, bits: Bitmaps, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of others may link with i, by sizes and bit counts."""
    small, large = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
    others = others[100 * small >= percent * large]
    mine, theirs = bits.lacking(i, others)
    most = np.minimum(n[i] - mine, n[others] - theirs)
    return others[100 * most >= percent * (n[i] + n[others] - most)]


def tile_edges(rows: DataFrame, percent: int) -> DataFrame:
    """u, v: spanning edges of what may link in each tile. rows: tile, did, comp, asks, n, bits; those that ask are compared
    with the others only."""
    import pyarrow as pa

    def unpack(batch):
        flat, off = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
        bits = [flat[x:y] for x, y in zip(off, off[1:], strict=False)]
        return list(zip(*(batch.column(i).to_pylist() for i in range(1, 5)), bits, strict=True))

    def run(batches):
        for held in groups(batches, 0, unpack):
            did, comp, asks, n = (np.array([r[k] for r in held]) for k in range(4))
            bits = Bitmaps([r[4] for r in held])
            at = {c: i for i, c in reversed(list(enumerate(comp.tolist())))}
            forest, u, v = Forest(len(held)), [], []
            for i, c in enumerate(comp.tolist()):
                forest.join(i, at[c])
            for i in range(len(held)):
                others = np.flatnonzero((comp[i + 1 :] != comp[i]) & ~(asks[i + 1 :] & asks[i])) + i + 1
                for j in may_link(n, bits, i, others, percent).tolist() if len(others) else ():
                    if forest.join(i, j):
                        u.append(did[i])
                        v.append(did[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("tile", "did", "comp", "asks", "n", "bits").repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(lean(run), "u long, v long")


def exact_links(rows: DataFrame, percent: int) -> DataFrame:
    """did, root, sig, links from rows of tile, block, did, sig, tokens: the edges and numbers of links of each tile.

    In a tile of two blocks, only pairs of one and the other count; block is 0 in tiles of one."""
    import pyarrow as pa

    def unpack(batch):
        flat, off = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
        return [(d, s, b, flat[x:y].view(np.uint64)) for b, d, s, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), off, off[1:], strict=False)]

    def solve(held):
        """Rows of (did, sig, block, tokens)."""
        did = [r[0] for r in held]
        place: dict[int, int] = {}
        forest = Forest(len(held))
        seen: dict[int, int] = {}
        for i, r in enumerate(held):
            forest.join(i, place.setdefault(r[0], i))
            forest.join(i, seen.setdefault(r[1], i))
        only = sorted(seen.values())
        sizes = np.array([len(held[i][3]) for i in only])
        order = np.argsort(sizes, kind="stable")
        only, sizes = [only[i] for i in order], sizes[order]
        block = np.array([held[i][2] for i in only])
        flat = np.concatenate([held[i][3] for i in only])
        words, at = bitmaps(flat, np.concatenate(([0], np.cumsum(sizes))))
        bits = Bitmaps([words[x:y] for x, y in zip(at, at[1:], strict=False)])
        names, flat = np.unique(flat, return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        two = bool(block.any())
        links = np.zeros(len(only), np.int64)
        mark = np.zeros(len(names), bool)
        for i in range(len(only)):
            later = np.arange(i + 1, len(only))
            later = may_link(sizes, bits, i, later[block[later] != block[i]] if two else later, percent)
            if not len(later):
                continue
            mine = flat[begin[i] : begin[i + 1]]
            mark[mine] = True
            count = sizes[later]
            at = np.repeat(begin[later] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            shared = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(count) - count)
            mark[mine] = False
            good = later[100 * shared >= percent * (sizes[i] + count - shared)]
            links[i] += len(good)
            links[good] += 1
            for j in good.tolist():
                forest.join(only[i], only[j])
        least: dict[int, int] = {}
        for i in range(len(held)):
            r = forest.root(i)
            least[r] = min(least.get(r, NO_ID), did[i])
        count = dict(zip(only, links.tolist(), strict=True))
        return [(did[i], least[forest.root(i)], held[i][1], count.get(i, 0)) for i in range(len(held))]

    def run(batches):
        for held in groups(batches, 0, unpack):
            cols = zip(*solve(held), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["did", "root", "sig", "links"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("tile", "block", "did", "sig", "tokens").repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(lean(run), "did long, root long, sig long, links long")


def band_of(n, percent: int):
    """Sets that link are in the same band or in neighbouring ones; bands are a little wider than the factor."""
    return F.floor(F.log(n) / F.lit(float(np.log(100 / percent)) * 1.000001)).cast("int")


def blocks_of(m: DataFrame, profile: DataFrame) -> DataFrame:
    """Rows of large tiles (tile, did, comp, others) in blocks of about TILE rows, each of which meets itself and every other."""
    nb = F.ceil(F.col("others") / TILE).cast("int")
    b = F.pmod(F.hash("did"), nb)
    meets = F.transform(F.sequence(F.lit(0), nb - 1), lambda x: F.struct(F.least(x, b).alias("i"), F.greatest(x, b).alias("j")))
    rows = m.select("tile", "did", "comp", F.explode(meets).alias("t")).withColumn("tile", F.xxhash64("tile", "t.i", "t.j")).drop("t")
    return rows.join(profile, "did").withColumn("asks", F.lit(False))


def meetings(asked: DataFrame, comps: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Rows of tiles in which texts that ask (did, comp, main, n) meet the members of the component main, in blocks by size."""
    band = lambda df: df.withColumn("band", band_of(F.col("n"), percent))
    wanted = asked.select(F.col("main").alias("root")).distinct()
    nodes = comps.join(wanted, "root").select(F.col("node").alias("did"), F.col("root").alias("main"))
    nodes = nodes.unionByName(wanted.select(F.col("root").alias("did"), F.col("root").alias("main"))).distinct()  # a component of one has no row
    members = band(nodes.join(profile, "did"))
    askers = band(asked).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    count = lambda df, name: df.groupBy("main", "band").agg(F.ceil(F.count("*") / GRID).cast("int").alias(name))
    grid = written(count(members, "rows").join(count(askers, "cols"), ["main", "band"]), "join-grid")
    block = lambda n: F.pmod(F.hash("did"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = members.join(grid, ["main", "band"]).withColumn("i", block("rows")).withColumn("j", every("cols"))
    a = askers.join(grid, ["main", "band"]).withColumn("j", block("cols")).withColumn("i", every("rows")).drop("n").join(profile, "did")
    side = lambda df, comp, asks: df.select(F.xxhash64("main", "band", "i", "j").alias("tile"), "did", F.col(comp).alias("comp"), F.lit(asks).alias("asks"), "n", "bits")
    return side(m, "main", False).unionByName(side(a, "comp", True))


def candidates(docs: DataFrame, profile: DataFrame, words: int, percent: int) -> DataFrame:
    """node, root: groups of doc_ids that hold all links between different sets."""
    tokens = profile.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys = first_tokens(docs, words, percent, frequent(docs, words, tokens))
    shared = written(keys.groupBy("key").agg(F.min("did").alias("low"), F.max("did").alias("high")).filter("low <> high"), "join-keys")
    held = written(keys.join(shared, "key"), "join-held")
    one = profile.filter("n > 0").groupBy("did").agg(F.count_distinct("sig").alias("sets"), F.max_by(F.struct("n", "bits"), "n").alias("p"))
    # a doc_id with several texts has no one bitmap: it may link with whatever shares its keys
    single = written(one.filter("sets = 1").select("did", "p.n", "p.bits"), "join-profiles")
    several = one.filter("sets > 1").select("did")
    size = F.shiftright("place", 32)
    stars = held.select(F.col("did").alias("u"), size.alias("n_u"), F.explode(F.array("low", "high")).alias("v")).filter("u <> v").distinct()
    edges = bounded(stars, single, percent)
    manifold = written(several, "join-several")
    if not manifold.isEmpty():
        s = lambda c: manifold.select(F.col("did").alias(c))
        pairs = held.join(manifold, "did").select("key", F.col("did").alias("u")).join(held.select("key", F.col("did").alias("v")), "key").select("u", "v").filter("u <> v")
        edges = edges.unionByName(stars.join(s("u"), "u", "left_semi").select("u", "v")).unionByName(pairs.distinct())
    edges = written(edges, "join-edges")
    first = components(edges)
    rows = held.join(first.withColumnRenamed("node", "did"), "did", "left").select("key", "did", "place", F.coalesce("root", "did").alias("comp"), band_of(size, percent).alias("band"))
    rows = written(rows, "join-rows")
    ends = lambda c: [F.min(c).alias("a"), F.max(c).alias("b")]
    # a tile is a band of a key (role 0) and its next band (role 1); those of one component or without role 0 are left out
    by_band = rows.groupBy("key", "band").agg(F.count("*").alias("n"), *ends("comp"))
    roles = F.explode(F.array(F.struct(F.col("band").alias("low"), F.lit(0).alias("role")), F.struct((F.col("band") - 1).alias("low"), F.lit(1).alias("role"))))
    tiles = by_band.withColumn("t", roles).groupBy("key", "t.low").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("t.role") == 0, F.col("n")).otherwise(0)).alias("own"), F.min("a").alias("a"), F.max("b").alias("b")
    )
    tiles = written(tiles.filter("a <> b AND own > 0").select("key", "low", "all"), "join-tiles")
    in_tiles = rows.withColumn("t", roles).select("key", "did", "place", "comp", "t.low", "t.role").join(tiles, ["key", "low"])
    in_tiles = written(in_tiles.withColumn("tile", F.xxhash64("key", "low")).drop("key", "low"), "join-in-tiles")
    few = in_tiles.filter(F.col("all") <= PAIRS)
    side = lambda c: few.select("tile", *(F.col(x).alias(f"{x}_{c}") for x in ("did", "comp", "role", "place")))
    n = lambda c: F.shiftright(f"place_{c}", 32)
    after = lambda c: n(c) - F.col(f"place_{c}").bitwiseAND(0xFFFFFFFF)
    pairs = side("u").join(side("v"), "tile").filter("did_u < did_v AND comp_u <> comp_v AND role_u + role_v < 2").filter(close(n("u"), n("v"), percent))
    pairs = pairs.filter((100 + percent) * F.least(after("u"), after("v")) >= percent * (n("u") + n("v")))
    more = bounded(pairs.select(F.col("did_u").alias("u"), F.col("did_v").alias("v"), n("u").alias("n_u")).distinct(), single, percent)
    many = in_tiles.filter(F.col("all") > PAIRS)
    if not many.isEmpty():
        own = many.groupBy("tile", "comp").agg(F.count("*").alias("n")).groupBy("tile").agg(F.max_by("comp", "n").alias("main"), (F.sum("n") - F.max("n")).alias("others"))
        # the largest component of a tile stays out of it: the others meet each other there, and its members once for all keys
        m = written(many.join(own, "tile").filter("comp <> main").select("tile", "did", "comp", "main", "others", size.alias("n")), "join-many")
        more = more.unionByName(tile_edges(blocks_of(m, single), percent))
        more = more.unionByName(tile_edges(meetings(m.select("did", "comp", "main", "n").distinct(), first, single, percent), percent))
    more = written(more, "join-more")
    found = components(edges.unionByName(more))
    discard(shared, held, single, manifold, edges, rows, tiles, in_tiles)
    return found


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each row of docs."""
    import pyarrow as pa

    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), text_of(text_col).alias("text"))
    profile = written(profiles(base, words), "join-sets")
    alike = written(profile.filter("n > 0").groupBy("sig", "n").agg(F.min("did").alias("rep"), F.max("did").alias("last")), "join-classes")
    groups_ = written(candidates(base, profile, words, percent), "join-candidates")
    among = groups_.join(alike.select(F.col("rep").alias("node")).distinct(), "node")
    size = written(among.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1"), "join-sizes")
    cand = written(among.join(size, "root").select(F.col("node").alias("did"), F.col("root").alias("comp"), "size"), "join-candidates")

    def spell(batches):
        for batch in pieces(batches, 3):
            for at, tokens, bounds in sets_of(batch.column(3), words):
                own = [batch.column(i).slice(at, len(bounds) - 1) for i in range(3)]
                own += [pa.array(signatures(tokens, bounds)), pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(own, ["did", "comp", "size", "sig", "n", "tokens"])

    sets = base.join(cand, "did").select("did", "comp", "size", "text").mapInArrow(lean(spell), "did long, comp long, size long, sig long, n int, tokens array<long>").filter("n > 0")
    sets = written(sets.withColumn("band", band_of(F.col("n"), percent)), "join-tokens")
    small = sets.filter(F.col("size") <= SMALL).select(F.col("comp").alias("tile"), F.lit(0).alias("block"), "did", "sig", "tokens")
    found = exact_links(small, percent)
    large = sets.filter(F.col("size") > SMALL)
    if not large.isEmpty():
        blocks = large.groupBy("comp", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
        blocks = written(blocks, "join-blocks")
        near = blocks.select(F.col("comp").alias("c"), F.col("band").alias("band2"), F.col("nb").alias("nb2"))
        # every block of a component meets itself, the later blocks of its band and all blocks of the next band
        l = large.join(blocks, ["comp", "band"]).withColumn("b", F.pmod(F.hash("sig"), F.col("nb")))
        tile = lambda b1, i, b2, j: F.xxhash64("comp", b1, i, b2, j)
        same = l.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
            tile(F.col("band"), F.least("b", "x"), F.col("band"), F.greatest("b", "x")).alias("tile"), F.when(F.col("b") == F.col("x"), 0).otherwise(F.col("b") + 1).alias("block"), "did", "sig", "tokens"
        )
        up = l.join(near, (F.col("comp") == F.col("c")) & (F.col("band2") == F.col("band") + 1)).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb2") - 1))).select(
            tile(F.col("band"), F.col("b"), F.col("band2"), F.col("x")).alias("tile"), F.lit(-1).alias("block"), "did", "sig", "tokens"
        )
        down = l.join(near, (F.col("comp") == F.col("c")) & (F.col("band2") == F.col("band") - 1)).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb2") - 1))).select(
            tile(F.col("band2"), F.col("x"), F.col("band"), F.col("b")).alias("tile"), F.lit(-2).alias("block"), "did", "sig", "tokens"
        )
        found = found.unionByName(exact_links(same.unionByName(up).unionByName(down), percent))
    found = written(found, "join-found")
    discard(sets, cand, size, groups_)
    copies = profile.filter("n > 0").join(alike.filter("rep <> last"), ["sig", "n"]).select(F.col("did").alias("u"), F.col("rep").alias("v")).filter("u <> v")
    comps = components(found.select(F.col("did").alias("u"), F.col("root").alias("v")).filter("u <> v").unionByName(copies))
    links = found.groupBy("did", "sig").agg(F.sum("links").alias("links"))
    per_set = links.groupBy("sig").agg(F.max("links").alias("links"))
    out = profile.select("did", "n", "sig").join(comps.withColumnRenamed("node", "did"), "did", "left").join(per_set, "sig", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(
        real(F.col("did")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real(F.coalesce("root", "did")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents", "doc_id", "text"))
