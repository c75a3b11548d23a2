"""Operator 4: suffix-array dedup. Removes each byte that a `length`-byte string covers which also starts earlier.

Texts are UTF-8 bytes. "Earlier" means a smaller doc_id, or the same document and an earlier start.

A suffix array of the whole corpus fits no task, so strings that can be equal are brought together first. Of the
k-byte grams in each window of `length` bytes the one with the least hash is the window's anchor (the last of equal
ones). Equal windows have equal anchors at equal offsets, and each window belongs to one occurrence of one anchor, an
occurrence being a run of windows that share it (about one for every 39 bytes).

1. Anchors that occur once are dropped: their windows are unique. (counts, then a join of two shuffled sides)
2. Occurrences with equal bytes around the anchor form a class. All but the first of a class are removed whole, and the
   first stands for the class: exact copies, however many, cost one row each and never meet in one task.
3. Where an anchor has two classes or more, the bytes of the classes' first occurrences are laid end to end in document
   order and sorted as suffixes. In suffix order the previous and the next smaller position give each position its
   longest previous factor; where that is `length` or more, the window is a later copy.
4. What is sorted in one task is bounded by `group` classes. An anchor with more (a very common line between ever new
   neighbours, perhaps a third of all rows) is split by a longer one: its runs are cut into parts of PART windows at
   fixed offsets from the anchor, and all the bytes that the windows of a part have in common (93 of 100) are the new
   anchor. Most parts then have an anchor of their own, or one class, and are done; the others go through steps 1 to 3
   again. What is still over the bound is cut into single windows, where the whole window is the anchor and the first
   occurrence is a minimum by partial sums. Rows follow the number of occurrences, and every way gives the same bytes.

Each text is shuffled twice, for the bytes around occurrences and when the marks come back, but never both at once: every
step ends in a table, and what is behind it leaves the disk before the next begins. Hashes of classes and windows are 64
bits beside the 64 of their anchor.

Defined cases: null is empty; texts under `length` bytes lose nothing. Rows that share doc_id and text are one document:
they remove nothing from each other and get equal results. Rows that share a doc_id but not the text are ordered by
start, then by a hash of the text. A null doc_id is smaller than all others (-2**63 stands for it, and comes back as
null). Other columns are not carried.
"""

import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import Prefix, discard, lean, mix, pieces, read, text_buffer, text_of, written

#: Most classes (of under 200 bytes each) that meet in one suffix array, and windows of a part of an occurrence.
LENGTH, GRAM, GROUP, PART = 100, 24, 4_000, 8
CHUNK, BATCH_BYTES, LOW = 500_000, 1_000_000, (1 << 20) - 1
NO_ID = -(2**63)
#: What is known of a run of windows: it goes; it goes but for first windows; it is a first window.
GONE, CROWDED, FIRST = 0, 1, 2


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Yields arrays (row, start of the first window in its row, windows, bytes from there to the anchor, anchor's hash,
    hash of all their bytes)."""
    left = np.repeat(offsets[1:], np.diff(offsets)) if len(raw) else np.zeros(0, np.int64)
    for c in range(0, max(0, len(raw) - length + 1), CHUNK):
        data = raw[c : c + CHUNK + length - 1]
        n = len(data) - length + 1
        at = np.flatnonzero(left[c : c + n] - np.arange(c, c + n) >= length)
        if not len(at):
            continue
        sums = Prefix(data)
        q = np.arange(len(data) - gram + 1)
        hashes = mix(sums.of(q, q + gram))
        least = (hashes & np.uint64(~LOW & (2**64 - 1))) | (np.uint64(LOW) - q.astype(np.uint64))
        have, want = 1, length - gram + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        q = LOW - (least[at] & np.uint64(LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        windows = np.diff(np.concatenate((first, [len(q)])))
        a, q = at[first], q[first]
        shape = mix(((q - a) * 4096 + windows).astype(np.uint64))
        around = mix(sums.of(a, a + windows - 1 + length) ^ shape)
        row = np.searchsorted(offsets, a + c, "right") - 1
        yield row, a + c - offsets[row], windows, q - a, hashes[q].view(np.int64), around.view(np.int64)


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, around, did, loc (start << 32 | hash of the text), shape (bytes before the anchor << 8 | windows).
    docs: did, th, text."""
    import pyarrow as pa

    names = ["anchor", "around", "did", "loc", "shape"]

    def run(batches):
        for batch in pieces(batches, 2):
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64) & 0xFFFFFFFF
            raw, offsets = text_buffer(batch.column(2))
            for row, start, windows, lead, anchor, around in anchor_runs(raw, offsets, length, gram):
                cols = (anchor, around, did[row], start << 32 | th[row], (lead << 8 | windows).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names)

    return docs.select("did", "th", "text").mapInArrow(lean(run), "anchor long, around long, did long, loc long, shape int")


def step(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """written(), after which the tables that nothing else will read are deleted, and the files of its shuffles too. Spark
    deletes those when the driver's JVM collects their plan, which may be after the whole query."""
    table = written(df, name)
    discard(*done)
    df.sparkSession._jvm.System.gc()
    return table


# ---- longest previous factors ----


def ranks(data: np.ndarray) -> dict[int, np.ndarray]:
    """By h = 8, 16, 32, 64 the rank of each suffix among all, by its first h bytes (zeros after the end)."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(64, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word |= padded[i : n + i] << np.uint64(56 - 8 * i)
    levels = {8: np.unique(word, return_inverse=True)[1].astype(np.int64) + 1}
    for h in (8, 16, 32):
        r = levels[h]
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = r[h:]
        levels[2 * h] = np.unique(r << 32 | after, return_inverse=True)[1].astype(np.int64) + 1
    return levels


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index the nearest index before and after it with a smaller value, or -1. Pointers jump over pointers."""
    out = []
    for v in (values, values[::-1]):
        to = np.arange(len(v)) - 1
        open_ = np.flatnonzero(to >= 0)
        while len(open_):
            open_ = open_[v[to[open_]] > v[open_]]
            to[open_] = to[to[open_]]
            open_ = open_[to[open_] >= 0]
        out.append(to)
    after = out[1][::-1]
    return out[0], np.where(after >= 0, len(values) - 1 - after, -1)


def longest_previous(data: np.ndarray, starts: np.ndarray, cap: int) -> np.ndarray:
    """For each of the ascending starts the longest prefix, up to cap (64 to 128), that also starts at an earlier one."""
    levels = ranks(data)
    full = np.concatenate((levels[64], np.zeros(cap, np.int64)))
    order = np.lexsort((starts, full[starts + cap - 64], full[starts]))
    suffix = starts[order]
    longest = np.zeros(len(starts), np.int64)
    padded = np.concatenate((data, np.zeros(cap + 8, np.uint8)))
    for near in nearest_smaller(suffix):
        i = np.flatnonzero(near >= 0)
        a, b = suffix[i], suffix[near[i]]
        common = np.zeros(len(i), np.int64)
        for h in (64, 32, 16, 8):
            r = np.concatenate((levels[h], np.zeros(cap + 64, np.int64)))
            same = (common + h <= cap) & (r[a + common] == r[b + common])
            common[same] += h
        for _ in range(8):
            same = (common < cap) & (padded[a + common] == padded[b + common])
            common[same] += 1
        longest[i] = np.maximum(longest[i], common)
    out = np.zeros(len(starts), np.int64)
    out[order] = longest
    return out


def later_copies(contexts: DataFrame, length: int) -> DataFrame:
    """did, loc, windows of runs that start earlier elsewhere. contexts: anchor, did, loc, shape, bytes."""
    import pyarrow as pa

    names = ["did", "loc", "windows"]

    def solve(parts):
        did, loc, windows, size = (np.concatenate([p[i] for p in parts]) for i in range(4))
        begin = np.cumsum(size) - size
        data, windows = np.concatenate([p[4] for p in parts]), windows & 255
        order = np.lexsort((loc, did))  # by doc_id, start, hash of the text
        order = order[np.concatenate(([True], (did[order[1:]] != did[order[:-1]]) | (loc[order[1:]] != loc[order[:-1]])))]  # repeated rows are one
        take = np.repeat(begin[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(size[order].sum())
        data, did, loc, windows, size = data[take], did[order], loc[order], windows[order], size[order]
        begin = np.cumsum(size) - size
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = np.repeat(begin, windows) + inner
        hit = np.flatnonzero(longest_previous(data, starts, length) >= length)
        if not len(hit):
            return None
        row = np.repeat(np.arange(len(did)), windows)[hit]
        new = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1]))))
        count = np.diff(np.concatenate((new, [len(hit)])))
        r = row[new]
        return pa.RecordBatch.from_arrays([pa.array(did[r]), pa.array(loc[r] + (inner[hit[new]] << 32)), pa.array(count.astype(np.int32))], names)

    def run(batches):
        held, total, last = [], 0, None
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            raw, offsets = _bytes(batch.column(4))
            at = 0
            while at < len(batch):
                if total >= BATCH_BYTES and anchor[at] != last:
                    if (found := solve(held)) is not None:
                        yield found
                    held, total = [], 0
                end = int(np.searchsorted(offsets, offsets[at] + max(1, BATCH_BYTES - total), "right")) - 1
                end = min(max(end, at + 1), len(batch))
                while end < len(batch) and anchor[end] == anchor[end - 1]:  # groups stay together
                    end += 1
                held.append((*(batch.column(i).to_numpy()[at:end] for i in (1, 2, 3)), np.diff(offsets[at : end + 1]), raw[offsets[at] : offsets[end]]))
                total, last, at = total + int(offsets[end] - offsets[at]), anchor[end - 1], end
        if held and (found := solve(held)) is not None:
            yield found

    return contexts.sortWithinPartitions("anchor").mapInArrow(lean(run), "did long, loc long, windows int")


def parts_of(batches, length: int, part: int, whole: bool):
    """Occurrences (anchor, did, loc, shape, bytes) cut into parts of `part` windows, at fixed offsets from the anchor: anchor,
    around, did, loc, shape and, if whole, bytes. Equal windows get into parts with equal anchors."""
    import pyarrow as pa

    for batch in batches:
        raw, offsets = _bytes(batch.column(4))
        if not len(raw):
            continue
        shape = batch.column(3).to_numpy().astype(np.int64)
        windows, lead = shape & 255, shape >> 8
        low, high = lead - windows + 1, lead  # offsets of the anchor in the last and the first window, maybe below 0 in a part
        first = low // part
        n = high // part - first + 1
        row = np.repeat(np.arange(len(batch)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        lo, hi = np.maximum(low[row], k * part), np.minimum(high[row], k * part + part - 1)
        anchor_at = offsets[:-1][row] + lead[row]
        sums = Prefix(raw)
        core, end = anchor_at - k * part, anchor_at - k * part - part + 1 + length  # what all windows of the part hold
        salt = mix(batch.column(0).to_numpy()[row].view(np.uint64) + k.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        anchor = mix(sums.of(core, end) ^ salt)
        begin, stop = anchor_at - hi, anchor_at - lo + length
        around = mix(sums.of(begin, stop) ^ mix((lo - k * part).astype(np.uint64) * np.uint64(256) + (hi - k * part).astype(np.uint64)))
        loc = batch.column(2).to_numpy()[row] + ((begin - offsets[:-1][row]) << 32)
        cols = [anchor.view(np.int64), around.view(np.int64), batch.column(1).to_numpy()[row], loc, ((hi - k * part) << 8 | hi - lo + 1).astype(np.int32)]
        names = ["anchor", "around", "did", "loc", "shape"]
        for a in range(0, len(row), 10_000):
            out = [pa.array(c[a : a + 10_000]) for c in cols]
            if whole:
                out.append(pa.array([raw[x:y].tobytes() for x, y in zip(begin[a : a + 10_000], stop[a : a + 10_000], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names + ["bytes"] * whole)


def classed(held: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of occurrences, two tables: did, loc, windows of those that are not the first of their class; and anchor, did, loc,
    shape of the firsts where an anchor has several classes, with their number."""
    classes = step(held.groupBy("anchor", "around").agg(F.min(F.struct("did", "loc")).alias("first"), F.max("shape").alias("shape"), F.count("*").alias("n")), f"{name}-classes")
    again = classes.filter("n > 1").select("anchor", "around", "first")
    copies = held.join(again, ["anchor", "around"]).filter((F.col("did") != F.col("first.did")) | (F.col("loc") != F.col("first.loc")))
    copies = step(copies.select("did", "loc", F.col("shape").bitwiseAND(255).alias("windows")), f"{name}-copies")
    many = step(classes.groupBy("anchor").agg(F.count("*").alias("classes")).filter("classes > 1"), f"{name}-groups")
    firsts = step(classes.join(many, "anchor").select("anchor", "first.did", "first.loc", "shape", "classes"), f"{name}-firsts", classes, many)
    return copies, firsts


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept binary: one row for each row of docs."""
    import pyarrow as pa

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.hash(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    found = occurrences(base, length, gram)
    repeated = step(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "suffix-anchors")
    held = step(found.join(repeated, "anchor"), "suffix-occurrences", repeated)
    copies, firsts = classed(held, "suffix")
    discard(held)
    th = F.expr("cast((loc & 4294967295) - if((loc & 2147483648) != 0, 4294967296, 0) as int)")  # the low 32 bits
    texts = base.repartition(n, "did", "th")

    def cut(batches):
        """The bytes around each asked occurrence."""
        for batch in pieces(batches, 2):
            did, rows, text = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for d, asks, t in zip(did.tolist(), rows, text, strict=True):
                b = t.encode()
                out += [(x["anchor"], d, x["loc"], x["shape"], x["classes"], b[(s := x["loc"] >> 32) : s + (x["shape"] & 255) - 1 + length]) for x in asks]
            for a in range(0, len(out), 5_000):
                cols = zip(*out[a : a + 5_000], strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "did", "loc", "shape", "classes", "bytes"])

    asked = firsts.withColumn("th", th).groupBy("did", "th").agg(F.collect_set(F.struct("anchor", "loc", "shape", "classes")).alias("asked"))
    contexts = asked.join(texts, ["did", "th"]).select("did", "asked", "text").mapInArrow(lean(cut), "anchor long, did long, loc long, shape int, classes long, bytes binary")
    contexts = step(contexts, "suffix-contexts", firsts)
    kind = lambda rows, k: rows.select("did", "loc", "windows", F.lit(k).alias("kind"))
    few = contexts.filter(F.col("classes") <= group).drop("classes")
    marks, done = kind(copies, GONE), [contexts]
    crowd = contexts.filter(F.col("classes") > group)
    if not crowd.isEmpty():
        cut_up = lambda rows, part, whole: rows.select("anchor", "did", "loc", "shape", "bytes").mapInArrow(
            lean(lambda batches: parts_of(batches, length, part, whole)), "anchor long, around long, did long, loc long, shape int" + ", bytes binary" * whole
        )
        parts = step(cut_up(crowd, PART, True), "suffix-parts")
        copies, firsts = classed(parts.drop("bytes"), "suffix-part")
        firsts = step(parts.select("anchor", "did", "loc", "bytes").join(firsts, ["anchor", "did", "loc"]), "suffix-part-contexts", parts, firsts)
        few = few.unionByName(firsts.filter(F.col("classes") <= group).drop("classes"))
        # of parts that are still crowded all windows go but the first of each; those are few, and no row is joined to its first
        rest = firsts.filter(F.col("classes") > group)
        first = cut_up(rest, 1, False).groupBy("anchor", "around").agg(F.min(F.struct("did", "loc")).alias("first")).select("first.did", "first.loc", F.lit(1).alias("windows"))
        rest = kind(rest.withColumn("windows", F.col("shape").bitwiseAND(255)), CROWDED).unionByName(kind(first, FIRST))
        marks, done = marks.unionByName(kind(copies, GONE)).unionByName(step(rest, "suffix-rest")), [*done, firsts]
    marks = marks.unionByName(kind(step(later_copies(few.repartition(n, "anchor"), length), "suffix-later", *done), GONE))
    by_doc = (
        marks.withColumn("th", th)
        .groupBy("did", "th").agg(F.collect_set(F.struct(F.shiftright("loc", 32).alias("start"), "windows", "kind")).alias("marks"))
    )

    def remove(batches):
        for batch in pieces(batches, 1):
            out = []
            ids, texts_, marks_ = ([None if d == NO_ID else d for d in batch.column(0).to_pylist()], *(batch.column(i).to_pylist() for i in (1, 2)))
            for d, t, m in zip(ids, texts_, marks_, strict=True):
                b = (t or "").encode()
                if not m:
                    out.append((d, len(b), 0, 0, hashlib.sha256(b).hexdigest(), b))
                    continue
                runs: list[list[int]] = []
                for s, e in sorted((s, e - 1 + length) for s, e in window_runs(m)):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                edges = [0, *(x for r in runs for x in r), len(b)]
                kept = b"".join(b[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((d, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    final = texts.join(by_doc, ["did", "th"], "left").select("did", "text", "marks")
    return final.mapInArrow(lean(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def window_runs(marks: list[dict]):
    """(start, end) of runs of windows that go."""
    first = sorted(x["start"] for x in marks if x["kind"] == FIRST)
    for x in marks:
        s, end = x["start"], x["start"] + x["windows"]
        if x["kind"] == GONE:
            yield s, end
        elif x["kind"] == CROWDED:
            for f in first[bisect_left(first, s) : bisect_left(first, end)]:
                if f > s:
                    yield s, f
                s = f + 1
            if end > s:
                yield s, end


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow binary column end to end, and the offsets of its rows."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
