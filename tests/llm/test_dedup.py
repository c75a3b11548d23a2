"""Line dedup, exact dedup, suffix-array dedup and the n-gram join against brute force, with nulls, ties and repeats."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from maskwright.llm.common import new_path, shared_dir
from maskwright.llm.components import components

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def frame(spark, rows):
    """With an extra column whose name clashes with what the operators compute."""
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string").repartition(3)


def brute_lines(rows):
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(SPACES).translate(LOWER)
            if len(k) >= 40:
                held.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not ((s := held.get(x.strip(SPACES).translate(LOWER))) and len(s) >= 5 and d != max(s, key=lambda i: (i is not None, i or 0)))]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(1)
    common = ["Common line number %d that is certainly long enough Ä" % i for i in range(6)]
    rows = []
    for i in range(60):
        lines = [rng.choice([*common, "short", "", "\t" + common[0].upper() + " \r", common[1].replace("Ä", "ä"), f"own line {i} " + "y" * 40]) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n"), (None, common[0]), (5, rows[5][1]), (6, common[2] + "\n" + common[2]), (73, "long " * 50_000)]
    got = line_dedup.line_dedup(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_exact_dedup(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "ä"), (4, "Ä"), (5, None), (6, ""), (7, "ab"), (7, "ab"), (None, "ab"), (None, "alone"), (8, "x" * 300_000)]
    docs = frame(spark, rows)
    index = exact_dedup.DigestIndex(spark, new_path(spark, "t6"), 4)
    index.add(docs)
    got = sorted(map(tuple, exact_dedup.decisions(docs, index).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    want = [(1, 7, 5, False), (2, 7, 5, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 5, True), (7, 7, 5, False), (None, 7, 5, False), (None, None, 1, True), (8, 8, 1, True)]
    assert got == sorted(want, key=str)
    kept = exact_dedup.keep(docs, index)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([7, 3, 4, 6, None, 8], key=str)
    index.add(frame(spark, [(9, "AB"), (10, "new")]))
    assert index.rows().count() == 7 and exact_dedup.keep(frame(spark, [(9, "AB"), (10, "new")]), index).select("doc_id").collect() == [(10,)]
    assert exact_dedup.keep(docs.limit(0), index).count() == 0


def brute_suffix(rows, length=100):
    out, seen = [], {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], (d, i)) != (d, i):
                gone[i : i + length] = True
        edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        out.append((d, len(b), int(gone.sum()), int((edge == 1).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [4000, 12, 2])
def test_suffix_dedup(spark, group):
    rng = random.Random(group)
    base = ["".join(rng.choices("abcdé \n", k=rng.randint(80, 400))) for _ in range(20)]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            x = rng.randint(0, len(b))
            t += b[x : x + rng.randint(0, 300)] + "".join(rng.choices("xyz", k=rng.choice([0, 0, 5, 40]))) + rng.choice("ab") * rng.choice([0, 0, 0, 250])
        rows.append((i * 3, t))
    rows += [(500, None), (501, ""), (None, base[0] * 2), (502, "w" * 99), (503, base[1] * 2000)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffix(rows)


@pytest.mark.parametrize("group", [4000, 3])
def test_suffix_dedup_common_line_and_repeated_rows(spark, group):
    """A line of 130 bytes between ever new neighbours, some of which agree by a few bytes, on both sides of the bound."""
    rng = random.Random(17)
    line = "".join(rng.choices("abcdefghij ", k=130))
    rows = [(i, "".join(rng.choices("pq", k=rng.randint(0, 12))) + line + "".join(rng.choices("rs", k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(70 + i, "".join(rng.choices("klmn", k=90)) + line[i:110 + i] + "".join(rng.choices("tuvw", k=90))) for i in range(20)]
    twice = rows + [rows[i] for i in (0, 5, 5, 60, 61, 79)]  # repeated rows are one document
    got = suffix_dedup.suffix_dedup(frame(spark, twice), group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = {r[0]: r for r in brute_suffix(rows)}
    assert sorted(map(tuple, got)) == sorted(want[d] for d, _ in twice)


@pytest.mark.parametrize("group", [4000, 1])
def test_suffix_dedup_repeats_of_one_document(spark, group):
    core = "".join(random.Random(6).choices("abcdef", k=120))
    rows = [(1, "x" * 40 + core + "y" * 40), (1, "x" * 40 + core + "y" * 40), (2, "z" * 40 + core + "v" * 40)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), group=group).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 0), (2, 120)]


def test_suffix_dedup_repeated_rows_and_none(spark):
    text = "".join(random.Random(5).choices("abcdef", k=300))
    got = suffix_dedup.suffix_dedup(frame(spark, [(1, text), (1, text), (2, text)])).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 0), (2, 300)]
    assert suffix_dedup.suffix_dedup(frame(spark, [(1, text)]).limit(0)).count() == 0


@pytest.mark.parametrize("group", [4000, 2])
def test_suffix_dedup_keeps_only_marks_on_disk(spark, group):
    """Occurrences, classes and contexts leave the shared folder with the step that read them last."""
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefghij ", k=130))
    rows = [(i, "".join(rng.choices("pq", k=20)) + line + "".join(rng.choices("rs", k=20))) for i in range(12)] + [(20, "k" * 300), (21, "k" * 300)]
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("suffix-*"))
    got = suffix_dedup.suffix_dedup(frame(spark, rows), group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    left = {x.name.rsplit("-", 1)[0] for x in set(folder.glob("suffix-*")) - before}
    assert left == {"suffix-copies", "suffix-later"} | ({"suffix-part-copies", "suffix-rest"} if group == 2 else set())
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffix(rows)


def test_longest_previous():
    rng = random.Random(2)
    text = bytes(rng.choices(b"ab", k=400)) + b"q" * 200
    data, starts = np.frombuffer(text, np.uint8), np.arange(500)

    def common(i, j):
        k = 0
        while k < 100 and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        return k

    assert suffix_dedup.longest_previous(data, starts, 100).tolist() == [max((common(i, j) for j in range(i)), default=0) for i in starts]


def brute_join(rows, words, percent):
    sets = []
    for d, t in rows:
        x = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((d, frozenset([tuple(x)] if 0 < len(x) < words else [tuple(x[i : i + words]) for i in range(len(x) - words + 1)])))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [set() for _ in sets]
    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                up[max(root(a), root(b))] = min(root(a), root(b))
                if x != y:
                    links[i].add(y)
                    links[j].add(x)
    return sorted((d, len(s), root(d), len(k)) for (d, s), k in zip(sets, links, strict=True))


@pytest.mark.parametrize(("words", "percent", "small"), [(4, 85, False), (5, 80, True)])
def test_ngram_join(spark, monkeypatch, words, percent, small):
    rng = random.Random(3)
    bases = [[rng.choice("abcdefghijkl") + str(rng.randint(0, 9)) for _ in range(rng.choice([1, 3, 5, 40, 120, 120]))] for _ in range(12)]
    rows = []
    for i in range(160):
        b = list(rng.choice(bases if rng.random() < 0.7 else bases[:2]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if b:
                k = rng.randrange(len(b))
                b[k : k + 1] = [] if rng.random() < 0.5 else [f"Z{rng.randint(0, 50)}"]
        rows.append((1000 - i, " ".join(b)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, " ".join(f"v{i}" for i in range(20_000))), (7, " ".join(f"v{i}" for i in range(20_050)))]
    if small:  # so that all ways through tiles are taken
        for k, v in {"PAIRS": 4, "TILE": 3, "GRID": 3, "SMALL": 5, "BLOCK": 4, "ROWS": 7, "SHARE": 1e-3, "LOCAL": 2, "CHUNK": 50}.items():
            monkeypatch.setattr(ngram_join, k, v)
    got = ngram_join.ngram_join(frame(spark, rows), words, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute_join(rows, words, percent)


def test_ngram_join_null_ids_and_repeats(spark):
    a, b = "w1 w2 w3 w4 w5 w6", "x1 x2 x3 x4 x5 x6"
    got = ngram_join.ngram_join(frame(spark, [(None, a), (3, a), (3, b), (5, b), (None, "only these few words here")])).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 3), (3, 3), (3, 3), (5, 3), (None, 3)], key=str)
    assert ngram_join.ngram_join(frame(spark, [(1, a)]).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 60), (60, 55), (70, 70)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(21)} | {50: 50, 60: 50, 55: 50}
