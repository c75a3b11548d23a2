"""Operator 3: SentencePiece encoding and decoding for merge-type vocabularies.

An agenda holds the adjacent symbol pairs that form a piece, ordered by score and then by position; the best pair
merges until none is left. Texts are cut only where no merge can cross: before a run of spaces, if no piece holds a
space after another character, around line feeds, if no piece holds one, and between a letter and a mark that no
piece holds after a letter. The distinct cuts of a batch are encoded
together: a matrix holds the agenda of each, and every round merges the best pair of each row. Cuts of over
MATRIX_CHARS symbols go through a heap. Characters that no piece covers become byte pieces.

`verify` encodes each Arrow batch with the sentencepiece library too and fails at the first difference. About
SLICE_BYTES of text are worked on at once, and the cuts that a task remembers are bounded in number and characters, so
memory follows neither the size of batches nor of the corpus (one very long text is held whole). Decoding uses
the library's decode(ids). The vocabulary's path is a parameter; its bytes (bounded by the vocabulary, 0.5 MB here) go
to the executors with the function.

Defined cases: null and empty texts have no ids and decode to nothing. Vocabularies of another type, without byte
fallback, with user-defined or unused pieces or with rewriting normalisation raise ValueError. Repeated rows are
encoded like any other. Other columns are not carried. The result has one row for each row of docs.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import lean, pieces, read

SPACE, NONE, ABSENT = "▁", np.int32(2**31 - 1), 2**40
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Longest cut for the matrix; most cuts and characters of cuts that are remembered; bytes of text worked on at once.
MATRIX_CHARS, CACHE, CACHE_CHARS, SLICE_BYTES = 40, 300_000, 4_000_000, 1_000_000


def proto_fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class MergeVocabulary:
    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in proto_fields(model):
            if number == 1:
                f = dict(proto_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(proto_fields(value))
            elif number == 3:
                normalizer = dict(proto_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE} or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only merge-type vocabularies with byte fallback and plain normalisation are supported")
        self.prefix = " " if normalizer.get(3, 1) else ""
        self.size = len(pieces)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.bytes = [0] * 256
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        order = {s: r for r, s in enumerate(sorted({-s for _, s, _ in pieces}))}
        self.rank = np.array([order[-s] for _, s, _ in pieces], np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = {(self.ids[p[:k]], self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pairs = pairs
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slot_key, self.slot_to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for (a, b), to in pairs.items():
            at = int(self._slot(np.array([a * self.size + b], np.int64))[0])
            while self.slot_key[at] >= 0:
                at = (at + 1) & int(self.mask)
            self.slot_key[at], self.slot_to[at] = a * self.size + b, to
        crossing = any(c == SPACE and p[i] != SPACE for p in self.ids for i, c in enumerate(p[1:]))
        line = any("\n" in p for p in self.ids)
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if re.fullmatch(LETTER, a)}
        marks = "".join(c for c in ".,;:!?" if c not in after_letter)
        word = (rf" *{LETTER}+(?=[{marks}])|" if marks else "") + (" *[^ ]+" if line else r" *[^ \n]+")
        self.cuts = re.compile("(?s).+" if crossing else rf"{word}| +" if line else rf"\n|{word}| +")
        self.names = list(map(str, range(self.size)))
        self.cache: dict[str, int] = {}
        self.cache_chars = 0
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair forms, or -1. Symbols of self.size and more stand for characters outside the vocabulary."""
        key = a.astype(np.int64) * self.size + b
        out = np.full(len(key), -1, np.int32)
        rest = np.flatnonzero((a < self.size) & (b < self.size))
        at = self._slot(key[rest])
        while len(rest):
            held = self.slot_key[at]
            hit = held == key[rest]
            out[rest[hit]] = self.slot_to[at[hit]]
            more = ~hit & (held >= 0)
            rest, at = rest[more], (at[more] + 1) & self.mask
        return out

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        ids = self.char[points]
        return np.where(ids >= 0, ids, points + self.size)

    def agenda(self, symbols: list[int]) -> list[int]:
        """One sequence, by a heap of (rank of score, position, length at the time)."""
        sym, n = list(symbols), len(symbols)
        before, after, width = list(range(-1, n - 1)), [*range(1, n), -1], [1] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i):
            j = after[i]
            if j >= 0 and (to := self.pairs.get((sym[i], sym[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[to]), i, width[i] + width[j], to))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, w, to = heapq.heappop(heap)
            j = after[i]
            if not width[i] or j < 0 or width[i] + width[j] != w or self.pairs.get((sym[i], sym[j])) != to:
                continue
            sym[i], width[i], width[j] = to, w, 0
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s, w in zip(sym, width, strict=True) if w]

    def matrix(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many short sequences at once, one in a row: each round merges the best pair of every row that has one."""
        done, lengths = np.full_like(sym, -1), length.copy()
        who, r = np.arange(len(sym)), np.arange(len(sym))
        to = self.merged(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(sym), -1)
        while len(who):
            wide = sym.shape[1]
            if wide > 1:
                rank = np.where(to >= 0, self.rank[to], NONE)
                best = rank.argmin(1)
                live = rank[r, best] < NONE
            else:
                best, live = r, np.zeros(len(who), bool)
            if not live.all():
                over = who[~live]
                done[over, :wide], lengths[over] = sym[~live], length[~live]
                who, sym, to, length, best = who[live], sym[live], to[live], length[live], best[live]
                r = np.arange(len(who))
            if not len(who):
                break
            length = length - 1
            sym[r, best] = to[r, best]
            cols = np.arange(wide - 1)
            sym = sym.ravel()[(r * wide)[:, None] + cols + (cols > best[:, None])]
            if wide > 2:
                cols = np.arange(wide - 2)
                to = to.ravel()[(r * (wide - 1))[:, None] + cols + (cols >= best[:, None])]
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < wide - 2)
                at = np.concatenate((best[left] - 1, best[right]))
                rows = np.concatenate((left, right))
                to[rows, at] = self.merged(sym[rows, at], sym[rows, at + 1])
        return done, lengths

    def spelled(self, symbols: np.ndarray) -> np.ndarray:
        """Ids: characters outside the vocabulary become byte pieces."""
        if not len(symbols) or symbols.max() < self.size:
            return symbols
        out: list[int] = []
        for s in symbols.tolist():
            out += [s] if s < self.size else [self.bytes[b] for b in chr(s - self.size).encode()]
        return np.array(out, np.int64)

    def learn(self, cuts: set[str]) -> None:
        """Adds the ids of each cut to the pool. What is remembered is bounded in cuts and in characters."""
        new = [c for c in cuts if c not in self.cache]
        chars = sum(map(len, new))
        if self.cache and (len(self.cache) + len(new) > CACHE or self.cache_chars + chars > CACHE_CHARS):
            self.cache, self.start, self.count, self.pool = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
            new, chars, self.cache_chars = list(cuts), sum(map(len, cuts)), 0
        if not new:
            return
        self.cache_chars += chars
        new.sort(key=len)
        symbols = self.symbols("".join(new).replace(" ", SPACE))
        length = np.fromiter(map(len, new), np.int64, len(new))
        begin = np.cumsum(length) - length
        pools, counts, k = [], [], 0
        short = int(np.searchsorted(length, MATRIX_CHARS, "right"))
        while k < short:
            end = min(k + 8192, short)
            wide = int(length[end - 1])
            held = np.arange(wide) < length[k:end, None]
            sym = np.full((end - k, wide), ABSENT, np.int64)
            sym[held] = symbols[begin[k] : begin[end - 1] + length[end - 1]]
            done, n = self.matrix(sym, length[k:end])
            odd = np.flatnonzero((done >= self.size).any(1) & (done < ABSENT).any(1) & ((done >= self.size) & (done < ABSENT)).any(1))
            held = np.arange(wide) < n[:, None]
            if len(odd):
                rows = np.split(done[held], np.cumsum(n)[:-1])
                for i in odd:
                    rows[i] = self.spelled(rows[i])
                    n[i] = len(rows[i])
                pools.append(np.concatenate(rows))
            else:
                pools.append(done[held])
            counts.append(n)
            k = end
        for i in range(short, len(new)):
            ids = self.spelled(np.array(self.agenda(symbols[begin[i] : begin[i] + length[i]].tolist()), np.int64))
            pools.append(ids)
            counts.append(np.array([len(ids)]))
        known, count = len(self.cache), np.concatenate(counts)
        self.cache.update(zip(new, range(known, known + len(new)), strict=True))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.pool = np.concatenate((self.pool, np.concatenate(pools).astype(np.int32)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        # a space and its own sign are the same; only runs of both may be cut from what is before them
        cuts = [self.cuts.findall(self.prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        flat = list(chain.from_iterable(cuts))
        self.learn(set(flat))
        which = np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))
        count = self.count[which]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(self.start[which] - total[:-1], count) + np.arange(total[-1])]
        return np.split(ids, total[np.cumsum([len(c) for c in cuts])[:-1]]) if texts else []


def sentence_pieces(docs: DataFrame, model_path: str, verify: bool = False, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids array<int> (if with_ids), ids_sha256, decoded_sha256: one row for each row of docs."""
    import pyarrow as pa

    with open(model_path, "rb") as f:
        model = f.read()
    MergeVocabulary(model)  # fails here, not on the executors

    def run(batches):
        import sentencepiece

        library, own = sentencepiece.SentencePieceProcessor(model_proto=model), MergeVocabulary(model)
        for batch in pieces(batches, 1, SLICE_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = own.encode(texts)
            ids_sha, text_sha = [], []
            for text, each in zip(texts, found, strict=True):
                ids = each.tolist()
                if verify and ids != library.encode(text):
                    raise ValueError("the agenda and the library differ")
                ids_sha.append(hashlib.sha256(",".join([own.names[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(library.decode(ids).encode() if ids else b"").hexdigest())
            n = np.array([len(each) for each in found], np.int64)
            cols = [batch.column(0), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                flat = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
                cols.insert(2, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens"] + ["ids"] * with_ids + ["ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces(read(spark, sf_dir, "documents", "doc_id", "text"), default_model(), verify=True, with_ids=False)
