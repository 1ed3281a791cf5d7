"""Lexical retrieval packing: each window is a seed document and what a BM25 index of its shard finds nearest to it.

Documents are encoded once into a written table. One pass over it counts in how many documents each token id occurs, a
table no longer than the vocabulary; a second pass splits each partition into shards of a bounded number of tokens,
builds each shard's inverted index and packs it, so nothing is shuffled and a window costs the postings of its seed.

A window starts with a seed: the document left over from the window before, else the next unused. The index ranks the
unused documents by BM25 for the seed's tokens, but not the end token, which all have; they fill the window in that
order, the last is cut where the window ends, and its rest seeds the next. Without matches the next unused document
follows. Rows of one doc_id are not put into one window while there are others: a mix that takes a document twice has it
in two. So all windows are full but a shard's last, which is split into sequences whose lengths are powers of two.

Nulls: a null text is empty, so only the end token is packed; a null doc_id is kept. Rows that repeat are packed each.
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import Kept, table
from .tokens import default_path, encoder

WINDOW = 2048
END_ID = 1
#: Tokens of a shard, besides its last document.
SHARD_TOKENS = 1_500_000
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids): ids are little-endian, of two bytes if the vocabulary allows, else four."""

    def encode(batches):
        enc = encoder(path)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids, size, begin = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                ids.append(enc.encode(value.as_py() or "") + end)
                size += len(ids[-1])
                if size >= 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i + 1 - begin), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                    ids, size, begin = [], 0, i + 1

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def token_frequencies(encoded: DataFrame, dtype: str, vocab_size: int) -> tuple[np.ndarray, int, int]:
    """Documents with each token id, documents and tokens of all; at most vocab_size + 1 rows come to the driver."""

    def count(batches):
        df, docs, tokens = np.zeros(vocab_size + 1, np.int64), 0, 0
        last = np.zeros(vocab_size + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                ids = np.frombuffer(value.as_py(), dtype)
                # Of an id's places in a document only its last one counts.
                at = np.arange(len(ids))
                last[ids] = at
                df[ids[last[ids] == at]] += 1
                docs, tokens = docs + 1, tokens + len(ids)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"token": pa.array([*seen.tolist(), -1, -2], pa.int64()), "n": pa.array([*df[seen].tolist(), docs, tokens], pa.int64())})

    rows = encoded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").sum("n").collect()
    df, docs, tokens = np.zeros(vocab_size + 1, np.int64), 0, 0
    for token, n in rows:
        if token == -1:
            docs = n
        elif token == -2:
            tokens = n
        else:
            df[token] = n
    return df, docs, tokens


class Shard:
    """BM25 inverted index over some documents; used ones leave it as it is compacted."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, end_id: int | None = None):
        self.n, self.used, self.docs, self.end_id = len(docs), np.zeros(len(docs), bool), docs, end_id
        length = np.array([len(x) for x in docs], np.float64)
        # One sort of (term, document) as a number gives all postings in order.
        pair, tf = np.unique(np.concatenate(docs).astype(np.int64) * self.n + np.repeat(np.arange(self.n), length.astype(np.int64)), return_counts=True)
        self.term, self.owner = np.divmod(pair, self.n)
        if end_id is not None:
            keep = self.term != end_id
            self.term, self.owner, tf = self.term[keep], self.owner[keep], tf[keep]
        tf = tf.astype(np.float64)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.owner] / max(mean, 1e-9)))
        self._index(len(idf))

    def _index(self, size: int) -> None:
        self.ptr = np.searchsorted(self.term, np.arange(size + 1))
        self.live = self.n - int(self.used.sum())

    def use(self, i: int) -> None:
        self.used[i] = True

    def compact(self) -> None:
        unused = self.n - int(self.used.sum())
        if unused * 3 < self.live * 2:
            keep = ~self.used[self.owner]
            self.owner, self.weight, self.term = self.owner[keep], self.weight[keep], self.term[keep]
            self._index(len(self.ptr) - 1)

    def nearest(self, seed: int) -> np.ndarray:
        """Unused documents that share a token with the seed, best first, ties by place."""
        self.compact()
        t = np.unique(self.docs[seed]).astype(np.int64)
        if self.end_id is not None:
            t = t[t != self.end_id]
        if not len(t):
            return np.zeros(0, np.int64)
        # A term's postings lie side by side, so they are copied as one.
        runs = list(map(slice, self.ptr[t].tolist(), self.ptr[t + 1].tolist()))
        score = np.bincount(np.concatenate([self.owner[x] for x in runs]), np.concatenate([self.weight[x] for x in runs]), self.n)
        score[self.used] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW, names: list | None = None, end_id: int | None = None):
    """Sequences of pieces (document, start, length); documents of one name other than None are kept apart."""
    shard, left = Shard(docs, idf, mean, end_id), [len(x) for x in docs]
    place, done, seed = 0, [0] * len(docs), None
    sequence, room, inside = [], window, set()

    def take(i: int) -> None:
        nonlocal room
        n = min(room, left[i])
        sequence.append((i, done[i], n))
        inside.add(names[i] if names and names[i] is not None else (i,))
        done[i] += n
        left[i] -= n
        room -= n

    def following():
        """The next unused document, first of those whose name is not in the window."""
        nonlocal place
        while place < len(docs) and shard.used[place]:
            place += 1
        other = place
        while other < len(docs) and (shard.used[other] or names and names[other] in inside):
            other += 1
        return other if other < len(docs) else place if place < len(docs) else None

    while True:
        seed = following() if seed is None else seed
        if seed is None:
            break
        shard.use(seed)
        while left[seed] >= window and room == window:
            take(seed)
            yield sequence
            sequence, room, inside = [], window, set()
        if not left[seed]:
            seed = None
            continue
        take(seed)
        first, seed = seed, None
        if room:
            for i in shard.nearest(first).tolist():
                if names and names[i] in inside:
                    continue
                shard.use(i)
                take(i)
                if left[i]:
                    seed = i
                if not room:
                    break
        while room and (i := following()) is not None:
            shard.use(i)
            take(i)
            if left[i]:
                seed = i
        if not room:
            yield sequence
            sequence, room, inside = [], window, set()
    if sequence:  # the shard's last: cut where the powers of two of its length end
        total, at = window - room, 0
        cuts = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        for size in cuts:
            part = []
            while size:
                i, start, n = sequence[at]
                m = min(n, size)
                part.append((i, start, m))
                size -= m
                if m == n:
                    at += 1
                else:
                    sequence[at] = (i, start + m, n - m)
            yield part


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, path = docs.sparkSession, path or default_path()
    enc = encoder(path)
    dtype, vocab_size = enc.dtype.str, enc.vocab_size
    encoded = Kept(spark).keep(encode_documents(docs, path, end_id), "encoded")
    df, n_docs, n_tokens = token_frequencies(encoded, dtype, vocab_size)
    # At most one number for each id of the vocabulary goes to the tasks.
    idf, mean = np.log1p((n_docs - df + 0.5) / (df + 0.5)), n_tokens / max(n_docs, 1)

    def packed(batches):
        base, local = TaskContext.get().partitionId() << 32, 0
        names, ids, size = [], [], 0

        def flush():
            nonlocal local, names, ids, size
            rows = []
            for sequence in pack_shard(ids, idf, mean, window, names, end_id):
                offset = 0
                for i, start, n in sequence:
                    crc = zlib.crc32(ids[i][start : start + n].astype("<u4").tobytes())
                    rows.append((names[i], start, n, crc, len(ids[i]), base + local, offset))
                    offset += n
                local += 1
            names, ids, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                names.append(name.as_py())
                ids.append(np.frombuffer(value.as_py(), dtype))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    return encoded.mapInArrow(packed, SCHEMA)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
