"""Near-duplicate documents by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

A document's set is its distinct shingles of five words, or all its words as one shingle if it has fewer. SuperMinHash
gives each element a random permutation of the registers, drawn step by step: at step j an element offers j plus a
random fraction to the register its permutation has at j. Ranks of one element are thus spread over all registers,
which lowers the variance, and a document stops at the step beyond which no register can fall any more.

Equal sets become one class, whose id is the smallest doc_id. Classes that agree on a band of registers are compared
with the bucket's smallest class and linked if their full sets reach the threshold. Buckets that then still hold
several groups show which groups are alike; each family of such groups has all pairs across its groups tried on full
sets, block by block, so no link is lost to the choice of the first centre and no pairs are emitted but links. A pair is confirmed on full sets only if the signatures' estimate is near the threshold or above. With 32
bands of 4 of 128 registers a pair at the threshold shares no band with probability 5e-6; the estimate of such a pair
falls below its bound with probability under 1e-6.

Nulls and ties: null, empty and blank texts have an empty set, n_shingles 0, and link with nothing. Rows that share a
doc_id are one document of several texts. A null doc_id links with nothing and is kept. Empty tables give no rows. Only
doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, SpanHasher, byte_class, components, mix64, segments, table, text_buffer, word_spans

WORDS, THRESHOLD = 5, 75
REGISTERS, BANDS = 128, 32
#: Least share of equal registers for which a pair is confirmed.
ESTIMATE = 0.55
#: Members of a bucket that are compared in one block.
BLOCK = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, inside: np.ndarray, words: int = WORDS):
    """Distinct shingle hashes, sorted by row and hash, and the row of each."""
    start, end, row = word_spans(data, offsets, inside)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hasher.of(hasher.prefix(data), start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    place = np.arange(len(row)) - first[row]
    # A shingle starts where words - 1 words follow; a shorter text is one shingle from its first word.
    width = np.minimum(count[row], words)
    at = np.flatnonzero(place + width <= count[row])
    at = at[(count[row[at]] >= words) | (place[at] == 0)]
    total = np.zeros(len(at), np.uint64)
    factor = _STEP
    for k in range(words):
        has = k < width[at]
        total[has] = total[has] * factor + h[at[has] + k]
    total = mix64(total ^ (width[at].astype(np.uint64) << np.uint64(56)))
    row = row[at]
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    return total[new], row[new]


def superminhash(h: np.ndarray, row: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n by m registers of 16 bits each, from (step, fraction) minima; rows without elements are all ones."""
    least = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    if len(h):
        active, perm = np.arange(len(h)), None
        for j in range(m):
            own = h[active]
            u = mix64(own + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
            k = j + ((u & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            if perm is None:
                to = k
            else:
                line = np.arange(len(active))
                to = perm[line, k].astype(np.int64)
                perm[line, k] = perm[:, j]
                perm[:, j] = to
            np.minimum.at(least, row[active] * m + to, np.uint64(j) << np.uint64(32) | u >> np.uint64(32))
            open_rows = least.reshape(n, m).max(1) > np.uint64((j + 1) << 32)
            go_on = open_rows[row[active]]
            if not go_on.any():
                break
            active = active[go_on]
            if perm is None:
                perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(active), m)).copy()
                line, swap = np.arange(len(active)), k[go_on]
                perm[line, swap] = 0
                perm[:, 0] = swap
            else:
                perm = perm[go_on]
    return (mix64(least) >> np.uint64(48)).astype(np.uint16).reshape(n, m)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig) by row; d1, d2 are a digest of the set, null with sig if it is empty."""

    def sign(batches):
        hasher, inside = SpanHasher(), byte_class("space")
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for low, high in segments(offsets):
                part = offsets[low : high + 1]
                h, row = shingle_sets(data[part[0] : part[-1]], part - part[0], hasher, inside, words)
                n = high - low
                size = np.bincount(row, minlength=n)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                end = np.cumsum(size)
                digest = [(s[end] - s[end - size]).view(np.int64) for s in sums]
                sig = superminhash(h, row, n)
                none = size == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), pa.array(size, pa.int64()), *(pa.array(d, pa.int64(), mask=none) for d in digest), pa.array([None if e else s.tobytes() for e, s in zip(none, sig, strict=True)], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def band_rows(classes: DataFrame, bands: int = BANDS) -> DataFrame:
    """(band, bucket, id): the registers of a band, as they are, name its bucket."""

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, -1)
                step = sig.shape[1] // bands
                for b in range(bands):
                    key = sig[:, b * step].copy()
                    for k in range(1, step):
                        key = mix64(key.view(np.uint64) + _STEP).view(np.int64) ^ sig[:, b * step + k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b, np.int32)), pa.array(key), batch.column(0)], ["band", "bucket", "id"])

    return classes.select("id", "sig").mapInArrow(deal, "band int, bucket long, id long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, shingles): sorted hashes of the whole set of the documents whose doc_id is in ids."""

    def gather(batches):
        hasher, inside = SpanHasher(), byte_class("space")
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for low, high in segments(offsets):
                part = offsets[low : high + 1]
                h, row = shingle_sets(data[part[0] : part[-1]], part - part[0], hasher, inside, words)
                end = np.searchsorted(row, np.arange(high - low), "right")
                begin = np.searchsorted(row, np.arange(high - low), "left")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([h[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary())], ["id", "shingles"])

    return docs.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(gather, "id long, shingles binary").where("length(shingles) > 0")


def dealt_in_blocks(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Members, with the number n of their group, once for each pair (i, j) of blocks that they are in; p is their block."""
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = members.withColumn("p", F.pmod(F.xxhash64("id", *keys), parts).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    return mine.withColumn("i", F.least("p", "q")).withColumn("j", F.greatest("p", "q")).drop("q", "n")


def block_sides(pdf: pd.DataFrame):
    i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
    return (pdf, pdf) if i == j else (pdf[pdf.p == i], pdf[pdf.p == j])


def alike_across(left: pd.DataFrame, right: pd.DataFrame, estimate: float):
    """For each row of left: its place, and the places in right of other labels whose signatures are alike."""
    rs = np.frombuffer(b"".join(right.sig), np.uint16).reshape(len(right), -1) if len(right) else None
    rlab, least = right.label.to_numpy(), estimate * (rs.shape[1] if len(right) else 0)
    for x, (sig, label) in enumerate(zip(left.sig, left.label, strict=True)):
        at = np.flatnonzero(rlab != label)
        if len(at):
            at = at[(rs[at] == np.frombuffer(sig, np.uint16)).sum(1) >= least]
            if len(at):
                yield x, at


def families(members: DataFrame, estimate: float, block: int) -> DataFrame:
    """(id, label, root): members that are alike to one of another label in a bucket; root joins their labels.

    members: (band, bucket, id, n, label, sig). A task gives a row for each of its members at most, not for pairs.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = block_sides(pdf)
        up: dict[int, int] = {}

        def top(a: int) -> int:
            while up.setdefault(a, a) != a:
                up[a] = up[up[a]]
                a = up[a]
            return a

        seen: dict[int, int] = {}
        lid, llab, rid, rlab = left.id.to_numpy(), left.label.to_numpy(), right.id.to_numpy(), right.label.to_numpy()
        for x, at in alike_across(left, right, estimate):
            seen[int(lid[x])] = int(llab[x])
            seen.update(zip(rid[at].tolist(), rlab[at].tolist(), strict=True))
            for other in np.unique(rlab[at]).tolist():
                a, b = top(int(llab[x])), top(other)
                up[max(a, b)] = min(a, b)
        return pd.DataFrame({"id": np.array(list(seen), np.int64), "label": np.array(list(seen.values()), np.int64), "root": np.array([top(v) for v in seen.values()], np.int64)})

    return dealt_in_blocks(members, ["bucket"], block).groupBy("band", "bucket", "i", "j").applyInPandas(compare, "id long, label long, root long")


def confirmed_within(members: DataFrame, estimate: float, threshold: int, block: int) -> DataFrame:
    """(a, b): for members (family, id, n, label, sig, shingles), a forest of the links across labels, on full sets."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = block_sides(pdf)
        a, b, up = [], [], {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        if len(left) and len(right):
            sets = [np.frombuffer(x, np.uint64) for x in right.shingles]
            size = np.array([len(x) for x in sets])
            begin = np.cumsum(size) - size
            universe, place = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(universe), np.int64)
            lid, llab, rid, rlab = left.id.to_numpy(), left.label.to_numpy(), right.id.to_numpy(), right.label.to_numpy()
            own = list(left.shingles)
            for x, at in alike_across(left, right, estimate):
                mine = np.frombuffer(own[x], np.uint64)
                low = np.searchsorted(universe, mine)
                low = low[universe[np.minimum(low, len(universe) - 1)] == mine]
                mark[low] = 1
                both = np.add.reduceat(mark[place], begin)[at]
                mark[low] = 0
                for y in at[100 * both >= threshold * (len(mine) + size[at] - both)].tolist():
                    p, q = top(int(llab[x])), top(int(rlab[y]))
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        a.append(int(lid[x]))
                        b.append(int(rid[y]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt_in_blocks(members, ["family"], block).groupBy("family", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, registers: int = REGISTERS, bands: int = BANDS, estimate: float = ESTIMATE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept by row of docs."""
    spark = docs.sparkSession
    kept = Kept(spark)
    signed = kept.keep(signatures(docs, words), "signed")
    classes = kept.keep(signed.where("sig is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size")), "classes")
    rows = band_rows(classes, bands)
    buckets = rows.groupBy("band", "bucket").agg(F.min("id").alias("centre"), F.count("id").alias("n")).where("n > 1")
    members = kept.keep(rows.join(buckets, ["band", "bucket"]), "members")

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs near enough by size and signature to be confirmed."""

        def agree(batches):
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[2:4])
                    keep = pa.array((x == y).mean(1) >= estimate)
                    yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

        x = classes.select(F.col("id").alias("a"), F.col("sig").alias("x"), F.col("size").alias("nx"))
        y = classes.select(F.col("id").alias("b"), F.col("sig").alias("y"), F.col("size").alias("ny"))
        near = pairs.join(x, "a").join(y, "b").where(100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny"))
        return near.select("a", "b", "x", "y").mapInArrow(agree, "a long, b long")

    pairs = kept.keep(alike(members.where("id <> centre").selectExpr("centre a", "id b").distinct()).distinct(), "pairs")
    ids = lambda p: p.selectExpr("explode(array(a, b)) id").distinct()
    links = kept.keep(confirmed(pairs, full_sets(docs, ids(pairs), words), threshold).distinct(), "links")
    groups = components(spark, links)
    labelled = members.where("n > 2").join(groups, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    split = labelled.groupBy("band", "bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band", "bucket")
    apart = labelled.join(split, ["band", "bucket"]).select("band", "bucket", "id", "n", "label").join(classes.select("id", "sig"), "id")
    near = kept.keep(families(apart, estimate, block).distinct(), "families")
    if not near.isEmpty():
        joined = components(spark, near.select(F.col("label").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("label"), F.col("component").alias("family"))
        inside = kept.keep(near.select("id", "label").distinct().join(joined, "label"), "families")
        inside = inside.join(inside.groupBy("family").agg(F.count("*").alias("n")), "family").join(classes.select("id", "sig"), "id").join(full_sets(docs, inside.select("id"), words), "id")
        late = kept.keep(confirmed_within(inside, estimate, threshold, block), "links")
        if not late.isEmpty():
            groups = components(spark, links.unionByName(late))
    kept.drop(members, pairs, links, near)
    named = classes.join(groups, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, and of rows that repeat a doc_id and its text, one."""
    cols = docs.columns
    lost = near_duplicates(docs, **how).where(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(lost, "doc_id", "left_anti").select(*cols)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    once = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*cols)
    return out.join(again, "doc_id", "left_anti").select(*cols).unionByName(once)


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
