"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document is the set of its distinct k-word shingles.  All shingles share one global order: first those that a
counting sketch over the whole corpus does not find frequent, then the frequent ones by rising frequency.  A document
of n shingles whose partners need T = ceil(t * n) shared ones keeps the first n - T + l shingles of that order; two
documents at or above the threshold then share at least min(l, l') shingles of those prefixes.  l is chosen for each
document from the estimated cost of its candidates: longer prefixes cost postings, larger l leaves fewer candidates to
verify.

Equal sets are one class from the start, so exact copies never meet in the join.  Within a shingle's posting list the
members first meet only one pivot (a star, not all pairs); stars that share enough prefix shingles are verified and
merged into components, and only members
of different components meet afterwards, pruned by the triangle inequality of the Jaccard distance to their pivot.

That gives the components, but not every link inside them.  Where links are counted, the sets of each component that is
not yet a clique are held against each other in full, in blocks, by products of their incidence matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel as K
from tessera.llm.components import components
from tessera.llm.workspace import Workspace

CELLS, CHUNK = 1 << 22, 1 << 13
ELLS = np.array([1, 2, 4, 8, 16, 32, 64])
#: cost of verifying one shingle of a candidate, in postings; candidates expected from one shingle that isn't frequent
VERIFY_COST, LIGHT_PARTNERS = 0.1, 0.1
NO_ID = -(1 << 63)
BITS = 1 << 24
#: sets and shingles of a block of a component, on average, and cells of a dense incidence matrix at a time
BLOCK_SETS, BLOCK_SHINGLES, DENSE = 1024, 1 << 20, 1 << 22


def _ids(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def _class_keys(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size, and a 64-bit key equal for equal sets."""
    size = np.bincount(rows, minlength=n)
    total = K.sums_by_row(rows, K.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), n)
    return size, K.mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _survey(k: int):
    """Per row (doc_id, n, cls); at a task's end its counting sketch in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, waiting, held = np.zeros(CELLS, np.uint32), [], 0

        def flush():
            nonlocal held
            if waiting:
                np.add(cells, np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32), out=cells)
                waiting.clear()
                held = 0

        for batch in batches:
            ids = _ids(batch.column(0))
            for part in K.slices(batch.column(1), K.NON_SPACE):
                rows, hashes = K.shingle_sets(part, k)
                size, keys = _class_keys(rows, hashes, part.rows)
                waiting.append((hashes >> np.uint64(64 - 22)).astype(np.int32))
                held += len(hashes)
                if held > 2_000_000:
                    flush()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part.low : part.high], mask=ids[part.low : part.high] == NO_ID), pa.array(size), pa.array(keys, mask=size == 0), pa.nulls(part.rows, pa.int32()), pa.nulls(part.rows, pa.binary())],
                    names=["doc_id", "n", "cls", "chunk", "cells"],
                )
        flush()
        if cells.any():
            packed = np.minimum(cells, 65535).astype(np.uint16).reshape(-1, CHUNK)
            blobs = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in packed]
            m = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.arange(m, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["doc_id", "n", "cls", "chunk", "cells"])
        K.release()

    return run


def _add_cells(out_chunk: bool, baseline: float | None):
    """Sum the sketches of one chunk; with a baseline, turn counts into frequency levels (0: not frequent)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.uint64)
        for blob, wide in zip(pdf["cells"], pdf["wide"], strict=True):
            kind = np.uint32 if wide else np.uint16
            total += np.frombuffer(pa.decompress(blob, decompressed_size=CHUNK * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
        if baseline is None:
            data = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        else:
            excess = total.astype(float) - baseline
            frequent = excess > 6 * math.sqrt(baseline) + 8
            data = np.where(frequent, np.clip(1 + 4 * np.log2(np.maximum(excess, 1)), 1, 255), 0).astype(np.uint8)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "cells": [pa.compress(data.tobytes(), codec="zstd", asbytes=True)], "wide": [True]})

    return run


def _levels(surveyed: DataFrame) -> np.ndarray:
    """Frequency level of every sketch cell: a fixed 4 MB whatever the corpus."""
    total = surveyed.agg(F.sum("n")).first()[0] or 0
    schema = "chunk int, cells binary, wide boolean"
    rows = surveyed.where("chunk is not null").select("chunk", "cells", F.lit(False).alias("wide"), F.pmod(F.xxhash64("cells"), F.lit(32)).alias("salt"))
    half = rows.groupBy("chunk", "salt").applyInPandas(_add_cells(True, None), schema)
    found = half.groupBy("chunk").applyInPandas(_add_cells(True, total / CELLS), schema).select("chunk", "cells").collect()
    levels = np.zeros((CELLS // CHUNK, CHUNK), np.uint8)
    for chunk, cells in found:  # at most CELLS / CHUNK rows
        levels[chunk] = np.frombuffer(pa.decompress(bytes(cells), decompressed_size=CHUNK, codec="zstd", asbytes=True), np.uint8)
    return levels.ravel()


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest shingles that a set of n must share with any partner."""
    return -(-n * percent // 100)


def _prefixes(k: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, seen = levels.value, set()
        for batch in batches:
            for part in K.slices(batch.column(0), K.NON_SPACE):
                rows, hashes = K.shingle_sets(part, k)
                size, keys = _class_keys(rows, hashes, part.rows)
                fresh = np.zeros(part.rows, bool)
                for r in np.flatnonzero(size):
                    if (key := int(keys[r])) not in seen:
                        seen.add(key)
                        fresh[r] = True
                keep = fresh[rows]
                rows, hashes = rows[keep], hashes[keep]
                if not len(rows):
                    continue
                level = level_of[hashes >> np.uint64(64 - 22)]
                order = np.lexsort(((level.astype(np.uint64) << np.uint64(56)) | (K.mix(hashes) >> np.uint64(8)), rows))
                hashes, level = hashes[order], level[order]
                partners = np.where(level == 0, LIGHT_PARTNERS, 2.0 ** ((level.astype(float) - 1) / 4))
                gain = np.concatenate([[0.0], np.cumsum(partners)])
                docs = np.flatnonzero(fresh)
                n = size[docs]
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                need = required(n, percent)
                ell = np.minimum(ELLS[:, None], need[None, :])
                length = (n - need)[None, :] + ell
                cost = length + VERIFY_COST * n * (gain[first + length] - gain[first]) / ell
                best = np.argmin(cost, axis=0)
                light = K.sums_by_row(rows, (level == 0).astype(np.int64), part.rows)[docs]
                ell, length = (x[best, np.arange(len(docs))] for x in (ell, length))
                take = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[take].view(np.int64)), pa.array(np.repeat(keys[docs], length)), pa.array(np.repeat(n, length).astype(np.int32)), pa.array(np.repeat(ell, length).astype(np.int32)), pa.array(level[take] > 0), pa.array(np.repeat(light, length).astype(np.int32))],
                    names=["token", "cls", "n", "ell", "heavy", "light"],
                )
        K.release()

    return run


def _bit(keys: np.ndarray) -> np.ndarray:
    return (K.mix(keys.view(np.uint64).copy()) & np.uint64(BITS - 1)).astype(np.int64)


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A fixed-size bit set of hashed ids, for skipping rows early; an exact join follows."""

    def run(batches):
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[_bit(_ids(batch.column(0)))] = True
        if bits.any():
            packed = np.packbits(bits).reshape(64, -1)
            keep = np.flatnonzero(packed.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array([packed[i].tobytes() for i in keep], pa.binary())], names=["part", "bits"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [out.tobytes()]})

    out = np.zeros((64, BITS // 8 // 64), np.uint8)
    for part, bits in df.select(column).mapInArrow(run, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect():
        out[part] = np.frombuffer(bytes(bits), np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def _fetch(k: int, bits):
    """(cls, text) of the documents that the bit set names, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = bits.value, set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted[_bit(_ids(batch.column(0)))]))
            for part in K.slices(batch.column(1), K.NON_SPACE):
                rows, hashes = K.shingle_sets(part, k)
                size, keys = _class_keys(rows, hashes, part.rows)
                pick = [r for r in np.flatnonzero(size) if int(keys[r]) not in seen and not seen.add(int(keys[r]))]
                if pick:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[pick]), batch.column(1).take(pa.array(np.array(pick) + part.low)).cast(pa.string())], names=["cls", "text"])
        K.release()

    return run


def _compare(k: int):
    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        part = next(K.slices(column, K.NON_SPACE, limit=1 << 60))
        return K.shingle_sets(part, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False))
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + 2 * K.SLICE_BYTES)))
                cut = batch.slice(low, high - low)
                left, right = sets(cut.column(2)), sets(cut.column(3))
                rows, hashes = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                both = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
                shared = np.bincount(rows[1:][both], minlength=high - low)
                size = np.bincount(rows, minlength=high - low)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(shared.astype(np.int32)), pa.array((size - shared).astype(np.int32))], names=["a", "b", "shared", "joint"])
                low = high
        K.release()

    return run


def _members(k: int, bits):
    """(cls, shingle hashes) of the documents that the bit set names, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = bits.value, set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted[_bit(_ids(batch.column(0)))]))
            for part in K.slices(batch.column(1), K.NON_SPACE):
                rows, hashes = K.shingle_sets(part, k)
                size, keys = _class_keys(rows, hashes, part.rows)
                pick = [r for r in np.flatnonzero(size) if int(keys[r]) not in seen and not seen.add(int(keys[r]))]
                if pick:
                    hashes, ends = hashes[np.argsort(rows, kind="stable")], np.cumsum(size)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[pick]), pa.array([hashes[ends[r] - size[r] : ends[r]].tobytes() for r in pick], pa.binary())], names=["cls", "hashes"])
        K.release()

    return run


def _shared(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x n counts of shared hashes; (row, hash) pairs are distinct."""
    _, token, times = np.unique(hashes, return_inverse=True, return_counts=True)
    keep = times[token] > 1
    rows, token = rows[keep], token[keep]
    order = np.argsort(token, kind="stable")
    rows, token = rows[order], token[order]
    token = np.cumsum(np.diff(token, prepend=token[:1]) != 0)
    shared = np.zeros((n, n), np.int64)
    wide = max(1, DENSE // n)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, wide):
        i, j = np.searchsorted(token, [low, low + wide])
        held = np.zeros((n, int(token[j - 1]) - low + 1), np.float32)
        held[rows[i:j], token[i:j] - low] = 1
        shared += np.rint(held @ held.T).astype(np.int64)
    return shared


def _degrees(percent: int):
    """Links of each set of a block pair: between the two blocks, or inside the block that meets itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, held in pdf.drop_duplicates("cls").groupby("comp", sort=False):
            sets = [np.frombuffer(x, np.uint64) for x in held["hashes"]]
            size, block = np.array([len(x) for x in sets]), held["block"].to_numpy()
            shared = _shared(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets))
            linked = shared * 100 >= (size[:, None] + size[None, :] - shared) * percent
            if held["p"].iloc[0] != held["q"].iloc[0]:
                linked &= block[:, None] != block[None, :]
            np.fill_diagonal(linked, False)
            out.append(pd.DataFrame({"cls": held["cls"].to_numpy(), "n_links": linked.sum(axis=1)}))
        return pd.concat(out)

    return run


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int, ws: Workspace):
        self.docs, self.k, self.percent, self.ws, self.spark = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), k, percent, ws, docs.sparkSession
        self.turn = 0

    def survey(self) -> DataFrame:
        surveyed = self.ws.save(self.docs.mapInArrow(_survey(self.k), "doc_id long, n long, cls long, chunk int, cells binary"), "survey")
        levels = self.spark.sparkContext.broadcast(_levels(surveyed))
        self.sets = surveyed.where("chunk is null").select("doc_id", "n", "cls")
        self.classes = self.ws.save(self.sets.where("n > 0").groupBy("cls").agg(F.min("n").cast("int").alias("n"), F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("rep")), "classes")
        sub = Window.partitionBy("token", "salt")
        posted = (
            self.docs.select("text")
            .mapInArrow(_prefixes(self.k, self.percent, levels), "token long, cls long, n int, ell int, heavy boolean, light int")
            .withColumn("salt", F.when(F.col("heavy"), F.pmod("cls", F.lit(64)) + 1).otherwise(F.lit(0)).cast("int"))
            .withColumn("key", F.struct("light", "cls"))
            .select("*", F.min("key").over(sub).alias("low"), F.max("key").over(sub).alias("high"))
            .where("heavy or low < high")
            .groupBy("token", "salt", "cls")  # dealt by token and salt already: no second shuffle
            .agg(F.max("ell").alias("ell"), *(F.first(c).alias(c) for c in ("n", "heavy", "key", "low")))
            .drop("salt")
        )
        self.postings = self.ws.save(posted, "postings")
        return self.postings

    def _bound(self) -> str:
        """Fewest prefix shingles that a linked pair x, y shares: of its T common ones at most max(T' - l) lie beyond the
        prefix that ends first, T' being each side's own bound."""
        p = self.percent
        return f"((x.n + y.n) * {p}L + {99 + p}L) div {100 + p}L - greatest((x.n * {p}L + 99) div 100 - x.ell, (y.n * {p}L + 99) div 100 - y.ell)"

    def verify(self, pairs: DataFrame, counted: bool = False) -> DataFrame:
        """Exact (a, b, shared, joint) of class pairs within the size bounds that share enough of their prefixes.

        ``counted`` pairs have had their shared prefix shingles counted already."""
        side = lambda x: self.classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("rep").alias(f"rep_{x}"))
        self.turn += 1
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(n_a, n_b) * 100L >= greatest(n_a, n_b) * {self.percent}L")
        if not counted:
            x, y = self.prefixes.alias("x"), self.prefixes.alias("y")
            met = sized.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls"))
            sized = met.where(f"size(array_intersect(x.tokens, y.tokens)) >= {self._bound()}")
        pairs = self.ws.save(sized.select("a", "b", "rep_a", "rep_b"), f"pairs_{self.turn}")
        ids = pairs.select(F.col("rep_a").alias("rep")).union(pairs.select("rep_b"))
        bits = self.spark.sparkContext.broadcast(_bitmap(ids, "rep"))
        texts = self.docs.mapInArrow(_fetch(self.k, bits), "cls long, text string")
        needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        texts = self.ws.save(texts.join(needed, "cls", "left_semi").dropDuplicates(["cls"]), f"texts_{self.turn}")
        paired = pairs.select("a", "b").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
        out = self.ws.save(paired.select("a", "b", "text_a", "text_b").mapInArrow(_compare(self.k), "a long, b long, shared int, joint int"), f"verified_{self.turn}")
        self.ws.drop(f"texts_{self.turn}", f"pairs_{self.turn}")
        return out

    def links(self) -> tuple[DataFrame, DataFrame | None]:
        """Links between classes, and the components they make."""
        empty = self.spark.createDataFrame([], "a long, b long")
        if self.survey().isEmpty():
            return empty, None
        # a shingle that two classes share is in both arrays: only postings of one class alone were left out
        self.prefixes = self.ws.save(self.postings.groupBy("cls").agg(F.collect_set("token").alias("tokens"), F.first("n").alias("n"), F.first("ell").alias("ell")), "prefixes")
        verified, labels = None, None
        open_postings = self.postings
        for turn in range(2):
            pivot = self._pivots(open_postings, turn)
            stars = pivot.where("cls <> leader").select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
            if verified is not None:
                stars = stars.join(verified.select("a", "b"), ["a", "b"], "left_anti")
            checked = self.verify(stars)
            verified = checked if verified is None else verified.unionByName(checked)
            labels = components(self._passed(verified), self.ws, f"star{turn}")
            open_postings, crossing = self._open(pivot, labels, turn)
            if not crossing or crossing <= 2 * open_postings.count():
                break
            if turn < 1:
                open_postings = open_postings.withColumn("low", F.coalesce("after", "low"))
        if crossing:
            pairs = self._crossing(open_postings, verified)
            checked = self.verify(pairs.join(verified.select("a", "b"), ["a", "b"], "left_anti"), counted=True)
            verified = verified.unionByName(checked)
            labels = components(self._passed(verified), self.ws, "final")
        return self._passed(verified), labels

    def _passed(self, verified: DataFrame) -> DataFrame:
        return verified.where(f"shared * 100L >= joint * {self.percent}L").select("a", "b")

    def degrees(self, edges: DataFrame, labels: DataFrame) -> DataFrame:
        """(cls, n_links): the number of sets that each set links to, all pairs of a component considered.

        Sets link only inside components, so components that the found links make cliques are settled.  Each of the
        others is dealt into blocks by the sets' keys, every two blocks meet once, and only counts leave a meeting; many
        small components share one.
        """
        found = edges.select(F.col("a").alias("cls")).union(edges.select("b")).groupBy("cls").agg(F.count("*").alias("n_links"))
        held = labels.select(F.col("node").alias("cls"), F.col("component").alias("comp")).join(self.classes, "cls").join(found, "cls")
        whole = held.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.sum("n_links").alias("ends"))
        parts = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int")
        whole = whole.select("comp", "total", (F.col("ends") == F.col("m") * (F.col("m") - 1)).alias("clique"), parts.alias("parts"))
        held = self.ws.save(held.join(whole, "comp").select("cls", "comp", "rep", "n", "n_links", "clique", "parts"), "degrees")
        settled, unsettled = held.where("clique").select("cls", "n_links"), held.where("not clique")
        small = unsettled.where("parts = 1").agg(F.sum("n")).first()[0]
        if small is None and unsettled.isEmpty():
            return settled
        bins = -(-(small or 0) // BLOCK_SHINGLES) or 1
        bits = self.spark.sparkContext.broadcast(_bitmap(unsettled, "rep"))
        sets = self.docs.mapInArrow(_members(self.k, bits), "cls long, hashes binary")
        dealt = (
            sets.join(unsettled.select("cls", "comp", "parts"), "cls")
            .withColumn("block", F.expr("cast(pmod(xxhash64(cls), parts) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
            .select("cls", "hashes", "comp", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), F.when(F.col("parts") == 1, F.pmod(F.xxhash64("comp"), F.lit(bins))).alias("bin"))
            .withColumn("meeting", F.when(F.col("bin").isNull(), F.col("comp")).otherwise(F.col("bin")))
        )
        counted = dealt.groupBy(F.col("bin").isNull().alias("large"), "meeting", "p", "q").applyInPandas(_degrees(self.percent), "cls long, n_links long")
        return settled.union(counted.groupBy("cls").agg(F.sum("n_links").alias("n_links")))

    def _pivots(self, postings: DataFrame, turn: int) -> DataFrame:
        """Postings with their list's pivot: the class with the fewest infrequent shingles of its own - the original of
        a group of near copies rather than one of its edits - and in each later turn the next one."""
        if turn == 0:
            heavy = postings.where("heavy").groupBy("token").agg(F.min("low").alias("top"))
            postings = postings.join(heavy, "token", "left").withColumn("low", F.coalesce("top", "low")).drop("top")
        return postings.withColumn("leader", F.col("low.cls"))

    def _open(self, postings: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, int]:
        """Postings of lists that still hold several components, and the number of pairs across components in them.

        One aggregate of each list gives all that later steps ask of it: whether it is open, its length (``held``) and
        the key that follows its pivot's (``after``), so the postings are joined to it once a turn.
        """
        held = postings.select("token", "cls", "n", "ell", "key", "low").join(labels.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        several = (
            held.groupBy("token")
            .agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("held"), F.min(F.when(F.col("key") > F.col("low"), F.col("key"))).alias("after"))
            .where("x <> y")
            .select("token", "held", "after")
        )
        still = self.ws.save(held.join(several, "token"), f"open_{turn}")
        self.ws.drop(f"open_{turn - 1}" if turn else "postings")
        by_comp = still.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg((F.pow(F.sum("m"), F.lit(2)) - F.sum(F.col("m") * F.col("m"))).alias("cross"))
        return still, int((by_comp.agg(F.sum("cross")).first()[0] or 0) / 2)

    def _crossing(self, postings: DataFrame, verified: DataFrame) -> DataFrame:
        """Pairs of different components that share enough of their prefixes.

        A prefix token that no other component holds can't be shared: only open tokens count.  With the open tokens of
        each side in one order, rarest first, a pair that shares h of them shares one at a rank with h - 1 others behind it
        on both sides, so a list makes a pair only there; the arrays of open tokens then give the full number of hits.
        """
        percent = self.percent
        pivot = postings.select("token", "cls", "n", "ell", "comp", "held", F.col("low.cls").alias("leader"))
        rarest = Window.partitionBy("cls").orderBy("held", "token")
        pivot = pivot.withColumn("rank", F.row_number().over(rarest)).withColumn("open", F.count("*").over(Window.partitionBy("cls")))
        gap = verified.select("a", "b", (1 - F.col("shared") / F.col("joint")).alias("gap"))
        far = gap.select(F.col("a").alias("cls"), F.col("b").alias("leader"), "gap").union(gap.select("b", "a", "gap"))
        known = pivot.join(far, ["cls", "leader"], "left").withColumn("gap", F.when(F.col("cls") == F.col("leader"), F.lit(0.0)).otherwise(F.col("gap")))
        known = self.ws.save(known, "known")
        slack = 1 - percent / 100 + 1e-9
        bound = self._bound()
        met = (
            known.alias("x")
            .join(known.alias("y"), F.expr(f"""
                x.token = y.token and x.cls < y.cls and x.comp <> y.comp
                and least(x.n, y.n) * 100L >= greatest(x.n, y.n) * {percent}L
                and least(x.open - x.rank, y.open - y.rank) + 1 >= {bound}
                and (x.gap is null or y.gap is null or abs(x.gap - y.gap) <= {slack})"""))
            .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.expr(bound).alias("least"))
            .distinct()
        )
        tokens = self.ws.save(known.groupBy("cls").agg(F.collect_set("token").alias("tokens")), "tokens")
        return (
            met.join(tokens.withColumnsRenamed({"cls": "a", "tokens": "left"}), "a")
            .join(tokens.withColumnsRenamed({"cls": "b", "tokens": "right"}), "b")
            .where(F.size(F.array_intersect("left", "right")) >= F.col("least"))
            .select("a", "b")
        )


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, ws: Workspace | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    Words are runs of non-space characters after lower-casing A-Z.  Documents link when 100 * |A and B| >= percent *
    |A or B| over their sets of k-word shingles; fewer than k words make one shingle.  component_id is the smallest
    doc_id reachable by links, itself included; n_links counts the different sets linked to the row's set.

    Null and empty texts, and texts without words: no shingles, linked with nothing, own component (two such rows
    never meet).  Repeated rows and equal sets: one class, linked.  A null doc_id takes part, but never names a
    component unless all ids of it are null (then null).  Other columns are ignored.  Sets are told apart by 64-bit hashes.
    """
    return _labelled(docs, k, percent, ws, True)


def _components(docs: DataFrame, k: int, percent: int, ws: Workspace | None, counted: bool) -> tuple[_Join, DataFrame]:
    """The join, and (cls, component, rep, n_links) of its classes; n_links is 0 unless links are counted."""
    join = _Join(docs, k, percent, ws or Workspace(docs.sparkSession, "ngram"))
    edges, labels = join.links()
    named = join.classes.select(F.col("cls").alias("node"), "rep")
    if labels is not None:
        named = named.join(labels, "node", "left")
    else:
        named = named.withColumn("component", F.col("node"))
    if labels is not None and counted:
        named = named.join(join.degrees(edges, labels).withColumnRenamed("cls", "node"), "node", "left")
    else:
        named = named.withColumn("n_links", F.lit(0).cast("long"))
    return join, named.select(F.col("node").alias("cls"), F.coalesce("component", "node").alias("component"), F.nullif("rep", F.lit(NO_ID)).alias("rep"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _labelled(docs: DataFrame, k: int, percent: int, ws: Workspace | None, counted: bool) -> DataFrame:
    """The join's result."""
    join, named = _components(docs, k, percent, ws, counted)
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(lowest, "component").select("cls", "component_id", "n_links")
    return join.sets.join(by_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def _keyed(k: int, id_at: int, text_at: int):
    """Rows with their set's class (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(text_at), K.NON_SPACE):
                size, keys = _class_keys(*K.shingle_sets(part, k), part.rows)
                own = batch.slice(part.low, part.rows)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(keys, mask=size == 0)], names=[*(f"c{i}" for i in range(own.num_columns)), "cls"])
        K.release()

    return run


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, all columns kept.

    A row with the smallest doc_id of its group stays; rows with a null doc_id stay only where no row of their group has
    an id, and then one does.  Rows without words, null and empty texts included, all stay.  Of rows that repeat that id
    inside the group one stays; rows that share an id but not a group are decided each in its own.
    """
    join, named = _components(docs, k, percent, None, False)
    # of each group the class that holds the smallest id, by the class key where several do
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "cls")).alias("low")).select(F.col("low.cls").alias("_cls"), F.col("low.rep").alias("_id"))
    kept = join.ws.save(kept, "kept")
    ids = join.sets.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:  # ids tell rows apart
        wordless = join.sets.where("n = 0").select(F.col("doc_id").alias("_id"))
        return docs.join(kept.select("_id").union(wordless), docs["doc_id"] == F.col("_id"), "left_semi")
    names, fields = docs.columns, docs.schema.fields
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index("doc_id")
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)), T.StructField("cls", T.LongType())])
    keyed = own.mapInArrow(_keyed(k, at, names.index("text")), schema)
    chosen = keyed.join(kept, (F.col("cls") == F.col("_cls")) & F.col(f"c{at}").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    rest = [f"c{i}" for i in range(len(names))]
    one = chosen.groupBy("cls").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("row")).select("row.*")
    return one.unionByName(keyed.where("cls is null").drop("cls")).toDF(*names)


def query(spark, sf_dir):
    from tessera.llm.workspace import table

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)
