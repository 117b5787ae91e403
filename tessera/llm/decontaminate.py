"""Benchmark decontamination by word windows.

The benchmark's windows of 13 consecutive normalised words (an item of fewer words is one window) form a hash set that
is broadcast behind a check of its size.  Every document's windows are hashed in numpy, looked up behind a bit filter,
verified word by word, and hit words are marked; spans or whole documents can then be removed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K

WINDOW = 13
#: windows that one broadcast set may hold (about 200 bytes each), and bytes of the items' texts; both are counted by
#: Spark before any item reaches the driver
MAX_WINDOWS, MAX_BYTES = 1_000_000, 64 << 20
_MASK = (1 << 22) - 1


class WindowSet:
    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        column = pa.array([x[1] for x in items], pa.large_string())
        hashes: dict[bytes, int] = {}
        for part in K.slices(column, K.ALNUM):
            words, count = part.word_hashes(), part.n_words
            for r in np.flatnonzero(count):
                k, first = int(min(window, count[r])), int(part.first_word[r])
                grams = K.ngram_hashes(words[first : first + count[r]], k)
                texts = [part.text(first + i) for i in range(count[r])]
                for i, h in enumerate(grams):
                    key = b" ".join(texts[i : i + k])
                    hashes[key] = int(h)
                    found[k][key].add(str(items[part.low + r][0]))
        self.size = len(hashes)
        self.by_length = {}
        for k, keys in found.items():
            order = sorted(keys, key=hashes.__getitem__)
            codes = np.array([hashes[x] for x in order], np.uint64)
            bits = np.zeros(_MASK + 1, bool)
            bits[(codes & np.uint64(_MASK)).astype(np.int64)] = True
            self.by_length[k] = codes, bits, [(x, sorted(keys[x])) for x in order]

    def scan(self, part: K.Slice) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Whether each word is hit, and the items that occur in each row."""
        words, row, limit = part.word_hashes(), part.row_of_word(), part.first_word
        edge = np.zeros(len(words) + 1, np.int32)
        items: dict[int, set[str]] = defaultdict(set)
        for k, (codes, bits, keys) in self.by_length.items():
            grams = K.ngram_hashes(words, k)
            near = np.flatnonzero(bits[(grams & np.uint64(_MASK)).astype(np.int64)])
            near = near[near + k <= limit[row[near] + 1]]
            at = np.searchsorted(codes, grams[near])
            at[at == len(codes)] = 0
            match = codes[at] == grams[near]
            for i, j in zip(near[match].tolist(), at[match].tolist(), strict=True):
                text = b" ".join(part.text(i + t) for t in range(k))
                while j < len(codes) and codes[j] == grams[i]:  # equal hashes of different windows
                    if keys[j][0] == text:
                        edge[i] += 1
                        edge[i + k] -= 1
                        items[int(row[i])].update(keys[j][1])
                    j += 1
        return np.cumsum(edge[:-1]) > 0, items


def _window_set(benchmark: DataFrame, window: int):
    items = benchmark.select("item_id", "text").where("text is not null")
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]|[A-Z])+"), F.lit(0)))
    n, size = items.select(F.when(n_words > 0, F.greatest(n_words - (window - 1), F.lit(1))).otherwise(0).alias("n"), F.octet_length("text").alias("size")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > MAX_WINDOWS or size > MAX_BYTES:
        raise ValueError(f"{n} benchmark windows in {size} bytes; a broadcast set holds {MAX_WINDOWS} and {MAX_BYTES}. Split the benchmark and run each part.")
    rows = items.collect()
    return benchmark.sparkSession.sparkContext.broadcast(WindowSet([tuple(x) for x in rows], window))


def _cut(part: K.Slice, hit: np.ndarray, r: int, source: bytes) -> str:
    """The row's text without its hit words and the separators between neighbouring ones."""
    first, last, base = part.first_word[r], part.first_word[r + 1], part.offsets[r]
    keep, at, i = [], 0, first
    while i < last:
        if hit[i]:
            j = i
            while j + 1 < last and hit[j + 1]:
                j += 1
            keep.append(source[at : part.starts[i] - base])
            at = part.ends[j] - base
            i = j
        i += 1
    return (b"".join(keep) + source[at:]).decode("utf-8", "replace")


def _report(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1), K.ALNUM):
                hit, items = windows.value.scan(part)
                count = part.n_words
                n_hit = K.sums_by_row(part.row_of_word(), hit.astype(np.int64), part.rows)
                listed = [sorted(items.get(r, ())) for r in range(part.rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.low, part.rows), pa.array(count.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()),
                     pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]), pa.array((n_hit > 0) & (20 * n_hit >= count)), pa.array(listed, pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of characters outside ASCII punctuation, spaces and controls, with A-Z lower-cased.  A word is hit
    inside any occurrence of a benchmark window; a row is contaminated from one hit word in twenty.  Null and empty
    texts have no words and no hits; items without words have no windows; an empty benchmark hits nothing.  Repeated
    rows are reported each; other columns are ignored.
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_report(_window_set(benchmark, window)), schema)


def _clean(windows, text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = K.as_binary(batch.column(text_at))
            texts = batch.column(text_at).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            changed = False
            for part in K.slices(source, K.ALNUM):
                hit, _ = windows.value.scan(part)
                n_hit = K.sums_by_row(part.row_of_word(), hit.astype(np.int64), part.rows)
                for r in np.flatnonzero(n_hit):
                    if 20 * n_hit[r] >= part.n_words[r]:
                        keep[part.low + r] = False
                    else:
                        texts[part.low + r] = _cut(part, hit, r, source[part.low + int(r)].as_py())
                        changed = True
            columns = list(batch.columns)
            if changed:
                columns[text_at] = pa.array(texts, batch.schema[text_at].type)
                if chars_at is not None:
                    columns[chars_at] = pc.utf8_length(columns[text_at]).cast(batch.schema[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows; hit spans of the others are cut out of ``text`` (and ``n_chars`` follows).

    Defined as in :func:`contamination`; all columns and the order of columns stay.
    """
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(_clean(_window_set(benchmark, window), docs.columns.index("text"), chars), docs.schema)


def query(spark, sf_dir):
    from tessera.llm.workspace import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")
