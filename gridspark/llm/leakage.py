"""Evaluation passages inside training documents, by spaced-seed hashing.

Fixed masks select some of the words in a window and ignore the others. The words of every
test item and of every document are hashed under each mask; a hash that occurs on both sides
is a hit, also when words at ignored positions were changed. Around each hit the diagonal
(document position minus item position) is verified: the longest run of equal words and the
longest overlap that tolerates substitutions.

Test items of at most ``block_chars`` characters together are a broadcast of sorted hashes, looked
up while the documents are read, without a shuffle. More items are hashed where they lie: a bitmap
of fixed size (``BITMAP_BITS``) of their hashes is broadcast, document hashes that miss it are never
written, and the others are joined with those of the items; documents and items that met are
brought together once and verified along the diagonals found. Either way every document is read in
full and the result is the same.

Defined results: null and empty texts have no words; a repeated row gives the same row once;
items with equal texts are reported each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .tokens import WORD, WordHash, mix

#: Selected positions of a window. No span is over 13 words, so an exact run of 13 always hits.
MASKS = ((0, 1, 2, 4, 7, 8, 10), (0, 2, 3, 6, 7, 9, 12), (0, 1, 5, 6, 8, 11, 12))
MASKS_SPAN = 13
#: Words hashed at once, and bits of the bitmap of item hashes.
CHUNK_WORDS = 400_000
BITMAP_BITS = 1 << 26
OVERLAPS = "doc_id bigint, item_id int, exact_run int, overlap_words int, substitutions int, share double, doc_word int, item_word int"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def seeds(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose selected words are all known (id >= 0), and their hashes."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ok = ids[:n] >= 0
    for off in mask[1:]:
        ok &= ids[off : off + n] >= 0
    pos = np.flatnonzero(ok)
    h = np.zeros(len(pos), np.uint64)
    for off in mask:
        h = (h + ids[pos + off].astype(np.uint64) + np.uint64(1)) * _PRIME
        h ^= h >> np.uint64(29)
    return pos, mix(h)


class Index:
    """Hashes of a block of test items under every mask."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            self.items.append((item, np.array(ids, np.int64)))
        self.tables = []
        for mask in MASKS:
            h, at = [], []
            for k, (_, ids) in enumerate(self.items):
                pos, hs = seeds(ids, mask)
                h.append(hs)
                at.append(np.stack([np.full(len(pos), k), pos], 1))
            hs = np.concatenate(h) if h else np.empty(0, np.uint64)
            order = np.argsort(hs, kind="stable")
            self.tables.append((hs[order], (np.concatenate(at) if at else np.empty((0, 2), np.int64))[order]))

    def hits(self, ids: np.ndarray, starts: np.ndarray) -> set[tuple[int, int, int]]:
        """(document, item, diagonal) of every hash shared under some mask.

        ``ids`` holds several documents, ``starts`` their first positions; between two of them
        lie as many unknown words as the longest mask spans.
        """
        out: set[tuple[int, int, int]] = set()
        for mask, (table, at) in zip(MASKS, self.tables):
            pos, h = seeds(ids, mask)
            if not len(pos) or not len(table):
                continue
            a = np.searchsorted(table, h, "left")
            found = np.flatnonzero((a < len(table)) & (table[np.minimum(a, len(table) - 1)] == h))
            if not len(found):
                continue
            b = np.searchsorted(table, h[found], "right")
            doc = np.searchsorted(starts, pos[found], "right") - 1
            local = pos[found] - starts[doc]
            for d, p, x, y in zip(doc.tolist(), local.tolist(), a[found].tolist(), b.tolist()):
                out.update((d, k, p - q) for k, q in at[x:y].tolist())
        return out


def verify(doc: np.ndarray, item: np.ndarray, diagonal: int, gap: int) -> tuple[int, int, int, int, int]:
    """Longest exact run; longest overlap whose substitutions stand alone, its substitutions, and its place.

    In the tolerant overlap every changed word has at least ``gap`` equal words on both sides.
    """
    a, b = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = doc[a:b] == item[a - diagonal : b - diagonal]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0, 0, 0, a, a - diagonal
    exact = int((ends - starts).max())
    best = (0, 0, int(starts[0]))
    s, subs = int(starts[0]), 0
    for k in range(len(starts)):
        if k and (starts[k] - ends[k - 1] > 1 or ends[k - 1] - starts[k - 1] < gap or ends[k] - starts[k] < gap):
            s, subs = int(starts[k]), 0
        elif k:
            subs += 1
        best = max(best, (int(ends[k]) - s, -subs, s), key=lambda x: (x[0], x[1]))
    return exact, best[0], -best[1], a + best[2], a + best[2] - diagonal


def overlaps(index: Index, docs: list[tuple[int, np.ndarray]], least: int, gap: int) -> list[tuple]:
    """The best verified overlap of each document and item."""
    lengths = np.array([len(ids) + MASKS_SPAN for _, ids in docs], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    joined = np.full(int(lengths.sum()), -1, np.int64)
    for (_, ids), s in zip(docs, starts.tolist()):
        joined[s : s + len(ids)] = ids
    best: dict[tuple[int, int], tuple] = {}
    for d, k, diagonal in index.hits(joined, starts):
        (doc, ids), (item, own) = docs[d], index.items[k]
        got = verify(ids, own, diagonal, gap)
        key = (got[0], got[1], -got[3], -got[4])
        if max(got[0], got[1]) >= least and ((d, k) not in best or key > best[d, k][0]):
            best[d, k] = (key, (doc, item, got[0], got[1], got[2], got[1] / len(own), got[3], got[4]))
    return [row for _, row in best.values()]


_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int32()), ("exact_run", pa.int32()), ("overlap_words", pa.int32()), ("substitutions", pa.int32()),
    ("share", pa.float64()), ("doc_word", pa.int32()), ("item_word", pa.int32()),
])


def _hashed(words_: list[str], known: WordHash) -> np.ndarray:
    """64-bit hashes of words, as numbers that are never negative."""
    return (known.of(words_) >> np.uint64(1)).astype(np.int64) if words_ else np.empty(0, np.int64)


def _seed_rows(texts: DataFrame, bitmap=None) -> DataFrame:
    """``seed, key, pos`` of every position of the texts (key, text) under every mask that the bitmap knows."""
    schema = pa.schema([("seed", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        known = WordHash()
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _hashed(words(text), known)
                for k, mask in enumerate(MASKS):
                    pos, h = seeds(ids, mask)
                    h = mix(h + np.uint64(k))  # hashes of different masks never meet
                    if bitmap is not None and len(h):
                        at = h & np.uint64(BITMAP_BITS - 1)
                        hit = (bitmap.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                        pos, h = pos[hit], h[hit]
                    found.append((h.view(np.int64), np.full(len(h), key, np.int64), pos.astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=schema)

    return texts.select("key", "text").mapInArrow(run, "seed bigint, key bigint, pos int")


def _by_join(documents: DataFrame, items: DataFrame, least: int, gap: int) -> DataFrame:
    """The same result by a join of hashes, for any number of items."""
    docs = spread(documents.select("doc_id", "text").filter("text is not null")).withColumn("key", F.xxhash64("doc_id", "text"))
    tests = items.select("item_id", "text").filter("text is not null").distinct().withColumn("key", F.xxhash64("item_id", "text"))
    theirs = _seed_rows(tests)
    low = F.col("seed").bitwiseAND(BITMAP_BITS - 1)
    # at most BITMAP_BITS / 64 rows, whatever the items
    held = theirs.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(seed & 63 AS INT))")).alias("bits")).toPandas()
    bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
    bitmap[held["w"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    ours = _seed_rows(docs, documents.sparkSession.sparkContext.broadcast(bitmap))
    met = (
        ours.join(theirs.withColumnsRenamed({"key": "item_key", "pos": "item_pos"}), "seed")
        .groupBy("key", "item_key").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("diagonals"))
        .join(docs.select("key", "doc_id", F.col("text").alias("doc_text")).distinct(), "key")
        .join(tests.select(F.col("key").alias("item_key"), "item_id", F.col("text").alias("item_text")), "item_key")
    )

    def check(batches):
        known = WordHash()
        for batch in batches:
            rows = []
            for doc, item, doc_text, item_text, diagonals in zip(*(batch.column(k).to_pylist() for k in range(5))):
                ids, own = _hashed(words(doc_text), known), _hashed(words(item_text), known)
                best = None
                for diagonal in sorted(diagonals):
                    got = verify(ids, own, diagonal, gap)
                    if max(got[0], got[1]) >= least and (best is None or (got[0], got[1], -got[3], -got[4]) > (best[0], best[1], -best[3], -best[4])):
                        best = got
                if best:
                    rows.append((doc, item, best[0], best[1], best[2], best[1] / len(own), best[3], best[4]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    return met.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("item_id").cast("int").alias("item_id"), "doc_text", "item_text", "diagonals").mapInArrow(check, OVERLAPS).dropDuplicates()


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 13, gap: int = 4, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and item that share an overlap of at least ``least`` words.

    ``exact_run`` is the longest run of equal words, ``overlap_words`` the longest overlap with
    single substitutions, ``share`` that overlap over the words of the item.
    """
    spark = documents.sparkSession
    size = items.select("item_id", "text").distinct().agg(F.sum(F.length("text"))).first()[0]
    if not size:
        return spark.createDataFrame([], OVERLAPS)
    if size > block_chars:
        return _by_join(documents, items, least, gap)
    texts = spread(documents.select("doc_id", "text").filter("text is not null"))

    def scan(index):
        def run(batches):
            own = index.value
            get = own.vocabulary.get
            for batch in batches:
                rows, held, n = [], [], 0
                todo = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                for place, (doc, text) in enumerate(todo):
                    ws = words(text)
                    held.append((doc, np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))))
                    n += len(ws)
                    if n > CHUNK_WORDS or place + 1 == len(todo):
                        rows += overlaps(own, held, least, gap)
                        held, n = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

        return run

    block = [(r.item_id, r.text) for r in items.select("item_id", "text").dropDuplicates().collect()]  # no more than block_chars
    return texts.mapInArrow(scan(spark.sparkContext.broadcast(Index(block))), OVERLAPS).dropDuplicates()
