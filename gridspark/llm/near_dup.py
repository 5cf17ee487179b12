"""Near-duplicate texts: MinHash bands for candidates, odd sketches to judge them, an exact check to end.

Per distinct text (sequence of lower-case words) the shingle set is hashed and sampled by
``ROWS * BANDS`` MinHash functions. The samples are folded into a parity bitmap (an odd
sketch): every sample flips one bit, so equal samples cancel between two sketches and the
population count of their XOR estimates how many samples differ. Texts that agree on a band
become candidates only if the sketches say that they can reach the threshold; the remaining
pairs are checked on the shingle sets themselves, so the result is exact up to the recall of
the bands (at similarity 0.6: 1 - (1 - 0.6**3)**32 = 0.9996).

Copies of one text are collapsed before anything is paired, so a bucket holds distinct texts
only, and each of them carries no more than an id into it. The pairs of ids, once each, then meet
the two sketches, and what these rule out goes no further. Buckets that grow large are split over
tasks by the adaptive skew join, which needs no key of their own.

Defined results: rows without an id, null and empty texts and texts under ``least_words``
words are left out; repeated rows count once; equal texts under different ids have
similarity 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .tokens import PLAIN, WordHash, mix

ROWS, BANDS = 3, 32
SAMPLES = ROWS * BANDS
#: Bits of an odd sketch, as longs of 64.
SKETCH_LONGS = 8
SKETCH_BITS = 64 * SKETCH_LONGS
_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
SIGNED = "id bigint, digest bigint, bands array<bigint>, sketch array<bigint>"
#: Characters of the texts whose shingle sets a task keeps while it checks pairs.
KEPT_CHARS = 8_000_000


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix(h + hashes[k : k + n] + np.uint64(k + 1))
    return np.unique(h)


def samples(shingles: np.ndarray) -> np.ndarray:
    """One minimum per hash function."""
    out = np.full(SAMPLES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None] * _MULTIPLY + _ADD
        np.minimum(out, (x ^ (x >> np.uint64(31))).min(axis=0), out=out)
    return out


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """The parity bitmap of (function, minimum), as signed longs."""
    bit = mix(minima + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def most_differing_bits(threshold: float, sigmas: float = 4.5) -> int:
    """XOR population count that a pair at the threshold stays under, but for ``sigmas`` deviations."""
    differing = 2 * SAMPLES * (1 - threshold) + sigmas * 2 * np.sqrt(SAMPLES * threshold * (1 - threshold))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS)) + sigmas))


def sign(texts: DataFrame, width: int, least_words: int) -> DataFrame:
    """``texts`` (id, text) -> digest of the words, band keys and odd sketch."""
    schema = pa.schema([
        ("id", pa.int64()), ("digest", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())),
    ])

    def run(batches):
        hashed = WordHash()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = PLAIN.findall(text.lower())
                if len(ws) < max(least_words, width):
                    continue
                h = hashed.of(ws)
                shingles = shingle_hashes(h, width)
                minima = samples(shingles)
                digest = mix(np.cumsum(mix(h + np.arange(len(h), dtype=np.uint64)))[-1:] + np.uint64(len(h)))
                band = np.arange(BANDS, dtype=np.uint64)  # keys of different bands never meet
                for r in range(ROWS):
                    band = mix(band * np.uint64(31) + minima[r::ROWS] + np.uint64(r))
                rows.append((i, int(digest.view(np.int64)[0]), band.view(np.int64).tolist(), odd_sketch(minima).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spread(texts.filter("id is not null and text is not null")).mapInArrow(run, SIGNED)


def similar_representatives(light: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Exact ``a < b, similarity`` of the distinct texts at or over the threshold.

    ``light`` has the band keys and sketches of one text of each kind, ``texts`` (id, text) the texts
    of all: these move only to meet the pairs that passed, for texts are a third of their shingle
    sets in size.
    """
    keys = light.select("id", F.explode("bands").alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    met = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        .distinct()
    )
    differing = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH_LONGS)), F.lit(0))
    sketches = light.select("id", "sketch")
    pairs = (
        met.join(sketches.withColumnsRenamed({"id": "b", "sketch": "sketch_b"}), "b")
        .join(sketches.withColumnsRenamed({"id": "a", "sketch": "sketch_a"}), "a")
        .filter(differing <= most_differing_bits(threshold))
        .select("a", "b")
    )
    pairs = cut(pairs)  # two numbers a pair; read for the ids in it and for the pairs
    in_pairs = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = texts.join(in_pairs, "id", "left_semi")
    both = pairs.join(own.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").join(own.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        hashed = WordHash()
        kept: dict[str, np.ndarray] = {}
        size = 0

        def of(text: str) -> np.ndarray:
            nonlocal size
            if text not in kept:
                if size > KEPT_CHARS:
                    kept.clear()
                    size = 0
                size += len(text)
                kept[text] = shingle_hashes(hashed.of(PLAIN.findall(text.lower())), width)
            return kept[text]

        for batch in batches:
            out = []
            for x, y, p, q in zip(*(batch.column(k).to_pylist() for k in range(4))):
                p, q = of(p), of(q)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if not len(p) or not len(q):  # another text of the same id
                    continue
                # the threshold is compared in integers: no rounding at exactly 60 %
                if common * 10**6 >= round(threshold * 10**6) * (len(p) + len(q) - common):
                    out.append((x, y, common / (len(p) + len(q) - common)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double").distinct()


def _prepared(texts: DataFrame, width: int, least_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id -> representative, bands and sketches of the representatives, texts of all); the first two written once."""
    signed = cut(sign(texts.select("id", "text"), width, least_words))
    members = signed.select("id", "digest").distinct()
    heads = members.groupBy("digest").agg(F.min("id").alias("rep"))
    # by id, not by digest: a text with very many copies makes no hot key
    own = signed.select("id", "digest", "bands", "sketch").join(heads.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id", "digest"])
    return members.join(heads, "digest").select("id", "rep"), own, texts.select(F.col("id").cast("bigint").alias("id"), "text").filter("id is not null and text is not null")


def near_duplicate_links(texts: DataFrame, threshold: float = 0.8, width: int = 5, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, rep) and ``links`` between representatives (a, b, similarity)."""
    members, own, all_texts = _prepared(texts, width, least_words)
    return members, similar_representatives(own, all_texts, threshold, width)


def near_duplicate_pairs(texts: DataFrame, threshold: float = 0.8, width: int = 5, least_words: int = 0) -> DataFrame:
    """All pairs ``a < b`` of ids at or over the threshold, copies expanded."""
    members, links = near_duplicate_links(texts, threshold, width, least_words)
    members, links = cut(members), cut(links)
    x, y = members.withColumnsRenamed({"id": "x"}), members.withColumnsRenamed({"id": "y"})
    copies = x.join(y, "rep").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    across = (
        links.join(x.withColumnRenamed("rep", "a"), "a")
        .join(y.withColumnRenamed("rep", "b"), "b")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return copies.unionByName(across).filter("a <> b").distinct()


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.8, width: int = 5, least_words: int = 0, most_rounds: int = 50) -> DataFrame:
    """One row per text: ``id, group_id`` (least id of the connected group) and ``n_links``.

    ``n_links`` counts the similar distinct texts, ``n_copies`` the ids with the same words.
    """
    members, links = near_duplicate_links(texts, threshold, width, least_words)
    members, links = cut(members), cut(links.select("a", "b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(members.select(F.col("rep").alias("v")).distinct().withColumn("label", F.col("v")))
    for _ in range(most_rounds):
        # the least label of the neighbours, then a jump to the label of that label
        near = both.join(label.withColumnsRenamed({"v": "b", "label": "other"}), "b").groupBy(F.col("a").alias("v")).agg(F.min("other").alias("other"))
        new = label.join(near, "v", "left").select("v", "label", F.least("label", F.coalesce("other", "label")).alias("l1"))
        jump = new.select(F.col("v").alias("l1"), F.col("l1").alias("l2"))
        new = cut(new.join(jump, "l1", "left").select("v", F.col("label").alias("old"), F.least("l1", F.coalesce("l2", "l1")).alias("label")))
        changed = new.filter("old <> label").limit(1).count()
        label = new.select("v", "label")
        if not changed:
            break
    else:
        raise RuntimeError("the groups did not settle")
    degree = both.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("n_links"))
    copies = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    return (
        members.join(label.withColumnRenamed("v", "rep"), "rep")
        .join(degree.withColumnRenamed("v", "rep"), "rep", "left")
        .join(copies, "rep")
        .select("id", F.col("label").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    )
