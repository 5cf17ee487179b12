"""Documents into containers of fixed capacity: a grouping genetic algorithm on islands.

An individual is a partition of the documents into containers; a population is founded by plain
best fit from several orders. Crossover injects well-filled containers of one parent whole into
the other, drops the containers that held any of their documents, and places the displaced
documents by best fit; mutation empties the worst-filled containers, and some others, into the
same pool. Best fit looks at sets: a container opened by the largest displaced document is
completed by the one, two or three others that leave least room. A container more or less decides
between two individuals, then the mean squared fill. Evolution ends early where the number of
containers has reached the least possible.

Documents are dealt by hash into blocks of bounded size; several islands evolve each block in
separate tasks, and after each epoch the elite of an island migrates to the next one around a
ring. The epochs are cut by checkpoints, so a lost executor costs one epoch of its islands. At
the end the worst-filled container of every block is dissolved, and the documents of those are
packed in blocks of ``MERGED`` containers, in the same way.

A document above the capacity is split: full containers first, its remainder is packed like a
document. No other document is split.

Defined results: rows that repeat ``doc_id`` and text count once; the same ``doc_id`` with two
texts is two documents; null and empty texts have size 0 and are placed like any other; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .tokens import TOKEN

#: Documents of a block on average, and containers merged at a time. A block is one task's unit; it never grows with the data.
BLOCK, MERGED = 5000, 256
#: Containers that a child takes from its second parent, worst-filled and random ones that it dissolves, and tries of sets of three.
INJECTED, WORST, RANDOM, TRIES = 12, 20, 10, 6


class Partition:
    """``genes``: the container of each document; ``fill`` of each container, with spare ones of fill 0 behind."""

    def __init__(self, genes: np.ndarray, fill: np.ndarray):
        self.genes, self.fill = genes, fill
        used = fill[fill > 0].astype(np.float64)
        self.score = (-len(used), float((used**2).sum()))

    @classmethod
    def of(cls, genes: np.ndarray, size: np.ndarray) -> Partition:
        fill = np.bincount(genes, size).astype(np.int64)
        return cls(genes.astype(np.int64), np.concatenate((fill, np.zeros(len(fill) // 8 + INJECTED + WORST + RANDOM + 8, np.int64))))


def best_fit(order: list[int], size: np.ndarray, capacity: int) -> np.ndarray:
    """Genes of placing the items in this order, each where least space is left."""
    open_: list[tuple[int, int]] = []
    genes, bins, sizes = np.empty(len(size), np.int64), 0, size.tolist()
    for i in order:
        k = bisect_left(open_, (sizes[i], -1))
        if k < len(open_):
            free, b = open_.pop(k)
        else:
            free, b, bins = capacity, bins, bins + 1
        genes[i] = b
        if free > sizes[i]:
            insort(open_, (free - sizes[i], b))
    return genes


def _best_pair(a: np.ndarray, free: int) -> tuple[int, list[int]]:
    """The largest sum of two of the ascending ``a`` that fits, and where they are; (-1, []) if none does."""
    first = np.arange(len(a))
    second = np.minimum(np.searchsorted(a, free - a, "right") - 1, first - 1)
    total = np.where(second >= 0, a + a[np.maximum(second, 0)], -1)
    total[total > free] = -1
    k = len(a) - 1 - int(total[::-1].argmax())
    return (int(total[k]), [k, int(second[k])]) if total[k] >= 0 else (-1, [])


def _completion(a: np.ndarray, free: int, rng: np.random.Generator) -> list[int]:
    """Which of the ascending sizes, the least of which fits, go into the free space next."""
    one = int(np.searchsorted(a, free, "right")) - 1
    if a[one] == free or len(a) == 1:
        return [one]
    total, take = _best_pair(a, free)
    if total == free:
        return take
    if total == int(a[-1]) + int(a[-2]):  # even the two largest leave room
        return [len(a) - 1]
    best, take = (total, take) if total >= a[one] else (int(a[one]), [one])
    top = int(np.searchsorted(a, free - 2 * int(a[0]), "right"))
    for x in rng.integers(0, top, TRIES).tolist() if top > 2 else ():
        total, pair = _best_pair(np.delete(a, x), free - int(a[x]))
        if pair and total + a[x] > best:
            best, take = total + int(a[x]), [x, *(k + (k >= x) for k in pair)]
            if best == free:
                break
    return take


def best_sets(items: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Containers for the items: the largest opens one, sets of those that leave least room complete it."""
    items = items[np.argsort(size[items], kind="stable")]
    a = size[items]
    out = []
    while len(a):
        free, own = capacity - int(a[-1]), [int(items[-1])]
        a, items = a[:-1], items[:-1]
        while len(a) and a[0] <= free:
            take = _completion(a, free, rng)
            free -= int(a[take].sum())
            own += items[take].tolist()
            a, items = np.delete(a, take), np.delete(items, take)
        out.append(own)
    return out


def child_of(a: Partition, b: Partition, size: np.ndarray, capacity: int, rng: np.random.Generator) -> Partition:
    """``a`` with some well-filled containers of ``b`` injected whole, and some of its own dissolved."""
    used = np.flatnonzero(a.fill > 0)
    good = np.flatnonzero(b.fill >= np.median(b.fill[b.fill > 0]))
    taken = rng.choice(good, min(len(good), 1 + int(rng.integers(INJECTED))), replace=False)
    chosen = np.zeros(len(b.fill), bool)
    chosen[taken] = True
    injected = np.flatnonzero(chosen[b.genes])
    gone = np.zeros(len(a.fill), bool)
    gone[a.genes[injected]] = True
    gone[used[np.argsort(a.fill[used], kind="stable")[:WORST]]] = True
    gone[rng.choice(used, RANDOM)] = True
    displaced = gone[a.genes]
    displaced[injected] = False
    genes, fill = a.genes.copy(), a.fill.copy()
    fill[gone] = 0
    new = best_sets(np.flatnonzero(displaced), size, capacity, rng)
    spare = np.flatnonzero(fill == 0)
    if len(spare) < len(taken) + len(new):
        fill = np.concatenate((fill, np.zeros(len(taken) + len(new), np.int64)))
        spare = np.flatnonzero(fill == 0)
    number = np.zeros(len(b.fill), np.int64)
    number[taken] = spare[: len(taken)]
    genes[injected] = number[b.genes[injected]]
    fill[spare[: len(taken)]] = b.fill[taken]
    for own, at in zip(new, spare[len(taken) :].tolist()):
        genes[own] = at
        fill[at] = size[own].sum()
    return Partition(genes, fill)


def least_bins(size: list[int], capacity: int) -> int:
    return max(1, -(-sum(size) // capacity)) if size else 0


def evolve(size: list[int], population: list[list[list[int]]], capacity: int, rng: np.random.Generator, people: int, generations: int) -> list[list[list[int]]]:
    """The next population, best first. An empty one is founded by best fit from several orders.

    Every generation has a quarter as many children as people; a child that is better replaces the worst.
    """
    real = [i for i, n in enumerate(size) if n > 0]
    empty = [i for i, n in enumerate(size) if n == 0]
    own = np.array([size[i] for i in real], np.int64)
    if not real:
        return [[empty]] if empty else [[]]
    place = {i: k for k, i in enumerate(real)}
    found = []
    for bins in population:
        genes = np.zeros(len(own), np.int64)
        for b, items in enumerate([x for x in ([place[i] for i in b if i in place] for b in bins) if x]):
            genes[items] = b
        found.append(Partition.of(genes, own))
    fall = np.argsort(-own, kind="stable")
    while len(found) < people:
        # founders differ in the items, drawn at random, that come first
        early = np.zeros(len(own), bool)
        early[rng.permutation(len(own))[: len(own) // 20 if found else 0]] = True
        found.append(Partition.of(best_fit([*fall[early[fall]].tolist(), *fall[~early[fall]].tolist()], own, capacity), own))
    found.sort(key=lambda p: p.score, reverse=True)
    least = least_bins(size, capacity)
    for _ in range(generations):
        for _ in range(max(1, people // 4)):
            if -found[0].score[0] <= least:
                break
            p, q = np.sort(rng.integers(0, len(found), (2, 2)), axis=1)[:, 0].tolist()  # of two drawn, the better one
            child = child_of(found[p], found[q], own, capacity, rng)
            if child.score > found[-1].score and all(child.score != x.score for x in found):
                found[-1] = child
                found.sort(key=lambda x: x.score, reverse=True)
    return [_as_bins(p, real, empty) for p in found]


def _as_bins(p: Partition, real: list[int], empty: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for k, b in enumerate(p.genes.tolist()):
        bins.setdefault(b, []).append(real[k])
    out = list(bins.values())
    out[0] += empty
    return out


def to_bins(genes: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(genes):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


def to_genes(bins: list[list[int]], n: int) -> list[int]:
    genes = np.empty(n, np.int32)
    for b, items in enumerate(bins):
        genes[items] = b
    return genes.tolist()


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> float:
    """Mean squared fill: of two partitions into as many bins, the more uneven one is better."""
    return sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def document_sizes(documents: DataFrame) -> DataFrame:
    """``doc_id, digest, n_tokens`` of every distinct document."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in batches:
            n = [len(TOKEN.findall(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], schema=schema)

    return spread(documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), "text"
    )).mapInArrow(run, "doc_id bigint, digest bigint, n_tokens bigint").distinct()


_STATE = pa.schema([
    ("block", pa.int32()), ("island", pa.int32()), ("sizes", pa.list_(pa.int64())),
    ("population", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int64()), ("least", pa.int64()), ("founded", pa.int64()), ("fit", pa.float64()),
])
_SHAPE = "block int, island int, sizes array<bigint>, population array<array<int>>, bins bigint, least bigint, founded bigint, fit double"


def _evolved(rest: DataFrame, capacity: int, islands: int, epochs: int, people: int, generations: int, seed: int, blocks: int) -> DataFrame:
    """``block, genes, bins, least, founded`` of the best individual of every block of ``rest`` (block, items)."""
    context = rest.sparkSession.sparkContext
    state = rest.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("items.n").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("bigint").alias("founded"),
    )

    def epoch(number):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    size = row["sizes"]
                    rng = np.random.default_rng([seed, number, row["block"], row["island"]])
                    people_ = [to_bins(g) for g in row["population"] or []]
                    if not people_:
                        people_ = evolve(size, [], capacity, rng, people, 0)
                        row["founded"] = len(people_[0])
                    out = evolve(size, people_, capacity, rng, people, generations)
                    yield pa.RecordBatch.from_pylist([{
                        "block": row["block"], "island": row["island"], "sizes": size, "population": [to_genes(b, len(size)) for b in out],
                        "bins": len(out[0]), "least": least_bins(size, capacity), "founded": row["founded"], "fit": fitness(out[0], size, capacity),
                    }], schema=_STATE)

        return run

    for number in range(epochs):
        # one island of one block is one row: as many tasks as the cluster has slots for
        slots = max(1, min(blocks * islands, context.defaultParallelism * 4))
        dealt = state.repartition(slots, F.pmod(F.col("block") * islands + F.col("island"), F.lit(slots)))
        evolved = cut(dealt.select("block", "island", "sizes", "population", "founded").mapInArrow(epoch(number), _SHAPE))
        open_ = evolved.groupBy("block").agg((F.min("bins") > F.max("least")).alias("open")).filter("open")
        if number + 1 == epochs or not open_.limit(1).count():
            break
        elite = evolved.select(
            "block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("population", 1, 1).alias("elite")
        )
        # the elite comes first, the worst one leaves
        state = evolved.join(elite, ["block", "island"]).withColumn("population", F.slice(F.array_distinct(F.concat("elite", "population")), 1, people))
    return evolved.groupBy("block").agg(
        F.max_by(F.element_at("population", 1), F.struct(-F.col("bins"), "fit", -F.col("island"))).alias("genes"),
        F.min("bins").alias("bins"), F.max("least").alias("least"), F.min("founded").alias("founded"),
    )


def pack_documents(
    documents: DataFrame, capacity: int = 2048, islands: int = 4, epochs: int = 4, people: int = 20, generations: int = 25, seed: int = 7, block: int = BLOCK
) -> DataFrame:
    """One row per document part: ``container, doc_id, part, first_token, n_tokens``."""
    sizes = cut(document_sizes(documents))
    blocks = max(1, -(-sizes.count() // block))
    placed = sizes.withColumn("block", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks)).cast("int"))
    item = F.struct((F.col("n_tokens") % capacity).alias("n"), "doc_id", "digest", "n_tokens")
    rest = placed.filter((F.col("n_tokens") % capacity > 0) | (F.col("n_tokens") == 0)).groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    args = (capacity, islands, epochs, people, generations, seed)
    packed = cut(_packed(rest, _evolved(rest, *args, blocks), "b"))
    if blocks > 1:
        fills = packed.groupBy("block", "container").agg(F.sum("item.n").alias("fill"))
        worst = fills.groupBy("block").agg(F.min_by("container", F.struct("fill", "container")).alias("container"))
        groups = -(-blocks // MERGED)
        again = (
            packed.join(worst, ["block", "container"], "left_semi").withColumn("block", F.pmod("block", F.lit(groups)).cast("int"))
            .groupBy("block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        )
        packed = packed.join(worst, ["block", "container"], "left_anti").unionByName(_packed(again, _evolved(again, *args, groups), "m"))
    packed = packed.select(
        "container", F.col("item.doc_id").alias("doc_id"), F.floor(F.col("item.n_tokens") / capacity).cast("int").alias("part"),
        (F.col("item.n_tokens") - F.col("item.n")).cast("int").alias("first_token"), F.col("item.n").cast("int").alias("n_tokens"),
    )
    full = placed.filter(F.col("n_tokens") >= capacity).select(
        "doc_id", "digest", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n_tokens") / capacity) - 1).cast("int"))).alias("part")
    ).select(
        F.concat_ws("-", F.lit("f"), F.hex("digest"), "doc_id", "part").alias("container"), "doc_id", "part",
        (F.col("part") * capacity).cast("int").alias("first_token"), F.lit(capacity).alias("n_tokens"),
    )
    return packed.unionByName(full)


def _packed(rest: DataFrame, best: DataFrame, mark: str) -> DataFrame:
    """``block, container, item`` of the best individuals."""
    return (
        best.join(rest, "block")
        .select("block", F.explode(F.arrays_zip(F.col("items").alias("item"), F.col("genes").alias("gene"))).alias("x"))
        .select("block", F.concat_ws("-", F.lit(mark), "block", "x.gene").alias("container"), F.col("x.item").alias("item"))
    )
