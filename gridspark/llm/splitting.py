"""Cut oversized documents at natural boundaries, with a fixed overlap.

Agglomerative merging: a document starts as atomic segments (sentences and lines; where one
of them is itself too large, clauses, then white space, then single tokens). All adjacent pairs wait
in a heap; the pair across the weakest boundary is merged first, smaller pairs before larger
ones, as long as the merged piece plus the overlap it will repeat stays under the limit.

One row per piece. Documents at or under the limit give no rows; null and empty texts have no
tokens; repeated rows give repeated work but distinct results; other columns are ignored. A
document is one task's row; its cost is O(n log n) in its length.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .tokens import TOKEN

PIECES = (
    "doc_id bigint, piece int, n_pieces int, first_token int, n_tokens int, overlap_tokens int, "
    "first_char int, boundary string, text string"
)

#: Boundary strengths, weakest to strongest.
LEVELS = ("token", "space", "clause", "sentence", "line", "claim", "paragraph")
_GAP_END = re.compile(r"[.!?。！？…][\"'»”’)\]]*$")
_CLAUSE_END = re.compile(r"[;:,，；：、][\"'»”’)\]]*$")
_CLAIM_START = re.compile(r"\s*(?:\[?\d{1,3}[.)\]]|(?:claim|anspruch|revendication|reivindicaci\w+)\s+\d+)", re.I)


def boundary(before: str, gap: str, after: str) -> int:
    """Strength of the place between two tokens: the text before, the white space, the text after."""
    lines = gap.count("\n") + gap.count("\r") - gap.count("\r\n")
    if lines >= 2:
        return 6
    if lines == 1:
        return 5 if _CLAIM_START.match(after) else 4
    if _GAP_END.search(before) and (gap or before[-1:] in "。！？"):
        return 3
    if _CLAUSE_END.search(before):
        return 2
    return 1 if gap else 0


def cut_points(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Token spans (char start, end), first tokens of the pieces, and the strength of each piece's start."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return spans, [0] if n else [], [len(LEVELS)] * bool(n)
    room = limit - overlap
    strength = [len(LEVELS)] + [
        boundary(text[max(0, a - 8) : a], text[a:b], text[b : b + 24])
        for (_, a), (b, _) in zip(spans, spans[1:])
    ]
    starts = _atoms(strength, n, room)
    ends = starts[1:] + [n]
    before = list(range(-1, len(starts) - 1))
    after = list(range(1, len(starts) + 1))
    alive = [True] * len(starts)
    size = lambda i, j: ends[j] - starts[i] + (overlap if i else 0)
    heap = [(strength[starts[j]], ends[j] - starts[j - 1], j - 1, j) for j in range(1, len(starts))]
    heapq.heapify(heap)
    while heap:
        s, total, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or total != ends[j] - starts[i]:
            continue
        if size(i, j) > limit:
            continue
        ends[i], alive[j] = ends[j], False
        after[i] = after[j]
        if after[i] < len(starts):
            before[after[i]] = i
            heapq.heappush(heap, (strength[starts[after[i]]], ends[after[i]] - starts[i], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strength[starts[i]], ends[i] - starts[before[i]], before[i], i))
    firsts = [starts[i] for i in range(len(starts)) if alive[i]]
    return spans, firsts, [strength[f] for f in firsts]


def _atoms(strength: list[int], n: int, room: int) -> list[int]:
    """First tokens of the atomic segments, none of them over ``room`` tokens."""
    out: list[int] = []
    todo = [(0, n, 3)]
    while todo:  # depth is bounded by the number of levels
        a, b, level = todo.pop()
        if b - a <= room and level < 3:
            out.append(a)
            continue
        cuts = [a] + [t for t in range(a + 1, b) if strength[t] >= level]
        for x, y in zip(cuts, cuts[1:] + [b]):
            if y - x <= room:
                out.append(x)
            elif level > 0:
                todo.append((x, y, level - 1))
            else:
                out.extend(range(x, y, max(1, room // 4)))
    return sorted(out)


def pieces_of(doc_id: int | None, text: str | None, limit: int, overlap: int) -> Iterator[tuple]:
    """The rows of one document."""
    if text is None or len(text) <= limit:
        return
    spans, firsts, strengths = cut_points(text, limit, overlap)
    if len(spans) <= limit:
        return
    for k, f in enumerate(firsts):
        end = firsts[k + 1] if k + 1 < len(firsts) else len(spans)
        back = min(overlap, f)
        a = 0 if k == 0 else spans[f - back][0]
        b = len(text) if k + 1 == len(firsts) else spans[end][0]
        yield doc_id, k, len(firsts), f - back, end - f + back, back, a, LEVELS[strengths[k]] if k else "start", text[a:b]


def split_documents(documents: DataFrame, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """The pieces of every document of more than ``limit`` tokens. No shuffle.

    ``0 <= overlap < limit``. Texts of at most ``limit`` characters have no more tokens than
    that and are left out by the scan.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("first_token", pa.int32()), ("n_tokens", pa.int32()),
        ("overlap_tokens", pa.int32()), ("first_char", pa.int32()), ("boundary", pa.string()), ("text", pa.string()),
    ])

    def run(batches):
        for batch in batches:
            rows = [r for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in pieces_of(d, t, limit, overlap)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spread(documents.select("doc_id", "text").filter(F.length("text") > limit)).mapInArrow(run, PIECES)
