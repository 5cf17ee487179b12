import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import leakage, packing, splitting
from gridspark.llm.tokens import TOKEN

from ..conftest import DATA


def _docs(spark, sf="sf0.01"):
    return spark.read.parquet(f"{DATA}/{sf}/documents.parquet")


def test_pieces_round_trip(spark):
    docs = {r.doc_id: r.text for r in _docs(spark).select("doc_id", "text").collect()}
    found = {}
    for r in splitting.split_documents(_docs(spark)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {d for d, t in docs.items() if t and len(TOKEN.findall(t)) > 1024}
    for d, pieces in found.items():
        pieces.sort(key=lambda r: r.piece)
        whole, tokens = "", TOKEN.findall(docs[d])
        for k, p in enumerate(pieces):
            own = TOKEN.findall(p.text)
            assert len(own) == p.n_tokens <= 1024
            assert own == tokens[p.first_token : p.first_token + p.n_tokens]
            assert p.overlap_tokens == (64 if k else 0)
            assert p.first_char <= len(whole) and docs[d].startswith(p.text, p.first_char)
            whole = whole[: p.first_char] + p.text
        assert whole == docs[d]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n!語;", max_size=400), st.integers(2, 30), st.integers(0, 12))
def test_cut_points_hold_the_limit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    rows = list(splitting.pieces_of(1, text, limit, overlap))
    n = len(TOKEN.findall(text))
    if n <= limit:
        assert not rows
        return
    assert all(r[4] <= limit for r in rows)
    firsts = [r[3] + r[5] for r in rows]
    assert firsts[0] == 0 and firsts == sorted(set(firsts)) and sum(r[4] - r[5] for r in rows) == n


def test_weakest_boundaries_are_merged_first():
    text = "\n\n".join(" ".join(f"w{k} x y z." for k in range(6)) for _ in range(4))
    _, firsts, strengths = splitting.cut_points(text, 40, 4)
    assert len(firsts) == 4 and strengths[1:] == [6, 6, 6]


def test_packing(spark):
    docs = _docs(spark)
    sizes = {r.doc_id: len(TOKEN.findall(r.text or "")) for r in docs.select("doc_id", "text").collect()}
    rows = packing.pack_documents(docs).collect()
    fill, parts = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(fill.values()) <= 2048 and set(parts) == set(sizes)
    for d, own in parts.items():
        own.sort()
        assert sum(n for _, n in own) == sizes[d]
        assert len(own) == 1 or sizes[d] > 2048 and all(n == 2048 for _, n in own[:-1])
    rest = [n % 2048 for n in sizes.values()]
    least = sum(n // 2048 for n in sizes.values()) + -(-sum(rest) // 2048)
    assert len(fill) == least  # no packing has fewer
    blocks = packing.pack_documents(docs, block=250).groupBy("container").sum("n_tokens").collect()
    assert len(blocks) <= least + 1 and sum(r[1] for r in blocks) == sum(sizes.values()) and max(r[1] for r in blocks) <= 2048


def test_evolution_beats_best_fit():
    import numpy as np

    rng = np.random.default_rng(4)
    size = np.clip(rng.lognormal(6, 0.6, 3000), 20, 2000).astype(int).tolist()
    founders = packing.evolve(size, [], 2048, np.random.default_rng(2), 20, 0)
    out = packing.evolve(size, founders, 2048, np.random.default_rng(3), 20, 25)
    least = packing.least_bins(size, 2048)
    assert len(out[0]) == least < len(founders[0])
    odd = [500, 700] * 40 + [0] * 5  # no set fills a container: nothing to gain, nothing lost
    out = packing.evolve(odd, [], 2048, np.random.default_rng(3), 20, 25)
    assert sorted(i for b in out[0] for i in b) == list(range(85)) and all(sum(odd[i] for i in b) <= 2048 for b in out[0])


def test_evolution_never_loses_an_item_and_never_gets_worse():
    import numpy as np

    rng = np.random.default_rng(1)
    size = rng.integers(0, 100, 300).tolist()
    first = packing.evolve(size, [], 128, np.random.default_rng(2), 4, 0)
    last = packing.evolve(size, first, 128, np.random.default_rng(3), 4, 30)
    for bins in first + last:
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(sum(size[i] for i in b) <= 128 for b in bins)
    assert len(last[0]) <= len(first[0])


def test_leaks_against_brute_force(spark):
    word = re.compile(r"[^\W_]+")
    runs = {}
    for r in spark.read.parquet(f"{DATA}/sf0.01/eval_items.parquet").collect():
        ws = word.findall(r.text.lower())
        for k in range(len(ws) - 12):
            runs.setdefault(tuple(ws[k : k + 13]), set()).add(r.item_id)
    want = set()
    for r in _docs(spark).collect():
        ws = word.findall((r.text or "").lower())
        for k in range(len(ws) - 12):
            want |= {(r.doc_id, i) for i in runs.get(tuple(ws[k : k + 13]), ())}
    items = spark.read.parquet(f"{DATA}/sf0.01/eval_items.parquet")
    for block in (4_000_000, 20_000):  # one block of items, and many
        got = leakage.leaked_passages(_docs(spark), items, block_chars=block).filter("exact_run >= 13")
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def test_overlap_tolerates_substitutions(spark):
    item = [f"w{k}" for k in range(40)]
    doc = list(item)
    doc[12] = doc[25] = "changed"
    docs = spark.createDataFrame([(1, "before " + " ".join(doc)), (2, " ".join(item[:9]))], "doc_id bigint, text string")
    rows = leakage.leaked_passages(docs, spark.createDataFrame([(7, " ".join(item))], "item_id int, text string")).collect()
    assert [(r.doc_id, r.item_id, r.exact_run, r.overlap_words, r.substitutions, r.doc_word) for r in rows] == [(1, 7, 14, 40, 2, 1)]


def test_join_of_hashes_gives_the_same(spark):
    items = spark.read.parquet(f"{DATA}/sf0.01/eval_items.parquet")
    docs = _docs(spark).unionByName(_docs(spark).limit(3))
    one, many = (sorted(map(tuple, leakage.leaked_passages(docs, items, block_chars=n).collect())) for n in (4_000_000, 1))
    assert one == many and one


def test_changed_words_do_not_hide_a_leak(spark):
    """Planted: 40 words of an item, of which one in five to twelve is another word."""
    items = spark.read.parquet(f"{DATA}/sf0.01/eval_items.parquet")
    rows, want = [], set()
    for k, r in enumerate(items.orderBy("item_id").collect()):
        ws = re.findall(r"[^\W_]+", r.text.lower())
        if len(ws) >= 40:
            step = 6 + k % 7
            own = [f"changed{k}" if (j + 1) % step == 0 else w for j, w in enumerate(ws[:40])]
            rows.append((k, " ".join([f"before{k}"] * 5 + own + [f"after{k}"] * 5)))
            want.add((k, r.item_id))
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert len(want) > 30 and len(want & got) >= 0.9 * len(want)
