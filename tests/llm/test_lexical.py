"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from trackloom.llm import lexical

DOCS = "doc_id long, text string, item_id int, score int, rank string, items string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(words(text))
                if c[t]
            )
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, top, parts=3, index=None):
    table = spark.createDataFrame([(*d, 1, 2, "r", "i") for d in docs], DOCS).repartition(parts)
    asked = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id long")
    return sorted((tuple(r) for r in lexical.search(table, asked, top, index=index).collect()), key=repr)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(4)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
    out = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 20, 80, 400])))) for i in range(400)]
    out += [(1000 + i, "Éa ÉA rare passage of five-word w1 w2") for i in range(90)]  # copies beyond the top
    out += [(7, out[7][1]), (7, out[8][1]), (None, out[9][1]), (None, None), (601, ""), (602, "-- !!")]
    out += [(700, "w1 " * 30_000 + "tail"), (701, "x" * 200_000)]
    return out


ITEMS = [
    (1, "rare passage, of FIVE word"), (2, "w1 w2 w3 w4 w1"), (3, "nothing@known"), (4, None), (5, " .. "), (2, "tail"),
    (6, "éa"), (7, " ".join(f"w{i}" for i in range(300))), (8, "x" * 200_000), (None, "w17"),
]


def test_equals_scoring_everything(spark, docs):
    for top in (1, 10, 50):
        assert run(spark, docs, ITEMS, top) == plain(docs, ITEMS, top)


def test_blocks_of_items_and_documents_change_nothing(spark, docs, monkeypatch):
    want = plain(docs, ITEMS, 10)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    monkeypatch.setattr(lexical, "ITEM_TERMS", 40)
    monkeypatch.setattr(lexical, "HELD_KEYS", 500)
    for parts in (1, 5):
        assert run(spark, docs, ITEMS, 10, parts) == want


def test_bounds_hold_and_exclude(spark, docs):
    """No bound is below its score, and most documents are excluded."""
    table = spark.createDataFrame(docs, "doc_id long, text string").where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [tuple(r) for r in table.collect()]
    blocks = lexical.build_index(table).collect()
    counted = {i: Counter(words(t)) for i, t in rows}
    df = Counter(t for c in counted.values() for t in c)
    n_docs, n_terms = sum(bool(c) for c in counted.values()), sum(c.total() for c in counted.values())
    import pyarrow as pa

    def codes(text):
        return next(lexical.term_counts(pa.array([text])))[0].view("int64").tolist()

    holders = {codes(t)[0]: n for t, n in df.items()}
    items = [codes(t) for _, t in ITEMS if words(t)]
    query = lexical._Query(items, holders, n_docs, n_terms)
    exact = {(r[0], r[2]): r[3] for r in plain(rows, [(k, t) for k, (_, t) in enumerate(x for x in ITEMS if words(x[1]))], 10**6)}
    reached = 0
    least = {k: sorted((s for (q, _), s in exact.items() if q == k), reverse=True)[:10] for k in range(len(items))}
    for b in blocks:
        import numpy as np

        bounds = lexical._bounds(query, np.array(b.lengths), b.width, bytes(b.slices))
        for k in range(len(items)):
            for j, doc in enumerate(b.doc_ids):
                assert bounds[k, j] >= exact.get((k, doc), 0)
                reached += len(least[k]) == 10 and bounds[k, j] >= least[k][-1]
    assert reached < 0.35 * len(items) * n_docs
    assert sum(len(b.doc_ids) for b in blocks) == n_docs


def test_levels():
    assert lexical.levels_up_to(30).tolist() == [*range(1, 9), 10, 12, 14, 16, 20, 24, 28, 32]


def test_empty_tables(spark, docs):
    assert run(spark, [], ITEMS, 10) == [] and run(spark, docs[:5], [], 10) == []
    assert run(spark, [(1, None), (2, "?")], ITEMS, 10) == []
