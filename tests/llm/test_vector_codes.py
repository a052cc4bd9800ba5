"""Product codes against a plain Lloyd loop."""

import math
from collections import defaultdict

import numpy as np
import pytest

from trackloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, entry int, salt int, code string"


def plain(rows, parts, entries, rounds):
    """(id, code, error, label_error) of every kept row, by plain loops over integers."""
    kept = [
        (i, [math.floor(4096 * np.float64(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    books = [[r[1][p * w : (p + 1) * w] for r in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                x = v[p * w : (p + 1) * w]
                groups[near(x, books[p])[1]].append(x)
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    coded = []
    for i, v, label in kept:
        best = [near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    by_label = defaultdict(int)
    for *_, error, label in coded:
        by_label[label] += error
    return sorted((i is None, i or 0, c, e, by_label[x]) for i, c, e, x in coded), books


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def check(df, rows, **options):
    got = vector_codes.compress(df, **options).collect()
    want, books = plain(rows, options["parts"], options["entries"], options["rounds"])
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == want
    flat = np.array([c for book in books for entry in book for c in entry])
    assert {r.codebooks_sha256 for r in got} == {vector_codes.codebooks_hash(flat)}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    out = [(i, [float(x) for x in centres[i % 5] + 0.2 * rng.normal(size=8)], i % 3) for i in range(160)]
    out += [(7, out[7][1], 1), (7, out[7][1], 1), (None, out[9][1], None), (None, [0.0] * 8, None)]  # repeats, null ids
    out += [(500 + i, out[3][1], None) for i in range(60)]  # one vector holds a third of the rows
    return out


BAD = [
    (900, None, 1),
    (901, [1.0, None] * 4, 1),
    (902, [float("nan")] * 8, 1),
    (903, [float("inf")] + [0.0] * 7, None),
    (904, [], 2),
]


def test_equals_plain_loop(spark, rows):
    check(table(spark, rows + BAD).repartition(5), rows + BAD, parts=4, entries=6, rounds=4)


def test_salted_owners_and_partitions_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "MEMBERS", 10)
    for n in (1, 7):
        check(table(spark, rows).repartition(n), rows, parts=2, entries=16, rounds=6)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-32000, 32000, 8)], 0) for i in range(40)]
    check(table(spark, rows), rows, parts=4, entries=4, rounds=3)


def test_fewer_rows_than_entries_and_ties(spark):
    rows = [(2, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (3, [-0.5, 0.1], None)]
    check(table(spark, rows), rows, parts=2, entries=16, rounds=6)


def test_nothing_to_keep(spark):
    for rows in ([], BAD):
        out = vector_codes.compress(table(spark, rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_only_changed_members_move(spark, rows):
    """What a round writes are the parts whose entry changed, and those that never move are written once."""
    df = table(spark, rows)
    written = []
    settle = vector_codes._settle
    vector_codes._settle = lambda arrivals: written.append(settle(arrivals)) or written[-1]
    try:
        vector_codes.train(df, parts=4, entries=6, rounds=6)
    finally:
        vector_codes._settle = settle
    counts = [t.count() for t in written]
    assert counts[0] == 4 * len(rows) and sum(counts[1:]) < counts[0]
