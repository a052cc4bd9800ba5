"""Near-duplicate groups around many roots: nothing is lost, no list is joined with itself at length."""

import random

import pytest

from trackloom.llm import near_dedup


def brute(rows, n, percent=80):
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[:p]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("short,block", [(8, 2048), (2, 40)])
def test_group_around_many_roots(spark, monkeypatch, short, block):
    """500 texts of one family, most of them farther than the limit from most others."""
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rnd.choice([0, 3, 6, 9, 12])):
            words[rnd.randrange(120)] = f"x{rnd.randrange(40)}"
        rows.append((1000 + (i * 7919) % 5003, " ".join(words)))
    got = near_dedup.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 2)


def test_rows_of_one_id_are_dropped_by_their_text(spark):
    one, two = ("red green blue black white pink grey brown", "one two three four five six seven eight")
    df = spark.createDataFrame([(3, one, "a"), (5, one, "b"), (5, two, "c"), (7, two + " nine", "d")],
                               "doc_id long, text string, text_hash string")
    kept = near_dedup.near_dedup(df, percent=70)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text_hash) for r in kept.collect()) == [(3, "a"), (5, "c")]
