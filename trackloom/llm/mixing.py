"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are added up by membership pattern (the set of sources they belong to).
A flow routes the words of each pattern to the quotas of its sources; a pattern's
first pass is free, each further pass costs one more (convex repetition costs), so
nothing is repeated while unused words can serve. Then seeded documents are chosen
in each pattern until its flow is used up.

The driver holds one row per pattern and per source. Their number is that of the
sources named in the data, not of the documents; beyond ``MAX_PATTERNS`` the
operator stops with an error instead of guessing.

Targets: sources in code-point order, null last, have the given weights in turn. All
targets together are ``share`` of all words; a target stops at ``passes`` times the
words of its source, and the excess is shared out again by weight.

Cases: a null text has size 0 and takes 0; a null source is a source of its own; an
empty table gives an empty result; repeated rows are separate documents.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.sources.tables import materialize

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
PASSES = 2
SEED = "mix"
BUCKET_DIGITS = 3
MAX_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights=WEIGHTS, share=SHARE, passes=PASSES) -> dict:
    """Exact target words of every source, as fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, free, out = Fraction(share) * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > passes * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = Fraction(passes * sizes[s])
            left -= out[s]
        free -= full
    return out


class Flow:
    """A small min-cost max-flow network: cheapest augmenting paths."""

    def __init__(self):
        self.out: dict = {}
        self.arcs: list[list] = []  # [head, free capacity, cost]; arc i and i ^ 1 are reverse

    def add(self, tail, head, capacity: int, cost: int) -> int:
        for node, other, free, price in ((tail, head, capacity, cost), (head, tail, 0, -cost)):
            self.out.setdefault(node, []).append(len(self.arcs))
            self.arcs.append([other, free, price])
        return len(self.arcs) - 2

    def run(self, start, end) -> None:
        while True:
            cost, via, queue, queued = {start: 0}, {}, deque([start]), {start}
            while queue:
                node = queue.popleft()
                queued.discard(node)
                for i in self.out.get(node, ()):
                    head, free, price = self.arcs[i]
                    if free and cost[node] + price < cost.get(head, 1 << 60):
                        cost[head], via[head] = cost[node] + price, i
                        if head not in queued:
                            queued.add(head)
                            queue.append(head)
            if end not in via:
                return
            path, node = [], end
            while node != start:
                path.append(via[node])
                node = self.arcs[via[node] ^ 1][0]
            amount = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= amount
                self.arcs[i ^ 1][1] += amount


def route(patterns: dict[tuple, int], quotas: dict, passes: int = PASSES) -> dict[tuple, int]:
    """Words to take of each pattern: patterns {sources: words}, quotas {source: words}."""
    net, arcs = Flow(), {}
    for pattern, words in patterns.items():
        arcs[pattern] = [net.add("start", ("p", pattern), words, r) for r in range(passes)]
        for source in pattern:
            net.add(("p", pattern), ("s", source), passes * words, 0)
    for source, quota in quotas.items():
        net.add(("s", source), "end", quota, 0)
    net.run("start", "end")
    return {p: sum(net.arcs[i ^ 1][1] for i in own) for p, own in arcs.items()}


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share=SHARE,
    passes: int = PASSES,
    seed: str = SEED,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    ``source_col`` holds a source or an array of sources; a document of several
    sources counts in full for the ``source_size`` of each, and its ``target`` and
    ``source_size`` are those of all its sources together. ``taken`` counts whole
    passes plus the document's part of the last one; the document at the end of a
    pattern's flow gives just the words still missing.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[source_col]
    member = df[source_col] if kind.startswith("array") else F.array(df[source_col].cast("string"))
    rows = materialize(
        df.select(
            df[id_col].alias("doc_id"),
            F.coalesce(F.regexp_count(df[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.coalesce(F.array_sort(F.array_distinct(member)), F.array(F.lit(None).cast("string"))).alias("sources"),
            F.md5(F.concat_ws(":", F.lit(seed), df[id_col].cast("string")).cast("binary")).alias("draw"),
        )
    )
    words: dict[tuple, int] = {}
    found = rows.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    for r in found:
        words[tuple(r["sources"])] = r["size"]
    sizes: dict = {}
    for pattern, n in words.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, share, passes)
    flow = route(words, {s: int(g + Fraction(1, 2)) for s, g in goal.items()}, passes)
    plan = spark.createDataFrame(
        [
            (list(p), sum(sizes[s] for s in p), float(sum(goal[s] for s in p)), flow[p] // n if n else 0, flow[p] % n if n else 0)
            for p, n in words.items()
        ],
        "sources array<string>, source_size long, target double, whole long, rest long",
    )
    # The seeded order is cut into buckets of the draw, so that no window holds a whole source.
    rows = rows.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    sums = rows.groupBy("sources", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("sources").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    inside = Window.partitionBy("sources", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = (
        rows.join(sums, ["sources", "bucket"])
        .withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        # One row per pattern, at most MAX_PATTERNS.
        .join(F.broadcast(plan), "sources")
    )
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    return placed.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + last).alias("taken")
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``df`` with every document as often as the mix takes it, in all its columns.

    A document taken in part counts as taken if that part is at least its half;
    documents without words stay once.
    """
    taken = mix(df, id_col, text_col, source_col, **options)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    picks = taken.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), copies.alias("__copies"))
    # Repeated ids: rows of one id and size are interchangeable, so their copies are averaged out by rank.
    rank = Window.partitionBy("__id", "__size").orderBy(F.desc("__copies"))
    picks = picks.withColumn("__rank", F.row_number().over(rank))
    size = F.coalesce(F.regexp_count(df[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = df.withColumn("__id", df[id_col]).withColumn("__size", size)
    same = Window.partitionBy("__id", "__size").orderBy(F.xxhash64(F.col(text_col)))
    rows = rows.withColumn("__rank", F.row_number().over(same))
    on = (
        rows["__id"].eqNullSafe(picks["__id"])
        & (rows["__size"] == picks["__size"])
        & (rows["__rank"] == picks["__rank"])
    )
    joined = rows.join(picks, on).where("__copies > 0")
    return joined.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(
        *[rows[c] for c in df.columns]
    )
