"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes its set of word shingles; texts of equal sets become one class,
   represented by the smallest id, and only representatives go on.
2. Each class is posted under every (coordinate, value) pair of its signature. The
   posting lists are only counted and reduced to their length and their smallest and
   largest member, so a list of any length costs each task one row.
3. Skip merging: the smallest and the largest member that a class meets most often are
   its hubs. Linked to a hub (confirmed on full sets), classes form first components; a
   large group of copies is then one component without any pair list. Classes of one
   smallest hub that are not linked to it are counted against the hub's group in blocks
   of bounded size, by inverted lists of full sets; only links that join two components
   leave the block.
4. Prefix merging: with ``match`` collisions of ``coordinates`` asked for, two classes
   must share one of the ``coordinates - match + 1`` rarest pairs of either. Only these
   lists are read on, split by set size so that sizes too far apart never meet, and only
   lists that meet several components. Collisions are counted inside blocks of a list;
   of the pairs with enough of them, between different components and hubs, a block hands
   on a spanning forest, at most one pair for each of its members.
5. Classes connected by such pairs form groups, so every pair with enough collisions lies in
   one. Groups are compared on full sets in blocks as in step 3, and the components are closed.

A pair at the similarity limit (0.8) misses ``match`` = 26 of 48 collisions with a
probability of about 1e-5; no other case is lost, and nothing is capped.

Cases: a null text, or one without words, has an empty set and is linked with
nothing. Rows with a null id are linked with nothing, have a null component and are
kept. Rows of one id and different texts are kept or dropped each for its own text, but
count as one node where no smaller id has either's set. An empty table gives an empty result. Other
columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.components import components
from trackloom.llm.shingles import mix, shingle_hashes, word_hashes
from trackloom.sources.tables import materialize

COORDINATES = 48
MATCH = 26
BLOCK = 2048
OUTER_BLOCK = 512
#: Lists of at most so many members are joined with themselves, a bounded number of rows for each member.
SHORT_LIST = 8
SEED = 5


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    seeds = rng.integers(0, 1 << 63, size=(2, n), dtype=np.uint64)
    return seeds[0], seeds[1] * np.uint64(2) + np.uint64(1)


def _distinct(shingles: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of each row."""
    sets = [np.unique(shingles[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else shingles[:0]), bounds


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _signer(size: int, coordinates: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds, factors = _seeds(coordinates)
        for batch in batches:
            for row, words, places in word_hashes(batch.column("text")):
                n = len(places) - 1
                values, bounds = _distinct(*shingle_hashes(words, places, size))
                full = np.flatnonzero(np.diff(bounds))
                signature = np.zeros((len(full), coordinates), dtype=np.uint64)
                if len(full):
                    for k in range(coordinates):
                        drawn = mix(values ^ adds[k]) if k == 0 else (values ^ adds[k]) * factors[k]
                        drawn ^= drawn >> np.uint64(29)
                        signature[:, k] = np.minimum.reduceat(drawn, bounds[full])
                lengths = np.zeros(n + 1, dtype=np.int32)
                lengths[full + 1] = coordinates
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n),
                        batch.column("text_hash").slice(row, n),
                        pa.array(np.diff(bounds)),
                        pa.array(_row_sums(mix(values), bounds).view(np.int64)),
                        pa.array(_row_sums(mix(values * np.uint64(3) + np.uint64(1)), bounds).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(signature.reshape(-1).view(np.int64))
                        ),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "signature"],
                )

    return sign


def _set_maker(size: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, places in word_hashes(batch.column("text")):
                values, bounds = _distinct(*shingle_hashes(words, places, size))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(places) - 1),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64))),
                    ],
                    ["doc_id", "shingles"],
                )

    return sets


def _sets(wanted: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """doc_id and full shingle set of the wanted classes (column doc_id).

    The wanted ids grow with the documents, so they are never broadcast: a call moves the
    texts once, by the same plan at every size.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    return materialize(
        texts.join(wanted.distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(
            _set_maker(size), f"doc_id {kind}, shingles array<long>"
        )
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
    )


def _slots(percent: int) -> Column:
    """Classes whose set sizes allow a link share one of their two slots of set size."""
    # A little wider than the limit, so that rounding cannot part two sizes exactly at it.
    place = F.floor(F.log("n_shingles") / math.log(100 / percent + 1e-6)) if percent < 100 else F.col("n_shingles")
    return F.array(place, place + 1)


def _hubs(posted: DataFrame, column: str, match: int) -> DataFrame:
    """(doc_id, hub): each class with the head of its lists (``least`` or ``most``) that it meets most often.

    A head counts only in the lists it heads; half of the asked collisions make it a hub.
    """
    met = (
        posted.where(F.col(column) != F.col("doc_id"))
        .groupBy("doc_id", column)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("doc_id")
        .agg(F.max(F.struct("n", F.col(column).alias("hub"))).alias("m"))
    )
    return met.where(F.col("m.n") * 2 >= match).select("doc_id", F.col("m.hub").alias("hub"))


def _pairs(hubs: DataFrame) -> DataFrame:
    return hubs.select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b")).distinct()


def _block_links(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the outer rows and all rows of a block that join different components."""
    own, outer = part[~part["outer"]], part[part["outer"]]
    ids, roots = own["doc_id"].to_numpy(), own["root"].to_numpy()
    lengths = own["shingles"].map(len).to_numpy()
    values = np.concatenate(list(own["shingles"])) if len(own) else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    holder = np.repeat(np.arange(len(own)), lengths)[order]
    values = values[order]
    joined: dict = {}

    def top(x):
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    out = []
    for doc_id, root, shingles in zip(outer["doc_id"], outer["root"], outer["shingles"], strict=True):
        if not len(own):
            break
        lo, hi = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
        lists = [holder[i:j] for i, j in zip(lo, hi, strict=True) if i < j]
        if not lists:
            continue
        both = np.bincount(np.concatenate(lists), minlength=len(own))
        near = 100 * both >= percent * (lengths + len(shingles) - both)
        for k in np.flatnonzero(near & (roots != root)):
            x, y = top(root), top(roots[k])
            if x != y:
                joined[max(x, y)] = min(x, y)
                out.append((max(doc_id, ids[k]), min(doc_id, ids[k])))
    return pd.DataFrame(out, columns=["a", "b"])


def _group_links(groups: DataFrame, sets: DataFrame, percent: int, least: int = 3) -> DataFrame:
    """(a, b) inside the groups (hub, doc_id, root, apart) of ``least`` rows or more: rows apart from their hub against all."""
    kind = groups.schema["doc_id"].dataType.simpleString()
    sizes = (
        groups.groupBy("hub")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("apart").cast("long")).alias("n_apart"))
        .where((F.col("n_apart") > 0) & (F.col("n") >= least))
    )
    draw = F.xxhash64("doc_id")
    rows = (
        groups.join(sizes, "hub")
        .withColumn("own_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("outer_blocks", F.ceil(F.col("n_apart") / OUTER_BLOCK).cast("int"))
        .join(sets, "doc_id")
    )
    whole = F.expr("sequence(0, outer_blocks - 1)")
    own = rows.select(
        "hub", F.pmod(draw, "own_blocks").cast("int").alias("i"), F.explode(whole).alias("j"), F.lit(False).alias("outer"),
        "doc_id", "root", "shingles",
    )
    outer = rows.where("apart").select(
        "hub", F.explode(F.expr("sequence(0, own_blocks - 1)")).alias("i"), F.pmod(draw, "outer_blocks").cast("int").alias("j"),
        F.lit(True).alias("outer"), "doc_id", "root", "shingles",
    )
    return own.union(outer).groupBy("hub", "i", "j").applyInPandas(
        lambda part: _block_links(part, percent), f"a {kind}, b {kind}"
    )


def _forest(part: pd.DataFrame, percent: int, match: int) -> pd.DataFrame:
    """A spanning forest of the pairs with ``match`` collisions among the rows of a block, or between its two parts."""
    part = part.sort_values("doc_id")
    ids, sizes = part["doc_id"].to_numpy(), part["n_shingles"].to_numpy()
    roots, hubs, sides = part["root"].to_numpy(), part["hub"].to_numpy(), part["side"].to_numpy()
    signatures = np.stack(list(part["signature"]))
    two = sides.min() != sides.max()
    tree = np.arange(len(ids))
    out = []
    for i in range(1, len(ids)):
        may = (roots[:i] != roots[i]) & (hubs[:i] != hubs[i]) & (tree[:i] != tree[i])
        may &= (100 * sizes[:i] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[:i])
        if two:
            may &= sides[:i] != sides[i]
        at = np.flatnonzero(may)
        at = at[(signatures[at] == signatures[i]).sum(axis=1) >= match]
        for k in at:
            if tree[k] != tree[i]:
                tree[tree == tree[i]] = tree[k]
                out.append((ids[i], ids[k]))
    return pd.DataFrame(out, columns=["a", "b"])


def _long_list_pairs(posts: DataFrame, sizes: DataFrame, percent: int, match: int) -> DataFrame:
    """(a, b) of the lists of more than ``SHORT_LIST`` members, in pairs of parts of about ``BLOCK`` members."""
    kind = posts.schema["doc_id"].dataType.simpleString()
    rows = (
        posts.join(sizes.where(F.col("members") > SHORT_LIST), ["value", "slot"])
        .withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("side", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    )
    return rows.groupBy("value", "slot", "i", "j").applyInPandas(
        lambda part: _forest(part, percent, match), f"a {kind}, b {kind}"
    )


def similar_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    match: int = MATCH,
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept.

    Texts with ``100 * |A & B| >= percent * |A | B|`` are linked; ``component_id`` is the
    smallest id reachable and ``kept`` says whether it is the row's own.
    """
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    return _row_components(docs, shingle, percent, coordinates, match).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def _row_components(docs: DataFrame, shingle: int, percent: int, coordinates: int, match: int) -> DataFrame:
    """The result of ``similar_components`` for (doc_id, text), with the hash of each row's text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(
        docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            _signer(shingle, coordinates),
            f"doc_id {kind}, text_hash long, n_shingles long, set_a long, set_b long, signature array<long>",
        )
    )
    key = ["n_shingles", "set_a", "set_b"]
    classes = materialize(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*key)
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    )
    # Every coordinate hashes with keys of its own, so its 64-bit value names the pair; a chance
    # equality of two coordinates only joins two lists.
    posts = classes.select(F.col("rep").alias("doc_id"), F.explode("signature").alias("value"))
    lists = (
        posts.groupBy("value")
        .agg(F.count(F.lit(1)).alias("length"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("length > 1")
    )
    posted = materialize(posts.join(lists, "value"))
    hubs = materialize(_hubs(posted, "least", match))
    pairs = materialize(_pairs(hubs.union(_hubs(posted, "most", match))))
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, shingle)
    linked = materialize(_confirmed(pairs, sets, percent))
    first = materialize(components(linked))
    roots = first.withColumnRenamed("node", "doc_id")
    heads = first.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    groups = (
        hubs.union(hubs.select("hub", "hub")).distinct()
        .join(roots, "doc_id", "left")
        .withColumn("root", F.coalesce("root", "doc_id"))
        .join(heads, "hub", "left")
        .withColumn("apart", F.col("root") != F.coalesce("hub_root", "hub"))
        .drop("hub_root")
    )
    grouped = materialize(_group_links(groups, sets, percent))

    # A pair alone in its list stands before all shared ones in the order of rarity.
    skip = coordinates - match + 1
    rarest = (
        posted.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("length", "value"))).alias("own"))
        .withColumn("room", F.lit(skip) - (F.lit(coordinates) - F.size("own")))
        .where("room > 0")
        .select("doc_id", F.explode(F.expr("slice(own, 1, room)")["value"]).alias("value"))
        .join(classes.select(F.col("rep").alias("doc_id"), "n_shingles"), "doc_id")
        .withColumn("slot", F.explode(_slots(percent)))
        .join(roots, "doc_id", "left")
        .join(hubs, "doc_id", "left")
        .withColumns({"root": F.coalesce("root", "doc_id"), "hub": F.coalesce("hub", "doc_id")})
    )
    rarest = materialize(rarest)
    mixed = (
        rarest.groupBy("value", "slot")
        .agg(
            F.count(F.lit(1)).alias("members"),
            *[f(c).alias(n + c) for c in ("root", "hub") for n, f in (("lo_", F.min), ("hi_", F.max))],
        )
        .where("lo_root < hi_root and lo_hub < hi_hub")
        .select("value", "slot", "members")
    )
    mixed = materialize(mixed)
    signatures = classes.select(F.col("rep").alias("doc_id"), "signature")
    open_posts = materialize(rarest.join(mixed.drop("members"), ["value", "slot"], "left_semi").join(signatures, "doc_id"))
    short = open_posts.join(mixed.where(F.col("members") <= SHORT_LIST), ["value", "slot"], "left_semi")
    names = ("doc_id", "n_shingles", "root", "hub", "signature")
    one, two = (short.select("value", "slot", *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab")
    collisions = F.expr("size(filter(zip_with(signature_a, signature_b, (x, y) -> x = y), x -> x))")
    near = (
        one.join(two, ["value", "slot"])
        .where(
            (F.col("doc_id_a") > F.col("doc_id_b"))
            & (F.col("root_a") != F.col("root_b"))
            & (F.col("hub_a") != F.col("hub_b"))
            & (100 * F.col("n_shingles_a") >= percent * F.col("n_shingles_b"))
            & (100 * F.col("n_shingles_b") >= percent * F.col("n_shingles_a"))
            & (collisions >= match)
        )
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
    )
    counted = components(near.union(_long_list_pairs(open_posts, mixed, percent, match)))
    members = materialize(counted.select(F.col("root").alias("hub"), F.explode(F.array("node", "root")).alias("doc_id")).distinct())
    last_groups = members.join(roots, "doc_id", "left").select(
        "hub", "doc_id", F.coalesce("root", "doc_id").alias("root"), F.lit(True).alias("apart")
    )
    more = _group_links(last_groups, _sets(members.select("doc_id"), docs, shingle), percent, 2)
    closed = components(linked.union(grouped).union(more))
    by_class = (
        classes.select(*key, "rep")
        .join(closed.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*key, F.coalesce("root", "rep").alias("component"))
    )
    result = signed.select("doc_id", "text_hash", *key).join(by_class, key, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return result.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def near_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    match: int = MATCH,
) -> DataFrame:
    """``df`` with one document of each component (the smallest id), in all its columns."""
    text = df[text_col].cast("string")
    docs = df.select(df[id_col].alias("doc_id"), text.alias("text"))
    gone = _row_components(docs, shingle, percent, coordinates, match).where("not kept").select(
        F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__text")
    )
    return df.join(gone, (df[id_col] == gone["__gone"]) & (F.xxhash64(text) == gone["__text"]), "left_anti")
