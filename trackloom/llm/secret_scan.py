"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least 12 characters ``[A-Za-z0-9+/_=-]`` with a digit in it;
a word of minified JSON, CSV or a query string has as many as it has such runs. A run with
assignment signs inside gives its parts that are candidates by themselves, else the whole.
Its features are its length and character classes, the transitions between characters,
the share of its letters that dictionary words cover, its path, and the words next to
it. The dictionary is every letter run that at least ``DICTIONARY_COUNT`` places of the
corpus have. A random forest is fitted on labelled findings (``SAMPLE`` of them at most,
chosen by hash) and gives every candidate a score; ``secret`` is a score of 0.5 or more.

Everything runs as DataFrame expressions and joins; the forest is Spark's own.

``label_findings`` labels by the context of trusted forms: an assignment to a key word or
a provider's prefix is a secret, a run of digits only or a candidate after a word such as
``sha256`` or ``uuid`` is none; other candidates have no label.

Cases: a null text has no candidates; a null path is empty. Repeated rows give repeated
findings. If one of the two labels is missing, every score is the share of the other (0
or 1; without any label 0). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.sources.tables import materialize

LEAST = 12
SHAPE = r"[A-Za-z0-9+/_=-]{12,}"
# A name and an assignment sign at the end of what stands before a run.
ASSIGNED = r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)[\"'\\]*[=:]+>?[\"'\\]*$"
DICTIONARY_COUNT = 20
SAMPLE = 20_000
TREES = 20
DEPTH = 6
SEED = 1
PLACES = 32

# Words next to a candidate that speak for or against a secret.
KEY_WORDS = "token|secret|passw(?:or)?d|passwd|pwd|api_?key|apikey|auth|credential|private_?key|access_?key"
ID_WORDS = "sha1|sha256|sha512|md5|crc|commit|revision|checksum|digest|uuid|guid|isbn|doi|hash|id"
PREFIXES = "AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk_live_|AIza"


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, word, place, candidate, before, name, after: one row per candidate in a text.

    ``word`` is the place of its white-space word, ``place`` its own in that word, ``name``
    what it is assigned to: what stands before it in the word, at the start of the word or,
    after a lone ``=`` or ``:``, the word before.
    """
    words = F.split(F.coalesce(df[text_col].cast("string"), F.lit("")), r"\s+")
    rows = df.select(
        df[id_col].alias("doc_id"),
        F.coalesce(df[path_col].cast("string"), F.lit("")).alias("path"),
        words.alias("words"),
    )
    has = "length(w) >= {n} and w rlike '[0-9]' and w rlike '{shape}'".format(n=LEAST, shape=SHAPE)
    places = F.expr(f"filter(transform(words, (w, i) -> if({has}, i, null)), i -> i is not null)")
    around = F.expr(
        "transform(places, i -> struct(cast(i as bigint) as word, words[i] as own, coalesce(get(words, i - 1), '') as one, "
        "coalesce(get(words, i - 2), '') as two, lower(coalesce(get(words, i + 1), '')) as after))"
    )
    one = rows.withColumn("places", places).select("doc_id", "path", F.explode(around).alias("w")).select("doc_id", "path", "w.*")
    one = one.select(
        "*",
        F.regexp_extract_all("own", F.lit(f"({SHAPE})"), F.lit(1)).alias("runs"),
        F.split("own", SHAPE, -1).alias("between"),
        F.regexp_extract("own", r"^([A-Za-z_]+)[=:]", 1).alias("first"),
    )
    empty = F.lit("")
    lead = F.transform(
        "runs", lambda _, k: F.concat(F.coalesce(F.get("runs", k - 1), empty), F.get("between", k))
    )

    def of_run(run, k):
        parts = F.split(run, "=+(?=[^=])")
        own = F.regexp_extract(F.get("leads", k), ASSIGNED, 1)
        both = F.transform(parts, lambda p, j: F.struct(p.alias("candidate"), F.coalesce(F.get(parts, j - 1), own).alias("own_name")))
        good = F.filter(both, lambda x: (F.length(x["candidate"]) >= LEAST) & x["candidate"].rlike("[0-9]"))
        whole = F.array(F.struct(run.alias("candidate"), own.alias("own_name")))
        return F.when(~run.rlike("[0-9]"), F.filter(whole, lambda x: F.lit(False))).when(F.size(good) > 0, good).otherwise(whole)

    found = one.withColumn("leads", lead).select(
        "doc_id", "path", "word", "one", "two", "after", "first", F.posexplode(F.flatten(F.transform("runs", of_run))).alias("place", "found")
    )
    sign = F.col("one").isin("=", ":", ":=", "=>")
    name = F.when(F.col("found.own_name") != "", F.col("found.own_name")).when(F.col("first") != "", F.col("first")).when(sign, F.col("two"))
    name = F.coalesce(name, F.when(F.col("one").rlike("[=:]$"), F.regexp_replace("one", "[=:]+$", "")), empty)
    return found.select(
        "doc_id", "path", "word", F.col("place").cast("long").alias("place"), "found.candidate",
        F.lower("one").alias("before"), F.lower(name).alias("name"), "after",
    )


def dictionary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Letter runs of three and more letters that are frequent in the whole corpus: (run)."""
    runs = F.expr(f"regexp_extract_all(lower(`{text_col}`), '([\\\\p{{L}}]{{3,}})', 1)")
    return (
        df.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= DICTIONARY_COUNT).select("run")
    )


def _covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """(candidate, dictionary): the share of its characters in dictionary words, of each different candidate."""
    runs = F.expr("regexp_extract_all(lower(candidate), '([a-z]{3,})', 1)")
    pieces = found.select("candidate").distinct().select("candidate", F.explode(runs).alias("run"))
    return (
        pieces.join(words, "run")
        .groupBy("candidate")
        .agg((F.sum(F.length("run")) / F.length("candidate")).alias("dictionary"))
    )


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the numeric features ``f_*``."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    count = lambda pattern, text=c: F.regexp_count(text, F.lit(pattern)) / n
    near = F.concat_ws(" ", "before", "name")
    yes = lambda condition: condition.cast("double")
    shape = {
        "f_length": n,
        "f_digits": count("[0-9]"),
        "f_upper": count("[A-Z]"),
        "f_signs": count("[^A-Za-z0-9]"),
        "f_hex": yes(c.rlike("^[0-9a-f]+$")),
        "f_distinct": F.size(F.array_distinct(F.split(F.lower(c), ""))) / n,
        "f_letter_digit": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        "f_case": count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "f_vowels": count("(?<=[bcdfghjklmnpqrstvwxyz])(?=[aeiou])", F.lower(c)),
        "f_repeats": count(r"(.)(?=\1)"),
        "f_prefix": yes(c.rlike(f"^(?:{PREFIXES})")),
        "f_path_test": yes(F.lower("path").rlike("test|example|sample|fixture|doc")),
        "f_path_depth": F.size(F.split("path", "/")).cast("double"),
        "f_path_place": F.pmod(F.xxhash64("path"), F.lit(PLACES)).cast("double"),
        "f_key_word": yes(near.rlike(rf"(?:^|[\s\"'_.-])(?:{KEY_WORDS})(?:$|[\s\"'_.:=-])")),
        "f_id_word": yes(near.rlike(rf"(?:^|[\s\"'_.-])(?:{ID_WORDS})(?:$|[\s\"'_.:=-])")),
        "f_named": yes(F.col("name") != ""),
        "f_prose": yes(F.col("before").rlike(r"^\p{L}+[.,]?$")) + yes(F.col("after").rlike(r"^\p{L}+[.,]?$")),
    }
    return (
        found.join(_covered(found, words), "candidate", "left")
        .withColumns(shape)
        .withColumn("f_dictionary", F.coalesce("dictionary", F.lit(0.0)))
        .drop("dictionary")
    )


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1.0 for a trusted secret, 0.0 for a trusted false positive; others are left out."""
    label = (
        F.when(F.col("candidate").rlike("^[0-9]+$"), 0.0)
        .when(F.col("f_prefix") == 1, 1.0)
        .when(F.col("f_id_word") == 1, 0.0)
        .when((F.col("f_key_word") == 1) & (F.col("f_named") == 1), 1.0)
    )
    return found.withColumn("label", label).where("label is not null")


def remove_false_positives(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """``found`` with ``score`` and ``secret``, by a forest fitted on ``labelled`` (features and ``label``)."""
    inputs = sorted(c for c in found.columns if c.startswith("f_"))
    rows = labelled.select("label", *inputs).withColumn("__draw", F.xxhash64("label", *inputs))
    # The sample is bounded by SAMPLE; the order by hash makes every run fit the same rows.
    sample = materialize(rows.orderBy("__draw").limit(SAMPLE)).coalesce(1).sortWithinPartitions("__draw", *inputs)
    share = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return found.withColumn("score", F.lit(float(next(iter(share), 0.0)))).withColumn("secret", F.col("score") >= 0.5)
    vector = VectorAssembler(inputCols=inputs, outputCol="__features")
    forest = RandomForestClassifier(
        featuresCol="__features", labelCol="label", predictionCol="__prediction", rawPredictionCol="__raw",
        probabilityCol="__probability", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
    ).fit(vector.transform(sample))
    scored = forest.transform(vector.transform(found))
    return scored.withColumn("score", F.round(vector_to_array("__probability")[1], 6)).withColumn(
        "secret", F.col("score") >= 0.5
    ).drop("__features", "__prediction", "__raw", "__probability")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, word, place, candidate, path, name, score, secret."""
    found = materialize(candidates(df, id_col, text_col, path_col))
    measured = materialize(features(found, dictionary(df, text_col)))
    scored = remove_false_positives(measured, label_findings(measured) if labelled is None else labelled)
    return scored.select("doc_id", "word", "place", "candidate", "path", "name", "score", "secret")
