"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of 64 bytes, forwards and backwards; at every byte
both states give a probability of each language. A document's probabilities are the
means over all its bytes. Gates are hard sigmoids and candidate states softsigns, so
that whole slabs of windows are stepped with few cheap numpy operations.

It is trained in numpy by backpropagation through time (Adam) on a bounded sample:
``per_language`` documents of each language, chosen by the hash of the id, a stretch of
``STRETCH`` characters of each. The sample's size follows these parameters and the
number of languages, not the corpus. Prediction reads every byte of every text.

``known_language`` lets the network decide. It learns one class more, ``und``, from the
same stretches with their letters replaced: by random ones, by a permutation of the
alphabet, or by those of another script. A document goes if its mean probability of
``und`` is over a cut: 0.5, or more if over 5 % of the held-out documents of a language were
to go at 0.5. With less than ``LEAST_HELD`` held-out documents to hold it against, none
goes by the cut. The rest get the most probable language, whatever ``lang`` said.

Cases: ``und`` with score 0 for a text that is null or has no letter, and for all texts
if there is nothing to learn from. Rows with a null id are never learned from and are
not held out. Repeated rows get the same answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.shingles import text_buffers

WINDOW = 64
HIDDEN = 8
SLAB = 4096
PER_LANGUAGE = 256
STRETCH = 512
STEPS = 160
BATCH = 256
RATE = 0.02
SEED = 2
UNKNOWN = "und"
CUT = 0.5
HELD_SHARE = 0.95
LEAST_HELD = 20
_f = np.float32


@dataclass
class Model:
    """tables, recurrent weights and biases of both directions, and the output layer."""

    languages: list[str]
    table: list[np.ndarray]  # per direction (3 * hidden, 256): input weights and bias of each byte
    inner: list[np.ndarray]  # per direction (3 * hidden, hidden)
    out: np.ndarray  # (languages, 2 * hidden)
    bias: np.ndarray  # (languages,)
    cut: float = 1.0  # a document with a greater probability of UNKNOWN is of none of the languages


def _start(languages: list[str], hidden: int) -> Model:
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(_f)
    table = [draw(3 * hidden, 256), draw(3 * hidden, 256)]
    for t in table:
        t[: 2 * hidden] += _f(0.5)
    n = len(languages)
    return Model(languages, table, [draw(3 * hidden, hidden), draw(3 * hidden, hidden)], draw(n, 2 * hidden), np.zeros(n, _f))


def _forward(table: np.ndarray, inner: np.ndarray, data: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, hidden, windows) for bytes (steps, windows); ``keep`` collects what learning needs."""
    steps, width = data.shape
    hidden = inner.shape[1]
    states = np.empty((steps, hidden, width), _f)
    given, own = np.empty((3 * hidden, width), _f), np.empty((3 * hidden, width), _f)
    size = np.empty((hidden, width), _f)
    state = np.zeros((hidden, width), _f)
    for t in range(steps):
        np.take(table, data[t], axis=1, out=given, mode="clip")
        np.dot(inner, state, out=own)
        gates = given[: 2 * hidden]
        gates += own[: 2 * hidden]
        np.clip(gates, 0, 1, out=gates)
        cand = own[2 * hidden :]
        if keep is not None:
            keep.append((gates.copy(), cand.copy(), state))
        cand *= gates[hidden:]
        cand += given[2 * hidden :]
        np.abs(cand, out=size)
        size += 1
        cand /= size
        new = states[t]
        np.subtract(state, cand, out=new)
        new *= gates[:hidden]
        new += cand
        state = new
    return states


def _backward(table, inner, data, kept, states, error):
    """Gradients of table and inner from the errors at all states (steps, hidden, windows)."""
    hidden = inner.shape[1]
    by_table, by_inner = np.zeros_like(table), np.zeros_like(inner)
    carried = np.zeros_like(states[0])
    for t in range(len(data) - 1, -1, -1):
        gates, raw, before = kept[t]
        keep_gate, reset = gates[:hidden], gates[hidden:]
        # The candidate is x / (1 + |x|); its slope is (1 - |candidate|) ** 2.
        summed = np.take(table[2 * hidden :], data[t], axis=1) + reset * raw
        cand = summed / (1 + np.abs(summed))
        total = error[t] + carried
        to_cand = total * (1 - keep_gate) * np.square(1 - np.abs(cand))
        to_keep = total * (before - cand) * ((keep_gate > 0) & (keep_gate < 1))
        to_reset = to_cand * raw * ((reset > 0) & (reset < 1))
        to_own = np.concatenate([to_keep, to_reset, to_cand * reset])
        to_given = np.concatenate([to_keep, to_reset, to_cand])
        by_inner += to_own @ before.T
        seen = np.zeros((data.shape[1], 256), _f)
        seen[np.arange(data.shape[1]), data[t]] = 1
        by_table += to_given @ seen
        carried = total * keep_gate + inner.T @ to_own
    return by_table, by_inner


def _position_probabilities(model: Model, data: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(steps, languages, windows)."""
    hidden = model.inner[0].shape[1]
    score = np.matmul(model.out[:, :hidden], forward) + np.matmul(model.out[:, hidden:], backward)
    score += model.bias[:, None]
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=1, keepdims=True)
    return score


def train(texts: list[str], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN) -> Model | None:
    """Fit on windows of the texts; None without any text of a label."""
    languages = sorted(set(labels))
    windows, answers = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = text.encode()
        for at in range(0, len(raw), WINDOW):
            part = np.zeros(WINDOW, np.uint8)
            cut = np.frombuffer(raw[at : at + WINDOW], np.uint8)
            part[: len(cut)] = cut
            windows.append(part)
            answers.append(languages.index(label))
    if not windows:
        return None
    rng = np.random.default_rng(SEED)
    data, answer = np.array(windows), np.array(answers)
    # Every language is drawn as often, whatever it has in the sample.
    places = [np.flatnonzero(answer == k) for k in range(len(languages))]
    places = [p if len(p) else np.arange(len(data)) for p in places]
    model = _start(languages, hidden)
    weights = [*model.table, *model.inner, model.out, model.bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, -(-BATCH // len(languages))) for p in places])
        x, y = data[pick].T.astype(np.intp), answer[pick]
        solid = (x > 0).astype(_f)
        kept: list[list] = [[], []]
        ahead = _forward(model.table[0], model.inner[0], x, kept[0])
        behind = _forward(model.table[1], model.inner[1], x[::-1], kept[1])
        error = _position_probabilities(model, x, ahead, behind[::-1])
        error[:, y, np.arange(len(y))] -= 1
        error *= (solid / max(1.0, solid.sum()))[:, None, :]
        pieces = [np.matmul(model.out[:, :hidden].T, error), np.matmul(model.out[:, hidden:].T, error)[::-1]]
        first = _backward(model.table[0], model.inner[0], x, kept[0], ahead, pieces[0])
        second = _backward(model.table[1], model.inner[1], x[::-1], kept[1], behind, pieces[1])
        both = np.concatenate([ahead, behind[::-1]], axis=1)
        slopes = [first[0], second[0], first[1], second[1], np.einsum("tlw,thw->lh", error, both), error.sum(axis=(0, 2))]
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, (m, v) in zip(weights, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def document_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): mean position probabilities of the byte runs data[offsets[i]:offsets[i + 1]]."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    sums = np.zeros((int(firsts[-1]) + 1, len(model.languages)))
    padded = np.zeros(int(firsts[-1]) * WINDOW, np.uint8)
    lengths = np.full(int(firsts[-1]), WINDOW)
    for i, size in enumerate(sizes):
        if size:
            at = firsts[i] * WINDOW
            padded[at : at + size] = data[offsets[i] : offsets[i + 1]]
            lengths[firsts[i + 1] - 1] = (size - 1) % WINDOW + 1
    windows = padded.reshape(-1, WINDOW)
    for at in range(0, len(windows), SLAB):
        x = windows[at : at + SLAB].T.astype(np.intp)
        ahead = _forward(model.table[0], model.inner[0], x)
        behind = _forward(model.table[1], model.inner[1], x[::-1])[::-1]
        chance = _position_probabilities(model, x, ahead, behind)
        chance *= (np.arange(WINDOW)[:, None] < lengths[at : at + SLAB])[:, None, :]
        sums[at : at + x.shape[1]] = chance.sum(axis=0).T
    totals = np.add.reduceat(sums, np.minimum(firsts[:-1], len(windows)), axis=0) if len(sizes) else sums[:0]
    return totals / np.maximum(sizes, 1)[:, None]


def scrambled(texts: list[str]) -> list[str]:
    """The texts with other letters, in turn: random, permuted and of another script. They teach UNKNOWN."""
    rng = np.random.default_rng(SEED)
    latin = np.array([chr(c) for c in range(ord("a"), ord("z") + 1)])
    out = []
    for i, text in enumerate(texts):
        if i % 3 == 1:
            other = dict(zip(latin, rng.permutation(latin), strict=True))
            out.append("".join(other.get(c, c) for c in text.lower()))
            continue
        letters = latin
        while i % 3 == 2 and letters is latin:
            start, width = int(rng.integers(0x370, 0xD700)), int(rng.integers(20, 400))
            script = [c for c in map(chr, range(start, start + width)) if c.isalpha()]
            letters = np.array(script) if len(script) > 10 else latin
        drawn = rng.choice(letters, len(text))
        out.append("".join((x.upper() if c.isupper() else x) if c.isalpha() else c for c, x in zip(text, drawn, strict=True)))
    return out


def train_with_unknown(texts: list[str], labels: list[str], held_texts: list[str], held_labels: list[str]) -> Model | None:
    """A model that also knows UNKNOWN, its cut held against the held-out texts."""
    model = train(texts + scrambled(texts), labels + [UNKNOWN] * len(texts))
    held = [t.encode() for t, label in zip(held_texts, held_labels, strict=True) if label != UNKNOWN and t]
    if model is not None and len(held) >= LEAST_HELD:
        offsets = np.cumsum([0, *map(len, held)])
        chance = document_probabilities(model, np.frombuffer(b"".join(held), np.uint8), offsets)
        model.cut = max(CUT, float(np.quantile(chance[:, model.languages.index(UNKNOWN)], HELD_SHARE)))
    return model


def _predictor(model: Model | None) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = text_buffers(batch.column("text"))
            rows = batch.num_rows
            best, score, odd = np.zeros(rows, int), np.zeros(rows), np.zeros(rows, bool)
            while model is not None and at < rows:
                to = int(np.searchsorted(offsets, offsets[at] + SLAB * WINDOW * 4, side="right")) - 1
                to = min(rows, max(at + 1, to))
                lo = offsets[at]
                chance = document_probabilities(model, data[lo : offsets[to]], offsets[at : to + 1] - lo)
                if UNKNOWN in model.languages:
                    unknown = chance[:, model.languages.index(UNKNOWN)]
                    odd[at:to] = unknown > model.cut
                    unknown[:] = 0
                best[at:to], score[at:to] = chance.argmax(axis=1), chance.max(axis=1)
                at = to
            names = np.array([*(model.languages if model else []), UNKNOWN], dtype=object)
            known = letters & ~odd & (model is not None)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in batch.schema.names if c not in ("text", "letters")),
                    pa.array(names[np.where(known, best, -1)], pa.string()),
                    pa.array(np.where(known, np.clip(np.round(score, 6), 0, 1), 0.0)),
                ],
                [*(c for c in batch.schema.names if c not in ("text", "letters")), "lang_pred", "score"],
            )

    return predict


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[list[str], list[str]]:
    """Stretches of at most ``per_language`` documents of each language."""
    draw = F.xxhash64(df[id_col])
    chosen = (
        df.where(df[lang_col].isNotNull() & df[id_col].isNotNull())
        .groupBy(df[lang_col].alias("__lang"), F.pmod(draw, F.lit(per_language)).alias("__place"))
        .agg(F.min(F.struct(draw.alias("h"), df[id_col].alias("id"))).alias("__least"))
        .select("__lang", F.col("__least.id").alias("__id"))
    )
    text = df[text_col].cast("string")
    start = F.pmod(F.xxhash64(df[id_col], F.lit(SEED)), F.greatest(F.length(text) - STRETCH, F.lit(1))) + 1
    rows = (
        # per_language rows of each language at most.
        df.join(F.broadcast(chosen), (df[id_col] == F.col("__id")) & (df[lang_col] == F.col("__lang")))
        .where(text.isNotNull())
        .select(text.substr(start.cast("int"), F.lit(STRETCH)).alias("t"), "__lang", "__id")
        .collect()
    )
    rows = sorted({(r["__id"], r["t"], r["__lang"]) for r in rows})
    return [r[1] for r in rows], [r[2] for r in rows]


def identify(
    df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred and score of every row."""
    text = df[text_col].cast("string")
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    schema = ", ".join([f"doc_id {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"])
    return df.select(
        df[id_col].alias("doc_id"),
        *(df[c] for c in keep),
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    ).mapInArrow(_predictor(model), schema)


def held_out(id_column) -> F.Column:
    """Rows kept for the test: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def train_and_identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned only from rows that are not held out."""
    model = train(*sample(df.where(~held_out(df[id_col])), id_col, text_col, lang_col, PER_LANGUAGE))
    marked = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"), held_out(df[id_col]).alias("held_out"))
    return identify(marked, model, keep=("held_out",))


def known_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` without the documents that the network finds in no learned language; ``lang`` is the predicted one."""
    hidden = held_out(df[id_col])
    model = train_with_unknown(
        *sample(df.where(~hidden), id_col, text_col, lang_col, PER_LANGUAGE),
        *sample(df.where(hidden), id_col, text_col, lang_col, PER_LANGUAGE),
    )
    names = df.columns
    row = df.select(
        F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"),
        df[id_col].alias("doc_id"),
        df[text_col].alias("text"),
    )
    found = identify(row, model, keep=("row",)).where(F.col("lang_pred") != UNKNOWN)
    return found.select(
        *[F.col("lang_pred" if c == lang_col else f"row.c{i}").alias(c) for i, c in enumerate(names)]
    )
