"""Quality scores by a generalised additive model with pairwise interactions.

Cyclic boosting adds shallow trees to one feature's lookup table after the other, then to the tables of the pairs of
features that explain most of what is left. A text's score is the sigmoid of the sum of its bins' entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import text_batches

FEATURES = (
    "log_words", "word_length", "letters", "upper", "symbols", "marks", "digits", "blanks", "distinct_words", "top_word",
    "repeated_lines", "words_a_line", "marked_words", "entropy", "repeated_pairs", "common_words",
)
#: Very common words of the languages.
COMMON = frozenset("the of and to in a is that for with as on at by this be are was en de la el los las que y un una por con le les des et du der die das und ein eine zu den mit von für".split())
#: Labelled rows from which a model is learned, at most: those whose ids hash lowest.
MOST_LABELLED = 20_000


def _features(text: str) -> list[float]:
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    upper, lower, high = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[128:].sum())
    words = text.split()
    m = max(1, len(words))
    found = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    share = counts[counts > 0] / n
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / m,
        (upper + lower + high) / n,
        upper / max(1, upper + lower),
        float(counts[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]].sum()) / n,
        float(counts[[33, 63]].sum()) / n,
        float(counts[48:58].sum()) / n,
        float(counts[[9, 10, 11, 12, 13, 32]].sum()) / n,
        len(found) / m,
        max(found.values(), default=0) / m,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        sum(1 for w in words if not w[-1].isalnum()) / m,
        float(-(share * np.log2(share)).sum()),
        sum(c for c in pairs.values() if c > 1) / m,
        sum(c for w, c in found.items() if w.lower() in COMMON) / m,
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([_features(t) for t in batch.column("_text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], [*names, *FEATURES])


def _as_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features: one lookup for each feature and pair, added up."""
        total = np.full(len(x), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, i], side="left")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="left"), np.searchsorted(self.coarse[j], x[:, j], side="left")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def _cuts(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, n) / n))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """Values by bin of a tree over an ordered feature, from the bins' gradients and hessians, split greedily."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            at = at[(ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least)]
            if len(at):
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                best = max(best, (float(gain.max()), k, int(at[gain.argmax()])), key=lambda t: t[0])
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each of two features once, from a table of gradients and hessians."""
    cg, ch = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not a.size:
        return 0.0, np.zeros_like(g)

    def quarter(c: np.ndarray) -> list[np.ndarray]:
        top, left, all_ = c[a, -1], c[-1, b], c[-1, -1]
        return [c[a, b], top - c[a, b], left - c[a, b], all_ - top - left + c[a, b]]

    qg, qh = quarter(cg), quarter(ch)
    gain = sum(x**2 / (y + l2) for x, y in zip(qg, qh, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = [x[i, j] / (y[i, j] + l2) for x, y in zip(qg, qh, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, l2: float = 4.0, least: float = 2.0) -> Model:
    """The model of features x and labels y (0 to 1). Without rows the score is 1/2; with one class it is nearly that class."""
    if not len(y):
        return Model(0.0)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(mean / (1 - mean))))
    model.edges = [_cuts(x[:, i], bins) for i in range(x.shape[1])]
    model.coarse = [_cuts(x[:, i], 8) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(model.edges)]
    raw = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, (bin_, table) in enumerate(zip(at, model.tables, strict=True)):
            g, h = slopes()
            step = rate * _shallow(np.bincount(bin_, g, len(table)), np.bincount(bin_, h, len(table)), 3, l2, least)
            table += step
            raw += step[bin_]
    coarse = [np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]

    def table_of(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    gains = sorted(((-_quadrants(table_of(i, j, g), table_of(i, j, h), l2)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain < 0]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _quadrants(table_of(i, j, g), table_of(i, j, h), l2)[1]
            table += step
            raw += step[coarse[i], coarse[j]]
    return model


def held_out(id_col: Column) -> Column:
    """Whether a document's label is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """A model learned from the labelled texts that aren't held out, at most the `most` whose ids hash lowest.

    Labels whose id or value is null are left out; of repeated ids the mean counts, of labels and of texts' features, so
    no more than `most` rows of numbers reach the driver. Only the texts' own features are
    inputs. With neither labels nor texts the model scores 1/2.
    """
    given = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null")
    given = given.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.avg("_y").alias("_y"))
    chosen = given.orderBy(F.xxhash64("_id"), "_id").limit(most)
    # At most `most` rows of two numbers: a proven bound.
    rows = _as_rows(docs, id_col, text_col).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")
    measured = rows.mapInArrow(_measured, "_id long, _y double, " + ", ".join(f"{f} double" for f in FEATURES))
    # A sum's last digits depend on its order, which mustn't move a cut.
    mean = lambda f: F.when(F.min(f) == F.max(f), F.min(f)).otherwise(F.round(F.avg(f), 9)).alias(f)
    table = measured.groupBy("_id").agg(F.first("_y").alias("_y"), *map(mean, FEATURES)).toArrow()
    x = np.column_stack([pc.fill_null(table.column(f), 0.0).to_numpy() for f in FEATURES]) if len(table) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, table.column("_y").to_numpy())) if len(table) else []
    return fit_tables(x[order], table.column("_y").to_numpy()[order] if len(table) else np.zeros(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, score), the model's estimate that the text's label is 1.

    Null texts are scored as empty ones. A null id stays null, repeated rows give repeated results, other columns aren't
    read, and an empty table gives an empty one.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([_features(t) for t in batch.column("_text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(model.scores(x))], ["_id", "score"])

    return _as_rows(docs, id_col, text_col).mapInArrow(scored, "_id long, score double").withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores threshold or more; all columns stay."""

    text_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        x = np.array([_features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.scores(x))

    return docs.where(scored(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
