"""Quality classifier: kernel ridge by random Fourier features, isotonic calibration.

Every text is reduced to ``len(NAMES)`` statistics in one pass. A Gaussian kernel over them is
approximated by ``FEATURES`` random cosines; ridge weights solve normal equations that are summed
by partition (FEATURES x FEATURES numbers, whatever the corpus). Raw scores of labelled rows that
the weights did not see are binned, and isotonic regression on the bins gives the probability.
Training uses at most ``MAX_TRAIN`` labelled rows, those with the smallest hash of their id: four
fifths (by crc32 of the id, remainders 1 to 4) may train, of which remainder 4 calibrates.

Defined results: null and empty texts have zero statistics and are scored like any other. Repeated
rows are scored one by one; a document labelled more than once counts once, by its largest label.
Without labels of both kinds the score is the share of label 1, or 0.5 where there are none.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

FEATURES = 256
MAX_TRAIN = 50_000
RIDGE = 1e-3
SEED = 20_240_501
#: Kernel width in standard deviations, by the square root of the number of statistics.
WIDTH = 1.0
BINS = 400
CUT = 0.3
#: Weight of the raw score in the result, so that equal probabilities keep an order.
TIE = 1e-3

NAMES = (
    "log_words", "log_chars", "word_length", "distinct", "repeated_next", "upper_words", "alpha_words", "symbol_ends",
    "marks_doubled", "bars", "symbols", "digits", "commas", "stops", "line_length", "line_ends", "distinct_lines", "top_word",
)


def statistics(text: str | None) -> list[float]:
    w = (text or "").split()
    n = len(w)
    if not n:
        return [0.0] * len(NAMES)
    chars, kinds = len(text), Counter(w)
    lines = [x for x in text.split("\n") if x]
    count = text.count
    symbols = sum(map(count, "#*$%&<>"))
    ends = [x[-1] for x in w]
    ended = sum(1 for x in lines if x.rstrip()[-1:] in ".!?:;\"”。！？")
    return [
        float(np.log1p(n)), float(np.log1p(chars)), chars / n, len(kinds) / n ** 0.9, sum(map(operator.eq, w, w[1:])) / n, sum(map(str.isupper, w)) / n,
        sum(map(str.isalpha, w)) / n, sum(map(ends.count, "#*$%&|<>")) / n, (count("!!") + count("??")) / n, count("|") / n, symbols / chars,
        sum(map(count, "0123456789")) / chars, count(",") / n, count(".") / n, float(np.log1p(n / max(1, len(lines)))), ended / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)), max(kinds.values()) / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = [statistics(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float32()))], names=["doc_id", "f"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)), F.lit(1))


class Kernel:
    """Standardise, then random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES) -> None:
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((d, features)) / (WIDTH * np.sqrt(d))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -8, 8)
        x = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([x, np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing fit of y (weights w), in the order of x."""
    blocks: list[list[float]] = []
    for v, n in zip(y, w, strict=True):
        blocks.append([v * n, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in blocks]) if blocks else np.empty(0)


def normal_equations(train: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """train: f, y. Sums over partitions of X'X and X'y, as rows of one matrix."""
    m = len(kernel.b) + 1

    def sums(frames):
        total = np.zeros((m, m + 1))
        for f in frames:
            if len(f):
                x = kernel(np.stack(f["f"]))
                total += np.hstack([x.T @ x, (x.T @ f["y"].to_numpy(float))[:, None]])
        yield pd.DataFrame({"i": np.arange(m), "row": list(total)})

    def add(key, g: pd.DataFrame) -> pd.DataFrame:
        parts = [(i, np.sum(np.stack(x["row"]), axis=0)) for i, x in g.groupby("i")]
        return pd.DataFrame({"i": [i for i, _ in parts], "row": [r for _, r in parts]})

    rows = train.mapInPandas(sums, "i int, row array<double>").groupBy(F.pmod("i", F.lit(16)).alias("k")).applyInPandas(add, "i int, row array<double>")
    out = np.zeros((m, m + 1))
    for r in rows.collect():  # FEATURES + 1 rows
        out[r[0]] = r[1]
    return out[:, :m], out[:, m]


def fit(train: DataFrame):
    """train: doc_id, f, y, part (1 to 4). Returns a function from statistics to scores, or None."""
    d = len(NAMES)
    row = train.agg(F.count("*"), F.sum("y"), *[F.avg(F.col("f")[i]) for i in range(d)], *[F.stddev_pop(F.col("f")[i]) for i in range(d)]).first()
    if not row[0] or row[1] in (0, row[0]):
        share = float(row[1] / row[0]) if row[0] else 0.5
        return lambda f: np.full(len(f), share)
    mean, scale = np.asarray(row[2 : 2 + d], float), np.maximum(np.asarray(row[2 + d :], float), 1e-6)
    kernel = Kernel(mean, scale)
    a, b = normal_equations(train.filter("part <> 4").select("f", "y"), kernel)
    weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(len(a)), b)

    def raw(f: np.ndarray) -> np.ndarray:
        return np.clip(kernel(f) @ weights, -0.5, 1.5)

    def bins(frames):
        for f in frames:
            if len(f):
                k = np.minimum(((raw(np.stack(f["f"])) + 0.5) / 2 * BINS).astype(int), BINS - 1)
                yield pd.DataFrame({"k": k, "y": f["y"].to_numpy(int)})

    counts = train.filter("part = 4").select("f", "y").mapInPandas(bins, "k int, y int").groupBy("k").agg(F.avg("y"), F.count("*")).collect()  # at most BINS rows
    counts = sorted(counts) or [(BINS // 4, 0.0, 1), (BINS * 3 // 4, 1.0, 1)]
    x = (np.asarray([c[0] for c in counts]) + 0.5) / BINS * 2 - 0.5
    p = isotonic(x, np.asarray([c[1] for c in counts], float), np.asarray([c[2] for c in counts], float))

    def score(f: np.ndarray) -> np.ndarray:
        r = raw(f)
        return np.clip((1 - TIE) * np.interp(r, x, p) + TIE * (r + 0.5) / 2, 0.0, 1.0)

    return score


def labelled(labels: DataFrame, column: str, most: int = MAX_TRAIN) -> DataFrame:
    """At most ``most`` labelled documents of remainders 1 to 4, by the smallest hash of their id."""
    y = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    y = y.withColumn("part", held_out()).filter("part <> 0").withColumn("h", F.xxhash64("doc_id"))
    return y.orderBy("h", "doc_id").limit(most).drop("h")


def quality_scores(docs: DataFrame, labels: DataFrame, column: str = "quality", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    feats = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, "doc_id long, f array<float>"), "quality_stats")
    y = F.broadcast(labelled(labels, column))  # at most MAX_TRAIN rows of 16 bytes
    score = fit(materialize(feats.join(y, "doc_id").dropDuplicates(["doc_id"]).coalesce(16), "quality_train"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(f), pa.float64())], names=["doc_id", "score"])

    out = feats.mapInArrow(apply, "doc_id long, score double")
    return out.select("doc_id", (held_out() == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
