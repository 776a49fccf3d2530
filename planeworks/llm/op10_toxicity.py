"""Toxicity severity by cumulative-link (proportional odds) ordinal regression on sparse text features.

Grades: 0 for texts labelled not toxic; toxic texts are graded 1 to 3 by terciles of how often, per 100 words, they
use features that the labelled sample associates with toxic texts. P(grade > k) = sigmoid(w.x - t_k), t_1 < t_2 < t_3:
all thresholds share the weights w. The expected severity is the sum of the three probabilities.

Features are words and their first 4 to 8 bytes; a feature has two values over the whole text, log(1 + count) and
log(1 + count per 100 words), so that a stray use in a long text weighs little. All features of the sample take part.
The likelihood is penalised by the weights' absolute values, those of a feature by PENALTY over its log-likelihood ratio
(twice the gain, between the classes of the sample, over one common document frequency), so that most weights are
exactly zero. A text moves the likelihood by no more than its share of its class, so a feature whose values, so weighed,
sum to less than its penalty has zero weights at the optimum: such features stay with the executors. Of the rest, the
set of features that may have weight grows, beginning with none, until no other feature's slope exceeds its penalty; the
slopes are sums over the sample's cells, which stay with the executors.

The sample is bounded: at most `per_class` labelled texts a class (a documented parameter), the least by a hash of
doc_id, so it doesn't depend on the input's order. Everything else covers all rows. The model (the features with
weights) is shipped with the code of the scoring tasks; scoring is per row.

Defined cases: null or empty texts have no features and get the severity of an empty text; labels without a text and
null labels are left out; a doc_id counts once, with its largest label and, if it is in `docs` more than once, its least
text; without labels of both classes every text gets severity 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.llm.text import LOWER_BYTES, WORD, bounded, dictionary, id_text, map_slices, shared_dir, slices, words_of

PER_CLASS, LEVELS, REJECT, PENALTY = 3000, 3, 0.5, 0.02
#: Log-likelihood ratio from which on a feature, if toxic texts have it more often, counts for a toxic text's grade.
ASSOCIATED = 20.0
#: Features that join the fit at least in a round, those whose slopes exceed their penalties most; it goes on until none does.
WORKING = 200
#: Features that are broadcast at most, once counted.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Model:
    words: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), one column a threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


EMPTY = Model({}, np.zeros(0), np.full(LEVELS, 40.0))


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The word and its first 4 to 8 bytes, told apart by a mark."""
    return (word, *[_MARKS[k] + word[:k] for k in range(4, min(9, len(word) + 1))])


_MARKS = {k: b"%d:" % k for k in range(4, 9)}


def values_of(col: np.ndarray, n: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values): a count's and a rate's for each cell; rates stand `width` columns on."""
    return np.concatenate([col, col + width]), np.concatenate([np.log1p(n), np.log1p(100 * n / words)])


def _coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row of each word, code of each word, distinct words)."""
    low = np.frombuffer(data.tobytes().translate(LOWER_BYTES), np.uint8)
    starts, ends, before = words_of(low, offsets, WORD)
    codes, distinct = dictionary(low, starts, ends)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(before)), codes, distinct.to_pylist()


def count_features(docs: DataFrame) -> DataFrame:
    """doc_id, feature, n, words of (doc_id, text): all features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, 1 << 20):
            row, code, distinct = _coded(data, offsets)
            per = [features_of(w) for w in distinct]
            names: dict[bytes, int] = {}
            flat = np.array([names.setdefault(f, len(names)) for x in per for f in x], np.int64)
            size = np.array([len(x) for x in per], np.int64)
            at = np.cumsum(size) - size
            own = size[code] if len(code) else size
            place = np.repeat(at[code] - (np.cumsum(own) - own), own) + np.arange(own.sum()) if len(code) else code
            pair, n = np.unique(np.repeat(row, own) * max(1, len(names)) + flat[place], return_counts=True)
            words = np.bincount(row, minlength=len(offsets) - 1)
            r = pair // max(1, len(names))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(list(names), pa.binary()).take(pa.array(pair % max(1, len(names)))), pa.array(n), pa.array(words[r])], names=["doc_id", "feature", "n", "words"])

    return docs.mapInArrow(run, "doc_id long, feature binary, n long, words long")


def likelihood(theta: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, width: int, levels: int = LEVELS) -> tuple[float, np.ndarray]:
    """(weighed negative log-likelihood, its slope) of the proportional odds model on sparse rows. theta: `width` weights,
    the first threshold, the logarithms of the gaps between thresholds."""
    gaps = np.exp(theta[width + 1 :])
    cut = theta[width] + np.concatenate([[0.0], np.cumsum(gaps)])
    z = np.bincount(row, theta[col] * value, len(grade))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    upper = np.where(grade < levels, sigmoid(np.append(cut, np.inf)[grade] - z), 1.0)  # P(grade <= g)
    lower = np.where(grade > 0, sigmoid(np.append(-np.inf, cut)[grade] - z), 0.0)
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
    dz = du - dl
    dcut = np.bincount(grade, -du, levels + 1)[:levels] + np.bincount(grade, dl, levels + 1)[1:]
    slope = np.concatenate([np.bincount(col, dz[row] * value, width), [dcut.sum()], gaps * dcut[::-1].cumsum()[::-1][1:]])
    return float(-(weight * np.log(p)).sum()), slope


def class_weights(grade: np.ndarray) -> np.ndarray:
    """Both classes weigh a half, their texts alike."""
    toxic = grade > 0
    return np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))


def _descend(theta: np.ndarray, cells: tuple, grade: np.ndarray, weight: np.ndarray, penalty: np.ndarray, levels: int, steps: int) -> np.ndarray:
    """theta after accelerated proximal steps, whose length follows from the likelihood, with restarts."""
    width = len(penalty)
    here, ahead, pace, bend, best = theta, theta, 1.0, 0.05, np.inf
    for _ in range(steps):
        at, slope = likelihood(ahead, *cells, grade, weight, width, levels)
        while True:
            new = ahead - slope / bend
            new[:width] = np.sign(new[:width]) * np.maximum(np.abs(new[:width]) - penalty / bend, 0.0)
            move = new - ahead
            there, _ = likelihood(new, *cells, grade, weight, width, levels)
            if there <= at + slope @ move + bend / 2 * (move @ move) + 1e-12 or bend > 1e9:
                break
            bend *= 2
        total = there + float((penalty * np.abs(new[:width])).sum())
        if total > best:  # too fast: start again from the best so far
            if pace == 1.0:
                break
            ahead, pace = here, 1.0
            continue
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - here)
        gained, here, pace, best, bend = best - total, new, faster, total, bend * 0.97
        if gained < 1e-7 * abs(best):
            break
    return here


def ends_of(grade: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Parameters of the thresholds (the first, logarithms of the gaps) that suit the grades best without any weights."""
    below = np.cumsum(np.bincount(grade, class_weights(grade), levels + 1))[:levels].clip(1e-6, 1 - 1e-6)
    cut = np.log(below / (1 - below))
    return np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, penalty: np.ndarray | float = 0.0, start: np.ndarray | None = None, levels: int = LEVELS, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, slope of each text's likelihood in its score) of the proportional odds model on sparse rows, classes
    weighing alike, each weight's absolute value penalised by its penalty. Parameters: `width` weights, then as ends_of()."""
    penalty = np.broadcast_to(np.asarray(penalty, float), (width,))
    weight = class_weights(grade)
    theta = np.concatenate([np.zeros(width), ends_of(grade, levels)]) if start is None else start
    theta = _descend(theta, (row, col, value), grade, weight, penalty, levels, steps)
    # the slope in each text's score is that of a feature which only this text has, with the value 1
    n = len(grade)
    own = np.arange(n)
    shifted = np.concatenate([np.bincount(row, theta[col] * value, n) if len(row) else np.zeros(n), theta[width:]])
    _, slope = likelihood(shifted, own, own, np.ones(n), grade, weight, n, levels)
    return theta, slope[:n]


def thresholds_of(ends: np.ndarray) -> np.ndarray:
    return ends[0] + np.concatenate([[0.0], np.cumsum(np.exp(ends[1:]))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, penalty: float = PENALTY) -> Model:
    """The model from a bounded sample of labelled texts. The driver holds a number a text, and the cells of features that
    may have weight; slopes of all others are summed by the executors, round by round, until none exceeds its penalty."""
    spark = docs.sparkSession

    def kept(table: DataFrame, name: str) -> DataFrame:
        folder = shared_dir(spark, name)
        table.write.parquet(folder)
        return spark.read.parquet(folder)

    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    chosen = kept(marks.where("toxic = 1").orderBy(by_hash, "doc_id").limit(per_class).unionByName(marks.where("toxic = 0").orderBy(by_hash, "doc_id").limit(per_class)), "labelled")
    sample = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows
    one = kept(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    ids = one.select("doc_id", "toxic").orderBy("doc_id").toArrow()
    keys, bad = ids["doc_id"].to_pylist(), ids["toxic"].to_numpy() == 1
    if not bad.any() or bad.all():
        return EMPTY
    n1, n0 = F.lit(float(bad.sum())), F.lit(float((~bad).sum()))
    numbered = spark.createDataFrame([(k, i, bool(b)) for i, (k, b) in enumerate(zip(keys, bad, strict=True))], "doc_id long, doc int, toxic boolean")
    features = count_features(one.select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id"))
    counted = kept(features.join(F.broadcast(numbered), "doc_id").select("feature", "doc", "toxic", "n", "words", F.log1p("n").alias("count"), F.log1p(100 * F.col("n") / F.col("words")).alias("rate")), "sample-features")
    weight = F.when(F.col("toxic"), 0.5 / n1).otherwise(0.5 / n0)
    by = counted.groupBy("feature").agg(F.count(F.when(F.col("toxic"), 1)).alias("df1"), F.count(F.when(~F.col("toxic"), 1)).alias("df0"), F.sum(weight * F.col("count")).alias("counts"), F.sum(weight * F.col("rate")).alias("rates"))
    p1, p0 = F.col("df1") / n1, F.col("df0") / n0
    both = (F.col("df1") + F.col("df0")) / (n1 + n0)
    term = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    gain = 2 * (term(F.col("df1"), p1, both) + term(F.col("df0"), p0, both) + term(n1 - F.col("df1"), 1 - p1, 1 - both) + term(n0 - F.col("df0"), 1 - p0, 1 - both))
    scored = by.withColumn("gain", F.greatest(F.round(gain, 6), F.lit(1e-6)))
    able = kept(scored.where(F.greatest("counts", "rates") * F.col("gain") > penalty).select("feature", "gain", ((p1 > p0) & (F.col("gain") >= ASSOCIATED)).alias("strong")), "features")
    cells = kept(counted.select("feature", "doc", "n", "words", "count", "rate").join(bounded(able, BROADCAST_ROWS), "feature"), "cells")
    told = cells.where("strong").groupBy("doc").agg((100 * F.sum("n") / F.first("words")).alias("rate")).toArrow()
    rate = np.zeros(len(bad))
    rate[told["doc"].to_numpy()] = told["rate"].to_numpy()
    terciles = np.quantile(rate[bad], [1 / 3, 2 / 3])
    grade = np.where(bad, 1 + (rate > terciles[0]) + (rate > terciles[1]), 0)

    names: list[bytes] = []
    gains = np.zeros(0)
    row, col, values = np.zeros(0, np.int64), np.zeros(0, np.int64), (np.zeros(0), np.zeros(0))
    theta = np.concatenate([np.zeros(0), ends_of(grade)])
    _, slope = fit_ordinal(row, col, values[0], grade, 0, start=theta, steps=0)
    while True:
        slopes = spark.createDataFrame(list(enumerate(slope.tolist())), "doc int, slope double")
        own = spark.createDataFrame([(x,) for x in names], "feature binary")
        summed = cells.join(F.broadcast(slopes), "doc").groupBy("feature", "gain").agg(F.abs(F.sum(F.col("slope") * F.col("count"))).alias("a"), F.abs(F.sum(F.col("slope") * F.col("rate"))).alias("b"))
        over = F.greatest("a", "b") * F.col("gain")
        late = summed.where(over > penalty * 1.001).join(F.broadcast(own), "feature", "left_anti").orderBy(F.desc(over), "feature").limit(max(WORKING, len(names))).select("feature", "gain").toArrow()
        if late.num_rows == 0:
            break
        new = late["feature"].to_pylist()
        places = spark.createDataFrame([(x, len(names) + i) for i, x in enumerate(new)], "feature binary, col int")
        met = cells.select("feature", "doc", "count", "rate").join(F.broadcast(places), "feature").select("doc", "col", "count", "rate").toArrow()
        row, col = np.concatenate([row, met["doc"].to_numpy()]), np.concatenate([col, met["col"].to_numpy()])
        values = np.concatenate([values[0], met["count"].to_numpy()]), np.concatenate([values[1], met["rate"].to_numpy()])
        del met
        old, names, gains = len(names), names + new, np.concatenate([gains, late["gain"].to_numpy()])
        width, none = len(names), np.zeros(len(new))
        start = np.concatenate([theta[:old], none, theta[old : 2 * old], none, theta[2 * old :]])
        theta, slope = fit_ordinal(np.tile(row, 2), np.concatenate([col, col + width]), np.concatenate(values), grade, 2 * width, np.tile(penalty / gains, 2), start)
    width = len(names)
    if width == 0:
        return EMPTY
    kept_ = np.flatnonzero((theta[:width] != 0) | (theta[width : 2 * width] != 0))
    return Model({names[i]: k for k, i in enumerate(kept_.tolist())}, np.concatenate([theta[kept_], theta[width + kept_]]), thresholds_of(theta[2 * width :]))


def _scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """P(grade > k) of each text, one column a threshold."""
    row, code, distinct = _coded(data, offsets)
    rows = len(offsets) - 1
    per = [[i for i in map(model.words.get, features_of(w)) if i is not None] for w in distinct]
    size = np.fromiter(map(len, per), np.int64, len(per))
    total = np.zeros(rows)
    use = np.flatnonzero(size[code]) if len(code) else code
    if len(use):
        flat, at = np.array([i for x in per for i in x], np.int64), np.cumsum(size) - size
        own = size[code[use]]
        place = np.repeat(at[code[use]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        width = len(model.words)
        pair, n = np.unique(np.repeat(row[use], own) * width + flat[place], return_counts=True)
        r = pair // width
        cols, values = values_of(pair % width, n, np.bincount(row, minlength=rows)[r], width)
        total = np.bincount(np.tile(r, 2), model.weights[cols] * values, rows)
    return model.chances(total)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """doc_id, severity (expected grade), grade (the most likely), p_toxic, toxic (p_toxic >= reject)."""

    def make():
        def step(keys: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict:
            p = _scores(model, data, offsets)
            one, none = np.ones((len(p), 1)), np.zeros((len(p), 1))
            each = np.concatenate([one, p], axis=1) - np.concatenate([p, none], axis=1)
            return {"doc_id": keys, "severity": pa.array(p.sum(axis=1).round(6)), "grade": pa.array(each.argmax(axis=1).astype(np.int32)), "p_toxic": pa.array(p[:, 0].round(6)), "toxic": pa.array(p[:, 0] >= reject)}

        return step

    return map_slices(id_text(docs, id_col, text_col), make, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs, all columns, whose text isn't rejected. Per row; nothing is shuffled."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # slices bound what is scored at once
            pairs = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], names=["row", "text"])
            keep = [_scores(model, data, offsets)[:, 0] < reject for _, data, offsets in slices(iter([pairs]))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
