"""Scores of notices by masked pseudo-likelihood: each word is predicted from its neighbours on both sides.

A small network (an embedding for either side, one hidden layer, a softmax over word
classes) is trained in numpy on the windows of the whole corpus.  Windows of classes are
few, so the corpus is gathered as their counts, which is all that full-batch training
needs; and the trained network is evaluated once per possible window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from fairlead.llm.common import field, key_type, keyed, map_batches, per_row
from fairlead.llm.ngram_join import word_hashes
from fairlead.session import stage

# Classes: 0 the edge of a text, then a class for each of the most frequent words, then
# CLASSES - FREQUENT - 1 classes that share out all other words by their value.
CLASSES, FREQUENT = 128, 96
SHARED = CLASSES - FREQUENT - 1
# Words whose counts are sent to the workers; the counts of all others are joined.
KNOWN = 1 << 17
RUN_WORDS = 2_000_000
HIDDEN, STEPS, RATE, SEED = 32, 100, 0.05, 20_240_115


def _words(text: str) -> np.ndarray:
    return word_hashes(text.encode("utf-8"))


def _counted(rows: DataFrame, values, label: str) -> DataFrame:
    """Sums over the corpus of how often each value occurs: value, times.  ``values``: text -> integers."""
    schema = T.StructType([field("value", "bigint"), field("times", "bigint")])

    def run(batches):
        import pyarrow as pa

        parts, held = [], 0

        def sent():
            found, times = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], names=["value", "times"])

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for text in batch.slice(i, 512).column(1).to_pylist():
                    found = values(text)
                    if len(found):
                        parts.append(found)
                        held += len(found)
                    if held >= RUN_WORDS:
                        yield sent()
                        parts, held = [], 0
        if parts:
            yield sent()

    return stage(map_batches(rows, run, schema).groupBy("value").agg(F.sum("times").alias("times")), label)


@dataclass(frozen=True)
class Vocabulary:
    """Known words by value, with their class and log-probability within it; for the rest that of a count of one."""

    values: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    unknown: np.ndarray

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, log-probabilities within them and which words are known."""
        shared = (FREQUENT + 1 + np.mod(words, SHARED)).astype(np.int64)
        if not len(self.values):
            return shared, self.unknown[shared], np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.values, words), len(self.values) - 1)
        known = self.values[at] == words
        classes = np.where(known, self.classes[at], shared)
        return classes, np.where(known, self.within[at], self.unknown[classes]), known


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the counts of all words.  At most KNOWN words and CLASSES totals come to the driver."""
    steps = sorted(counts.groupBy(F.floor(F.log2("times") * 8).alias("step")).count().collect(), reverse=True)
    least, total = None, 0
    for step, n in steps:
        total += n
        if total > KNOWN:
            break
        least = step
    table = counts.filter(F.floor(F.log2("times") * 8) >= (least if least is not None else 1 << 20)).select("value", "times").toArrow()
    values, times = table["value"].to_numpy(), table["times"].to_numpy()
    order = np.lexsort((values, -times))
    values, times = values[order], times[order]
    frequent = np.arange(len(values)) < FREQUENT
    classes = np.where(frequent, 1 + np.arange(len(values)), FREQUENT + 1 + np.mod(values, SHARED))
    totals = np.ones(CLASSES)
    sums = counts.groupBy(F.pmod("value", F.lit(SHARED)).alias("c")).agg(F.sum("times").alias("n")).collect()
    for c, n in sums:
        totals[FREQUENT + 1 + c] += n
    for v, n in zip(values[frequent], times[frequent]):
        totals[FREQUENT + 1 + v % SHARED] -= n
    within = np.where(frequent, 0.0, np.log(times / totals[classes])) if len(values) else np.zeros(0)
    order = np.argsort(values)
    return Vocabulary(values[order], classes[order], within[order], -np.log(totals))


def _windows(classes: np.ndarray) -> np.ndarray:
    """Codes of (left, right, own) class for every word; class 0 stands beyond either edge."""
    if not len(classes):
        return classes
    left = np.concatenate([[0], classes[:-1]])
    right = np.concatenate([classes[1:], [0]])
    return (left * CLASSES + right) * CLASSES + classes


def train(counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Log-probabilities of every class in every (left, right) window, from counts of that shape.

    Full-batch gradient steps (Adam) on the log-loss of all counted windows.
    """
    rng = np.random.default_rng(SEED)
    shapes = {"l": (CLASSES, HIDDEN), "r": (CLASSES, HIDDEN), "w": (HIDDEN, CLASSES), "b": (CLASSES,)}
    net = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes.items()}
    totals = counts.sum(axis=(0, 1), dtype=np.float64) + 1.0
    net["b"] = np.log(totals / totals.sum()).astype(np.float32)
    mean = {k: np.zeros(s, np.float32) for k, s in shapes.items()}
    square = {k: np.zeros(s, np.float32) for k, s in shapes.items()}
    target = counts.reshape(-1, CLASSES).astype(np.float32, copy=False)
    weight = target.sum(axis=1, keepdims=True)
    scale = np.float32(1.0 / max(1.0, float(weight.sum(dtype=np.float64))))

    def forward():
        hidden = np.tanh(net["l"][:, None, :] + net["r"][None, :, :]).reshape(-1, HIDDEN)
        logits = hidden @ net["w"] + net["b"]
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        total = odds.sum(axis=1, keepdims=True)
        return hidden, logits, odds, total

    for step in range(1, steps + 1):
        hidden, _, odds, total = forward()
        error = (odds * (weight / total) - target) * scale
        back = ((error @ net["w"].T) * (1 - hidden * hidden)).reshape(CLASSES, CLASSES, HIDDEN)
        grads = {"w": hidden.T @ error, "b": error.sum(axis=0), "l": back.sum(axis=1), "r": back.sum(axis=0)}
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    _, logits, _, total = forward()
    return (logits - np.log(total)).astype(np.float32)


def notice_scores(readings: DataFrame, key: str = "metric_id", text: str = "construction_notice") -> DataFrame:
    """Log pseudo-likelihood of each notice under a network trained on all of them.

    One row per reading: ``<key>``, n_words, log_likelihood (sum over its words of the log
    probability given both neighbours), mean_log_likelihood (per word).  The probability of
    a word is that of its class from the network times that of the word within the class
    from corpus counts, of every word; words are cut at white space and A-Z lower-cased.

    A notice without words, or null, has 0 words, likelihood 0 and a null mean.  Repeated
    rows count and are scored each; an empty table gives an empty result; other columns are
    ignored.  Counts cover every word and window of the table; what comes to the driver is
    bounded by KNOWN words and CLASSES**3 windows.
    """
    rows = keyed(readings, key, text=text)
    spark = rows.sparkSession
    word_counts = _counted(rows, lambda t: _words(t).view(np.int64), "word-counts")
    words = vocabulary(word_counts)
    shared = spark.sparkContext.broadcast(words)  # at most KNOWN entries
    windows = _counted(rows, lambda t: _windows(shared.value.look_up(_words(t).view(np.int64))[0]), "window-counts")
    found = windows.select("value", "times").toArrow()  # at most CLASSES**3 rows
    counts = np.zeros(CLASSES**3, np.float32)
    counts[found["value"].to_numpy()] = found["times"].to_numpy()
    table = spark.sparkContext.broadcast(train(counts.reshape(CLASSES, CLASSES, CLASSES)).ravel())  # CLASSES**3 numbers
    schema = T.StructType([
        T.StructField("key", key_type(rows)), field("n_words", "bigint"), field("log_likelihood", "double"),
        field("others", "array<bigint>"), field("often", "array<bigint>"),
    ])

    def begin():
        lookup, logp = shared.value, table.value

        def score(k, t):
            found = _words(t).view(np.int64)
            classes, within, known = lookup.look_up(found)
            total = float(logp[_windows(classes)].sum(dtype=np.float64) + within.sum()) if len(found) else 0.0
            others, often = np.unique(found[~known], return_counts=True)
            yield k, len(found), total, others.tolist(), often.tolist()

        return score

    # Other words are scored there as if they occurred once; the logarithms of their counts are added per row.
    scored = stage(per_row(rows, begin, schema, size=lambda r: 16 * len(r[3])).withColumn("row", F.monotonically_increasing_id()), "scored-rows")
    others = scored.select("row", F.inline(F.arrays_zip(F.col("others").alias("value"), F.col("often").alias("often"))))
    more = others.toDF("row", "value", "often").join(word_counts.filter("times > 1"), "value").groupBy("row").agg(
        F.sum((F.col("often") * F.log("times")).cast("decimal(28,12)")).cast("double").alias("more")  # the same in any order
    )
    whole = scored.join(more, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return whole.select(
        F.col("key").alias(key), "n_words", "log_likelihood",
        F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"),
    )
