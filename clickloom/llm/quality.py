"""Document quality by hierarchical empirical Bayes.

A document classifier, fitted on a bounded sample of labelled documents, gives
every document evidence of being good, that is neither of low quality nor
toxic. Grouped sums of that evidence over all documents give each host and each
path on it a posterior, shrunk towards its parent's: a path towards its host, a
host towards the whole. How strongly is estimated from how much the groups
differ. The classifier's prior is then replaced by the path's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import numbered, pick, restore, settle
from clickloom.llm.wordhash import text_chunks, word_hashes

# Labelled documents the classifier is fitted on, about.
SAMPLE = 20_000
# Words are told apart by so many values of a hash.
BUCKETS = 1 << 18
# Documents' worth of the overall rate that a word starts with.
PRIOR = 4.0
KEEP_FROM = 0.5
HEADS = ("toxic", "poor")

_CLASSES = ["upper", "lower", "digit", "!", "|", "%&$#*", ".,;:?", "\n", "other"]


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), np.uint8)
    for byte in range(256):
        char = chr(byte)
        if byte >= 0x80 or "a" <= char <= "z":
            table[byte] = _CLASSES.index("lower")
        elif "A" <= char <= "Z":
            table[byte] = _CLASSES.index("upper")
        elif char.isdigit():
            table[byte] = _CLASSES.index("digit")
        else:
            for number, members in enumerate(_CLASSES):
                if char in members and len(members) <= 5:
                    table[byte] = number
    return table


_CLASS = _class_table()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first run of each text and their total) of runs of letters."""
    inside = _CLASS[data] <= 1
    edges = offsets[(offsets < len(data)) & (offsets > 0)]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return _LOWER[data], starts, ends, np.searchsorted(starts, offsets)


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    running = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return running[firsts[1:]] - running[firsts[:-1]]


def _largest(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(firsts) - 1)
    some = firsts[1:] > firsts[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, firsts[:-1][some])
    return out


def features(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of numbers per text: its characters, repetition, and the weights of its words."""
    size = np.maximum(1, np.diff(offsets)).astype(np.float64)
    kinds = _CLASS[data]
    columns = [_sums(kinds == k, offsets) / size for k in range(len(_CLASSES) - 1)]
    lowered, starts, ends, firsts = _letter_runs(data, offsets)
    hashes = word_hashes(lowered, starts, ends)
    n = np.diff(firsts).astype(np.float64)
    of = np.repeat(np.arange(len(n)), np.diff(firsts))
    again = np.zeros(len(hashes), bool)
    for back in range(1, 9):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (of[back:] == of[:-back])
    columns += [
        _sums(again, firsts) / np.maximum(1, n), np.log1p(n), n / size * 5,
        _sums(data == 32, offsets) / size,
    ]
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    for weight in weights:
        own = weight[bucket]
        strong = own > 2.0
        columns += [
            _largest(own, firsts), np.log1p(_sums(strong, firsts)), _sums(strong, firsts) / np.maximum(1, n) * 20,
            _sums(own, firsts) / np.maximum(1, n),
        ]
    return np.column_stack(columns)


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, poor, fold) of about ``sample`` labelled documents, chosen by a hash of the id."""
    rows = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id IS NOT NULL")
    judged = rows.groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"), F.max((F.col("quality") == 0).cast("int")).alias("poor")
    )
    n = judged.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1 << 24))
    chosen = judged.where(drawn < int((1 << 24) * min(1.0, sample / max(1, n)))).withColumn("fold", drawn % 2)
    texts = pick(docs, doc_id="doc_id", text="text").where("text IS NOT NULL")
    # At most about ``sample`` rows of four numbers.
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "poor", "fold")


def _word_weights(labelled: DataFrame) -> np.ndarray:
    """For each head, each word bucket's log odds against the overall log odds, shrunk to none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((4, BUCKETS), np.int64)
        for batch in batches:
            marks = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2)]
            for row, data, offsets in text_chunks(batch.column(0)):
                lowered, starts, ends, firsts = _letter_runs(data, offsets)
                bucket = word_hashes(lowered, starts, ends) % np.uint64(BUCKETS)
                of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                once = np.unique(of * BUCKETS + bucket.astype(np.int64))
                of, bucket = row + once // BUCKETS, once % BUCKETS
                for head, mark in enumerate(marks):
                    known = ~np.isnan(mark[of])
                    seen[2 * head] += np.bincount(bucket[known], minlength=BUCKETS)
                    seen[2 * head + 1] += np.bincount(bucket[known & (mark[of] == 1)], minlength=BUCKETS)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *[pa.array(seen[i][some]) for i in range(4)]], names=["bucket", "n0", "y0", "n1", "y1"]
        )

    counted = labelled.mapInArrow(count, "bucket long, n0 long, y0 long, n1 long, y1 long")
    counted = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n0", "y0", "n1", "y1")]).toPandas()
    rates = labelled.agg(F.avg("toxic").alias("toxic"), F.avg("poor").alias("poor")).first()
    weights = np.zeros((2, BUCKETS), np.float32)
    for head, name in enumerate(HEADS):
        rate = min(max(rates[name] or 0.0, 1e-3), 1 - 1e-3)
        posterior = (counted[f"y{head}"] + PRIOR * rate) / (counted[f"n{head}"] + PRIOR)
        posterior = np.clip(posterior.to_numpy(np.float64), 1e-4, 1 - 1e-4)
        weights[head, counted["bucket"].to_numpy()] = np.log(posterior / (1 - posterior)) - np.log(rate / (1 - rate))
    return weights


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic regression, the constant first and unpenalised."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, gradient)
        beta += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


class DocumentClassifier:
    """Word weights, and a regression per head on scaled features."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, betas: list[np.ndarray]):
        self.weights, self.mean, self.scale, self.betas = weights, mean, scale, betas

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DocumentClassifier | None:
        """Fitted on about ``sample`` labelled documents; None if there are none.

        A null label says nothing about its head; of several labels of a document the worst counts.
        """
        labelled = settle(_labelled(docs, labels, sample), "labelled")
        if labelled.isEmpty():
            return None
        # A regression on word weights must not see the documents the weights are from.
        halves = [_word_weights(labelled.where(f"fold = {1 - fold}")) for fold in (0, 1)]
        shared = docs.sparkSession.sparkContext.broadcast(halves)

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold = batch.column(3).to_numpy(zero_copy_only=False)
                for row, data, offsets in text_chunks(batch.column(0)):
                    both = [features(data, offsets, weights) for weights in shared.value]
                    own = fold[row:row + len(offsets) - 1, None]
                    x = pa.array(list(np.where(own == 0, both[0], both[1])), pa.list_(pa.float64()))
                    marks = [batch.column(i).slice(row, len(own)) for i in (1, 2)]
                    yield pa.RecordBatch.from_arrays([x, *marks], names=["x", "toxic", "poor"])

        # At most about as many rows as the sample, some twenty numbers each.
        rows = labelled.mapInArrow(compute, "x array<double>, toxic int, poor int").toPandas()
        weights = _word_weights(labelled)
        width = len(_CLASSES) + 3 + 4 * len(HEADS)
        x = np.array(rows["x"].tolist(), np.float64).reshape(-1, width)
        mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
        betas = []
        for head in HEADS:
            known = rows[head].notna().to_numpy()
            betas.append(_regression((x[known] - mean) / scale, rows.loc[known, head].to_numpy(np.float64)))
        return cls(weights, mean, scale, betas)

    def good(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of being good by the text alone, between -12 and 12."""
        x = np.clip((features(data, offsets, self.weights) - self.mean) / self.scale, -8, 8)
        bad = [1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -12, 12))) for beta in self.betas]
        p = np.clip((1 - bad[0]) * (1 - bad[1]), 6e-6, 1 - 6e-6)
        return np.log(p / (1 - p))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _strength(groups: DataFrame, centre: Column) -> float:
    """How many documents the parent's rate is worth, by the method of moments.

    The spread of group rates beyond what groups of their sizes show by chance,
    against the spread within; equal groups give a large strength.
    """
    n, rate = F.col("n"), F.col("good") / F.col("n")
    within = F.sum(F.col("good") * (F.lit(1.0) - rate))
    moved = F.sum(n * (rate - centre) * (rate - centre))
    row = groups.where("n > 0").agg(
        moved.alias("moved"), within.alias("within"), F.sum("n").alias("n"), F.count("*").alias("k")
    ).first()
    if not row["n"] or row["n"] <= row["k"]:
        return 1.0
    inside = row["within"] / (row["n"] - row["k"])
    between = max(0.0, (row["moved"] - row["k"] * inside) / row["n"])
    return float(min(1e6, max(1.0, inside / between if between > 0 else 1e6)))


def assess(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: doc_id, text_hash, p_document, p_site, p_good, kept.

    ``source`` is a host, or a host and a path; the path level is its second
    part and the language. Null source and null lang are groups of their own.
    Null and empty texts are judged like any other, as texts without words.
    ``p_document`` is the classifier's, ``p_site`` the path's posterior, and a
    document is kept from ``keep_from``. Without labels all is kept. Repeated
    rows come out as often as they came in; no documents, no rows.
    """
    model = DocumentClassifier.fit(docs, labels, sample)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = pick(docs, doc_id="doc_id", text="text", source="source", lang="lang").select(
        "doc_id", F.substring_index(source, "/", 1).alias("host"),
        F.concat_ws("#", F.substring_index(source, "/", 2), "lang").alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    if model is None:
        one = F.lit(1.0)
        return rows.select(
            "doc_id", "text_hash", one.alias("p_document"), one.alias("p_site"), one.alias("p_good"),
            F.lit(True).alias("kept"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [shared.value.good(data, offsets) for _, data, offsets in text_chunks(batch.column(3))]
            odds = np.concatenate(odds) if odds else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(odds)],
                names=["doc_id", "host", "path", "text_hash", "odds"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"doc_id {kind}, host string, path string, text_hash long, odds double")
    scored = settle(scored.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("odds")))), "scored")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"))
    paths = settle(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("good") / F.sum("n")).first()[0]
    if whole is None:
        return scored.select(
            "doc_id", "text_hash", F.col("p").alias("p_document"), F.col("p").alias("p_site"),
            F.col("p").alias("p_good"), F.lit(True).alias("kept"),
        )
    by_host = _strength(hosts, F.lit(whole))
    hosts = hosts.select("host", ((F.col("good") + by_host * whole) / (F.col("n") + by_host)).alias("host_rate"))
    nested = paths.join(hosts, "host")
    by_path = _strength(nested, F.col("host_rate"))
    site = (F.col("good") + F.lit(by_path) * F.col("host_rate")) / (F.col("n") + by_path)
    sites = nested.select("host", "path", F.least(F.greatest(site, F.lit(1e-4)), F.lit(1 - 1e-4)).alias("p_site"))
    odds = F.col("odds") + _logit(F.col("p_site")) - _logit(F.lit(min(max(whole, 1e-4), 1 - 1e-4)))
    judged = scored.join(sites, ["host", "path"]).withColumn("p_good", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    return judged.select(
        "doc_id", "text_hash", F.col("p").alias("p_document"), "p_site", "p_good",
        (F.col("p_good") >= keep_from).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that ``assess`` keeps, with all their columns.

    Rows with the same id and text are judged alike but for their site; they
    stay if any of them does. Rejected rows are an anti-join's small side, so
    texts need no shuffle while Spark can broadcast that.
    """
    judged = assess(docs, labels, **settings)
    verdict = judged.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"))
    bad = settle(verdict.where(~F.col("kept")).select("doc_id", "text_hash"), "rejected")
    rows, names = numbered(docs, doc_id="doc_id", text="text")
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = rows["doc_id"].eqNullSafe(bad["doc_id"]) & (rows["text_hash"] == bad["text_hash"])
    return restore(rows.join(bad, same, "left_anti"), names)
