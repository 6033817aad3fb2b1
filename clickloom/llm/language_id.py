"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of slots serves all languages: a slot holds a bit per language, and
an n-gram sets its languages' bits in a few slots. The AND of an n-gram's slots
is the set of all languages that contain it, false positives included. A text
sums these bits per language; what chance alone would give, known from how full
each language's slice is, is taken off before the largest sum decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.llm.common import pick, settle
from clickloom.llm.wordhash import mixed

GRAM = 3
# Learning reads about this many documents per language, chosen by a hash of their id.
DOCS_PER_LANGUAGE = 3_000
# A language's n-grams are its most frequent ones that make up this share of its text,
# whatever the size of its alphabet ...
MASS = 0.98
# ... of which each is at least this share of what it is in the language that uses it most.
RELATIVE = 0.25
HASHES = 3
# The table has at most this many slots, of eight bytes per 64 languages, and fewer where it would
# take more bytes; more false positives are then taken off. So a filter's size is bounded for any
# number of n-grams, and grows only with the languages once it has the fewest slots.
MOST_SLOTS, FEWEST_SLOTS, MOST_BYTES = 1 << 21, 1 << 12, 1 << 25
HELD_OUT = 2
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, number of its text, which texts have a letter).

    Texts are lower-cased; whatever is no letter is a space, runs of spaces count
    as one, and a text begins and ends with a space.
    """
    lowered = [f" {text.lower()} " for text in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    of = np.repeat(np.arange(len(texts)), sizes)
    has = np.bincount(of[letter], minlength=len(texts)) > 0
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[np.cumsum(sizes)[:-1]] = True
    kept[:1] = True
    points, of = np.where(letter, points, 32)[kept].astype(np.uint64), of[kept]
    if len(points) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    count = len(points) - n + 1
    value = np.zeros(count, np.uint64)
    for step in range(n):
        value = (value << np.uint64(21)) | points[step:step + count]
    whole = (of[:count] == of[n - 1:]) & has[of[:count]]
    return mixed(value[whole]), of[:count][whole], has


def _stretches(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _words(languages: int) -> int:
    return (languages + 63) // 64


def table_size(members: int, languages: int) -> int:
    """Slots for so many n-grams of so many languages: a power of two."""
    size = min(MOST_SLOTS, 1 << (8 * max(1, members)).bit_length())
    while size > FEWEST_SLOTS and size * 8 * _words(languages) > MOST_BYTES:
        size //= 2
    return size


def slots_of(gram: Column, size: int) -> Column:
    """The slots of an n-gram's hash, as ``LanguageFilter`` finds them."""
    step = F.shiftrightunsigned(gram, 40).bitwiseOR(F.lit(1))
    low = gram.bitwiseAND(F.lit(size - 1))
    return F.array_distinct(F.array(*[(low + F.lit(i) * step).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)]))


@dataclass
class LanguageFilter:
    """Languages in code point order, the table of slots, and each slice's chance of a false positive."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    usual: str

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], usual: str) -> LanguageFilter:
        """A filter of the n-gram hashes that each language has."""
        slots = np.zeros((table_size(sum(map(len, members)), len(languages)), _words(len(languages))), np.uint64)
        for number, own in enumerate(members):
            bit = np.uint64(1 << (number % 64))
            for where in cls._where(own, len(slots)):
                np.bitwise_or.at(slots[:, number // 64], where, bit)
        return cls.of(languages, slots, usual)

    @classmethod
    def of(cls, languages: list[str], slots: np.ndarray, usual: str) -> LanguageFilter:
        fill = [
            float(np.count_nonzero(slots[:, i // 64] & np.uint64(1 << (i % 64)))) / len(slots)
            for i in range(len(languages))
        ]
        return cls(languages, slots, np.array(fill) ** HASHES, usual)

    @staticmethod
    def _where(hashed: np.ndarray, size: int) -> Iterator[np.ndarray]:
        step = (hashed >> np.uint64(40)) | np.uint64(1)
        for i in range(HASHES):
            yield ((hashed + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)

    def masks(self, hashed: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits."""
        found = None
        for where in self._where(hashed, len(self.slots)):
            found = self.slots[where] if found is None else found & self.slots[where]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """(language, score from 0 to 1) per text; ``und`` and 0 without a letter.

        The score is the winner's share of all corrected sums. Ties go to the
        first language in code point order; a text with no known n-gram gets the
        language most often learned from, with score 0.
        """
        hashed, of, has = grams(texts)
        masks = self.masks(hashed)
        n = np.bincount(of, minlength=len(texts)).astype(np.float64)
        sums = np.empty((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            hit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            sums[i] = np.bincount(of, weights=hit, minlength=len(texts))
        corrected = np.maximum(0.0, (sums - n * self.chance[:, None]) / (1.0 - np.minimum(self.chance, 0.999))[:, None])
        best, total = corrected.argmax(axis=0), corrected.sum(axis=0)
        out, scores = [], []
        for i in range(len(texts)):
            known = has[i] and total[i] > 0
            out.append(self.languages[best[i]] if known else self.usual if has[i] else UNKNOWN)
            scores.append(float(corrected[best[i], i] / total[i]) if known else 0.0)
        return out, scores


def _rows(docs: DataFrame) -> DataFrame:
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return rows.withColumn("held_out", F.coalesce(rest == HELD_OUT, F.lit(False)))


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageFilter | None:
    """The filter, from labelled documents outside the held-out fold; None if there are none.

    About ``docs_per_language`` documents of each language, chosen by a hash of
    their id, are read. Any number of languages can be learned. The table of
    slots is made on the executors; the driver gets its slots that are not
    empty, whose number is bounded, and the languages' names.
    """
    rows = _rows(docs).where("NOT held_out AND lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    number = {language: i for i, language in enumerate(languages)}
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_per_language / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(drawn < rates[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            which = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for start, end in _stretches(texts):
                hashed, of, _ = grams(texts[start:end])
                owner = which[start:end][of]
                for language in np.unique(owner):
                    own, n = np.unique(hashed[owner == language], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), language, np.int32)), pa.array(own.view(np.int64)), pa.array(n)],
                        names=["language", "gram", "n"],
                    )

    counted = sample.mapInArrow(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    members = settle(_members(settle(counted, "language-grams")), "language-members")
    size = table_size(members.count(), len(languages))
    bits = members.select(
        F.explode(slots_of(F.col("gram"), size)).alias("slot"), F.expr("language DIV 64").cast("int").alias("word"),
        F.expr("shiftleft(1L, language % 64)").alias("bit"),
    )
    filled = bits.groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    slots = np.zeros((size, _words(len(languages))), np.uint64)
    slots[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    usual = min(languages, key=lambda language: (-sizes[language], language))
    return LanguageFilter.of(languages, slots, usual)


def _members(counted: DataFrame) -> DataFrame:
    """(language, gram): the n-grams that count as a language's, from (language, gram, n).

    Which frequency a language's n-grams must have follows from how many
    n-grams it has of each, so n-grams themselves are never sorted.
    """
    masses = counted.groupBy("language", "n").agg((F.count("*") * F.col("n")).alias("mass"))
    whole = W.partitionBy("language")
    before = F.sum("mass").over(whole.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1))
    masses = masses.select("language", "n", F.coalesce(before, F.lit(0)).alias("before"), F.sum("mass").over(whole).alias("total"))
    least = masses.where(F.col("before") < MASS * F.col("total")).groupBy(F.col("language").alias("of")).agg(
        F.min("n").alias("least"), F.first("total").alias("total")
    )
    common = counted.join(settle(least, "least-frequencies"), F.col("language") == F.col("of"))
    common = common.where("n >= least").withColumn("share", F.col("n") / F.col("total"))
    most = F.max("share").over(W.partitionBy("gram"))
    return common.withColumn("most", most).where(F.col("share") >= RELATIVE * F.col("most")).select("language", "gram")


def identify(docs: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Whole texts are read, and only texts: neither lang nor source nor doc_id has
    a part in a prediction. ``held_out`` is false for a null doc_id, which is
    not learned from either. Null text, and text without a letter, is ``und``;
    so is every text if there is nothing to learn from. Repeated rows come out
    as often as they came in; no documents, no rows.
    """
    model = model or learn(docs)
    rows = _rows(docs).select("doc_id", "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages, scores = batch.column(2).to_pylist(), [], []
            for start, end in _stretches(texts):
                some, score = shared.value.predict(texts[start:end])
                languages += some
                scores += score
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
