"""Benchmark decontamination: edit distance through random walks and bit sampling.

An item has leaked into a document if some stretch of it is at most a fifth of
the item's words away in word edit distance. Windows of the item's size are
laid wherever a run of words agrees that every such stretch must share with
the item. A CGK random walk embeds windows and items so that a small edit
distance becomes a small Hamming distance: it reads a word for each output
position and moves on or stays by a coin thrown for the position and the word.
Coordinates sampled from several walks make the keys of the search; so many
keys are used that the wanted recall is reached on items edited at random. What
collides is verified by exact edit distance. Item sizes that would take too many
walks are not searched for by keys: all stretches around shared runs that have
enough of the item's words are verified, so their recall is 1.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import numbered, pick, restore, settle
from clickloom.llm.wordhash import mixed, text_chunks, word_hashes, word_spans

SHARE = 0.2
RECALL = 0.99
# Output positions per key, keys per walk.
SAMPLED, KEYS_PER_WALK = 2, 4
# Item sizes over so many words, and those that miss the recall with so many walks, are verified without keys.
LONGEST_WALKED, MOST_WALKS = 256, 24
# Edited items that a size's number of walks is found with.
TRIALS = 400
# Shared runs and table cells handled at a time.
_RUNS, _CELLS = 1 << 20, 1 << 20
# Items searched for at a time; more are searched for in blocks. It bounds what is broadcast.
BLOCK_ITEMS = 20_000
SEED = 20_240_501
_FILTER_BITS = 20
_PUNCTUATION = np.array([32 if b < 0x80 and not chr(b).isalnum() else b for b in range(256)], np.uint8)


def words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each text and their total): lower-cased, ASCII punctuation dropped."""
    for row, data, offsets in text_chunks(pc.utf8_lower(column)):
        plain = _PUNCTUATION[data]
        starts, ends, firsts = word_spans(plain, offsets)
        yield row, word_hashes(plain, starts, ends), firsts


def shared_run(n: int, edits: int) -> int:
    """Words in a row that survive ``edits`` edits of ``n`` words, however these are placed."""
    return max(1, (n - edits) // (edits + 1)) if edits else n


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    values = words[:n].copy()
    for step in range(1, length):
        values = mixed(values + np.uint64(step)) ^ words[step:step + n]
    return mixed(values)


def walk(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, number: int, length: int) -> np.ndarray:
    """The first ``length`` output positions (rows) of the CGK embedding of each window words[start:stop].

    ``words`` ends with a zero, which is also what a window reads past its end.
    """
    out = np.empty((length, len(starts)), np.uint64)
    at = starts.copy()
    for position in range(length):
        word = np.where(at < stops, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        out[position] = word
        coin = mixed(word ^ np.uint64((SEED * 1_000_003 + number * 7919 + position) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at += (coin >> np.uint64(63)).astype(np.int64)
    return out


@cache
def _plan(n: int, number: int) -> np.ndarray:
    """Sampled output positions of a walk over ``n`` words, ``SAMPLED`` for each of its keys."""
    rng = np.random.default_rng([SEED, n, number])
    return rng.integers(0, 2 * n, size=(KEYS_PER_WALK, SAMPLED))


def signatures(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, sizes: np.ndarray, number: int) -> np.ndarray:
    """The walk's keys (rows) of windows of items of the given sizes; keys of different sizes differ."""
    if not len(starts):
        return np.empty((KEYS_PER_WALK, 0), np.uint64)
    kinds, kind = np.unique(sizes, return_inverse=True)
    plans = np.stack([_plan(int(n), number) for n in kinds])
    embedded = walk(words, starts, stops, number, int(plans.max()) + 1)
    columns = np.arange(len(starts))
    keys = np.empty((KEYS_PER_WALK, len(starts)), np.uint64)
    for key in range(KEYS_PER_WALK):
        value = (sizes * KEYS_PER_WALK + key).astype(np.uint64)
        for sample in range(SAMPLED):
            value = mixed(value + np.uint64(1)) ^ embedded[plans[kind, key, sample], columns]
        keys[key] = mixed(value)
    return keys


def edit_distances(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray) -> tuple:
    """(distance, start, end) of the stretch nearest to the item within words[start:end], for each region.

    The exact word edit distance with free ends; of equally near stretches the
    one ending first, and of those the shortest.
    """
    width = int((ends - starts).max()) if len(starts) else 0
    reach = starts[:, None] + np.arange(width)[None, :]
    inside = reach < ends[:, None]
    region = np.where(inside, words[np.minimum(reach, len(words) - 1)], np.uint64(0))

    def table(text: np.ndarray, known: np.ndarray, pattern: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(width + 1, dtype=np.int32)
        row = np.zeros((len(text), width + 1), np.int32) if free else np.tile(steps, (len(text), 1))
        for i, word in enumerate(pattern, 1):
            change = row[:, :-1] + ~((text == word) & known)
            best = np.empty_like(row)
            best[:, 0] = i
            best[:, 1:] = np.minimum(change, row[:, 1:] + 1)
            row = np.minimum.accumulate(best - steps, axis=1) + steps
        return row

    last = table(region, inside, item, free=True)
    last[:, 1:][~inside] = 1 << 20
    distance, end = last.min(axis=1), last.argmin(axis=1)
    back = np.maximum(0, end[:, None] - 1 - np.arange(width)[None, :])
    known = np.arange(width)[None, :] < end[:, None]
    reverse = table(np.take_along_axis(region, back, axis=1), known, item[::-1], free=False)
    reverse[:, 1:][~known] = 1 << 20
    return distance, starts + end - reverse.argmin(axis=1), starts + end


def joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping regions as one; neither ends nor starts may fall from one region to the next."""
    first = np.append(True, low[1:] >= high[:-1])
    return low[first], high[np.append(first[1:], True)]


class ItemIndex:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple], share: float = SHARE, recall: float = RECALL):
        self.share = share
        column = pa.array([text for _, text in items], pa.string())
        self.ids, self.words = [], []
        for row, hashes, firsts in words_of(column):
            for i in range(len(firsts) - 1):
                if firsts[i + 1] > firsts[i]:
                    self.ids.append(items[row + i][0])
                    self.words.append(hashes[firsts[i]:firsts[i + 1]])
        self.edits = [int(share * len(w)) for w in self.words]
        self.sizes: dict[int, list[int]] = defaultdict(list)
        for item, words in enumerate(self.words):
            self.sizes[len(words)].append(item)
        self.walks = {n: self._walks_for(n, members, recall) for n, members in self.sizes.items()}
        # By whether the items have walks, and by length.
        runs: dict[tuple[bool, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for item, words in enumerate(self.words):
            length = shared_run(len(words), self.edits[item])
            values = run_hashes(words, length)
            part = values, np.full(len(values), item), np.arange(len(values))
            runs[self.walks[len(words)] > 0, length].append(part)
        self.runs = {}
        for key, parts in runs.items():
            values, owners, places = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(values, kind="stable")
            self.runs[key] = values[order], owners[order], places[order]
        self.filters = {}
        for key, (values, _, _) in self.runs.items():
            self.filters[key] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[key][values >> np.uint64(64 - _FILTER_BITS)] = True
        flat = np.append(np.concatenate([*self.words, np.empty(0, np.uint64)]), np.uint64(0))
        sizes = np.array([len(w) for w in self.words], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.tables = []
        for number in range(max(self.walks.values(), default=0)):
            some = np.flatnonzero([self.walks[n] > number for n in sizes.tolist()])
            keys = signatures(flat, starts[some], starts[some] + sizes[some], sizes[some], number)
            order = np.argsort(keys, axis=1, kind="stable")
            self.tables.append((np.take_along_axis(keys, order, axis=1), some[order]))

    def _walks_for(self, n: int, members: list[int], recall: float, trials: int = TRIALS) -> int:
        """So many walks that ``recall`` of items with as many random edits as are allowed collide.

        0 where that takes too many: such items are verified without keys.
        """
        rng = np.random.default_rng([SEED, n])
        edits = int(self.share * n)
        if not edits:
            return 1
        if n > LONGEST_WALKED:
            return 0
        plain, edited = [], []
        for trial in range(trials):
            words = self.words[members[trial % len(members)]]
            changed = list(words)
            for _ in range(edits):
                at, kind = int(rng.integers(0, len(changed) + 1)), int(rng.integers(0, 3))
                new = np.uint64(rng.integers(1, 1 << 62))
                if kind == 0:
                    changed.insert(at, new)
                elif kind == 1 and at < len(changed):
                    del changed[at]
                elif at < len(changed):
                    changed[at] = new
            plain.append(words)
            edited.append(np.array((changed + [np.uint64(0)] * n)[:n], np.uint64))
        found = np.zeros(trials, bool)
        starts, sizes = np.arange(trials) * n, np.full(trials, n)
        plain, edited = (np.append(np.concatenate(x), np.uint64(0)) for x in (plain, edited))
        for number in range(MOST_WALKS):
            a = signatures(plain, starts, starts + n, sizes, number)
            b = signatures(edited, starts, starts + n, sizes, number)
            found |= (a == b).any(axis=0)
            if found.mean() >= recall:
                return number + 1
        return 0

    def shared_runs(self, words: np.ndarray, firsts: np.ndarray, walked: bool) -> Iterator[tuple]:
        """(place in the words, item, place in the item) of runs that texts share with items, in parts."""
        for key, (values, owners, places) in self.runs.items():
            if key[0] != walked:
                continue
            hashes = run_hashes(words, key[1])
            hit = np.flatnonzero(self.filters[key][hashes >> np.uint64(64 - _FILTER_BITS)])
            hit = hit[hit + key[1] <= firsts[np.searchsorted(firsts, hit, side="right")]]
            first = np.searchsorted(values, hashes[hit])
            number = np.searchsorted(values, hashes[hit], side="right") - first
            total = np.cumsum(number)
            cuts = np.searchsorted(total, np.arange(_RUNS, int(number.sum()), _RUNS))
            for part in np.split(np.arange(len(hit)), cuts):
                some = number[part]
                which = np.repeat(first[part] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                yield np.repeat(hit[part], some), owners[which], places[which]

    def windows(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, item size) of the windows laid around runs shared with walked items, each once."""
        laid = []
        size_of = np.array([len(w) for w in self.words], np.int64)
        for at, owner, place in self.shared_runs(words, firsts, walked=True):
            size = size_of[owner]
            edits = (self.share * size).astype(np.int64)
            # An edit before the run moves the stretch's start; windows two words apart leave one edit of doubt.
            for move in range(0, int(edits.max(initial=0)) + 1, 2):
                near = edits >= move
                for start in {move, -move}:
                    laid.append(np.stack([at[near] - place[near] + start, at[near], size[near]]))
        laid = np.concatenate(laid, axis=1) if laid else np.empty((3, 0), np.int64)
        text = np.searchsorted(firsts, laid[1], side="right") - 1
        # At a text's edges a stretch may lack words: its window is the part inside.
        start = np.minimum(np.maximum(laid[0], firsts[text]), firsts[text + 1] - 1)
        start, text, size = np.unique(np.stack([start, text, laid[2]]), axis=1)
        return text, start, size

    def regions(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, starts, ends) of regions that hold every stretch into which an item without walks has leaked.

        Such a stretch has all but the allowed edits of the item's words, so regions with fewer go.
        """
        for at, owner, place in self.shared_runs(words, firsts, walked=False):
            text = np.searchsorted(firsts, at, side="right") - 1
            start = at - place
            order = np.lexsort((start, text, owner))
            owner, text, start = owner[order], text[order], start[order]
            changes = np.flatnonzero(owner[1:] != owner[:-1]) + 1
            for part in np.split(np.arange(len(owner)), changes):
                if not len(part):
                    continue
                item = int(owner[part[0]])
                n, edits = len(self.words[item]), self.edits[item]
                low = np.maximum(firsts[text[part]], start[part] - edits)
                high = np.minimum(firsts[text[part] + 1], start[part] + n + edits)
                begin, end = joined(low, high)
                before = np.cumsum(end - begin) - (end - begin)
                reach = np.repeat(begin - before, end - begin) + np.arange((end - begin).sum())
                known = np.append(0, np.cumsum(np.isin(words[reach], self.words[item])))
                within = np.searchsorted(begin, low, side="right") - 1
                moved = before[within] - begin[within]
                enough = known[high + moved] - known[low + moved] >= n - edits
                if enough.any():
                    yield item, *joined(low[enough], high[enough])

    def verify(
        self, words: np.ndarray, firsts: np.ndarray, item: int, low: np.ndarray, high: np.ndarray, best: dict
    ) -> None:
        """Enters the item's nearest stretch in each region words[low:high] that is near enough and the text's best."""
        order = np.argsort(low - high, kind="stable")
        while len(order):
            some, order = np.split(order, [max(1, _CELLS // int(high[order[0]] - low[order[0]]))])
            distance, begin, end = edit_distances(words, low[some], high[some], self.words[item])
            text = np.searchsorted(firsts, low[some], side="right") - 1
            for i in np.flatnonzero(distance <= self.edits[item]).tolist():
                where = int(text[i])
                hit = int(distance[i]), int(begin[i] - firsts[where]), int(end[i] - firsts[where])
                if (where, item) not in best or hit < best[where, item]:
                    best[where, item] = hit

    def search(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of the nearest stretch of each item in each text it leaked into."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.words:
            return
        text, start, size = self.windows(words, firsts)
        ends = firsts[text + 1]
        words = np.append(words, np.uint64(0))
        walks = np.zeros(int(size.max(initial=0)) + 1, np.int64)
        for n, number in self.walks.items():
            if n < len(walks):
                walks[n] = number
        pairs = [np.empty(0, np.int64)]
        for number, (known, owner) in enumerate(self.tables):
            some = np.flatnonzero(walks[size] > number)
            keys = signatures(words, start[some], np.minimum(start[some] + size[some], ends[some]), size[some], number)
            for key in range(KEYS_PER_WALK):
                left = np.searchsorted(known[key], keys[key])
                met = np.searchsorted(known[key], keys[key], side="right") - left
                window = np.repeat(some, met)
                which = np.repeat(left - (np.cumsum(met) - met), met) + np.arange(len(window))
                pairs.append(window * len(self.words) + owner[key][which])
        pairs = np.unique(np.concatenate(pairs))
        by_item: dict[int, list[int]] = defaultdict(list)
        for window, item in zip((pairs // len(self.words)).tolist(), (pairs % len(self.words)).tolist()):
            by_item[item].append(window)
        for item, found in by_item.items():
            n, edits, found = len(self.words[item]), self.edits[item], np.array(found)
            low = np.maximum(firsts[text[found]], start[found] - edits)
            self.verify(words, firsts, item, low, np.minimum(ends[found], start[found] + n + edits), best)
        for item, low, high in self.regions(words[:-1], firsts):
            self.verify(words, firsts, item, low, high, best)
        for (where, item), hit in best.items():
            yield (where, item, *hit)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, item_id, distance, first_word, end_word), one row per document and item leaked into it.

    Words are lower-cased runs of ASCII letters, digits and all characters beyond ASCII. ``distance`` is at most ``share`` of the item's words;
    the first and end word place the nearest stretch. Null text has no words,
    and an item without words leaks nowhere. Items alike are all reported.
    Repeated rows are reported as often as they come. Without documents or items
    there are no rows. Items reach all executors in blocks of ``BLOCK_ITEMS``.
    """
    rows = pick(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    items = pick(benchmark, item_id="item_id", text="text").where("text IS NOT NULL")
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((rows, "doc_id"), (items, "item_id")))
    ddl = f"doc_id {kind}, text_hash long, item_id {item_kind}, distance int, first_word long, end_word long"
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for number in range(blocks):
        listed = [tuple(r) for r in items.where(block == number).sort("item_id", "text").collect()]
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(listed, share, recall))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, words, firsts in words_of(batch.column(1)):
                    hits = list(index.value.search(words, firsts))
                    if not hits:
                        continue
                    text, item, distance, first, end = zip(*hits)
                    where = pa.array([row + t for t in text])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(where), batch.column(2).take(where),
                            pa.array([index.value.ids[i] for i in item]).cast(item_type),
                            pa.array(distance, pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64()),
                        ],
                        names=["doc_id", "text_hash", "item_id", "distance", "first_word", "end_word"],
                    )

        item_type = pa.string() if item_kind == "string" else pa.int32() if item_kind == "int" else pa.int64()
        part = rows.mapInArrow(search, ddl)
        found = part if found is None else found.unionByName(part)
    return found


def remove_leaked(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that no item leaked into, with all their columns; cases as in ``leaks``.

    Texts are shuffled only if the list of leaks is too large for a broadcast.
    """
    bad = settle(leaks(docs, benchmark, **settings).select("doc_id", "text_hash").distinct(), "leaked")
    rows, names = numbered(docs, doc_id="doc_id", text="text")
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = rows["doc_id"].eqNullSafe(bad["doc_id"]) & (rows["text_hash"] == bad["text_hash"])
    return restore(rows.join(bad, same, "left_anti"), names)
