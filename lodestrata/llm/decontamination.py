"""Operator 2, benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WORDS = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score as a share of a full match of the item, and least number of matched words' worth of score.
LEAST_SHARE, LEAST_WORDS = 0.5, 6
#: Words of benchmark items that one block broadcasts at most; a larger benchmark is matched block by block.
BLOCK_WORDS = 2_000_000


#: Places of items' words in a text that are held at once.
PLACES = 1_000_000


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from first on, n of each, one range after another, and the range that each is of."""
    of = np.repeat(np.arange(len(n)), n)
    return (first - np.cumsum(n) + n)[of] + np.arange(len(of)), of


class Items:
    """A block of test items as word numbers, with the pairs of neighbouring words of each.

    Items of fewer than LEAST_WORDS words are kept apart: only a text of just these words is a copy of one.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        cut = [(i, WORDS.findall((t or "").lower())) for i, t in rows]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, w in cut:
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(tuple(w), []).append(i)
        rows = [(i, w) for i, w in cut if len(w) >= LEAST_WORDS]
        self.ids = [i for i, _ in rows]
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in own], np.int64) for _, own in rows]
        own = [np.unique(self.codes(w[:-1], w[1:]) if len(w) > 1 else w) for w in self.words]
        every = np.concatenate([np.zeros(0, np.int64), *own])
        owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.pairs, at, count = np.unique(every, return_inverse=True, return_counts=True)
        self.start = np.concatenate([[0], np.cumsum(count)])
        self.owner = owner[np.argsort(at, kind="stable")]
        self.own_pairs = [np.searchsorted(self.pairs, x) for x in own]
        self.least_apart = np.array([max(1, len(w) - 3) if len(w) > LEAST_WORDS else np.iinfo(np.int64).max for w in self.words], np.int64)
        words, uses = zip(*(np.unique(w, return_counts=True) for w in self.words)) if rows else ((), ())
        self.own_words, self.own_uses = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (words, uses))
        self.word_start = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self.need = MATCH * np.array([max(min(LEAST_WORDS, len(w)), LEAST_SHARE * len(w)) for w in self.words], float)
        self.word_mark, self.pair_mark = np.zeros(len(self.vocab) + 1, bool), np.zeros(len(self.pairs) + 1, bool)

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each pair of word numbers, -1 if one is of no item; an item of one word has that word's number."""
        return np.where((a > 0) & (b > 0), a * (len(self.vocab) + 1) + b, -1)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code among the items' pairs, their number if absent."""
        at = np.searchsorted(self.pairs, codes)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == codes[known]
        return np.where(known, at, len(self.pairs))

    def owners(self, places: np.ndarray) -> np.ndarray:
        """The items that hold each place, one after another."""
        return self.owner[_ranges(self.start[places], self.start[places + 1] - self.start[places])[0]]

    def candidates(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Items that an alignment may reach: those with two neighbouring words next to each other in the text, or with
        almost all neighbours one word apart there."""
        known = len(self.pairs)
        found = [self.owners(np.unique(x[x < known])) for x in (near, self.places(np.unique(ids[ids > 0])))]
        apart = self.places(self.codes(ids[:-2], ids[2:]))
        count = np.bincount(self.owners(apart[apart < known]), minlength=len(self.words))
        return np.unique(np.concatenate([*found, np.nonzero(count >= self.least_apart)[0]]))

    def reached(self, ids: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Those of the items for which MATCH for each of their words in some stretch of the text, less a mismatch or gap
        for each other word in it, is the score needed at least. Bounded memory, however many items there are."""
        if not len(some):
            return some
        at = np.argsort(ids, kind="stable")
        count = np.bincount(ids, minlength=len(self.vocab) + 1)
        first = np.cumsum(count) - count
        words, item = _ranges(self.word_start[some], self.word_start[some + 1] - self.word_start[some])
        n = count[self.own_words[words]]
        keep = MATCH * np.bincount(item, np.minimum(n, self.own_uses[words]), len(some)) >= self.need[some]
        some, n = some[keep], np.bincount(item, n, len(some)).astype(np.int64)[keep]
        part, out = np.cumsum(n) // PLACES, [np.zeros(0, np.int64)]
        for k in np.unique(part):
            own = some[part == k]
            words, item = _ranges(self.word_start[own], self.word_start[own + 1] - self.word_start[own])
            word = self.own_words[words]
            places, of = _ranges(first[word], count[word])
            item, place = np.divmod(np.sort(item[of] * len(ids) + at[places]), len(ids))
            total = (MATCH - max(MISMATCH, GAP)) * np.arange(len(item)) + max(MISMATCH, GAP) * place
            # Each item's sums start below those of the items before it.
            total -= item * (MATCH * len(item) + 2 * len(item) + 2 * len(ids) + 2)
            best = total - np.minimum.accumulate(total) + MATCH
            out.append(own[np.bincount(item[best >= self.need[own][item]], minlength=len(own)) > 0])
        return np.concatenate(out)

    def number(self, words: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words], np.int64)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(score, end in b) of the best local alignment of two sequences of word numbers (0: a word of no item)."""
    step = np.arange(len(b) + 1) * -GAP
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        new = row + GAP
        np.maximum(new[1:], row[:-1] + (MISMATCH + (MATCH - MISMATCH) * (b == x)), out=new[1:])
        row = np.maximum.accumulate(np.maximum(new, 0) + step) - step
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def stretches(own: np.ndarray, paired: np.ndarray, need: float) -> list[tuple[int, int]]:
    """Stretches of a text that hold every alignment of the score needed.

    own: whether the item has the word; paired: whether the item has the word and the next as neighbours. An alignment
    scores MATCH for a word that it matches, at most, and a mismatch or gap for any other word of the text; two matched
    words next to each other that are no neighbours in the item cost a gap. The greatest sum of these over any stretch
    is thus at least the score.
    """
    gain = np.where(own, MATCH, max(MISMATCH, GAP))
    gain[1:] += GAP * (own[1:] & own[:-1] & ~paired)
    total = np.concatenate([[0], np.cumsum(gain)])
    ending = total[1:] - np.minimum.accumulate(total)[:-1]
    # The first word of a stretch has no neighbour in it.
    if ending.max() - GAP < need:
        return []
    starting = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
    hot = np.concatenate([[0], ending + starting - gain - GAP >= need, [0]]).astype(np.int8)
    return list(zip(np.nonzero(np.diff(hot) > 0)[0].tolist(), np.nonzero(np.diff(hot) < 0)[0].tolist()))


def matches(text: str, items: Items) -> list[tuple[int, float, int]]:
    """(item id, share of a full match, word where the alignment ends) of items that the text holds."""
    words = WORDS.findall(text.lower())
    if len(words) < LEAST_WORDS:
        return [(i, 1.0, len(words)) for i in items.short.get(tuple(words), ())]
    ids = items.number(words)
    near = items.places(items.codes(ids[:-1], ids[1:]))
    out = []
    for k in items.reached(ids, items.candidates(ids, near)).tolist():
        a = items.words[k]
        need = items.need[k]
        items.word_mark[a] = True
        own = items.word_mark[ids]
        items.word_mark[a] = False
        items.pair_mark[items.own_pairs[k]] = True
        paired = items.pair_mark[near]
        items.pair_mark[items.own_pairs[k]] = False
        best, end = 0, 0
        unique = slice(items.word_start[k], items.word_start[k + 1])
        for first, last in stretches(own, paired, need):
            # An item's word matches as often as the item has it, at most.
            count = np.bincount(ids[first:last], minlength=len(items.word_mark))[items.own_words[unique]]
            if MATCH * np.minimum(count, items.own_uses[unique]).sum() < need:
                continue
            score, e = align(a, ids[first:last])
            if score > best:
                best, end = score, first + e
        if best >= need:
            out.append((items.ids[k], best / (MATCH * len(a)), end))
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[list, str]:
    """Broadcast blocks of Items, of about BLOCK_WORDS words each, and the type of the ids."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    words = items.agg(F.sum(F.length("text") - F.length(F.translate("text", " \n\t", "")) + 1)).first()[0] or 0
    blocks, out = int(words // BLOCK_WORDS) + 1, []
    for k in range(blocks):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        # As bytes that hold the class by value: workers need not be able to import this package.
        out.append(benchmark.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Items(own))))
    return out, items.schema["item_id"].dataType.simpleString()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, score, end_word): the document holds an exact, paraphrased or edited copy of the item.

    Items are aligned with a document by Smith-Waterman over words, where a bound on the score reaches LEAST_SHARE of
    that of a full match. The seeds are pairs of words. An alignment of that share without two neighbouring words of the
    item next to each other in the text leaves an error between any two matches, so it matches all words of the item
    but one at least and has nearly all neighbours one word apart; these are the seeds as well, counted. No pair of
    that share is lost, however the copy was edited. One pass maps whole texts; nothing shuffles. The benchmark is
    collected in blocks of about BLOCK_WORDS words; a single item has to fit the driver and a worker.

    An item of fewer than LEAST_WORDS words says too little inside a text: only texts of just its words match, with score
    1. Null or empty texts and items match nothing. Texts of any length are taken whole. Rows with a null doc_id give
    pairs with a null doc_id; repeated rows give repeated pairs. An empty table on either side gives no rows. Further
    columns are ignored.
    """
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks, item_kind = _blocks(benchmark, item_id, item_text)
    parts = []
    for block in blocks:

        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = pickle.loads(block.value)
            for batch in batches:
                own = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in matches(t.as_py() or "", items)]
                c = list(zip(*own)) or [()] * 4
                yield pa.record_batch([pa.array(c[0], batch.schema.field(0).type), pa.array(c[1]).cast(pa.int64()) if item_kind == "bigint" else pa.array(c[1], pa.string()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64())], ["doc_id", "item_id", "score", "end_word"])

        parts.append(rows.mapInArrow(find, f"doc_id {kind}, item_id {'long' if item_kind == 'bigint' else 'string'}, score double, end_word long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _holds_none(block):
    """A predicate on texts: whether the text holds no copy of an item of the block."""

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = pickle.loads(block.value)
        for column in texts:
            yield pa.array([not matches(t.as_py() or "", items) for t in column], pa.bool_())

    return clean


def without_copies(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no copy of an item in the sense of decontaminate(); each row is decided in
    place, in one scan for all blocks of items, and only texts go to the workers. Null and empty texts stay."""
    out = small_batches(docs)
    for block in _blocks(benchmark, item_id, item_text)[0]:
        out = out.where(_holds_none(block)(F.col(text)))
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
