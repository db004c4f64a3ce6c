"""Operator 1, n-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists of shingles."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BITMAP, WORD, connected, dropped, has_bit, join_groups, only_marked, slot_of, slots_for, small_batches, staged, table

#: Shingles that a block of a cluster holds at most, about: a larger cluster is searched in several blocks.
BLOCK_SHINGLES = 1 << 19
#: Documents of a large cluster that every block of it holds, to connect what the blocks find.
PIVOTS = 16
#: DivideSkip's weight of the longest list against the number set aside, and the entries up to which the short lists go
#: through a heap; more are counted in one pass, since a heap in Python costs some 0.3 microseconds an entry.
MU, HEAP_ENTRIES = 0.0085, 1 << 11
#: So many candidates are probed one by one; more at once, and a long list of under PROBE times their number is added whole.
FEW, PROBE = 16, 8
#: A document's posted prefix is longer than the least one by this share of its size; pairs then share as many more shingles.
EXTRA = 0.06
#: Lowest bits of a shingle's hash that aren't shuffled where shingles are only counted and documents clustered. Shingles that
#: differ in no other bit count as one there, which leaves in more and loses nothing; the search has all bits.
LOW_BITS = 16
#: A shingle's level is the number of these that its documents reach; a filter of at most MAX_SLOTS slots has a bitmap for each.
LEVELS, MAX_SLOTS = (2, 3, 5, 17, 257), 1 << 26
#: Rows of an Arrow batch where rows are single shingles.
SHINGLE_ROWS = 1 << 16
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_words = re.compile(WORD).findall


#: Words whose hashes a task remembers.
MEMO_WORDS = 150_000


class _Hashes(dict):
    """Word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Whole text -> sorted distinct 64-bit hashes of its n-word shingles."""

    def __init__(self, n: int):
        self.n, self.memo = n, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = _words(text.translate(LOWER)) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """Overlap with any partner that a set of n needs: the union has n at least."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + int(EXTRA * n) + 1)


def least_shared(n: int, percent: int) -> int:
    """Shingles of a posted prefix that some partner has posted as well: as the smaller partner's surplus."""
    return int(EXTRA * least_overlap(n, percent)) + 1


def with_level(rows: DataFrame, shared: DataFrame, slots: int) -> DataFrame:
    """rows with a column level of their gram, from shared(gram, df): never lower than df's, 0 only if shared lacks the gram.

    All grams of a filter slot have the level of the most frequent one. The filter is broadcast, so rows stay in their order.
    """
    marked = shared.select(slot_of(F.col("gram"), slots).alias("slot"), "df").groupBy(F.expr(f"slot div {BITMAP}").alias("bucket"))
    bits = marked.agg(*(F.expr(f"bitmap_construct_agg(slot % {BITMAP}) filter (where df >= {least})").alias(f"level{k}") for k, least in enumerate(LEVELS)))
    placed = rows.withColumn("slot", slot_of(F.col("gram"), slots)).withColumn("bucket", F.expr(f"slot div {BITMAP}")).withColumn("at", F.expr(f"cast(slot % {BITMAP} as int)"))
    level = F.when(~has_bit("level0", "at"), 0)
    for k in range(1, len(LEVELS)):
        level = level.when(~has_bit(f"level{k}", "at"), k)
    return placed.join(F.broadcast(bits), "bucket", "left").select(*rows.columns, level.otherwise(len(LEVELS)).alias("level"))


def rarest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(id, gram) of the grams by which a document is clustered, from (id, n, gram, level): n rows in a row for each document.

    Of the grams of a level above 0, in order of level and gram, as many as two linked sets can't avoid to share one of.
    """
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(k).to_numpy() for k in range(4)])
        rows += batch.num_rows
        if rows < held[0][1][0]:
            continue
        i, n, gram, level = (np.concatenate(x) for x in zip(*held))
        starts, end = [], 0
        while end < rows and end + n[end] <= rows:
            starts.append(end)
            end += int(n[end])
        size = n[starts]
        owner = np.repeat(np.arange(len(starts)), size)
        if (i[:end] != np.repeat(i[starts], size)).any():
            raise RuntimeError("a document's shingles aren't in a row")
        shared = np.nonzero(level[:end] > 0)[0]
        shared = shared[np.lexsort((gram[shared], level[shared], owner[shared]))]
        k = np.bincount(owner[shared], minlength=len(starts))
        most = k + percent * size // -100 + 1  # k - least_overlap(n) + 1
        taken = shared[np.arange(len(shared)) - np.repeat(np.cumsum(k) - k, k) < np.repeat(most, k)]
        yield pa.record_batch([pa.array(i[taken]), pa.array(gram[taken])], ["id", "gram"])
        held, rows = ([[x[end:] for x in (i, n, gram, level)]], rows - end) if end < rows else ([], 0)
    if rows:
        raise RuntimeError("a document's last shingles are missing")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in sets)])))


def heap_merge(lists: list[list[int]], weights: list[int], low: int, high: int, least: int) -> dict[int, int]:
    """Entries from low up to high that lists of `least` weight in all hold at least, with that weight.

    The heap holds the next entry of each list. Where the smallest entry has too little weight, more lists are popped as
    long as those popped weigh too little even together: none of them can reach `least` before the heap's new top, so
    they skip on to it by binary search.
    """
    at = [bisect_left(own, low) for own in lists]
    n = len(lists)
    heap = [own[i] * n + k for k, (own, i) in enumerate(zip(lists, at)) if i < len(own) and own[i] < high]
    heapify(heap)
    out: dict[int, int] = {}
    while heap:
        top, k = divmod(heappop(heap), n)
        popped, weight = [k], weights[k]
        while heap and heap[0] < (top + 1) * n:
            popped.append(heappop(heap) % n)
            weight += weights[popped[-1]]
        if weight >= least:
            out[top] = weight
            onward = top + 1
        else:
            while heap and weight + weights[heap[0] % n] < least:
                popped.append(heappop(heap) % n)
                weight += weights[popped[-1]]
            if not heap:
                break
            onward = heap[0] // n
        for k in popped:
            own = lists[k]
            i = at[k] = bisect_left(own, onward, at[k])
            if i < len(own) and own[i] < high:
                heappush(heap, own[i] * n + k)
    return out


class Lists:
    """Inverted lists over a block of sets in order of size. Shingles with equal lists are one list with their number as weight."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, [len(s) for s in sets]
        self.sizes = np.array(self.size, np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((owner, every))
        self.keys, start = np.unique(every[order], return_index=True)
        self.owner = owner[order]
        # Lists are equal if their members' random numbers have equal sums.
        random = np.random.default_rng(1).integers(0, 1 << 63, max(1, len(sets)), np.uint64)
        sums = np.add.reduceat(random[self.owner], start) if len(start) else np.zeros(0, np.uint64)
        _, first, self.list_of = np.unique(sums, return_index=True, return_inverse=True)
        self.first, self.last = start[first], np.append(start, len(every))[first + 1] if len(first) else start
        self.df = self.last - self.first
        self.held: dict[int, list[int]] = {}

    def members(self, k: int) -> list[int]:
        if k not in self.held:
            self.held[k] = self.owner[self.first[k] : self.last[k]].tolist()
        return self.held[k]

    def search(self, query: np.ndarray) -> list[int]:
        """Members linked with the query, by DivideSkip.

        Only members of a fitting size are searched, which are a range. A member needs `need` shingles of the query at
        least. The longest lists of under that weight are set aside, the fewer the longer the longest is; the short ones
        are merged by a heap that skips; members that reach what is left of `need` are looked up in the long lists by
        binary search until they can't reach the overlap that the two sizes need. The overlap is then exact.
        """
        n, percent, size = len(query), self.percent, self.size
        low = bisect_left(size, least_overlap(n, percent))
        high = bisect_right(size, 100 * n // percent)
        need = least_overlap(n, percent)
        at = np.searchsorted(self.keys, query)
        at = np.minimum(at, len(self.keys) - 1)
        which, weight = np.unique(self.list_of[at[self.keys[at] == query]], return_counts=True) if low < high else ([], [])
        if low >= high or weight.sum() < need:
            return []
        order = np.argsort(self.df[which], kind="stable")
        which, weight = which[order].tolist(), weight[order].tolist()
        most = min(need - 1, need / (MU * math.log(int(self.df[which[-1]]) + 1) + 1))
        cut, aside = len(which), 0
        while cut and aside + weight[cut - 1] <= most:
            cut -= 1
            aside += weight[cut]
        if self.df[which[:cut]].sum() <= HEAP_ENTRIES:
            count = heap_merge([self.members(k) for k in which[:cut]], weight[:cut], low, high, need - aside)
            if len(count) <= FEW:
                return [m for m, got in count.items() if self._reaches(m, got, n, which[cut:], weight[cut:], aside)]
            some = np.fromiter(count, np.int64, len(count))
            sums = np.zeros(len(size), np.int64)
            sums[some] = list(count.values())
        else:
            sums = np.zeros(len(size), np.int64)
            for k, w in zip(which[:cut], weight):
                sums[self.owner[self.first[k] : self.last[k]]] += w
            some = low + np.nonzero(sums[low:high] >= need - aside)[0]
        wanted = -(-percent * (n + self.sizes) // (100 + percent))
        for k, w in zip(which[cut:], weight[cut:]):
            some = some[sums[some] + aside >= wanted[some]]
            if not len(some):
                return []
            own, aside = self.owner[self.first[k] : self.last[k]], aside - w
            if len(some) * PROBE < len(own):
                i = np.minimum(np.searchsorted(own, some), len(own) - 1)
                sums[some[own[i] == some]] += w
            else:
                sums[own] += w
        return some[sums[some] >= wanted[some]].tolist()

    def _reaches(self, m: int, got: int, n: int, lists: list[int], weights: list[int], rest: int) -> bool:
        """Whether member m, with got shingles in common so far, has the overlap that 100 * overlap >= percent * union asks for."""
        wanted = -(-self.percent * (n + self.size[m]) // (100 + self.percent))
        for k, w in zip(lists, weights):
            if got >= wanted or got + rest < wanted:
                break
            own, rest = self.members(k), rest - w
            i = bisect_left(own, m)
            got += w * (i < len(own) and own[i] == m)
        return got >= wanted


def search_block(own: list[tuple[int, int, bool, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Edges (id, id) that connect what is linked in a block of (id, label, is query only, set).

    Every link comes from a search. Rows that are query only search the members. Without such rows all members search,
    the most typical first; as soon as one component holds more than half of the members, those in it needn't search
    any more: a pair that isn't connected yet has a side that searches. Equal labels are known to be connected.
    """
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    members = sorted((x for x in own if not x[2]), key=lambda x: (len(x[3]), x[0]))
    queries = [x for x in own if x[2]]
    if not members or len(members) < 2 and not queries:
        return []
    lists = Lists([x[3] for x in members], percent)
    for x in own:
        parent[root(("id", x[0]))] = root(("label", x[1]))
    edges, size, main = [], {}, None
    for x in members:
        r = root(("id", x[0]))
        size[r] = size.get(r, 0) + 1
    if not queries:
        if len(size) < 2:
            return []
        held = np.repeat(np.arange(len(members)), lists.size)
        every = lists.df[lists.list_of[np.searchsorted(lists.keys, np.concatenate([x[3] for x in members]))]]
        typical = np.bincount(held, every) / np.maximum(lists.size, 1)
        queries = [members[k] for k in np.argsort(-typical, kind="stable").tolist()]
    for i, _, extra, s in queries:
        if not extra and main is not None and root(("id", i)) == root(main):
            continue
        for m in lists.search(s):
            a, b = root(("id", i)), root(("id", members[m][0]))
            if a != b:
                parent[a] = b
                size[b] = size.get(b, 0) + size.pop(a, 0)
                edges.append((i, members[m][0]))
                if not extra and main is None and 2 * size[b] > len(members):
                    main = b
    return edges


def _search(blocks: DataFrame, percent: int) -> DataFrame:
    """Runs search_block over blocks(cluster, part, id, label, extra, grams); a block's rows meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def ended():
            edges = search_block(own, percent) if len(own) > 1 else []
            a, b = zip(*edges) if edges else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            c, p, i, l, e = (batch.column(k).to_pylist() for k in range(5))
            grams = batch.column(5)
            for k in range(len(c)):
                if (c[k], p[k]) != key:
                    if len(own) > 1:
                        yield ended()
                    key, own = (c[k], p[k]), []
                own.append((i[k], l[k], e[k], grams[k].values.to_numpy().view(np.uint64)))
        if len(own) > 1:
            yield ended()

    rows = blocks.select("cluster", "part", "id", "label", "extra", "grams").repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return rows.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, ngram: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of ngram-word shingles (A-Z lowered; a
    shorter text is one shingle). component_id is the smallest doc_id that links reach, itself included.

    1. Equal sets become one representative; the members only follow it.
    2. Representatives post the prefix of their hashes in the order of a fixed permutation. Linked sets share at least
       EXTRA of their size in the prefixes, so a document with fewer posted shingles that another posts is left out.
    3. The shingles of those left are counted, once over the network; a filter of bounded size tells a shingle's level
       in place, 0 if no other document holds it. A document with fewer than percent above 0 links with nothing. The
       others are clustered by their shingles of the lowest levels, as many as two linked sets can't avoid to share one
       of; only connected clusters can hold links. Any order that depends on the shingle alone gives the same links.
    4. A cluster is searched in one task, or in blocks of BLOCK_SHINGLES with common pivots, whose links give labels;
       then the documents outside a cluster's largest label search every other block. Every pair of different sets is
       thereby decided or already connected. DivideSkip finds the members that reach the required overlap; no link is
       found otherwise. Edges are at most as many as a block's rows.

    Null or empty texts have n_shingles 0, link with nothing and are their own component. Rows with a null doc_id get
    the component of their equal set if that has an id, else null. Repeated rows are kept; rows that share a doc_id
    count as one node. Texts of any length are taken whole. Further columns are ignored; an empty table gives no rows.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(ngram)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                n, a, b, posted = [], [], [], []
                for t in batch.column(1)[at : at + 256]:
                    s = cut(t.as_py())
                    raw = s.tobytes()
                    n.append(len(s))
                    a.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                    b.append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                    posted.append(s[: prefix_length(len(s), percent)] >> np.uint64(LOW_BITS))
                kind = pa.int64()
                yield pa.record_batch([batch.column(0)[at : at + 256], pa.array(n, kind), pa.array(a, kind), pa.array(b, kind), _lists(posted)], ["doc_id", "n", "h1", "h2", "posted"])

    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = staged(rows.mapInArrow(shingles, "doc_id long, n long, h1 long, h2 long, posted array<long>"))
    same = ["n", "h1", "h2"]
    ids = staged(cut.select("doc_id", *same))
    total = ids.count()
    groups = staged(ids.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    # Copies post nothing, but for a few that share a filter slot with a representative: more shingles count as shared then.
    rep_slot = lambda c: slot_of(F.xxhash64(c), slots_for(total)).alias("slot")
    reps = only_marked(cut.where("n > 0").select(F.col("doc_id").alias("id"), "n", "posted", rep_slot("doc_id")), groups.select(rep_slot("rep"))).where("maybe and id is not null")
    kept = reps.select("id", "n", F.explode("posted").alias("gram"))
    shared = staged(kept.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))
    slots = slots_for(shared.count())
    slot = slot_of(F.col("gram"), slots).alias("slot")
    posts = staged(only_marked(kept.select("*", slot), shared.select(slot)).where("maybe").select("id", "n", "gram"))
    dropped(cut)
    need = F.floor(F.lit(EXTRA) * F.ceil(F.col("n") * percent / 100)) + 1
    enough = join_groups(posts, shared, ["gram"], "df", posts.count()).where("df is not null").groupBy("id", "n").agg(F.count("*").alias("k")).where(F.col("k") >= need)
    left = staged(enough.join(groups.select(F.col("rep").alias("id"), "n"), ["id", "n"], "left_semi").select("id").distinct())
    dropped(shared, posts)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(ngram)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), _lists(grams := [cut(t.as_py()) for t in part.column(1)]), pa.array([len(g) for g in grams], pa.int64())], ["id", "grams", "n"])

    # A row more that only shares a filter slot does no harm, so texts aren't joined by id.
    id_slot = slot_of(F.xxhash64("id"), slots_for(left.count())).alias("slot")
    some = only_marked(rows.withColumnRenamed("doc_id", "id").select("*", id_slot), left.select(id_slot)).where("maybe")
    full = staged(some.select("id", "text").mapInArrow(sets, "id long, grams array<long>, n long").where("n > 0 and id is not null"))
    dropped(left)
    every = full.select("id", "n", F.explode("grams").alias("gram")).withColumn("gram", F.shiftrightunsigned("gram", LOW_BITS))
    shared = staged(every.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))
    found = with_level(every, shared, min(MAX_SLOTS, slots_for(shared.count(), 8)))
    posts = staged(found.mapInArrow(lambda batches: rarest(batches, percent), "id long, gram long"), SHINGLE_ROWS)
    dropped(shared)
    heads = staged(posts.groupBy("gram").agg(F.count("*").alias("df"), F.min("id").alias("head")).where("df > 1"))
    pairs = staged(join_groups(posts, heads, ["gram"], "df", posts.count()).where("df is not null and id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct())
    dropped(posts, heads)
    nodes = connected(pairs)
    # A cluster's size in shingles tells its number of blocks.
    sized = full.groupBy("id").agg(F.sum("n").alias("n")).join(nodes.select(F.col("node").alias("id"), F.col("label").alias("cluster")), "id")
    members = staged(sized)
    dropped(pairs, nodes)
    sizes = staged(members.groupBy("cluster").agg(F.count("*").alias("size"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts")))
    placed = join_groups(members.select("id", "cluster"), sizes, ["cluster"], "size", members.count())
    placed = staged(placed.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), "parts").cast("int")))
    dropped(members, sizes)
    base = placed.select("id", "cluster", "part", F.col("id").alias("label"), F.lit(False).alias("extra"))
    large = placed.where("parts > 1")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to")
    pivots = large.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) < F.lit(float(PIVOTS)) / F.col("size") * (1 << 30)).select("*", everywhere).where("to <> part")
    blocks = base.unionByName(pivots.select("id", "cluster", F.col("to").alias("part"), F.col("id").alias("label"), F.lit(False).alias("extra")))
    id_slot = slot_of(F.xxhash64("id"), slots_for(placed.count())).alias("slot")
    clustered = only_marked(full.select("id", "grams", id_slot), placed.select(id_slot)).where("maybe").select("id", "grams")
    with_sets = lambda b: b.join(clustered, "id")
    edges = staged(_search(with_sets(blocks), percent))
    if not large.isEmpty():
        labels = connected(edges)
        again = staged(large.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")))
        by_label = again.groupBy("cluster", "label").count()
        main = staged(by_label.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"), F.sum("count").alias("rows")).where("labels > 1"))
        mixed = staged(join_groups(again, main, ["cluster"], "rows", again.count()).where("main is not null"))
        others = mixed.where("label <> main").select("*", everywhere).where("to <> part")
        columns = ["id", "cluster", "label"]
        crossed = mixed.select(*columns, "part", F.lit(False).alias("extra")).unionByName(others.select(*columns, F.col("to").alias("part"), F.lit(True).alias("extra")))
        first, edges = edges, staged(edges.unionByName(_search(with_sets(crossed), percent)))
        dropped(labels, again, main, mixed, first)
    dropped(full, placed)
    labels = connected(edges)
    named = staged(groups.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*same, "members", F.coalesce("label", "rep").alias("component")))
    dropped(edges, labels, groups)
    out = join_groups(ids, named, same, "members", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)
