"""Operator 10, language ID: unigram pieces with all segmentations summed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, small_batches, staged, table
from .token_counts import vocabulary_path

#: Learning reads an expected number of whole documents a language, chosen by a hash of doc_id: the bound of its sample.
DOCS_A_LANG = 1500
#: The model has some 73 KB a language on the driver and in each worker; more languages than this are an error.
MOST_LANGS = 4096
MAX_PIECE, EM_ROUNDS = 8, 2
#: Learning, not scoring, cuts longer words, so that a word's probabilities stay within a double.
LEARNED_CHARS = 64
#: Words that a task remembers, numbers that it holds for words walked at once, and steps between two rescalings.
MEMO_WORDS, BATCH_CELLS, RESCALE = 100_000, 1 << 19, 16
#: A text's log likelihood ratios are divided by its number of words, up to this: neighbouring words aren't independent.
TEMPER = 8
UNKNOWN = 1e-7
WORD = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")

#: Letters with a column of the trie's table, those in the most pieces; the steps of all others are looked up by search.
COLUMNS = 255


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and their marks, the same for learning and scoring; marks alone are no word."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or LETTER.search(w)] if text else []


@dataclass
class Lattice:
    """A trie of the pieces over character codes; arrays, so that a batch of words is walked at once."""

    chars: dict[str, int]
    step: np.ndarray  # node, code up to COLUMNS -> node, 0: none
    rare: np.ndarray  # sorted node << 16 | code, for the codes beyond
    rare_to: np.ndarray  # their nodes
    piece: np.ndarray  # node -> piece, -1: none
    n_pieces: int

    def next(self, node: np.ndarray | int, code: np.ndarray) -> np.ndarray:
        beyond = code > COLUMNS
        if not beyond.any():
            return self.step[node, code]
        out = self.step[node, np.where(beyond, 0, code)]
        key = (np.broadcast_to(node, code.shape)[beyond].astype(np.int64) << 16) | code[beyond]
        at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
        out[beyond] = np.where(self.rare[at] == key, self.rare_to[at], 0)
        return out


def read_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters and marks of the fixed vocabulary, without word marks, and all their single characters."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {p.id_to_piece(i).replace("▁", "").lower() for i in range(p.get_piece_size())}
    found = {x for x in found if WORD.fullmatch(x) and len(x) <= MAX_PIECE}
    return sorted(found | {c for x in found for c in x})


def build_lattice(pieces: list[str]) -> Lattice:
    uses: dict[str, int] = {}
    for x in pieces:
        for c in x:
            uses[c] = uses.get(c, 0) + 1
    chars = {c: i + 1 for i, c in enumerate(sorted(uses, key=lambda c: (-uses[c], c)))}
    nodes, ends = [{}], {}
    for k, x in enumerate(pieces):
        at = 0
        for c in x:
            at = nodes[at][chars[c]] if chars[c] in nodes[at] else _add(nodes, at, chars[c])
        ends[at] = k
    step, rare = np.zeros((len(nodes), min(len(chars), COLUMNS) + 1), np.int32), {}
    for i, own in enumerate(nodes):
        for c, j in own.items():
            if c <= COLUMNS:
                step[i, c] = j
            else:
                rare[i << 16 | c] = j
    keys = sorted(rare)
    piece = np.full(len(nodes), -1, np.int32)
    piece[list(ends)] = list(ends.values())
    return Lattice(chars, step, np.array(keys, np.int64), np.array([rare[k] for k in keys], np.int32), piece, len(pieces))


def _add(nodes: list[dict], at: int, code: int) -> int:
    nodes.append({})
    nodes[at][code] = len(nodes) - 1
    return len(nodes) - 1


def coded(words: list[str], lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (padded with 0) and lengths."""
    width = max(map(len, words), default=1)
    raw = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    top = int(raw.max(initial=0)) + 1
    codes = np.zeros(max(top, 1), np.uint16)
    for c, i in lattice.chars.items():
        if ord(c) < top:
            codes[ord(c)] = i
    return codes[raw], np.fromiter(map(len, words), np.int64, len(words))


def forward(codes: np.ndarray, n: np.ndarray, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """log P(word | language), words x languages, summed over every segmentation into pieces; p has a row per piece.

    alpha[i] is the probability of the first i letters; each piece from i to j adds alpha[i] * p(piece). A letter that
    no piece covers steps with the probability UNKNOWN. Only the next MAX_PIECE values are held, and rescaled now and
    then, so words may have any length.
    """
    order = np.argsort(-n, kind="stable")
    codes, n = codes[order], n[order]
    w, width = codes.shape
    ring = np.zeros((MAX_PIECE + 1, w, p.shape[1]))
    ring[0] = 1.0
    scale, out = np.zeros((w, p.shape[1])), np.zeros((w, p.shape[1]))
    ending = np.searchsorted(-n, -np.arange(width + 1), side="right")  # so many words have i letters at least
    for i in range(width + 1):
        some = ending[i]
        alpha = ring[i % (MAX_PIECE + 1)]
        more = ending[i + 1] if i < width else 0
        out[more:some] = np.log(np.maximum(alpha[more:some], 1e-300)) + scale[more:some]
        if not more:
            break
        if i % RESCALE == RESCALE - 1:
            by = np.maximum(alpha[:more], 1e-300)
            scale[:more] += np.log(by)
            ring[:, :more] /= by
        live, node, own = np.arange(more), np.zeros(more, np.int32), codes[:more]
        single = lattice.piece[lattice.next(0, own[:, i])] < 0
        if single.any():
            ring[(i + 1) % (MAX_PIECE + 1), live[single]] += alpha[live[single]] * UNKNOWN
        for j in range(i, min(width, i + MAX_PIECE)):
            ok = j < n[live]
            live, node = live[ok], lattice.next(node[ok], own[live[ok], j])
            ok = node > 0
            live, node = live[ok], node[ok]
            if not len(live):
                break
            hit = lattice.piece[node] >= 0
            at = live[hit]
            ring[(j + 1) % (MAX_PIECE + 1), at] += alpha[at] * p[lattice.piece[node[hit]]]
        ring[i % (MAX_PIECE + 1)] = 0.0
    back = np.empty_like(out)
    back[order] = out
    return back


def in_batches(words: list[str], letters: int) -> Iterator[list[int]]:
    """Indices of words of like lengths, of about so many letters together."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    start = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - start) * len(words[order[end]]) > letters:
            yield order[start:end]
            start = end


def expected_counts(codes: np.ndarray, n: np.ndarray, weight: np.ndarray, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of the weighted words (one language), forward-backward.

    Each letter counts with a factor that makes its word's probability 1; the factors of a word's segmentations are equal.
    """
    w, width = codes.shape
    factor = np.exp(-forward(codes, n, lattice, p[:, None])[:, 0] / np.maximum(n, 1))
    alpha, beta = np.zeros((width + 1, w)), np.zeros((width + 2, w))
    alpha[0] = 1.0
    beta[n, np.arange(w)] = 1.0
    arcs = []
    for i in range(width):
        live = np.nonzero(n > i)[0]
        node = np.zeros(len(live), np.int32)
        single = live[lattice.piece[lattice.next(0, codes[live, i])] < 0]
        alpha[i + 1, single] += alpha[i, single] * UNKNOWN * factor[single]
        arcs.append((i, i, single, None, UNKNOWN * factor[single]))
        for j in range(i, min(width, i + MAX_PIECE)):
            ok = j < n[live]
            live, node = live[ok], node[ok]
            node = lattice.next(node, codes[live, j])
            ok = node > 0
            live, node = live[ok], node[ok]
            if not len(live):
                break
            hit = lattice.piece[node] >= 0
            at, k = live[hit], lattice.piece[node[hit]]
            step = p[k] * factor[at] ** (j + 1 - i)
            alpha[j + 1, at] += alpha[i, at] * step
            arcs.append((i, j, at, k, step))
    for i, j, at, _, step in reversed(arcs):
        beta[i, at] += beta[j + 1, at] * step
    z = np.maximum(alpha[n, np.arange(w)], 1e-290)
    out = np.zeros(len(p))
    for i, j, at, k, step in arcs:
        if k is not None:
            out += np.bincount(k, alpha[i, at] * step * beta[j + 1, at] / z[at] * weight[at], len(p))
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None, docs_a_lang: int = DOCS_A_LANG) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities pieces x languages) from rows with a language; docs holds training rows only.

    Of each language an expected docs_a_lang documents are learned from, whole. Every piece starts equally likely;
    EM_ROUNDS of EM follow, whose expected counts the workers sum: only the model, pieces x languages, reaches the
    driver. All languages are learned; over MOST_LANGS raise an error.
    """
    spark, where = docs.sparkSession, path or vocabulary_path()
    n_pieces = len(read_pieces(where))
    sizes = {r.lang: r.n for r in docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((n_pieces, 0))
    # From an Arrow table, which needs no Python worker beside those of the stages.
    rates = spark.createDataFrame(pa.table({"lang": langs, "rate": [min(1.0, docs_a_lang / sizes[k]) for k in langs]}))
    rows = small_batches(docs).select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.pmod(F.xxhash64(F.lit(10), F.col(doc_id)), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("u"))
    sample = rows.join(F.broadcast(rates), "lang").where("u < rate").select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[tuple[str, str], int] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word in words_of(t.as_py()):
                    for at in range(0, len(word), LEARNED_CHARS):
                        key = (k, word[at : at + LEARNED_CHARS])
                        count[key] = count.get(key, 0) + 1
            a, b = zip(*count) if count else ((), ())
            yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(count.values(), pa.int64())], ["lang", "word", "n"])

    words = staged(sample.mapInArrow(cut, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    at = {k: i for i, k in enumerate(langs)}
    p = np.full((n_pieces, len(langs)), 1.0 / n_pieces)
    for _ in range(EM_ROUNDS):
        model = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            lattice, p, total = build_lattice(read_pieces(where)), model.value, {}
            for batch in batches:
                own: dict[str, list] = {}
                for k, word, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    own.setdefault(k, []).append((word, n))
                for k, some in own.items():
                    found = [x for x, _ in some]
                    for part in in_batches(found, BATCH_CELLS // MAX_PIECE):
                        codes, n = coded([found[i] for i in part], lattice)
                        got = expected_counts(codes, n, np.array([some[i][1] for i in part], float), lattice, np.ascontiguousarray(p[:, at[k]]))
                        total[k] = total.get(k, 0.0) + got
            for k, got in total.items():
                piece = np.nonzero(got)[0]
                yield pa.record_batch([pa.array([at[k]] * len(piece), pa.int32()), pa.array(piece, pa.int32()), pa.array(got[piece])], ["lang", "piece", "c"])

        counts = words.mapInArrow(expect, "lang int, piece int, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toPandas()
        p = np.full((n_pieces, len(langs)), 0.05)
        np.add.at(p, (counts["piece"].to_numpy(), counts["lang"].to_numpy()), counts["c"].to_numpy())
        p /= p.sum(axis=0)
        model.unpersist()
    dropped(words)
    return langs, np.log(p)


class Scorer:
    """Texts -> (predicted language, score), with a bounded memo of words; made once a task."""

    def __init__(self, langs: list[str], logp: np.ndarray, path: str):
        self.langs, self.lattice = langs, build_lattice(read_pieces(path))
        self.p = np.exp(logp.astype(np.float64))
        self.memo: dict[str, int] = {}
        self.known = np.zeros((4096, self.p.shape[1]))

    def learn(self, words: list[list[str]]) -> None:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        fresh = list(dict.fromkeys(w for own in words for w in own if w not in memo))
        while len(memo) + len(fresh) > len(self.known):
            self.known = np.vstack([self.known, np.zeros_like(self.known)])
        for part in in_batches(fresh, BATCH_CELLS // (MAX_PIECE * max(1, len(self.langs)))):
            codes, n = coded([fresh[i] for i in part], self.lattice)
            self.known[len(memo) : len(memo) + len(part)] = forward(codes, n, self.lattice, self.p)
            for i in part:
                memo[fresh[i]] = len(memo)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        preds, scores = [], []
        words = [words_of(t) if self.langs else [] for t in texts]
        self.learn(words)
        for own in words:
            if not own:
                preds.append("und")
                scores.append(0.0)
                continue
            total = self.known[np.fromiter(map(self.memo.__getitem__, own), np.int64, len(own))].sum(axis=0)
            best = int(total.argmax())
            preds.append(self.langs[best])
            scores.append(float(1.0 / np.exp((total - total[best]) / min(TEMPER, len(own))).sum()))
        return preds, scores

    def batch(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        parts = [self(texts[at : at + 64].to_pylist()) for at in range(0, len(texts), 64)]
        return [x for p, _ in parts for x in p], [x for _, s in parts for x in s]


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    score is the posterior of the predicted language (equal priors) with the log likelihood ratios divided by the number
    of words, up to TEMPER, since words aren't independent. Every distinct word of a batch goes through the forward
    algorithm once, a bounded memo keeps its log probabilities, and a text's score is the sum over all its words; words
    of any length are scored whole. `und` with score 0 if the text is null, empty or has no letter, or if no language
    was learned. Ties go to the first language in order. Repeated rows and null ids are scored each; further columns
    are ignored; an empty table gives no rows.
    """
    where = path or vocabulary_path()
    model = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(langs, model.value, where)
        for batch in batches:
            preds, scores = score.batch(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def in_a_language(docs: DataFrame, langs: list[str], logp: np.ndarray, least: float, text: str = "text", path: str | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language identify() finds with a score of `least` or more. Only texts go to
    the Python workers; each row is decided in place."""
    where = path or vocabulary_path()
    model = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))

    @F.arrow_udf("boolean")
    def clear(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = Scorer(langs, model.value, where)
        for column in texts:
            yield pa.array([x != "und" and s >= least for x, s in zip(*score.batch(column))], pa.bool_())

    return small_batches(docs).where(clear(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """True for the fold that is never learned from; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, logp = train(docs.where(~held_out()))
    return identify(docs, langs, logp).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
