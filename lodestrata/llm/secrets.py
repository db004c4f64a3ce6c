"""Operator 5, secret scans: fixed patterns, and a battery of randomness tests for further spans."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more among all runs
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Inferred encodings, the smallest alphabet that holds the run first. Numbers are never reported.
ENCODINGS = {"decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_", "mixed": _UPPER + _LOWER + _DIGITS + "+/-_"}
#: Language is modelled over 28 symbols: letters without case, any digit, any separator; BREAK is every other character.
SYMBOLS, DIGIT, SEPARATOR, BREAK = 28, 26, 27, 28
#: Frequencies of the letters a to z in English text, percent (fixed values), for the prior of the pairs.
ENGLISH = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Of the pairs' distribution, LEARNED comes from the corpus (with so many pairs of the prior beside its counts), the rest from the prior.
LEARNED, PRIOR_PAIRS = 0.5, 1000
#: Written runs differ among each other: the standard deviation of a test's mean per character between them, as a share of
#: its distance between language and uniform characters.
SPREAD = 0.12
#: Runs are judged beside those of their length only; the least length of each band.
BANDS = (20, 24, 32, 48, 96)
#: Steps of -log10 p in the counts, and the last of them.
STEP, LAST = 0.25, 80
FALSE_DISCOVERIES, LEAST_RANDOM = 0.001, 0.001


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_sf(x: float, k: int) -> float:
    """Wilson-Hilferty approximation of the upper tail."""
    return _normal_sf(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def _symbol(c: str) -> int:
    low = c.lower()
    return ord(low) - 97 if "a" <= low <= "z" else DIGIT if c in _DIGITS else SEPARATOR


def _prior() -> np.ndarray:
    """P(next symbol | symbol) of written runs before any text is seen."""
    letters = np.array(ENGLISH) / sum(ENGLISH)
    row = lambda letter, digit, separator: np.concatenate([letter * letters, [digit, separator]])
    return np.stack([row(0.94, 0.02, 0.04)] * 26 + [row(0.15, 0.7, 0.15), row(0.8, 0.15, 0.05)])


class Language:
    """What the tests expect of written language and of uniform characters, by encoding.

    pairs: how often each symbol follows each other in the words of the corpus, SYMBOLS x SYMBOLS.
    """

    def __init__(self, pairs: np.ndarray):
        prior = _prior()
        first = np.append(np.array(ENGLISH) / sum(ENGLISH) * 0.94, [0.02, 0.04])
        seen = pairs + PRIOR_PAIRS * first[:, None] * prior
        joint = LEARNED * seen / seen.sum() + (1 - LEARNED) * first[:, None] * prior
        follows = joint / joint.sum(1, keepdims=True)
        digit, separator = np.arange(SYMBOLS) == DIGIT, np.arange(SYMBOLS) == SEPARATOR
        apart = separator[:, None] | separator
        change = (digit[:, None] != digit) & ~apart
        self.encodings = {}
        for name, alphabet in ENCODINGS.items():
            uniform = np.bincount([_symbol(c) for c in alphabet], minlength=SYMBOLS) / len(alphabet)
            held = uniform > 0
            odds = np.where(apart, 0, np.log(follows / np.where(held, uniform, 1)))
            spoken = np.where(held[:, None] & held, joint, 0)
            spoken /= spoken.sum()
            both = uniform[:, None] * uniform
            moments = lambda x: ((spoken * x).sum(), (spoken * x * x).sum() - (spoken * x).sum() ** 2, (both * x).sum())
            # A symbol's share is spread evenly over its characters; of two cases one may hold most letters, or both half.
            characters = np.where(held, uniform * len(alphabet), 1)
            excess = len(alphabet) * (spoken.sum(1) ** 2 / characters).sum() - 1
            self.encodings[name] = ({c: i for i, c in enumerate(alphabet)}, [_symbol(c) for c in alphabet], odds.tolist(), moments(odds), moments(change.astype(float)), max(0.0, excess))

    def battery(self, run: str) -> tuple[str, float, float]:
        """(encoding, p_random, p_language) of a run of characters, each Bonferroni's combination of three tests.

        p_random, uniform characters of the inferred alphabet as the null: chi-squared uniformity, runs above and below the
        median, serial correlation. p_language, written language of this length as the null: its excess chi-squared
        against uniformity, its runs of letters and digits, and its serial dependence (log odds of each symbol after the one
        before against a uniform one), whose means and variances by encoding come from the corpus and grow with the length.
        What stands beside a separator says nothing, as identifiers and paths are made of words.
        """
        body = run.rstrip("=")
        held = set(body)
        name, (at, symbol, odds, serial, kinds, excess) = next((e, x) for e, x in self.encodings.items() if held <= x[0].keys())
        n, k = len(body), len(at)
        if name == "decimal":
            return name, 0.0, 1.0
        v = [at[c] for c in body]
        chi2 = k / n * sum(c * c for c in Counter(v).values()) - n
        high = [i >= k / 2 for i in v]
        ones = sum(high)
        zeros = n - ones
        if ones and zeros:
            runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
            mean = 2 * ones * zeros / n + 1
            p_runs = 2 * _normal_sf(abs(runs - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1))))
        else:
            p_runs = 2.0 ** (1 - n)
        m, s2 = (k - 1) / 2, (k * k - 1) / 12
        r = sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / ((n - 1) * s2)
        p_random = min(1.0, 3 * min(_chi2_sf(chi2, k - 1), p_runs, 2 * _normal_sf(abs(r) * math.sqrt(n - 1))))
        u = [symbol[i] for i in v]
        pairs = list(zip(u, u[1:]))
        changes = sum((x == DIGIT) != (y == DIGIT) and x != SEPARATOR != y for x, y in pairs)
        said = sum(odds[x][y] for x, y in pairs)

        def below(value: float, mean: float, var: float, uniform: float) -> float:
            """The chance that language shows `value` or less, towards uniform characters."""
            away = uniform - mean
            z = (value - mean * (n - 1)) / math.sqrt(var * (n - 1) + (SPREAD * away * (n - 1)) ** 2)
            return _normal_sf(z if away > 0 else -z)

        far = n * excess
        p_uniform = 1 - _normal_sf((chi2 - (k - 1) - far) / math.sqrt(2 * (k - 1) + 4 * far + (SPREAD * far) ** 2))
        return name, p_random, min(1.0, 3 * min(p_uniform, below(changes, *kinds), below(said, *serial)))


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, code points, by start and then kind."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(t)]
    if "AKIA" in t:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(t) if m.end() - m.start() >= 18]
    low = t.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 12]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def band(length: int) -> int:
    return bisect.bisect(BANDS, length) - 1


def step(p: float) -> int:
    """p's step of -log10 p, rounded towards p = 1."""
    return min(LAST, int(-math.log10(max(p, 1e-300)) / STEP))


def candidates(t: str, base: list[tuple[int, int, str]], language: Language) -> list[tuple[int, int, int, int]]:
    """(start, end, band, step) of the runs outside the base spans that pass as random characters of their alphabet."""
    out = []
    for m in CANDIDATE.finditer(t):
        if not any(s < m.end() and m.start() < e for s, e, _ in base):
            _, p_random, p_language = language.battery(m.group())
            if p_random >= LEAST_RANDOM:
                out.append((m.start(), m.end(), band(m.end() - m.start()), step(p_language)))
    return out


def least_steps(counts: dict[tuple[int, int], int]) -> dict[int, int]:
    """By band, the least step that Benjamini-Hochberg passes, from the number of runs by (band, step); a run of this step counts
    with the greatest p of the step. Bands without one are absent."""
    out = {}
    for b in range(len(BANDS)):
        total, passed = sum(n for (x, _), n in counts.items() if x == b), 0
        for k in range(LAST, -1, -1):
            passed += counts.get((b, k), 0)
            if passed and 10 ** (-k * STEP) <= FALSE_DISCOVERIES * passed / total:
                out[b] = k
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def learn(docs: DataFrame, text: str = "text") -> Language:
    """The pairs of symbols in all words of all texts, candidates left out: at most SYMBOLS x SYMBOLS counts reach the driver."""
    code = np.full(128, BREAK, np.int64)
    for c in ENCODINGS["mixed"]:
        code[ord(c)] = _symbol(c)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BREAK + 1) ** 2, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if t := t.as_py():
                    v = code[np.frombuffer(CANDIDATE.sub(" ", t).encode("ascii", "replace"), np.uint8)]
                    total += np.bincount(v[:-1] * (BREAK + 1) + v[1:], minlength=len(total))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["pair", "n"])

    pairs = np.zeros((BREAK + 1) ** 2)
    for pair, n in docs.select(F.col(text).alias("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        pairs[pair] = n
    return Language(pairs.reshape(BREAK + 1, BREAK + 1)[:SYMBOLS, :SYMBOLS])


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. `random` spans are those that the
    battery adds; they never replace a base span. Two passes over all texts come first: the pairs of symbols that language
    has, and the counts of runs by length band and p, from which Benjamini-Hochberg fixes each band's threshold for the
    whole corpus. So whether a run is reported depends on the corpus, base spans don't; reruns agree. Null or empty text:
    no spans. Texts of any length are scanned whole. Repeated rows, and rows with null or equal ids, are scanned each; an
    empty table gives no rows; further columns are ignored. Only counts shuffle.
    """
    language = learn(docs, text)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                if t := t.as_py():
                    counts.update((b, k) for *_, b, k in candidates(t, base_spans(t), language))
        keys = list(counts)
        yield pa.record_batch([pa.array([b for b, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array([counts[x] for x in keys], pa.int64())], ["band", "step", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(tally, "band int, step int, n long").groupBy("band", "step").agg(F.sum("n"))
    least = least_steps({(b, k): n for b, k, n in counted.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                kinds = [k for _, _, k in base]
                added = [(s, e, "random") for s, e, b, k in candidates(t, base, language) if b in least and k >= least[b]]
                every = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))
                out.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            n = list(zip(*out)) or [()] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in n[:3]), pa.array(n[3], pa.string()), pa.array(n[4], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
