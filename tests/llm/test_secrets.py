"""Operator 5: detection rates by encoding and length, clean runs, and the whole scan against a plain version."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import secrets

SF = "/root/testdata/sf0.001"
LENGTHS = (20, 24, 32, 40, 64)
FOUND = ("HEX", "base32", "base36", "BASE36", "base62", "base64", "base64url", "mixed")
CLEAN = ["internationalization_of_everything_else", "docs/reference/getting-started/installation", "getUserNameFromDatabaseConnection", "donaudampfschifffahrtsgesellschaft", "2024-01-05-2023-12-31-2022", "12345678901234567890123", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "--------------------------", "MAXIMUM_NUMBER_OF_CONNECTIONS", "A1" * 30]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def planted():
    r = random.Random(5)
    for name in FOUND:
        for n in LENGTHS:
            for k in range(20):
                yield name, n, k, "".join(r.choice(secrets.ENCODINGS[name]) for _ in range(n))


def test_random_runs_are_found_in_short_and_long_texts_and_clean_ones_left(spark, docs):
    every, prose = list(planted()), " ".join(r.text for r in docs.limit(20).collect() if r.text)[:30_000]
    # Each run alone in a short text, or among many clean runs in a long one.
    rows = [(10_000 + i, f"see {run} there" if k % 2 else f"{' '.join(CLEAN)} {prose} {run} {' '.join(CLEAN)}") for i, (_, _, k, run) in enumerate(every)]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()}
    rate, wrong = {}, 0
    for (i, text), (name, n, _, run) in zip(rows, every):
        spans = [s.split(":") for s in got[i].split(",") if s.startswith("random")]
        found = {text[int(a) : int(b)] for _, a, b in spans}
        rate.setdefault((name, n), []).append(run in found or any(k in got[i] for k in ("hex:", "access:", "assign:")))
        wrong += len(found & set(CLEAN))
    assert wrong == 0
    share = {x: sum(v) / len(v) for x, v in rate.items()}
    assert min(share.values()) >= 0.8 and all(sum(share[x, n] for n in LENGTHS) / len(LENGTHS) >= 0.9 for x in FOUND), share


def test_scan_is_what_a_plain_version_finds(spark, docs):
    blob = base64.b64encode(hashlib.sha512(b"k").digest()).decode()
    odd = [(5001, f"see {blob} or {CLEAN[0]}"), (5002, f"token={blob}"), (5002, f"token={blob}"), (None, f"\u0444 {blob}"), (5003, None), (5004, ""), (5005, "x" * 200_000)]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    language = secrets.learn(every)
    tested = []
    texts = [(i, r.doc_id, r.text or "") for i, r in enumerate(every.collect())]
    for i, _, t in texts:
        base = secrets.base_spans(t)
        for m in secrets.CANDIDATE.finditer(t):
            if all(e <= m.start() or m.end() <= s for s, e, _ in base):
                _, p_random, p = language.battery(m.group())
                if p_random >= secrets.LEAST_RANDOM:
                    # The step's greatest p, and 0.1^20 for the last step.
                    tested.append((max(x for x in range(len(secrets.BANDS)) if secrets.BANDS[x] <= m.end() - m.start()), 10 ** (-secrets.STEP * secrets.step(p)), i, m.span()))
    passed = set()
    for b in range(len(secrets.BANDS)):
        own = sorted(x for x in tested if x[0] == b)
        last = max((x[1] for j, x in enumerate(own) if x[1] <= secrets.FALSE_DISCOVERIES * (j + 1) / len(own)), default=-1)
        passed |= {(x[2], x[3]) for x in own if x[1] <= last}
    want = []
    for i, doc_id, t in texts:
        base = secrets.base_spans(t)
        spans = sorted(base + [(s, e, "random") for j, (s, e) in passed if j == i], key=lambda x: (x[0], secrets.KINDS.index(x[2])))
        want.append((doc_id or 0, ",".join(f"{k}:{s}:{e}" for s, e, k in spans)))
    got = secrets.scan_secrets(every).select(F.coalesce("doc_id", F.lit(0)), "spans").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum("random" in s for _, s in want) >= 2


def test_prior_stands_where_no_text_is(spark, docs):
    assert secrets.scan_secrets(docs.limit(0)).collect() == []
    one = spark.createDataFrame([(1, base64.b64encode(hashlib.sha512(b"k").digest()).decode()), (2, CLEAN[0])], docs.schema)
    assert {r.doc_id: r.spans[:6] for r in secrets.scan_secrets(one).collect()} == {1: "random", 2: ""}
