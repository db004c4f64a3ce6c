"""The whole pipeline against a plain version of each stage: all segmentations, all pairs, all alignments, SQL, shard by shard."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import regex

import corpus_pipeline
from lodestrata.llm import language_id, mixing

SF = "/root/testdata/sf0.001"


def planted(docs, items):
    """Rows of the fixture, with copies of texts and items, near copies, and rows that language ID rejects."""
    rng, rows = np.random.default_rng(5), [tuple(r) for r in docs]
    long = [r for r in rows if len((r[1] or "").split()) > 150][:12]
    new = []
    for k, (_, text, lang, source, _) in enumerate(long):
        w = text.split()
        new.append((text, lang, source))
        for edits in (1, 2, 6):
            near = list(w)
            for at in rng.choice(len(w), edits, replace=False):
                near[at] = f"edit{k}"
            new.append((" ".join(near), lang, source if edits < 6 else None))
        item = items[k].split()
        new.append((" ".join(w[:40] + item + w[-40:]), lang, source))
        new.append((" ".join(w[40:80] + [x if i % 4 else "changed" for i, x in enumerate(item)] + w[80:90]), lang, source))
    new += [(None, "en", "a"), ("", "en", "a"), ("12 34 ½ ②", "en", "a"), (" \t\n", None, None), ("漢字日", None, "b")]
    at = max(r[0] for r in rows) + 1
    return rows + [(at + i, t, k, s, len(t or "")) for i, (t, k, s) in enumerate(new)]


def in_language(rows, langs, logp):
    """Rows whose best language has a posterior of at least 0.5, by the sum over all segmentations of each word."""
    p = dict(zip(language_id.read_pieces(language_id.vocabulary_path()), np.exp(logp.astype(np.float32).astype(float))))
    memo, kept = {}, []
    for r in rows:
        words = [w for w in regex.findall(r"[\p{L}\p{M}]+", (r[1] or "").lower()) if regex.search(r"\p{L}", w)]
        for w in set(words) - memo.keys():
            alpha = [np.ones(len(langs))] + [np.zeros(len(langs)) for _ in w]
            scale = 0.0
            for j in range(1, len(w) + 1):
                for i in range(max(0, j - language_id.MAX_PIECE), j):
                    if w[i:j] in p:
                        alpha[j] = alpha[j] + alpha[i] * p[w[i:j]]
                if w[j - 1] not in p:
                    alpha[j] = alpha[j] + alpha[j - 1] * language_id.UNKNOWN
                top = alpha[j].max()
                alpha, scale = [a / top for a in alpha], scale + math.log(top)
            memo[w] = np.log(alpha[-1]) + scale
        if words:
            total = sum(memo[w] for w in words)
            score = 1 / np.exp((total - total.max()) / min(8, len(words))).sum()
            assert abs(score - 0.5) > 1e-4
            if score >= 0.5:
                kept.append(r)
    return kept


def one_of_each_group(rows):
    lower, sets, label = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}, {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower))
        n = min(5, len(w))
        sets[r[0]], label[r[0]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set(), r[0]
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return [r for r in rows if label[r[0]] == r[0]]


def without_items(rows, items):
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in items]

    def holds(own, item):
        if len(item) < 6 or len(own) < 6:
            return own == item and bool(item)
        need = max(12, len(item))
        if 2 * sum(x in set(own) for x in set(item) for _ in range(item.count(x))) < need:
            return False
        before = [0] * (len(own) + 1)
        for x in item:
            now = [0]
            for j, y in enumerate(own):
                now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
                if now[-1] >= need:
                    return True
            before = now
        return False

    return [r for r in rows if not any(holds(re.findall(r"[^\W_]+", (r[1] or "").lower()), w) for w in words)]


def mixed(rows):
    import pandas as pd

    con = duckdb.connect()
    con.register("kept", pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]))
    return dict(con.sql(mixing.mixing_sql("kept") + "SELECT doc_id, copies FROM c").fetchall())


def test_pipeline_against_plain_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text for r in bench.select("text").collect()]
    rows = planted(docs.select("doc_id", "text", "lang", "source", "n_chars").collect(), [t for t in items if len(t.split()) >= 12])
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    bench.coalesce(1).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    langs, logp = language_id.train(table.where(~language_id.held_out()))
    want, sizes = rows, [len(rows)]
    for stage in (lambda x: in_language(x, langs, logp), one_of_each_group, lambda x: without_items(x, items)):
        want = stage(want)
        sizes.append(len(want))
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4  # each stage drops some
    copies, crc = mixed(want), {r[0]: (len(r[1].encode()) + 8, zlib.crc32(r[1].encode())) for r in want}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter({(i, *crc[i]): n for i, n in copies.items() if n})
    slots, size, shards = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        shards[r.text_crc32, r.size].add(r.shard)
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in shards.values())
    assert max(size.values()) <= sum(size.values()) / 24 + 2 * max(r.size for r in got)
