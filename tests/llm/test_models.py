"""Operators with a trained or solved part: held-out accuracy, brute force, and the pipeline."""
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from llm_models import ROWS, SF

from docfields.llm import mixing, quality, toxicity
from docfields.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_model(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


def bucket_model(text):
    b = (text or "").encode()
    return [(int.from_bytes(b[i:i + 4], "little") * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48 for i in range(len(b) - 3)]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality(request, labels, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(g := bucket_model(t))
        if d in good:
            target.update(g)
    top = quality.BUCKETS
    nr, nt = sum(raw.values()) + top, sum(target.values()) + top

    def ratio(b):
        return round((math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr)) * quality.SCALE)
    known = {b: ratio(b) for b in raw}
    want = Counter()
    for d, t in rows:
        base = base_model(t)
        g = bucket_model(t)
        total = sum(known[b] for b in g)
        want[(d, *base, not base[5] and total >= -0.2 * quality.SCALE * len(g))] += 1
    got = Counter(tuple(r)[:8] for r in quality.quality_verdicts(df, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    assert got == want
    kept = quality.keep_quality(df, labels)
    assert kept.columns == df.columns
    assert kept.count() == sum(n for k, n in want.items() if k[7])


def test_quality_keeps_clean_documents(docs, labels):
    r = quality.quality_verdicts(docs, labels).where("not base_failed").join(labels, "doc_id").toPandas()
    assert r[r.quality == 1].kept.mean() > 0.99
    assert r[r.quality == 0].kept.mean() < 0.3


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = read(spark, sf, "labels")
    out = toxicity.toxicity_scores(read(spark, sf, "documents"), labels)
    p = out.join(labels, "doc_id").toPandas()
    assert (p.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in p.doc_id]).all()
    assert (p.predicted == (p.score >= 0.7)).all() and p.score.between(0, 1).all()
    h = p[p.held_out]
    rank = h.score.rank()
    pos = h.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95
    assert (h[~pos].predicted == 1).mean() < 0.01


def test_toxicity_ignores_held_out_labels(odd, spark):
    rows = [(i, 1, int(i % 2)) for i in range(90)]
    flip = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, _, t in rows]
    a, b = (spark.createDataFrame([*x, (None, 1, 1), (5000, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
            for x in (rows, flip))
    one, two = (sorted(map(tuple, toxicity.toxicity_scores(odd, x).collect()), key=str) for x in (a, b))
    assert one == two and len(one) == len(ROWS)


def word_model(text):
    return [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w]


def signed_bucket(h):
    return (h - (1 << 64) if h >> 63 else h) % mixing.BUCKETS


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixing(request, labels, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    label = {r["doc_id"]: "toxic" if r["toxic"] == 1 else "low" if r["quality"] == 0 else "clean" for r in labels.collect()}
    seen = {k: Counter() for k in mixing.DOMAINS}
    for d, t in rows:
        if d in label:
            seen[label[d]].update(map(signed_bucket, word_model(t)))
    prior = Counter(label.values())
    total = {k: sum(c.values()) + mixing.BUCKETS for k, c in seen.items()}
    model = []
    for d, t in rows:
        w = [signed_bucket(h) for h in word_model(t)]
        log = []
        for k in mixing.DOMAINS:
            s = sum(math.log((seen[k][b] + 1) / total[k]) for b in w)
            log.append(math.log((prior[k] + 1) / (len(label) + 3)) + s / max(1, len(w)) * min(len(w), mixing.EVIDENCE))
        e = np.exp(np.array(log) - max(log))
        model.append((d, len(w), *(e / e.sum())))
    model.sort(key=lambda r: (str(r[0]), r[1], r[2:]))
    got = sorted(map(tuple, mixing.mixing_table(df, labels).collect()), key=lambda r: (str(r[0]), r[1], r[2:5]))
    assert [r[:2] for r in got] == [r[:2] for r in model]
    p, q = np.array([r[2:5] for r in got]), np.array([r[2:5] for r in model])
    assert np.allclose(p, q, atol=1e-9)
    n, rate = np.array([r[1] for r in got], float), np.array([r[5] for r in got])
    goal = np.array([mixing.TARGETS[k] for k in mixing.DOMAINS])
    assert (rate >= 0).all() and all(r[6] - 1 <= r[5] <= r[6] + 1 for r in got)
    if which == "docs":
        assert np.abs((n * rate) @ p / n.sum() - goal).max() < 2 * mixing.TOLERANCE
        mixed = mixing.mix_documents(df, labels)
        assert mixed.columns == df.columns and mixed.count() == sum(r[6] for r in got)


@pytest.mark.parametrize("op", [quality.quality_verdicts, quality.keep_quality, toxicity.toxicity_scores,
                                mixing.mixing_table, mixing.mix_documents])
def test_empty_tables(none, labels, op):
    assert op(none, labels).count() == 0
    assert op(none, labels.limit(0)).count() == 0


def test_no_labels(odd, labels):
    for op in (quality.quality_verdicts, toxicity.toxicity_scores, mixing.mixing_table):
        assert op(odd, labels.limit(0)).count() == len(ROWS)


def test_pipeline(spark, docs, labels):
    table, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == docs.columns, name
        table = corpus_pipeline.write_table(out, name)
        sizes.append(table.count())
    assert docs.count() > sizes[0] > sizes[1] == sizes[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, SF).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    ends = pieces[pieces.start + pieces.length == pieces.doc_tokens]
    assert Counter(ends.doc_id) == Counter(r["doc_id"] for r in table.select("doc_id").collect())
