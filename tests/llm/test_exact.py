"""Operators with one right answer, against brute force."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P
import xxhash
from llm_models import ROWS, SF

from docfields.llm import embedding_dedup, packing, simhash, substring_dedup, suffix_dedup, token_ids, warc
from docfields.llm import rolling as R
from docfields.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def removed_model(texts, n, cut, join):
    seen = Counter()
    for t in texts:
        seen.update(hash(join(t[i:i + n])) for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[hash(join(t[i:i + n]))] > 1:
                gone[i:i + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_substring(request, which):
    df = request.getfixturevalue(which)
    rows = pairs_of(df)
    texts = [WORD.findall(t or "") for _, t in rows]
    want = Counter()
    for (d, _), t, gone in zip(rows, texts, removed_model(texts, 35, None, tuple)):
        kept = " ".join(w for w, g in zip(t, gone) if not g)
        want[(d, len(t), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in substring_dedup.substring_digest(df, 35).collect())
    assert got == want
    assert any(k[2] for k in got)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_suffix(request, which):
    df = request.getfixturevalue(which)
    rows = pairs_of(df)
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), t, gone in zip(rows, texts, removed_model(texts, 400, None, bytes)):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(tuple(r) for r in suffix_dedup.suffix_digest(df, 400).collect())
    assert got == want


def test_hot_anchor_is_dealt(odd, monkeypatch):
    from docfields.llm import repeats
    plain = Counter(tuple(r) for r in suffix_dedup.suffix_digest(odd, 100).collect())
    monkeypatch.setattr(repeats, "BLOCK_EXTENTS", 2)
    assert Counter(tuple(r) for r in suffix_dedup.suffix_digest(odd, 100).collect()) == plain
    words = Counter(tuple(r) for r in substring_dedup.substring_digest(odd, 6).collect())
    monkeypatch.setattr(repeats, "BLOCK_EXTENTS", 1024)
    assert Counter(tuple(r) for r in substring_dedup.substring_digest(odd, 6).collect()) == words


def test_text_removal_keeps_columns(odd, none):
    for cut in (substring_dedup.remove_repeated_words, suffix_dedup.remove_repeated_bytes):
        out = cut(odd)
        assert out.columns == odd.columns and out.count() == len(ROWS)
        assert cut(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_sort_block_is_a_suffix_array(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 99 + seed, 3000).astype(np.uint8)
    text[1000:1600] = text[200:800]
    text[2000:2500] = 97
    n = 50
    pos = rng.permutation(len(text) - n)
    bucket = rng.integers(0, 2, len(pos))
    cls, order = suffix_dedup.sort_block(text, pos, bucket, n)
    raw = text.tobytes()
    got = [(bucket[i], raw[pos[i]:pos[i] + n]) for i in order]
    assert got == sorted(got)
    assert [a == b for a, b in zip(got, got[1:])] == (np.diff(cls) == 0).tolist()


def test_difference_cover():
    for a in range(suffix_dedup.PERIOD):
        for b in range(suffix_dedup.PERIOD):
            assert suffix_dedup._SHIFTS[a] & suffix_dedup._SHIFTS[b]


def test_long_text_in_parts():
    rng = np.random.default_rng(1)
    sym = rng.integers(0, 3, 5000).astype(np.uint64)
    off = np.array([0, 10, 10, 4000, 5000])
    for chunk in (64, 700, 1 << 20):
        doc, start, cnt, _, _, _ = R.extents(sym, off, 20, 6, chunk)
        seen = sorted((d, s + i) for d, s, c in zip(doc.tolist(), start.tolist(), cnt.tolist()) for i in range(c))
        assert seen == [(d, i) for d in range(4) for i in range(off[d + 1] - off[d] - 19)]


def simhash_model(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_model(ids, linked):
    low = {i: i for i in range(len(ids))}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for i, j in linked:
        a, b = find(i), find(j)
        low[max(a, b)] = min(a, b)
    best = defaultdict(list)
    for i in range(len(ids)):
        if ids[i] is not None:
            best[find(i)].append(ids[i])
    return [min(best[find(i)], default=None) for i in range(len(ids))]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = pairs_of(df)
    fp = [simhash_model(t) for _, t in rows]
    x = np.array(fp, np.uint64)
    linked = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4) if j > i]
    comp = component_model([d for d, _ in rows], linked)
    want = Counter((d, f, c) for (d, _), f, c in zip(rows, fp, comp))
    got = Counter((r[0], r[1] % (1 << 64), r[2]) for r in simhash.simhash_components(df).collect())
    assert got == want
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str) == sorted(
        {c for (_, c) in zip(rows, comp)}, key=str)


@pytest.mark.parametrize("budget,bits", [(4, 64), (2, 20), (4, 14)])
def test_trie_join_dense(budget, bits):
    rng = np.random.default_rng(bits)
    x = np.unique(rng.integers(0, 1 << bits, 700, dtype=np.uint64) << np.uint64(64 - bits))
    x = np.unique(np.concatenate([x, x[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))]))
    label = simhash.trie_links(x, np.array([0, 100]), np.array([100, len(x)]), budget)
    run = np.arange(len(x)) >= 100
    linked = [(i, int(j)) for i in range(len(x)) for j in
              np.flatnonzero((np.bitwise_count(x ^ x[i]) <= budget) & (run == run[i])) if j > i]
    assert label.tolist() == component_model(list(range(len(x))), linked)


def test_simhash_bucket_split(docs, monkeypatch):
    plain = Counter(tuple(r) for r in simhash.simhash_components(docs).collect())
    monkeypatch.setattr(simhash, "BUCKET", 4)
    assert Counter(tuple(r) for r in simhash.simhash_components(docs).collect()) == plain


def encoder(name):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_ids(request, which):
    df = request.getfixturevalue(which)
    enc = encoder("word_bpe_49k.json")
    ids = [(d, enc(t)) for d, t in pairs_of(df)]
    got = [tuple(r) for r in token_ids.token_id_digest(df, P.path("word_bpe_49k.json")).collect()]
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(i), crc(i)) for d, i in ids)
    got.sort(key=lambda r: r[1])
    at = 0
    for d, start, n, _ in got:
        assert start == at
        at += n
    order = [d for d, *_ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_rank_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_ids.encode_ranks(r)
        assert token_ids.decode_ranks(control, data, n).tolist() == r.tolist()
    block = token_ids.pack_block([5, None], [2, 1], np.array([1, 70_000, 3], np.uint32))
    ((ids, null, counts, ranks),) = token_ids.read_blocks(block)
    assert (ids[0], null.tolist(), counts.tolist(), ranks.tolist()) == (5, [False, True], [2, 1], [1, 70_000, 3])
    with pytest.raises(ValueError):
        list(token_ids.read_blocks(block[:-1]))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    enc = encoder("byte_bpe_50k.json")
    ids = [(d, enc(t)) for d, t in pairs_of(df)]
    got = packing.pack_documents(df, P.path("byte_bpe_50k.json"), limit=8, fan_in=2).collect()
    want = Counter()
    for d, x in ids:
        for s in range(0, len(x), 2048):
            want[(d, s, len(x[s:s + 2048]), crc(x[s:s + 2048]), len(x))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(seq) <= 1.12 * total / 2048 + 1


@pytest.mark.parametrize("op", [
    lambda d: token_ids.token_id_digest(d, P.path("word_bpe_49k.json")),
    lambda d: packing.pack_documents(d, P.path("byte_bpe_50k.json")),
    substring_dedup.substring_digest, suffix_dedup.suffix_digest, simhash.simhash_components,
    simhash.keep_representatives])
def test_empty_table(none, op):
    assert op(none).count() == 0


def page_rows():
    same, short = "<p>" + "same page " * 30, "<p>tiny</p>"
    return [(3, "http://a/ b", same), (1, "http://a/\r\nX: y", same), (2, None, same), (4, "", short), (5, "u", short),
            (6, "u", None), (7, "u", ""), (8, "ü", "é" * 49 + "xx"), (9, "u", "é" * 49 + "xx"), (1, "again", same),
            (None, "n", same), (None, "n", "lone " * 40), (10, "crlf", "WARC/1.1\r\n\r\n" * 20)]


def test_warc(spark):
    rows = page_rows() + [(100 + i, f"http://h/{i}", f"<html>page {i} " + "text " * (i * 7)) for i in range(200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= 100:
            first[b] = min(p, first.get(b, p))
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        ref = first.get(b) if len(b) >= 100 and first.get(b) not in (None, p) else None
        want[(p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref is not None else "response", ref, None)] += 1
    assert Counter(tuple(r) for r in warc.warc_round_trip(df).collect()) == want
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_broken_records():
    import io
    sink = io.BytesIO()
    samples = [f"<html>page number {i} of the sample, with some words {i * 7}</html>".encode() * 4 for i in range(200)]
    w = warc.ArchiveWriter(sink, samples)
    bodies = [warc.record_bytes(i, "u", s, "response", None, hashlib.sha256(s).hexdigest(), len(s)) for i, s in
              enumerate(samples)]
    bodies[3] = bodies[3].replace(b"Content-Length: ", b"Content-Length: 1")
    bodies[5] = bodies[5].replace(b"page number", b"page numbex")
    bodies[7] = b"nonsense"
    for b in bodies:
        w.write(b)
    buf = sink.getvalue()
    assert buf[:4] == (0x184D2A5D).to_bytes(4, "little")
    out = list(warc.read_archive(buf))
    assert [i for i, r in enumerate(out) if isinstance(r, str)] == [3, 5, 7] and len(out) == 200
    assert out[9]["block"] == samples[9]
    cut = list(warc.read_archive(buf[:-5]))
    assert len(cut) == 200 and isinstance(cut[-1], str)


def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        centre = rng.standard_normal(16)
        for i in range(60):
            v = centre + rng.standard_normal(16) * (0.05 if i < 40 else 1.0)
            rows.append((v.astype(np.float32).tolist(), label))
    rows += [(rows[0][0], 0), (rows[0][0], 0), (rows[0][0], 1), ([0.0] * 16, 0), (None, 0), ([1.0, None] * 8, 0),
             ([float("nan")] * 16, 1), ([float("inf")] * 16, 1), ([1.0, 2.0], 0), ([1.0, 2.0], 0), ([], 0)]
    out = [(i, *r) for i, r in enumerate(rows)]
    return [*out, out[1], (None, rows[0][0], 0)]


def vector_model(rows):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)
    u = [unit(v) if i is not None and label is not None else None for i, v, label in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if u[i] is not None and u[j] is not None
              and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.98]
    deg = Counter(x for p in linked for x in p)
    comp = component_model([r[0] for r in rows], linked)
    return Counter((r[0], deg[i], c, r[0] is not None and r[0] == c) for i, (r, c) in enumerate(zip(rows, comp)))


def test_embeddings(spark, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    want = vector_model(rows)
    assert Counter(tuple(r) for r in embedding_dedup.embedding_links(df).collect()) == want
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    got = embedding_dedup.embedding_links(df, window=8, range_rows=16)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_embeddings_recall(spark):
    """Against brute force over all rows of a larger table: every component and nearly every link."""
    df = read(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    want = 0
    for v in set(label) - {-1}:
        s = x[label == v] @ x[label == v].T
        want += int((s >= 0.98).sum()) - len(s)
    got = sum(r["n_links"] for r in embedding_dedup.embedding_links(df).collect())
    assert 0.98 * want <= got <= want
