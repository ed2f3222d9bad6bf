"""Fill-in-the-middle, whitening and language-model scoring against brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_models import ROWS

from docfields.llm import eigen, fim, suffix_tree, whitening
from docfields.llm.common import read

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def fim_model(doc_id, text, fim_percent=100, spm=50):
    t = text or ""
    units = UNITS.findall(t)
    hexa = hashlib.sha256(("7:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(hexa[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, t
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


EXTRA = [(200, "a <P> b\nc"), (201, "<S>"), (202, "x\n<M>"), (203, "\n\n\n"), (204, "no line feed"), (205, "<"), (206, "<P\n>\nS>"),
         (207, "ends with <S\n"), (208, "\r\n  é\n\U0001F600"), (209, "y\n" * 30_000), (209, "y\n" * 30_000)]


@pytest.mark.parametrize("which", ["odd", "docs", "extra"])
def test_fim_digest(request, spark, which):
    df = spark.createDataFrame(EXTRA, "doc_id long, text string") if which == "extra" else request.getfixturevalue(which)
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        n, form, p, m, out = fim_model(*r)
        want[(r[0], n, form, p, m, sha(out), sha(r[1] or ""))] += 1
    assert Counter(map(tuple, fim.fim_digest(df).collect())) == want
    assert which != "docs" or {k[2] for k in want} >= {"psm", "spm"}


@given(st.text(alphabet="ab\n<PSM>é", max_size=40), st.integers(0, 10_000))
@settings(max_examples=300, deadline=None)
def test_fim_text(text, doc_id):
    for f, s in ((100, 50), (40, 0), (0, 50)):
        assert fim.Cutter(fim=f, spm=s)(doc_id, text) == fim_model(doc_id, text, f, s)


def test_fim_documents_keep_columns(spark, odd, none):
    out = fim.fim_documents(odd)
    assert out.columns == odd.columns
    want = Counter((r["doc_id"], fim_model(r["doc_id"], r["text"])[4], r["tkey"], r["row"]) for r in odd.collect())
    assert Counter((r["doc_id"], r["text"], r["tkey"], r["row"]) for r in out.collect()) == want
    assert fim.fim_documents(none).count() == fim.fim_digest(none).count() == 0
    words = fim.fim_rows(spark.createDataFrame([(1, "a b  c")], "doc_id long, text string"), unit=r"\S++\s*+|\s++").first()
    assert words.n == 3


def whiten_model(vectors, k=8):
    keep = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in keep]
    n, s = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    y = np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in x])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in keep], n, dev, y @ u / np.sqrt(e), e / np.trace(cov)


def test_whitening(spark):
    df = read(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    odd = [(None, rows[0][1]), (7, rows[7][1]), (9001, None), (9002, [*rows[1][1][:-1], float("nan")]), (9003, []),
           (9004, [*rows[1][1][:-1], None]), (9005, [float("inf"), *rows[1][1][1:]]), (9006, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd],
                                  "vec_id long, embedding array<float>, w1 string, n int").repartition(3)
    ids, n, dev, white, explained = whiten_model(rows + odd[:2])
    got = whitening.whitened_components(table).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter(zip(ids, dev))
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    first = dict(zip(ids, white))
    for c in range(8):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        sign = np.sign(mine[5] * first[5][c])
        assert max(abs(mine[i] * sign - first[i][c]) for i in mine) < 1e-8
        assert {r["explained"] for r in got if r["component"] == c + 1}.pop() == pytest.approx(explained[c], rel=1e-10)


def test_whitening_degenerate(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        return whitening.whitened_components(df).collect()
    assert run([]) == run([(1, None)]) == run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    out = run([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])])  # one direction only
    assert [r["component"] for r in out] == [1, 1, 1]
    assert sorted(r["deviation"] for r in out) == [0, 2 * 3072 ** 2, 2 * 3072 ** 2]
    wide = run([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [3e38, 2.0])])  # beyond 64 bits: null
    assert {r["deviation"] for r in wide if r["vec_id"] == 3} == {None}
    s = [math.floor(1024 * x) for x in (1e9, -1e9, 2.0 ** 43)]
    assert all(r["identity_error"] < 1e-4 for r in wide) and len({r["component"] for r in wide}) >= 1 and len(s) == 3


@pytest.mark.parametrize("m", [1, 2, 3, 17, 64])
def test_eigenpairs(m):
    rng = np.random.default_rng(m)
    b = rng.normal(size=(m, m))
    cases = [b @ b.T, np.eye(m) * 3, np.diag(np.arange(m) // 3 * 1.0), np.outer(b[0], b[0]), np.zeros((m, m)),
             b @ np.diag(1.0 + 1e-13 * np.arange(m)) @ np.linalg.inv(b) if m == 1 else np.diag(1.0 + 1e-13 * np.arange(m))]
    for a in cases:
        a = (a + a.T) / 2
        values, vectors = eigen.leading(a, 8)
        top = np.linalg.eigvalsh(a)[::-1][:8]
        scale = max(1.0, np.abs(top).max())
        assert np.abs(values - top).max() < 1e-12 * scale
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-11
        assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * scale


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Tree:
    """The suffix tree in dictionaries: counts of every context, states with their kappa."""

    def __init__(self, rows, depth, min_count, gain, kappas):
        texts = [(*WORD.findall(lower(t)), None) for d, t in rows if not held_out(d)]
        self.uni = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.next = defaultdict(Counter)
        for t in texts:
            for i in range(len(t)):
                for d in range(1, depth + 1):
                    if i >= d:
                        self.next[t[i - d:i]][t[i]] += 1
        self.kappa = {}
        for d in range(1, depth + 1):
            for s, c in [(s, c) for s, c in self.next.items() if len(s) == d]:
                total = sum(c.values())
                if total < min_count or (d > 1 and s[1:] not in self.kappa) or (d > 2 and s[1:-1] not in self.kappa):
                    continue
                gains = [sum(x * math.log((x - 1 + k * self.p(w, s[1:])) / ((total - 1 + k) * self.p(w, s[1:])))
                             for w, x in c.items()) for k in kappas]
                if max(gains) > gain:
                    self.kappa[s] = kappas[gains.index(max(gains))]

    def p(self, w, s):
        if not s:
            return (self.uni[w] + 0.5) / (self.n + 0.5 * (self.v + 1))
        if s not in self.kappa:
            return self.p(w, s[1:])
        k = self.kappa[s]
        return (self.next[s][w] + k * self.p(w, s[1:])) / (sum(self.next[s].values()) + k)

    def score(self, t, depth):
        """The longest suffix of the history that is a state; suffixes of states are states."""
        out = 0.0
        for i, w in enumerate(t):
            s = ()
            while len(s) < min(i, depth) and t[i - len(s) - 1:i] in self.kappa:
                s = t[i - len(s) - 1:i]
            out += math.log10(self.p(w, s))
        return out


@pytest.mark.parametrize("which,depth,block", [("odd", 2, 3000), ("docs", 2, 100_000), ("docs", 3, 10**6), ("docs", 1, 50_000)])
def test_lm_scores(request, which, depth, block):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    options = dict(depth=depth, min_count=4, gain=2.0, kappas=(3.0, 30.0, 300.0))
    tree = Tree(rows, **options)
    assert {len(s) for s in tree.kappa} == set(range(1, depth + 1))
    want = []
    for d, t in rows:
        words = (*WORD.findall(lower(t)), None)
        base = sum(math.log10(tree.p(w, ())) for w in words)
        want.append((d, held_out(d), len(words), sum(tree.uni[w] > 0 for w in words), tree.n, base, tree.score(words, depth)))
    order = lambda r: (str(r[0]), *r[2:])
    got = sorted((tuple(r) for r in suffix_tree.lm_scores(df, block=block, **options).collect()), key=order)
    want.sort(key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_lm_state_is_a_distribution(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(200).collect()]
    tree = Tree(rows, 2, 4, 2.0, (3.0, 30.0))
    unseen = 0.5 / (tree.n + 0.5 * (tree.v + 1))
    for s in sorted((s for s in tree.kappa), key=str)[:20]:
        k, c, part = tree.kappa[s], tree.next[s], 1.0
        rest = unseen
        for i in range(len(s)):
            state = s[len(s) - 1 - i:]
            if state in tree.kappa:
                part = tree.kappa[state] / (sum(tree.next[state].values()) + tree.kappa[state])
                rest *= part
        assert sum(tree.p(w, s) for w in tree.uni) + rest == pytest.approx(1.0)
        assert k > 0 and c


def test_lm_beats_unigrams(spark):
    p = suffix_tree.lm_scores(read(spark, "/root/testdata/sf0.1", "documents")).toPandas()
    h = p[p.held_out]
    assert (h.score - h.base_score).sum() / h.n_tokens.sum() > 0.4
    assert (h.score > h.base_score).mean() > 0.9


def test_lm_edges(spark, none):
    assert suffix_tree.lm_scores(none).count() == 0
    ids = [i for i in range(100) if held_out(i)]
    only = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    assert {tuple(r)[1:] for r in suffix_tree.lm_scores(only).collect()} == {(True, 3, 0, 0, 0.0, 0.0)}


def thue_morse(n, swap=False):
    bits = [bin(i).count("1") % 2 ^ swap for i in range(n)]
    return "".join("ab"[b] for b in bits)


def test_words_and_lines_that_collide_modulo_a_power_of_two(spark):
    """Polynomial hashes modulo 2^64 are equal for these, whatever the base."""
    from docfields.llm import quality, substring_dedup, suffix_dedup

    one, two = thue_morse(2048), thue_morse(2048, True)
    same = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {two}")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.substring_digest(df, 35).collect()} == {0}
    lines = spark.createDataFrame([(1, f"{one}\n{two}"), (2, f"{one}\n{one}")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality.quality_verdicts(lines, none).collect()}
    assert got == {1: 0, 2: 1}
    assert {r["n_removed"] for r in suffix_dedup.suffix_digest(
        spark.createDataFrame([(1, one[:400]), (2, two[:400])], "doc_id long, text string"), 400).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_extension_finds_every_repeat(spark, seed, monkeypatch):
    """Few words, so that anchors have many different sides; against all windows."""
    from docfields.llm import substring_dedup

    rng = np.random.default_rng(seed)
    texts = [[f"w{x}" for x in rng.integers(0, 2 + seed, rng.integers(0, 90))] for _ in range(60)]
    seen = Counter(tuple(t[i:i + 8]) for t in texts for i in range(len(t) - 7))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = {}
    for d, t in enumerate(texts):
        gone = set()
        for i in range(len(t) - 7):
            if seen[tuple(t[i:i + 8])] > 1:
                gone.update(range(i, i + 8))
        want[d] = len(gone)
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_digest(df, 8).collect()} == want


def test_archives_of_a_repeated_task_are_not_read(spark):
    import os
    import shutil

    from docfields.llm import warc
    from docfields.llm.common import shared_path

    pages = spark.createDataFrame([(i, f"u{i}", "x" * (50 * i)) for i in range(20)], "page_id long, url string, html string").repartition(3)
    path = shared_path(spark, "warc-test").removeprefix("file:")
    names = warc.write_archives(pages, path)
    shutil.copy(names[0], os.path.join(path, "pages-00000000-lost-00000.warc.zst"))
    assert warc.read_archives(spark, path).count() > 20 == warc.read_archives(spark, names).count()
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_ftrl_row_by_row(odd, spark):
    """The learner against plain dictionaries, row by row in the order of the written sample."""
    from docfields.llm import toxicity as tox

    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    rows = [(r["toxic"], [*np.frombuffer(r["feats"], "<i4").tolist(), tox.DIM]) for r in tox.training_rows(odd, labels).collect()]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == tox.DIM else tox.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) * tox.ALPHA / (tox.BETA + math.sqrt(n[i]))
    for _ in range(tox.ROUNDS):
        for toxic, feats in rows:
            w = {i: weight(i) for i in feats}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - toxic
            for i in feats:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / tox.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    learned = tox.train(odd, labels)
    want = np.zeros(tox.DIM + 1)
    for i in list(z):
        want[i] = weight(i)
    assert len(rows) > 20 and np.count_nonzero(want) > 1
    assert np.allclose(learned, want, atol=1e-7)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_pipeline_on_odd_and_empty_tables(request, spark, which):
    import corpus_pipeline
    from llm_models import SF

    table = request.getfixturevalue(which)
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == columns, name
        table = corpus_pipeline.write_table(out, name)
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, SF).toPandas()
    ends = pieces[pieces.start + pieces.length == pieces.doc_tokens]
    assert Counter(ends.doc_id.dropna().astype(int)) == Counter(r["doc_id"] for r in table.select("doc_id").collect() if r["doc_id"] is not None)
    assert which != "none" or len(pieces) == 0


def test_packing_with_default_bounds(spark):
    """More open windows than one partition keeps, over several partitions."""
    import public_tokenizers
    from docfields.llm import packing

    df = spark.createDataFrame([(i, "word " * (1 + i * 37 % 1900)) for i in range(900)], "doc_id long, text string").repartition(5)
    p = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    p = p.sort_values(["sequence_id", "offset"])
    size = p.groupby("sequence_id").length.sum()
    assert size.max() <= packing.LENGTH
    gapless = p.groupby("sequence_id").apply(lambda g: (g.offset == g.length.cumsum() - g.length).all(), include_groups=False)
    assert gapless.all()
    whole = p.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert (whole.n == whole.t).all() and len(whole) == 900
    assert 1 - size.sum() / (len(size) * packing.LENGTH) < 0.02


def test_gains_travel_as_they_are(spark):
    """op13: rows of zeros cost a bit; a step's shuffle files go when it ends, and the setting is put back."""
    import numpy as np

    from docfields.llm import suffix_tree as S
    from docfields.llm.common import finished_shuffles_go

    for n in (0, 1, 7, 8, 1000):
        a = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
        a[::3] = 0
        assert (S._unpack_gains(S._pack_gains(a), n, 4) == a).all()
    assert len(S._pack_gains(np.zeros((800, 4), np.float32))) == 100
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with finished_shuffles_go(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_blocks_of_a_task_ask_together(spark):
    """op13: a key that several blocks of a task hold is sent once, with a bit a block, and sorted keys go as gaps."""
    import numpy as np

    from docfields.llm import suffix_tree as S

    for n in (0, 1, 7, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**64 - 1, n, np.uint64, endpoint=True))
        assert (S._unpack_keys(S._pack_keys(keys)) == keys).all()
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(40)), False) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").coalesce(1)
    known = df.mapInArrow(S._tokenize(100), S.BLOCKS)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")  # small batches, so that there are many blocks
    try:
        blocks = {r["block"]: np.sort(S._unpack(r["words"], np.uint64)) for r in known.collect()}
        asked = known.mapInArrow(S._ask(0, (0, 0), {}, 3), S.ASK).collect()
    finally:
        spark.conf.set(name, before)
    assert len(blocks) > S.GROUP_BLOCKS
    sent = [S._unpack_keys(r["keys"]) for r in asked]
    assert sum(map(len, sent)) < sum(map(len, blocks.values())) / 2
    assert sum(S._unpack(S._expand(r["amounts"]), np.int64).sum() for r in asked) == 30 * 41
    got = {b: [] for b in blocks}
    for r, keys in zip(asked, sent):
        bits = np.frombuffer(S._expand(r["askers"]), np.uint8).reshape(len(r["blocks"]), -1)
        for b, mine in zip(r["blocks"], bits):
            got[b].append(keys[np.unpackbits(mine, count=len(keys)).astype(bool)])
    assert all((np.sort(np.concatenate(got[b])) == words).all() for b, words in blocks.items())
