"""Operators against brute force, on small tables with nulls, empty, repeated and long texts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from isohyet.llm import langid, mixing, neardup, ngrams, pieces, quality, textcodes, topk, vectordup, warc, wordpieces
from isohyet.llm.common import fold
from isohyet.llm.queries import ORACLES, QUERIES

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, vec_id string, class string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def odd_docs(spark):
    r = np.random.default_rng(4)
    vocabulary = [f"word{k}" for k in range(300)]
    base = [" ".join(r.choice(vocabulary, 60)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, t + " tail") for k, t in enumerate(base[:6])] + [(200 + k, " ".join(t.split()[2:])) for k, t in enumerate(base[:6])]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One two"), (304, "one TWO"), (None, base[0]), (None, "alone here"), (5, base[5]), (305, "12 34 !!"), (306, " ".join(base) * 5)]
    return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", 0, "x", "y") for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in (words(t) for _, t in rows)]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        component = min(ids, default=None) if sets[k] else i
        want.append((i, len(sets[k]), component, i is not None and i == component))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    stays = neardup.representatives(docs)
    assert stays.columns == docs.columns
    assert stays.filter("doc_id < 100").count() == 12 and stays.filter("doc_id between 100 and 210").count() == 0
    assert neardup.near_duplicates(empty(spark)).count() == 0


def exact_model(train):
    """Probability of a word after the words before it, from exact counts (none above ngrams.EXACT)."""
    count = [Counter() for _ in range(6)]
    for t in train:
        w = [*t, None]
        for k in (1, 2, 4, 5):
            count[k].update(tuple(w[i - k : i]) for i in range(k, len(w) + 1))
        count[2][None, w[0]] += 1
    n, v = sum(count[1].values()), len(count[1])
    ends = count[1][(None,)]

    def probability(before, w):
        p = (count[1][(w,)] + v / (v + 1)) / (n + v) if v else 1.0
        c = count[1][(before[-1],)] if before else ends
        if c:
            m = ngrams.PAIR_MASS * math.sqrt(c)
            p = (count[2][before[-1] if before else None, w] + m * p) / (c + m)
        if len(before) >= 4 and (c := count[4][tuple(before[-4:])]):
            p = (count[5][(*before[-4:], w)] + ngrams.RUN_MASS * p) / (c + ngrams.RUN_MASS)
        return p

    return count, probability


def test_language_model(spark):
    docs = odd_docs(spark)
    held = fold("doc_id", 7, 2)
    rows = docs.select("doc_id", "text", held.alias("h")).collect()
    count = exact_model([words(r.text) for r in rows if not r.h])[0]
    count = {w: c for (w,), c in count[1].items()}
    n, v = sum(count.values()), len(count)
    lowest = {}
    for most, chunk in ((ngrams.MOST_BYTES, ngrams.CHUNK_BYTES), (0, ngrams.CHUNK_BYTES), (ngrams.MOST_BYTES, 500), (0, 200)):  # broadcast and sent, texts whole and in pieces
        got = sorted(ngrams.score_texts(docs, held, most, chunk, 4000).collect(), key=str)
        told = lambda r: [count.get(w, 0) for w in [*words(r.text), None]]
        want = sorted(((r.doc_id, r.h, len(told(r)), sum(c > 0 for c in told(r)), n, round(sum(math.log10((c + 1) / (n + v + 1)) for c in told(r)), 6)) for r in rows), key=str)
        assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=str) == want
        assert all(r.score <= 0 for r in got)
        lowest[most, chunk] = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): round(r.score, 6) for r in got}
    a, b, *_ = lowest.values()
    assert a == b
    assert ngrams.score_texts(empty(spark), held).count() == 0
    assert {r.score for r in ngrams.score_texts(docs, F.lit(True)).collect()} == {0.0}


def test_language_model_is_a_probability(spark):
    train = ["a b c d e f", "a b c d e g", "a b c d e f", "x y z", ""]
    rows = [*enumerate(train), (10, "x y"), (11, "a b c d e f g"), (12, "b c d e f unknown q"), (13, None), (14, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, probability = exact_model([t.split() for t in train])
    for before in ([], ["a"], ["q"], list("abcd"), list("bcde"), list("xyzq")):
        assert math.isclose(sum(probability(before, w) for w in [*"abcdefgxyz", None, "other"]), 1)
    want = {i: sum(math.log10(probability((t or "").split()[:k], w)) for k, w in enumerate([*(t or "").split(), None])) for i, t in rows}
    for most in (ngrams.MOST_BYTES, 0):
        got = {r.doc_id: r.score for r in ngrams.score_texts(docs, F.col("doc_id") >= 10, most, bits_per_key=100).collect()}
        assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want), (got, want)


def test_probabilities_never_sum_to_more_than_one():
    r = np.random.default_rng(3)
    for _ in range(20):
        followers = r.geometric(0.02, 50)
        level, c = ngrams.levels(followers), followers.sum()
        for context, filled in ((ngrams.levels(np.array([c])), 1), (np.zeros(1, int), 0)):
            run = np.append(level * filled, 0)  # the last one stands for all unknown words
            first = np.append(ngrams.levels(followers), 0)
            p = ngrams.smoothed([first, run, run * 0], [np.broadcast_to(context, 51), np.zeros(51, int)], 50, ngrams.LOW[first].sum())
            assert 0.85 < p.sum() <= 1 + 1e-12


def test_runs_travel_whole():
    r = np.random.default_rng(5)
    for keys in (np.unique(r.integers(1, 1 << 62, 900).astype(np.uint64)), np.unique(r.integers(0, 1 << 32, 900).astype(np.uint64)) + (np.uint64(7) << np.uint64(32)), np.array([0, (1 << 64) - 1], np.uint64), np.array([5 << 32], np.uint64)):
        assert (ngrams.unpacked(ngrams.packed(keys)) == keys).all()
    numbers = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert (ngrams.expanded(ngrams.squeezed(numbers)) == numbers).all() and not len(ngrams.expanded(ngrams.squeezed(numbers[:0])))


def test_filter_has_no_false_negatives():
    r = np.random.default_rng(0)
    codes = np.unique(r.integers(1, 1 << 63, 5000).astype(np.uint64))
    level = ngrams.levels(r.geometric(0.1, len(codes)))
    held = ngrams.build(codes, level)
    found = ngrams.probe(held, codes)
    assert (found >= level).all() and (found == level).mean() > 0.95
    assert (ngrams.probe(held, r.integers(1, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.05


def test_words_in_slices(monkeypatch):
    texts = [b"One two", b"", b" \t ", b"x" * 50 + b" yy", "é ü".encode()]
    whole = textcodes.words(texts)
    for size in (1, 3, 16):
        monkeypatch.setattr(textcodes, "SLICE", size)
        assert all(np.array_equal(a, b) if isinstance(a, np.ndarray) else a == b for a, b in zip(whole, textcodes.words(texts), strict=True))


def vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(100 + k, (v + r.normal(size=16) * 0.05).tolist()) for k, v in enumerate(base[:20])]
    rows += [(50, base[0].tolist()), (51, base[0].tolist()), (52, (3 * base[1]).tolist()), (53, None), (54, [0.0] * 16), (55, [float("nan")] * 16), (56, [None] * 16), (57, []), (58, base[2][:8].tolist()), (None, base[3].tolist())]
    return spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, class string")


def test_vector_duplicates(spark):
    rows = [(r.vec_id, r.embedding) for r in vectors(spark).collect()]
    use = [v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v) for _, v in rows]
    full = np.array([[*v, *[0.0] * (16 - len(v))] if u else [0.0] * 16 for (_, v), u in zip(rows, use, strict=True)])
    unit = full / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-300)
    link = (unit @ unit.T >= 0.95) & np.outer(use, use) & ~np.eye(len(rows), dtype=bool)
    group = list(range(len(rows)))
    for _ in rows:
        for a, b in zip(*np.nonzero(link), strict=True):
            group[a] = group[b] = min(group[a], group[b])
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        component = min(ids, default=None) if use[k] else i
        want.append((i, int(link[k].sum()), component, i is not None and i == component))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectordup.near_duplicate_vectors(vectors(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert vectordup.near_duplicate_vectors(vectors(spark).limit(0)).count() == 0


def test_top_k(spark):
    v = vectors(spark)
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding] + [0] * (16 - len(r.embedding))) for r in v.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = []
    for i, q in rows:
        if i % 10 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in rows if j != i))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = [tuple(r) for r in topk.top_k(v, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(v.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_blocks_are_pruned():
    r = np.random.default_rng(0)
    centres = r.integers(-400, 400, (30, 8))
    blocks = [(np.arange(64) + 64 * k, c + r.integers(-5, 5, (64, 8))) for k, c in enumerate(centres)]
    queries = centres[:5]
    q, d, s, visited = topk.search_blocks(queries, np.full(5, -1), np.full(5, np.iinfo(np.int64).min), blocks, 5)
    scores = queries @ np.concatenate([b for _, b in blocks]).T
    assert sorted(s[q == 0])[::-1] == sorted(scores[0])[::-1][:5] and visited < 5 * 30


def test_warc(spark):
    html = "é<p>x</p>" * 4000
    rows = [(1, "http://a/ b", html), (2, None, html), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", html), (5, "http://f", "WARC/1.1\r\n\r\n\r\n"), (5, "http://f", "WARC/1.1\r\n\r\n\r\n"), (6, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        again = i is not None and top is not None and i < top
        want.append((i, len(b), warc.sha1_base32(b), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_token_counts(spark):
    path = P.path("word_bpe_49k.json")
    known = set(wordpieces.vocabulary(path))

    def greedy(w):
        n = at = 0
        while at < len(w):
            at = next(k for k in range(len(w), at, -1) if w[at:k] in known)
            n += 1
        return n

    docs = odd_docs(spark).union(spark.createDataFrame([(400, "Straße naïve 数据 " + "ab" * 3000, "de", None, 0, "", "")], DOCS))
    want = sorted(((r.doc_id, len(words(r.text)), sum(greedy(w.encode()) for w in words(r.text)), 0) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in wordpieces.count_tokens(docs, path).collect()), key=str) == want
    assert wordpieces.Automaton([b"a", b"ab", b"bc"]).counts(np.frombuffer(b"abcabx", np.uint8), np.array([0, 3, 4]), np.array([3, 6, 5])).tolist() == [-1, -1, -1]


def test_encoding(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd_docs(spark).union(spark.createDataFrame([(500, "a  b\n\n▁x 🙂 " + "q" * 500, "en", None, 0, "", "")], DOCS))
    got = sorted((tuple(r) for r in pieces.encode_documents(docs, path, digest=True).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = (mixing.mix(d).toPandas().sort_values("doc_id").reset_index(drop=True) for d in (docs, docs.repartition(7)))
    assert one.equals(two)
    assert (one.taken <= 2 * one["size"]).all() and (one.taken % one["size"].where(one["size"] > 0, 1) == 0).all()
    sums = one.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert np.isclose(sums.target.sum(), 1.5 * sums["size"].sum()) and (sums.target <= 2 * sums["size"] + 1e-6).all()
    assert ((sums.taken - sums.target).abs() <= sums.largest).all()
    odd = odd_docs(spark)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score_quality(docs, labels).join(labels.filter("quality is not null"), "doc_id").filter(fold("doc_id", 3, 1)).toPandas()
    assert ((scored.quality_score >= 0.5) == scored.quality).mean() > 0.97
    told = langid.identify(docs).filter(fold("doc_id", 4, 2) & F.col("lang").isNotNull()).toPandas()
    assert (told.lang_pred == told.lang).mean() > 0.97
    odd = {r.doc_id: r.lang_pred for r in langid.identify(odd_docs(spark)).collect()}
    assert [odd[k] for k in (300, 301, 302, 305)] == ["und"] * 4 and odd[303] == "en"
    assert quality.score_quality(odd_docs(spark), labels.limit(0)).filter("quality_score = 0.5").count() == odd_docs(spark).count()
    assert langid.identify(empty(spark)).count() == 0 and quality.score_quality(empty(spark), labels).count() == 0


def test_recall_of_pivots(spark):
    """Groups of turned copies at all angles around the threshold, among vectors that link with nothing."""
    r = np.random.default_rng(12)
    base = r.normal(size=(3000, 32))
    near = np.repeat(base[:150], 4, axis=0) + r.normal(size=(600, 32)) * r.uniform(0.05, 0.25, 600)[:, None]
    every = np.concatenate([base, near])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    got = vectordup.near_duplicate_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>")).collect()
    found = {x.vec_id: x.n_links for x in got}
    assert close.sum() > 1500 and all(found[k] <= n for k, n in enumerate(close.sum(axis=1)))
    assert sum(found.values()) >= 0.97 * close.sum()


def test_candidates_share_pivots():
    r = np.random.default_rng(1)
    named = np.stack([r.permutation(12)[:8] for _ in range(60)]).astype(np.int32)
    shared = lambda a, b, n: len(set(named[a, :n].tolist()) & set(named[b, :n].tolist()))
    for rule in ((6, 3, 4), (6, 2, 4), (8, 1, 5), (5, 2, 2)):
        keys = vectordup._keys(named, rule)
        want = {(a, b) for a in range(60) for b in range(a + 1, 60) if shared(a, b, rule[0]) >= rule[1] and shared(a, b, 8) >= rule[2]}
        seen, listed = set(), []
        for key in np.unique(keys).tolist():
            mine = np.flatnonzero((keys == key).any(axis=1))
            listed += [(key, k) for k in mine.tolist()]
            for i, j in vectordup.candidates(named[mine], key, rule):
                pairs = set(zip(mine[i].tolist(), mine[j].tolist(), strict=True))
                assert not pairs & seen
                seen |= pairs
        assert seen == want
        rows = np.array([k for _, k in listed])
        every = [(int(rows[a]), int(rows[b])) for i, j in vectordup.short_candidates(named[rows], np.array([k for k, _ in listed]), rule) for a, b in zip(i, j, strict=True)]
        assert len(every) == len(set(every)) and set(every) == want


@pytest.mark.parametrize("n", [83, 1000, 4096])
def test_recall_by_number_of_pivots(n):
    """Pairs at cosines of 0.95 and 0.96, in all 64 dimensions, meet in a list whatever the number of pivots."""
    r = np.random.default_rng(n)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots, a, side = (unit(r.normal(size=(k, 64))) for k in (n, 1500, 1500))
    rule = vectordup._rule(unit(r.normal(size=(1024, 64))), pivots.astype(np.float32))
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    for cosine in (0.95, 0.96):
        x, y = (vectordup.nearest(v, pivots.astype(np.float32)) for v in (a, cosine * a + np.sqrt(1 - cosine**2) * side))
        met = np.array([len(set(p) & set(q)) for p, q in zip(vectordup._keys(x, rule).tolist(), vectordup._keys(y, rule).tolist(), strict=True)]) > 0
        shared = np.array([len(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]) >= rule[2]
        assert (met & shared).mean() >= 0.95


@pytest.mark.parametrize("alike", [0.0, 0.5, 0.85, 0.93])
def test_vectors_that_are_all_alike(spark, alike):
    """All vectors share a direction, so that no two are far apart; links are found, and lists stay shorter than the table."""
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(r.normal(size=(2500, 48)))
    base = np.concatenate([base, unit(base[:200] + 0.25 * unit(r.normal(size=(200, 48))))])
    every = np.concatenate([np.sqrt(1 - alike) * base, np.full((len(base), 1), np.sqrt(alike))], axis=1)
    close = (every @ every.T >= 0.95) & ~np.eye(len(every), dtype=bool)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>")
    found = {x.vec_id: x.n_links for x in vectordup.near_duplicate_vectors(rows).collect()}
    assert close.sum() >= 300 and all(found[k] <= n for k, n in enumerate(close.sum(axis=1)))
    assert sum(found.values()) >= 0.93 * close.sum()
    drawn, rule = vectordup._pivots(rows.selectExpr("embedding vector"), len(every), 49)
    lists = np.unique(vectordup._keys(vectordup.nearest(every, drawn), rule), return_counts=True)[1]
    assert len(drawn) >= 16 and lists.max() < 0.6 * len(every)


def test_voting_against_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = [(r.text or "").encode() for r in docs.limit(150).collect()] + [b"", b"word " * 1000]
    got = model.scores(texts)
    for text, score in zip(texts, got, strict=True):
        x = model.latent(*quality.features([text]))[0].astype(float)
        near = sorted(((-float(np.dot(x, k)), y) for k, y in zip(model.known.astype(float), model.labels, strict=True)))[: quality.NEIGHBOURS]
        votes = [(((1 - d) / 2) ** quality.POWER, y) for d, y in near]
        assert math.isclose(score, sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs_tol=0.02)
    whole, parts = quality._pairs([b"ab, c " * 1000]), None
    keep, quality.SLICE = quality.SLICE, 777
    try:
        parts = quality._pairs([b"ab, c " * 1000])
    finally:
        quality.SLICE = keep
    assert (whole == parts).all()


def test_names_that_clash(spark):
    """Columns named like the operators' own are kept as they are."""
    names = ["quality_score", "lang_pred", "lang_score", "lang_told", "m_id", "s_id", "s_hash", "count", "row", "copies", "rows", "id", "hash", "nth", "bucket", "n", "class", "key"]
    odd = odd_docs(spark).select("doc_id", "text", "lang", "source", *[F.lit(f"own {c}").alias(c) for c in names])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for stage in (lambda d: quality.score_quality(d, labels), langid.identify, neardup.representatives, mixing.mixed_documents):
        for rows in (odd, odd.limit(0)):
            out = stage(rows)
            assert out.columns[: len(rows.columns)] == rows.columns
            kept = out.collect()
            assert all(r[c] == f"own {c}" for r in kept for c in names) and bool(kept) == (rows is odd)
    assert sum(r.n for r in mixing.mix(odd).groupBy().agg(F.sum("copies").alias("n")).collect()) == mixing.mixed_documents(odd).count()
    stays = pytest.importorskip("corpus_pipeline").identify_language(spark, odd, SF)
    assert stays.columns == odd.columns and stays.filter("lang_pred <> 'own lang_pred'").count() == 0


def test_mixing_shares_copies_of_one_id(spark):
    docs = spark.createDataFrame([(None, f"word {k} of many" + " more" * (k % 7), "a") for k in range(900)] + [(7, "same text here", "b")] * 40 + [(8, None, "b"), (9, "", None)], "doc_id long, text string, source string")
    plan = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert got == Counter({k: n for k, n in plan.items() if n})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_value(spark, name):
    oracle.compare(spark, name, QUERIES[name], ORACLES[name], SF)
