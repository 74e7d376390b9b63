"""The pipeline against brute force on a small table, from the scores of its models on."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from isohyet.llm import langid, mixing, quality
from isohyet.llm.common import fold, give_back, table

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def first_of_groups(texts):
    """Smallest id of each group of texts linked by a resemblance of 0.75 or more."""
    sets, root, holders = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(set)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in set().union(*(holders[s] for s in sets[i])):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for s in sets[i]:
            holders[s].add(i)
    return {i for i in texts if top(i) == i}


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    told = langid.identify(docs).withColumn("held", fold("doc_id", 4, 2)).collect()
    known = {r.doc_id for r in told if r.lang_pred != "und" and r.lang_score >= 0.5}
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()} == known
    lettered = [r for r in told if r.lang_pred != "und"]
    assert 0 < sum(r.doc_id not in known for r in lettered)
    sure = [r.doc_id in known for r in lettered if r.held and r.lang == r.lang_pred]
    assert len(sure) > 200 and np.mean(sure) >= 0.99

    left = docs.filter(docs.doc_id.isin(sorted(known)))
    good = {r.doc_id: r.text for r in quality.score_quality(left, table(spark, SF, "labels")).collect() if r.quality_score >= 0.5}
    one = first_of_groups(good)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs.filter(docs.doc_id.isin(sorted(one)))).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = []
    for i in one:
        ids = lib.encode(good[i], add_bos=True, add_eos=True)
        want += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] * copies[i]
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(one) < len(good) < len(known) and sorted(got) == sorted(want)


def test_freed_memory_of_the_driver_goes_back(spark):
    """The JVM frees nearly all of many small native buffers; the system has them back before the next stage begins."""
    driver = spark.sparkContext._gateway.proc.pid
    resident = lambda: int(re.search(r"Rss:\s+(\d+)", open(f"/proc/{driver}/smaps_rollup").read())[1]) // 1024
    docs, stage = table(spark, SF, "documents").limit(1), dict(corpus_pipeline.STAGES)["sentencepiece"]
    stage(spark, docs, SF)  # code is loaded
    assert give_back(spark)
    deflaters = [spark._jvm.java.util.zip.Deflater() for _ in range(400)]
    out = spark.sparkContext._gateway.new_array(spark._jvm.byte, 100)
    for d in deflaters:
        d.setInput(bytes(range(256)) * 100)
        d.finish()
        d.deflate(out)
    for d in deflaters[:-1]:  # the last one lies above the others
        d.end()
    held = resident()
    stage(spark, docs, SF)
    assert resident() < held - 20
    deflaters[-1].end()


def test_mixing_ranks_repeated_ids_only(spark):
    docs = table(spark, SF, "documents").limit(300)
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert "Window" not in mixed._jdf.queryExecution().optimizedPlan().toString()
    got = Counter(r.doc_id for r in mixed.collect())
    assert got == Counter({k: n for k, n in want.items() if n}) and mixed.columns == docs.columns
    twice = docs.unionByName(docs.limit(5))
    mixed = mixing.mixed_documents(twice)
    assert "Window" in mixed._jdf.queryExecution().optimizedPlan().toString()
    want = Counter()
    for r in mixing.mix(twice).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want
