"""Packing, phrases and spelling variants against brute force, on small tables with nulls, empty, repeated and long texts."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import oracle
from isohyet.llm import packing, phrases, spelling
from isohyet.llm.queries import ORACLES, QUERIES

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, phrase string, start long, key long, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "y", 1, 2, 3) for i, t, lang in rows], DOCS)


def odd_rows():
    r = np.random.default_rng(6)
    letters = [f"{a}{b}" for a in ("ka", "lo", "mé", "tü", "ra") for b in ("n", "r", "st", "ÿ")]
    word = lambda: "".join(r.choice(letters, r.integers(1, 5)))
    vocabulary = [word() for _ in range(60)]
    rows = [(k, " ".join(r.choice(vocabulary, 80)) + r.choice([".", "!\n", " , "]) + "The old Mill the old mill; the  old\tmill", ("en", "de", None)[k % 3]) for k in range(40)]
    rows += [(100 + k, "The old mill stands. Here <|endoftext|> there we   go \r\n 日本 don't", "en") for k in range(30)]
    rows += [(200, None, "en"), (201, "", None), (202, " \t\n", "en"), (None, rows[0][1], "en"), (5, rows[5][1], "en"), (5, rows[5][1], "en"), (203, "wörd" * 4000, "und"), (204, " ".join(vocabulary) * 60, "de")]
    return rows


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = odd_rows()
    got = [r.asDict() for r in packing.pack_documents(table(spark, rows), path).collect()]
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    ids_of = {}
    for i, t, _ in rows:
        ids_of.setdefault(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    repeats, tokens = Counter(i for i, _, _ in rows), Counter()
    sequences = defaultdict(list)
    for r in got:
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        for k in range(r["start"], r["start"] + r["length"]):
            tokens[r["doc_id"], k] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert tokens == Counter({(i, k): n for i, n in repeats.items() for k in range(len(ids_of[i]))})
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= packing.CAPACITY and at & (at - 1) == 0  # nothing to pad
    assert packing.pack_documents(table(spark, []), path).count() == 0


def plain_pack(lengths, capacity):
    """The same rule, sequence by sequence."""
    room = packing.rooms(sum(lengths), capacity)
    size, spent, todo, out = list(room), [0] * len(room), [[n, k, 0] for k, n in enumerate(lengths) if n], []
    while todo:
        todo.sort(key=lambda x: (-packing.cost(x[0]), x[1], x[2]))
        n, k, at = todo.pop(0)
        fits = [s for s in range(len(room)) if room[s] >= n]
        if not fits:
            most = max(room)
            fits = [s for s in range(len(room)) if room[s] == most]
            todo.append([n - most, k, at + most])
            n = most
        s = min(fits, key=lambda s: (spent[s], s))
        out.append((k, at, n, s, size[s] - room[s]))
        room[s] -= n
        spent[s] += packing.cost(n)
    return out


def test_packing_rule():
    r = np.random.default_rng(3)
    for _ in range(60):
        lengths = r.integers(0, 64, r.integers(0, 40)).tolist()
        assert packing.pack(lengths, 64) == plain_pack(lengths, 64)
    lengths = r.integers(1, 1024, 2000).tolist()
    costs = Counter()
    for _, _, n, s, _ in packing.pack(lengths):
        costs[s] += packing.cost(n)
    full = [c for s, c in costs.items() if s < sum(lengths) // 1024]
    assert max(full) < 1.16 * min(full)  # equal lengths, so only the quadratic part can differ


def test_units_agree_with_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), packing.Encoder(path, kept=50)
    r = np.random.default_rng(8)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", " ", "　", "\x1c", "a", "bc", "The", "é", "÷", "×", "»", "…", "don't", "'s", "12", "½", "日本", "<|", "<|endoftext|>", ".", ",", "|", ")", "🙂"]
    texts = ["".join(r.choice(parts, r.integers(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    long = "The quick brown foxes, " * 60_000
    assert encoder.encode([long.encode()])[0].tolist() == library.encode(long, add_special_tokens=False).ids


def plain_phrases(rows, least, reported):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, k = min((Fraction(2_000_000 * a, f[p[:k]] + f[p[k:]]).__floor__(), k, k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:reported], 1)]
    return sorted(out)


@pytest.mark.parametrize("reported", [2000, 7])
def test_phrases(spark, monkeypatch, reported):
    monkeypatch.setattr(phrases, "REPORTED", reported)
    monkeypatch.setattr(phrases, "CHUNK", 2000)
    rows = odd_rows()
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, rows)).collect())
    assert got == plain_phrases(rows, phrases.LEAST, reported) and len(got) >= 3
    assert phrases.collocations(table(spark, rows[:0])).count() == 0


def test_filter_has_all_keys(spark):
    rows = spark.createDataFrame([("en", f"w{k % 97} v{k}") for k in range(5000)], "lang string, phrase string")
    import pyarrow as pa

    told = phrases._filter(rows)
    lang, word = phrases._codes(pa.array(["en"])), phrases._codes(pa.array([f"w{k}" for k in range(97)] + [f"v{k}" for k in range(20000)]))
    code = phrases.textcodes.mix(lang * phrases._POWERS[7] + word)
    at = np.arange(20000)
    has = told.has(phrases.gram_codes([code[at % 97], code[97 + at]]))
    assert has[:5000].all() and has[5000:].mean() < 0.1


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spelling(rows):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    linked = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, c in words.items():
        best = min(linked[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * c else None
    out = []
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(linked[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def spelling_rows():
    r = np.random.default_rng(9)
    base = ["".join(r.choice(list("abcé"), r.integers(7, 10))) for _ in range(30)]
    texts = []
    for w in base:
        texts += [w.title() if k % 5 else w for k in range(60)]
        for _ in range(8):
            at, kind = int(r.integers(0, len(w))), int(r.integers(0, 3))
            other = w[:at] + ("" if kind == 0 else str(r.choice(list("abcéÀ")))) + w[at + (kind < 2) :]
            texts += [other] * int(r.integers(1, 6))
    texts += ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa"] * 3 + ["q" * 3000, "q" * 3001] * 2 + ["q" * 1500 + "x" + "q" * 1499] * 30
    rows = [(k if k % 50 else None, f"{t}, {t} 12x", "en") for k, t in enumerate(texts)]
    return rows + [(1, None, None), (2, "", "en"), (3, "short words", "en"), (4, rows[4][1], "en"), (4, rows[4][1], "en")]


@pytest.mark.parametrize("limit", [spelling.LIMIT, 6])
def test_spelling(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "HOT_NODES", 1000)
    rows = spelling_rows()
    got = sorted((tuple(r) for r in spelling.spelling_variants(table(spark, rows), limit).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == plain_spelling(rows)
    assert any(r[1] for r in got)
    assert spelling.spelling_variants(table(spark, [])).count() == 0


def test_merging():
    r = np.random.default_rng(1)
    for k in range(200):
        words = sorted({"".join(r.choice(list("ab" if k % 2 else "abé"), r.integers(0, 7))) for _ in range(40)})
        counts = r.integers(1, 9, len(words)).tolist()
        told = spelling.merge_errata(words, counts, 0)
        for i, w in enumerate(words):
            other = [(-counts[j], x) for j, x in enumerate(words) if near(w, x)]
            assert told.n[i] == len(other) and told.best[i] == min(other, default=None)


@pytest.mark.parametrize("name", ["op12_phrases", "op13_spelling"])
def test_new_queries_against_sql(spark, name):
    oracle.compare(spark, name, QUERIES[name], ORACLES[name], SF)


def test_a_round_of_components_asks_once(spark):
    """One aggregate a round tells of stars and hubs: few jobs, and the components of lines, stars, loops and a hub."""
    from isohyet.llm.components import _ends, components

    made = lambda edges: spark.createDataFrame(edges, "a long, b long")
    cases = {(): (True, None), ((2, 1), (3, 1)): (True, 2), ((2, 1), (3, 2)): (False, 2), ((3, 1), (3, 2)): (False, 2)}
    for edges, (stars, most) in cases.items():
        assert (_ends(made(list(edges))).stars, _ends(made(list(edges))).most) == (stars, most)
    spark.sparkContext.setJobGroup("components-star", "")
    got = {r.node: r.component for r in components(made([(1, k) for k in range(1, 50)])).collect()}
    spark.sparkContext.setJobGroup("components-other", "")
    assert got == dict.fromkeys(range(1, 50), 1)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components-star")) <= 8
    hub = [(1000 + k, 5000) for k in range(600)] + [(k + 1, k) for k in range(20)] + [(20, 1100), (7000, 7001), (7001, 7001)]
    got = {r.node: r.component for r in components(made(hub)).collect()}
    assert got == dict.fromkeys([*range(21), *range(1000, 1600), 5000], 0) | {7000: 7000, 7001: 7000}
