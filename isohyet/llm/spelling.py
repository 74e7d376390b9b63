"""Spelling variants: words that differ by one character, found by merging subtrees of a trie of errata.

Two words one edit apart part at a node of the trie of all words. There, either both go on alike behind
different characters (one was replaced), or one goes on behind a character as the other does from
the node itself (one was left out). A node with more words than ``limit`` is worked on by Spark: each of its words is sent, with
its character at the node's depth left out, to the group of words that coincide. The subtrees below
hold at most ``limit`` words; each is merged in a task. Of the children of a node the largest stays
where it is (the heavy path); words of the others, the light ones, are merged into one map of remaining
paths, smaller ones into larger, and looked up below the heavy child and below the node. A word lies in few light
subtrees, so that a task's work is near linear. Paths are kept whole, as slices of sorted words, so that
neither memory nor recursion grows with the length of a word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import materialise

RUN = "[A-Za-zÀ-ÿ]"
SHORTEST = 7  # code points of a word
DAMAGE = 31  # a run loses a character if its digest is divisible by this
FORM_TIMES = 10  # a form occurs at least so many times as often as its variant
#: Words of a subtree that one task merges, and the most hot nodes of one depth: beyond 250 million words the subtrees grow with them.
LIMIT, HOT_NODES = 50_000, 5_000
WORDS_HELD = 200_000  # distinct words that a task counts before it sends them on


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: words of at least SHORTEST code points and two occurrences.

    A run's digest is the crc32 of its document's id (none: nothing), a colon and the run with A-Z lower-cased.
    """
    long_run = re.compile(RUN + "{%d,}" % SHORTEST)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter(long_run.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), before)
                    if h % DAMAGE == 0:
                        if len(w) == SHORTEST:
                            continue
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    held[w] = held.get(w, 0) + n
                if len(held) >= WORDS_HELD:
                    yield batch_of()
        yield batch_of()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")


class Near:
    """How many words are near to each word, and the one that occurs most often (of equals the first in order)."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.n = [0] * len(words)
        self.best: list[tuple[int, str] | None] = [None] * len(words)

    def link(self, a: int, b: int) -> None:
        for x, y in ((a, b), (b, a)):
            self.n[x] += 1
            told = (-self.counts[y], self.words[y])
            if self.best[x] is None or told < self.best[x]:
                self.best[x] = told


def merge_errata(words: list[str], counts: list[int], depth: int) -> Near:
    """Links every two of the sorted ``words``, alike up to ``depth``, that part by one character there or behind."""
    near = Near(words, counts)
    place = {w: k for k, w in enumerate(words)}
    todo = [(0, len(words), depth)] if len(words) > 1 else []
    while todo:
        lo, hi, d = todo.pop()
        a, b = words[lo], words[hi - 1]
        most = min(len(a), len(b))
        while d < most and a[d] == b[d]:  # words between the first and the last share what these share
            d += 1
        node = lo if len(a) == d else None
        children = _children(words, lo + (node is not None), hi, d)
        todo += [(x, y, d + 1) for x, y in children if y - x > 1]
        children.sort(key=lambda c: c[0] - c[1])
        if node is not None:  # the word of the node, and one more character
            for x, _ in children:
                if len(words[x]) == d + 1:
                    near.link(node, x)
        if len(children) < 2:
            continue
        path = a[:d]
        heavy = path + words[children[0][0]][d]
        errata: dict[str, list[int]] = {}
        for x, y in children[1:]:
            light = words[x][d]
            for k in range(x, y):
                w = words[k]
                rest = w[d + 1 :]
                # replaced: the same path behind another light character, or behind the heavy one
                for other in errata.get(rest, ()):
                    near.link(other, k)
                other = place.get(heavy + rest)
                if other is not None:
                    near.link(other, k)
                # left out: this word without its light character; the last of a run stands for the run
                if rest and rest[0] != light:
                    other = place.get(path + rest)
                    if other is not None:
                        near.link(other, k)
                # a word below the heavy child that is this one with the heavy character put in
                other = place.get(heavy + w[d:])
                if other is not None:
                    near.link(other, k)
            for k in range(x, y):
                errata.setdefault(words[k][d + 1 :], []).append(k)
    return near


def _children(words: list[str], lo: int, hi: int, d: int) -> list[tuple[int, int]]:
    """Ranges of sorted words with one character at ``d``, found by doubling steps."""
    out = []
    while lo < hi:
        c, step, at = words[lo][d], 1, lo
        while at + step < hi and words[at + step][d] == c:
            at += step
            step *= 2
        while step:
            if at + step < hi and words[at + step][d] == c:
                at += step
            step //= 2
        out.append((lo, at + 1))
        lo = at + 1
    return out


def _nodes(words: DataFrame, limit: int) -> DataFrame:
    """``words`` with depth, the length of the shortest prefix that at most ``limit`` words share (of a word that is such a prefix: its length)."""
    total = words.count()
    limit = max(limit, total // HOT_NODES)
    hot, depth, parts = words, 0, []
    if total <= limit:
        return words.withColumn("depth", F.lit(0))
    while True:
        depth += 1
        prefix = F.substring("word", 1, depth)
        # at most HOT_NODES prefixes of one depth have more than a HOT_NODES-th of all words
        crowded = materialise(hot.groupBy(prefix.alias("prefix")).count().filter(F.col("count") > limit).select("prefix"), "spelling_hot")
        marked = hot.withColumn("prefix", prefix).join(F.broadcast(crowded.withColumn("crowded", F.lit(True))), "prefix", "left")
        more = F.coalesce("crowded", F.lit(False)) & (F.length("word") > depth)
        parts.append(marked.filter(~more).select("word", "n", F.lit(depth).alias("depth")))
        if crowded.isEmpty():
            break
        hot = materialise(marked.filter(more).select("word", "n"), "spelling_below")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _told(word: Column, n: Column) -> Column:
    return F.struct((-n).alias("less"), word.alias("word"))


def _above(words: DataFrame) -> DataFrame:
    """word, n_near, best from nodes above the words' depth: words that coincide with a character left out.

    A group holds the words that differ in one place only, so it is never larger than the alphabet (times the depth).
    """
    at = F.col("at")
    sent = words.filter("depth > 0").select("word", "n", F.explode(F.expr("sequence(-1, depth - 1)")).alias("at"))
    char, behind = F.expr("substring(word, at + 1, 1)"), F.expr("substring(word, at + 2, 1)")
    sent = sent.select("word", "n", "at", F.when(at < 0, F.col("word")).otherwise(F.expr("concat(substring(word, 1, at), substring(word, at + 2))")).alias("key"), (char != behind).alias("last"))
    told = _told(F.col("word"), F.col("n"))
    replaced = sent.filter("at >= 0").groupBy("key", "at").agg(F.sort_array(F.collect_list(told)).alias("all")).filter("size(all) > 1")
    replaced = replaced.select("all", F.posexplode("all").alias("k", "one")).select(F.col("one.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("k") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    left_out = sent.filter("at < 0 or last").groupBy("key").agg(F.max(F.when(at < 0, told)).alias("whole"), F.sort_array(F.collect_list(F.when(at >= 0, told))).alias("all")).filter("whole is not null and size(all) > 0")
    shorter = left_out.select(F.col("whole.word").alias("word"), F.size("all").cast("long").alias("n_near"), F.col("all")[0].alias("best"))
    longer = left_out.select("whole", F.explode("all").alias("one")).select(F.col("one.word").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("whole").alias("best"))
    return replaced.unionByName(shorter).unionByName(longer)


def _below(words: DataFrame) -> DataFrame:
    """word, n_near, best within each subtree, merged in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        node: tuple | None = None

        def merged() -> pa.RecordBatch:
            near = merge_errata([w for w, _ in held], [n for _, n in held], node[1])
            some = [k for k, n in enumerate(near.n) if n]
            best = pa.array([{"less": near.best[k][0], "word": near.best[k][1]} for k in some], pa.struct([("less", pa.int64()), ("word", pa.string())]))
            return pa.RecordBatch.from_arrays([pa.array([held[k][0] for k in some], pa.string()), pa.array([near.n[k] for k in some], pa.int64()), best], ["word", "n_near", "best"])

        for batch in batches:
            for prefix, depth, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (prefix, depth) != node:
                    if len(held) > 1:
                        yield merged()
                    held.clear()
                    node = (prefix, depth)
                held.append((word, n))
        if len(held) > 1:
            yield merged()

    rows = words.select(F.expr("substring(word, 1, depth)").alias("prefix"), "depth", "word", "n")
    return rows.repartition("prefix", "depth").sortWithinPartitions("prefix", "depth", "word").mapInArrow(work, "word string, n_near long, best struct<less:long,word:string>")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form: each round doubles the steps taken. Counts grow tenfold a step, so rounds are few."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialise(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per distinct word of at least two occurrences.

    Null and empty texts have no words; rows of one id and repeated rows count each; a document without an id
    digests as an empty one; texts and words of any length are read whole; an empty table gives no rows. Only doc_id and text are read.
    """
    words = materialise(_nodes(materialise(count_words(docs), "spelling_counts"), limit), "spelling_words")
    near = _above(words).unionByName(_below(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    found = words.select("word", "n").join(near, "word", "left")
    has = -F.col("best.less") >= FORM_TIMES * F.col("n")
    found = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "spelling_forms")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
