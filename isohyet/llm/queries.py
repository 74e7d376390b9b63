"""The registered text queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import langid, mixing, neardup, ngrams, packing, phrases, pieces, quality, spelling, topk, vectordup, warc, wordpieces
from isohyet.llm.common import fold, table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 7, 2))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "group_id")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = langid.identify(table(spark, sf_dir, "documents"))
    return told.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wordpieces.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_topk_search, op2_warc, op3_lm_scoring, op4_quality, op5_minhash, op6_langid, op7_pivots, op8_mixing, op9_sentencepiece, op10_token_counts, op11_packing, op12_phrases, op13_spelling)}

ORACLES: dict[str, str] = {
    "op1_topk_search": """
with v as (
  select vec_id, [cast(floor(cast(x as double) * 256) as bigint) for x in embedding] as q from embeddings
  where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum([a.q[i] * b.q[i] for i in range(1, least(len(a.q), len(b.q)) + 1)]) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
""",
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
t as (select html, max(page_id) as top from p group by html),
h as (select page_id, top, strlen(html) as payload_bytes, sha1(html) as hex from p join t using (html))
select page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(hex, 5 * (k // 4) + 1, 5) as bigint) >> (15 - 5 * (k % 4))) & 31 as int) + 1, 1) for k in range(0, 32)], '') as payload_digest,
  case when page_id < top then 'revisit' else 'response' end as record_type, case when page_id < top then top end as refers_to
from h
""",
    "op5_minhash": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as shingle from d),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 75 * (x.n + y.n - m)),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on l.a = r.b),
least_of as (select a, min(b) as b from reached group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(least_of.b, d.doc_id)) as component_id, d.doc_id <= coalesce(least_of.b, d.doc_id) as kept
from d left join n on n.doc_id = d.doc_id left join least_of on least_of.a = d.doc_id
""",
    "op7_pivots": """
with recursive v as (
  select vec_id, [cast(x as double) for x in embedding] as e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.95),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on l.a = r.b),
least_of as (select a, min(b) as b from reached group by a),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0) as n_links, least(vec_id, coalesce(least_of.b, vec_id)) as component_id, vec_id <= coalesce(least_of.b, vec_id) as kept
from embeddings left join least_of on least_of.a = vec_id left join n on n.a = vec_id
""",
    "op12_phrases": r"""
with d as (select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
p as (select lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') as w from d),
g as (select lang, n, array_to_string(w[i:i + n - 1], ' ') as phrase from p, range(1, 5) t(n), range(1, len(w) - n + 2) u(i)),
f as (select lang, n, phrase, count(*) as a from g group by all),
total as (select lang, sum(a) as n from f where n = 1 group by lang),
c as (select lang, n as size, phrase, a, string_split(phrase, ' ') as w from f where n > 1 and a >= 30),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest from c, range(1, 4) t(k) where k < size),
scored as (
  select cuts.lang, cuts.phrase, cuts.a, x.a as l, y.a as r, cast(2000000::hugeint * cuts.a // (x.a::hugeint + y.a) as bigint) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = first join f y on y.lang = cuts.lang and y.phrase = rest
  qualify row_number() over (partition by cuts.lang, cuts.phrase order by 2000000::hugeint * cuts.a // (x.a::hugeint + y.a), k) = 1),
inside as (
  select lang, array_to_string(w[i:i + n - 1], ' ') as phrase, max(a) as most
  from c, range(2, 4) t(n), range(1, size - n + 2) u(i) where n < size group by 1, 2),
ranked as (
  select s.lang, row_number() over (partition by s.lang order by score desc, s.a desc, s.phrase) as rank, s.phrase, s.a, l, r, cast(total.n as bigint) as n, score
  from scored s join total on total.lang = s.lang left join inside on inside.lang = s.lang and inside.phrase = s.phrase
  where most is null or 100::hugeint * most < 80::hugeint * s.a)
select * from ranked where rank <= 2000
""",
    "op13_spelling": r"""
with recursive runs as (
  select doc_id, w, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents)
  where length(w) >= 7 group by all),
raw as (select w, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || w)) as x from runs),
bits as (select w, n, list_prepend(4294967295::bigint, flatten([[cast((cast('0x' || x[2 * i - 1:2 * i] as bigint) >> b) & 1 as bigint) for b in range(0, 8)] for i in range(1, length(x) // 2 + 1)])) as bits from raw),
hashed as (select w, n, xor(list_reduce(bits, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) as h from bits),
damaged as (select case when h % 31 = 0 then w[1:(h % length(w))::bigint] || w[(h % length(w))::bigint + 2:] else w end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from damaged where length(word) >= 7 group by word having sum(n) >= 2),
gaps as (select word, n, i, word[1:i - 1] || word[i + 1:] as rest from words, range(1, length(word) + 1) t(i)),
near as (
  select distinct a.word, b.word as other, b.n from gaps a join gaps b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as n from near group by word),
found as (
  select words.word, words.n, coalesce(n_near, 0) as n_near, case when best.n >= 10 * words.n then other end as form, case when best.n >= 10 * words.n then best.n end as form_n
  from words left join best on best.word = words.word),
steps(word, root) as (select word, form from found where form is not null union select steps.word, found.form from steps join found on found.word = steps.root where found.form is not null),
roots as (select steps.word, root from steps join found on found.word = steps.root where found.form is null)
select found.word, form, coalesce(root, found.word) as root, n, n_near, form_n from found left join roots on roots.word = found.word
""",
}
