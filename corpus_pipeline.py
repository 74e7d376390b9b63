"""A corpus pipeline: each stage takes the rows that the one before it kept, written and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import langid, mixing, neardup, pieces, quality
from isohyet.llm.common import free_name, give_back, materialise, table

#: Less than a majority of the network's probability for its best language rejects a document. Of held-out labelled
#: documents with a letter, the score's 0.001 quantile is 0.519 at sf0.1 (2,499 of them) and its 0.01 quantile 0.716 at sf0.01 (249).
LEAST_LANGUAGE_SCORE = 0.5

ORACLE_SQL = None  # trained models, minwise hashing and the tokenizer are beyond SQL; tests hold run() against brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or any text (null, empty) go, and those of which the network is unsure.

    Repeated rows are judged alike and null ids kept; an empty table stays empty; further columns are kept, whatever their names.
    """
    lang, score = (F.col(free_name(docs, c)) for c in ("lang_pred", "lang_score"))
    told = langid.identify(docs).filter((lang != langid.UNKNOWN) & (score >= LEAST_LANGUAGE_SCORE))
    return told.select(*[f"`{c}`" for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half go; a score of one half, as without any label, stays.

    Null and empty texts are scored as empty ones. Repeated rows are judged alike and null ids kept; an
    empty table stays empty; further columns are kept, whatever their names.
    """
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col(free_name(docs, "quality_score")) >= 0.5).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays, once.

    Texts without words (null, empty) are in no group: they stay, once for each id. A group without
    any id keeps one row. An empty table stays empty; further columns are kept, whatever their names.
    """
    return neardup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights.

    Null and empty texts have no words to take and go. Null sources are one source; rows of one id share
    its copies; an empty table stays empty; further columns are kept, whatever their names.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, as counts and digests: one row per row.

    A null or empty text has the begin and end ids alone; repeated rows are each encoded, null ids
    kept; an empty table gives no rows; further columns are not read.
    """
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _afresh(stage: Stage) -> Stage:
    """The stage, begun after the driver has handed back what the one before it has freed."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _afresh(identify_language)),
    ("quality", _afresh(keep_quality)),
    ("near_dedup", _afresh(drop_near_duplicates)),
    ("mixing", _afresh(mix_sources)),
    ("sentencepiece", _afresh(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
