"""From raw documents to packed sequences: identify, deduplicate twice, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return
the columns of ``documents``.  An empty table gives an empty one at every stage, texts are read whole whatever their
length, and null ids, languages and sources are values like others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import stored, table
from trailmark.llm.exact_dedup import drop_exact_copies
from trailmark.llm.language_id import identify, learn_profiles
from trailmark.llm.minhash import drop_near_copies
from trailmark.llm.mixture import mixed
from trailmark.llm.packing import pack_documents

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; texts without a letter, null and empty ones among them, go."""
    profiles = learn_profiles(docs.filter(F.col("lang").isNotNull()))
    return identify(docs, profiles).filter("lang_pred <> 'und'").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z and a-z alike) the largest id stays; null and empty texts are one text."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles the smallest id stays; texts without words and null ids stay too."""
    return drop_near_copies(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 0.95 of the entropy of equal weights, none read more than 4 times, as many tokens as there are.

    A row comes as often as its source's weight asks: not at all, once or several times.
    """
    return mixed(docs, target_entropy=0.95, max_repeats=4.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null or empty text is its end token alone."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can't express near-dedup by sketches, nor tokens; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
