"""A corpus pipeline over documents: every stage takes what its predecessor kept.

language:  documents whose language the network cannot tell go; a missing language is filled in.
neardup:   of each group of near duplicates the document with the smallest id stays.
benchmark: documents that hold a benchmark item go.
secrets:   live credentials are masked in the texts; every document stays.
mixing:    the source schedule over what is left: the texts, and which words of them each slot of the mix takes.

Every stage takes any documents table (doc_id, text, lang, source, n_chars, and further columns under any name, which
it passes on unread; only the last one leaves them out).  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from larkspur.llm import credentials, decontaminate, language, mixing, neardup
from larkspur.llm.common import settle, staged, table

#: How far the network's best language must be above an even guess, on the way to certainty; texts of a word or two
#: that several languages share come out near 0.1.
MARGIN = 0.05


def language_stage(spark, docs, sf_dir):
    """Keeps the documents whose language is told (op 9); learns from the labelled documents it is given.

    Null, empty and letterless texts, and those whose best language is hardly above an even guess (MARGIN), go; texts
    of any length are read whole.  A null lang is filled in, one that is there stays.  A null id is no reason to go; repeated rows
    fare alike.  Without any labelled document nothing is learnt, and all stay as they are."""
    net = language.train_network(*language.training_sample(docs))
    return language.keep_identified(docs, net, MARGIN)


def neardup_stage(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates (op 4): the one with the smallest id.

    Texts without words are near nothing and stay; rows without an id all stay; repeated rows of one id stay once,
    and of different rows that share an id one stays."""
    return neardup.keep_one(docs)


def benchmark_stage(spark, docs, sf_dir):
    """Keeps the documents that hold no benchmark item (op 5).

    Null and wordless texts hold none, and null or wordless items are held by none.  Rows that share an id go or stay
    together; of rows without an id all go if one holds an item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark, docs, sf_dir):
    """Masks live credentials (op 3); every row stays, repeated ones too.

    A null text stays null; n_chars follows the masked text and is otherwise left as it is; a null source is one
    unnamed repository, and a null id is no obstacle."""
    return credentials.masked(docs)


def mixing_stage(spark, docs, sf_dir):
    """The mix (op 6): a row for every document, with its text and the blocks that are taken of it.

    Null and wordless texts have size 0 and are never taken; a null source is a source of its own; repeated rows are
    documents of their own."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language", language_stage),
    ("neardup", neardup_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Neither trained language identification nor sketches and latent spaces can be told in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply all stages to documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        settle(spark)
    return docs
