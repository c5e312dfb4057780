"""Documents made into token ids: one function for each stage, each on what the one before it kept."""

from __future__ import annotations

from tabulark.llm import decontaminate, language_id, ngram_join, pii, sentencepiece_codec
from tabulark.llm.shared import materialize, table


def identify_language(spark, docs, sf_dir):
    """Documents that no language explains well go. The trees are counted from labelled documents of docs."""
    return language_id.keep_identified(docs, language_id.Ppm(language_id.labelled_sample(docs)))


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of documents linked by n-gram Jaccard, the one with the smallest doc_id stays;
    of rows equal in doc_id and text, null or not, one stays."""
    return ngram_join.keep_one_of_each(docs, ngram_join.near_classes(docs))


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def redact_private(spark, docs, sf_dir):
    """Personal data and secrets give way to the name of their kind."""
    return pii.redact(docs, pii.fit_tagger(pii.context_sample(docs)))


def encode(spark, docs, sf_dir):
    """(doc_id, ids, n_tokens, exact)."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_private),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # trained models and Viterbi decoding: SQL can't express them


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
