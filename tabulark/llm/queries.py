"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from . import chat_format, decontaminate, language_id, ngram_join, pii, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, token_records
from .shared import table


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.pii_spans(docs, pii.fit_tagger(pii.context_sample(docs)))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_chat_format(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.Ppm(language_id.labelled_sample(docs)))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.quality_filter(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_records(spark, sf_dir):
    return token_records.write_token_records(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_pii, op3_substring_dedup, op4_chat_format, op5_language_id, op6_quality_rules, op7_decontaminate, op8_token_records, op9_quality_classifier, op10_sentencepiece)}
SQL = {"op1_ngram_jaccard": ngram_join.SQL, "op3_substring_dedup": substring_dedup.SQL, "op4_chat_format": chat_format.SQL, "op6_quality_rules": quality_rules.SQL}
