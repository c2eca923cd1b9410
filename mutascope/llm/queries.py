"""Registered queries of the training-data operators (``ORACLES``: SQL where it can express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mutascope.llm import (audit, bpe, decontam, html, lattice, licenses, neardup, pii, quality, secrets, spelling, urlrules,
                           warc)
from mutascope.llm.oracles import ORACLES
from mutascope.llm.text import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


def op2_quality_rules(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_poor")


def op3_decontamination(spark, sf_dir):
    return decontam.contamination(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op4_lattice_score(spark, sf_dir):
    return lattice.score(documents(spark, sf_dir))


def op5_html_text(spark, sf_dir):
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_url_filter(spark, sf_dir):
    return urlrules.judge(_table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir))


def op8_licences(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op9_bpe(spark, sf_dir):
    return bpe.encode(documents(spark, sf_dir))


def op10_secrets(spark, sf_dir):
    return secrets.digest(documents(spark, sf_dir))


def op11_warc(spark, sf_dir):
    return warc.archived(spark, _table(spark, sf_dir, "pages"))


def op12_filter_audit(spark, sf_dir):
    return audit.audit(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op13_spelling(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_decontamination, op4_lattice_score, op5_html_text,
                                   op6_url_filter, op7_near_duplicates, op8_licences, op9_bpe, op10_secrets, op11_warc, op12_filter_audit,
                                   op13_spelling)}


__all__ = ["QUERIES", "ORACLES"]
