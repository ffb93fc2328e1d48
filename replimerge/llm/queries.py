"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, infill, licenses, mixing, phrases, pii, quality_model, quality_rules, secrets, simhash, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": tokens.query,
    "op2_license_scans": licenses.query,
    "op3_simhash": simhash.query,
    "op4_quality_classifier": quality_model.query,
    "op5_secret_scans": secrets.query,
    "op6_pii": pii.query,
    "op7_quality_rules": quality_rules.query,
    "op8_decontamination": decontamination.query,
    "op9_mixing": mixing.query,
    "op10_chat_formatting": chat.query,
    "op11_fill_in_middle": infill.query,
    "op12_warc_archive": warc.query,
    "op13_phrase_collocations": phrases.query,
}
ORACLES: dict[str, str] = {
    "op2_license_scans": licenses.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_decontamination": decontamination.SQL,
    "op9_mixing": mixing.SQL,
    "op10_chat_formatting": chat.SQL,
    "op11_fill_in_middle": infill.SQL,
    "op12_warc_archive": warc.SQL,
    "op13_phrase_collocations": phrases.SQL,
}
