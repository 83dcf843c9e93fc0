"""The corpus operators' queries: one opN_<name> for each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import bpe, chosenpath, crosspolytope, decontaminate, interaction, langid, linededup, matroska, merkle, pii, quality, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_toxicity": toxicity.query,
        "op3_langid": langid.query,
        "op4_linededup": linededup.query,
        "op5_matroska": matroska.query,
        "op6_warc": warc.query,
        "op7_chosenpath": chosenpath.query,
        "op8_decontaminate": decontaminate.query,
        "op9_bpe": bpe.query,
        "op10_pii": pii.query,
        "op11_crosspolytope": crosspolytope.query,
        "op12_merkle": merkle.query,
        "op13_interaction": interaction.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_linededup": linededup.SQL,
        "op6_warc": warc.SQL,
        "op7_chosenpath": chosenpath.SQL,
        "op8_decontaminate": decontaminate.SQL,
        "op12_merkle": merkle.SQL,
        "op13_interaction": interaction.SQL,
    }
