"""The registered queries of this subpackage."""

from __future__ import annotations

from taskweave.llm import ann, decontaminate, mixing, neardup, negatives, packing, quality, secrets, substrings, toxicity, urls, variants, warc


def queries() -> dict:
    return {
        "op1_packing": packing.op1,
        "op2_secret_scan": secrets.op2,
        "op3_substring_dedup": substrings.op3,
        "op4_url_filter": urls.op4,
        "op5_decontamination": decontaminate.op5,
        "op6_toxicity": toxicity.op6,
        "op7_near_dedup": neardup.op7,
        "op8_warc": warc.op8,
        "op9_neighbours": ann.op9,
        "op10_quality": quality.op10,
        "op11_hard_negatives": negatives.op11,
        "op12_mix_sources": mixing.op12,
        "op13_spelling_variants": variants.op13,
    }


def oracle_sql() -> dict[str, str]:
    """Scores of trained models, packed places and approximate searches are beyond SQL; tests hold them against brute force."""
    return {
        "op2_secret_scan": secrets.ORACLE,
        "op3_substring_dedup": substrings.ORACLE,
        "op5_decontamination": decontaminate.ORACLE,
        "op7_near_dedup": neardup.ORACLE,
        "op8_warc": warc.ORACLE,
        "op11_hard_negatives": negatives.ORACLE,
        "op13_spelling_variants": variants.ORACLE,
    }
