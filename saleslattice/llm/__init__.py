"""Training-data operators. ``queries()`` and ``oracle_sql()`` list what is registered."""

from __future__ import annotations


def queries() -> dict:
    from . import bpe, decontam, fmindex, forest, langid, lines, media, negatives, simhash, structure, suffix, toxicity, warc

    return {
        "op1_warc_derivatives": warc.op1_warc_derivatives,
        "op2_media_columns": media.op2_media_columns,
        "op3_near_dedup": forest.op3_near_dedup,
        "op4_substring_dedup": fmindex.op4_substring_dedup,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
        "op8_bpe": bpe.op8_bpe,
        "op9_suffix_dedup": suffix.op9_suffix_dedup,
        "op10_language_id": langid.op10_language_id,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_simhash_dedup": simhash.op12_simhash_dedup,
        "op13_structure_repair": structure.op13_structure_repair,
    }


def oracle_sql() -> dict[str, str]:
    from . import lines, negatives

    return {"op5_line_dedup": lines.OP5_SQL, "op11_hard_negatives": negatives.OP11_SQL}
