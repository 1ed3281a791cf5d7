"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op1_mix, op2_warc, op3_grid_join, op4_preferences, op5_toxicity, op6_images, op7_superminhash, op8_lengths, op9_licenses, op10_pack, op11_fill_in_middle, op12_runs, op13_main_text


def queries() -> dict:
    return {
        "op1_mix": op1_mix.op1_mix,
        "op2_warc": op2_warc.op2_warc,
        "op3_grid_join": op3_grid_join.op3_grid_join,
        "op4_preferences": op4_preferences.op4_preferences,
        "op5_toxicity": op5_toxicity.op5_toxicity,
        "op6_images": op6_images.op6_images,
        "op7_superminhash": op7_superminhash.op7_superminhash,
        "op8_lengths": op8_lengths.op8_lengths,
        "op9_licenses": op9_licenses.op9_licenses,
        "op10_pack": op10_pack.op10_pack,
        "op11_fill_in_middle": op11_fill_in_middle.op11_fill_in_middle,
        "op12_runs": op12_runs.op12_runs,
        "op13_main_text": op13_main_text.op13_main_text,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": op1_mix.ORACLE, "op2_warc": op2_warc.ORACLE, "op4_preferences": op4_preferences.ORACLE, "op9_licenses": op9_licenses.ORACLE,
        "op11_fill_in_middle": op11_fill_in_middle.ORACLE, "op13_main_text": op13_main_text.ORACLE}
