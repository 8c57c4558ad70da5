"""The registered queries of the training-data operators, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import corpus_pipeline
from corpusloom.llm.covering import op12_covering_simhash
from corpusloom.llm.decontaminate import op7_decontaminate
from corpusloom.llm.filter_audit import OP11_SQL, op11_filter_audit
from corpusloom.llm.html_extract import op8_html_extract
from corpusloom.llm.langid import op1_langid
from corpusloom.llm.minhash import op5_minhash
from corpusloom.llm.mixing import op2_mixing
from corpusloom.llm.onebit import op4_onebit_ann
from corpusloom.llm.pii_lstm import op6_pii
from corpusloom.llm.token_count import op3_token_count
from corpusloom.llm.token_orc import op10_token_orc
from corpusloom.llm.toxicity import op9_toxicity
from corpusloom.llm.whitening import op13_whitening


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_langid": op1_langid,
        "op2_mixing": op2_mixing,
        "op3_token_count": op3_token_count,
        "op4_onebit_ann": op4_onebit_ann,
        "op5_minhash": op5_minhash,
        "op6_pii": op6_pii,
        "op7_decontaminate": op7_decontaminate,
        "op8_html_extract": op8_html_extract,
        "op9_toxicity": op9_toxicity,
        "op10_token_orc": op10_token_orc,
        "op11_filter_audit": op11_filter_audit,
        "op12_covering_simhash": op12_covering_simhash,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": OP11_SQL}
