"""The registered queries of this folder and their DuckDB twins."""
from __future__ import annotations

from basketlab.llm import (op1_decontaminate, op2_quality, op3_line_dedup, op4_mixing,
                           op5_exact_dedup, op6_suffix_dedup, op7_licenses, op8_jaccard,
                           op9_warc, op10_langid, op11_vector_codes, op12_chat_format,
                           op13_fill_in_middle)
from basketlab.session import apply_job_conf

MODULES = [op1_decontaminate, op2_quality, op3_line_dedup, op4_mixing, op5_exact_dedup,
           op6_suffix_dedup, op7_licenses, op8_jaccard, op9_warc, op10_langid, op11_vector_codes,
           op12_chat_format, op13_fill_in_middle]


def _query(fn):
    def run(spark, sf_dir):
        apply_job_conf(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict:
    """opN_<name> -> fn(spark, sf_dir); each module's query has the module's name."""
    names = [m.__name__.rpartition(".")[2] for m in MODULES]
    return {n: _query(getattr(m, n)) for n, m in zip(names, MODULES)}


def oracle_sql() -> dict[str, str]:
    return {m.__name__.rpartition(".")[2]: m.ORACLE for m in MODULES
            if getattr(m, "ORACLE", None)}
