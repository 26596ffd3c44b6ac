"""Queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op10_lines import ORACLE as _OP10
from .op10_lines import op10_line_dedup
from .op1_secrets import op1_secret_scan
from .op2_quality import op2_quality_rules
from .op3_suffixes import op3_suffix_dedup
from .op4_fertility import op4_token_fertility
from .op5_html import op5_html_extraction
from .op6_lm import op6_lm_scoring
from .op7_decontamination import ORACLE as _OP7
from .op7_decontamination import op7_decontamination
from .op8_simhash import op8_simhash
from .op9_packing import op9_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_quality_rules,
        op3_suffix_dedup,
        op4_token_fertility,
        op5_html_extraction,
        op6_lm_scoring,
        op7_decontamination,
        op8_simhash,
        op9_packing,
        op10_line_dedup,
    )
}

ORACLES: dict[str, str] = {"op7_decontamination": _OP7, "op10_line_dedup": _OP10}
