"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .archive import ORACLE_OP5, op5_arc_to_warc
from .classifier import op10_pu_quality
from .fingerprints import op9_one_permutation_fingerprints
from .language import op7_compression_language
from .language_model import op3_pitman_yor
from .mixing import ORACLE_OP4, op4_poisson_mixing
from .neardup import op6_dart_minhash
from .packing import op1_best_fit_packing
from .quality import op2_quality_rules
from .secrets import op8_secret_scan


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_pitman_yor, op4_poisson_mixing, op5_arc_to_warc, op6_dart_minhash, op7_compression_language, op8_secret_scan, op9_one_permutation_fingerprints, op10_pu_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op4_poisson_mixing": ORACLE_OP4, "op5_arc_to_warc": ORACLE_OP5}
