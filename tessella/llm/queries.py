"""The subpackage's queries, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import ORACLE as CHAT
from .chat import op3_chat_formatting
from .decontaminate import op8_benchmark_decontamination
from .images import op6_media_columns
from .language import op7_language_id
from .licenses import ORACLE as LICENSES
from .licenses import op10_license_scans
from .pieces import op4_sentencepiece
from .pitman_yor import op5_lm_scoring
from .secrets import op1_secret_scans
from .simhash import op9_simhash_near_dedup
from .suffixes import op2_suffix_array_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_media_columns": op6_media_columns,
    "op7_language_id": op7_language_id,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_license_scans": op10_license_scans,
}

ORACLES: dict[str, str] = {"op3_chat_formatting": CHAT, "op10_license_scans": LICENSES}
