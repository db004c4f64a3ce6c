"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op2_decontamination
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .jaccard_join import op1_jaccard_join
from .language_id import op10_language_id
from .mixing import OP4_SQL, op4_mixing
from .pii import op6_pii
from .secrets import op5_secret_scans
from .sharding import op8_sharding
from .token_counts import op7_token_counts
from .warc import OP9_SQL, op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_jaccard_join, op2_decontamination, op3_exact_dedup, op4_mixing, op5_secret_scans, op6_pii, op7_token_counts, op8_sharding, op9_warc, op10_language_id)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_mixing": OP4_SQL, "op9_warc": OP9_SQL}
