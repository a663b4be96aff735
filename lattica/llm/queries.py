"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.decontamination import OP5_SQL, op5_decontamination
from lattica.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from lattica.llm.extraction import op4_extraction
from lattica.llm.langid import op8_langid
from lattica.llm.licenses import op7_licenses
from lattica.llm.packing import op9_packing
from lattica.llm.quality import op3_quality
from lattica.llm.simhash import op6_simhash
from lattica.llm.substring_dedup import op10_substring_dedup
from lattica.llm.warc import OP1_SQL, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_extraction": op4_extraction,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_licenses": op7_licenses,
    "op8_langid": op8_langid,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op5_decontamination": OP5_SQL}
