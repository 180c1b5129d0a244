"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.divergence import OP3_SQL, op3_divergence
from weftline.llm.hash_tree import op2_hash_tree
from weftline.llm.packing import op6_packing
from weftline.llm.pii import op7_personal
from weftline.llm.separators import op9_separators
from weftline.llm.simhash import op8_simhash
from weftline.llm.style_tree import op10_style_tree
from weftline.llm.substrings import op4_substrings
from weftline.llm.templates import op1_templates
from weftline.llm.temporal_urls import OP5_SQL, op5_temporal_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_templates, op2_hash_tree, op3_divergence, op4_substrings, op5_temporal_urls, op6_packing, op7_personal, op8_simhash, op9_separators, op10_style_tree)}
ORACLE_SQL: dict[str, str] = {"op3_divergence": OP3_SQL, "op5_temporal_urls": OP5_SQL}
