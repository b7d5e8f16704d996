"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import centroids, extraction, media, neardup, resampling, sharding, substring, warc
from corpuscle.llm.centroids import op12_yinyang_clusters
from corpuscle.llm.extraction import op3_template_deduction
from corpuscle.llm.media import op10_interleaved_media
from corpuscle.llm.mixing import op9_pfair_mix
from corpuscle.llm.neardup import op7_dart_minhash
from corpuscle.llm.neighbours import op1_multiprobe_lsh
from corpuscle.llm.packing import op8_deficit_packing
from corpuscle.llm.pieces import op11_distinct_chunks
from corpuscle.llm.resampling import op13_importance_resampling
from corpuscle.llm.sharding import op5_fixed_slots
from corpuscle.llm.toxicity import op6_nbsvm_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_multiprobe_lsh, substring.op2_fixed_block_anchors, op3_template_deduction, warc.op4_warc_ranges, op5_fixed_slots, op6_nbsvm_toxicity, op7_dart_minhash, op8_deficit_packing, op9_pfair_mix, op10_interleaved_media, op11_distinct_chunks, op12_yinyang_clusters, op13_importance_resampling)}
ORACLE_SQL: dict[str, str] = {"op2_fixed_block_anchors": substring.ORACLE, "op3_template_deduction": extraction.ORACLE, "op4_warc_ranges": warc.ORACLE, "op5_fixed_slots": sharding.ORACLE, "op7_dart_minhash": neardup.ORACLE, "op10_interleaved_media": media.ORACLE, "op12_yinyang_clusters": centroids.ORACLE, "op13_importance_resampling": resampling.ORACLE}
