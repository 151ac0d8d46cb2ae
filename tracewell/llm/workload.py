"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.boilerplate_lines import line_spread_sql, op7_line_spread
from tracewell.llm.content_sort import exact_copies_sql, op13_content_sort
from tracewell.llm.decontaminate import op2_spaced_seeds
from tracewell.llm.huffman_ids import op1_huffman_ids
from tracewell.llm.merkle_manifest import manifest_sql, op11_merkle_manifest
from tracewell.llm.minhash_dedup import near_duplicates_sql, op4_minhash_hamming
from tracewell.llm.quality import kept_sql, op9_quality_cascade
from tracewell.llm.reshard import op8_min_cost_reshard
from tracewell.llm.sentence_pieces import op5_sentencepiece
from tracewell.llm.substring_dedup import op6_countmin_windows, repeated_sql
from tracewell.llm.token_counts import op10_token_counts
from tracewell.llm.warc import op3_warc
from tracewell.llm.whitening import op12_bit_sliced_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_huffman_ids": op1_huffman_ids,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_warc": op3_warc,
    "op4_minhash_hamming": op4_minhash_hamming,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_countmin_windows": op6_countmin_windows,
    "op7_line_spread": op7_line_spread,
    "op8_min_cost_reshard": op8_min_cost_reshard,
    "op9_quality_cascade": op9_quality_cascade,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_bit_sliced_whitening": op12_bit_sliced_whitening,
    "op13_content_sort": op13_content_sort,
}

ORACLE: dict[str, str] = {
    "op4_minhash_hamming": near_duplicates_sql(),
    "op6_countmin_windows": repeated_sql(),
    "op7_line_spread": line_spread_sql(),
    "op9_quality_cascade": kept_sql(),
    "op11_merkle_manifest": manifest_sql(),
    "op13_content_sort": exact_copies_sql(),
}
