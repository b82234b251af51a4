"""The operators' queries and SQL, for the driver's entry module."""

from __future__ import annotations

from gridloom.llm.ann import op9_hnsw_neighbours
from gridloom.llm.chat_format import OP10_SQL, op10_chat_format
from gridloom.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from gridloom.llm.jaccard_join import op7_jaccard_join
from gridloom.llm.mixing import op1_mix_sources
from gridloom.llm.quality import op5_quality
from gridloom.llm.sentencepiece_ops import op2_sentencepiece
from gridloom.llm.sharding import op8_feistel_shards
from gridloom.llm.token_files import op6_token_files
from gridloom.llm.warc import op4_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_sentencepiece,
        op3_exact_dedup,
        op4_warc_derivatives,
        op5_quality,
        op6_token_files,
        op7_jaccard_join,
        op8_feistel_shards,
        op9_hnsw_neighbours,
        op10_chat_format,
    )
}
SQL = {"op3_exact_dedup": OP3_SQL, "op10_chat_format": OP10_SQL}
