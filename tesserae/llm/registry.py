"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tesserae.llm.html_text import op9_html_text
from tesserae.llm.jaccard_join import OP10_SQL, op10_jaccard_join
from tesserae.llm.media import op6_media_columns
from tesserae.llm.mixing import op5_mixture
from tesserae.llm.passages import op3_substring_dedup
from tesserae.llm.pieces import op1_sentencepiece
from tesserae.llm.quality import op8_quality
from tesserae.llm.toxicity import op7_toxicity
from tesserae.llm.vptree import op4_nearest
from tesserae.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest": op4_nearest,
    "op5_mixture": op5_mixture,
    "op6_media_columns": op6_media_columns,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL = {"op2_warc": OP2_SQL, "op10_jaccard_join": OP10_SQL}
