"""Queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from strandline.llm.chat import OP1_SQL, op1_chat
from strandline.llm.decontaminate import op10_decontamination
from strandline.llm.jaccard_join import op8_jaccard_join
from strandline.llm.langid import op3_language
from strandline.llm.line_dedup import op9_line_dedup
from strandline.llm.media import op2_media
from strandline.llm.mixing import OP6_SQL, op6_mixing
from strandline.llm.token_counts import op4_token_counts
from strandline.llm.token_files import op5_token_files
from strandline.llm.toxicity import op7_toxicity


def queries() -> dict:
    return {
        "op1_chat": op1_chat,
        "op2_media": op2_media,
        "op3_language": op3_language,
        "op4_token_counts": op4_token_counts,
        "op5_token_files": op5_token_files,
        "op6_mixing": op6_mixing,
        "op7_toxicity": op7_toxicity,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_line_dedup": op9_line_dedup,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op6_mixing": OP6_SQL}
