"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat
from .decontaminate import op10_decontaminate
from .gru_lm import op9_gru_lm
from .html_text import OP5_SQL, op5_html_text
from .jaccard_join import OP4_SQL, op4_jaccard_join
from .language import op3_language_id
from .pieces import op2_pieces
from .pivot_dedup import OP8_SQL, op8_pivot_dedup
from .quality import op6_quality
from .url_filter import op7_url_filter

QUERIES = {
    "op1_chat": op1_chat,
    "op2_pieces": op2_pieces,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_text": op5_html_text,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_pivot_dedup": op8_pivot_dedup,
    "op9_gru_lm": op9_gru_lm,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE: dict[str, str] = {
    "op1_chat": OP1_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op5_html_text": OP5_SQL,
    "op8_pivot_dedup": OP8_SQL,
}
