"""The operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.chaining import op3_fuzzy_passages
from lodestrata.llm.events import ORACLE as EVENTS_SQL, op6_chats
from lodestrata.llm.fertility import op5_fertility
from lodestrata.llm.gif import op2_gif
from lodestrata.llm.html import op8_main_text
from lodestrata.llm.jaccard import op7_near_pairs
from lodestrata.llm.mixing import ORACLE as MIXING_SQL, op1_mixture
from lodestrata.llm.ngram_lm import op4_lm_scores
from lodestrata.llm.pieces import op9_pieces
from lodestrata.llm.suffixes import op10_repeats


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixture": op1_mixture,
        "op2_gif": op2_gif,
        "op3_fuzzy_passages": op3_fuzzy_passages,
        "op4_lm_scores": op4_lm_scores,
        "op5_fertility": op5_fertility,
        "op6_chats": op6_chats,
        "op7_near_pairs": op7_near_pairs,
        "op8_main_text": op8_main_text,
        "op9_pieces": op9_pieces,
        "op10_repeats": op10_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixture": MIXING_SQL, "op6_chats": EVENTS_SQL}
