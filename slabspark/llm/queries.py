"""The queries of this subpackage by name, and their SQL where SQL can say it."""

from __future__ import annotations

from slabspark.llm.bpe import op10_bpe
from slabspark.llm.clusters import OP13_SQL, op13_centroids
from slabspark.llm.decontaminate import op3_decontamination
from slabspark.llm.html import op7_main_text
from slabspark.llm.langid import op2_language
from slabspark.llm.lm import op8_lm_score
from slabspark.llm.middle import OP12_SQL, op12_fill_in_middle
from slabspark.llm.neighbours import op9_neighbours
from slabspark.llm.secrets import op5_secrets
from slabspark.llm.simhash import op1_simhash
from slabspark.llm.substrings import op6_substring_dedup
from slabspark.llm.urls import OP4_SQL, op4_url_filter
from slabspark.llm.warc import OP11_SQL, op11_warc

QUERIES = {f.__name__: f for f in (op1_simhash, op2_language, op3_decontamination, op4_url_filter, op5_secrets, op6_substring_dedup, op7_main_text, op8_lm_score, op9_neighbours, op10_bpe, op11_warc, op12_fill_in_middle, op13_centroids)}
ORACLE: dict[str, str] = {"op4_url_filter": OP4_SQL, "op11_warc": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_centroids": OP13_SQL}
