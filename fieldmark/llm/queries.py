"""The queries of this subpackage, one for each of its operators, and their SQL."""

from __future__ import annotations

from fieldmark.llm.audio import op1_audio
from fieldmark.llm.language import op12_language
from fieldmark.llm.linededup import OP2_SQL, op2_line_dedup
from fieldmark.llm.merkle import OP13_SQL, op13_merkle
from fieldmark.llm.mixing import op3_mixing
from fieldmark.llm.ngramjoin import op5_ngram_join
from fieldmark.llm.packing import op9_packing
from fieldmark.llm.pii import op4_personal_data
from fieldmark.llm.secrets import op6_secrets
from fieldmark.llm.simhash import op10_fingerprints
from fieldmark.llm.toxicity import op7_toxicity
from fieldmark.llm.urls import op8_urls
from fieldmark.llm.variants import OP11_SQL, op11_variants


def queries() -> dict:
    found = (op1_audio, op2_line_dedup, op3_mixing, op4_personal_data, op5_ngram_join, op6_secrets, op7_toxicity, op8_urls, op9_packing, op10_fingerprints, op11_variants, op12_language, op13_merkle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op11_variants": OP11_SQL, "op13_merkle": OP13_SQL}
