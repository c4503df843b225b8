"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from weftline.llm import chat_format, decontaminate, filter_audit, merkle, source_mix
from weftline.llm.chat_format import op9_chat_format
from weftline.llm.decontaminate import op2_decontamination
from weftline.llm.filter_audit import op11_filter_audit
from weftline.llm.jaccard_join import op10_jaccard_components
from weftline.llm.language import op3_language_id
from weftline.llm.language_model import op6_lm_scoring
from weftline.llm.line_templates import op5_line_templates
from weftline.llm.merkle import op13_merkle_manifest
from weftline.llm.packing import op12_packing
from weftline.llm.quality import op7_quality_rules
from weftline.llm.sharding import op4_sharding
from weftline.llm.source_mix import op1_source_mix
from weftline.llm.toxicity import op8_toxicity


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_source_mix, op2_decontamination, op3_language_id, op4_sharding, op5_line_templates,
            op6_lm_scoring, op7_quality_rules, op8_toxicity, op9_chat_format, op10_jaccard_components,
            op11_filter_audit, op12_packing, op13_merkle_manifest,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mix": source_mix.ORACLE, "op2_decontamination": decontaminate.ORACLE, "op9_chat_format": chat_format.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op13_merkle_manifest": merkle.ORACLE,
    }
