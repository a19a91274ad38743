"""Schemas of the records, and the domains of their enumerated fields."""

from __future__ import annotations

# The domains of the enumerated fields, and the payloads in the order in which one is picked.
KNOWLEDGE_TYPES = ["setup", "contextual", "framework", "tip", "psychology", "anecdote"]
TESTABILITY = ["backtestable", "partially", "not_testable"]
EPISTEMIC_STATUS = ["unvalidated_concept", "validated", "contradicted", "mixed"]
SESSIONS = ["asia_tokyo", "london", "ny_am", "ny_pm", "overnight", "any"]
INSTRUMENTS = ["NQ", "ES", "YM", "RTY", "CL", "GC", "any"]

METADATA = """struct<knowledge_type:string,testability:string,epistemic_status:string,domains:array<string>,session_applicability:array<string>,
 instrument_applicability:array<string>,concepts_raw:array<string>,concepts_canonical:array<string>,linked_stat_ids:array<string>,
 inferred_fields:array<string>,extraction_confidence:double>"""
PROVENANCE = """struct<source_file:string,source_type:string,source_credibility:string,session_date:date,speaker:string,chunk_id:string,
 timestamp_range:string,image_path:string,source_page:int,source_url:string,extractor_model:string,extracted_at:string>"""
SETUP = """struct<name:string,regime_precondition:string,bias_source:string,timing_gate:string,trigger:string,entry:string,invalidation:string,
 target_logic:string,management:string,stop_philosophy:string,quality_notes:string,
 sequence:array<struct<order:int,action:string,position:string,range_liquidity:string,relative_to:string,zone_label:string>>,
 reference_levels:array<string>,kind:string,text_content:struct<conditions:array<string>,confluences:array<string>,notes:array<string>,other_text:array<string>>,
 chart_inferred:array<string>>"""
PAYLOADS = {
    "setup": SETUP,
    "contextual": "struct<event_or_condition:string,expected_behavior:string,directional_lean:string,testable_claim:string,date_scope:string>",
    "framework": "struct<method_name:string,what_it_answers:string,steps:array<string>,inputs_required:array<string>,when_to_apply:string>",
    "tip": "struct<heuristic:string,rationale:string,conditions:string>",
    "psychology": "struct<principle:string,trigger_situation:string,prescribed_action:string>",
    "anecdote": "struct<embedded_heuristic:string,context:string>",
}
KNOWLEDGE_UNIT = "unit_id string, summary string, verbatim_anchor string, metadata " + METADATA + ", provenance " + PROVENANCE + ", " + ", ".join(f"{k} {v}" for k, v in PAYLOADS.items())
SEGMENT = "start_ts string, end_ts string, text string"
CLASSIFICATION = "idx int, knowledge_type string, testability string, session_applicability array<string>, instrument_applicability array<string>, concepts_raw array<string>, extraction_worthwhile boolean"
EXTRACTION = "idx int, summary string, verbatim_anchor string, inferred_fields array<string>, extraction_confidence double, payload string"
