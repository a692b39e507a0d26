"""The fixed row types: facts with embedded relations, edges, findings and stream envelopes."""

from __future__ import annotations

RELATION = "struct<kind:string,target:string,target_kind:string,target_file:string>"
FACTS = (
    "repo string, kind string, name string, file string, line int, end_line int, symbol_kind string, exported boolean, "
    f"language string, props map<string,string>, relations array<{RELATION}>"
)
EDGES = "repo string, src string, src_kind string, rel string, dst string, dst_kind string, src_file string, dst_file string"
EVIDENCE = "struct<file:string,line:int,symbol:string,fact:string,detail:string>"
FINDINGS = f"source string, title string, description string, confidence double, informational boolean, evidence array<{EVIDENCE}>, actions array<string>, metrics map<string,string>"
OWNER = "struct<kind:string,id:string>"
NODE = f"struct<owner:{OWNER},id:string,kind:string,name:string,occurrence:int>"
EDGE = f"struct<owner:{OWNER},id:string,source_id:string,kind:string,target:string,target_id:string,resolution:string,occurrence:int>"
ENVELOPE = (
    "type string, schema_version int, repo_id string, context_id string, run_id string, base_generation long, target_generation long, "
    f"phase string, scope_mode string, owner_scope array<{OWNER}>, seq int, nodes array<{NODE}>, edges array<{EDGE}>, owners array<{OWNER}>, "
    "batch_count int, batch_digest string, owner_scope_len int, owner_scope_digest string, status string"
)

#: Fact kinds and relation kinds.
FACT_KINDS = (
    "module", "symbol", "route", "storage", "dependency", "service", "intent", "extraction", "association",
    "fsm_machine", "fsm_state", "fsm_event", "fsm_transition", "fsm_command", "test_ref", "file_ref", "lint",
)
RELATION_KINDS = ("declares", "imports", "calls", "implements", "depends_on", "instantiates", "injects", "has_method", "handled_by", "implemented_by", "names")
#: Relations and sources that don't count into architectural fan-in and fan-out.
NOT_FAN_IN_RELATIONS = ("instantiates", "implemented_by")
NOT_FAN_IN_SOURCES = ("test_ref", "file_ref", "route")
NOT_FAN_OUT_RELATIONS = ("has_method",)
