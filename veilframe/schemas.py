"""Schemas of the data model, as DDL."""

SPAN = "struct<text:string,start:int,end:int,span_type:string,source:string,bucket:string,subsource:string>"
SPANS = f"array<{SPAN}>"
TRACE = (
    "source string, gathered_at string, from_workflow string, data struct<task:string,result:string,sensitive_info:array<string>,"
    "domain_sensitive:array<string>,general_sensitive:array<string>,domain:string>"
)
SEED = (
    "seed_id string, domain string, intent string, service_type string, hard_constraints array<string>, soft_preference array<string>, "
    "supporting_context array<string>, sensitive_info array<string>, domain_sensitive array<string>, general_sensitive array<string>, user_goal string"
)
TASK = "seed_id string, variant_id int, domain string, prompt string, sensitive_info array<string>, domain_sensitive array<string>, general_sensitive array<string>"
DOMAIN = (
    "domain string, intent_templates array<string>, service_type array<string>, hard_constraints array<string>, soft_preference array<string>, "
    "supporting_context array<string>, domain_sensitive_info map<string,array<string>>, general_sensitive_info array<string>, user_goal array<string>"
)
