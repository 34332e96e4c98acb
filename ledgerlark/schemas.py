"""Schemas of the JSON artifacts, given to the readers so that nothing is inferred."""

from __future__ import annotations

AMOUNT = "struct<value:struct<kind:string,dollars:bigint>,semantics:string,text_as_written:string>"
EARMARK = "struct<recipient:string,location:string,requesting_member:string>"
SPAN = "struct<start:bigint,end:bigint,file:string,verified:boolean,match_tier:string>"
#: All variants' fields side by side; what a variant lacks is null. Fields that come as text or object are read as text.
PROVISION = (
    "struct<provision_type:string,section:string,division:string,title:string,confidence:float,raw_text:string,notes:array<string>,"
    "cross_references:array<struct<ref_type:string,target:string,description:string>>,"
    f"source_span:{SPAN},amount:{AMOUNT},new_amount:{AMOUNT},old_amount:{AMOUNT},amounts:array<{AMOUNT}>,"
    "account_name:string,agency:string,program:string,fiscal_year:int,availability:string,"
    f"provisos:array<struct<proviso_type:string,description:string,amount:{AMOUNT},references:array<string>,raw_text:string>>,"
    f"earmarks:array<{EARMARK}>,earmark:{EARMARK},detail_level:string,parent_account:string,reference_law:string,fiscal_years:string,"
    "reference_act:string,reference_section:string,from_scope:string,to_scope:string,limit:string,conditions:array<string>,"
    "program_name:string,statutory_reference:string,period:string,extends_through:string,description:string,deadlines:array<string>,"
    "policy_area:string,reference_year:int,reference_laws:array<string>,rate:string,duration:string,"
    "anomalies:array<struct<account:string,modification:string,delta:bigint,raw_text:string>>,"
    "llm_classification:string,references:array<string>,metadata:string>"
)
EXTRACTION = (
    "schema_version string, bill struct<identifier:string,classification:string,short_title:string,fiscal_years:array<int>,divisions:array<string>,public_law:string>, "
    f"provisions array<{PROVISION}>, "
    "summary struct<total_provisions:bigint,by_division:map<string,bigint>,by_type:map<string,bigint>,total_budget_authority:bigint,total_rescissions:bigint,sections_with_no_provisions:array<string>,flagged_issues:array<string>>, "
    "chunk_map array<struct<chunk_id:string,label:string,provision_indices:array<bigint>>>"
)
VERIFICATION = (
    "amount_checks array<struct<provision_index:bigint,text_as_written:string,found_in_source:boolean,source_positions:array<bigint>,status:string>>, "
    "raw_text_checks array<struct<provision_index:bigint,raw_text_preview:string,is_verbatim_substring:boolean,match_tier:string,found_at_position:bigint>>, "
    "completeness struct<total_dollar_amounts_in_text:bigint,accounted_for:bigint,unaccounted:array<struct<text:string,value:bigint,position:bigint,context:string>>>, "
    "summary struct<total_provisions:bigint,amounts_verified:bigint,amounts_not_found:bigint,amounts_ambiguous:bigint,raw_text_exact:bigint,raw_text_normalized:bigint,raw_text_spaceless:bigint,raw_text_no_match:bigint,completeness_pct:double,provisions_by_detail_level:map<string,bigint>>"
)
BILL_META = (
    "schema_version string, congress int, fiscal_years array<int>, bill_nature string, "
    "subcommittees array<struct<division:string,jurisdiction:string,title:string,source:string>>, "
    "provision_timing array<struct<provision_index:bigint,timing:string,available_fy:int,source:string>>, "
    "canonical_accounts array<struct<provision_index:bigint,canonical_name:string>>, extraction_sha256 string"
)
TAS_MAPPING = (
    "bill_dir string, bill_identifier string, model string, fas_reference_hash string, timestamp string, "
    "mappings array<struct<provision_index:bigint,account_name:string,agency:string,dollars:bigint,fas_code:string,fas_title:string,confidence:string,method:string,reasoning:string>>, "
    "summary struct<total_provisions:bigint,deterministic_matched:bigint,llm_matched:bigint,unmatched:bigint,unique_fas_codes:bigint,match_rate_pct:double>"
)
FAS = "struct<fas_code:string,agency_code:string,main_account:string,agency_name:string,title:string,fund_type:string,has_no_year_variant:boolean,has_annual_variant:boolean,last_updated:string,legislation:string,independent_agency:string,tas_variants:bigint,action:string,comments:string>"
FAS_REFERENCE = f"accounts array<{FAS}>, discontinued array<{FAS}>"
EMBEDDINGS = "schema_version string, model string, dimensions int, count bigint, extraction_sha256 string, vectors_file string, vectors_sha256 string"
DATASET = "entities struct<agency_groups:array<struct<canonical:string,members:array<string>>>,account_aliases:array<struct<canonical:string,aliases:array<string>>>>"
REF = "struct<bill_dir:string,provision_index:bigint,label:string>"
LINKS = f"schema_version string, embedding_model string, accepted array<struct<hash:string,source:{REF},target:{REF},similarity:float,relationship:string,evidence:struct<type:string>,accepted_at:string,note:string>>"
CPI = "source string, retrieved string, note string, monthly map<string,double>, annual_averages map<string,double>, partial_years map<string,struct<months:int,through:string>>"
EXTRACTION_METADATA = "extraction_version string, prompt_version string, model string, schema_version string, source_xml_sha256 string, source_pdf_sha256 string, extracted_text_sha256 string, timestamp string, chunks_total bigint, chunks_completed bigint"
TOKENS = "total_input bigint, total_output bigint, total_cache_read bigint, total_cache_create bigint, calls bigint"
CONVERSION = "provisions_parsed bigint, provisions_failed bigint, null_to_default bigint, type_coercions bigint, unknown_provision_types bigint, warnings array<string>"
AUTHORITIES = "schema_version string, authorities array<struct<fas_code:string,agency_code:string,fas_title:string,agency_name:string,name_variants:array<struct<name:string,bills:array<string>,fiscal_years:array<int>,classification:string>>,provisions:array<struct<bill_identifier:string,bill_dir:string,fiscal_years:array<int>,dollars:bigint,provision_index:bigint,account_name:string,confidence:string,method:string>>,total_dollars:bigint,fiscal_years:array<int>>>"
