"""Schemas of the exported tables the audit reads, as DDL."""

SPACES = (
    "space_id STRING, title STRING, display_name STRING, description STRING, "
    "table_identifiers ARRAY<STRING>, warehouse_id STRING, error STRING"
)
INSTRUCTIONS = (
    "space_id STRING, ordinal BIGINT, instruction_type STRING, title STRING, content STRING"
)
QUESTIONS = (
    "space_id STRING, question_id BIGINT, question_type STRING, question STRING, question_text STRING, "
    "content STRING, answer_text STRING"
)
TABLES = (
    "table_id STRING, comment STRING, owner STRING, table_type STRING, has_row_filter BOOLEAN, "
    "has_col_mask BOOLEAN, error STRING"
)
COLUMNS = ("table_id STRING, ordinal BIGINT, name STRING, data_type STRING, comment STRING")
DESCRIBE_ROWS = ("table_id STRING, col_name STRING, data_type STRING, comment STRING")
TABLE_TAGS = ("table_id STRING, tag_name STRING, tag_value STRING, ordinal INT")
CONSTRAINTS = ("table_id STRING, constraint_type STRING")
GRANTS = ("table_id STRING, principal STRING, action_type STRING")
GRANT_STATUS = ("table_id STRING, readable BOOLEAN")
ACL = (
    "object_type STRING, object_id STRING, access_control_list ARRAY<STRUCT<user_name: STRING, "
    "group_name: STRING, service_principal_name: STRING, "
    "all_permissions: ARRAY<STRUCT<permission_level: STRING>>>>"
)
WAREHOUSES = ("warehouse_id STRING, enable_serverless_compute BOOLEAN, error STRING")
VERDICTS = ("space_id STRING, metrics BOOLEAN, dimensions BOOLEAN, grain BOOLEAN, users BOOLEAN")
# Events may lie in a folder a day, named by event_date.
LINEAGE = (
    "source_table_full_name STRING, target_table_full_name STRING, event_time TIMESTAMP, event_date DATE"
)
AUDIT = (
    "request_params STRUCT<full_name_arg: STRING>, user_identity STRUCT<email: STRING>, "
    "action_name STRING, event_time TIMESTAMP, event_date DATE"
)

# Content of an instruction of kind SQL_SNIPPET.
SNIPPET = (
    "type STRING, display_name STRING, alias STRING, code STRING, synonyms ARRAY<STRING>"
)
