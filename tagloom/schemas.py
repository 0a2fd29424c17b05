"""Explicit schemas of the data model; JSON is never inferred."""

from pyspark.sql import types as T

SPAN = "struct<start: int, end: int, label: string>"
SPANS = f"array<{SPAN}>"
VALUED_SPANS = "array<struct<start: int, end: int, value: string, label: string>>"
MESSAGES = "array<struct<role: string, content: string>>"
ANNOTATED = f"text string, spans {SPANS}, language string, source string"
LITERAL = "text string, spans string, uid string, domain string, document_type string, document_format string, locale string"
MASKED = f"source_text string, privacy_mask {VALUED_SPANS}, language string, uid string"
SPAN_ROWS = f"text string, spans {SPANS}, uid string"
CHAT = f"row_id bigint, messages {MESSAGES}, source string, split string"
PREDICTIONS = "row_id bigint, output string, error string"
REWARD_ROWS = "completion string, gold_tagged string, names array<string>, source_text string"
TAG_REQUESTS = "text string, entities array<string>, constrained boolean"
TAG_RESPONSES = "tagged string, entities array<string>, faithful boolean, constrained boolean, error string"
BATCH_REQUESTS = f"custom_id string, method string, url string, body struct<model: string, messages: {MESSAGES}, max_completion_tokens: int>"
BATCH_STATE = "map<string, struct<file_id: string, batch_id: string, status: string>>"
RUN_META = "model string, n int, failures int, seconds double, usage struct<prompt_tokens: bigint, completion_tokens: bigint>"

# Types of Arrow functions, as objects: a DDL string needs a running session when the module is imported.
_span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())])
SPANS_TYPE = T.ArrayType(_span)
INJECTED = T.StructType([T.StructField("tagged", T.StringType()), T.StructField("reason", T.StringType())])
PARSED = T.StructType([T.StructField("reason", T.StringType()), T.StructField("text", T.StringType()), T.StructField("spans", SPANS_TYPE)])
STATE = T.StructType([T.StructField("copy_pos", T.IntegerType()), T.StructField("open_tag", T.StringType()), T.StructField("open_pos", T.IntegerType()), T.StructField("pending", T.StringType()), T.StructField("valid", T.BooleanType())])
