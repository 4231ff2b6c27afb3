"""Row layouts shared by several operators."""

from pyspark.sql import types as T

PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_rate", T.DoubleType()),
    T.StructField("blank_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("min", T.StringType()),
    T.StructField("max", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("top_5_values", T.ArrayType(T.StringType())),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])

SEMANTIC_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("inferred_type", T.StringType()),
    T.StructField("original_type", T.StringType()),
    T.StructField("needs_cast", T.BooleanType()),
    T.StructField("suggested_cast", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("detected_formats", T.ArrayType(T.StringType())),
])

DRIFT_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("change", T.StringType()),
    T.StructField("prior_type", T.StringType()),
    T.StructField("current_type", T.StringType()),
])

CHECK_SCHEMA = T.StructType([
    T.StructField("check_name", T.StringType()),
    T.StructField("check_type", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("severity", T.StringType()),
    T.StructField("expected", T.MapType(T.StringType(), T.StringType())),
    T.StructField("actual", T.MapType(T.StringType(), T.StringType())),
    T.StructField("detail", T.StringType()),
])

# Preceded by the key columns of the scanned table.
ANOMALY_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
])

LINEAGE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("source_dataset", T.StringType()),
    T.StructField("source_column", T.StringType()),
    T.StructField("target_dataset", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("transformation", T.StringType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_key", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("rows_input", T.LongType()),
    T.StructField("rows_output", T.LongType()),
    T.StructField("quality_passed", T.BooleanType()),
    T.StructField("watermark_column", T.StringType()),
    T.StructField("watermark_value", T.StringType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("event_time", T.TimestampType()),
])

DOMAIN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("method", T.StringType()),
])

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("catalogue_id", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("schema", T.MapType(T.StringType(), T.StringType())),
    T.StructField("column_descriptions", T.MapType(T.StringType(), T.StringType())),
    T.StructField("row_count", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

LIBRARY_SCHEMA = T.StructType([
    T.StructField("library_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("steps", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
