"""veridoc: document validation and data quality on Spark DataFrames."""

__version__ = "0.1.0"

from veridoc.operators.registry import SchemaSet  # noqa: E402
from veridoc.operators.transform import rewrite  # noqa: E402
from veridoc.operators.validator import Validator, compile, prepare, validate  # noqa: E402
from veridoc.sources.ndjson import count_valid, read_ndjson, read_ndjson_stream, valid_flags  # noqa: E402

__all__ = ["SchemaSet", "Validator", "compile", "count_valid", "prepare", "read_ndjson", "read_ndjson_stream", "rewrite", "valid_flags", "validate"]
