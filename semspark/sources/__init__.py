"""Relations in and out: descriptors as schemas, registers, views, and sinks for tables about the model."""

from semspark.sources.registers import read_register
from semspark.sources.schema import bind, drift, spark_type, struct_type
from semspark.sources.sinks import external_table_ddl, view_ddl, write_ndjson
from semspark.sources.transforms import build_view, read_input

__all__ = ["bind", "build_view", "drift", "external_table_ddl", "read_input", "read_register", "spark_type", "struct_type", "view_ddl", "write_ndjson"]
