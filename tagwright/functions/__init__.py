"""Column-level functions (all built from pyspark.sql.functions, JVM-side)."""
