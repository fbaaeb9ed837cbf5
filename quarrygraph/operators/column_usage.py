"""Column usage: who reads and writes the fields of a table class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import code, names
from quarrygraph.functions.kernels import create_table_columns, field_declarations
from quarrygraph.plans.space import Space, SymbolNotFound


def table_class(space: Space, table: str):
    low = table.lower()
    hit = F.col("entity_type").isin("java.class", "java.record") & ((F.lower("fqn") == low) | F.lower("fqn").endswith("." + low) | (F.lower("label") == low))
    row = space.entities.where(hit).orderBy(F.length("fqn"), "fqn").first()
    if row is None:
        raise SymbolNotFound(table)
    return row


def columns(space: Space, table: str) -> DataFrame:
    """(field_name, logical_name, column_name, data_type) of the class's fields, with DDL types and comments where Java has none."""
    cls = table_class(space, table)
    files = space.table("source_files")
    fields = field_declarations(files.where(F.col("path") == cls.file))
    candidates = [cls.label.lower()]
    snake = "".join(("_" + c if c.isupper() and k and cls.label[k - 1] != "_" else c) for k, c in enumerate(cls.label)).lower()
    candidates = [snake + "s", snake]
    named = files.where(F.col("path") == cls.file).select(F.regexp_extract("text", r'@Table\s*\([^)]*name\s*=\s*"([^"]+)"', 1).alias("t")).first()
    if named is not None and named.t:
        candidates.insert(0, named.t.lower())
    ddl = create_table_columns(files.where(F.lower("path").endswith(".sql"))).where(F.lower("table_name").isin(candidates)).select(F.lower("column_name").alias("_c"), "comment", "sql_type").dropDuplicates(["_c"])
    column = F.coalesce("column_name", names.snake_case(F.col("field_name")))
    out = fields.withColumn("column_name", column).join(ddl, F.lower("column_name") == F.col("_c"), "left")
    return out.select("field_name", F.coalesce("doc", "comment", F.lit("")).alias("logical_name"), "column_name", F.coalesce("java_type", "sql_type", F.lit("unknown")).alias("data_type"), "ord")


def column_usage(space: Space, table: str) -> DataFrame:
    """(field_name, logical_name, column_name, data_type, readers, writers, usage): places in all other files, most used first.

    A place is fqn, file, line, access_type; one for each line. A line that reads and writes counts as a write.
    """
    cls = table_class(space, table)
    cols = columns(space, table)
    lines = space.table("source_lines").where(~F.col("path").endswith(f"{cls.label}.java"))
    # the identifiers that can touch a field: itself, its column, its accessors; lines meet them by equality
    name, column = F.col("field_name"), F.col("column_name")
    cap = names.capitalised(name)
    keys = F.array_distinct(F.transform(F.array(name, column, *(F.concat(F.lit(x), cap) for x in ("get", "is", "set"))), F.lower))
    fields = cols.select("field_name", "column_name", F.explode(keys).alias("_key"))
    near = lines.withColumn("_key", F.explode(code.identifiers(F.col("line")))).join(F.broadcast(fields), "_key").dropDuplicates(["path", "line_no", "field_name"])
    acc, direct = names.getter_setter_access(F.col("line"), name), names.direct_access(F.col("line"), name)
    java_w, java_r = acc["setter"] | direct["write"], acc["getter"] | (direct["found"] & ~direct["write"])
    sql = F.when(F.lower("path").endswith(".sql") | code.looks_like_sql(F.col("line")), code.column_access(F.col("line"), column))
    kind = F.when(java_w & java_r, "read_write").when(java_w, "write").when(java_r, "read").otherwise(sql)
    hits = near.select("field_name", "path", "line_no", kind.alias("access_type")).where("access_type IS NOT NULL")
    place = F.struct(names.class_of_file(F.col("path")).alias("fqn"), F.col("path").alias("file"), F.col("line_no").alias("line"), "access_type")
    per = hits.groupBy("field_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("access_type") == "read", place))).alias("readers"), F.array_sort(F.collect_list(F.when(F.col("access_type") != "read", place))).alias("writers")
    )
    empty = F.array().cast("array<struct<fqn:string,file:string,line:int,access_type:string>>")
    out = cols.join(per, "field_name", "left").select("field_name", "logical_name", "column_name", "data_type", F.coalesce("readers", empty).alias("readers"), F.coalesce("writers", empty).alias("writers"))
    return out.withColumn("usage", F.size("readers") + F.size("writers")).orderBy(F.col("usage").desc(), "field_name")
