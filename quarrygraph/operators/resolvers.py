"""Resolution strategies over a symbol table, and helpers on source roots and URIs."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class TypeResolver(Protocol):
    """names(target_text, package, class) to (target_text, fqn); several rows for a target where a strategy is unsure."""

    def resolve_type(self, names: DataFrame) -> DataFrame: ...

    def resolve_method_call(self, names: DataFrame) -> DataFrame: ...

    def find_references(self, fqns: DataFrame) -> DataFrame: ...


class HeuristicResolver:
    """All candidates of the textual rules that exist: dotted names as they are, names in the package, known tails."""

    def __init__(self, symbols: DataFrame, incidences: DataFrame | None = None, entities: DataFrame | None = None) -> None:
        self.symbols, self.incidences, self.entities = symbols, incidences, entities

    def _known(self, options: DataFrame) -> DataFrame:
        return options.join(self.symbols.select("fqn"), "fqn").select("target_text", "fqn").distinct()

    def resolve_type(self, names: DataFrame) -> DataFrame:
        options = names.select("target_text", F.explode(F.array("target_text", F.concat_ws(".", "package", "target_text"))).alias("fqn"))
        tails = self.symbols.select("fqn", F.substring_index("fqn", ".", -1).alias("target_text"))
        loose = names.where(~F.contains("target_text", F.lit("."))).select("target_text").distinct().join(tails, "target_text").select("target_text", "fqn")
        return self._known(options).unionByName(loose).distinct()

    def resolve_method_call(self, names: DataFrame) -> DataFrame:
        has = F.contains("target_text", F.lit("."))
        options = F.when(has, F.array(F.concat_ws(".", "package", "target_text"), F.col("target_text"))).otherwise(F.array(F.concat_ws(".", "class", "target_text")))
        return self._known(names.select("target_text", F.explode(options).alias("fqn")))

    def find_references(self, fqns: DataFrame) -> DataFrame:
        """(fqn, from_fqn, relation_type, file, line) of all incidences that point at the names."""
        names = self.entities.select("fqn", "cell_id")
        to = fqns.select("fqn").distinct().join(names, "fqn").withColumnRenamed("cell_id", "to_cell_id")
        return self.incidences.join(to, "to_cell_id").join(names.withColumnsRenamed({"fqn": "from_fqn", "cell_id": "from_cell_id"}), "from_cell_id").select("fqn", "from_fqn", "relation_type", "file", F.col("start_line").alias("line"))


class CachedResolver:
    """Resolutions that another program made: cache(target_text, fqn)."""

    def __init__(self, cache: DataFrame) -> None:
        self.cache = cache

    def resolve_type(self, names: DataFrame) -> DataFrame:
        return names.select("target_text").distinct().join(self.cache.select("target_text", "fqn"), "target_text")

    resolve_method_call = resolve_type

    def find_references(self, fqns: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return fqns.where("false").select("fqn", none.alias("from_fqn"), none.alias("relation_type"), none.alias("file"), F.lit(None).cast("int").alias("line"))


class ChainResolver:
    """The first strategy that finds anything for a target gives all its answers."""

    def __init__(self, *resolvers: TypeResolver) -> None:
        self.resolvers = resolvers

    def _first(self, found: list[DataFrame], key: str) -> DataFrame:
        every = None
        for k, df in enumerate(found):
            one = df.withColumn("_rank", F.lit(k))
            every = one if every is None else every.unionByName(one)
        best = F.min("_rank").over(W.partitionBy(key))
        return every.withColumn("_best", best).where("_rank = _best").drop("_rank", "_best")

    def resolve_type(self, names: DataFrame) -> DataFrame:
        return self._first([r.resolve_type(names) for r in self.resolvers], "target_text")

    def resolve_method_call(self, names: DataFrame) -> DataFrame:
        return self._first([r.resolve_method_call(names) for r in self.resolvers], "target_text")

    def find_references(self, fqns: DataFrame) -> DataFrame:
        return self._first([r.find_references(fqns) for r in self.resolvers], "fqn")


def resolution_cache(answers: DataFrame) -> DataFrame:
    """cache(target_text, fqn) from answers(target_text, file, line, col, fqn): one place asked once, one name a target."""
    once = answers.dropDuplicates(["file", "line", "col"]).where("fqn IS NOT NULL")
    return once.groupBy("target_text").agg(F.min_by("fqn", F.struct("file", "line", "col")).alias("fqn"))


def path_to_uri(path: Column) -> Column:
    """``file://`` with the parts percent-encoded."""
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/"))


def uri_to_path(uri: Column) -> Column:
    """Percent signs decoded; a plus sign stays one."""
    return F.try_url_decode(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B")))


def path_to_fqn(path: Column, root: Column) -> Column:
    """The dotted name of a file below a source root."""
    inner = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)
    return F.translate(F.regexp_replace(inner, r"\.java$", ""), "/", ".")


def source_roots(files: DataFrame) -> DataFrame:
    """(root, files): folders whose files' packages are the rest of their path; one file of each folder is read."""
    parsed = files.where(F.lower("path").endswith(".java")).select(F.regexp_extract("path", "^(.*?)/?[^/]*$", 1).alias("dir"), F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), "path")
    per = parsed.groupBy("dir").agg(F.min_by("package", "path").alias("package"), F.count("*").alias("files"))
    tail = F.translate("package", ".", "/")
    fits = (F.col("package") == "") | (F.col("dir") == tail) | F.endswith("dir", F.concat(F.lit("/"), tail))
    root = F.when(F.col("package") == "", F.col("dir")).when(F.col("dir") == tail, F.lit("")).otherwise(F.substring("dir", F.lit(1), F.length("dir") - F.length(tail) - 1))
    return per.where(fits).groupBy(root.alias("root")).agg(F.sum("files").alias("files")).orderBy("root")
