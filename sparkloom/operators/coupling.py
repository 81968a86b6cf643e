"""Module metrics: coupling between directories and the complexity inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.expr import half_up, instability, module_of
from sparkloom.operators.graph import module_edges


def module_complexity(functions: DataFrame) -> DataFrame:
    """(module, functions, total, max, name of the first most complex one if any is over 0). `functions`: file, name, complexity, seq."""
    rows = functions.withColumn("module", module_of(F.col("file")))
    first = F.min_by(F.when(F.col("complexity") > 0, F.col("name")), F.struct(-F.col("complexity"), F.col("seq")))
    return rows.groupBy("module").agg(F.count("*").alias("functions"), F.sum("complexity").alias("total_complexity"), F.max("complexity").cast("long").alias("max_complexity"), first.alias("max_name"))


def module_coupling(files: DataFrame, edges: DataFrame, functions: DataFrame) -> DataFrame:
    """One row for each module with a file: files, afferent and efferent modules, instability, complexity.

    `files`: path. `edges`: src, dst (paths). Edges of modules without a file are left out."""
    modules = files.groupBy(module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files"))
    known = modules.select("module")
    cross = module_edges(edges).join(known.select(F.col("module").alias("src_module")), "src_module", "left_semi").join(known.select(F.col("module").alias("dst_module")), "dst_module", "left_semi")
    out = cross.groupBy(F.col("src_module").alias("module")).agg(F.count("*").alias("efferent"))
    into = cross.groupBy(F.col("dst_module").alias("module")).agg(F.count("*").alias("afferent"))
    rows = modules.join(into, "module", "left").join(out, "module", "left").join(module_complexity(functions), "module", "left").na.fill(0, ["afferent", "efferent", "functions", "total_complexity", "max_complexity"])
    mean = F.when(F.col("functions") > 0, half_up(F.col("total_complexity") / F.col("functions"), 2)).otherwise(0.0)
    return rows.select("module", "files", "afferent", "efferent", half_up(instability(F.col("afferent"), F.col("efferent")), 2).alias("instability"), "functions", "total_complexity", "max_complexity", "max_name", mean.alias("avg_complexity"))
