"""The symbol table of a source tree: one file gives many symbols, ids and the interface rule are relational."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.ids import base_symbol_id
from linkloom.sources.scanner import scan

_SCHEMA = (
    "kind string, name string, qualifiedName string, relativePath string, startLine int, endLine int, signature string, documentation string, normalizedSource string, exported boolean, "
    "overload string, types array<string>"
)


def _scan_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.strip().split(" ")[0] for c in _SCHEMA.split(",")]
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            path = path.replace("\\", "/")
            symbols, types = scan(path, content or "")
            for i, s in enumerate(symbols):
                made = json.dumps({"params": s.parameter_types, "returnType": s.return_type}, separators=(",", ":"), ensure_ascii=False)
                digest = hashlib.sha256(made.encode()).hexdigest()[:8]
                rows.append((s.kind, s.name, s.qualified, path, s.start, s.end, s.signature, s.documentation, s.source, s.exported, digest, sorted(types) if i == 0 else []))
        yield pd.DataFrame(rows, columns=columns)


def extract_symbols(files: DataFrame, commit: str, keep_interfaces: tuple[str, ...] = ()) -> DataFrame:
    """The symbol index of ``files`` (path, content): the columns of the index, with ids.

    Kinds: file, module (of files that export something), class, interface, function, method, constructor (with
    parameters or a comment). An interface stays only if some parameter or return type anywhere names it, or if it is in
    ``keep_interfaces``. Overloads share a base id and get the hash of their types; such that agree in these as well
    keep the first by line. Null contents count as empty, null paths are left out.
    """
    found = files.filter(F.col("path").isNotNull()).select("path", "content").mapInPandas(_scan_files, _SCHEMA)
    named = found.select(F.explode("types").alias("name")).distinct()
    if keep_interfaces:
        named = named.unionByName(files.sparkSession.createDataFrame([(n,) for n in keep_interfaces], "name string")).distinct()
    kept = found.filter("kind <> 'interface'").unionByName(found.filter("kind = 'interface'").join(named, "name", "left_semi").select(found.columns))
    base = base_symbol_id(F.col("relativePath"), F.col("qualifiedName"), F.col("kind"))
    group = Window.partitionBy("base")
    ids = kept.withColumn("base", base).withColumn("n", F.count(F.lit(1)).over(group))
    ids = ids.withColumn("symbolId", F.when(F.col("n") > 1, F.concat_ws(":", "base", "overload")).otherwise(F.col("base")))
    first = Window.partitionBy("symbolId").orderBy("startLine")
    once = ids.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return once.select(
        "symbolId", "kind", "name", "qualifiedName", "relativePath", "startLine", "endLine", "signature", "documentation", "normalizedSource", "exported", F.lit(commit).alias("repositoryCommit")
    )
