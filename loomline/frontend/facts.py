"""Sources to relations: reading files, telling their language, lowering them, projecting facts.

One Arrow pass lowers each file to records as JSON (:mod:`loomline.frontend.lowering`); relations
are projections of that one written table, so no file is parsed twice. A file that can't be
read or parsed has a row in ``errors`` and no facts; the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.frontend.lowering import lowered
from loomline.sources.code import ship

LANGUAGES = {
    "python": "py pyi", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts", "tsx": "tsx", "rust": "rs", "go": "go", "java": "java", "kotlin": "kt kts", "c": "c", "cpp": "cc cpp cxx hpp hh hxx",
    "csharp": "cs", "ruby": "rb", "php": "php", "swift": "swift",
}
#: Signs of C++ in a header that could be C.
_CPP = r"(?m)^\s*(class\s|namespace\s|template\s*<|public:|private:|protected:|using\s)|std::|#include <(string|vector|memory|map|iostream)>|virtual\s|constexpr\s|nullptr"
_CALL = "struct<call:int, callee:string, line:int, col:int, recv:struct<paths:array<string>, calls:array<int>>, args:array<struct<pos:int, kw:string, literal:string, paths:array<string>, calls:array<int>>>>"
_STMT = f"struct<kind:string, line:int, col:int, text:string, assigns:array<struct<target:string, strong:boolean, paths:array<string>, calls:array<int>>>, calls:array<{_CALL}>, ret:struct<paths:array<string>, calls:array<int>>, cond:struct<paths:array<string>, calls:array<int>>>"
SCHEMAS = {
    "function": f"fn_id string, path string, name string, owner string, line int, col int, params array<string>, receiver string, ret_type string, types array<struct<name:string, type:string>>, free array<string>, blocks array<struct<block:int, stmts:array<{_STMT}>>>, edges array<struct<src:int, dst:int, kind:string>>",
    "import": "module string, names array<string>, full array<string>, line int, kind string",
    "decl": "kind string, name string, member string, type string, line int",
    "node": "id string, kind string, parent string, ord int, line int, col int, name string",
    "error": "error string",
}


def language(path: Column, text: Column) -> Column:
    """Language by extension; a ``.h`` file is C++ where its text shows it."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(ext == "h", F.when(text.rlike(_CPP), "cpp").otherwise("c"))
    for name, all_ in LANGUAGES.items():
        out = out.when(ext.isin(all_.split()), name)
    return out


def read_files(spark: SparkSession, folder: str, exclude: list[str] | None = None) -> DataFrame:
    """``path``, ``text`` and ``lang`` of all files below ``folder``, without hidden and excluded ones.

    ``exclude`` has wildcards over the path below the folder. Bytes that are no UTF-8 are replaced.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = folder.rstrip("/")
    path = F.regexp_replace(F.col("path"), "^file:/*(?=/)", "")
    path = F.regexp_replace(path, "^" + at.replace("file://", "").replace(".", r"\.") + "/", "")
    out = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text")).where(~F.col("path").rlike(r"(^|/)\."))
    for pattern in exclude or []:
        out = out.where(~F.col("path").rlike("^" + "".join(".*" if c == "*" else "[.]" if c == "." else c for c in pattern) + "$"))
    return out.withColumn("lang", language(F.col("path"), F.col("text")))


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, key, text in zip(*(batch.column(c).to_pylist() for c in ("path", "key", "text")), strict=True):
            *relations, error = lowered(path, text)
            rows = [(kind, json.dumps(r)) for kind, own in zip(("function", "import", "decl", "node"), relations, strict=True) for r in own]
            rows += [("error", json.dumps({"error": error}))] if error else []
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([key] * len(part)), pa.array([k for k, _ in part]), pa.array([r for _, r in part])], ["path", "key", "relation", "record"])


def content_key(path: Column, text: Column) -> Column:
    """What a file's facts depend on."""
    return F.sha2(F.concat_ws("\u0001", path, text), 256)


def facts(files: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """``path``, ``key``, ``relation``, ``record`` of all Python ``files`` (path, text).

    Of ``cached``, an earlier table of facts, those of unchanged files are taken; only the others
    are parsed.
    """
    ship(files.sparkSession)
    own = files.withColumn("key", content_key(F.col("path"), F.col("text")))
    if "lang" in files.columns:
        own = own.where("lang = 'python'")
    kinds = "path string, key string, relation string, record string"
    if cached is None:
        return own.select("path", "key", "text").mapInArrow(_lower, kinds)
    known = cached.join(own.select("path", "key"), ["path", "key"], "left_semi")
    new = own.join(cached.select("path", "key").distinct(), ["path", "key"], "left_anti")
    return known.select("path", "key", "relation", "record").unionByName(new.select("path", "key", "text").mapInArrow(_lower, kinds))


def relation(table: DataFrame, kind: str) -> DataFrame:
    """One relation of the facts: function, import, decl, node or error; with ``path``."""
    own = table.where(F.col("relation") == kind).select("path", F.from_json("record", SCHEMAS[kind]).alias("r"))
    return own.select("r.*") if kind == "function" else own.select("path", "r.*")


def statements(functions: DataFrame) -> DataFrame:
    """fn_id, block, idx, kind, line, col, text, assigns, calls, ret of every statement."""
    block = functions.select("fn_id", "path", F.explode("blocks").alias("b"))
    return block.select("fn_id", "path", "b.block", F.posexplode("b.stmts").alias("idx", "s")).select("fn_id", "path", "block", "idx", "s.*")


def flow_edges(functions: DataFrame) -> DataFrame:
    """fn_id, src, dst, kind between blocks."""
    return functions.select("fn_id", F.explode("edges").alias("e")).select("fn_id", "e.*")


def assignments(functions: DataFrame) -> DataFrame:
    """fn_id, block, idx, target, strong, paths, calls."""
    return statements(functions).select("fn_id", "block", "idx", F.explode("assigns").alias("a")).select("fn_id", "block", "idx", "a.*")


def calls(functions: DataFrame) -> DataFrame:
    """fn_id, path, block, idx, call, callee, line, col, recv, args."""
    return statements(functions).select("fn_id", "path", "block", "idx", F.explode("calls").alias("c")).select("fn_id", "path", "block", "idx", "c.*")


def arguments(functions: DataFrame) -> DataFrame:
    """Arguments in order: fn_id, callee, line, col, ord, pos, kw, literal, paths."""
    return calls(functions).select("fn_id", "callee", "line", "col", F.posexplode("args").alias("ord", "a")).select("fn_id", "callee", "line", "col", "ord", "a.pos", "a.kw", "a.literal", "a.paths")
