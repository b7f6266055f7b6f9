"""Imports of source files and what they lead to."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.rules import first_found

_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("module", T.StringType()), T.StructField("name", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("type_only", T.BooleanType()), T.StructField("dynamic", T.BooleanType()), T.StructField("error", T.StringType())]
)


def python_imports(source: str) -> tuple[list[tuple], str | None]:
    """([(module, name, level, type_only, dynamic)], error) of a Python source."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], type(e).__name__
    out: list[tuple] = []

    def walk(node: ast.AST, typing: bool) -> None:
        for child in ast.iter_child_nodes(node):
            inner = typing or (isinstance(child, ast.If) and ast.unparse(child.test).endswith("TYPE_CHECKING"))
            if isinstance(child, ast.Import):
                out.extend((a.name, None, 0, typing, False) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend((child.module or "", a.name, child.level, typing, False) for a in child.names)
            elif isinstance(child, ast.Call) and ast.unparse(child.func) in ("__import__", "importlib.import_module", "import_module") and child.args and isinstance(child.args[0], ast.Constant) and isinstance(child.args[0].value, str):
                out.append((child.args[0].value, None, 0, typing, True))
            walk(child, inner)

    walk(tree, False)
    return out, None


_COMMENT = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/""", re.DOTALL)
_TS = re.compile(
    r"""(?:^|[;\n}])\s*(?P<kind>import|export)\s+(?P<type>type\s+)?(?:(?P<what>[\w*{}\s,$]+?)\s+from\s+)?['"](?P<a>[^'"\n]+)['"]|\brequire\(\s*['"](?P<b>[^'"\n]+)['"]\s*\)|\bimport\(\s*['"](?P<c>[^'"\n]+)['"]\s*\)""",
)


def script_imports(source: str) -> list[tuple]:
    """[(module, None, 0, type_only, dynamic)] of a TypeScript or JavaScript source."""
    bare = _COMMENT.sub(lambda m: m.group(1) or " ", source)
    return [(m["a"] or m["b"] or m["c"], None, 0, bool(m["type"]), m["c"] is not None) for m in _TS.finditer(bare)]


def jsonc(text: str) -> str:
    """JSON without comments and trailing commas."""
    return re.sub(r",(\s*[}\]])", r"\1", _COMMENT.sub(lambda m: m.group(1) or " ", text))


def extract_imports(files: DataFrame) -> DataFrame:
    """(path, module, name, level, type_only, dynamic, error) of ``files`` (path, content); a file that cannot be parsed gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(_SCHEMA)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path is None or content is None:
                    continue
                found, error = python_imports(content) if path.endswith(".py") else (script_imports(content), None)
                rows += [(path, *f, None) for f in found]
                if error:
                    rows.append((path, None, None, None, None, None, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with target: the file of ``files`` (path) that each leads to; NULL if none does.

    Candidates are tried in order: for Python the name as a module of the package, the module, then
    packages above it; for scripts the path as it is, with an extension, and as a directory's index.
    """
    named = imports.filter("module IS NOT NULL").select("path", "module", "name", "level").distinct().withColumn("_key", F.xxhash64("path", "module", "name", "level"))
    folder = F.split("path", "/")
    base = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.lit(0), F.size(folder) - F.greatest(F.lit(1), F.col("level")))), "/")
    stem = F.translate("module", ".", "/")
    full = F.when(F.col("level") > 0, F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(stem, F.lit("")))).otherwise(stem)
    inner = F.concat_ws("/", F.nullif(full, F.lit("")), "name")
    python = F.array(F.concat(inner, F.lit(".py")), F.concat(inner, F.lit("/__init__.py")), F.concat(full, F.lit(".py")), F.concat(full, F.lit("/__init__.py")))
    parts = F.split(F.concat_ws("/", F.when(F.col("module").startswith("."), F.array_join(F.slice(folder, F.lit(1), F.size(folder) - 1), "/")), "module"), "/")
    clean = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin(".", ""), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, x)))
    script = F.array_join(clean, "/")
    endings = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
    tried = F.when(F.col("path").endswith(".py"), python).otherwise(F.array(*[F.concat(script, F.lit(e)) for e in endings]))
    found = first_found(named.withColumn("_tried", tried), "_key", "_tried", files.select(F.col("path").alias("target")), "target")
    a, b = imports.alias("a"), found.alias("b")
    same = F.lit(True)
    for c in ("path", "module", "name", "level"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select("a.*", "b.target")
