"""Parquet footers as a DataFrame; Spark's own schema loses unsigned types and fixed-size lists."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from frameledger.sources.files import filesystem

SCHEMA = "path string, error string, row_groups int, columns array<struct<name:string,type:string,element:string,width:int,is_list:boolean,spark:string>>"
_COLUMNS = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("element", pa.string()), ("width", pa.int32()), ("is_list", pa.bool_()), ("spark", pa.string())]))


def spark_type(t: pa.DataType) -> str:
    """Spark's type for an Arrow type, '' for one that holds no numbers or texts."""
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        inner = spark_type(t.value_type)
        return f"array<{inner}>" if inner else ""
    plain = {"float": "float", "double": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "bool": "boolean", "string": "string", "large_string": "string"}
    return plain.get(str(t), "")


def _width(t: pa.DataType) -> int | None:
    """Values per row; None where each row has its own number."""
    if pa.types.is_fixed_size_list(t):
        inner = _width(t.value_type)
        return None if inner is None else t.list_size * inner
    return None if pa.types.is_list(t) else 1


def column(f: pa.Field) -> dict:
    t = f.type
    is_list = pa.types.is_list(t) or pa.types.is_fixed_size_list(t)
    return {"name": f.name, "type": str(t), "element": str(t.value_type) if is_list else None, "width": _width(t), "is_list": is_list, "spark": spark_type(t)}


def read_footers(paths: DataFrame, root: str) -> DataFrame:
    """path, error (null if the file opens), row_groups, columns: one row per relative path in column `path`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(root)
        for b in batches:
            rows = []
            for p in b.column("path").to_pylist():
                try:
                    with system.open_input_file(posixpath.join(base, p)) as f:
                        q = pq.ParquetFile(f)
                        rows.append((p, None, q.metadata.num_row_groups, [column(x) for x in q.schema_arrow]))
                except (OSError, pa.ArrowException) as e:
                    rows.append((p, f"{type(e).__name__}: {e}"[:300], 0, []))
            kinds = (pa.string(), pa.string(), pa.int32(), _COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "error", "row_groups", "columns"])

    return paths.select("path").mapInArrow(run, SCHEMA)
