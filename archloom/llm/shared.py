"""Tables in the cluster's shared folder, and passes over rows.

Intermediate results that are read more than once are written as Parquet to the folder that
``spark.checkpoint.dir`` names (see operators/staging.py), so that a lost executor costs nothing but a re-read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from archloom.operators.staging import cut_lineage as staged
from archloom.operators.staging import discard, new_folder

from .text import slices

__all__ = ["discard", "new_folder", "numbered", "row_wise", "staged"]


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under the names c0, c1, ..., and which is which: what an operator adds can't clash with them."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def row_wise(docs: DataFrame, text: str, keep: list[str] | None, made: str, measure: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns ``keep`` of docs (default: all but the text) and those that measure() makes of Arrow arrays of whole texts, in one pass.

    made: their names and types, as in DDL. A kept column of such a name gives way. Columns travel under numbers, so their names can't clash.
    """
    names = [x.split()[0] for x in made.split(", ")]
    keep = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c not in names]
    source = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("t"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *measure(b.column(b.num_columns - 1))], [*b.schema.names[:-1], *names])

    return source.mapInArrow(run, ", ".join([*kinds, made])).toDF(*keep, *names)
