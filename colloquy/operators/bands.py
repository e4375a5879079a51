"""Bands of scores from a table of cut points, of any number: each score is looked up by binary search in its scheme's cuts.

This is a range join whose one side is a bounded table: what is broadcast is its sorted cut points, rows stay where they
are, and the plan does not grow with the bands. `scoring.band` is the compiled form for a few fixed ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType

#: For each scheme, the sorted upper ends of its bands (the last one open) and their names.
Bands = Mapping[str, tuple[np.ndarray, tuple[str, ...]]]


def banded(rows: DataFrame, bands: Bands, scheme: str = "scheme", score: str = "score", name: str = "band") -> DataFrame:
    """rows with the band of each score: the first of its scheme whose upper end is not below the score.

    Null scores, scores above the last upper end, and schemes that the table lacks have no band (null).
    """
    schema = StructType([*rows.schema.fields]).add(name, StringType())
    sent = rows.sparkSession.sparkContext.broadcast(dict(bands))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(scheme).dictionary_encode()
            codes = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            values = batch.column(score).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out = np.full(batch.num_rows, None, dtype=object)
            for code, kind in enumerate(kinds.dictionary.to_pylist()):
                if kind in sent.value:
                    cuts, names = sent.value[kind]
                    mine = np.flatnonzero((codes == code) & ~np.isnan(values))
                    at = np.searchsorted(cuts, values[mine], side="left")
                    out[mine] = np.append(np.array(names, dtype=object), None)[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
