"""The N best rows of every group by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaders(names: list[str], n: int):
    """Streams sorted Arrow batches and passes on the first n rows of each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = pa.table({c: b.column(c) for c in names}).to_struct_array().combine_chunks()
            same = [False] + [True] * (b.num_rows - 1)
            if b.num_rows > 1:
                new = None
                for c in names:
                    col = b.column(c)
                    d = pc.fill_null(pc.not_equal(col[1:], col[:-1]), True)
                    new = d if new is None else pc.or_(new, d)
                same = [False, *(not x for x in new.to_pylist())]
            first = tuple(keys[0].as_py().values())
            if first == last:
                same[0] = True
            keep = []
            for i, s in enumerate(same):
                seen = seen + 1 if s else 1
                if seen <= n:
                    keep.append(i)
            last = tuple(keys[b.num_rows - 1].as_py().values())
            if keep:
                yield b.take(pa.array(keep))

    return run


def top_n_per_group(df: DataFrame, group: list[str], score: str, ident: str, n: int) -> DataFrame:
    """The n rows with the highest ``score`` of every group, ties to the smaller ``ident``.

    Secondary sort: every scan partition is first sorted by (group, score, ident)
    and streamed, so it forwards at most n rows a group (a hot group is thinned
    before it moves); the rest is hash-partitioned by group, sorted again within
    partitions and streamed once more. No group is ever buffered: the state of a
    task is the last key and a count.

    Rows whose group holds a NULL, whose score is NULL or NaN, or whose ident is
    NULL never count. Repeated rows count as often as they occur. All columns
    of ``df`` are kept. An empty table gives an empty one.
    """
    bad = F.col(score).isNull() | F.col(ident).isNull()
    for g in group:
        bad = bad | F.col(g).isNull()
    if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)):
        bad = bad | F.isnan(score)
    order = [*(F.col(g) for g in group), F.desc(score), F.col(ident)]
    run = _leaders(group, n)
    thin = df.where(~bad).sortWithinPartitions(*order).mapInArrow(run, df.schema)
    return thin.repartition(*(F.col(g) for g in group)).sortWithinPartitions(*order).mapInArrow(run, df.schema)
