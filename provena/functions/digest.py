"""Digest columns. All are SHA-256 hex over UTF-8."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha(value: Column) -> Column:
    return F.sha2(value, 256)


def payload_digest(*parts: Column) -> Column:
    """Parts joined by U+001F. NULL parts count as empty, they are never dropped."""
    return sha(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def operation_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def set_digest(pairs: Column) -> Column:
    """Digest of an array of ``id:sha`` strings, independent of their order."""
    return sha(F.array_join(F.array_sort(pairs), "\n"))


def _streamed(keys: list[str], sep: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by ``keys`` to a row for each key. A key may go on in the next batch;
    what is held of it is its hash so far and a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, state, total, first = None, None, None, 0, True

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(schema)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([*[batch.schema.field(k) for k in keys], pa.field("digest", pa.string()), pa.field("total", pa.int64())])
            found = []
            each = zip(*[batch.column(k).to_pylist() for k in keys])
            for here, line, n in zip(each, batch.column("_line").to_pylist(), batch.column("_n").to_pylist()):
                if state is None or here != key:
                    if state is not None:
                        found.append((*key, state.hexdigest(), total))
                    key, state, total, first = here, hashlib.sha256(), 0, True
                total += n or 0
                if line is not None:
                    if not first:
                        state.update(sep)
                    state.update(line)
                    first = False
            if found:
                yield rows(found)
        if state is not None:
            yield rows([(*key, state.hexdigest(), total)])

    return run


def ordered_digests(rows: DataFrame, keys: list[str], order: list[Column], line: Column, sep: str, total: Column | None = None) -> DataFrame:
    """(keys, digest, total): the digest of each key's lines in ``order``, joined by ``sep``.

    No list of lines is built: rows are sorted inside their partition, which may spill, and
    hashed as they pass, so a key of any size takes the memory of one batch. A NULL line is
    left out, with its separator; a key of such lines only has the digest of nothing.
    ``total`` is summed for each key, NULL as 0; by default it counts the rows. Keys are
    strings or whole numbers, NULL among them; lines that ``order`` does not tell apart
    must be equal for a defined result.
    """
    sorting = {f"_o{i}": c for i, c in enumerate(order)}
    narrow = rows.select(
        *keys, *[c.alias(n) for n, c in sorting.items()], line.cast("binary").alias("_line"),
        (F.lit(1) if total is None else total).cast("bigint").alias("_n"),
    )
    within = narrow.repartition(*keys).sortWithinPartitions(*keys, *sorting).select(*keys, "_line", "_n")
    kept = T.StructType([*[within.schema[k] for k in keys], T.StructField("digest", T.StringType()), T.StructField("total", T.LongType())])
    return within.mapInArrow(_streamed(keys, sep.encode()), kept)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A deterministic id: prefix and 32 hex digits of the parts' digest."""
    return F.concat(F.lit(prefix + "_"), F.substr(payload_digest(*parts), F.lit(1), F.lit(32)))
