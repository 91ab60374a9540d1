"""Deeply nested semi-structured records to related flat tables, by columnar shredding.

``shred`` turns each record into one column chunk per leaf path: three parallel arrays of repetition levels,
definition levels and values. ``assemble`` rebuilds the flat table of any repeated ancestor from the level
sequences of the leaves directly below it, without looking at the nesting again, and gives each child row its
record, the position of its parent and its own position.

Levels. A repeated group at depth k (1 for a list in the record, 2 for a list inside a list) has these definition
levels for an entry: 2k-1, the entry is there but null, empty or not an object; 2k, it is an object with at least
one key. A leaf of the group adds 1 if its key is there with null and 2 if it has a value. A leaf under a list
that is absent or empty has one level triple with the definition level of its deepest ancestor that exists. The
repetition level is 0 for the first triple of a record and else the depth of the list that goes on.

Input lists are read however they are written: an array, an object keyed "0", "1", ..., a lone object (position
0), or a string that holds any of these as JSON. Null, empty and scalar entries are kept as entries, so that the
positions of their siblings stay, but are no rows. Text that does not parse counts as absent. Keys outside the
declared leaves are kept as JSON text in the leaf ``*``, so that no content is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

REST = "*"


@dataclass(frozen=True)
class Group:
    """A repeated group: where its list is found, its declared leaves and the lists inside its entries.

    ``sources``: (input column, key path) in the order in which their entries count. A list of plain names has
    ``scalar`` set and the single leaf ``*``.
    """

    name: str
    sources: tuple[tuple[str, tuple[str, ...]], ...] = ()
    leaves: tuple[str, ...] = ()
    groups: tuple[Group, ...] = field(default=())
    key: str = ""
    scalar: bool = False


def siblings(value: Any) -> list:
    """The entries of a list however it is written."""
    while isinstance(value, str):  # JSON in JSON, however often; each round is shorter by its quotes
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return []
    if isinstance(value, (list, tuple)):
        return list(value)
    if isinstance(value, dict) and value:
        if all(k.isascii() and k.isdigit() for k in value):
            return list(value.values())
        return [value]
    return []


def _dig(value: Any, path: tuple[str, ...]) -> Any:
    for k in path:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class _Chunk:
    """The column chunk of one leaf path over the records of a batch."""

    __slots__ = ("r", "d", "v", "ends")

    def __init__(self) -> None:
        self.r: list[int] = []
        self.d: list[int] = []
        self.v: list[str | None] = []
        self.ends: list[int] = [0]

    def add(self, r: int, d: int, v: str | None = None) -> None:
        self.r.append(r)
        self.d.append(d)
        self.v.append(v)

    def array(self) -> pa.StructArray:
        ends = pa.array(self.ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((self.r, pa.int8()), (self.d, pa.int8()), (self.v, pa.string()))]
        return pa.StructArray.from_arrays(lists, names=["r", "d", "v"])


def leaf_paths(groups: tuple[Group, ...], prefix: str = "") -> list[str]:
    found = []
    for g in groups:
        found += [f"{prefix}{g.name}.{x}" for x in (*g.leaves, REST)]
        found += leaf_paths(g.groups, f"{prefix}{g.name}.")
    return found


def _shred_entries(g: Group, prefix: str, depth: int, entries: list, first_r: int, above: int, chunks: dict[str, _Chunk]) -> None:
    """Add the triples of one list; first_r is the repetition level of its first entry, above its parent's level."""
    path = f"{prefix}{g.name}."
    here = [(x, c) for x in (*g.leaves, REST) if (c := chunks.get(path + x))]
    if not entries:
        for _, c in here:
            c.add(first_r, above)
        for sub in g.groups:
            _shred_entries(sub, path, depth + 1, [], first_r, above, chunks)
        return
    r = first_r
    for entry in entries:
        if g.scalar:
            full = isinstance(entry, str) and bool(entry.strip())
            for _, c in here:
                c.add(r, 2 * depth + 2 if full else 2 * depth - 1, entry if full else None)
        else:
            full = isinstance(entry, dict) and bool(entry)
            level = 2 * depth if full else 2 * depth - 1
            for leaf, c in here:
                if not full:
                    c.add(r, level)
                elif leaf == REST:
                    known = {*g.leaves, *(s.key for s in g.groups)}
                    rest = {k: v for k, v in entry.items() if k not in known}
                    c.add(r, level + 2 if rest else level, _text(rest) if rest else None)
                elif leaf not in entry:
                    c.add(r, level)
                elif (value := entry[leaf]) is None:
                    c.add(r, level + 1)
                else:
                    c.add(r, level + 2, _text(value))
            for sub in g.groups:
                _shred_entries(sub, path, depth + 1, siblings(entry.get(sub.key)) if full else [], r, level, chunks)
        r = depth


def shred(records: DataFrame, record_id: str, groups: tuple[Group, ...], leaves: list[str] | None = None) -> DataFrame:
    """One row per record: ``record_id`` and one struct<r, d, v> of arrays per leaf path, dots written as ``__``.

    ``leaves`` prunes the column chunks to the paths that are needed. A null record_id is kept, repeated records
    are shredded one by one, an empty table gives no rows, and other columns of ``records`` are not read. There is
    no shuffle; memory is bounded by one Arrow batch.
    """
    paths = leaf_paths(groups) if leaves is None else list(leaves)
    sources = list(dict.fromkeys(c for g in groups for c, _ in g.sources))
    jsons = {c for c in sources if isinstance(records.schema[c].dataType, T.StringType)}
    level = T.StructType([T.StructField("r", T.ArrayType(T.ByteType())), T.StructField("d", T.ArrayType(T.ByteType())), T.StructField("v", T.ArrayType(T.StringType()))])
    id_type = records.schema[record_id].dataType
    schema = T.StructType([T.StructField("record_id", id_type), *(T.StructField(p.replace(".", "__"), level) for p in paths)])
    needed = tuple(g for g in groups if any(p.startswith(f"{g.name}.") for p in paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                cols = {c: batch.column(c).to_pylist() for c in sources}
                chunks = {p: _Chunk() for p in paths}
                for i in range(batch.num_rows):
                    parsed = {}
                    for c in sources:
                        value = cols[c][i]
                        if c in jsons and value is not None:
                            try:
                                value = json.loads(value)
                            except (ValueError, RecursionError):
                                value = None
                        parsed[c] = value
                    for g in needed:
                        entries: list = []
                        for c, path in g.sources:
                            entries += siblings(_dig(parsed[c], path))
                        _shred_entries(g, "", 1, entries, 0, 0, chunks)
                    for chunk in chunks.values():
                        chunk.ends.append(len(chunk.r))
                yield pa.RecordBatch.from_arrays([batch.column(record_id), *(chunks[p].array() for p in paths)], names=[f.name for f in schema.fields])

    return records.select(record_id, *[c for c in sources if c != record_id]).mapInArrow(run, schema)


def _positions(r: np.ndarray, d: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the level sequence of a leaf at this depth: which triples are rows, their parent's position, their own."""

    def ordinals(level: int, resets: np.ndarray) -> np.ndarray:
        began = (r <= level) & (d >= 2 * level - 1)
        count = np.cumsum(began)
        at = np.maximum.accumulate(np.where(resets, np.arange(len(r)), 0))
        return count - (count[at] - began[at]) - 1

    own = ordinals(depth, r < depth)
    parent = ordinals(depth - 1, r < depth - 1) if depth > 1 else np.full(len(r), -1)
    return d >= 2 * depth, parent, own


def assemble(shredded: DataFrame, tables: dict[str, str], attributes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Flat child tables from the level sequences; tables: child's name to the dotted path of its repeated group.

    Out come record_id, child, parent_ord (-1 in the record itself), child_ord, and, with ``attributes``, a map of
    the named leaves that have a value for each child table, and ``nulls``, the names of those whose key is there
    with null. A leaf that is in neither was absent.
    """
    id_field = shredded.schema["record_id"]
    fields = [id_field, T.StructField("child", T.StringType()), T.StructField("parent_ord", T.IntegerType()), T.StructField("child_ord", T.IntegerType())]
    if attributes is not None:
        fields.append(T.StructField("attributes", T.MapType(T.StringType(), T.StringType())))
        fields.append(T.StructField("nulls", T.ArrayType(T.StringType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for child, path in tables.items():
                base, depth = path.replace(".", "__"), path.count(".") + 1
                own_leaf = next(n for n in batch.schema.names if n.startswith(f"{base}__") and "__" not in n[len(base) + 2 :])
                chunk = batch.column(own_leaf).flatten()
                r, d = (x.flatten().to_numpy(zero_copy_only=False) for x in chunk[:2])
                if not len(r):
                    continue
                rows, parent, own = _positions(r, d, depth)
                at = np.flatnonzero(rows)
                record = np.repeat(np.arange(batch.num_rows), np.diff(chunk[0].offsets.to_numpy()))[at]
                cols = [batch.column("record_id").take(pa.array(record)), pa.array([child] * len(at), pa.string()), pa.array(parent[at], pa.int32()), pa.array(own[at], pa.int32())]
                if attributes is not None:
                    names = attributes.get(child, ())
                    chunks = {x: batch.column(f"{base}__{x}").flatten() for x in names}
                    # Row by leaf: the name where the definition level says that there is a value, or a null.
                    levels = np.array([c[1].flatten().to_numpy(zero_copy_only=False)[at] for c in chunks.values()]).reshape(len(names), len(at)).T
                    values = np.array([c[2].flatten().take(pa.array(at)).to_numpy(zero_copy_only=False) for c in chunks.values()], dtype=object).reshape(len(names), len(at)).T
                    labels = np.broadcast_to(np.array(names, dtype=object), levels.shape)
                    ends = lambda there: pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32())
                    valued, null = levels == 2 * depth + 2, levels == 2 * depth + 1
                    cols.append(pa.MapArray.from_arrays(ends(valued), pa.array(labels[valued], pa.string()), pa.array(values[valued], pa.string())))
                    cols.append(pa.ListArray.from_arrays(ends(null), pa.array(labels[null], pa.string())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return shredded.mapInArrow(run, schema)
