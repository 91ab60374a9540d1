"""Schemas that drift between files: one report of every change, one consistent table.

``leaf_counts`` counts the fields of JSON lines by file and type. ``file_schemas`` keeps the fields that belong to
each file. ``proposals`` pairs each file with the one before it in its feed and matches the two schemas by similarity
flooding: both become graphs of name, type and nesting, match scores spread over the pairwise connectivity graph
until they settle, and every pair of a field that is gone and one that is new is proposed with its score.
``confirmed`` keeps the proposals whose values agree, and ``drift`` chooses among these one to one, best scores
first. ``consistent`` follows the renames along each feed, casts and unions.

Only fields that belong to a file are brought together per file pair; there are at most 1 / least_share times as
many as a line has. Values meet in a join on (file pair, record key, value), so that a pair of fields costs as many
rows as it has equal values, and only pairs with some are looked at again.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.runtime import cut

TYPES = ("string", "number", "boolean", "array")
COUNTS = "feed string, file_seq int, path string, type string, n bigint"
HELD = "feed string, file_seq int, rec_key string, line_no int, path string, hash bigint"
CHANGES = "feed string, file_seq int, change string, field string, new_field string"


def _bad_constant(name: str) -> None:
    raise ValueError(name)


def parse_line(body: str | None) -> Any:
    """The JSON value of a line, or ValueError: blank, broken and null lines do not parse."""
    if body is None:
        raise ValueError("null")
    return json.loads(body, parse_constant=_bad_constant)


def type_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "string"


def leaves_of(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """Dotted paths to the values other than null that are not objects."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves_of(v, f"{path}.{k}" if path else k)
    elif value is not None and path:
        yield path, value


def _plain(value: Any) -> Any:
    """Numbers that are equal are written alike."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_plain(x) for x in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def value_hash(value: Any) -> int:
    text = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"))
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def _lines(lines: DataFrame, *more: str) -> DataFrame:
    known = lines.where(F.col("file_seq").isNotNull())
    return known.select(F.col("feed").cast("string"), F.col("file_seq").cast("int"), F.col("rec_key").cast("string"), F.col("line_no").cast("int"), F.col("body").cast("string"), *more)


def leaf_counts(lines: DataFrame) -> DataFrame:
    """feed, file_seq, path, type, n: how many lines hold a value of the type; path '' counts the lines that parse.

    lines: feed, file_seq, rec_key, line_no, body; other columns are not read. Lines that do not parse give
    nothing; a line that parses to something other than an object is a line without fields. Counts are partial, one
    row per field and batch of lines, so sum them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for feed, seq, body in zip(*(batch.column(c).to_pylist() for c in ("feed", "file_seq", "body")), strict=True):
                try:
                    line = parse_line(body)
                except (ValueError, RecursionError):
                    continue
                counts[(feed, seq, "", "")] = counts.get((feed, seq, "", ""), 0) + 1
                if isinstance(line, dict):
                    for p, v in leaves_of(line):
                        k = (feed, seq, p, type_of(v))
                        counts[k] = counts.get(k, 0) + 1
            cols = list(zip(*counts, strict=True)) if counts else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(counts.values(), pa.int64())], names=["feed", "file_seq", "path", "type", "n"])

    return _lines(lines).mapInArrow(run, COUNTS)


def held_values(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """feed, file_seq, path, rec_key, line_no, hash: the values of the wanted fields (feed, file_seq, paths) line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, path, hashed = [], [], []
            for i, (body, paths) in enumerate(zip(batch.column("body").to_pylist(), batch.column("paths").to_pylist(), strict=True)):
                try:
                    line = parse_line(body)
                except (ValueError, RecursionError):
                    continue
                if isinstance(line, dict):
                    for p, v in leaves_of(line):
                        if p in paths:
                            at.append(i)
                            path.append(p)
                            hashed.append(value_hash(v))
            rows = pa.array(at, pa.int32())
            cols = [batch.column(c).take(rows) for c in ("feed", "file_seq", "rec_key", "line_no")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(path, pa.string()), pa.array(hashed, pa.int64())], names=["feed", "file_seq", "rec_key", "line_no", "path", "hash"])

    typed = _lines(lines).where(F.col("rec_key").isNotNull())
    asked = wanted.select(F.col("feed").alias("_feed"), F.col("file_seq").alias("_seq"), "paths")
    both = typed.join(asked, typed["feed"].eqNullSafe(asked["_feed"]) & (typed["file_seq"] == asked["_seq"])).drop("_feed", "_seq")
    return both.mapInArrow(run, HELD)


def file_schemas(counts: DataFrame, least_share: float = 0.2) -> DataFrame:
    """feed, file_seq, prev_seq, fields, prev_fields: the (path, type) pairs that belong to each file and the one before.

    A field belongs to a file if at least ``least_share`` of its lines that parse hold a value for it; its type is
    that of most of these values, the first of TYPES in a tie. Files without any line that parses do not count. The
    share is tested before the fields of a file are brought together, so keys that are data gather nowhere.
    """
    of_type = [F.sum(F.when(F.col("type") == t, F.col("n")).otherwise(0)).alias(f"_{t}") for t in TYPES]
    per_path = cut(counts.groupBy("feed", "file_seq", "path").agg(F.sum("n").alias("_n"), *of_type), "paths")
    most = F.greatest(*[F.col(f"_{t}") for t in TYPES])
    kind = F.coalesce(*[F.when(F.col(f"_{t}") == most, F.lit(t)) for t in TYPES])
    files = per_path.where(F.col("path") == "").select(F.col("feed").alias("_feed"), F.col("file_seq").alias("_seq"), F.col("_n").alias("_lines"))
    same_file = F.col("feed").eqNullSafe(F.col("_feed")) & (F.col("file_seq") == F.col("_seq"))
    kept = per_path.where(F.col("path") != "").join(files, same_file).where(F.col("_n") >= F.col("_lines") * F.lit(least_share) - F.lit(1e-9))
    packed = kept.groupBy("_feed", "_seq").agg(F.array_sort(F.collect_list(F.struct("path", kind.alias("type")))).alias("fields"))
    none = F.array().cast("array<struct<path:string,type:string>>")
    every = files.withColumnsRenamed({"_feed": "feed", "_seq": "file_seq"}).join(packed, same_file, "left").select("feed", "file_seq", F.coalesce("fields", none).alias("fields"))
    feed = Window.partitionBy("feed").orderBy("file_seq")
    return every.withColumn("prev_seq", F.lag("file_seq").over(feed)).withColumn("prev_fields", F.lag("fields").over(feed))


# -- similarity flooding -------------------------------------------------------------------------------------


def _words(name: str) -> list[str]:
    out, last = [], ""
    for ch in name:
        if not ch.isalnum():
            last = ""
            continue
        if not out or not last or (ch.isupper() and last.islower()):
            out.append("")
        out[-1] += ch.lower()
        last = ch
    return out


def name_similarity(a: str, b: str) -> float:
    wa, wb = _words(a), _words(b)
    if not wa or not wb:
        return 0.0
    shared = len(set(wa) & set(wb)) / len(set(wa) | set(wb))
    return max(shared, SequenceMatcher(None, "".join(wa), "".join(wb)).ratio())


def schema_graph(fields: list[tuple[str, str]]) -> tuple[list[str], list[tuple[int, str, int]]]:
    """Nodes and labelled edges: an object holds its children, every field has a name and a type."""
    nodes: dict[str, int] = {}
    edges: set[tuple[int, str, int]] = set()

    def node(x: str) -> int:
        return nodes.setdefault(x, len(nodes))

    root = node("/")
    for path, kind in fields:
        above, parts = root, path.split(".")
        for i, part in enumerate(parts):
            here = node("/" + ".".join(parts[: i + 1]))
            edges.add((above, "child", here))
            edges.add((here, "name", node("name:" + part)))
            above = here
        edges.add((above, "type", node("type:" + kind)))
    return list(nodes), sorted(edges)


def flood(old: list[tuple[str, str]], new: list[tuple[str, str]], most_rounds: int = 60, settled: float = 1e-3, memo: dict | None = None) -> dict[tuple[str, str], float]:
    """Scores of the field pairs of two schemas, spread over the pairwise connectivity graph to convergence.

    memo: name similarities that are known from schemas before.
    """
    memo = {} if memo is None else memo

    def similar(a: str, b: str) -> float:
        if (a, b) not in memo:
            memo[a, b] = name_similarity(a, b)
        return memo[a, b]

    na, ea = schema_graph(old)
    nb, eb = schema_graph(new)
    by_label: dict[str, list[list[tuple[int, int]]]] = defaultdict(lambda: [[], []])
    for a, label, c in ea:
        by_label[label][0].append((a, c))
    for b, label, d in eb:
        by_label[label][1].append((b, d))
    width = len(nb)
    first, second, labels = [], [], []
    for k, (xs, ys) in enumerate(by_label.values()):
        if not xs or not ys:
            continue
        x, y = np.array(xs), np.array(ys)
        first.append((x[:, 0][:, None] * width + y[:, 0][None, :]).ravel())
        second.append((x[:, 1][:, None] * width + y[:, 1][None, :]).ravel())
        labels.append(np.full(len(first[-1]), k))
    start = np.zeros(len(na) * width)
    leaf = lambda x: x.rpartition(":")[2] if x.startswith(("name:", "type:")) else x.rpartition(".")[2].lstrip("/")
    kind = lambda x: x[:5] if x.startswith(("name:", "type:")) else "/"
    for i, x in enumerate(na):
        for j, y in enumerate(nb):
            if kind(x) == kind(y):
                start[i * width + j] = 1.0 if x == y else 0.5 * similar(leaf(x), leaf(y)) if kind(x) != "type:" else 0.0
    if first:
        src, dst, lab = np.concatenate(first), np.concatenate(second), np.concatenate(labels)
        # Each pair hands its score on in equal parts over its neighbours of the same label, in either direction.
        out = np.unique(lab * len(start) + src, return_inverse=True, return_counts=True)
        back = np.unique(lab * len(start) + dst, return_inverse=True, return_counts=True)
        w_out, w_back = 1.0 / out[2][out[1]], 1.0 / back[2][back[1]]
        score = start.copy()
        for _ in range(most_rounds):
            spread = start + score
            spread = spread + np.bincount(dst, score[src] * w_out, len(start)) + np.bincount(src, score[dst] * w_back, len(start))
            spread /= max(spread.max(), 1e-12)
            change = np.abs(spread - score).max()
            score = spread
            if change < settled:
                break
    else:
        score = start
    ia, ib = {x: i for i, x in enumerate(na)}, {x: i for i, x in enumerate(nb)}
    return {(p, q): float(score[ia["/" + p] * width + ib["/" + q]]) for p, _ in old for q, _ in new}


def correspond(pairs: dict[tuple[str, str], float]) -> dict[str, str]:
    """A one-to-one choice that matches as many fields as possible, best scores first."""
    wishes: dict[str, list[str]] = defaultdict(list)
    for (old, new), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        wishes[old].append(new)
    taken: dict[str, str] = {}

    def place(old: str, seen: set[str]) -> bool:
        for new in wishes[old]:
            if new not in seen:
                seen.add(new)
                if new not in taken or place(taken[new], seen):
                    taken[new] = old
                    return True
        return False

    for old in dict.fromkeys(o for (o, _), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))):
        place(old, set())
    return {old: new for new, old in taken.items()}


def proposals(schemas: DataFrame) -> DataFrame:
    """feed, file_seq, prev_seq, old, new, score: flooding of each pair of files in which fields went and came.

    schemas: the rows of ``file_schemas`` with a file before. The graphs are those of the whole schemas. All pairs of
    a field that is gone and one that is new are proposed, so no correspondence is lost to a low score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                old, new = ([(x["path"], x["type"]) for x in row[c]] for c in ("prev_fields", "fields"))
                before, after = dict(old), dict(new)
                gone, fresh = [p for p in before if p not in after], [p for p in after if p not in before]
                if gone and fresh:
                    scores = flood(old, new, memo=memo)
                    out += [(row["feed"], row["file_seq"], row["prev_seq"], p, q, scores[p, q]) for p in gone for q in fresh]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["feed", "file_seq", "prev_seq", "old", "new", "score"])

    # Schemas are few and flooding them is the work, so they are spread out first.
    spread = schemas.where(F.col("fields") != F.col("prev_fields")).select("feed", "file_seq", "prev_seq", "prev_fields", "fields").repartition("feed", "file_seq")
    return spread.mapInArrow(run, "feed string, file_seq int, prev_seq int, old string, new string, score double")


def confirmed(lines: DataFrame, proposed: DataFrame, same_share: float = 0.8) -> DataFrame:
    """feed, file_seq, old, new, score: the proposals whose values agree for ``same_share`` of the keys that have both."""
    side = lambda seq, path: proposed.select("feed", F.col(seq).alias("file_seq"), F.col(path).alias("path"))
    wanted = side("prev_seq", "old").unionByName(side("file_seq", "new")).groupBy("feed", "file_seq").agg(F.collect_set("path").alias("paths"))
    of_key = held_values(lines, wanted).groupBy("feed", "file_seq", "path", "rec_key")
    held = cut(of_key.agg(F.min_by("hash", F.struct("line_no", "hash")).alias("value")), "held")
    pairs = proposed.select("feed", "file_seq", "prev_seq").distinct()
    name = lambda df, of: df.select(*[F.col(c).alias(f"{of}_{c}") for c in ("feed", "file_seq", "path", "rec_key", "value")])
    o, w = name(held, "o"), name(held, "n")
    at_old = F.col("feed").eqNullSafe(F.col("o_feed")) & (F.col("prev_seq") == F.col("o_file_seq"))
    at_new = F.col("feed").eqNullSafe(F.col("n_feed")) & (F.col("file_seq") == F.col("n_file_seq")) & (F.col("o_rec_key") == F.col("n_rec_key"))
    keys = ["feed", "file_seq", "old", "new"]
    # Fields are looked at as a pair only where a key has the same value in both; without any they can't agree.
    equal = pairs.join(o, at_old).join(w, at_new & (F.col("o_value") == F.col("n_value"))).groupBy("feed", "file_seq", F.col("o_path").alias("old"), F.col("n_path").alias("new")).agg(F.count(F.lit(1)).alias("same"))
    match = F.col("feed").eqNullSafe(F.col("_f")) & (F.col("file_seq") == F.col("_s")) & (F.col("old") == F.col("_o")) & (F.col("new") == F.col("_n"))
    likely = cut(proposed.join(equal.withColumnsRenamed({"feed": "_f", "file_seq": "_s", "old": "_o", "new": "_n"}), match).select(*keys, "prev_seq", "score", "same"), "likely")
    both = likely.join(o, at_old & (F.col("old") == F.col("o_path"))).join(w, at_new & (F.col("new") == F.col("n_path")))
    counted = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("same").alias("same"), F.max("score").alias("score"))
    return counted.where(F.col("same") >= F.col("n") * F.lit(same_share) - F.lit(1e-9)).select(*keys, "score")


def changes_between(old: list[tuple[str, str]], new: list[tuple[str, str]], agreed: dict[tuple[str, str], float]) -> list[tuple[str, str, str]]:
    """(change, field, new_field) from one schema to the next; agreed: the confirmed pairs with their flooded scores."""
    before, after = dict(old), dict(new)
    found = [("type_changed", p, "") for p, t in old if p in after and after[p] != t]
    renamed = correspond(agreed)
    found += [("renamed", p, renamed[p]) if p in renamed else ("removed", p, "") for p in before if p not in after]
    return found + [("added", p, "") for p in after if p not in before and p not in set(renamed.values())]


def drift(lines: DataFrame, least_share: float = 0.2, same_share: float = 0.8) -> DataFrame:
    """feed, file_seq, change, field, new_field: every change from one file of a feed to the next.

    A field that is gone is ``renamed`` to a new field if flooding proposes the pair and the new field holds the
    values that the old one held in the file before, for at least ``same_share`` of the record keys that have both.
    Confirmed pairs are taken one to one by their flooded scores, so structure decides where values alone do not. A
    key with several lines in a file has the value of its first line that has one; null keys are not compared.
    Repeated lines count as lines. A null feed is a feed; lines without a file_seq belong to no file. An empty table
    gives no changes.
    """
    # The lines are parsed twice: for the schemas, and for the values of the fields that moved. Both are written once.
    schemas = cut(file_schemas(leaf_counts(lines), least_share), "schemas").where(F.col("prev_seq").isNotNull())
    proposed = cut(proposals(schemas), "proposed")
    evidence = confirmed(lines, proposed, same_share).groupBy(F.col("feed").alias("_feed"), F.col("file_seq").alias("_seq")).agg(F.collect_list(F.struct("old", "new", "score")).alias("agreed"))
    whole = schemas.join(evidence, schemas["feed"].eqNullSafe(evidence["_feed"]) & (schemas["file_seq"] == evidence["_seq"]), "left").where(F.col("fields") != F.col("prev_fields"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                old_fields, new_fields = ([(x["path"], x["type"]) for x in row[c]] for c in ("prev_fields", "fields"))
                agreed = {(x["old"], x["new"]): x["score"] for x in row["agreed"] or ()}
                out += [(row["feed"], row["file_seq"], *x) for x in changes_between(old_fields, new_fields, agreed)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:])], names=["feed", "file_seq", "change", "field", "new_field"])

    return whole.select("feed", "file_seq", "prev_fields", "fields", "agreed").mapInArrow(run, CHANGES)


# -- one consistent table ------------------------------------------------------------------------------------


def canonical_names(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """feed, file_seq, names: for each file, a map from the paths that were renamed to the first name in their chain."""
    files = lines.select(F.col("feed").cast("string"), F.col("file_seq").cast("int")).distinct()
    steps = changes.where(F.col("change") == "renamed").groupBy("feed").agg(F.collect_list(F.struct("file_seq", "field", "new_field")).alias("steps"))
    of_feed = files.groupBy("feed").agg(F.collect_set("file_seq").alias("files"))
    both = of_feed.join(steps.withColumnRenamed("feed", "_feed"), F.col("feed").eqNullSafe(F.col("_feed"))).select("feed", "files", "steps")
    schema = "feed string, file_seq int, names map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feeds, seqs, maps = [], [], []
            for row in batch.to_pylist():
                known: dict[str, str] = {}
                todo = sorted(row["steps"], key=lambda x: x["file_seq"])
                k = 0
                for seq in sorted(x for x in row["files"] if x is not None):
                    was = dict(known)
                    while k < len(todo) and todo[k]["file_seq"] <= seq:
                        known[todo[k]["new_field"]] = was.get(todo[k]["field"], todo[k]["field"])
                        k += 1
                    feeds.append(row["feed"])
                    seqs.append(seq)
                    maps.append([(a, b) for a, b in known.items() if a != b])
            yield pa.RecordBatch.from_arrays([pa.array(feeds, pa.string()), pa.array(seqs, pa.int32()), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=["feed", "file_seq", "names"])

    return both.mapInArrow(run, schema)


def cast_value(value: Any, kind: str) -> Any:
    """value as kind, or None if it has no such reading: lists of one are unwrapped, single values wrapped."""
    if kind == "array":
        return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in (value if isinstance(value, list) else [value])]
    if isinstance(value, list):
        if len(value) != 1 or isinstance(value[0], (list, dict)) or value[0] is None:
            return json.dumps(value, ensure_ascii=False) if kind == "string" else None
        value = value[0]
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if kind == "number":
        try:
            return None if isinstance(value, bool) else float(value)
        except (ValueError, OverflowError):
            return None
    if isinstance(value, bool):
        return value
    return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(str(value).strip().lower())


def column_names(paths: list[str], taken: set[str]) -> dict[str, str]:
    """Column names of dotted paths that differ even when case is ignored; the first paths get the plain names."""
    used, out = {x.lower() for x in taken}, {}
    for p in paths:
        name = base = p.replace(".", "_")
        k = 2
        while name.lower() in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name.lower())
        out[p] = name
    return out


def consistent(lines: DataFrame, keep: list[str], least_share: float = 0.2) -> DataFrame:
    """All lines that parse to an object in one table: the columns ``keep``, one column per field, and ``rest``.

    A field that was renamed along a feed has one column under its first name. A field has a column if it belongs to
    some file, under any of its names, whatever their number; a column's type is that of most of its values over all
    files. Stray fields, and values that cannot be cast, are kept as JSON text in the map ``rest``, so nothing is lost.
    """
    names = cut(canonical_names(drift(lines, least_share), lines), "names")
    mapped = lines.join(names.withColumnsRenamed({"feed": "_feed", "file_seq": "_seq"}), lines["feed"].eqNullSafe(F.col("_feed")) & (lines["file_seq"] == F.col("_seq")), "left")
    counts = cut(leaf_counts(lines).groupBy("feed", "file_seq", "path", "type").agg(F.sum("n").alias("n")), "counts")
    size = counts.where(F.col("path") == "").select(F.col("feed").alias("_f"), F.col("file_seq").alias("_s"), F.col("n").alias("_lines"))
    of_path = Window.partitionBy("feed", "file_seq", "path")  # at most one row per type
    of_file = counts.where(F.col("path") != "").join(size, F.col("feed").eqNullSafe(F.col("_f")) & (F.col("file_seq") == F.col("_s"))).withColumn("belongs", F.sum("n").over(of_path) >= F.col("_lines") * F.lit(least_share) - F.lit(1e-9)).drop("_f", "_s")
    named = of_file.join(names.withColumnsRenamed({"feed": "_feed", "file_seq": "_seq"}), F.col("feed").eqNullSafe(F.col("_feed")) & (F.col("file_seq") == F.col("_seq")), "left")
    totals = named.groupBy(F.coalesce(F.try_element_at("names", F.col("path")), F.col("path")).alias("path"), "type").agg(F.sum("n").alias("n"), F.max("belongs").alias("belongs"))
    by_path = totals.groupBy("path").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("n"), F.max("belongs").alias("belongs")).where("belongs")
    types = {r["path"]: r["type"] for r in by_path.orderBy(F.desc("n"), "path").collect()}  # the schema of the result
    columns = column_names(list(types), {*keep, "rest"})
    spark_types = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}
    arrow_types = {"string": pa.string(), "number": pa.float64(), "boolean": pa.bool_(), "array": pa.list_(pa.string())}
    kept = [lines.schema[c] for c in keep]
    schema = T.StructType([*kept, *(T.StructField(columns[p], spark_types[types[p]]) for p in columns), T.StructField("rest", T.MapType(T.StringType(), T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                at, made, rests = [], {p: [] for p in columns}, []
                for i, (body, renames) in enumerate(zip(batch.column("body").to_pylist(), batch.column("names").to_pylist(), strict=True)):
                    try:
                        line = parse_line(body)
                    except (ValueError, RecursionError):
                        continue
                    if not isinstance(line, dict):
                        continue
                    first = dict(renames or ())
                    row: dict[str, Any] = {}
                    rest: dict[str, str] = {}
                    for path, value in leaves_of(line):
                        target = first.get(path, path)
                        cast = cast_value(value, types[target]) if target in types and target not in row else None
                        if cast is None:
                            rest[path] = json.dumps(value, ensure_ascii=False)
                        else:
                            row[target] = cast
                    at.append(i)
                    for p, values in made.items():
                        values.append(row.get(p))
                    rests.append(list(rest.items()))
                rows = pa.array(at, pa.int32())
                cols = [batch.column(c).take(rows) for c in keep]
                cols += [pa.array(made[p], arrow_types[types[p]]) for p in columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(rests, pa.map_(pa.string(), pa.string()))], names=[f.name for f in schema.fields])

    return mapped.select(*[lines[c] for c in keep], lines["body"], "names").mapInArrow(run, schema)
