"""Wiki markup: templates, links, headings and plain text. Nesting needs a scanner, so these run on Arrow batches.

The scanner walks a text once and keeps a stack of open ``{{`` and ``[[``; separators count only at the depth at
which their construct was opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ENTITIES

_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\||=")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_HEADING = re.compile(r"^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", re.M)
_LINK_END = {"{{": "}}", "[[": "]]"}


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each outermost ``{{...}}``; one that is never closed is no template."""
    out, stack = [], []
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t in _LINK_END:
            stack.append((t, m.start()))
        elif t in ("}}", "]]"):
            while stack and _LINK_END[stack[-1][0]] != t:
                stack.pop()  # an opening of the other kind that was never closed
            if stack:
                kind, start = stack.pop()
                if kind == "{{" and not any(k == "{{" for k, _ in stack):
                    out.append((start, m.end()))
    return out


def split_top(text: str, separator: str, most: int = -1) -> list[str]:
    """Split where the separator is outside any ``{{`` or ``[[``."""
    parts, depth, last = [], 0, 0
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t in _LINK_END:
            depth += 1
        elif t in ("}}", "]]"):
            depth = max(0, depth - 1)
        elif t == separator and not depth and (most < 0 or len(parts) < most):
            parts.append(text[last : m.start()])
            last = m.end()
    return [*parts, text[last:]]


def parse_template(body: str) -> tuple[str, dict[str, str], list[str]]:
    """Name, named and positional parameters of ``{{name|...}}``; a name that is given twice has its last value."""
    name, *arguments = split_top(body[2:-2], "|")
    named: dict[str, str] = {}
    positional: list[str] = []
    for a in arguments:
        parts = split_top(a, "=", 1)
        if len(parts) == 2 and parts[0].strip():
            named[parts[0].strip()] = parts[1].strip()
        else:
            positional.append(a.strip())
    return " ".join(name.replace("_", " ").split()), named, positional


def templates_of(text: str | None) -> list[dict]:
    bare = _COMMENT.sub("", text or "")
    out = []
    for start, end in spans(bare):
        name, named, positional = parse_template(bare[start:end])
        if name and "{{" not in name:
            out.append({"name": name, "named": named, "positional": positional})
    return out


#: Fixed values, in order: what is taken out or rewritten before templates are removed, and after.
BEFORE = tuple((re.compile(p, f), r) for p, r, f in (
    (r"<!--[\s\S]*?-->", "", 0),
    (r"\{\|[\s\S]*?\n\|\}", " ", 0),
    (r"<ref\b[^>]*>[\s\S]*?</ref>", " ", re.I),
    (r"<ref\b[^/>]*/>", " ", re.I),
    (r"\{\{mes\|([^{}|]+)(?:\|[^{}]*)?\}\}", r"\1", re.I),
    (r"\[\[(?:File|Image):[^\]]+\]\]", " ", re.I),
    (r"\[\[Category:[^\]]+\]\]", " ", re.I),
    (r"\[\[([^\]|#]+)(?:#[^\]|]*)?\|([^\]]+)\]\]", r"\2", 0),
    (r"\[\[([^\]|#]+)(?:#[^\]|]*)?\]\]", r"\1", 0),
    (r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1", 0),
    (r"\[https?://[^\s\]]+\]", " ", 0),
))
AFTER = tuple((re.compile(p), r) for p, r in ((r"'{2,5}", ""), (r"={2,}\s*([^=]+?)\s*={2,}", r"\1"), (r"<[^>]+>", " ")))
INNERMOST = re.compile(r"\{\{[^{}]*\}\}")


def without_templates(text: str, most: int = 20) -> str:
    """Innermost templates go first, until none is left or ``most`` rounds are over."""
    for _ in range(most):
        text, n = INNERMOST.subn(" ", text)
        if not n:
            break
    return text


def plain_text(text: str | None) -> str | None:
    """What a reader sees: links by their labels, headings by their words; references, templates, files and tags gone."""
    if text is None:
        return None
    for pattern, put in BEFORE:
        text = pattern.sub(put, text)
    text = without_templates(text)
    for pattern, put in AFTER:
        text = pattern.sub(put, text)
    for name, char in ENTITIES:
        text = text.replace(name, char)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


_TOP_FILE = re.compile(r"\[\[(?:File|Image):[^\]]+\]\]\s*", re.I)
_BRACES = re.compile(r"\{\{|\}\}")


def below_top_matter(text: str) -> str:
    """The text from where it begins to read: templates, files and tables at its top are left out."""
    text, at = _COMMENT.sub("", text), 0
    while True:
        at += len(text) - at - len(text[at:].lstrip())
        end = _top_end(text, at)
        if end is None:
            return text[at:].strip()
        at = end


def _top_end(text: str, at: int) -> int | None:
    """Where the template, file or table that begins at ``at`` ends; None if there is none or it is never closed."""
    if text.startswith("{{", at):
        depth = 0
        for m in _BRACES.finditer(text, at):
            depth += 1 if m.group() == "{{" else -1
            if not depth:
                return m.end()
    elif m := _TOP_FILE.match(text, at):
        return m.end()
    elif text.startswith("{|", at) and (end := text.find("\n|}", at)) >= 0:
        return end + 3
    return None


def maps_of(field: str, value: str | None) -> list[dict]:
    """The map templates in a value, in order: field, x, y, plane, radius, type, name; what is no number is null."""
    out = []
    for m in re.finditer(r"\{\{Map\|[^{}]+\}\}", value or "", re.I):
        named = parse_template(m.group())[1]

        def number(key: str, named: dict = named) -> float | None:
            try:
                return float(named[key])
            except (KeyError, ValueError):
                return None

        out.append({"field": field, "x": number("x"), "y": number("y"), "plane": number("plane"), "radius": number("r"), "type": named.get("mtype"), "name": plain_text(named.get("name", ""))})
    return out


def sections_of(text: str | None) -> list[dict]:
    """Headings of levels 2 to 6 with their text, the path from the top, and an anchor that is unique in the text."""
    bare = text or ""
    found = list(_HEADING.finditer(bare))
    out: list[dict] = [{"level": 1, "heading": "", "path": "", "anchor": "", "body": bare[: found[0].start() if found else len(bare)].strip()}]
    stack: list[tuple[int, str]] = []
    seen: dict[str, int] = {}
    for i, m in enumerate(found):
        level, heading = len(m.group(1)), m.group(2)
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, heading))
        anchor = re.sub(r"\s+", "_", heading)
        seen[anchor] = seen.get(anchor, 0) + 1
        end = found[i + 1].start() if i + 1 < len(found) else len(bare)
        out.append({"level": level, "heading": heading, "path": " > ".join(h for _, h in stack), "anchor": anchor if seen[anchor] == 1 else f"{anchor}_{seen[anchor]}", "body": bare[m.end() : end].strip()})
    return out


def lead_of(text: str | None, paragraphs: int = 2) -> str:
    """The first paragraphs of plain text below the top matter and above the first line that begins with ``==``."""
    body = plain_text(re.split(r"^==", below_top_matter(text or ""), maxsplit=1, flags=re.M)[0]) or ""
    return "\n\n".join([p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()][:paragraphs])


def explode_templates(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, name, named, positional: one row per outermost template."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, t["name"], t["named"], t["positional"]) for k, x in zip(batch[key], batch["_text"], strict=True) for i, t in enumerate(templates_of(x))]
            yield pd.DataFrame(rows, columns=[key, "at", "name", "named", "positional"])

    return pages.select(key, F.col(text).alias("_text")).mapInPandas(run, f"{key} {kind}, at int, name string, named map<string,string>, positional array<string>")


def explode_sections(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, level, heading, path, anchor, body: the text above the first heading and one row per heading."""
    kind = dict(pages.dtypes)[key]
    fields = ["level", "heading", "path", "anchor", "body"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *(s[f] for f in fields)) for k, x in zip(batch[key], batch["_text"], strict=True) for i, s in enumerate(sections_of(x))]
            yield pd.DataFrame(rows, columns=[key, "at", *fields])

    return pages.select(key, F.col(text).alias("_text")).mapInPandas(run, f"{key} {kind}, at int, level int, heading string, path string, anchor string, body string")


def explode_maps(rows: DataFrame, key: str, field: str, text: str) -> DataFrame:
    """key, at, field, x, y, plane, radius, type, name: one row per map template of a text."""
    kind = dict(rows.dtypes)[key]
    columns = ["field", "x", "y", "plane", "radius", "type", "name"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(k, i, *(m[c] for c in columns)) for k, x in zip(batch[key], batch["_text"], strict=True) for i, m in enumerate(maps_of(field, x))]
            yield pd.DataFrame(made, columns=[key, "at", *columns])

    return rows.select(key, F.col(text).alias("_text")).mapInPandas(run, f"{key} {kind}, at int, field string, x double, y double, plane double, radius double, type string, name string")


def rendered(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, plain, lead."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "plain": [plain_text(x) for x in batch["_text"]], "lead": [lead_of(x) for x in batch["_text"]]})

    return pages.select(key, F.col(text).alias("_text")).mapInPandas(run, f"{key} {kind}, plain string, lead string")


# -- numbered parameters -------------------------------------------------------------------------------------


def numbered(named: Column) -> Column:
    """Map of parameters to an array of struct<index, fields>: ``name1``, ``name2`` ... by their trailing number.

    Parameters without a number belong to every variant and are given only if there is no numbered one at all.
    """
    entries = F.map_entries(named)
    with_index = F.transform(entries, lambda e: F.struct(F.regexp_extract(e["key"], r"^(.*?)(\d+)$", 1).alias("k"), F.regexp_extract(e["key"], r"^(.*?)(\d+)$", 2).try_cast("int").alias("i"), e["value"].alias("v")))
    kept = F.filter(with_index, lambda e: e["i"].isNotNull() & (e["k"] != "") & (F.trim(e["v"]) != ""))
    indexes = F.array_sort(F.array_distinct(F.transform(kept, lambda e: e["i"])))
    return F.transform(indexes, lambda i: F.struct(i.alias("index"), F.map_from_entries(F.transform(F.filter(kept, lambda e: e["i"] == i), lambda e: F.struct(e["k"], e["v"]))).alias("fields")))


def slots(named: Column, prefixes: dict[str, str], most: int = 10) -> Column:
    """Array of struct of the parameters prefix1..prefix<most>; slots without the first of them are left out.

    prefixes: field name to parameter pattern with ``{}`` for the number, the required one first.
    """
    first = next(iter(prefixes.values()))
    every = F.array(*[F.struct(F.lit(i).alias("slot"), *[F.try_element_at(named, F.lit(p.format(i))).alias(f) for f, p in prefixes.items()], F.try_element_at(named, F.lit(first.format(i))).alias("_need")) for i in range(1, most + 1)])
    return F.transform(F.filter(every, lambda s: s["_need"].isNotNull() & (F.trim(s["_need"]) != "")), lambda s: F.struct(s["slot"], *[s[f] for f in prefixes]))
