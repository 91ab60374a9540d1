"""Text normal forms as Column expressions; every one stays inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII and Unicode white space for Java's regular expressions.
SPACE = r"[\s\x{85}\p{Z}]+"


def normal_name(name: Column) -> Column:
    """``_`` read as a space, white space collapsed and trimmed, lower case. Null stays null."""
    return F.lower(F.trim(F.regexp_replace(F.translate(name, "_", " "), SPACE, " ")))


def page_id(title: Column) -> Column:
    return F.concat(F.lit("page:"), normal_name(title))


def letters_digits(text: Column) -> Column:
    """Only letters and decimal digits, lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{Nd}]+", ""))


def title_form(name: Column) -> Column:
    """``_`` read as a space, trimmed, lower case; inner white space stays as it is."""
    return F.lower(F.trim(F.translate(name, "_", " ")))


def slug(name: Column, default: str = "section") -> Column:
    """Lower case, anything but letters a-z and digits as one ``_``, none at the ends; the default if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def base_field(name: Column) -> Column:
    """A field's name without its number: in normal form, trailing digits dropped, trimmed."""
    return F.trim(F.regexp_replace(normal_name(name), r"\d+$", ""))


def clean_name(name: Column) -> Column:
    """``_`` read as a space, white space collapsed and trimmed; case stays."""
    return F.trim(F.regexp_replace(F.translate(name, "_", " "), SPACE, " "))


def unique_strings(values: Column) -> Column:
    """Clean names, empty and null dropped, repeats dropped in order of first sight."""
    return F.array_distinct(F.filter(F.transform(values, clean_name), lambda x: x.isNotNull() & (x != "")))


def field_map(params: Column) -> Column:
    """Map of fields to arrays: parameters by their base field, empty values dropped, repeats of a field dropped."""
    entries = F.transform(F.map_entries(params), lambda e: F.struct(base_field(e["key"]).alias("k"), F.trim(e["value"]).alias("v")))
    kept = F.filter(entries, lambda e: (e["k"] != "") & (e["v"] != ""))
    names = F.array_distinct(F.transform(kept, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: unique_strings(F.transform(F.filter(kept, lambda e: e["k"] == n), lambda e: e["v"]))))


def listed(json: Column) -> Column:
    """The texts of a list however it is written, from get_json_object: an array, an object of numbered entries, a lone
    text, or any of these as JSON in a string. Null gives null; a null entry stays one."""
    as_map = F.map_values(F.from_json(json, "map<string,string>"))
    return F.when(json.rlike(r"^\s*\["), F.from_json(json, "array<string>")).when(json.rlike(r"^\s*\{"), as_map).when(json.isNotNull(), F.array(json))


#: Fixed values, in order: character references and what they stand for.
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"))


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


#: A link with its target and an optional label.
LINK = r"\[\[([^\[\]|#]*)(?:#[^\[\]|]*)?(?:\|([^\[\]]*))?\]\]"


def links(text: Column) -> Column:
    """Array of struct<target, label> of the links to articles; links to files, images and categories are left out."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.trim(x))
    labels = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(2)), lambda x: F.trim(x))
    both = F.arrays_zip(targets.alias("target"), labels.alias("label"))
    pairs = F.transform(both, lambda x: F.struct(x["target"].alias("target"), F.coalesce(F.nullif(x["label"], F.lit("")), x["target"]).alias("label")))
    return F.filter(pairs, lambda x: (x["target"] != "") & ~x["target"].rlike(r"(?i)^\s*(file|image|category)\s*:"))


def tri_state(text: Column) -> Column:
    """true for yes, true and y, false for no, false and n, whatever the case; null for anything else."""
    low = F.lower(text)
    return F.when(low.isin("yes", "true", "y"), True).when(low.isin("no", "false", "n"), False)


def clip(text: Column, n: int) -> Column:
    """White space collapsed and trimmed, then at most n characters, with ``...`` in place of what was cut off; null is empty."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 3)), F.lit("..."))).otherwise(flat)


#: Fixed value: what counts as a search token.
TOKEN = r"[a-z0-9][a-z0-9'+_\-]*"


def tokens(text: Column) -> Column:
    """Lower-case search tokens of at least two characters, in order, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda x: F.length(x) > 1)


def phrase(text: Column) -> Column:
    """Letters a-z and digits in normal form, anything else as one space, none at the ends."""
    return F.trim(F.regexp_replace(normal_name(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def safe_number(text: Column) -> Column:
    """A double for a plain or scientific number, else null: no separators, no names such as Infinity or NaN."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def numbers_in(text: Column) -> Column:
    """All whole numbers that stand alone in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b\d+\b"), F.lit(0)), lambda x: x.try_cast("bigint"))


def gold_amount(value: Column) -> Column:
    """Whole millions from 10,000,000, whole thousands from 100,000, else the digits in groups."""
    part = lambda n, sign: F.concat(F.floor(value / n).cast("string"), F.lit(sign))
    return F.when(value >= 10_000_000, part(1_000_000, "M")).when(value >= 100_000, part(1000, "K")).otherwise(F.format_number(value, 0))


def stack_amount(value: Column) -> Column:
    """Whole billions, millions or thousands, whichever fits first; smaller numbers as they are."""
    part = lambda n, sign: F.concat(F.floor(value / n).cast("string"), F.lit(sign))
    return F.when(value >= 1_000_000_000, part(1_000_000_000, "B")).when(value >= 1_000_000, part(1_000_000, "M")).when(value >= 1000, part(1000, "K")).otherwise(value.cast("string"))


def play_time(ticks: Column, tick_ms: int = 600) -> Column:
    """Ticks as ``3h 12m``, or ``12m`` below an hour."""
    seconds = F.floor(ticks * F.lit(tick_ms / 1000))
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return F.when(hours > 0, F.concat(hours, F.lit("h "), minutes, F.lit("m"))).otherwise(F.concat(minutes, F.lit("m")))


def split_list(text: Column, at: str = r"\s*,\s*") -> Column:
    """Parts of a list that is written as text, cleaned and without repeats; null gives an empty list."""
    return unique_strings(F.split(F.coalesce(text, F.lit("")), at))


def aliases(title: Column, listed_names: Column, names: Column) -> Column:
    """Other names: ``listed_names`` are taken apart at commas, ``names`` are not; cleaned, without repeats and without
    the title itself in its normal form. Null arrays count as empty."""
    none = F.array().cast("array<string>")
    parts = F.flatten(F.transform(F.filter(F.coalesce(listed_names, none), lambda x: x.isNotNull()), lambda x: F.split(x, r",\s*")))
    own = title_form(F.coalesce(title, F.lit("")))
    return unique_strings(F.filter(F.concat(parts, F.coalesce(names, none)), lambda x: title_form(x) != own))


#: Fixed values, in order: the type of a page, the pattern of its templates and that of its categories.
TYPE_RULES = (
    ("quest", r"^infobox quest$|^quest details$", r"^(quests|free-to-play quests|members' quests|novice quests|intermediate quests|experienced quests|master quests|grandmaster quests)$"),
    ("item", r"^infobox item$", r"\bitems?\b"),
    ("npc", r"^infobox npc$", r"non-player characters|\bnpcs?\b"),
    ("monster", r"^infobox monster$", r"\bmonsters?\b"),
    ("location", r"^infobox location$", r"^(locations|cities|towns|dungeons)$"),
    ("shop", r"^infobox shop$", r"^(shops|stores)$"),
    ("skill", r"^infobox skill$", r"^skills?$|skill training"),
    ("spell", r"^infobox spell$", r"\bspells?\b|magic spells"),
    ("prayer", r"^infobox prayer$", r"\bprayers?\b"),
    ("combat_achievement", r"^infobox combat achievement$", r"combat achievements|achievements tasks"),
    ("achievement_diary", None, r"achievement diar"),
    ("minigame", None, r"\bminigames?\b"),
    ("scenery", r"^infobox scenery$", r"\bscenery\b"),
    ("guide", None, r"\bguides?\b|quick guide|training"),
    ("event", None, r"^(events|holiday events|birthday events|christmas events|easter events|halloween events|thanksgiving events|midsummer events)$"),
    ("music", None, r"\bmusic\b|soundtrack"),
)
#: Which type counts where a page has several, the first first.
TYPE_PRIORITY = ("item", "monster", "npc", "quest", "location", "shop", "skill", "spell", "prayer", "combat_achievement", "achievement_diary", "minigame", "scenery", "event", "guide", "music")


def matched_types(categories: Column, templates: Column) -> Column:
    """The types of TYPE_RULES that a category or a template name matches in normal form, in the order of the rules."""
    none = F.array().cast("array<string>")
    keys = lambda c: F.filter(F.transform(F.coalesce(c, none), normal_name), lambda x: x.isNotNull())
    have = {"t": keys(templates), "c": keys(categories)}
    marks = [F.when((F.exists(have["t"], _like(t)) if t else F.lit(False)) | F.exists(have["c"], _like(c)), F.lit(kind)) for kind, t, c in TYPE_RULES]
    return F.array_compact(F.array(*marks))


def primary_type(types: Column) -> Column:
    """The first of TYPE_PRIORITY that is among the types, else article."""
    return F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, TYPE_PRIORITY)), lambda p: F.array_contains(types, p)), F.lit(1)), F.lit("article"))


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def numbers_of(fields: Column, wanted: list[str]) -> Column:
    """Map of the wanted fields that read as numbers."""
    kept = F.map_filter(fields, lambda k, v: k.isin(wanted) & v.try_cast("double").isNotNull())
    return F.transform_values(kept, lambda k, v: v.try_cast("double"))
