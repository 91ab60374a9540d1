"""Text quality by distribution tails: statistics of texts and of their passages, sketched per language.

1. ``common_words`` finds the words that most documents of a language use, from the documents themselves.
2. ``measured`` cuts each text into passages (sentences, items, rows) and counts what a passage is made of: words,
   phrases, common words, letters, word lengths. Only counts leave this step.
3. ``sketch`` counts the values of each statistic per language in buckets of constant relative width. Bucket counts
   merge by addition in any order. Passages are weighted by the common *and* uncommon words that they hold side by
   side (the smaller number, squared, times a hundred, and one), as running text does and lists, tables, codes and strings of function words
   do not. So the centre of a language stays in its running text even if nearly all of its documents are junk.
4. ``scales`` reads medians and median absolute deviations from the buckets; ``passage_scores`` turns every value
   into a robust z-score of its language, with the sampling error of short passages in the denominator.
5. A passage in the tail of a statistic, or of a sum of several, is not running text; ``running_shares`` adds up the
   characters of the others.

A language is what ``lang`` says, trimmed and in lower case; every language has its own scales, however many there
are. A text without a language has that of the frequent languages whose common words it uses most.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.runtime import cut

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*(?=\s|$)|\n")
_BREAK = re.compile(r"[^\w\s'’\"“”«»„.!?…\-‐¿¡]+|\t| {3,}|\s[-–—]\s|_")
_ASIDE = re.compile(r" \([^()]*\)")
_MARKUP = re.compile(r"\[\[|\]\]|'''?|</?(?:b|i|em|strong|small|sup|sub|ref|span|p|br)\b[^<>]*>|&\w+;|[:;]-?[)(DP](?=\s|$)")
_ITEM = re.compile(r"\s*(?:[-–—*•+#>|!]|\d+[.)]|\[[ x]?\]|<|\{|==)")


def language(lang: Column) -> Column:
    return F.coalesce(F.lower(F.trim(lang)), F.lit(""))


# -- the common words of each language -----------------------------------------------------------------------


def common_words(documents: DataFrame, most: int = 60, frequent_share: float = 0.001) -> DataFrame:
    """lang, words: the ``most`` words that the most documents of a language use, joined by spaces; ties by spelling.

    documents: lang, text. Only words that stand at least five in a row count, so that lists and tables do not
    make their entries common. Every document counts. For lang '' the words are those of all languages with at
    least ``frequent_share`` of the documents (so at most 1 / frequent_share), written ``lang=words`` and joined by
    line breaks; if there is no such language, '' has words of its own.
    """
    parts = F.split(F.lower(F.col("text")), r"[^\p{L} ]+")
    rows = F.filter(parts, lambda x: x.rlike(r"^ *\p{L}+ +\p{L}+ +\p{L}+ +\p{L}+ +\p{L}"))
    words = F.array_remove(F.array_distinct(F.split(F.array_join(rows, " "), " +")), "")
    counted = documents.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # The aggregate keeps the best few of each group, so no language is gathered or sorted in one task.
    best = F.expr(f"slice(sort_array(collect_list(struct(-n AS n, word))), 1, {most})")
    partial = counted.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64))).groupBy("lang", "salt").agg(best.alias("b"))
    of_lang = partial.groupBy("lang").agg(F.expr(f"array_join(transform(slice(sort_array(flatten(collect_list(b))), 1, {most}), x -> x.word), ' ')").alias("words"))
    lists = cut(of_lang, "words")
    sizes = documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("lang") != "")
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    frequent = sizes.join(F.broadcast(total)).where(F.col("n") >= F.col("total") * F.lit(frequent_share)).select("lang")
    known = lists.join(frequent, "lang", "left_semi").agg(F.expr("array_join(sort_array(collect_list(concat(lang, '=', words))), '\n')").alias("words"))
    unknown = known.where(F.col("words") != "").select(F.lit("").alias("lang"), "words")
    own = lists.where(F.col("lang") == "").join(unknown, "lang", "left_anti")
    return cut(lists.where(F.col("lang") != "").unionByName(unknown).unionByName(own), "common")


def with_words(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds ``words`` by language. The lists are a written table, so Spark knows its size and sends it to every task
    only below its own limit; beyond that the documents are shuffled by language, and AQE splits the large ones."""
    return documents.join(lists, "lang", "left")


class _Lists:
    """The parsed word lists of a worker: a text of one language has its set, one without has a table to guess by."""

    def __init__(self) -> None:
        self.sets: dict[str, frozenset] = {}
        self.tables: dict[str, tuple[dict, dict]] = {}

    def of(self, lang: str, words: str | None, used: list[str]) -> tuple[str, frozenset]:
        if not words:
            return lang, frozenset()
        if lang or "=" not in words:
            found = self.sets.get(words)
            if found is None:
                found = self.sets[words] = frozenset(words.split())
            return lang, found
        table = self.tables.get(words)
        if table is None:
            sets = {k: frozenset(v.split()) for k, _, v in (line.partition("=") for line in words.split("\n"))}
            speaks: dict[str, list[str]] = {}
            for k in sorted(sets):
                for w in sets[k]:
                    speaks.setdefault(w, []).append(k)
            table = self.tables[words] = (sets, speaks)
        sets, speaks = table
        votes: dict[str, int] = {}
        for w in used:
            for k in speaks.get(w, ()):
                votes[k] = votes.get(k, 0) + 1
        if not votes:
            return lang, frozenset()
        best = min(votes, key=lambda k: (-votes[k], k))
        return best, sets[best]


# -- passages ------------------------------------------------------------------------------------------------


def passages_of(text: str) -> list[str]:
    """Sentences, items and rows of a text. A line of five words or more that ends without a mark goes on in the next
    line, unless that begins like an item; a blank line ends it."""
    lines: list[str] = []
    open_ = False
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            open_ = False
            continue
        if open_ and not _ITEM.match(line):
            lines[-1] += " " + bare
        else:
            lines.append(bare)
        open_ = bare[-1] not in ".!?…:;|" and "\t" not in line and len(bare.split(None, 5)) >= 5
    return [s for s in map(str.strip, _SENTENCE.split("\n".join(lines))) if s]


#: What is counted in a passage: characters, words, phrases, common words, letters and signs outside of brackets,
#: letters in words, their squares per word, the smaller number of distinct common and uncommon words, repetition.
COUNTS = ("chars", "words", "phrases", "common", "letters", "signs", "length", "squares", "both", "again")


def passage_counts(passage: str, common: frozenset, seen: set[str]) -> tuple[int, ...]:
    again = passage.lower()
    repeated = again in seen
    seen.add(again)
    bare = _MARKUP.sub("", passage)
    words = _WORD.findall(bare.lower())
    main = _ASIDE.sub("", bare) if "(" in bare else bare
    sizes = list(map(len, words))
    length = sum(sizes)
    letters = length if main is bare else sum(map(len, _WORD.findall(main)))
    known = [w for w in words if w in common]
    kinds, distinct = len(set(known)), len(set(words))
    return (len(passage) + 1, len(words), 1 + len(_BREAK.findall(main)), len(known), letters, len(main) - main.count(" "), length, sum(n * n for n in sizes), min(kinds, distinct - kinds), int(repeated))


PASSAGES = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in COUNTS]))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, passages: the counts of every passage of each whole text; lang is guessed where it is ''.

    documents: doc_id, lang, words, text. Repeated rows stay rows. A null or empty text has no passages.
    """
    struct = pa.struct([(c, pa.int32()) for c in COUNTS])
    schema = T.StructType([documents.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("passages", PASSAGES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists()
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                langs, sizes, ends, counts = [], [], [0], []
                for lang, words, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "text")), strict=True):
                    text = text or ""
                    used = _WORD.findall(text.lower()) if not lang else []
                    lang, common = lists.of(lang, words, used)
                    seen: set[str] = set()
                    counts += [passage_counts(p, common, seen) for p in passages_of(text)]
                    langs.append(lang)
                    sizes.append(len(text))
                    ends.append(len(counts))
                cols = list(zip(*counts, strict=True)) if counts else [[]] * len(COUNTS)
                values = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in cols], fields=list(struct))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[f.name for f in schema.fields])

    return documents.select("doc_id", "lang", "words", "text").mapInArrow(run, schema)


def word_shares(documents: DataFrame) -> DataFrame:
    """doc_id, lang, common_share, text: the share of the words of each text that are common in its language."""
    schema = T.StructType([documents.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("common_share", T.DoubleType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists()
        for batch in batches:
            langs, shares = [], []
            for lang, words, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "text")), strict=True):
                used = _WORD.findall((text or "").lower())
                lang, common = lists.of(lang, words, used)
                langs.append(lang)
                shares.append(sum(map(common.__contains__, used)) / len(used) if used else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), batch.column("text")], names=[f.name for f in schema.fields])

    return documents.select("doc_id", "lang", "words", "text").mapInArrow(run, schema)


# -- statistics of whole documents ---------------------------------------------------------------------------

STATISTICS = ("n_chars", "n_words", "mean_word", "symbol_share", "digit_share", "line_end_share", "mean_line", "common_share")


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang and STATISTICS, one row per row of ``documents`` (doc_id, lang, words, text).

    Words are what white space separates. Null and empty texts have no words, and shares and means of nothing are
    null. Repeated rows are kept. Whole texts are read, however long.
    """
    rows = word_shares(documents)
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("bigint")
    base = rows.select(
        "doc_id", "lang", "common_share", F.length(text).cast("bigint").alias("n_chars"), count(r"\S+").alias("n_words"), count(r"\S").alias("_solid"), count(r"\p{L}").alias("_letters"), count("[0-9]").alias("_digits"),
        count(r"[^\n]*\S[^\n]*").alias("_lines"), F.regexp_count(F.concat(text, F.lit("\n")), F.lit("[.!?…:;\"”»)][ \t\r]*\n")).cast("bigint").alias("_ends"),
    )
    per = lambda a, b: F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b))
    return base.select(
        "doc_id", "lang", "n_chars", "n_words", per("_solid", "n_words").alias("mean_word"), per(F.col("_solid") - F.col("_letters") - F.col("_digits"), "n_chars").alias("symbol_share"),
        per("_digits", "n_chars").alias("digit_share"), per("_ends", "_lines").alias("line_end_share"), per("n_chars", "_lines").alias("mean_line"), "common_share",
    )


# -- quantile sketches ---------------------------------------------------------------------------------------

#: Relative width of a bucket, and the value below which all count as 0.
WIDTH, LEAST = 0.01, 1e-4


def bucket(value: Column) -> Column:
    """The sketch bucket of a value that is not negative: 0 below LEAST, then one per relative WIDTH."""
    return F.when(value < LEAST, F.lit(0)).otherwise(F.floor(F.log(value / LEAST) / math.log1p(WIDTH)) + 1).cast("int")


def middle(of_bucket: Column) -> Column:
    return F.when(of_bucket == 0, F.lit(0.0)).otherwise(F.exp((of_bucket - F.lit(0.5)) * math.log1p(WIDTH)) * LEAST)


def sketch(rows: DataFrame, values: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """lang, statistic, bucket, n: summed per task before the shuffle; there are at most a few thousand buckets per statistic.

    Values that are null or have no weight do not count.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("statistic"), bucket(v.cast("double")).alias("bucket")) for s, v in values.items()])
    flat = rows.select("lang", (F.lit(1) if weight is None else weight).cast("bigint").alias("n"), F.explode(pairs).alias("p")).where(F.col("p.bucket").isNotNull() & (F.col("n") > 0))
    return flat.groupBy("lang", F.col("p.statistic").alias("statistic"), F.col("p.bucket").alias("bucket")).agg(F.sum("n").alias("n"))


def merge_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("lang", "statistic", "bucket").agg(F.sum("n").alias("n"))


def scales(sketched: DataFrame, ratios: tuple[str, ...] = ()) -> DataFrame:
    """lang, statistic, total, median, mad, cumulative: read from the buckets alone.

    For the statistics in ``ratios``, whose values count by their ratio to each other, mad is the median distance of
    the logarithms. cumulative maps a bucket to the share of the weight that lies below its middle.
    """
    keys = ["lang", "statistic"]
    whole = Window.partitionBy(*keys)  # the buckets of one statistic, whatever the number of values
    up = whole.orderBy("bucket")
    ranked = sketched.withColumn("at", middle(F.col("bucket"))).withColumn("total", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(up))
    median = F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("at"))).over(whole)
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(LEAST)))
    distance = F.when(F.col("statistic").isin(*ratios), F.abs(log("at") - log("median"))).otherwise(F.abs(F.col("at") - F.col("median"))) if ratios else F.abs(F.col("at") - F.col("median"))
    away = ranked.withColumn("median", median).withColumn("away", distance)
    out = away.withColumn("near", F.sum("n").over(whole.orderBy("away").rangeBetween(Window.unboundedPreceding, 0)))
    share = (F.col("upto") - F.col("n") / 2) / F.col("total")
    return out.groupBy(*keys).agg(F.max("total").alias("total"), F.max("median").alias("median"), F.min(F.when(F.col("near") * 2 >= F.col("total"), F.col("away"))).alias("mad"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", share.alias("share"))))).alias("cumulative"))


def _per_language(scale: DataFrame, label: str) -> DataFrame:
    packed = scale.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("statistic", F.struct("median", "mad", "cumulative").alias("s")))).alias("_s"))
    return cut(packed, label)  # written, so that Spark knows its size when it joins


#: The least deviation by which a z-score is scaled, so that a statistic that hardly varies doesn't flag every text.
LEAST_DEVIATION = {"n_chars": 50.0, "n_words": 10.0, "mean_word": 0.2, "mean_line": 5.0}


def scored(stats: DataFrame, scale: DataFrame, names: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Adds ``z``, a map from statistic to robust z-score, and ``percentile``, a map to the share of smaller values.

    A statistic that is null has neither. Every language is scored by its own scales, joined by language.
    """
    joined = stats.join(_per_language(scale, "scales"), "lang", "left")

    def z(s: str) -> Column:
        of = F.try_element_at("_s", F.lit(s))
        return (F.col(s) - of["median"]) / F.greatest(of["mad"] * 1.4826, F.lit(LEAST_DEVIATION.get(s, 0.02)))

    def percentile(s: str) -> Column:
        return F.try_element_at(F.try_element_at("_s", F.lit(s))["cumulative"], bucket(F.col(s).cast("double")))

    zs = F.create_map(*[x for s in names for x in (F.lit(s), z(s))])
    ps = F.create_map(*[x for s in names for x in (F.lit(s), percentile(s))])
    return joined.withColumn("z", zs).withColumn("percentile", ps).drop("_s")


def flagged(scored_stats: DataFrame, tails: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """The rows in a tail of any statistic, with ``tails``, their names; bounds are z-scores, None for no bound."""
    marks = []
    for s, (low, high) in tails.items():
        z = F.col("z")[s]
        if low is not None:
            marks.append(F.when(z <= low, F.lit(f"{s}-low")))
        if high is not None:
            marks.append(F.when(z >= high, F.lit(f"{s}-high")))
    return scored_stats.withColumn("tails", F.array_compact(F.array(*marks))).where(F.size("tails") > 0)


# -- running text --------------------------------------------------------------------------------------------

#: The statistics of a passage; for words and flow (words per phrase) ratios count.
PASSAGE_RATIOS = ("words", "flow")
PASSAGE_STATISTICS = (*PASSAGE_RATIOS, "common", "signs", "length", "spread")


def passage_sketch(docs: DataFrame) -> DataFrame:
    """The sketch of the passages of ``measured`` documents per language, weighted as running text (see above)."""
    rows = docs.select("lang", F.explode("passages").alias("p")).where((F.col("p.words") > 0) & (F.col("p.again") == 0)).select("lang", "p.*")
    k = F.col("words")
    mean = F.col("length") / k
    values = {
        "words": k, "flow": k / F.col("phrases"), "common": F.col("common") / k, "signs": F.greatest(F.lit(0), 1 - F.col("letters") / F.greatest(F.col("signs"), F.lit(1))),
        "length": mean, "spread": F.greatest(F.lit(0), F.col("squares") / k - mean * mean),
    }
    return sketch(rows, values, 1 + 100 * F.col("both") * F.col("both"))


#: The least deviations by which passages are scored.
LEAST_PASSAGE_DEVIATION = {"words": 0.05, "flow": 0.05, "common": 0.02, "signs": 0.005, "length": 0.05, "spread": 0.0}


def passage_scores(p: dict[str, np.ndarray], at: dict[str, np.ndarray], dev: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """z-scores of passages from their counts and the scales of their languages, all arrays of one length.

    Shares and means of few words vary by chance; that variance adds to the scale's.
    """
    k = np.maximum(p["words"], 1).astype(float)
    signs = np.maximum(0.0, 1 - p["letters"] / np.maximum(p["signs"], 1))
    z = lambda value, s, chance=0.0: (value - at[s]) / np.sqrt(dev[s] ** 2 + chance)
    return {
        "words": z(np.log(k), "words"), "flow": z(np.log(k / p["phrases"]), "flow"), "common": z(p["common"] / k, "common", at["common"] * (1 - at["common"]) / k),
        "letters": -z(signs, "signs", at["signs"] * (1 - at["signs"]) / p["chars"]), "length": z(p["length"] / k, "length", at["spread"] / k),
    }


def running_shares(docs: DataFrame, scale: DataFrame, one: float = 3.0, several: float = 2.5) -> DataFrame:
    """doc_id, lang, n_chars, running_share, repeated_share of ``measured`` documents.

    A passage is not running text if it repeats an earlier one, has no words, lies below -``one`` in words, words per
    phrase, share of common words or share of letters, or below -``several`` in a sum of z-scores over the root of
    their number: of those four where they are negative, or of short words with many common ones among them, as in
    function words strung together. Texts without characters have null shares. Scales are joined by language; the
    scores are arrays over all passages of a batch.
    """
    packed = _per_language(scale.drop("cumulative").withColumn("cumulative", F.lit(0)), "passage-scales")
    of = {s: F.try_element_at(F.col("_s"), F.lit(s)) for s in PASSAGE_STATISTICS}
    centre = lambda s: F.log(F.greatest(of[s]["median"], F.lit(LEAST))) if s in PASSAGE_RATIOS else of[s]["median"]
    bounds = [F.coalesce(centre(s), F.lit(0.0)).alias(f"at_{s}") for s in PASSAGE_STATISTICS]
    bounds += [F.greatest(of[s]["mad"] * 1.4826, F.lit(LEAST_PASSAGE_DEVIATION[s])).alias(f"dev_{s}") for s in PASSAGE_STATISTICS]
    joined = docs.join(packed, "lang", "left").select("doc_id", "lang", "n_chars", "passages", *bounds)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("running_share", T.DoubleType()), T.StructField("repeated_share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("passages")
            flat = lists.flatten()
            p = {c: flat.field(c).to_numpy() for c in COUNTS}
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at, dev = ({s: batch.column(f"{x}_{s}").to_numpy(zero_copy_only=False)[row] for s in PASSAGE_STATISTICS} for x in ("at", "dev"))
            z = passage_scores(p, at, dev)
            low = np.stack([z["words"], z["flow"], z["common"], z["letters"]])
            keep = (p["again"] == 0) & (p["words"] > 0) & (low.min(axis=0, initial=np.inf) >= -one) & (np.minimum(low, 0).sum(axis=0) / 2 >= -several) & ((z["length"] - z["common"]) / math.sqrt(2) >= -several)
            chars = batch.column("n_chars").to_numpy(zero_copy_only=False)

            def share(there: np.ndarray, p: dict = p, row: np.ndarray = row, chars: np.ndarray = chars) -> pa.Array:
                found = np.bincount(row, p["chars"] * there, len(chars)) / np.maximum(chars, 1)
                return pa.array(np.minimum(found, 1.0), mask=chars == 0)

            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "n_chars")), share(keep), share(p["again"] == 1)], names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)
