import random

import pytest
from pyspark.sql import functions as F

from quern.llm.quality import PASSAGE_RATIOS, bucket, common_words, document_statistics, flagged, language, measured, merge_sketches, middle, passage_sketch, passages_of, running_shares, scales, scored, sketch, with_words

NOUNS = [a + b + c for a in ("sie", "vil", "tun", "scro", "basi", "fer", "quar") for b in ("la", "mo", "ri", "ten", "ker") for c in ("ge", "nel", "lisk", "ry", "man", "cher")]
VERBS = [a + b for a in ("guard", "sell", "hid", "follow", "measur", "collect", "repair", "search", "carri", "buri") for b in ("s", "ed", "ing")]
PLACES = "Nordheim Kalvor Westmark Ostrin Belfast Dunmore Talvik Hesper".split()
MIDDLE = "and then goes back to|because nobody else wants|as soon as they have left|in order to find|on the way to|but it is not far from".split("|")


def sentence(rng):
    return f"The {rng.choice(NOUNS)} in the {rng.choice(NOUNS)} of {rng.choice(PLACES)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} {rng.choice(MIDDLE)} the {rng.choice(NOUNS)} that was {rng.choice(VERBS)} at {rng.choice(PLACES)}."


def swap(text, table):
    return " ".join(table.get(w.lower(), w) for w in text.split(" "))


#: Another language for the library: every small word is spelled differently, so no list of known words can help.
OTHER = {"the": "nu", "in": "wo", "of": "sa", "and": "ky", "then": "tel", "goes": "rann", "back": "ovu", "to": "di", "because": "perka", "nobody": "nils", "else": "mer", "wants": "vul", "as": "ka", "soon": "bald", "they": "zij", "have": "hab", "left": "weg", "order": "ord", "find": "finn", "on": "pa", "way": "vei", "but": "men", "it": "det", "is": "er", "not": "ikk", "far": "fjer", "from": "fra", "that": "som", "was": "var", "at": "ved"}


def prose(rng, lang):
    text = " ".join(sentence(rng) for _ in range(rng.randint(3, 9)))
    return text if lang == "en" else swap(text, OTHER)


def junk(rng, lang):
    kind = rng.randrange(5)
    if kind == 0:
        return "\n".join(f"- {rng.randint(1, 500)} x {rng.choice(NOUNS)}" for _ in range(20))
    if kind == 1:
        return "\n".join("\t".join([rng.choice(NOUNS), rng.choice(PLACES), str(rng.randint(1, 99999)), f"{rng.randint(1, 99)}%"]) for _ in range(15))
    if kind == 2:
        return " ".join(f"{rng.getrandbits(32):08x}" for _ in range(60))
    if kind == 3:
        small = list(OTHER) if lang == "en" else list(OTHER.values())
        return " ".join(rng.choice(small) for _ in range(120)) + "."
    return (prose(rng, lang).split(".")[0] + ". ") * 12


def corpus(spark, shares, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for lang, share in shares.items():
        rows += [(lang, i < n * share) for i in range(n)]
    made = [(k, (junk if bad else prose)(rng, lang), lang, bad) for k, (lang, bad) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string, bad boolean")


def running(docs):
    slim = docs.select("doc_id", language(F.col("lang")).alias("lang"), "text")
    passages = measured(with_words(slim, common_words(slim.select("lang", "text"))))
    return running_shares(passages, scales(passage_sketch(passages), PASSAGE_RATIOS))


@pytest.mark.parametrize("share", [0.2, 0.9])
def test_tails_survive_junk_in_any_language(spark, share):
    """Nine tenths of a language may be junk, and no word of the second language is known to the library."""
    docs = corpus(spark, {"en": 0.2, "xx": share})
    got = {r.doc_id: r.running_share < 0.5 for r in running(docs).collect()}
    for lang in ("en", "xx"):
        truth = {r.doc_id: r.bad for r in docs.where(F.col("lang") == lang).collect()}
        both = sum(got[i] and bad for i, bad in truth.items())
        assert both / sum(truth.values()) >= 0.9
        assert both / max(1, sum(got[i] for i in truth)) >= 0.9


def test_mixtures_count_characters(spark):
    base = corpus(spark, {"en": 0.2})
    rng = random.Random(9)
    table = "red ring\tKox\t2539\t55%\n" * 3
    rows = [(9001, prose(rng, "en") + "\n\n" + "".join(f"red {x}\tKox\t{i}\t5%\n" for i, x in enumerate(NOUNS * 9)), "en", True), (9002, " ".join(sentence(rng) for _ in range(9)) + "\n\n" + table, "en", False), (9003, " ".join(sentence(rng) for _ in range(9)), None, False)]
    got = {r.doc_id: r for r in running(base.unionByName(spark.createDataFrame(rows, base.schema))).where("doc_id > 9000").collect()}
    assert got[9001].running_share < 0.5 < got[9002].running_share
    assert got[9003].lang == "en" and got[9003].running_share > 0.9  # a text without a language has one guessed


def test_passages():
    wrapped = "the hermit in the quarry of Talvik\nsells the anvil to the raider.\n- one\n- two three four five six seven\n\nlast words here"
    assert passages_of(wrapped) == ["the hermit in the quarry of Talvik sells the anvil to the raider.", "- one", "- two three four five six seven", "last words here"]
    assert passages_of("") == [] and passages_of(" \n\t ") == []


def test_common_words_come_from_the_documents(spark):
    rows = [("en", "the cat sat on the mat and slept\nrare"), ("en", "the dog sat on the bed and slept"), ("en", "- list\n- list\n- list"), ("", "nobody"), ("zz", None)]
    got = {r.lang: r.words for r in common_words(spark.createDataFrame(rows, "lang string, text string"), 4).collect()}
    assert got["en"] == "and on sat slept" and got[""] == "en=and on sat slept" and "list" not in got["en"] and "zz" not in got


def test_odd_texts(spark):
    long = " ".join(sentence(random.Random(i)) for i in range(4000))
    rows = spark.createDataFrame([(1, None, None, 0.1), (2, "", " EN ", 0.2), (3, long, "en", 0.3), (3, "x", "en", 0.4), (None, " \n ", "en", 0.5)], "doc_id bigint, text string, lang string, running_share double")
    docs = rows.select("doc_id", language(F.col("lang")).alias("lang"), "text")
    worded = with_words(docs, common_words(docs.select("lang", "text")))
    got = {(r.doc_id, r.n_chars): r for r in document_statistics(worded).collect()}
    assert got[1, 0].n_words == 0 and got[1, 0].mean_word is None and got[2, 0].lang == "en" and got[2, 0].common_share is None
    assert (3, len(long)) in got and got[None, 3].line_end_share is None
    shares = {(r.doc_id, r.n_chars): r.running_share for r in running(rows).collect()}
    assert shares[1, 0] is None and shares[2, 0] is None and shares[None, 3] == 0.0 and len(shares) == 5
    assert running(rows.where("false")).count() == 0 and document_statistics(worded.where("false")).count() == 0


def test_sketches_merge_and_scale(spark):
    values = [float(i % 97) for i in range(2000)] + [None] * 5
    stats = spark.createDataFrame([(i, "en" if i % 2 else "de", v) for i, v in enumerate(values)], "doc_id int, lang string, n_words double")
    of = lambda df: sketch(df, {"n_words": F.col("n_words")})
    parts = merge_sketches(of(stats.where("doc_id < 700")), of(stats.where("doc_id >= 700")))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, of(stats).collect()))
    for r in scales(parts).collect():
        mine = sorted(v for i, v in enumerate(values) if v is not None and (i % 2 == 1) == (r.lang == "en"))
        median = mine[(len(mine) - 1) // 2]
        mad = sorted(abs(v - median) for v in mine)[(len(mine) - 1) // 2]
        assert abs(r.median - median) <= 0.03 * median and abs(r.mad - mad) <= 0.1 * mad and r.total == len(mine)
    marked = scored(stats, scales(of(stats)), ("n_words",))
    for r in marked.where("n_words is not null").limit(200).collect():
        mine = [v for i, v in enumerate(values) if v is not None and (i % 2 == 1) == (r.lang == "en")]
        exact = (sum(v < r.n_words for v in mine) + sum(v == r.n_words for v in mine) / 2) / len(mine)
        assert abs(r.percentile["n_words"] - exact) < 0.03
    assert {r.doc_id for r in flagged(marked, {"n_words": (None, 1.2)}).collect()} <= {i for i, v in enumerate(values) if v and v > 75}


def test_weights_and_buckets(spark):
    rows = spark.createDataFrame([("en", 1.0, 1), ("en", 5.0, 10), ("en", 9.0, 0), ("en", None, 4)], "lang string, v double, w int")
    assert {(r.bucket, r.n) for r in sketch(rows, {"v": F.col("v")}, F.col("w")).collect()} == {tuple(r) for r in rows.where("w > 0 and v is not null").select(bucket(F.col("v")), F.col("w").cast("bigint")).collect()}
    for r in rows.where("v is not null").select("v", middle(bucket(F.col("v"))).alias("m")).collect():
        assert abs(r.m - r.v) <= 0.006 * r.v
