"""Spelling variants: words one edit apart, found by bands of letter-parity masks, and the form that each may stand for.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. An inserted or deleted letter
flips one bit and a replaced one two, so of three bands of the mask one at least is equal in words one edit apart. Words
meet where a band is equal and lengths differ by one at most. As words of few letters share their bands, such a bucket is
split further by the half of the word that the edit leaves alone, its first or its last. Pairs that meet are compared
letter by letter. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import materialise

#: Letters of a word, a maximal run of them; code points.
LETTER = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Of runs whose crc32 with the document's id it divides, one letter is taken out.
DAMAGE = 199
#: Bits of a band, and bands: a-z and U+00C0 to U+00FF have a bit each.
BAND_BITS, BANDS = 30, 3
#: Tables of words are joined by sorting. Spark would broadcast one by the size of its compressed files, whatever its rows
#: take in memory and however many keys each has: 4.9 MB stand for 6.0 million rows at 0.5 GB of documents.
SORTED = "merge"


def _lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.when(~F.rlike(text, F.lit("[A-Z]")), text).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", damage: int | None = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, that have so many letters and occur so often.

    damage: from a run whose crc32 of `<doc_id>:<run>` it divides, the letter at that number modulo the length goes. A null
    text has no words, a null id is an empty string; other columns are not looked at. Shorter runs cannot become long
    enough words and are left in the text.
    """
    # A run of that many letters starts where its maximal run does, and takes it all.
    runs = F.regexp_extract_all(F.col(text_column), F.lit(f"({LETTER}{{{least_length},}})"), F.lit(1))
    each = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", _lower(F.col("run")).alias("word"))
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        each = each.withColumn("h", h).withColumn("at", (F.col("h") % F.length("word")).cast("int"))
        cut = F.concat(F.expr("left(word, at)"), F.expr("substring(word, at + 2)"))
        each = each.withColumn("word", F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word"))).where(F.length("word") >= least_length)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _masks(word: Column) -> Column:
    """array<long>: the bands of the mask. Letters are dealt to bands in turn, so that each band has common and rare ones."""
    code = lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 166)
    places = F.transform(F.split(word, ""), lambda c: F.pmod(code(c), F.lit(BAND_BITS * BANDS)))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(p / BANDS).cast("int"))
    band = lambda k: F.aggregate(F.filter(places, lambda p: p % BANDS == k), F.lit(0).cast("long"), lambda m, p: m.bitwiseXOR(bit(p)))
    return F.array(*[band(k) for k in range(BANDS)])


def _keys(length: Column) -> Column:
    """array<long>: for each band, and each end of the word, a hash of the band, the half at that end and the length of the
    shorter of two words."""
    half = F.floor(length / 2).cast("int")
    ends = [F.left(F.col("word"), half), F.right(F.col("word"), half)]
    return F.array(*[F.xxhash64(F.lit(len(ends) * k + j), F.col("m")[k], end, length) for k in range(BANDS) for j, end in enumerate(ends)])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: all pairs of words (word, n; each word once) that differ by exactly one inserted, deleted or replaced
    character; each pair once, and a is the shorter one or the smaller one of equal length."""
    masked = words.select("word", "n", F.length("word").alias("length"), _masks(F.col("word")).alias("m"))
    masked = materialise(masked, "masked")
    mine = masked.select("word", "n", "length", "m", F.explode(_keys(F.col("length"))).alias("key"))
    longer = masked.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("length").alias("l_b"), F.col("m").alias("m_b"), F.explode(F.concat(_keys(F.col("length")), _keys(F.col("length") - 1))).alias("key"))
    differing = sum((F.bit_count(F.col("m")[k].bitwiseXOR(F.col("m_b")[k])) for k in range(BANDS)), F.lit(0))
    in_order = (F.col("length") < F.col("l_b")) | (F.col("word") < F.col("b"))
    one_edit = F.levenshtein("word", "b", 1) == 1
    # Keys are hashes: the lengths are compared again.
    met = mine.join(longer.hint(SORTED), "key").where((F.col("l_b") - F.col("length")).between(0, 1) & in_order & (differing <= 2) & one_edit)
    return met.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "b", "n_b").distinct()


def variant_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; each word once).

    n_near: how many words are one edit away. form: of those the one that occurs most (of equal ones the smallest in
    code-point order), if it occurs `times` times as often as the word; form_n is how often. root: where following forms
    from the word ends, itself without a form. Counts grow along forms, so they never run in a circle. No words give no
    rows.
    """
    words = materialise(words, "words")
    pairs = materialise(near_pairs(words), "near-words")
    sides = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), F.col("near"))).alias("best"), F.max("n").alias("n"))
    takes = -F.col("best.col1") >= times * F.col("n")
    best = materialise(best.select("word", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.col1")).alias("form_n")), "forms")
    # Each step doubles how far a root is from its word.
    roots = best.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")).hint(SORTED), "root", "left")
        further = materialise(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    out = words.join(best.hint(SORTED), "word", "left").join(roots.hint(SORTED), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
