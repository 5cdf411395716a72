"""Spelling variant grouping (operator 13) by anagram hashing.

A word's key is the sum of its letters' fifth powers. Adding, removing or exchanging one letter changes the key
by that letter's value or by the difference of two, so near words are found by joining keys: a word offers its
key, and its key less each of its letters; two offers that agree differ by an addition or removal (one of them
whole) or by an exchange (both less a letter). What agrees has the right letters in some order; the order is
then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, table
from .resampling import CRC_TABLE_SQL, crc_sql

#: Words have at least so many letters and occurrences; a form is so many times as frequent as its variant.
LETTERS, OCCURRENCES, TIMES = 5, 3, 2
#: One in so many pairs of document and word loses a letter.
MISSPELT = 97
#: A key with more offers than this is joined by letters in order as well.
CROWD = 200
_POWER, _MODULUS = 5, (1 << 61) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[^a-zÀ-ÿ]+"


def without_letter(word: Column, at: Column) -> Column:
    """``word`` less its letter ``at``, counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """``word, n`` of the words of all texts, lower-cased A-Z, with at least ``letters`` letters and ``least`` occurrences.

    In a document whose CRC-32 of ``<key>:<word>`` is divisible by ``MISSPELT`` the word loses the letter that the
    CRC points at. A null key counts as an empty one; null and wordless texts have no words; each repeated row
    counts. Counts are combined before the shuffle, so frequent words cost no more than rare ones.
    """
    split = F.split(F.translate(F.col(f"`{text}`").cast("string"), _UPPER, _LOWER), _BETWEEN)
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(split).alias("run")).where(F.length("run") >= letters)
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    words = runs.select(F.when(h % MISSPELT == 0, without_letter(F.col("run"), at)).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= letters) & (F.col("n") >= least))


def letter_value(letter: Column) -> Column:
    x = F.ascii(letter).cast("long")
    out = x
    for _ in range(_POWER - 1):
        out = out * x
    return out


def offers(words: DataFrame) -> DataFrame:
    """``word, n, key, less``: each word's key with ``less`` empty, and its key less each of its distinct letters."""
    letters = F.split("word", "")
    key = F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: (a + letter_value(c)) % _MODULUS)
    keyed = words.withColumns({"_key": key, "_letters": F.array_distinct(letters)})
    less = F.transform("_letters", lambda c: F.struct(F.pmod(F.col("_key") - letter_value(c), F.lit(_MODULUS)).alias("key"), c.alias("less")))
    every = F.concat(F.array(F.struct(F.col("_key").alias("key"), F.lit("").alias("less"))), less)
    return keyed.select("word", "n", F.inline(every))


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, a_n, b, b_n``, each pair of ``words(word, n)`` once that differs by one inserted, deleted or replaced code point.

    Words are distinct. Where more than ``crowd`` offers share a key (many orders of the same letters), offers are
    joined by what remains in order too, and for exchanges by the place of the letter: at most as many words as
    the alphabet has letters share that, so no key's pairs grow with the square of its offers. (That costs a crowded
    key's words the square of their length; other words, however long, cost their length for each distinct letter.)
    """
    all_offers = cut(offers(words))
    crowded = cut(all_offers.groupBy("key").agg(F.count("*").alias("_m")).where(F.col("_m") > crowd).select("key"))
    crowded = checked_broadcast(crowded)
    plain = all_offers.join(crowded, "key", "left_anti").select("*", F.lit("").alias("rest"), F.lit(0).alias("place"))
    places = F.filter(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.substring(F.col("word"), i + 1, F.lit(1)) == F.col("less"))
    rests = F.transform(places, lambda i: F.struct(without_letter(F.col("word"), i).alias("rest"), i.alias("place")))
    whole = F.array(F.struct(F.col("word").alias("rest"), F.lit(-1).alias("place")))
    ordered = all_offers.join(crowded, "key", "left_semi").select("*", F.inline(F.when(F.col("less") == "", whole).otherwise(rests)))
    sides = plain.unionByName(ordered)
    a, b = (sides.select("key", "rest", *[F.col(c).alias(f"{side}{c}") for c in ("word", "n", "less", "place")]) for side in ("a_", "b_"))
    met = a.join(b, ["key", "rest"]).where("a_less < b_less and (a_less = '' or a_place = b_place)").where(F.levenshtein("a_word", "b_word", 1) == 1)
    return met.select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n").dropDuplicates(["a", "b"])


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``word, root`` for each row of ``forms(word, form)``: the last word that forms lead to. Each round doubles the steps taken.

    Forms must not run in a circle (here each is more frequent than its variant); raises if they do.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        then = cut(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if not then.where("moved").limit(1).count():
            return now
    raise RuntimeError("forms run in a circle")


def spelling_variants(words: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words(word, n)``, which are distinct.

    ``form`` is the most frequent near word (ties: smallest in code-point order) if it is at least ``times`` as
    frequent as the word, else null; ``root`` is where forms lead, the word itself without one. An empty table
    gives an empty one.
    """
    words = cut(words)
    pair = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{y}_n").alias("near_n"), F.col(y).alias("near"))
    near = near_words(words, crowd).select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.minus_n") >= times * F.col("n")
    known = cut(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus_n")).alias("form_n")
        )
    )
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc_sql("(doc_id || ':' || run)")} AS h FROM counted, crc WHERE length(run) >= {LETTERS}),
spelt AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, word[1:i - 1] || '?' || word[i + 1:] AS hole FROM places),
less AS (SELECT DISTINCT word, n, word[1:i - 1] || word[i + 1:] AS rest FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word UNION
  SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word UNION
  SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
known AS (
  SELECT w.word, w.n, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n, coalesce(n_near, 0) AS n_near
  FROM words w LEFT JOIN best b ON w.word = b.word AND r = 1),
walk(word, last) AS (SELECT word, word FROM known UNION ALL SELECT walk.word, known.form FROM walk JOIN known ON walk.last = known.word WHERE known.form IS NOT NULL),
ends AS (SELECT walk.word, walk.last AS root FROM walk JOIN known ON walk.last = known.word WHERE known.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM known JOIN ends USING (word)
"""
