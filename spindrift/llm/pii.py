"""PII surrogates (operator 6): detected entities get keyed replacements of the same type. DataFrame operations only.

E-mail addresses, phone and card numbers (their Luhn status kept), IP addresses, social security numbers, IBANs
(valid ones stay valid), dates of birth and names are found. Letters and digits are replaced one by one from a
keyed hash of the entity's normal form: digits by digits, vowels by vowels and consonants by consonants of the same
script, each in the case it had; everything else (spaces, brackets, dots, titles) stays. Dates move by a keyed
number of days, which keeps them apart.

Names are keyed word by word, so a surname alone and with a given name stay one person. A known given name is
replaced by one of the same gender and script, another word keeps its last letter. A name is found after a title or
by a known given name; once a full name has been found after a title anywhere, its mentions without one change too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, checked_broadcast, cut, table, unboxed, without

#: The key of the registered query. Callers of ``pseudonymise`` bring their own and keep it secret.
QUERY_KEY = "registered-query"
# Titles, given names by gender and script, what comes before a date of birth.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Г-н|Г-жа)"
GIVEN = (
    ("Alice Andrea Anna Barbara Camille Carmen Caroline Catherine Charlotte Christine Claudia Elena Elizabeth Emily Emma Eva Hannah Helen Isabel Jennifer Julia Katharina Laura Linda Louise Lucia Margaret Maria Marie Martina Mary Monica Nicole Olivia Patricia Paula Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria".split()),
    ("Alexander Andrew Antonio Benjamin Carlos Charles Christian Christopher Daniel David Edward Eric Ernesto Felix Francisco Frederick George Hans Henri James John Jonathan José Joseph Juan Karl Klaus Luis Martin Matthew Michael Miguel Nicolas Patrick Paul Pedro Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang".split()),
    ("Александра Анастасия Анна Вера Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split()),
    ("Александр Алексей Андрей Борис Владимир Дмитрий Иван Михаил Николай Павел Пётр Сергей".split()),
)
_BORN = r"(?:[Bb]orn|[Gg]eboren|[Gg]eb\.|[Nn]ée?|[Nn]acid[oa]|[Bb]irth|Geburtsdatum|[Nn]aissance|[Nn]acimiento|DOB)"
_L = r"\p{L}"
_WORD = rf"\p{{Lu}}{_L}+"
# What is detected; the first kind that matches a place wins.
PATTERNS = {
    "email": rf"(?<![{_L}\p{{N}}._%+-])[{_L}\p{{N}}_%+-](?:[{_L}\p{{N}}._%+-]{{0,62}}[{_L}\p{{N}}_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}}\.){{1,8}}[A-Za-z]{{2,24}}(?![{_L}\p{{N}}])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?=\d)(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "date": rf"(?=\d)(?<={_BORN}[ :,]{{1,3}}(?:(?:on|am|le|el|date)[ :]{{1,2}})?)(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{4}}-\d\d-\d\d)(?!\w)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?=[\d+(])(?:(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,8}){1,5}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))",
    "card": r"(?=\d)(?<![\w.-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{4,5})(?![\w-])",
    "name": rf"(?=\p{{Lu}})(?<!{_L}){TITLES}\.? {_WORD}(?:[ -]{_WORD}){{0,2}}",
    # capitalised words in a row: names if a part of them is known as one; possessive, so that a long row takes no stack
    "words": rf"(?=\p{{Lu}})(?<![{_L}\p{{N}}])(?!{TITLES}\b){_WORD}(?:[ -](?!{TITLES}\b){_WORD}(?![{_L}\p{{N}}]))++",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The same for texts without an @, where the search for addresses would be in vain.
NO_MAIL = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email")
#: A text without any of these can't match; it is cheap to test.
HINT = rf"[0-9@]|{TITLES}\.? \p{{Lu}}|\p{{Lu}}{_L}+[ -]\p{{Lu}}"
# The letters that replace letters, by script and sound.
LETTERS = (("[aeiou]", "aeiou"), ("[a-z]", "bcdfghklmnprstvwz"), ("[аеиоуыэюя]", "аеиоуыэюя"), ("[а-яё]", "бвгдзклмнпрстфх"), ("[αεηιουω]", "αεηιουω"), ("[α-ω]", "βγδζθκλμνπρστφχψ"), (r"\p{IsHan}", "安明文华国平志海林春"), (r"[\p{IsHiragana}]", "あいうえおかきくけこさしすせそ"), (r"[\p{IsKatakana}]", "アイウエオカキクケコサシスセソ"))
#: Letters that a surrogate grows by, by script.
GROWTH = ((r"\p{IsCyrillic}", "аеиоубвгдклмнрст"), (r"\p{IsGreek}", "αεηιουβγδκλμνρστ"), (r"\p{IsHan}", "安明文华国平志海林春秋冬东西南北"))
MAX_ROUNDS = 200


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` mentions it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def by_any(text: Column, f) -> Column:
    """``f(pattern)`` of the pattern that fits the text."""
    return F.when(F.contains(text, F.lit("@")), f(ANY)).otherwise(f(NO_MAIL))


def kind_of(v: Column) -> Column:
    """The kind of a value that one of the patterns has matched, from its shape."""
    letters = F.when(v.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(v.rlike(rf"^{TITLES}\.? "), "name").otherwise("words")
    numbers = F.when(v.rlike(r"^\d+(\.\d+){3}$"), "ip").when(v.rlike(r"^(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d\d-\d\d)$"), "date").when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    numbers = numbers.when(v.rlike(r"^(?:\d[ -]?){13,}$"), "card").otherwise("phone")
    return F.when(F.contains(v, F.lit("@")), "email").when(v.rlike(r"^\p{L}"), letters).otherwise(numbers)


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^({TITLES}\.? )", 1)


def words_of(value: Column) -> Column:
    """The words of a name without its title."""
    return F.split(F.substring(value, F.length(_title(value)) + 1, F.length(value)), "[ -]")


def pairs_of(words: Column) -> Column:
    """Neighbouring words, lower-cased, joined by a space."""
    none = F.array().cast("array<string>")
    low = F.transform(words, F.lower)
    return let(low, lambda a: F.when(F.size(a) > 1, F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(none))


def is_given(low: Column) -> Column:
    return low.isin([n.lower() for names in GIVEN for n in names])


def normal(kind: Column, value: Column) -> Column:
    """What makes two mentions one entity: lower-cased e-mails and words, the bare digits or letters of others."""
    bare = F.regexp_replace(F.upper(value), r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("email", "word"), F.lower(value)).when(kind == "ip", value).otherwise(bare)


def _number(seed: Column, i: Column) -> Column:
    """A number under 65536 for place ``i`` (from 0) of a keyed seed."""
    block = F.sha2(F.concat(seed, F.lit("/"), F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substring(block, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _swap(c: Column, n: Column) -> Column:
    """The replacement of one character for the number ``n``: same class, same case."""
    low = F.lower(c)
    pick = lambda s: F.substring(F.lit(s), n % len(s) + 1, F.lit(1))
    out = F.when(c.rlike(r"\p{N}"), (n % 10).cast("string"))
    for pattern, letters in LETTERS:
        out = out.when(low.rlike(pattern), pick(letters))
    out = out.when(c.rlike(r"\p{L}"), pick("aeiou"))
    return F.when(~c.rlike(r"[\p{L}\p{N}]"), c).otherwise(F.when((c != low), F.upper(out)).otherwise(out))


def _respell(value: Column, seed: Column) -> Column:
    """Each letter and digit swapped, counted over letters and digits only, so separators don't matter."""
    count = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
    numbered = F.transform(F.split(value, ""), lambda c, i: F.struct(c.alias("c"), _number(seed, count(i)).alias("n")))
    return F.array_join(F.transform(numbered, lambda x: _swap(x["c"], x["n"])), "")


def _more(value: Column, seed: Column, n: Column) -> Column:
    """``n`` keyed letters in the script of ``value``; no number of attempts can use up such surrogates."""
    drawn = F.substring(F.sha2(F.concat(seed, F.lit("+")), 256), F.lit(1), n)
    out = None
    for pattern, letters in GROWTH:
        test, spelled = value.rlike(pattern), F.translate(drawn, "0123456789abcdef", letters)
        out = F.when(test, spelled) if out is None else out.when(test, spelled)
    return out.otherwise(F.translate(drawn, "0123456789abcdef", "aeioubdfgklmnrst"))


def _luhn(value: Column) -> Column:
    """The Luhn sum of a number's digits, mod 10."""
    digits = F.reverse(F.regexp_replace(value, r"\D", ""))
    each = F.transform(F.split(digits, ""), lambda c, i: (lambda d: F.when(i % 2 == 0, d).otherwise(F.floor(d * 2 / 10).cast("int") + (d * 2) % 10))(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN's number (from the fifth place on, then country and check digits), letters from 10 up."""
    bare = F.regexp_replace(value, "[^A-Z0-9]", "")
    digits = F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), "")

    def step(a: Column, c: Column) -> Column:
        n = F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (a * F.when(n < 10, 10).otherwise(100) + n) % 97

    return F.aggregate(digits, F.lit(0), step)


def word_surrogate(word: Column, low: Column, attempt: Column, key: str) -> Column:
    """A name's word: a given name of the same gender and script, else a respelling that keeps the last letter.

    From the third attempt on (once the given names are through) it grows.
    """
    base = F.concat(F.lit(f"{key}|word|"), low, F.lit("|"))
    seed = F.concat(base, attempt.cast("string"))
    list_of = F.lit(None).cast("array<string>")
    for names in GIVEN:
        list_of = F.when(low.isin([x.lower() for x in names]), F.array(*[F.lit(x) for x in names])).otherwise(list_of)
    n = F.length(word)
    kept = F.when(n > 2, F.substring(word, -1, 1)).otherwise("")
    made = F.array(F.struct(word.alias("w"), seed.alias("s"), kept.alias("kept"), list_of.alias("names"), (_number(base, F.lit(0)) + attempt).alias("n"), attempt.alias("a")))
    # what a word has of its own first, then (in a second step) the letters that it grows by
    made = F.transform(made, lambda x: F.struct(x["w"].alias("w"), x["kept"].alias("kept"), F.when(x["names"].isNotNull(), F.get(x["names"], x["n"] % F.size(x["names"]))).otherwise(_respell(F.substring(x["w"], F.lit(1), F.length(x["w"]) - F.length(x["kept"])), x["s"])).alias("new"), x["names"].isNotNull().alias("given"), F.greatest(F.lit(0), F.floor((x["a"] - F.when(x["names"].isNotNull(), F.size(x["names"])).otherwise(2)) / 2).cast("int") + 1).alias("more"), x["s"].alias("s")))
    made = F.transform(made, lambda x: F.struct(x["w"].alias("w"), F.concat(x["new"], _more(x["w"], x["s"], x["more"]), F.when(x["given"], "").otherwise(x["kept"])).alias("new")))
    made = F.transform(made, lambda x: F.when((x["w"] == F.upper(x["w"])) & (F.length(x["w"]) > 1), F.upper(x["new"])).otherwise(x["new"]))
    return F.get(made, F.lit(0))


def parts_of(items: Column) -> Column:
    """``(v, kind, norm, title, words, gaps)`` of each ``(v, kind)``."""
    named = lambda x: x["kind"].isin("name", "words", "word")
    out = F.transform(items, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), normal(x["kind"], x["v"]).alias("norm"), F.when(x["kind"] == "name", _title(x["v"])).otherwise("").alias("title")))
    out = F.transform(out, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["norm"].alias("norm"), x["title"].alias("title"), F.when(named(x), F.substring(x["v"], F.length(x["title"]) + 1, F.length(x["v"]))).alias("rest")))
    return F.transform(out, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["norm"].alias("norm"), x["title"].alias("title"), F.split(x["rest"], "[ -]").alias("words"), F.regexp_extract_all(x["rest"], F.lit("[ -]"), F.lit(0)).alias("gaps")))


def decided(parts: Column, attempt, is_pair) -> Column:
    """``parts`` with the attempt of each value, and for each word of a name whether it changes and its attempt."""

    out = F.transform(parts, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["norm"].alias("norm"), x["title"].alias("title"), x["words"].alias("words"), x["gaps"].alias("gaps"), F.zip_with(F.transform(x["words"], lambda w: is_given(F.lower(w))), F.transform(pairs_of(x["words"]), is_pair), lambda g, p: F.coalesce(g & p.isNotNull(), F.lit(False)) | F.coalesce(p, F.lit(False))).alias("opens")))

    def word(x: Column, w: Column, i: Column) -> Column:
        hit = (x["kind"] != "words") | F.get(x["opens"], i) | ((i > 0) & F.get(x["opens"], F.greatest(i - 1, F.lit(0))))
        return F.struct(w.alias("w"), F.lower(w).alias("low"), hit.alias("hit"), attempt(F.lit("word"), F.lower(w)).alias("attempt"), F.coalesce(F.get(x["gaps"], i), F.lit("")).alias("gap"))

    return F.transform(out, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["norm"].alias("norm"), x["title"].alias("title"), attempt(x["kind"], x["norm"]).alias("attempt"), F.transform(x["words"], lambda w, i: word(x, w, i)).alias("words")))


def surrogates(items: Column, key: str) -> Column:
    """``(v, kind, new)`` of each decided item. From the third attempt on, the local part of an e-mail grows.

    Steps follow one another rather than being nested, which keeps the plan small.
    """
    seed = lambda x: F.concat(F.lit(f"{key}|"), x["kind"], F.lit("|"), x["norm"], F.lit("|"), x["attempt"].cast("string"))
    octet = lambda s, o, i: F.when((i == 0) & o.isin("10", "127", "172", "192"), o).otherwise((_number(s, i) % 223 + 1).cast("string"))

    def split(x: Column) -> Column:
        """What is respelled (``body``) with what seed, and what stays before and after it."""
        v, kind = x["v"], x["kind"]
        names = F.concat(x["title"], F.array_join(F.transform(x["words"], lambda w: F.concat(F.when(w["hit"], word_surrogate(w["w"], w["low"], w["attempt"], key)).otherwise(w["w"]), w["gap"])), ""))
        before = F.when(kind == "phone", F.regexp_extract(v, r"^(\+\d{1,3}(?=[ .(-])[ .-]?)", 1)).when(kind == "iban", F.substring(v, 1, 4)).otherwise("")
        body = F.when(kind == "email", F.substring_index(v, "@", 1)).otherwise(F.substring(v, F.length(before) + 1, F.length(v)))
        return F.struct(v.alias("v"), kind.alias("kind"), seed(x).alias("s"), x["attempt"].alias("a"), before.alias("before"), F.when(kind.isin("phone", "iban", "card", "ssn", "email"), body).alias("body"), F.when(kind == "email", F.substring_index(v, "@", -1)).alias("host"), names.alias("names"))

    def spell(x: Column) -> Column:
        kind, v = x["kind"], x["v"]
        body = F.when(x["body"].isNotNull(), _respell(x["body"], x["s"]))
        longer = F.when(x["a"] >= 2, _more(F.lit("a"), x["s"], F.floor(x["a"] / 2).cast("int"))).otherwise("")
        site, top = F.regexp_extract(x["host"], r"^(.*)\.([^.]+)$", 1), F.regexp_extract(x["host"], r"\.([^.]+)$", 1)
        host = F.concat(longer, F.lit("@"), _respell(site, F.concat(F.lit(f"{key}|host|"), F.lower(site))), F.lit("."), top)
        new = F.when(kind == "ip", F.array_join(F.transform(F.split(v, r"\."), lambda o, i: octet(x["s"], o, i)), ".")).when(kind == "date", moved(v, key)).when(body.isNotNull(), F.concat(x["before"], body, F.coalesce(F.when(kind == "email", host), F.lit("")))).otherwise(x["names"])
        return F.struct(v.alias("v"), kind.alias("kind"), new.alias("new"))

    def checked(x: Column) -> Column:
        p, v = x["new"], x["v"]
        last = ((F.substring(p, -1, 1).cast("int") + _luhn(v) - _luhn(p) + 20) % 10).cast("string")
        # check digits that give the number the remainder that it had
        zero = F.concat(F.substring(p, 1, 2), F.lit("00"), F.substring(p, F.lit(5), F.length(p)))
        digits = F.lpad(((_mod97(v) + 97 - _mod97(zero) + 96) % 97 + 1).cast("string"), 2, "0")
        iban = F.concat(F.substring(p, 1, 2), digits, F.substring(p, F.lit(5), F.length(p)))
        new = F.when(x["kind"] == "card", F.concat(F.substring(p, F.lit(1), F.length(p) - 1), last)).when(x["kind"] == "iban", iban).otherwise(p)
        return F.struct(v.alias("v"), x["kind"].alias("kind"), new.alias("new"))

    return F.transform(F.transform(F.transform(items, split), spell), checked)


def moved(value: Column, key: str) -> Column:
    """A date moved back by a keyed number of days (the same for all, so they stay apart), in the format it had."""
    days = F.conv(F.substring(F.sha2(F.lit(f"{key}|date"), 256), 1, 6), 16, 10).cast("int") % 1500 + 200
    split = r"^(\d+)([./-])(\d+)[./-](\d+)$"
    a, gap, b, c = (F.regexp_extract(value, split, k) for k in (1, 2, 3, 4))
    first = F.length(a) == 4
    y, x, z = F.when(first, a).otherwise(c), b, F.when(first, c).otherwise(a)
    pad = lambda v, like: F.when(F.length(like) > 1, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))

    def shift(month: Column, day: Column, swapped: bool) -> Column:
        d = F.try_to_timestamp(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
        d = F.date_sub(d, days)
        year, m, n = F.lpad(F.year(d).cast("string"), 4, "0"), pad(F.month(d), month), pad(F.dayofmonth(d), day)
        return F.when(first, F.concat(year, gap, m, gap, n)).otherwise(F.concat(m, gap, n, gap, year) if swapped else F.concat(n, gap, m, gap, year))

    # day first, else month first, else no date at all: digits by digits
    return F.coalesce(shift(x, z, False), shift(z, x, True), _respell(value, F.concat(F.lit(f"{key}|date|"), value)))


def found_in(docs: DataFrame, text: str) -> DataFrame:
    """``_key`` (md5 of the text), ``_found``: distinct values with their kinds, of each text that has any."""
    t = docs.where(F.col(text).rlike(HINT)).select(F.col(text).alias("_t"))
    values = F.array_distinct(by_any(F.col("_t"), lambda p: F.regexp_extract_all(F.col("_t"), F.lit(p), F.lit(0))))
    out = t.select(F.md5(F.col("_t").cast("binary")).alias("_key"), values.alias("_v")).where(F.size("_v") > 0)
    return out.select("_key", F.transform("_v", lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind"))).alias("_found"))


def named_words(kind: Column, value: Column) -> Column:
    """The words of a value that are a name's: all after a title; in a row of words, a known given name and the next."""
    marked = F.transform(words_of(value), lambda w: F.struct(w.alias("w"), is_given(F.lower(w)).alias("given")))
    led = let(marked, lambda a: F.filter(a, lambda x, i: ((i + 1 < F.size(a)) & x["given"]) | ((i > 0) & F.coalesce(F.get(a, i - 1)["given"], F.lit(False)))))
    return F.when(kind == "name", words_of(value)).otherwise(F.transform(led, lambda x: x["w"]))


def mentions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct entities ``(kind, norm, _v)``, ``_v`` one spelling; and ``(_k)``, pairs of words of full names after titles."""
    values = found.select(F.explode("_found").alias("x")).select("x.kind", F.col("x.v").alias("_v")).distinct()
    plain = values.where(~F.col("kind").isin("name", "words", "date"))
    words = values.where(F.col("kind").isin("name", "words")).select(F.lit("word").alias("kind"), F.explode(named_words(F.col("kind"), F.col("_v"))).alias("_v"))
    every = plain.unionByName(words)
    pairs = values.where("kind = 'name'").select(F.explode(pairs_of(words_of(F.col("_v")))).alias("_k")).distinct()
    return every.select("kind", normal(F.col("kind"), F.col("_v")).alias("norm"), "_v").groupBy("kind", "norm").agg(F.min("_v").alias("_v")), pairs


def settle(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, attempt``: the first attempt of each entity whose surrogate is no other's and no original.

    Each round keys the entities in conflict anew: of those that share a surrogate all but the first
    yield, and so does any whose surrogate is an entity of the corpus. Words and e-mails grow with their
    attempts, so there's always room for them; raises if conflicts of others last.
    """
    todo = entities.withColumn("attempt", F.lit(0))
    done = None
    originals = entities.select("kind", F.col("norm").alias("_s"), F.lit(True).alias("_real"))
    for _ in range(MAX_ROUNDS):
        one = decided(parts_of(F.array(F.struct(F.col("_v").alias("v"), "kind"))), lambda *_: F.col("attempt"), lambda _: F.lit(False))
        tried = cut(todo.withColumn("_s", F.get(F.transform(surrogates(one, key), lambda x: normal(x["kind"], x["new"])), F.lit(0))))
        first = tried.groupBy("kind", "_s").agg(F.min("norm").alias("_winner"))
        judged = tried.join(first, ["kind", "_s"]).join(originals, ["kind", "_s"], "left")
        if done is not None:
            judged = judged.join(done.select("kind", "_s", F.lit(True).alias("_taken")), ["kind", "_s"], "left")
        else:
            judged = judged.withColumn("_taken", F.lit(None).cast("boolean"))
        good = (F.col("norm") == F.col("_winner")) & F.col("_real").isNull() & F.col("_taken").isNull()
        judged = cut(judged.select("kind", "norm", "_v", "attempt", "_s", good.alias("_good")))
        won = judged.where("_good").select("kind", "norm", "attempt", "_s")
        done = won if done is None else cut(done.unionByName(won))
        todo = judged.where("not _good").select("kind", "norm", "_v", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done.select("kind", "norm", "attempt")
    raise RuntimeError("surrogates still collide")


def _entity(kind, norm) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("|"), norm)


def looked_up(found: DataFrame, again: DataFrame, pairs: DataFrame) -> DataFrame:
    """``_key, _known``: what a text must know of the corpus: attempts of its entities, and which word pairs are names."""
    kind, v = F.col("x.kind"), F.col("x.v")
    words = F.transform(words_of(v), lambda w: _entity("word", F.lower(w)))
    keys = F.when(kind.isin("name", "words"), F.concat(words, F.transform(pairs_of(words_of(v)), lambda p: _entity("pair", p)))).otherwise(F.array(_entity(kind, normal(kind, v))))
    asked = found.select("_key", F.explode("_found").alias("x")).select("_key", F.explode(keys).alias("_k")).distinct()
    known = again.select(_entity(F.col("kind"), F.col("norm")).alias("_k"), "attempt")
    known = cut(known.unionByName(pairs.select(_entity("pair", F.col("_k")).alias("_k"), F.lit(0).alias("attempt"))))
    met = asked.join(checked_broadcast(known), "_k")
    return met.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("_k", "attempt"))).alias("_known"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_pii``, ``pii_kinds`` (the kinds, in order of the text).

    ``key`` is a secret: equal keys give equal surrogates, from one run to the next as long as no collision
    differs. The same entity gets the same surrogate everywhere, different ones get different ones (checked
    over all rows; full names differ since their words do). Null texts stay null with 0 entities, empty ones
    stay empty; texts are read whole, however long; repeated rows get equal results; an empty table gives an
    empty one; earlier columns with these names are replaced. Replacement happens inside the row. Entities that
    needed another attempt, and names known from titles elsewhere, are looked up by the texts that hold them;
    the list of such texts is broadcast only after its size is checked.
    """
    found = cut(found_in(docs, text))
    entities, pairs = mentions(found)
    again = cut(settle(cut(entities), key).where("attempt > 0"))
    held = cut(looked_up(found, again, pairs))
    base = boxed(docs, _text=text).withColumn("_of", F.md5(F.col("_text").cast("binary")))
    out = base.join(checked_broadcast(held), F.col("_of") == F.col("_key"), "left")
    hinted = F.coalesce(F.col("_text").rlike(HINT), F.lit(False))
    # one pass of the pattern: matches are fenced off, the pieces between fences are in turn text and match
    fence = f"\ufdd0{hash_of(key):x}\ufdd1"
    out = out.withColumn("_pieces", F.when(hinted, F.split(by_any(F.col("_text"), lambda p: F.regexp_replace("_text", p, f"{fence}$0{fence}")), fence)))
    attempt = lambda kind, norm: F.coalesce(F.try_element_at("_known", _entity(kind, norm)), F.lit(0))
    is_pair = lambda p: F.coalesce(F.map_contains_key("_known", _entity("pair", p)), F.lit(False))
    odd = lambda r: F.filter("_pieces", lambda p, i: i % 2 == r)
    values = F.transform(odd(1), lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))
    out = out.withColumn("_new", surrogates(decided(parts_of(values), attempt, is_pair), key))
    whole = F.array_join(F.zip_with(odd(0), "_new", lambda p, x: F.concat(p, F.coalesce(x["new"], F.lit("")))), "")
    hits = F.filter("_new", lambda x: (x["kind"] != "words") | (x["new"] != x["v"]))
    return out.select(
        *unboxed(without(docs.columns, "n_pii", "pii_kinds"), **{text: F.when(F.size("_new") > 0, whole).otherwise(F.col("_text"))}),
        F.coalesce(F.when(F.col("_new").isNotNull(), F.size(hits)), F.lit(0)).cast("long").alias("n_pii"),
        F.coalesce(F.array_join(F.transform(hits, lambda x: F.when(x["kind"] == "words", "name").otherwise(x["kind"])), ","), F.lit("")).alias("pii_kinds"),
    )


def hash_of(key: str) -> int:
    """A number that marks the fences of one key; nobody without the key can write them into a text."""
    import hashlib

    return int(hashlib.sha256(f"{key}|fence".encode()).hexdigest()[:12], 16)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
