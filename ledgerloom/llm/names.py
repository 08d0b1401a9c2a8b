"""Comparable forms of brand, model and place names, shared by the two name operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import arabic_sound, number_word, words

#: Words that say what kind of thing a name is, not which one.
BRAND_FILLERS = ("motors", "motor", "co", "company", "corp", "auto", "autos", "automobile", "automobiles", "automotive", "cars", "car", "group")
PLACE_FILLERS = ("governorate", "gov", "of", "capital", "office", "north", "south", "east", "west", "city", "province", "محافظه", "مدينه")
#: Words that make a further model of a name.
TRIMS = ("plus", "sport", "cross", "van", "max", "gt", "lite", "pro", "turbo", "sedan", "coupe", "classic")

#: Roman numbers one to ten.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def brand_key(x: Column) -> Column:
    """The name without fillers and spaces; fillers stay where nothing else is left."""
    all_words = words(x)
    return _joined(F.filter(all_words, lambda w: ~w.isin(*BRAND_FILLERS)))


def place_key(x: Column) -> Column:
    return _joined(F.filter(words(x), lambda w: ~w.isin(*PLACE_FILLERS)))


def sound_key(key: Column) -> Column:
    """The Arabic writing of a Latin key; null where the key has no Latin letter."""
    return F.when(key.rlike("[a-z]"), arabic_sound(key))


def _roman(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, w in enumerate(ROMAN, 1) for x in (w, str(i))])
    return F.coalesce(F.try_element_at(table, word), word)


def _near_number_word(word: Column) -> Column:
    """The digit of a long spoken number that the word nearly is: one edit, or its letters in another order."""
    out = word
    for name, digit in (("three", "3"), ("seven", "7"), ("eight", "8")):
        swapped = (F.length(word) == 5) & (F.array_join(F.array_sort(F.split(word, "")), "") == "".join(sorted(name)))
        out = F.when(F.levenshtein(word, F.lit(name), 1).between(0, 1) | swapped, F.lit(digit)).otherwise(out)
    return out


def numbers_of(joined: Column) -> Column:
    """The numbers of a joined name, in order, as one text."""
    return F.array_join(F.regexp_extract_all(joined, F.lit(r"(\d+)"), 1), " ")


def letters_of(joined: Column) -> Column:
    return F.regexp_replace(joined, r"\d+", "")


BRAND_KEYS = "array<struct<n:int,k:string>>"


def brand_keys(keys: Column) -> Column:
    """The keys of a brand that may stand before its models' names, the longest first, with their lengths; one-letter ones are left out."""
    return F.reverse(F.array_sort(F.transform(F.filter(keys, lambda k: F.length(k) >= 2), lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))))


def with_model_parts(df: DataFrame, value: str, keys: str) -> DataFrame:
    """Adds, with the column ``brand_keys`` made by the function of that name, ``_worded`` (the words without numbers), ``joined`` (all words but leading brand names and model-year marks), ``numbers`` and ``key`` (its letters).

    Spoken numbers, and Roman ones at the end, become digits. Leading names of the brand go, up to three
    of them, the longest first; '' is left where there is nothing else. Each step is a column of its
    own, so that none is worked out twice.
    """
    step = df.withColumn("_text", F.concat(F.lit(" "), F.array_join(words(F.col(value)), " "), F.lit(" ")))
    step = step.withColumn("_text", F.regexp_replace("_text", r"(?<=[ \d])my ?(20)?\d\d(?= )", " "))
    # a mark run together with the name before it
    step = step.withColumn("_text", F.regexp_replace("_text", r"(?<=\p{L}{3})my(20)?[12]\d(?= )", " "))
    step = step.withColumn("_tokens", F.filter(F.split("_text", " "), lambda w: w != ""))
    step = step.withColumn("_n", F.size("_tokens"))
    step = step.withColumn("_tokens", F.transform("_tokens", lambda w, i: F.when((i > 0) & (i == F.col("_n") - 1), _roman(_near_number_word(number_word(w)))).otherwise(number_word(w))))
    step = step.withColumn("_worded", F.transform(F.filter("_tokens", lambda w: w.rlike(r"\D")), lambda w: F.regexp_replace(w, r"\d+", "")))
    step = step.withColumn("_bk", F.coalesce(keys, F.array().cast(BRAND_KEYS)))
    # a leading word that nearly is the brand's name, before other words
    first = F.coalesce(F.try_element_at("_tokens", F.lit(1)), F.lit(""))
    nearly = (F.col("_n") > 1) & F.exists("_bk", lambda b: (b["n"] >= 5) & (F.levenshtein(first, b["k"], 2).between(0, 2)))
    step = step.withColumn("joined", _joined(F.when(nearly, F.slice("_tokens", F.lit(2), F.greatest(F.col("_n"), F.lit(1)))).otherwise(F.col("_tokens"))))
    step = step.withColumn(
        "joined", F.aggregate(F.flatten(F.array_repeat("_bk", 3)), F.col("joined"), lambda acc, b: F.when(acc.startswith(b["k"]), F.substring(acc, b["n"] + 1, F.length(acc))).otherwise(acc))
    )
    return step.withColumn("numbers", numbers_of(F.col("joined"))).withColumn("key", letters_of(F.col("joined"))).drop("_text", "_tokens", "_n", "_bk")


def with_trim(df: DataFrame) -> DataFrame:
    """Adds ``trim``: the trim word a name of several words ends with, '' if none."""
    last = F.coalesce(F.try_element_at("_worded", F.lit(-1)), F.lit(""))
    return df.withColumn("_last", last).withColumn("trim", F.when((F.size("_worded") > 1) & F.col("_last").isin(*TRIMS), F.col("_last")).otherwise(F.lit(""))).drop("_last")


def with_typed_trims(df: DataFrame) -> DataFrame:
    """Adds ``trims``: the trim words a typed name may end with.

    A name of several words has the trim its last word is or nearly is (one edit, or its letters
    in another order), else ''. A last word of four letters or more that only nearly is a trim may be a name's own: that is
    marked by '~'. A name run together to one word may have none as well as any it nearly ends with.
    """
    step = df.withColumn("_last", F.coalesce(F.try_element_at("_worded", F.lit(-1)), F.lit(""))).withColumn("_one", F.size("_worded") <= 1)
    step = step.withColumn("_sorted", F.array_join(F.array_sort(F.split("_last", "")), ""))

    # one expression that goes over the table of trims, as twelve of them in a row make code too long to be compiled
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(len(t)).alias("n"), F.lit("".join(sorted(t))).alias("s")) for t in TRIMS])

    def hit(t: Column) -> Column:
        near = lambda word: F.levenshtein(word, t["t"], 1).between(0, 1)
        key = F.col("key")
        ending = near(F.right(key, t["n"])) | near(F.right(key, t["n"] + 1)) | ((t["n"] > 2) & near(F.right(key, t["n"] - 1)))
        # most last words are too long or too short to be near at all
        whole = F.length("_last").between(F.greatest(F.lit(1), t["n"] - 1), t["n"] + 1) & (near(F.col("_last")) | (F.col("_sorted") == t["s"]))
        return F.when(F.col("_one"), ending).otherwise(whole)

    step = step.withColumn("_found", F.transform(F.filter(table, hit), lambda t: t["t"]))
    doubtful = (F.length("_last") >= 4) & ~F.col("_last").isin(*TRIMS)
    several = F.when(doubtful, F.concat("_found", F.array(F.lit("~")))).otherwise(F.col("_found"))
    return step.withColumn("trims", F.when(F.col("_one") | (F.size("_found") == 0), F.concat(F.array(F.lit("")), "_found")).otherwise(several)).drop("_last", "_one", "_sorted", "_found")
