"""List and page number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals, number words, alphabets and signs.
ROMAN = [("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)]
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
LATIN = "abcdefghijklmnopqrstuvwxyz"
RUSSIAN = "абвгдежзиклмнопрстуфхцчшщэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CHICAGO = ["*", "†", "‡", "§"]


def roman(n: Column) -> Column:
    """Upper-case Roman numeral; decimal outside 1 to 3999."""
    text, left = F.lit(""), n
    pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(v).cast("long").alias("v")) for s, v in ROMAN])
    start = F.struct(text.alias("t"), left.cast("long").alias("n"))
    folded = F.aggregate(pairs, start, lambda acc, p: F.struct(F.concat(acc["t"], F.repeat(p["s"], F.floor(acc["n"] / p["v"]).cast("int"))).alias("t"), (acc["n"] % p["v"]).alias("n")), lambda acc: acc["t"])
    return F.when(n.between(1, 3999), folded).otherwise(n.cast("string"))


def letters(n: Column, alphabet: str = LATIN) -> Column:
    """The n-th letter, repeated once more on every round: z, aa, bb."""
    k = len(alphabet)
    at = ((n - 1) % k + 1).cast("int")
    return F.when(n >= 1, F.repeat(F.substring(F.lit(alphabet), at, F.lit(1)), (F.floor((n - 1) / k) + 1).cast("int"))).otherwise(n.cast("string"))


def bijective(n: Column, alphabet: str = GREEK) -> Column:
    """Alphabetic counting without a zero: the last letter, then aa, ab."""
    k = len(alphabet)
    start = F.struct(F.lit("").alias("t"), n.cast("long").alias("n"))

    def step(acc: Column, _: Column) -> Column:
        at = ((acc["n"] - 1) % k + 1).cast("int")
        more = acc["n"] > 0
        return F.struct(F.when(more, F.concat(F.substring(F.lit(alphabet), at, F.lit(1)), acc["t"])).otherwise(acc["t"]).alias("t"), F.when(more, F.floor((acc["n"] - 1) / k)).otherwise(F.lit(0)).cast("long").alias("n"))

    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["t"])).otherwise(n.cast("string"))


def ordinal(n: Column) -> Column:
    ten, hundred = n % 10, n % 100
    end = F.when(hundred.between(11, 13), "th").when(ten == 1, "st").when(ten == 2, "nd").when(ten == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def _below_hundred(n: Column) -> Column:
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    two = F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.when(n % 10 > 0, F.concat(F.lit("-"), F.get(ones, (n % 10).cast("int")))).otherwise(""))
    return F.when(n < 20, F.get(ones, n.cast("int"))).otherwise(two)


def _below_thousand(n: Column) -> Column:
    rest = n % 100
    high = F.concat(_below_hundred(F.floor(n / 100)), F.lit(" hundred"), F.when(rest > 0, F.concat(F.lit(" "), _below_hundred(rest))).otherwise(""))
    return F.when(n < 100, _below_hundred(n)).otherwise(high)


def cardinal_words(n: Column) -> Column:
    """Lower-case English words of 0 to 999999; decimal elsewhere."""
    rest = n % 1000
    high = F.concat(_below_thousand(F.floor(n / 1000)), F.lit(" thousand"), F.when(rest > 0, F.concat(F.lit(" "), _below_thousand(rest))).otherwise(""))
    return F.when(n.between(0, 999), _below_thousand(n)).when(n.between(1000, 999_999), high).otherwise(n.cast("string"))


def ucfirst(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def ordinal_words(n: Column) -> Column:
    words = cardinal_words(n)
    last = F.regexp_extract(words, r"([a-z]+)\z", 1)
    head = F.substring(words, F.lit(1), F.length(words) - F.length(last))
    table = F.create_map(*[F.lit(x) for p in IRREGULAR.items() for x in p])
    new = F.coalesce(F.try_element_at(table, last), F.when(last.endswith("y"), F.concat(F.regexp_replace(last, r"y\z", "ie"), F.lit("th"))).otherwise(F.concat(last, F.lit("th"))))
    return F.when(n.between(0, 999_999), F.concat(head, new)).otherwise(n.cast("string"))


def decimal_zero(n: Column) -> Column:
    return F.when(n.between(0, 9), F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def chicago(n: Column) -> Column:
    return F.when(n >= 1, F.repeat(F.get(F.array(*map(F.lit, CHICAGO)), ((n - 1) % 4).cast("int")), (F.floor((n - 1) / 4) + 1).cast("int"))).otherwise(n.cast("string"))


def enclosed(n: Column, first: str) -> Column:
    """1 to 20 as one of the enclosed signs that begin at `first`; decimal elsewhere."""
    signs = F.array(*[F.lit(chr(ord(first) + i)) for i in range(20)])
    return F.when(n.between(1, 20), F.get(signs, (n - 1).cast("int"))).otherwise(n.cast("string"))


def full_width(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", "".join(chr(0xFF10 + i) for i in range(10)))


def formatted(n: Column, kind: Column) -> Column:
    """n in the word-processor format named by `kind`; decimal for unknown names, empty for none and bullet."""
    out = F.when(kind == "upperRoman", roman(n)).when(kind == "lowerRoman", F.lower(roman(n)))
    out = out.when(kind == "upperLetter", F.upper(letters(n))).when(kind == "lowerLetter", letters(n))
    out = out.when(kind == "russianLower", letters(n, RUSSIAN)).when(kind == "russianUpper", F.upper(letters(n, RUSSIAN)))
    out = out.when(kind == "ordinal", ordinal(n)).when(kind == "cardinalText", ucfirst(cardinal_words(n))).when(kind == "ordinalText", ucfirst(ordinal_words(n)))
    out = out.when(kind == "hex", F.hex(n)).when(kind == "decimalZero", decimal_zero(n)).when(kind.isin("none", "bullet"), F.lit(""))
    out = out.when(kind == "chicago", chicago(n)).when(kind == "decimalEnclosedCircle", enclosed(n, "①")).when(kind == "decimalEnclosedParen", enclosed(n, "⑴")).when(kind == "decimalEnclosedFullstop", enclosed(n, "⒈"))
    return out.when(kind == "decimalFullWidth", full_width(n)).otherwise(n.cast("string"))
