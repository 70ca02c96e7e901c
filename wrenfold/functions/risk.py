"""Risk score and sector, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import nfkc, without_marks
from .vocab import ENTROPY_HIGH, ENTROPY_LENGTH, ENTROPY_LETTERS, KEYBOARD_ROWS, NO_SECTOR, PHRASES, RISKY_TLDS, SECTORS, SPAM_TRAPS, TEXT_LIMIT, TOKEN_LIMIT


def classify_text(c: Column) -> Column:
    """RSK1: first 300 characters, no diacritics, small letters and digits, single spaces."""
    v = F.substring(F.coalesce(c, F.lit("")), 1, TEXT_LIMIT)
    other = v.rlike(r"[^\x00-\x7F]")
    v = without_marks(F.when(other, nfkc(F.when(other, v))).otherwise(v))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(v), "[^a-z0-9 ]", " "), " {2,}", " "))


def tokens(c: Column) -> Column:
    """RSK2: at most 60; none of an empty text."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(c, " "), 1, TOKEN_LIMIT))


def tld(domain: Column) -> Column:
    """RSK3."""
    return F.when(F.contains(domain, F.lit(".")), F.lower(F.substring_index(domain, ".", -1)))


def domain_threats(domain: Column) -> tuple[Column, Column]:
    """RSK4: tags and points."""
    d = F.trim(F.lower(domain))
    trap, risky = F.coalesce(d.isin(*SPAM_TRAPS), F.lit(False)), F.coalesce(tld(d).isin(*RISKY_TLDS), F.lit(False))
    tags = F.array_compact(F.array(F.when(trap, "SPAM_TRAP_MATCH"), F.when(risky, "HIGH_RISK_TLD")))
    return tags, F.when(trap, 60).otherwise(0) + F.when(risky, 20).otherwise(0)


def entropy(c: Column) -> Column:
    """RSK5: bits a character."""
    return F.when(F.length(c) > 0, _entropy_of(F.split(c, ""))).otherwise(0.0)


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


_GRAMS = "|".join(sorted({r[i : i + 4] for row in KEYBOARD_ROWS for r in (row, row[::-1]) for i in range(len(row) - 3)}))
# Points and tags of the signals, in order.
POINTS = {
    "trap": (60, "SPAM_TRAP_MATCH"), "tld": (20, "HIGH_RISK_TLD"), "disposable": (25, "DISPOSABLE_SIGNAL"), "role": (5, "ROLE_BASED_SIGNAL"), "catch_all": (10, "CATCH_ALL_SIGNAL"),
    "voip": (15, "VOIP_PHONE_SIGNAL"), "dummy": (20, "DUMMY_PHONE_SIGNAL"), "bot": (30, "BOT_GENERATED_PATTERN"),
}


def keyboard_mash(c: Column) -> Column:
    """RSK6: four neighbours of a keyboard row in turn, either way."""
    return F.coalesce(_letters(c).rlike(_GRAMS), F.lit(False))


def _entropy_of(letters: Column) -> Column:
    """Bits a character, of the array of a text's characters."""
    n = F.size(letters).cast("double")
    share = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def with_bot(df: DataFrame, text: Column, name: str) -> DataFrame:
    """RSK7: whether a text looks typed at random, in steps that use each other's columns."""
    df = df.withColumn("_v", F.trim(text)).withColumn("_a", _letters(F.col("_v"))).withColumn("_cs", F.split("_a", ""))
    busy = (F.col("_a") != "") & (_entropy_of(F.col("_cs")) >= ENTROPY_HIGH) & (F.size(F.array_distinct("_cs")) >= ENTROPY_LETTERS)
    mash = F.col("_a").rlike(_GRAMS)
    return df.withColumn(name, F.coalesce(mash | (F.length("_v") >= ENTROPY_LENGTH) & busy, F.lit(False))).drop("_v", "_a", "_cs")


def _hits(items: Column, words) -> Column:
    return F.size(F.filter(items, lambda x: x.isin(*words)))


def sector_of(t: Column, phrases: Column) -> Column:
    """RSK8 of tokens and the phrases among them: struct of sector and confidence; on a tie the first sector."""
    scores = []
    for order, (name, words) in enumerate(SECTORS.items()):
        score = _hits(t, words.split())
        if name in PHRASES:
            score = score + 2 * _hits(phrases, PHRASES[name])
        scores.append(F.struct(score.alias("score"), F.lit(-order).alias("first"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scores))


def with_sector(df: DataFrame, company: Column, domain: Column, name: str = "sector", confidence: str = "confidence") -> DataFrame:
    """RSK8: sector and confidence. No shuffle: scores are counted within the row, in steps that use each other's columns."""
    first = F.substring_index(domain, ".", 1)
    df = df.withColumn("_text", F.concat_ws(" ", F.when(company != "", company), F.when(first != "", first)))
    df = df.withColumn("_text", classify_text(F.col("_text"))).withColumn("_t", tokens(F.col("_text")))
    join = lambda x, y: F.concat(x, F.lit(" "), y)
    df = df.withColumn("_two", F.zip_with("_t", F.slice("_t", 2, TOKEN_LIMIT), join))
    df = df.withColumn("_two", F.concat("_two", F.zip_with("_two", F.slice("_t", 3, TOKEN_LIMIT), join))).withColumn("_best", sector_of(F.col("_t"), F.col("_two")))
    some = F.col("_best.score") > 0
    out = {name: F.when(some, F.col("_best.name")).otherwise(NO_SECTOR), confidence: F.when(some, F.least(F.lit(100), F.col("_best.score") * 25)).otherwise(0).cast("int")}
    return df.withColumns(out).drop("_text", "_t", "_two", "_best")


def with_risk(df: DataFrame, domain: Column, flags: dict[str, Column], name: Column, company: Column) -> DataFrame:
    """RSK9: risk_score, 0 to 100, and risk_tags in their order. flags: by name, of those in POINTS."""
    df = df.withColumns({"_d": F.trim(F.lower(domain)), "_n": name, "_c": company})
    df = with_bot(with_bot(df, F.col("_n"), "_bot_n"), F.col("_c"), "_bot_c")
    found = {"trap": F.col("_d").isin(*SPAM_TRAPS), "tld": tld(F.col("_d")).isin(*RISKY_TLDS), **flags, "bot": F.col("_bot_n") | F.col("_bot_c")}
    df = df.withColumns({f"_is_{k}": F.coalesce(c, F.lit(False)) for k, c in found.items()})
    known = [(F.col(f"_is_{k}"), n, tag) for k, (n, tag) in POINTS.items() if k in found]
    score = F.least(F.lit(100), reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n, _ in known))).cast("int")
    tags = F.array_compact(F.array(*(F.when(c, F.lit(tag)) for c, _, tag in known)))
    return df.withColumns({"risk_score": score, "risk_tags": tags}).drop("_d", "_n", "_c", "_bot_n", "_bot_c", *(f"_is_{k}" for k in found))
