"""Full-text search of English texts: stems, stop words, phrases, and an index of tokens with weights."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.operators.relational import contains
from quillspark.shared import materialize

# fixed values: words that are not searched for; and of the published English stemmer: words with stems of their own,
# words that keep their form, beginnings behind which the first region starts, and endings with what stands for them
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now".split()
)
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = "sky news howe atlas cosmos bias andes".split()
KEPT_LATER = "inning outing canning herring earring proceed exceed succeed".split()
BEGINNINGS = ("gener", "commun", "arsen")
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_VOWELS = "aeiouy"


def _region(word: str, start: int) -> int:
    """Where the part behind the first consonant that follows a vowel begins."""
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


@lru_cache(maxsize=100_000)
def english_stem(word: str) -> str:
    """The stem of a lower-case English word, by the published rules of the second Porter stemmer."""
    if len(word) < 3 or word in KEPT:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word.removeprefix("'"))
    one = next((len(b) for b in BEGINNINGS if w.startswith(b)), None) or _region(w, 0)
    two = _region(w, one)
    w = w[: len(w) - len(_ending(w, ("'", "'s", "'s'")))]
    # plurals
    end = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT_LATER:
        return w
    # past and progressive forms
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    head = w[: len(w) - len(end)]
    if end in ("eed", "eedly"):
        w = head + "ee" if len(head) >= one else w
    elif end and re.search("[aeiouy]", head):
        w = head
        if w.endswith(("at", "bl", "iz")) or (not re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w) and len(w) <= one and _short_end(w)):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # endings of nouns and adjectives, the longest first, if they stand in their region
    end = _ending(w, (*SECOND, "ogi", "li"))
    head = w[: len(w) - len(end)]
    if end and len(head) >= one:
        if end in SECOND:
            w = head + SECOND[end]
        elif (end == "ogi" and head.endswith("l")) or (end == "li" and head[-1:] in tuple("cdeghkmnrt")):
            w = head + ("og" if end == "ogi" else "")
    end = _ending(w, (*THIRD, "ative"))
    head = w[: len(w) - len(end)]
    if end and len(head) >= (two if end == "ative" else one):
        w = head + THIRD.get(end, "")
    end = _ending(w, (*FOURTH, "ion"))
    head = w[: len(w) - len(end)]
    if end and len(head) >= two and (end != "ion" or head.endswith(("s", "t"))):
        w = head
    if w.endswith("e") and (len(w) > two or (len(w) > one and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > two:
        w = w[:-1]
    return w.lower()


def _places(text: str | None) -> list[str | None]:
    return [None if t in STOP_WORDS else english_stem(t) for t in re.findall(r"\w+", (text or "").lower())]


@F.pandas_udf(ArrayType(StringType()))
def stemmed(text: pd.Series) -> pd.Series:
    """The stems of a text in order; null stands in the places of stop words. A null text has none."""
    return text.map(_places)


def search_terms(query: str) -> list[list[tuple[bool, list[str | None]]]]:
    """What a search asks for: alternatives (parted by `or`) of terms (wanted, stems in order), of which each must occur;
    `-` before a word or a quoted phrase means that it must not. Terms of stop words alone fall away."""
    ways = []
    for part in re.split(r"\s+or\s+", query, flags=re.I):
        terms = [(sign != "-", _places(phrase or word)) for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\w+))', part)]
        terms = [(wanted, stems) for wanted, stems in terms if any(stems)]
        if terms:
            ways.append(terms)
    return ways


def _holds(places: Column, stems: list[str | None]) -> Column:
    """Whether the stems stand one after the other; a stop word in a phrase is any word."""
    while stems[0] is None:
        stems = stems[1:]
    while stems[-1] is None:
        stems = stems[:-1]
    if len(stems) == 1:
        return F.array_contains(places, stems[0])
    here = lambda x, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(places, i + k) == s, F.lit(False)) for k, s in enumerate(stems) if s is not None])
    return F.array_contains(F.transform(places, here), True)


def full_text(df: DataFrame, columns: list[str], query: str, plain: list[str] | None = None) -> DataFrame:
    """Rows that a search finds: by the stems of all columns, as if they were one text, or by the query as it stands in a
    `plain` column (the first one, if none is named), whatever its case. A blank query finds all rows."""
    if not query.strip():
        return df
    places = F.concat(*(stemmed(F.col(c)) for c in columns))
    rows = df.withColumn("_places", places)
    at = F.col("_places")
    term = lambda wanted, stems: F.coalesce(_holds(at, stems), F.lit(False)) if wanted else ~F.coalesce(_holds(at, stems), F.lit(False))
    ways = [reduce(lambda a, b: a & b, [term(*t) for t in way]) for way in search_terms(query)]
    ways += [F.coalesce(contains(c, query.strip()), F.lit(False)) for c in (plain if plain is not None else columns[:1])]
    return rows.where(reduce(lambda a, b: a | b, ways)).drop("_places") if ways else rows.limit(0).drop("_places")


def token_index(df: DataFrame, key: str, weights: dict[str, str]) -> DataFrame:
    """(stem, key, place, weight): an inverted index; weights name the weight of each column, whose places follow each
    other in the order given. Written by stem, a search reads the stems that it asks for."""
    rows = df.select(key, *(stemmed(F.col(c)).alias(f"_{k}") for k, c in enumerate(weights)))
    weighted = lambda k, w: F.transform(f"_{k}", lambda s: F.struct(s.alias("stem"), F.lit(w).alias("weight")))
    whole = F.concat(*(weighted(k, w) for k, w in enumerate(weights.values())))
    return rows.select(key, F.posexplode(whole).alias("place", "x")).select("x.stem", key, "place", "x.weight").where("stem is not null")


def indexed(index: DataFrame, key: str, query: str) -> DataFrame:
    """(key, hits, heavy): the keys that a search finds in a token index, with the places of its terms and how many of them
    have the weight A. Only the lists of the stems asked for are read, all of them at once, however the index is made; an
    alternative needs a term that is wanted."""
    ways = search_terms(query)
    asked = sorted({s for way in ways for _, stems in way for s in stems if s is not None})
    index = materialize(index.where(F.col("stem").isin(*asked)), "lists") if asked else index

    def found(stems: list[str | None]) -> DataFrame:
        first, *more = [(k, s) for k, s in enumerate(stems) if s is not None]
        hits = index.where(F.col("stem") == first[1]).select(key, (F.col("place") - first[0]).alias("at"), "weight")
        for k, s in more:
            hits = hits.join(index.where(F.col("stem") == s).select(key, (F.col("place") - k).alias("at")), [key, "at"], "left_semi")
        return hits.groupBy(key).agg(F.count("*").alias("hits"), F.count_if(F.col("weight") == "A").alias("heavy"))

    out = None
    for way in ways:
        wanted = [stems for yes, stems in way if yes]
        if not wanted:
            raise ValueError("a search needs a word that must occur")
        rows = reduce(lambda a, b: a.unionByName(b), [found(s).withColumn("term", F.lit(k)) for k, s in enumerate(wanted)])
        rows = rows.groupBy(key).agg(F.sum("hits").alias("hits"), F.sum("heavy").alias("heavy"), F.count("*").alias("terms")).where(F.col("terms") == len(wanted)).drop("terms")
        for stems in (s for yes, s in way if not yes):
            rows = rows.join(found(stems).select(key), key, "left_anti")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return index.limit(0).groupBy(key).agg(F.count("*").alias("hits"), F.count("*").alias("heavy"))
    return out.groupBy(key).agg(F.max("hits").alias("hits"), F.max("heavy").alias("heavy"))
