"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Words are indexed under all their q-grams by place and length. One edit can't touch two grams that don't overlap, so a word
asks under two such grams, its rarest, for words as long (at the same place) or one longer (there, or one place on). Where
they meet, the words are indexed by their character pairs. One edit leaves max(lengths) - 3 pairs of a word, so of the
postings, cut to length and places, only the shortest few are merged by a heap: a word that is in none of them is under that
bound whatever the others hold. The rest is compared.
"""

from __future__ import annotations

import heapq
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, shuffle_partitions, table

#: Least length of words that are compared.
SHORTEST = 5
#: Least length of a word, least number of its occurrences, and how many times as frequent its form is.
LEAST_LENGTH, LEAST_COUNT, MORE = 7, 2, 10
#: Words that are indexed together; those of a more crowded gram are dealt to several indexes.
CROWD = 2000
#: Grams whose numbers are known where words choose under which to ask.
COMMON = 50_000

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, slips: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH letters or more that occur LEAST_COUNT times or more.

    A word is a run of Latin letters with A-Z in lower case. Where `slips` divides the hash of id and run, one letter of
    it is left out, which stands for a slip of the pen. Null and empty texts have no words, a null id counts as empty.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select(F.translate("run", _CAPITALS, _SMALL).alias("run"), "id")
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % slips == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def one_edit(a: str, b: str) -> bool:
    """Whether a and b, no longer than it by more than one, differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905 - b may be longer
    return a[k + len(a) + 1 - len(b) :] == b[k + 1 :]


def gram_length(size: int) -> int:
    """The length of the grams by which a word of this size asks: two fit side by side, with a place to spare."""
    return (size - 1) // 2


class Index:
    """Words of one length, with the postings of their character pairs by place: the numbers of the words, in order."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, len(words[0])
        self.postings: list[dict[str, list[int]]] = [{} for _ in range(self.size)]  # nothing stands at the last place
        for k, w in enumerate(words):
            for at in range(self.size - 1):
                self.postings[at].setdefault(w[at : at + 2], []).append(k)

    def near(self, word: str) -> list[str]:
        """The words one edit from `word`, which is as long or one shorter.

        Near words share size - 3 pairs, each at its place or, in a longer word, one place on. A word that is in so many
        lists is in one of the rarest few, those beyond size - 4 others: these are merged, and what they hold is compared.
        """
        shift, lists = self.size - len(word), []
        for at in range(len(word) - 1):
            pair = word[at : at + 2]
            here, on = self.postings[at].get(pair, _NONE), self.postings[at + 1].get(pair, _NONE) if shift else _NONE
            lists.append((len(here) + len(on), here, on))
        lists.sort(key=itemgetter(0))
        merged = heapq.merge(*(x for _, *both in lists[: len(lists) - (self.size - 4)] for x in both if x))
        return [self.words[k] for k, _ in groupby(merged) if one_edit(word, self.words[k])]


_NONE: list[int] = []


def _meet(parts):
    """Pairs (word, near) of each group of rows; groups are sorted together, with the words to be indexed first."""
    here, index, words = None, None, []
    for pdf in parts:
        found = []
        for *key, asks, word in zip(*(pdf[c].tolist() for c in ("key", "size", "place", "q", "asks", "word")), strict=True):
            if key != here:
                here, index, words = key, None, []
            if not asks:
                words.append(word)
            elif words and words != [word]:
                index = index or Index(words)
                found += [(word, b) for b in index.near(word) if key[1] > len(word) or word < b]
        yield pd.DataFrame(found, columns=["a", "b"], dtype=str)


def _rarest(common: dict[str, int]):
    """For each word the places of its two rarest grams that don't overlap."""

    def choose(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            q = gram_length(len(w))
            often = [common.get(w[k : k + q], 0) for k in range(len(w) - q + 1)]
            best, first = None, 0  # first: the rarest gram that ends before the second begins
            for second in range(q, len(often)):
                first = min(first, second - q, key=often.__getitem__)
                total = often[first] + often[second]
                if best is None or total < best[0]:
                    best = total, first, second
            out.append(list(best[1:]))
        return pd.Series(out)

    return F.pandas_udf(choose, "array<int>")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs (a, b) of words that are one edit apart, a the shorter one or the smaller of two as long.

    words: distinct words of SHORTEST letters or more.
    """
    spark, size = words.sparkSession, F.length("word")
    if not words.where(size < SHORTEST).isEmpty():
        raise ValueError(f"words of fewer than {SHORTEST} letters have no two grams side by side")
    # a word is found by those of its length and by those one shorter, whose grams may be a letter shorter
    lengths = F.array_distinct(F.transform(F.array(size, F.greatest(F.lit(SHORTEST), size - 1)), lambda m: F.floor((m - 1) / 2).cast("int")))
    index = words.select("word", size.alias("size"), F.explode(lengths).alias("q"))
    index = index.select("word", "size", "q", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("q"))).alias("place")).withColumn("gram", F.substring(F.col("word"), F.col("place") + 1, F.col("q"))).withColumn("asks", F.lit(False))
    # how common grams are only decides where words ask; which ones are known is bounded, and every choice is right
    common = {r.gram: r["count"] for r in index.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(COMMON).collect()}
    # a word asks at its place among words as long, and there and one place on among longer ones
    asking = words.select("word", size.alias("m"), F.floor((size - 1) / 2).cast("int").alias("q"), F.explode(_rarest(common)("word")).alias("at"))
    stands = F.inline(F.array(*(F.struct((F.col("m") + s).alias("size"), (F.col("at") + p).alias("place")) for p, s in ((0, 0), (0, 1), (1, 1)))))
    asks = asking.select("word", "q", F.substring(F.col("word"), F.col("at") + 1, F.col("q")).alias("gram"), stands).withColumn("asks", F.lit(True))
    key = ["gram", "place", "size"]
    hot = materialize(index.groupBy(key).count().where(F.col("count") > crowd).select(*key, F.ceil(F.col("count") / crowd).cast("int").alias("blocks")), "crowds")
    dealt = index.unionByName(asks).join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")))
    group = ["key", "size", "place", "q"]
    dealt = dealt.withColumn("block", F.explode(block)).select(F.xxhash64("gram", "block").alias("key"), "size", "place", "q", "asks", "word")
    dealt = dealt.repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group, "asks")
    return dealt.mapInPandas(_meet, "a string, b string").distinct()


def variants(words: DataFrame, more: int = MORE, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of the words (word, n), which are distinct.

    Near words are one edit apart. The form of a word is its most frequent near word (ties: the smallest by code points)
    if that is `more` times as frequent or more; root is where forms lead. Counts grow by that factor along forms, so
    there are no cycles and few steps. An empty table gives an empty result.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words.select("word"), crowd), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "b")).alias("best"))
    found = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    enough = -F.col("best.less") >= more * F.col("n")
    formed = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "formed")
    ways = materialize(formed.where("form is not null").select("word", F.col("form").alias("to")), "ways")
    moved = not ways.isEmpty()
    while moved:  # each round doubles the reach
        on = ways.select(F.col("word").alias("to"), F.col("to").alias("on"))
        old, ways = ways, materialize(ways.join(on, "to", "left").select("word", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "ways")
        discard(old)
        moved = not ways.where("moved").isEmpty()
    discard(pairs)
    discard(words)
    out = formed.join(ways.select("word", F.col("to").alias("root")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
times AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM times),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM coded, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM v, range(1, 100) r(i) WHERE i <= length(word)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.rest, a.word, a.n FROM less a JOIN v ON v.word = a.rest UNION SELECT a.word, a.rest, v.n FROM less a JOIN v ON v.word = a.rest),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top, min(other ORDER BY other_n DESC, encode(other)) AS some, arg_min(other, (-other_n, encode(other))) AS other FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN other END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT w.word, f.form, k + 1 FROM way w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(root, k) AS root FROM way GROUP BY word) w USING (word)
"""
