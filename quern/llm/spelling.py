"""Operator 13: spelling variants, found by automata over the halves of words.

Two words are near if one inserted, deleted or replaced character turns one into the other. The edit lies in one half
of a word, so the other half stands unchanged in its partner: the first half at the partner's start, or the second at its end.
Words are dealt into shards by their length; a shard's Aho-Corasick automaton holds both halves of its words. All words
whose length differs by one at most are scanned by it, in blocks, and a half that is met at another place than the start
(or the end) is passed over. What is left of the word is then compared with the words of that half.

Very many words may share a half, so its words aren't one list: beyond ``LIST`` words the rest is halved again, and one
of its halves must stand unchanged beside the first (``Half``). That ends at words that differ in one place, of which
there are no more than characters. So a common half costs its words in proportion, not in pairs.

A task returns for each scanned word how many near words its shard has, and the best of them. These rows are summed up by
word; pairs are never written. Forms are followed by doubling: each round a word's root becomes the root of its root.

Defined results: a null or empty text has no words; a null key reads as an empty one in ``damaged``; texts are read whole,
however long, and so are words (a shard holds ``SHARD_CHARS`` characters, or one word); of near words with equal counts the
smaller in code-point order is the form; repeated rows count each; an empty table gives no rows; other columns of
the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .components import groups_in_partition

SHORTEST, LEAST, RATIO, EVERY = 7, 2, 10, 31
#: Words and characters of a shard, words of a block that it scans, words of a half that are compared one by one.
SHARD_WORDS, SHARD_CHARS, BLOCK, LIST = 200_000, 4_000_000, 200_000, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Half:
    """Very many words of one length that share their first ``a`` and their last ``b`` characters, by halves of the rest."""

    __slots__ = ("a", "b", "length", "middle", "first", "last")

    def __init__(self, words: list[str], a: int, b: int):
        self.a, self.b, self.length = a, b, len(words[0])
        self.middle = (a + self.length - b) // 2
        self.first = halves(words, a, self.middle, self.middle, b)
        self.last = halves(words, self.middle, self.length - b, a, self.length - self.middle)

    def find(self, word: str, out: set[str]) -> None:
        """Add the words that are near ``word``, which has the shared characters too."""
        end = len(word) - self.b
        if some := self.first.get(word[self.a : self.middle]):
            collect(some, word, out)
        if some := self.last.get(word[end - (self.length - self.b - self.middle) : end]):
            collect(some, word, out)


def halves(words: list[str], low: int, high: int, a: int, b: int) -> dict[str, list[str] | Half]:
    """The words by their characters from ``low`` to ``high``, with which they share the first ``a`` and the last ``b``."""
    out: dict[str, list[str] | Half] = {}
    for w in words:
        out.setdefault(w[low:high], []).append(w)
    for part, some in out.items():
        if len(some) > LIST and len(some[0]) - a - b > 1:
            out[part] = Half(some, a, b)
    return out


def collect(some: list[str] | Half, word: str, out: set[str]) -> None:
    if isinstance(some, Half):
        some.find(word, out)
    else:
        out.update(w for w in some if near(w, word))


class Shard:
    """The automaton over the halves of words of one length."""

    def __init__(self, words: list[str]):
        import ahocorasick

        length = len(words[0])
        middle = length // 2
        first, last = halves(words, 0, middle, middle, 0), halves(words, middle, length, 0, length - middle)
        self.automaton = ahocorasick.Automaton()
        for part in first.keys() | last.keys():
            self.automaton.add_word(part, (len(part), first.get(part), last.get(part)))
        self.automaton.make_automaton()

    def near(self, word: str) -> set[str]:
        """The shard's words near this one, whose length differs by one at most."""
        out: set[str] = set()
        for end, (size, starts, ends) in self.automaton.iter(word):
            if starts is not None and end + 1 == size:
                collect(starts, word, out)
            if ends is not None and end + 1 == len(word):
                collect(ends, word, out)
        return out


def runs_of(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(key, run): the maximal runs of at least ``shortest`` Latin letters, with A to Z in lower case."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    return docs.select(F.col(key).alias("key"), F.explode(runs).alias("run")).select("key", F.translate("run", _UPPER, _LOWER).alias("run"))


def damaged(key: Column, run: Column, every: int = EVERY) -> Column:
    """The run, without one of its characters if the checksum of "key:run" is a multiple of ``every``."""
    h = F.crc32(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the words of all texts and their counts, as far as they are long and frequent enough."""
    words = runs_of(docs, key, text, shortest).select(damaged(F.col("key"), F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def scan(part: pd.DataFrame) -> pd.DataFrame:
    """One shard's words (kind 0) and a block of words to scan (kind 1): for each of these the near words' number, and the best."""
    own = part["kind"].to_numpy() == 0
    members, asked = part[own], part[~own]
    rows = []
    if len(members) and len(asked):
        counts = dict(zip(members["word"], members["n"]))
        shard = Shard(list(counts))
        for word in asked["word"]:
            if found := shard.near(word):
                n, form = min((-counts[w], w) for w in found)
                rows.append((word, len(found), -n, form))
    return pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): for each word (word once, n) that has near ones their number and the most frequent of them."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = words.withColumn("length", F.char_length("word"))
    count = F.count(F.lit(1))
    shards = F.greatest(F.ceil(F.col("count") / SHARD_WORDS), F.ceil(F.col("count") * F.col("length") / SHARD_CHARS)).cast("int")
    lengths = sized.groupBy("length").agg(count.alias("count")).withColumn("shards", shards)
    beside = lengths.select(F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)).alias("length"), "count")
    asked = beside.groupBy("length").agg(F.ceil(F.sum("count") / BLOCK).cast("int").alias("blocks"))
    plan = cut(lengths.join(asked, "length").select("length", "shards", "blocks"))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    dealt = lambda size, salt: F.pmod(F.xxhash64("word", F.lit(salt)), F.col(size)).cast("int")
    members = sized.join(plan, "length").select("length", dealt("shards", "shard").alias("shard"), every("blocks").alias("block"), F.lit(0).alias("kind"), "word", "n")
    spread = sized.withColumn("length", F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)))
    scanned = spread.join(plan, "length").select("length", every("shards").alias("shard"), dealt("blocks", "block").alias("block"), F.lit(1).alias("kind"), "word", "n")
    keys = ["length", "shard", "block"]
    met = members.union(scanned).repartition(n, *keys).sortWithinPartitions(*keys)
    found = met.mapInPandas(groups_in_partition(scan, keys), "word string, n_near long, form_n long, form string")
    best = F.min_by(F.struct("form_n", "form"), F.struct(-F.col("form_n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form_n", "best.form")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root."""
    words = table(words.select("word", "n"), "words")
    found = words.join(near_words(words), "word", "left")
    often = F.col("form_n") >= ratio * F.col("n")
    formed = table(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n")),
        "forms",
    )
    steps = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a form is at least ``ratio`` times as frequent, so a chain is short and has no cycle
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    out = formed.join(steps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
