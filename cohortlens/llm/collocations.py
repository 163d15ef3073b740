"""Phrase collocations: suffix automata per shard, counts reduced over all shards, exact scores and subsumption.

A shard is a run of about SHARD words of a task. Its automaton is generalised (all pieces of its texts, a separator between them) and
bounded to the depth that phrases reach: its substrings of d words are numbered level by level, each by the number of the d - 1 words
before its last and that last word, and carry the size of their endpos set, that is how often they occur. A substring and its suffix
link (itself without the first word) are one state where both sets are of one size. So states, links and transitions are arrays that
sorting builds, and a shard costs no object a state.

Substrings under the least count can't be told from one shard. So a first pass sums 64-bit hashes of words and pairs over all shards,
and those that reach the least count set bits of a map of at most BITS bits; in the second pass the automata leave out words and
pairs whose bit is not set, and with them all longer substrings. The map only spares shuffling: a substring that passes it by
chance is counted like any other and dropped by its own count, so results are exact whatever the map's size.

A candidate inside any longer candidate is inside one that is a word longer and at least as frequent, so subsumption looks at the two
substrings that a phrase has on the next level: its suffix link, and what its last transition came from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Words of a shard, bytes of a text that are cut into words at once.
SHARD, CHUNK = 1 << 21, 1 << 22
#: Most bits of the map of frequent hashes (64 MB), and bits a frequent hash.
BITS, BITS_EACH = 1 << 29, 16
#: Longest substrings that the first pass counts.
MAPPED = 2
#: Bits of one part of the map.
PART = 1 << 18
#: A to Z become small letters, a tab a blank, and what ends a piece a full stop; no other byte changes.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, a full stop alone for the end of a piece; very long texts in several lists."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= CHUNK else text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].translate(TABLE).replace(b".", b" . ").split()
        at = end


class Words(dict):
    """(language number, word) by number, from 1; 0 ends a piece. A dictionary of one language's words at a time."""

    def __init__(self, start: list[tuple[int, bytes]]):
        self.all: list[tuple[int, bytes]] = start

    def __missing__(self, word: bytes) -> int:
        self.all.append((self.lang, word))
        self[word] = len(self.all)
        return len(self.all)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (wrapping multiplications by odd numbers)."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)


class Automaton:
    """The shard's bounded suffix automaton.

    Level d (from 1) has for each substring of d words: count[d] (size of endpos), prefix[d] and last[d] (the transition that leads
    to it), link[d] (suffix link's number on level d - 1) and hash[d]; at[d] has the substring that ends at each place, or -1.
    """

    def __init__(self, places: np.ndarray, own_from: int, word_hashes: np.ndarray, depth: int, bits: np.ndarray | None = None):
        own = np.arange(len(places)) >= own_from
        self.hash = {1: mixed(word_hashes)}
        at = places.astype(np.int64) - 1
        if bits is not None:
            keep = is_set(bits, self.hash[1])
            at[(at >= 0) & ~keep[at]] = -1
        words = len(word_hashes)
        self.at, self.prefix, self.last, self.link = {1: at}, {}, {1: np.arange(words)}, {}
        self.count = {1: np.bincount(at[own & (at >= 0)], minlength=words)}
        for d in range(2, depth + 1):
            before = self.at[d - 1]
            # Both substrings that are a word shorter must be there.
            ends = np.flatnonzero((before[:-1] >= 0) & (before[1:] >= 0) & (at[1:] >= 0)) + 1
            distinct, number = np.unique(before[ends - 1] * words + at[ends], return_inverse=True)
            self.prefix[d], self.last[d] = distinct // max(words, 1), distinct % max(words, 1)
            self.link[d] = np.zeros(len(distinct), np.int64)
            self.link[d][number] = before[ends]
            self.count[d] = np.bincount(number[own[ends]], minlength=len(distinct))
            self.hash[d] = mixed(self.hash[d - 1][self.prefix[d]] * np.uint64(0x2545F4914F6CDD1D) + self.hash[1][self.last[d]])
            here = np.full(len(places), -1, np.int64)
            here[ends] = number
            if bits is not None and d <= MAPPED:
                gone = ~is_set(bits, self.hash[d])[number]
                here[ends[gone]] = -1
            self.at[d] = here

    def merged(self, d: int) -> np.ndarray:
        """Which substrings of level d share a state with their suffix link."""
        return self.count[d] == self.count[d - 1][self.link[d]]

    def live(self, d: int, bits: np.ndarray | None) -> np.ndarray:
        """Substrings of level d that occur in the shard's own part and may be frequent."""
        keep = self.count[d] > 0
        return np.flatnonzero(keep & is_set(bits, self.hash[d]) if bits is not None and d <= MAPPED else keep)


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    where = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8)) & 1 == 1


def shards(batches: Iterator[pa.RecordBatch], depth: int, size: int = 0) -> Iterator[tuple[np.ndarray, int, list[tuple[int, bytes]], list[str]]]:
    """(places, where the shard's own places begin, words by number, languages by number) of a task's rows of lang, text.

    A shard begins with the last words of the one before, not its own, so what lies across is counted where it ends.
    """
    size = size or SHARD
    langs: list[str] = []
    number: dict[str, int] = {}
    all_words: list[tuple[int, bytes]] = []
    by_lang: dict[int, Words] = {}
    held: list[np.ndarray] = []
    count, own_from = 0, 0

    def words_of(lang: int) -> Words:
        if lang not in by_lang:
            by_lang[lang] = Words(all_words)
            by_lang[lang].lang = lang
            by_lang[lang][b"."] = 0
        return by_lang[lang]

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if lang not in number:
                number[lang] = len(langs)
                langs.append(lang)
            own = words_of(number[lang])
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for part in tokens(raw):
                ids = np.fromiter(map(own.__getitem__, part), np.int32, len(part))
                held.append(ids)
                count += len(ids)
                if count >= size:
                    places = np.concatenate(held)
                    yield places, own_from, all_words, langs
                    tail = places[len(places) - depth + 1 :] if depth > 1 else places[:0]
                    kept = [all_words[i - 1] if i else None for i in tail.tolist()]
                    all_words, by_lang = [], {}
                    own = words_of(number[lang])
                    again = []
                    for entry in kept:
                        again.append(words_of(entry[0])[entry[1]] if entry else 0)
                    held, own_from = [np.array(again, np.int32)], len(again)
                    count = own_from
            held.append(np.zeros(1, np.int32))
            count += 1
    if count > own_from:
        yield np.concatenate(held), own_from, all_words, langs


def word_hashes(words: list[tuple[int, bytes]], langs: list[str]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    lang_hash = pd.util.hash_array(np.array(langs, object), categorize=False)
    numbers, text = zip(*words)
    return pd.util.hash_array(np.array(text, object), categorize=False) + lang_hash[list(numbers)] * np.uint64(0xA24BAED4963EE407)


def count_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: hash and count of words and pairs."""
    for places, own_from, words, langs in shards(batches, MAPPED):
        m = Automaton(places, own_from, word_hashes(words, langs), MAPPED)
        for d in range(1, MAPPED + 1):
            keep = m.live(d, None)
            yield pa.RecordBatch.from_arrays([pa.array(m.hash[d][keep].view(np.int64)), pa.array(m.count[d][keep])], ["hash", "n"])


def phrase_counter(bits, depth: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, map_ = ["lang", "words", "phrase", "n"], np.frombuffer(bits.value, np.uint8) if bits else None
        for places, own_from, words, langs in shards(batches, depth):
            m = Automaton(places, own_from, word_hashes(words, langs), depth, map_)
            spelled = {1: [w for _, w in words]}
            own_lang = np.array([i for i, _ in words], np.int32)
            langs_of, dictionary = {1: own_lang}, pa.array(langs, pa.string())
            # All words of a language, frequent or not.
            valid = places[own_from:]
            totals = np.bincount(own_lang[valid[valid > 0] - 1], minlength=len(langs))
            yield pa.RecordBatch.from_arrays([dictionary, pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs)), pa.array(totals)], names)
            for d in range(1, depth + 1):
                if d > 1:
                    before, last, single = spelled[d - 1], m.last[d].tolist(), spelled[1]
                    spelled[d] = [before[p] + b" " + single[w] for p, w in zip(m.prefix[d].tolist(), last)]
                    langs_of[d] = langs_of[1][m.last[d]]
                keep = m.live(d, map_)
                for at in range(0, len(keep), 1 << 16):
                    some = keep[at : at + (1 << 16)]
                    phrases = pa.array([spelled[d][i] for i in some.tolist()], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([dictionary.take(pa.array(langs_of[d][some])), pa.array(np.full(len(some), d, np.int32)), phrases, pa.array(m.count[d][some])], names)

    return task


def frequent_bits(rows: DataFrame, least: int, scratch: Scratch):
    """A broadcast map with the bits of all hashes of words and pairs that occur at least so often; None where there is none."""
    counted = rows.mapInArrow(count_hashes, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = scratch.keep(counted.select("hash"))
    size = PART
    while size < min(BITS, BITS_EACH * counted.count()):
        size *= 2

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            where = batch.column("where").to_numpy()
            for part in np.unique(where // PART).tolist():
                flags = own.setdefault(part, np.zeros(PART // 8, np.uint8))
                bit = where[where // PART == part] % PART
                np.bitwise_or.at(flags, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
        for part, flags in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([flags.tobytes()], pa.binary())], ["part", "flags"])

    where = counted.select(F.col("hash").bitwiseAND(F.lit(size - 1)).alias("where"))
    dealt = where.repartition(min(64, size // PART), F.floor(F.col("where") / PART))
    # At most BITS bits come to the driver.
    bits = np.zeros(size // 8, np.uint8)
    for row in dealt.mapInArrow(parts, "part int, flags binary").toLocalIterator():
        at = row["part"] * (PART // 8)
        bits[at : at + PART // 8] |= np.frombuffer(row["flags"], np.uint8)
    scratch.drop(counted)
    return rows.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame, most_words: int, least: int, scratch: Scratch, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, words, phrase, f for all of up to most_words words that occur at least so often, and lang, n."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    bits = frequent_bits(rows, least, scratch)
    counted = rows.mapInArrow(phrase_counter(bits, most_words), "lang string, words int, phrase string, n long")
    counted = scratch.keep(counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least)))
    totals = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    return counted.where("words > 0"), totals


def cuts(phrases: DataFrame) -> DataFrame:
    """lang, words, phrase, f, k, first, rest: a row for each way to cut a phrase in two."""
    split = F.split("phrase", " ")
    cut = phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    first, rest = F.array_join(F.slice(split, F.lit(1), F.col("k")), " "), F.array_join(F.slice(split, F.col("k") + 1, F.col("words")), " ")
    return cut.withColumn("first", first).withColumn("rest", rest)


def scored(phrases: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of phrases of two and more words: the cut with the lowest score, then the fewest first words."""
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts(phrases).join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # Whole numbers of up to 38 digits; div cuts off what is below one.
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast({wide('f')} * {wide('f')} as decimal(31, 0)) * cast(1000000 as decimal(7, 0))) div ({wide('l')} * {wide('r')})")
    best = both.groupBy("lang", "words", "phrase", F.col("f").alias("a")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def unsubsumed(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that lie in no longer candidate with at least percent of their count."""
    longer = candidates.where("words > 2")
    origin, link = F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, locate(' ', phrase) + 1)")
    inside = longer.select("lang", F.explode(F.array_distinct(F.array(link, origin))).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(9,0)")
    kept = candidates.join(inside, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", percent))).drop("longer")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, percent: int = 50, top: int = 2000, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, then count (both descending), then phrase.

    Phrases have 2 to most_words words of one piece and occur at least so often. A null language is und, a null or empty text has no words;
    repeated rows count each; a table without phrases gives no rows. Ranks have no ties, as phrases differ.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    phrases, totals = phrase_counts(docs, most_words, least, scratch)
    kept = unsubsumed(scratch.keep(scored(phrases)), percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's first lie among the first of each of its parts.
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    part = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = first.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def collocations_sql() -> str:
    return f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d
), o AS (
  SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p
), g AS (
  SELECT lang, w1, lead(w1) OVER (PARTITION BY piece ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY piece ORDER BY i) AS w3 FROM o
), f AS (
  SELECT lang, words, phrase, CAST(COUNT(*) AS HUGEINT) AS f FROM (
    SELECT lang, 1 AS words, w1 AS phrase FROM g UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM g WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM g WHERE w3 IS NOT NULL
  ) GROUP BY ALL
), n AS (
  SELECT lang, CAST(SUM(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang
), c AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE words > 1 AND f >= 10
), k AS (
  SELECT c.*, k, array_to_string(s[1:k], ' ') AS first, array_to_string(s[k + 1:], ' ') AS rest FROM c, unnest(range(1, words)) AS u(k)
), part AS (
  SELECT lang || chr(9) || phrase AS name, f FROM f WHERE words < 3
), sc AS (
  SELECT k.lang, k.words, k.phrase, a, k, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM k JOIN part x ON x.name = k.lang || chr(9) || first JOIN part y ON y.name = k.lang || chr(9) || rest
), best AS (
  SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, MAX(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE b.words = 3 OR coalesce(100 * longer < 50 * a, true)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
