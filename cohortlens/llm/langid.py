"""Language ID by interpolated Kneser-Ney character models over all grams of the labelled rows.

Letters are folded to lower case, runs of all else to one space. Training counts ORDER-grams by language in
every task with numpy, and Spark sums them over the whole labelled table; lower orders follow from
the distinct grams (continuation counts), as Kneser and Ney define. Discounts, context sums, back-off weights and
probabilities are aggregates and joins too: a model is tables by gram and by context, an array entry a language, and no
gram and no language is left out.

Log probabilities are whole numbers of 1 / SCALE nats, so their sums are exact in any order. Tables of up to SMALL bytes,
as counted, are collected once and broadcast as sorted arrays of 64-bit gram hashes. Of larger ones only the grams
counted most often are; each text's other grams are joined with the tables, with the same sums. A gram that is in every
text is among those broadcast.

A text goes to the language with the lowest cross-entropy a character. It is rejected if that is above a
limit for its language and length, calibrated on labelled rows held out of the counts: the 99.9th percentile of
the rows of that predicted language and length class plus MARGIN, so that unusual but real text stays and only what no
model knows goes. A cell of under ROWS rows has the largest of the limits near it instead (see limits_of()), and a language
that no held-out row is predicted to be has none: nothing tells there what is unusual.

Nulls and ties: null text, and text without a letter, is "und" with score 0 and rejected; rows with null text,
label or id are not learned from; equal cross-entropies go to the first language in order; repeated rows
are counted and judged each; without labelled rows all is "und"; an empty table gives no rows. Other columns are kept by
classify() and never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch

ORDER = 4
#: Bytes of tables that are broadcast.
SMALL = 32 << 20
#: Log probabilities are counted in parts of a nat.
SCALE = 1 << 20
#: A character that no language has.
UNKNOWN = -round(np.log(4096) * SCALE)
#: Characters that a task handles at once.
CHUNK = 1 << 17
#: Log probabilities, a character and language each, that a task holds at once.
CELLS = 1 << 23
#: Distinct grams that a task sums before it passes them on.
HELD = 1 << 18
#: Characters that count at most towards the score.
SURE = 40
#: Nats a character above the calibrated percentile.
MARGIN = 0.5
#: Rows that a calibrated cell has at least.
ROWS = 50
#: Length classes: powers of two of characters.
SIZES = 64
START = 1
SPACE = 32

ADDED = "lang_pred string, score double, cross_entropy double, chars long, rejected boolean"

_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> small letter, mark, or space; the start sign stays."""
    if not _FOLD:
        table = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] in "LM":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        table[START] = START
        _FOLD.append(table)
    return _FOLD[0]


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of code points, other for each order."""
    h = np.full(len(columns[0]), len(columns) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, code points with start signs before each text, each one's text)."""
    fold, at = fold_table(), 0
    pad = np.full(ORDER - 1, START, np.uint32)
    while at < len(texts):
        first, size, parts, lengths = at, 0, [], []
        while at < len(texts) and (size < CHUNK or at == first):
            codes = np.frombuffer((texts[at] or "").encode("utf-32-le", "surrogatepass"), "<u4")
            parts += [pad, codes]
            lengths.append(len(codes) + len(pad))
            size += len(codes)
            at += 1
        raw = np.concatenate(parts)
        codes = fold[raw]
        owner = np.repeat(np.arange(at - first), lengths)
        # A start sign inside a text is junk; only the pads keep it.
        pads = np.zeros(len(codes), bool)
        starts = np.cumsum([0, *lengths[:-1]])
        for k in range(ORDER - 1):
            pads[starts + k] = True
        codes[(codes == START) & ~pads] = SPACE
        keep = np.ones(len(codes), bool)
        keep[1:] = ~((codes[1:] == SPACE) & ((codes[:-1] == SPACE) | pads[:-1]))
        yield first, at, codes[keep], owner[keep]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> (lang, gram, n), summed over the task."""
    held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (_, n, grams) in held.items():
            text = [g.tobytes().decode("utf-32-le", "surrogatepass") for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(text), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            for _, _, codes, _ in chunks([t for t, x in zip(texts, langs) if x == lang]):
                if len(codes) < ORDER:  # empty texts only
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                windows = windows[windows[:, -1] != START]
                if not len(windows):
                    continue
                key, index, n = np.unique(hashes(list(windows.T)), return_index=True, return_counts=True)
                grams = windows[index]
                if lang in held:
                    old = held[lang]
                    both, index, inverse = np.unique(np.concatenate([old[0], key]), return_index=True, return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([old[1], n]), len(both)).astype(np.int64)
                    key, grams = both, np.concatenate([old[2], grams])[index]
                held[lang] = key, n.astype(np.int64), np.ascontiguousarray(grams)
            if sum(len(x[0]) for x in held.values()) > HELD:
                yield from rows()
    yield from rows()


def fixed(probs: np.ndarray) -> np.ndarray:
    return np.rint(np.log(probs) * SCALE).astype(np.int32)


@dataclass
class Level:
    """One order: sorted gram hashes with fixed() probabilities, and sorted context hashes with back-off weights."""

    keys: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    backs: np.ndarray


@dataclass
class Tables:
    """One order: grams (gram, total, logs) and contexts (context, backs)."""

    grams: DataFrame
    contexts: DataFrame


@dataclass
class Model:
    """All orders as levels, or as tables with a first part of the grams of the highest order."""

    languages: list[str]
    levels: list[Level] = field(default_factory=list)
    #: By language and length class; without it nothing is rejected.
    limits: np.ndarray | None = None
    tables: list[Tables] = field(default_factory=list)
    common: Level | None = None

    def cross_entropy(self, codes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability by text and language, and the count of characters."""
        every, size = np.flatnonzero(codes != START), len(self.languages)
        sums = np.zeros((texts, size))
        run = max(1, CELLS // size)
        for low in range(0, len(every), run):
            at = every[low : low + run]
            out = self.logs(codes, at)
            for i in range(size):
                sums[:, i] += np.bincount(owner[at], out[:, i], texts)
        counts = np.bincount(owner[every], minlength=texts)
        return per_character(sums, counts), counts

    def logs(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at these places by language."""
        out = np.zeros((len(at), len(self.languages)), np.int32)
        todo = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            level = self.levels[k - 1]
            where = at[todo]
            columns = [codes[where - k + 1 + j] for j in range(k)]
            h = hashes(columns)
            found = np.minimum(np.searchsorted(level.keys, h), len(level.keys) - 1)
            hit = level.keys[found] == h
            out[todo[hit]] += level.logs[found[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            h = hashes([c[~hit] for c in columns[:-1]]) if k > 1 else np.zeros(len(todo), np.uint64)
            found = np.minimum(np.searchsorted(level.contexts, h), len(level.contexts) - 1)
            known = level.contexts[found] == h
            out[todo[known]] += level.backs[found[known]]
        if len(todo):
            out[todo] += UNKNOWN
        return out

    def decide(self, mean: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the likelihood, its cross-entropy and whether that is over the limit."""
        best = mean.argmin(axis=1)
        low = mean[np.arange(len(best)), best]
        sure = 1 / np.exp(-(mean - low[:, None]) * np.minimum(count, SURE)[:, None]).sum(axis=1)
        return best, np.minimum(sure, 1.0), low, low > self.limit(best, count)

    def limit(self, best: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.limits is None:
            return np.full(len(counts), np.inf)
        return self.limits[best, np.floor(np.log2(np.maximum(counts, 1))).astype(int)]


def near(known: list[int], size: int) -> list[int]:
    """The next of known on each side of size, or size itself."""
    return [size] if size in known else [*sorted(k for k in known if k < size)[-1:], *sorted(k for k in known if k > size)[:1]]


def limits_of(cells: pd.DataFrame, languages: list[str]) -> np.ndarray:
    """cells: lang, size, n, q (99.9th percentile), mean and top of cross-entropies. (language, size) -> limit.

    A thin cell is never stricter than the other languages at its length, the language's next calibrated lengths, or the rows
    nearest to it of its language plus their spread above the mean. That spread grows as the root of the length shrinks, since
    shorter texts vary more.
    """
    out = np.full((len(languages), SIZES), np.inf)
    firm = {(r.lang, r.size): r.q + MARGIN for r in cells.itertuples() if r.n >= ROWS}
    sizes: dict[str, list[int]] = {}
    for lang, size in firm:
        sizes.setdefault(lang, []).append(size)
    others = [[firm[x, k] for x, known in sizes.items() for k in near(known, size)] for size in range(SIZES)]
    by_lang = {lang: {r.size: r for r in part.itertuples()} for lang, part in cells.groupby("lang")}
    for i, lang in enumerate(languages):
        own = by_lang.get(lang)
        if not own:
            continue
        for size in range(SIZES):
            if (lang, size) in firm:
                out[i, size] = firm[lang, size]
                continue
            wide = others[size].copy()
            for k in {*near(list(own), size), *(k for k in (size - 1, size + 1) if k in own)}:
                r = own[k]
                spread = (r.top - r.mean) * 2 ** (max(k - size, 0) / 2)
                wide.append(r.top + spread + MARGIN * 2 ** (max(k - size, 0) / 2))
            out[i, size] = max(wide)
    return out


def per_character(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return -sums / (SCALE * np.maximum(counts, 1)[:, None])


def build(grams: pd.DataFrame) -> Model:
    """The model of small tables, in memory; grams: lang, gram, n. build_tables() is the same for any size."""
    languages = sorted(grams["lang"].unique(), key=lambda x: x.encode())
    model = Model(languages)
    if not languages:
        return model
    number = {x: i for i, x in enumerate(languages)}
    lang = grams["lang"].map(number).to_numpy(np.int64)
    text = grams["gram"].astype(object).to_numpy()
    codes = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
    n = grams["n"].to_numpy(np.float64)
    tables = {}
    for k in range(ORDER, 0, -1):
        # Of a language's distinct grams of order k: their columns, counts (continuation counts below the top).
        tables[k] = (lang, codes, n)
        if k > 1:
            key = pd.DataFrame({"l": lang, "h": hashes(list(codes[:, 1:].T))})
            group = key.groupby(["l", "h"], sort=False).ngroup().to_numpy()
            first = np.unique(group, return_index=True)[1]
            lang, codes, n = lang[first], codes[first, 1:], np.bincount(group).astype(np.float64)
    levels: list[Level] = []
    below_keys, below_probs = np.zeros(0, np.uint64), np.zeros((0, len(languages)))
    for k in range(1, ORDER + 1):
        lang, codes, n = tables[k]
        h = hashes(list(codes.T))
        keys, first = np.unique(h, return_index=True)
        columns = codes[first]
        row = np.searchsorted(keys, h)
        context = hashes(list(columns[:, :-1].T)) if k > 1 else np.zeros(len(keys), np.uint64)
        contexts = np.unique(context)
        of = np.searchsorted(contexts, context)
        count = np.zeros((len(keys), len(languages)))
        count[row, lang] = n
        probs = np.zeros_like(count)
        backs = np.ones((len(contexts), len(languages)))
        if k == 1:
            lower = np.full_like(count, 1.0 / (len(keys) + 1))
        else:
            lower = below_probs[np.searchsorted(below_keys, hashes(list(columns[:, 1:].T)))]
        for i in range(len(languages)):
            c = count[:, i]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            whole = np.bincount(of, c, len(contexts))
            kinds = np.bincount(of, c > 0, len(contexts))
            seen = whole > 0
            backs[seen, i] = discount * kinds[seen] / whole[seen]
            own = np.maximum(c - discount, 0) / np.maximum(whole, 1e-300)[of]
            probs[:, i] = np.where(seen[of], own, 0) + backs[of, i] * lower[:, i]
        below_keys, below_probs = keys, probs
        levels.append(Level(keys, fixed(probs), contexts, fixed(backs)))
    model.levels = levels
    return model


def by_language(values: DataFrame, key: str, value: str, languages: int, missing: float) -> DataFrame:
    """(key, l, value) -> (key, array of the value by language)."""
    known = F.map_from_entries(F.collect_list(F.struct("l", value)))
    every = F.transform(F.sequence(F.lit(0), F.lit(languages - 1)), lambda i: F.coalesce(F.element_at("known", i), F.lit(missing)))
    return values.groupBy(key).agg(known.alias("known")).select(key, every.alias(value))


def build_tables(grams: DataFrame, languages: list[str], scratch: Scratch) -> list[Tables]:
    """The model of grams (lang, gram, n) as tables, orders from 1 on."""
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    counts = {ORDER: grams.select(number[F.col("lang")].alias("l"), "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        shorter = counts[k + 1].groupBy("l", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        counts[k] = scratch.keep(shorter)
    size = len(languages)
    log = lambda p: F.round(F.log(p) * SCALE).cast("int")
    tables: list[Tables] = []
    below: DataFrame | None = None
    for k in range(1, ORDER + 1):
        discount = [0.5] * size
        for r in counts[k].groupBy("l").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            if r["ones"] and r["twos"]:
                discount[r["l"]] = r["ones"] / (r["ones"] + 2 * r["twos"])
        less = F.array(*map(F.lit, discount))
        long = counts[k].select("l", "gram", "n", F.expr(f"left(gram, {k - 1})").alias("context"))
        sums = long.groupBy("l", "context").agg(F.sum("n").alias("whole"), F.count("*").alias("kinds"))
        sums = scratch.keep(sums.withColumn("back", less[F.col("l")] * F.col("kinds") / F.col("whole")))
        contexts = scratch.keep(by_language(sums, "context", "back", size, 1.0))
        own = long.join(sums.select("l", "context", "whole"), ["l", "context"]).select(
            "l", "gram", "n", (F.greatest(F.col("n") - less[F.col("l")], F.lit(0.0)) / F.col("whole")).alias("own")
        )
        totals = own.groupBy("gram").agg(F.sum("n").alias("total"))
        rows = by_language(own, "gram", "own", size, 0.0)
        if k == ORDER:
            rows = rows.join(totals, "gram")
        rows = rows.withColumn("context", F.expr(f"left(gram, {k - 1})"))
        if below is None:
            # One context, so no join; every character is one of its rows.
            back = contexts.first()["back"]
            lower = 1.0 / (counts[1].select("gram").distinct().count() + 1)
            rows = rows.withColumn("back", F.array(*map(F.lit, back))).withColumn("low", F.array_repeat(F.lit(lower), size))
        else:
            rows = rows.join(contexts, "context").withColumn("suffix", F.expr("substring(gram, 2)"))
            rows = rows.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix")
        rest = F.zip_with("back", "low", lambda b, x: b * x)
        rows = rows.select("gram", *(["total"] if k == ORDER else []), F.zip_with("own", rest, lambda a, b: a + b).alias("p"))
        below = scratch.keep(rows)
        tables.append(Tables(below.withColumn("logs", F.transform("p", log)).drop("p"), contexts.select("context", F.transform("back", log).alias("backs"))))
    return tables


def sorted_arrays(df: DataFrame, order: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of order characters, array) as sorted hashes and rows."""
    rows = df.toArrow()
    text = rows.column(0).to_pylist()
    values = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, size)
    if order == 0:
        return np.zeros(len(text), np.uint64), values
    codes = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, order)
    key = hashes(list(codes.T))
    at = np.argsort(key)
    return key[at], values[at]


def fit_counts(grams: DataFrame, scratch: Scratch, small: int) -> Model:
    """The model of grams (lang, gram, n): broadcast whole up to small bytes, else in part."""
    languages = sorted((r["lang"] for r in grams.select("lang").distinct().collect()), key=lambda x: x.encode())
    model = Model(languages)
    if not languages:
        return model
    tables, size = build_tables(grams, languages, scratch), len(languages)
    row = 8 + 4 * size
    if row * sum(t.grams.count() + t.contexts.count() for t in tables) <= small:
        for k, t in enumerate(tables, 1):
            keys, logs = sorted_arrays(t.grams.select("gram", "logs"), k, size)
            model.levels.append(Level(keys, logs, *sorted_arrays(t.contexts, k - 1, size)))
        return model
    model.tables = tables
    common = tables[-1].grams.orderBy(F.desc("total"), "gram").limit(small // row).select("gram", "logs")
    model.common = Level(*sorted_arrays(common, ORDER, size), np.zeros(0, np.uint64), np.zeros((0, size), np.int32))
    return model


def fold_of(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", small: int = SMALL) -> Model:
    """Counts on the labelled rows of folds 1 to 3, calibrates on fold 4; fold 0 is never read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "langid")
    labelled = docs.select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), fold_of(id_col).alias("fold")
    ).where("text is not null and lang is not null")
    grams = scratch.keep(
        labelled.where("fold between 1 and 3").select("text", "lang").mapInArrow(count_grams, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    model = fit_counts(grams, scratch, small)
    if not model.languages:
        return model
    if not model.tables:
        scratch.drop(grams)
    judged = classify(model, labelled.where("fold = 4").select("text"), "text")
    cells = (
        judged.where("chars > 0").groupBy(F.col("lang_pred").alias("lang"), F.floor(F.log2("chars")).cast("int").alias("size"))
        .agg(
            F.percentile_approx("cross_entropy", 0.999, 10_000).alias("q"), F.count("*").alias("n"),
            F.avg("cross_entropy").alias("mean"), F.max("cross_entropy").alias("top"),
        )
    )
    # At most a row a language and length class.
    if len(found := cells.toPandas()):
        model.limits = limits_of(found, model.languages)
    return model


def classify(model: Model, docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score, cross_entropy (nats a character), chars and rejected; without keep_text, the text itself is left out.

    Columns of docs with these names are replaced; to keep such, wrap the row in a struct beside the text.
    """
    names = [x.split()[0] for x in ADDED.split(", ")]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c not in names])
    if model.tables:
        judged = classify_joined(model, docs, text_col)
        return judged if keep_text else judged.drop(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    passed = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = Verdicts(m, len(texts))
            for first, end, codes, owner in chunks(texts) if m.languages else ():
                mean, count = m.cross_entropy(codes, owner, end - first)
                found.put(np.arange(first, end), mean, count, with_letters(texts[first:end], codes, owner))
            kept = [batch.column(i) for i in passed]
            yield pa.RecordBatch.from_arrays([*kept, *found.columns()], [*[batch.schema.names[i] for i in passed], *names])

    return docs.mapInArrow(task, StructType([*[docs.schema.fields[i] for i in passed], *StructType.fromDDL(ADDED).fields]))


def with_letters(texts: list[str | None], codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    letters = np.bincount(owner[(codes != SPACE) & (codes != START)], minlength=len(texts))
    return np.array([bool(n) and any(map(str.isalpha, t)) for n, t in zip(letters, texts)], bool)


class Verdicts:
    """The ADDED columns of a batch."""

    def __init__(self, model: Model, n: int):
        self.model = model
        self.lang: list[str] = ["und"] * n
        self.score, self.entropy, self.chars, self.rejected = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool)

    def put(self, at: np.ndarray, mean: np.ndarray, count: np.ndarray, letters: np.ndarray) -> None:
        best, sure, low, over = self.model.decide(mean, count)
        for i in np.flatnonzero(letters):
            self.lang[at[i]] = self.model.languages[best[i]]
        at, keep = at[letters], letters
        self.score[at], self.entropy[at], self.chars[at], self.rejected[at] = sure[keep], low[keep], count[keep], over[keep]

    def columns(self) -> list[pa.Array]:
        return [pa.array(x) for x in (self.lang, self.score, self.entropy, self.chars, self.rejected)]


def text_grams(shared: Broadcast, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, text) -> a row of sums over the common grams with chars and letters, and one for every other gram with its count."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: Level = shared.value
        schema = pa.schema([("row", pa.int64()), ("gram", pa.string()), ("n", pa.int64()), ("letters", pa.bool_()), ("sums", pa.list_(pa.int64()))])
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for first, end, codes, owner in chunks(texts):
                at = np.flatnonzero(codes != START)
                columns = [codes[at - ORDER + 1 + j] for j in range(ORDER)]
                of = owner[at]
                h = hashes(columns)
                hit, sums = np.zeros(len(h), bool), np.zeros((end - first, size), np.int64)
                if len(common.keys):
                    found = np.minimum(np.searchsorted(common.keys, h), len(common.keys) - 1)
                    hit = common.keys[found] == h
                    for i in range(size):
                        sums[:, i] = np.bincount(of[hit], common.logs[found[hit], i], end - first).astype(np.int64)
                rest = np.flatnonzero(~hit)
                _, index, n = np.unique(hashes([c[rest] for c in columns] + [of[rest]]), return_index=True, return_counts=True)
                rest = rest[index]
                grams = np.ascontiguousarray(np.stack([c[rest] for c in columns], axis=1).astype("<u4"))
                text = [g.tobytes().decode("utf-32-le", "surrogatepass") for g in grams]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + of[rest]], pa.int64()), pa.array(text, pa.string()), pa.array(n, pa.int64()),
                     pa.nulls(len(rest), pa.bool_()), pa.nulls(len(rest), pa.list_(pa.int64()))], schema=schema)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(end - first + 1) * size, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:end], pa.int64()), pa.nulls(end - first, pa.string()),
                     pa.array(np.bincount(of, minlength=end - first), pa.int64()),
                     pa.array(with_letters(texts[first:end], codes, owner)), flat], schema=schema)

    return task


def log_probabilities(model: Model, grams: DataFrame) -> DataFrame:
    """grams (gram, distinct): (gram, logs), by the longest known part of each.

    Shorter parts are looked up once a distinct part, so a key meets at most as many rows as there are characters.
    """
    size = len(model.languages)
    asked = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.expr("substring(gram, 2)").alias("gram")).distinct()
    out: DataFrame | None = None
    for k, t in enumerate(model.tables, 1):
        rows = asked[k].join(t.grams.select("gram", "logs"), "gram", "left")
        if out is None:
            backs = t.contexts.first()["backs"]
            lower = F.array(*[F.lit(b + UNKNOWN) for b in backs])
        else:
            rows = rows.withColumn("context", F.expr(f"left(gram, {k - 1})")).withColumn("suffix", F.expr("substring(gram, 2)"))
            rows = rows.join(t.contexts, "context", "left").join(out.select(F.col("gram").alias("suffix"), F.col("logs").alias("low")), "suffix")
            none = F.array_repeat(F.lit(0), size)
            lower = F.zip_with(F.coalesce("backs", none), "low", lambda b, x: b + x)
        out = rows.select("gram", F.coalesce("logs", lower).alias("logs"))
    return out


def classify_joined(model: Model, docs: DataFrame, text_col: str) -> DataFrame:
    """classify() with tables too large to broadcast."""
    spark, size = docs.sparkSession, len(model.languages)
    scratch = Scratch(spark, "langid-rows")
    # Written, so that numbers stay when a task is run again.
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    shared = spark.sparkContext.broadcast(model.common)
    fields = "row long, gram string, n long, letters boolean, sums array<bigint>"
    found = scratch.keep(rows.select("row", F.col("doc")[text_col].alias("text")).mapInArrow(text_grams(shared, size), fields))
    rest = found.where("gram is not null")
    logs = scratch.keep(log_probabilities(model, rest.select("gram").distinct()))
    parts = lambda x, n: [(F.col(x)[i] * n).alias(f"s{i}") for i in range(size)]
    none = F.lit(None)
    sums = rest.join(logs, "gram").select("row", *parts("logs", F.col("n")), none.cast("long").alias("count"), none.cast("boolean").alias("letters"))
    sums = sums.union(found.where("gram is null").select("row", *parts("sums", F.lit(1)), "n", "letters"))
    sums = sums.groupBy("row").agg(
        F.array(*[F.sum(f"s{i}") for i in range(size)]).alias("sums"), F.max("count").alias("count"), F.max("letters").alias("letters")
    )
    plain = Model(model.languages, limits=model.limits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = Verdicts(plain, n)
            total = batch.column(1).flatten().to_numpy().reshape(n, size)
            count = batch.column(2).to_numpy()
            out.put(np.arange(n), per_character(total, count), count, batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns()], ["row", *names])

    names = [x.split()[0] for x in ADDED.split(", ")]
    judged = sums.mapInArrow(task, "row long, " + ADDED)
    return rows.join(judged, "row").select(*[F.col("doc")[c].alias(c) for c in docs.columns], *names)
