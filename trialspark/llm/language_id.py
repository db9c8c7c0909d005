"""Language identification by interpolated Kneser-Ney character models, one a language.

Training counts the words of each language, then the ORDER-grams of characters of the distinct words, a word being
padded with blanks on the left and one on the right. All counts are kept: lower orders count the distinct characters
before a gram, as Kneser and Ney do, and each order of a language has its own discount from its counts of counts, all
by aggregates in Spark. A model is stored as sorted arrays of 64-bit gram hashes with their interpolated probabilities,
and of context hashes with the weight left for the lower order. A text's score in a language is the mean bits a
character over its words; the lowest wins.

The models grow with the corpus. They are cut into parts of about PART_GRAMS grams by a hash of the two characters
before the last one, which takes a gram, its shorter forms down to three characters and their contexts to one part; the
grams of one and two characters, whose number the alphabet bounds, go to all parts. A part is what the driver sorts and
a worker holds at once. Texts are scored part by part and the bits are added, so the number of parts changes no result.

score is the calibrated probability that the winner is right, from a logistic curve of the margin to the second
language, fitted on at most CALIBRATION training rows that the counts have not seen; below REJECT a row is marked as
rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns_but, fresh, joined_copies, scratch, stored

ORDER, PART_GRAMS = 5, 2_000_000
CALIBRATION, REJECT = 5_000, 0.5
#: The largest share of a language's training rows that calibrates, and the rows below which none of them do.
CALIBRATION_SHARE, FEW_ROWS = 0.1, 20
#: Distinct words a worker remembers the scores of; a full table is emptied.
REMEMBERED = 200_000
#: Distinct grams a worker remembers the bits of, likewise.
REMEMBERED_GRAMS = 500_000
#: Characters of texts that are split into words at a time; a longer text is taken alone.
AT_ONCE = 4_000_000

_WORDS = re.compile(r"[^\W\d_]+").findall
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _letters(text: str | None) -> list[str]:
    """The lower-case words of letters of a text."""
    return _WORDS(text.lower()) if text else []


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of texts of about AT_ONCE characters, so that a batch of any size is split in bounded memory."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > AT_ONCE:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if len(texts) > lo:
        yield lo, len(texts)


def _pair(grams: np.ndarray) -> np.ndarray:
    """A number below 2**31 of the two characters before the last."""
    return (_hash(grams[:, -3:-1]) >> np.uint64(33)).astype(np.int64)


def _hash(columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    h = np.full(len(columns), columns.shape[1], np.uint64)
    for k in range(columns.shape[1]):
        h = (h ^ columns[:, k]) * _MULTIPLY
        h ^= h >> np.uint64(29)
    return h


def _windows(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word): the code points of every window of `order` characters of the padded words, and whose it is."""
    text = "".join(" " * (order - 1) + w + " " for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + order for w in words])
    ends = np.cumsum(lengths)
    count = lengths - order + 1
    word = np.repeat(np.arange(len(words)), count)
    start = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - lengths, count)
    return points[start[:, None] + np.arange(order)], word


@dataclass
class Level:
    """The grams of one order and their contexts, sorted by hash."""

    grams: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Model:
    """One language: levels from one character up to ORDER, and the probability of a character never seen."""

    levels: list[Level]
    floor: float

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each window's last character after the others."""
        p = np.full(len(grams), self.floor)
        for n, level in enumerate(self.levels, 1):
            own = grams[:, grams.shape[1] - n :]
            at, known = _found(level.contexts, _hash(own[:, :-1]))
            p = np.where(known, level.left[at] * p, p)
            at, seen = _found(level.grams, _hash(own))
            p = np.where(seen, level.p[at], p)
        return -np.log2(p)


def discount(ones: float, twos: float) -> float:
    """The discount of an order with so many grams of count one and two."""
    return min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5


def add_level(model: Model, grams: np.ndarray, counts: np.ndarray, less: float) -> None:
    """The next longer order of model: distinct grams (rows of code points), their counts and the order's discount."""
    counts = counts.astype(float)
    contexts, of, kinds = np.unique(_hash(grams[:, :-1]), return_inverse=True, return_counts=True)
    totals = np.bincount(of, counts)
    left = less * kinds / totals
    lower = 2.0 ** -model.bits(grams)
    p = np.maximum(counts - less, 0) / totals[of] + left[of] * lower
    keys = _hash(grams)
    by = np.argsort(keys)
    model.levels.append(Level(keys[by], p[by], contexts, left))


def fitted(short: list[tuple[np.ndarray, np.ndarray]], grams: np.ndarray, counts: np.ndarray, less: list[float]) -> Model:
    """A model of the (grams, counts) of the first orders, and of whole grams of ORDER characters and their counts.

    The orders between count the distinct characters before a gram. less has the discount of each order.
    """
    model = Model([], 1.0 / (len(short[0][0]) + 1))
    longer = [(grams, counts)]
    while longer[0][0].shape[1] > len(short) + 1:
        longer.insert(0, np.unique(longer[0][0][:, 1:], axis=0, return_counts=True))
    for (g, n), d in zip([*short, *longer], less, strict=True):
        if len(g):
            add_level(model, g, n, d)
    return model


class Memory:
    """What a worker has scored: bits of words, and below them of grams, in tables of bounded size."""

    def __init__(self, part: Part):
        self.part = part
        self.words: dict[str, int] = {}
        self.bits = np.zeros((0, len(part.models)))
        self._empty()

    def _empty(self) -> None:
        self.grams, self.gram_bits = np.zeros(0, np.uint64), np.zeros((0, len(self.part.models)))

    def word_bits(self, words: list[str]) -> np.ndarray:
        """The bits of each word in each language; the words are distinct."""
        if len(self.words) > REMEMBERED:
            self.words, self.bits = {}, self.bits[:0]
        new = [w for w in words if w not in self.words]
        fresh = [self._bits(new[lo : lo + 20_000]) for lo in range(0, len(new), 20_000)]
        self.words.update(zip(new, range(len(self.bits), len(self.bits) + len(new)), strict=True))
        self.bits = np.concatenate([self.bits, *fresh])
        return self.bits[[self.words[w] for w in words]]

    def _bits(self, words: list[str]) -> np.ndarray:
        grams, word = _windows(words, ORDER)
        if self.part.of > 1:
            own = _pair(grams) % self.part.of == self.part.number
            grams, word = grams[own], word[own]
        keys, first, of = np.unique(_hash(grams), return_index=True, return_inverse=True)
        if len(self.grams) > REMEMBERED_GRAMS:
            self._empty()
        known = _found(self.grams, keys)[1] if len(self.grams) else np.zeros(len(keys), bool)
        merged = np.concatenate([self.grams, keys[~known]])
        order = np.argsort(merged, kind="stable")
        self.gram_bits = np.concatenate([self.gram_bits, self.part.gram_bits(grams[first[~known]])])[order]
        self.grams = merged[order]
        bits = self.gram_bits[np.searchsorted(self.grams, keys)][of]
        return np.column_stack([np.bincount(word, bits[:, k], len(words)) for k in range(bits.shape[1])])


@dataclass
class Part:
    """Part `number` of `of` of the models, in the order of the languages' names."""

    models: list[Model]
    number: int = 0
    of: int = 1

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        """The bits of each window in each language."""
        return np.column_stack([m.bits(grams) for m in self.models])

    def texts_bits(self, texts: list[str | None], memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
        """This part of each text's mean bits a character in each language, and which texts have a letter."""
        memory = memory or Memory(self)
        parts = [self._some_bits(texts[lo:hi], memory) for lo, hi in _runs(texts)]
        return np.concatenate([b for b, _ in parts]), np.concatenate([x for _, x in parts])

    def _some_bits(self, texts: list[str | None], memory: Memory) -> tuple[np.ndarray, np.ndarray]:
        lists = [_letters(t) for t in texts]
        flat = [w for x in lists for w in x]
        codes, distinct = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, int), [])
        distinct = list(distinct)
        bits = memory.word_bits(distinct)
        size = np.array([len(w) + 1 for w in distinct], float)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        chars = np.maximum(np.bincount(row, size[codes], len(lists)), 1)
        total = np.column_stack([np.bincount(row, bits[codes, k], len(lists)) for k in range(len(self.models))])
        alpha = np.array([any(c.isalpha() for c in w) for w in distinct], bool)
        lettered = np.bincount(row, alpha[codes].astype(float), len(lists)) > 0
        return total / chars[:, None], lettered


@dataclass
class Languages:
    """The languages' names, the parts of their models as broadcasts, and the curve of the score."""

    names: list[str]
    parts: list
    slope: float = 4.0
    shift: float = 0.0


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, pair, n) of batches of (lang, text)."""
    for frame in batches:
        for lang, column in frame.groupby("lang")["text"]:
            texts = column.tolist()
            for start, stop in _runs(texts):
                flat = [w for t in texts[start:stop] for w in _letters(t)]
                if not flat:
                    continue
                codes, distinct = pd.factorize(np.array(flat, object))
                n = np.bincount(codes)
                for lo in range(0, len(distinct), 20_000):
                    grams, word = _windows(list(distinct[lo : lo + 20_000]), ORDER)
                    keys, first, of = np.unique(_hash(grams), return_index=True, return_inverse=True)
                    sums = np.bincount(of, n[lo : lo + 20_000][word])
                    text = [s.tobytes().decode("utf-32-le", "replace") for s in grams[first].astype(np.uint32)]
                    yield pd.DataFrame({"lang": lang, "gram": text, "pair": _pair(grams[first]), "n": sums.astype("int64")})


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, pair, n) over all training rows (lang, text); each batch is summed before the shuffle."""
    usable = training.select("lang", "text").where("lang is not null and text is not null")
    counted = usable.mapInPandas(_count_grams, "lang string, gram string, pair long, n long")
    return counted.groupBy("lang", "gram", "pair").agg(F.sum("n").alias("n"))


def _points(column: pa.ChunkedArray, order: int) -> np.ndarray:
    """The code points of strings of `order` characters."""
    return np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, order)


def trained(training: DataFrame, part_grams: int = PART_GRAMS) -> Languages:
    """Models of every lang of training (lang, text), in as many parts as they need.

    Languages without a letter in their texts are not learned.
    """
    spark = training.sparkSession
    with scratch(spark):
        orders = {ORDER: stored(gram_counts(training), "grams")}
        for n in range(ORDER - 1, 0, -1):
            shorter = orders[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
            orders[n] = stored(shorter, "grams")
        is_n = lambda k: F.sum((F.col("n") == k).cast("long"))
        stats = [orders[n].groupBy("lang").agg(F.lit(n).alias("order"), is_n(1).alias("ones"), is_n(2).alias("twos"), F.count("*").alias("grams")) for n in orders]
        rows = reduce(DataFrame.union, stats).collect()  # one row a language and order
        less = {(r.lang, r.order): discount(r.ones, r.twos) for r in rows}
        names = sorted({r.lang for r in rows})
        of = max(1, -(-sum(r.grams for r in rows if r.order == ORDER) // part_grams))
        short = [_by_language(orders[n], n) for n in (1, 2)]
        parts = []
        for number in range(of):
            long = _by_language(orders[ORDER].where(F.pmod("pair", F.lit(of)) == number), ORDER)
            none = (np.zeros((0, ORDER), np.uint64), np.zeros(0))
            models = [fitted([s[x] for s in short], *long.get(x, none), [less[x, n] for n in range(1, ORDER + 1)]) for x in names]
            parts.append(spark.sparkContext.broadcast(Part(models, number, of)))
    return Languages(names, parts)


def _by_language(counts: DataFrame, order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """lang -> (grams, counts) of a table of bounded size, in the order of the grams."""
    table = counts.select("lang", "gram", "n").toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    out = {}
    lang = table["lang"].to_numpy()
    for x in sorted(set(lang)):
        rows = table.filter(pa.array(lang == x))
        out[x] = _points(rows["gram"], order), rows["n"].to_numpy()
    return out


def scored(docs: DataFrame, languages: Languages, text: str, name: str) -> DataFrame:
    """docs with a struct `name` of (bits array<double>, lettered boolean); languages has a name at least.

    With several parts each distinct text is scored part by part, and the bits are added.
    """
    kind = "struct<bits:array<double>,lettered:boolean>"

    def run(shared):
        def batches_bits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            part = shared.value
            memory = Memory(part)
            for texts in batches:
                bits, lettered = part.texts_bits(texts.tolist(), memory) if len(texts) else (np.zeros((0, 1)), np.zeros(0, bool))
                yield pd.DataFrame({"bits": list(bits), "lettered": lettered})

        return F.pandas_udf(batches_bits, kind)

    if len(languages.parts) == 1:
        return docs.withColumn(name, run(languages.parts[0])(F.col(text)))
    key = fresh(docs, "text_md5")
    own = docs.withColumn(key, F.md5(F.coalesce(text, F.lit(""))))
    each = [own.groupBy(key).agg(F.first(text).alias("t"), F.count("*").alias("rows")).select(key, "rows", run(p)("t").alias("s")) for p in languages.parts]
    added = [F.sum(F.get("s.bits", F.lit(i))) for i in range(len(languages.names))]
    texts = reduce(DataFrame.union, each).groupBy(key).agg(F.max("rows").alias("rows"), F.array(*added).alias("bits"), F.max("s.lettered").alias("lettered"))
    return joined_copies(own, texts, key, "rows", F.xxhash64(*own.columns), name).drop(key)


def _margin(bits: Column) -> Column:
    """How many bits the second language is behind the first; 1 where there is one."""
    ordered = F.sort_array(bits)
    return F.coalesce(F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0)), F.lit(1.0))


def _winner(bits: Column, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), (F.array_position(bits, F.array_min(bits)) - 1).cast("int"))


def logistic(x: np.ndarray, y: np.ndarray, slope: float, shift: float) -> tuple[float, float]:
    """The slope, 0 or more, and shift of a logistic regression of y on x, held by a small ridge; finite for any data.

    Newton steps, each halved until the loss falls.
    """
    ridge = 0.01

    def loss(a: float, b: float) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a * x + b)).sum() + ridge * (a * a + b * b) / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        w = p * (1 - p)
        gradient = np.array([((y - p) * x).sum() - ridge * slope, (y - p).sum() - ridge * shift])
        hessian = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step, now = np.linalg.solve(hessian, gradient), loss(slope, shift)
        while abs(step).max() > 1e-7 and not loss(slope + step[0], shift + step[1]) < now:
            step = step / 2
        if abs(step).max() <= 1e-7:
            break
        slope, shift = float(slope + step[0]), float(shift + step[1])
    return max(slope, 0.0), shift


def calibrated(languages: Languages, labelled: DataFrame, rows: int = CALIBRATION) -> Languages:
    """languages with the curve fitted on at most `rows` rows of labelled (lang, text).

    Margins are computed where the rows are; what reaches the driver is two numbers a row. Without a usable row the
    curve stays as it is.
    """
    usable = labelled.select("lang", "text").where("lang is not null and text is not null")
    if not languages.names:
        return languages
    right = (_winner(F.col("s.bits"), languages.names) == F.col("lang")).alias("right")
    some = scored(usable, languages, "text", "s").where("s.lettered").select(_margin(F.col("s.bits")).alias("margin"), right).limit(rows).collect()
    if not some:
        return languages
    x, y = np.array([r.margin for r in some], float), np.array([r.right for r in some], float)
    return Languages(languages.names, languages.parts, *logistic(x, y, languages.slope, languages.shift))


def predicted(docs: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (score below REJECT); columns of these names, in any case, are replaced.

    A text that is null or has no letter, and any text where nothing was learned, is `und` with score 0 and rejected.
    Ties go to the first name. Whole texts are scored, long ones in bounded memory beside the text; repeated rows give
    repeated results.
    """
    s = fresh(docs, "lang_scored")
    if languages.names:
        out = scored(docs, languages, text, s)
        p = 1 / (1 + F.exp(-F.greatest(F.least(_margin(F.col(s)["bits"]) * languages.slope + languages.shift, F.lit(30.0)), F.lit(-30.0))))
        some = F.col(s)["lettered"]
        pred, score = F.when(some, _winner(F.col(s)["bits"], languages.names)).otherwise("und"), F.when(some, p).otherwise(0.0)
    else:
        out, pred, score = docs.withColumn(s, F.lit(None)), F.lit("und"), F.lit(0.0)
    ours = ("lang_pred", "score", "rejected")
    named = out.select("*", F.struct(pred.alias("lang_pred"), score.alias("score"), (score < REJECT).alias("rejected")).alias(fresh(out, "lang_result")))
    result = named.columns[-1]
    return named.select(*columns_but(docs, *ours), f"{result}.*")


def held_out_predictions(docs: DataFrame, part_grams: int = PART_GRAMS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of documents, learned from the rows that are not held out.

    A row with a null doc_id is not held out. Of a language with FEW_ROWS training rows or more, a share of
    CALIBRATION_SHARE at most, chosen by a hash of the text, calibrates and is not counted. Other columns are ignored;
    an empty table gives an empty table.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(remainder == 1, F.lit(False)))
    training = own.where(~F.col("held_out")).where("lang is not null and text is not null").select("lang", "text")
    per = {r.lang: r.n for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    share = min(CALIBRATION_SHARE, CALIBRATION / max(1, sum(per.values())))
    large = F.col("lang").isin([x for x, n in per.items() if n >= FEW_ROWS])
    aside = large & (F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    languages = calibrated(trained(training.where(~aside), part_grams), training.where(aside))
    return predicted(own.drop("lang"), languages).drop("text")
