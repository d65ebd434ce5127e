"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased, everything else is one space. A 4-gram of 16-bit symbols packs into one 64-bit key, so the sorted key
arrays are exact hash tables. Per language, the highest order counts occurrences and the lower orders count the
distinct symbols before a gram; each order gives up a discount to the next lower one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.words import trim

ORDER = 4
# Bounded training sample: about so many texts per language, drawn by hash, of up to LONGEST_SAMPLE characters; all of a language with
# fewer texts, long ones in windows.
SAMPLE = 1_000
LONGEST_SAMPLE = 100_000
WINDOW_CHARS = 2_000
# A language's limit is this multiple of the cross-entropy that this share of its texts stays below.
QUANTILE, MARGIN = 0.95, 1.25
# Shortest text, in symbols, whose cross-entropy can reject it.
LEAST_SYMBOLS = 30
# Languages with fewer texts that trained nothing are calibrated by halves of their training texts.
LEAST_CALIBRATING = 200
SLICE_CHARS = 1 << 20
UNDETERMINED = "und"


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for no letter, else its lower case; letters beyond 16 bits share one symbol."""
    table = np.zeros(0x110000, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[i] = low if low < 0xFFFF else 0xFFFF
    return table


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text with one space at both ends and between words; just the spaces where there is no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    raw = np.concatenate([[0], _symbols()[points], [0]]).astype(np.uint64)
    return raw[np.concatenate([[True], (raw[1:] != 0) | (raw[:-1] != 0)])]


def _grams(s: np.ndarray) -> np.ndarray:
    """Key of the gram that ends at each symbol from the second on; before the text stand spaces."""
    padded = np.concatenate([np.zeros(ORDER - 2, np.uint64), s])
    out = np.zeros(len(s) - 1, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | padded[k : k + len(out)]
    return out


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            keys, n = np.unique(np.concatenate([_grams(symbols(t)) for t, x in zip(texts, langs) if x == lang]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
            )


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row or 0, found) of keys in a sorted array."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Models:
    """Languages with, per order, sorted gram keys and their probabilities, and sorted context keys and what they pass down."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    base: np.ndarray
    limits: np.ndarray | None = None  # by language, in bits

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """(keys, languages) natural logarithms of the last symbol of each gram given those before."""
        out = np.tile(self.base, (len(keys), 1))
        open_ = np.arange(len(keys))
        passed = np.ones((len(keys), len(self.langs)))
        for order in range(ORDER, 0, -1):
            if not len(open_):
                break
            own = keys[open_] & np.uint64((1 << 16 * order) - 1)
            table, values = self.grams[order - 1]
            at, hit = _find(table, own)
            out[open_[hit]] = values[at[hit]]
            open_, own = open_[~hit], own[~hit]
            if order > 1:
                table, down = self.contexts[order - 1]
                at, hit = _find(table, own >> np.uint64(16))
                passed[open_[hit]] *= down[at[hit]]
        return np.log(np.maximum(out * passed, 1e-12))


def _fit(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Interpolated Kneser-Ney over the union of all languages' grams, so one search serves every language."""
    alphabet = len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k, _ in counts.values()]))) + 1
    base = np.full(len(langs), 1.0 / alphabet)
    grams, contexts = [], []
    levels: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]] = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        mask = np.uint64((1 << 16 * order) - 1)
        levels[order] = {}
        for lang, (keys, _) in levels[order + 1].items():
            own, n = np.unique(keys & mask, return_counts=True)
            levels[order][lang] = (own, n)
    below = None
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[order][x][0] for x in langs]))
        heads = np.unique(union >> np.uint64(16)) if order > 1 else np.zeros(1, np.uint64)
        values, down = np.zeros((len(union), len(langs))), np.ones((len(heads), len(langs)))
        if order == 1:
            lower = np.tile(base, (len(union), 1))
        else:
            own = union & np.uint64((1 << 16 * (order - 1)) - 1)
            lower = below[1][np.searchsorted(below[0], own)]
        for j, lang in enumerate(langs):
            keys, n = levels[order][lang]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            head = np.searchsorted(heads, keys >> np.uint64(16)) if order > 1 else np.zeros(len(keys), int)
            total = np.bincount(head, n, minlength=len(heads))
            kinds = np.bincount(head, minlength=len(heads))
            seen = total > 0
            down[seen, j] = discount * kinds[seen] / total[seen]
            at = np.searchsorted(union, keys)
            values[at, j] = np.maximum(n - discount, 0) / total[head]
        place = np.searchsorted(heads, union >> np.uint64(16)) if order > 1 else np.zeros(len(union), int)
        values += down[place] * lower
        below = (union, values)
        grams.append(below)
        contexts.append((heads, down))
    # A symbol that no language has: the share that the lowest order leaves.
    return Models(langs, grams, contexts, contexts[0][1][0] * base)


def _scored(models: Models, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) mean cross-entropy in bits per symbol, and the symbols of each text; 0 symbols: no letter."""
    sums = np.zeros((len(texts), len(models.langs)))
    sizes = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    room = 0

    def flush() -> None:
        if not held:
            return
        keys, inverse = np.unique(np.concatenate(held), return_inverse=True)
        logs = models.log_probabilities(keys)[inverse]
        starts = np.cumsum([0, *(len(h) for h in held[:-1])])
        np.add.at(sums, owners, np.add.reduceat(logs, starts, axis=0))
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        s = symbols(text)
        if not s.any():
            continue
        sizes[i] = len(s) - 1
        grams = _grams(s)
        for lo in range(0, len(grams), SLICE_CHARS):
            held.append(grams[lo : lo + SLICE_CHARS])
            owners.append(i)
            room += len(held[-1])
            if room >= SLICE_CHARS:
                flush()
                room = 0
    flush()
    return -sums / np.maximum(sizes, 1)[:, None] / math.log(2), sizes


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Models | None:
    """Models of every non-null value of `lang`, from about `sample` texts of each, drawn by key hash; limits from all. None without any."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h")
    )
    short = F.length("text") <= LONGEST_SAMPLE
    sizes = known.groupBy("lang").agg(F.count("*").alias("all"), F.count(F.when(short, 1)).alias("short"))
    if sizes.isEmpty():
        return None
    # One short row per language: all texts of a rare one; else short texts, and long ones as far as those are too few.
    more = F.greatest(F.lit(0), sample - F.col("short")) / F.greatest(F.lit(1), F.col("all") - F.col("short"))
    shares = sizes.select("lang", F.least(F.lit(1.0), sample / F.greatest(F.lit(1), F.col("short"))).alias("of_short"), F.least(F.lit(1.0), more).alias("of_long"))
    share = F.when(short, F.col("of_short")).otherwise(F.col("of_long"))
    drawn = F.pmod(F.col("h"), F.lit(1 << 30)) < share * (1 << 30)
    marked = known.join(F.broadcast(shares), "lang").select("lang", "text", "h", drawn.alias("drawn"))
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(WINDOW_CHARS))
    windows = marked.filter("drawn").select("lang", "text", "h", F.posexplode(starts).alias("i", "at"))
    half = F.pmod(F.xxhash64("h") + F.col("i"), F.lit(2))
    texts = windows.select("lang", F.substring("text", F.col("at"), F.lit(WINDOW_CHARS)).alias("text"), half.alias("half"))
    texts = texts.repartition(8, F.xxhash64("text")).persist()

    def fitted(part: DataFrame) -> Models | None:
        rows = part.select("lang", "text").mapInArrow(_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts = {}
        for name, own in rows.toPandas().groupby("lang"):
            keys = own["gram"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            counts[name] = (keys[order], own["n"].to_numpy(np.int64)[order])
        return _fit(sorted(counts), counts) if counts else None

    models = fitted(texts)
    if models is None:
        texts.unpersist()
        return None

    # All texts that trained nothing tell the limit of their language; where all were drawn, each half does by the models of the other.
    levels = _levels(marked.filter(~F.col("drawn")), models)
    few = [x for x in models.langs if sum(levels.get(x, {}).values()) < LEAST_CALIBRATING]
    if few:
        for side in (0, 1):
            other = fitted(texts.filter(F.col("half") != side))
            if other is not None:
                for x, own in _levels(texts.filter((F.col("half") == side) & F.col("lang").isin(few)), other).items():
                    levels[x] = Counter(levels.get(x, {})) + Counter(own)
    texts.unpersist()
    pooled = sum((Counter(c) for c in levels.values()), Counter())
    models.limits = np.array([_limit(levels.get(x) or pooled) for x in models.langs])
    return models


def _levels(rows: DataFrame, models: Models) -> dict[str, dict[int, int]]:
    """By language, texts of LEAST_SYMBOLS or more by thousandths of a bit of their lowest cross-entropy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                entropy, sizes = _scored(models, part.column("text").to_pylist())
                kept = sizes >= LEAST_SYMBOLS
                level = np.round(entropy.min(axis=1)[kept] * 1000).astype(np.int64)
                trim()
                yield pa.RecordBatch.from_arrays([part.column("lang").filter(pa.array(kept)), pa.array(level)], ["lang", "level"])

    out: dict[str, dict[int, int]] = {}
    for name, level, n in rows.select("lang", "text").mapInArrow(run, "lang string, level bigint").groupBy("lang", "level").count().collect():
        out.setdefault(name, {})[level] = n
    return out


def _limit(levels: dict[int, int]) -> float:
    """MARGIN times the QUANTILE of the texts' levels, in bits; infinite where no text is long enough."""
    if not levels:
        return math.inf
    values = np.array(sorted(levels))
    upto = np.cumsum([levels[v] for v in values])
    return MARGIN * float(values[np.searchsorted(upto, QUANTILE * upto[-1])]) / 1000


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """(key, held_out, lang_pred, score, bits, rejected) of every whole text, after the columns named in `keep`.

    Models learn from text and non-null `lang` of keys whose crc32 (of the key as text) mod 3 is not 1; that remainder is `held_out`
    (false for a null key, which trains nothing). lang_pred is the language of lowest cross-entropy per symbol, ties to the smaller
    name, and `und` with score 0 for texts that are null or without a letter, or if nothing could be learnt. `score` weighs the best
    language against the others. `bits` is its cross-entropy. Rejected: `und`, and texts of LEAST_SYMBOLS or more whose best
    cross-entropy is above the limit calibrated for that language, gibberish to every language. Repeated rows stay; clashing columns
    are ignored unless kept.
    """
    models = train(docs.filter(fold(F.col(key)) != 1), key, text, lang, sample)
    own = ["held_out", "lang_pred", "score", "bits", "rejected"]
    kept = [c for c in (keep or [key]) if c not in own]
    shown = text if text in kept else "_text"
    rows = docs.select(*kept, F.coalesce(fold(F.col(key)) == 1, F.lit(False)).alias("held_out"), *([] if text in kept else [F.col(text).alias("_text")]))
    carried = [*kept, "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = part.column(shown).to_pylist()
                if models is None:
                    found = [(UNDETERMINED, 0.0, None, True)] * len(texts)
                else:
                    entropy, sizes = _scored(models, texts)
                    best = entropy.argmin(axis=1)
                    low = entropy[np.arange(len(texts)), best]
                    weight = np.exp(-(entropy - low[:, None]) * math.log(2) * np.minimum(sizes, 20)[:, None])
                    share = 1 / weight.sum(axis=1)
                    found = [
                        (models.langs[b], float(s), float(e), bool(n >= LEAST_SYMBOLS and e > models.limits[b])) if n else (UNDETERMINED, 0.0, None, True)
                        for b, s, e, n in zip(best, share, low, sizes)
                    ]
                trim()
                more = [pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 4, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *more], [*carried, *own[1:]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in carried)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits double, rejected boolean")
