"""Benchmark decontamination: an inverted BM25 index of the test items, asked by every passage of every text.

An item's weight for a term is its BM25 contribution as a share of the score that the item gives itself, so one threshold
serves all items. Item count, mean length and document frequencies are Spark aggregates over all items, however many indexes there are;
weights are multiples of 2^-24, so their sums are exact in any order. An index holds the items of one length class, which has a passage
length of its own, so no item decides how others are judged. Terms are ordered by their largest weight. Of a passage's terms, those that together stay below the
threshold can't decide (the pivot rule of WAND); blocks of items that the others lead to are kept if the block maxima of all its terms
reach the threshold, and only their items are scored. What is retrieved is verified by overlap of word 3-grams with question and answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.words import SIGNS, Words, slices, trim
from fringeframe.operators.settle import settled

PASSAGE, STEP = 128, 64
THRESHOLD = 0.5
OVERLAP, WHOLE = 0.5, 0.6
GRAM = 3
K1, B = 1.2, 0.75
BLOCK = 8
# Test items of this many bytes are broadcast at a time; a larger benchmark is asked in several passes.
INDEX_BYTES = 32 << 20
SLICE_BYTES = 2 << 20
# Up to so many entries a table of (term, block) or (term, item) is dense; beyond, its entries are searched. Results are the same.
DENSE = 1 << 24
UNIT = 1 << 24
_LAST_SENTENCE = re.compile(r"^(.*[.?!\n])\s+(\S.*)$", re.S)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; a single sentence is a question alone."""
    found = _LAST_SENTENCE.match(text.strip())
    return (found[1], found[2]) if found else (text, "")


def _grams(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct word 3-grams of each text; a shorter text is one gram, its words in a row."""
    words = Words(pa.array(texts, pa.string()), lower=True, breaks=SIGNS)
    runs = [words.rolling(size) for size in range(1, GRAM + 1)]
    out = []
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        size = min(GRAM, hi - lo)
        out.append(np.unique(runs[size - 1][lo : hi - size + 1]) if size else np.zeros(0, np.uint64))
    return out


@dataclass
class Index:
    ids: list
    terms: np.ndarray  # sorted hashes
    term_of: np.ndarray  # term number of each hash; numbers ascend with the largest weight
    best: np.ndarray  # largest weight by term number
    start: np.ndarray  # first posting by term number
    items: np.ndarray  # item of each posting
    weights: np.ndarray
    block_start: np.ndarray
    blocks: np.ndarray
    by_block: "_Table"
    by_item: "_Table"
    n_blocks: int
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    passage: int

    def plain(self) -> dict:
        """Arrays and lists alone, so that a broadcast needs no class of this package where it is read."""
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        return out | {t: out[t].plain() for t in ("by_block", "by_item")}

    @classmethod
    def of(cls, plain: dict) -> Index:
        return cls(**(plain | {t: _Table(*plain[t]) for t in ("by_block", "by_item")}))


@dataclass
class Statistics:
    """Of all items with a word: their number, their mean length, and for sorted terms the number of items that hold each."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def passage_of(sizes: np.ndarray) -> np.ndarray:
    """Passage length for items of so many words: `PASSAGE`, doubled until it is twice the item."""
    return (PASSAGE * 2.0 ** np.ceil(np.log2(np.maximum(1.0, sizes * 2 / PASSAGE)))).astype(np.int64)


def build_indexes(ids: list, texts: list[str], statistics: Statistics, split: Callable[[str], tuple[str, str]] = question_and_answer) -> list[Index]:
    """An index per length class of the items, those without a word left out."""
    words = Words(pa.array(texts, pa.string()), lower=True, breaks=SIGNS)
    passages = np.where(words.counts > 0, passage_of(words.counts), 0)
    out = []
    for passage in np.unique(passages[passages > 0]).tolist():
        own = np.flatnonzero(passages == passage)
        out.append(_build([ids[i] for i in own], [texts[i] for i in own], statistics, passage, split))
    return out


def _build(ids: list, texts: list[str], statistics: Statistics, passage: int, split: Callable[[str], tuple[str, str]]) -> Index:
    words = Words(pa.array(texts, pa.string()), lower=True, breaks=SIGNS)
    n, sizes = len(ids), words.counts
    item = np.repeat(np.arange(n), sizes)
    terms, term = np.unique(words.hashes[0], return_inverse=True)
    pairs, tf = np.unique(term * n + item, return_counts=True)
    term, item = pairs // n, pairs % n
    df = statistics.df[np.searchsorted(statistics.terms, terms)]
    idf = np.log1p((statistics.n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / statistics.mean))
    # Added up in the order of the hashes, which is the same in every index.
    weight = np.rint(weight / np.bincount(item, weight, minlength=n)[item] * UNIT) / UNIT
    best = np.zeros(len(terms))
    np.maximum.at(best, term, weight)
    order = np.argsort(best, kind="stable")
    number = np.empty(len(terms), np.int64)
    number[order] = np.arange(len(terms))
    place = np.lexsort((item, number[term]))
    term, item, weight = number[term][place], item[place], weight[place]
    n_blocks = -(-n // BLOCK)
    block_keys, first = np.unique(term * n_blocks + item // BLOCK, return_index=True)
    parts = [split(t) for t in texts]
    return Index(
        ids=ids,
        terms=terms,
        term_of=number,
        best=best[order],
        start=np.searchsorted(term, np.arange(len(terms) + 1)),
        items=item,
        weights=weight,
        block_start=np.searchsorted(block_keys // n_blocks, np.arange(len(terms) + 1)),
        blocks=block_keys % n_blocks,
        by_block=_Table(block_keys, np.maximum.reduceat(weight, first), len(terms), n_blocks),
        by_item=_Table(term * n + item, weight, len(terms), n),
        n_blocks=n_blocks,
        questions=_grams([q for q, _ in parts]),
        answers=_grams([a for _, a in parts]),
        passage=passage,
    )


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places lo..hi of each row."""
    sizes = hi - lo
    row = np.repeat(np.arange(len(lo)), sizes)
    return row, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[row]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class _Table:
    """Weights by (term number, column), 0 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, terms: int, columns: int):
        self.keys, self.values, self.terms, self.columns = keys, values, terms, columns
        self.dense = None
        if terms * columns <= DENSE:
            self.dense = np.zeros(terms * columns, np.float32)
            self.dense[keys] = values

    def plain(self) -> tuple:
        return self.keys, self.values, self.terms, self.columns

    def __call__(self, term: np.ndarray, column: np.ndarray) -> np.ndarray:
        asked = term * self.columns + column
        if self.dense is not None:
            return self.dense[asked]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.values[at], 0.0)


def retrieve(index: Index, words: Words, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word, item, score) of all passages and items that reach the threshold."""
    passage = index.passage
    step = passage // 2
    h = words.hashes[0]
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == h)
    term = index.term_of[at[known]]
    counts = words.counts
    number = np.maximum(1, -(-(counts - step) // step))
    base = np.cumsum(number) - number
    text = np.searchsorted(words.first, known, side="right") - 1
    place = known - words.first[text]
    last = np.minimum(place // step, number[text] - 1)
    before = (last > 0) & (place < (last - 1) * step + passage)
    owner = np.concatenate([base[text] + last, (base[text] + last - 1)[before]])
    size = len(index.best)
    asked = _distinct(owner * size + np.concatenate([term, term[before]]))
    owner, term = asked // size, asked % size
    empty = np.zeros(0, np.int64)
    if not len(owner):
        return empty, empty, empty, empty, np.zeros(0)
    # Pivot: within a passage terms ascend by largest weight; before the first that lifts the sum to the threshold none can decide.
    total = np.cumsum(index.best[term])
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    group = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
    total -= (total[first] - index.best[term[first]])[group]
    deciding = total >= threshold - 1e-6
    row, spot = _expand(index.block_start[term[deciding]], index.block_start[term[deciding] + 1])
    led = _distinct(owner[deciding][row] * index.n_blocks + index.blocks[spot])
    bounds = np.append(first, len(owner))
    which = np.searchsorted(owner[first], led // index.n_blocks)
    found = []
    for lo in range(0, len(led), 4096):
        part, own = led[lo : lo + 4096], which[lo : lo + 4096]
        row, spot = _expand(bounds[own], bounds[own + 1])
        block = part % index.n_blocks
        bound = np.bincount(row, index.by_block(term[spot], block[row]), minlength=len(part))
        keep = bound >= threshold - 1e-6
        part, own = part[keep], own[keep]
        if not len(part):
            continue
        n = len(index.ids)
        cand, item = _expand(part % index.n_blocks * BLOCK, np.minimum((part % index.n_blocks + 1) * BLOCK, n))
        row, spot = _expand(bounds[own[cand]], bounds[own[cand] + 1])
        score = np.bincount(row, index.by_item(term[spot], item[row]), minlength=len(cand))
        hit = score >= threshold - 1e-6
        found.append((part[cand[hit]] // index.n_blocks, item[hit], score[hit]))
    if not found:
        return empty, empty, empty, empty, np.zeros(0)
    owner, item, score = (np.concatenate(c) for c in zip(*found))
    text = np.searchsorted(base, owner, side="right") - 1
    lo = words.first[text] + (owner - base[text]) * step
    return text, lo, np.minimum(lo + passage, words.first[text + 1]), item, score


def _share(wanted: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(wanted, there).mean()) if len(wanted) else 1.0


_LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passages", pa.int64())])
_LEAK_SQL = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,passages:bigint>>"


def _matches(indexes: list[Index], texts: pa.Array, threshold: float) -> list[list[dict]]:
    words = Words(texts, lower=True, breaks=SIGNS)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    runs = [words.rolling(size) for size in range(1, GRAM + 1)]
    for index in indexes:
        met: dict[tuple[int, int], dict] = {}
        for text, lo, hi, item, score in zip(*(x.tolist() for x in retrieve(index, words, threshold))):
            q, a = index.questions[item], index.answers[item]
            there = np.concatenate([run[lo : max(lo, hi - size)] for size, run in enumerate(runs)])
            asked, answered = _share(q, there), _share(a, there)
            whole = (asked * len(q) + answered * len(a)) / max(1, len(q) + len(a))
            if (asked >= OVERLAP and answered >= OVERLAP) or whole >= WHOLE:
                row = {"item_id": index.ids[item], "score": score, "question_overlap": asked, "answer_overlap": answered, "passages": 1}
                old = met.get((text, item))
                if old:
                    row = {**(row if score > old["score"] else old), "passages": old["passages"] + 1}
                met[text, item] = row
        for (text, _), row in met.items():
            out[text].append(row)
    return [sorted(rows, key=lambda r: tuple(r.values())) for rows in out]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and distinct terms of each item."""
    for batch in batches:
        for part in slices(batch, "t", SLICE_BYTES):
            words = Words(part.column("t"), lower=True, breaks=SIGNS)
            terms = [np.unique(words.hashes[0][lo:hi]).view(np.int64) for lo, hi in zip(words.first[:-1], words.first[1:])]
            columns = [part.column("part"), pa.array(words.counts.astype(np.int64)), pa.array(terms, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "words", "terms"])


def index_parts(
    benchmark: DataFrame,
    item: str = "item_id",
    item_text: str = "text",
    split: Callable[[str], tuple[str, str]] = question_and_answer,
    index_bytes: int = INDEX_BYTES,
) -> Iterator[list[Index]]:
    """The indexes of each part of the test items, `index_bytes` of text at a time: what the driver and a task hold is bounded by that."""
    known = benchmark.filter(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    size = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // index_bytes))
    known = known.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int"))
    counted = settled(known.mapInArrow(_counted, "part int, words bigint, terms array<bigint>").filter("words > 0"))
    n, total = counted.agg(F.count(F.lit(1)), F.sum("words")).first()
    if not n:
        return
    held = counted.select("part", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.collect_set("part").alias("parts"))
    held = settled(held) if parts > 1 else held
    for part in range(parts):
        rows = known.filter(F.col("part") == part).select("i", "t").orderBy("i", "t").collect()
        if not rows:
            continue
        found = held.filter(F.array_contains("parts", part)).select("term", "df").toPandas()
        terms = found["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(terms)
        statistics = Statistics(n, total / n, terms[order], found["df"].to_numpy(np.int64)[order])
        yield build_indexes([r["i"] for r in rows], [r["t"] for r in rows], statistics, split)


def _searched(docs: DataFrame, indexes: list[Index], text: str, threshold: float) -> DataFrame:
    """`docs`, which has a column `leaks`, with the items of these indexes added to it."""
    shared = docs.sparkSession.sparkContext.broadcast([index.plain() for index in indexes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Index.of(plain) for plain in shared.value]
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found = _matches(own, part.column(text), threshold)
                before = part.column("leaks").to_pylist()
                rows = [sorted((b or []) + f, key=lambda r: tuple(r.values())) for b, f in zip(before, found)]
                leaks = pa.array(rows, pa.list_(_LEAK))
                names = part.schema.names
                trim()
                yield pa.RecordBatch.from_arrays([leaks if n == "leaks" else part.column(n) for n in names], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, kinds)


def screen(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    threshold: float = THRESHOLD,
    item: str = "item_id",
    item_text: str = "text",
    split: Callable[[str], tuple[str, str]] = question_and_answer,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """`docs` with `leaks` added: the test items found in each text, with score, overlaps and number of passages.

    Passages are `PASSAGE` words every half passage, over the whole text, doubled for items of more than half of that; words are runs of
    letters and digits, A-Z lower-cased. An item is found where its score reaches `threshold` of its own and half of its question's
    and of its answer's 3-grams are there, or 60 % of all; a question or answer of one or two words is one gram, these words in a row.
    `split` cuts an item into question and answer. Null and empty texts leak nothing; items with null id, null text or without a word
    are ignored; repeated ids are items of their own. A column `leaks` is replaced. No shuffle. A benchmark above `index_bytes` is
    asked in parts with the same result; between them the rows are checkpointed, so that one index stands in memory at a time.
    """
    names = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*names).withColumn("leaks", F.lit(None).cast(_LEAK_SQL))
    for number, indexes in enumerate(index_parts(benchmark, item, item_text, split, index_bytes)):
        out = _searched(settled(out) if number else out, indexes, text, threshold)
    return out.withColumn("leaks", F.coalesce("leaks", F.array().cast(_LEAK_SQL)))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    split: Callable[[str], tuple[str, str]] = question_and_answer,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap, passages): one row per text and test item found in it.

    As `screen`, but the parts of a large benchmark are tasks of their own, and only what they find is put together.
    """
    rows = docs.select(key, text).withColumn("leaks", F.lit(None).cast(_LEAK_SQL))
    found = [_searched(rows, indexes, text, threshold) for indexes in index_parts(benchmark, split=split, index_bytes=index_bytes)]
    each = reduce(DataFrame.unionByName, found) if found else rows.filter(F.lit(False))
    return each.select(key, F.explode("leaks").alias("l")).select(key, "l.*")
