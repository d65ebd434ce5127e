"""Spelling variants by a bit-sliced position index.

A block of the vocabulary is an index of bitsets, one per (position, letter), with a bit per word. A query word walks its letters
once; at every letter four sets of words move on together: those that agree so far (zero errors), and, with one error behind them,
those that stand at the same position (a replaced letter), one ahead (the indexed word has a letter more) or one behind (a letter
less). Each step is a few ANDs and ORs over whole machine words, for all words of the block at once.

Words meet in blocks dealt by half-words: of two words one edit apart, the shorter of length s, either the first s // 2 letters or the
last s - s // 2 agree. A half that very many words share is cut into parts whose pairs are blocks of their own. A pair is counted where the
first half agrees, and by the last half only where the first does not: the zero-error set after s // 2 letters tells which.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.graph import small_batches
from fringeframe.operators.settle import settled

# Words of an index block, fewer for very long words: about this many letters at most, and at least LEAST words.
ROWS, LETTERS, LEAST = 4_096, 1 << 22, 64
QUERIES = 512
# Distinct words that a task counts before it hands them on.
HELD = 300_000
# Very long texts are counted in pieces of about this many characters.
PIECE = 1_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LETTER = "A-Za-zÀ-ÿ"


def _pieces(text: str) -> Iterator[str]:
    """The text cut at characters that are no letter."""
    lo, other = 0, re.compile(f"[^{_LETTER}]")
    while len(text) - lo > PIECE:
        found = other.search(text, lo + PIECE)
        if found is None:
            break
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:]


def count_words(docs: DataFrame, least_length: int = 5, drop_one_in: int = 97) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, that have `least_length` letters after the planted deletions.

    With h the crc32 of `<doc_id>:<run>` (a null doc_id reads `null`), a run for which `drop_one_in` divides h loses its letter
    h % length in that document. Null and empty texts hold no word; rows that repeat a doc_id count each.
    """
    run_of = re.compile(f"[{_LETTER}]{{{least_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                start = zlib.crc32(f"{key.as_py() if key.is_valid else 'null'}:".encode())
                for piece in _pieces(text.as_py() or ""):
                    for run, n in Counter(run_of.findall(piece.translate(_LOWER))).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % drop_one_in == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                        held[run] += n
                    if len(held) > HELD:
                        yield out()
        yield out()

    with small_batches(docs.sparkSession, 200):
        parts = docs.select("doc_id", "text").mapInArrow(counted, "word string, n bigint")
        return settled(parts.groupBy("word").agg(F.sum("n").alias("n")))


def _keyed(words: DataFrame) -> DataFrame:
    """(word, n, s, side, u): each word under the halves it may share with a word of its length or one more (s: its length), or of one less."""
    m = F.length("word")

    def halves(s):
        h = F.floor(s / 2).cast("int")
        return [
            F.struct(s.alias("s"), F.lit(0).alias("side"), F.xxhash64(s, F.lit(0), F.substring("word", 1, h)).alias("u")),
            F.struct(s.alias("s"), F.lit(1).alias("side"), F.xxhash64(s, F.lit(1), F.substring("word", m - (s - h) + 1, s - h)).alias("u")),
        ]

    return words.select("word", "n", F.explode(F.array(*halves(m), *halves(m - 1))).alias("k")).select("word", "n", "k.*")


def _dealt(keyed: DataFrame, rows: int) -> DataFrame:
    """Rows with the block they ask (role 1), stand in (role 2) or both (3); parts of a hot half meet pairwise."""
    most = F.least(F.lit(rows), F.greatest(F.lit(LEAST), F.floor(F.lit(LETTERS) / F.col("s")))).cast("int")
    sizes = keyed.groupBy("s", "side").agg(F.count(F.lit(1)).alias("all")).select("s", "side", F.ceil(F.col("all") / most).alias("blocks"))
    hot = keyed.groupBy("s", "u").agg(F.count(F.lit(1)).alias("own")).filter(F.col("own") > most)
    hot = hot.select("u", F.ceil(F.col("own") / most).cast("int").alias("parts"))
    both = keyed.join(sizes, ["s", "side"]).join(hot, "u", "left")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(3).alias("role")))).otherwise(
        F.concat(
            F.transform(every, lambda j: F.struct(part.alias("i"), j.alias("j"), F.lit(1).alias("role"))),
            F.transform(every, lambda i: F.struct(i.alias("i"), part.alias("j"), F.lit(2).alias("role"))),
        )
    )
    block = F.when(F.col("parts").isNull(), F.pmod("u", "blocks")).otherwise(F.col("u"))
    return both.withColumn("hot", F.col("parts").isNotNull()).withColumn("block", block).withColumn("c", F.explode(cells)).select(
        "word", "n", "s", "side", "hot", "block", "c.*"
    )


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [*[(0, 0)] * (packed.ndim - 1), (0, short)])).view(np.uint64)


def _position(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of one position, ascending, and their bitsets; a last, empty bitset for any other letter."""
    letters = np.unique(codes)
    return letters, np.concatenate([_bits(codes == letters[:, None]), np.zeros((1, -(-len(codes) // 64)), np.uint64)])


def _of(position: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> np.ndarray:
    letters, sets = position
    at = np.searchsorted(letters, asked)
    at[(at == len(letters)) | (letters[np.minimum(at, len(letters) - 1)] != asked)] = len(letters)
    return sets[at]


def near_sets(index: np.ndarray, queries: np.ndarray, s: int, same_start: bool) -> np.ndarray:
    """(queries, words / 64) bitsets of the indexed words exactly one edit away from each query.

    Both are matrices of code points of width s + 1, 0 where the word is shorter; words have s or s + 1 letters, and of two words of s + 1
    no answer is given. With `same_start` the first s // 2 letters have to agree, without it they must not.
    """
    positions = [_position(index[:, i]) for i in range(s + 1)]
    wide = _bits(index[:, s] != 0)
    slim = _bits(index[:, s] == 0)
    shape = (len(queries), wide.shape[-1])
    exact = np.broadcast_to(wide | slim, shape)
    replaced = ahead = behind = np.zeros(shape, np.uint64)
    start = exact
    for i in range(s):
        c = queries[:, i]
        here = _of(positions[i], c)
        replaced = (replaced & here) | (exact & ~here)
        ahead = (ahead | exact) & _of(positions[i + 1], c)
        behind = ((behind & _of(positions[i - 1], c)) | exact) if i else exact
        exact = exact & here
        if i + 1 == s // 2:
            start = exact
    short = (replaced & slim) | ((ahead | exact) & wide)
    long = ((behind & _of(positions[s - 1], queries[:, s])) | exact) & slim
    return np.where((queries[:, s] == 0)[:, None], short, long) & (start if same_start else ~start)


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def _block(group: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best): of each asking word with a near word in this block."""
    s, side = group.column("s")[0].as_py(), group.column("side")[0].as_py()
    role = group.column("role").to_numpy()
    words, n = np.array(group.column("word").to_pylist(), object), group.column("n").to_numpy()
    stand, ask = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
    # Most frequent first, then in code-point order: the first bit of a set is its best word.
    stand = np.array(sorted(stand, key=lambda i: (-n[i], words[i])), np.int64)
    out = []
    if len(stand) and len(ask):
        index = _codes(list(words[stand]), s + 1)
        for lo in range(0, len(ask), QUERIES):
            own = ask[lo : lo + QUERIES]
            sets = near_sets(index, _codes(list(words[own]), s + 1), s, side == 0)
            found = np.bitwise_count(sets).sum(axis=1).astype(np.int64)
            some = np.flatnonzero(found)
            first = np.unpackbits(sets[some].view(np.uint8), axis=1, bitorder="little").argmax(axis=1) if len(some) else some
            out.append((words[own[some]], found[some], n[stand[first]], words[stand[first]]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], [], []]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, rows: int = ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of `words` (word, n) that have another one edit away: their number and the most frequent one."""
    dealt = _dealt(_keyed(words), rows)
    found = dealt.groupBy("s", "side", "hot", "block", "i", "j").applyInArrow(_block, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")
    )


def follow(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root): the end of the chain word -> form -> its form of at most `hops` steps; the reach doubles with every round."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(hops, 1))))):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = settled(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return at


def group_spellings(docs: DataFrame, least_length: int = 5, least_n: int = 3, times: int = 2, drop_one_in: int = 97, rows: int = ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that stands `least_n` times in the texts of `docs` (doc_id, text).

    form is the near word (one letter inserted, deleted or replaced) of largest n, ties to the smaller in code-point order, if it stands
    at least `times` as often, else null with form_n; root is where following the forms ends (the word itself without a form).
    Null, empty and letterless texts add nothing, an empty table gives no row; extra columns of `docs` are not read.
    `times` has to be above 1, so that forms have no cycle and a chain is as long as n can grow by it.
    """
    if times <= 1:
        raise ValueError("times has to be above 1")
    words = settled(count_words(docs, least_length, drop_one_in).filter(F.col("n") >= least_n))
    near = near_words(words, rows)
    formed = F.col("best_n") >= times * F.col("n")
    judged = settled(
        words.join(near, "word", "left").select(
            "word",
            F.when(formed, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        )
    )
    top = judged.agg(F.max("n")).first()[0] or 1
    roots = follow(judged.filter("form IS NOT NULL"), int(math.log(max(top / least_n, 1), times)) + 2)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
