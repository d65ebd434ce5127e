"""Toxicity by compression distance.

Two zstandard dictionaries of equal size, trained by the library's cover algorithm, stand for ordinary and for toxic text. A third
is the ordinary one with the segments behind it that are typical of toxic text; the ordinary one has filler there that matches
nothing, so ordinary text costs the same in both. Every window compares how many bytes the toxic dictionary and the segments
save against the ordinary one. Features of these savings pass a logistic curve calibrated on texts that trained no dictionary.

Segments are kept if they occur in far more toxic than ordinary texts and no single context makes up most of their texts: a
passage copied through toxic texts has one context.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounded training sample: about so many texts of each label, drawn by hash, train the dictionaries, as many more calibrate.
SAMPLE = 2_000
LONGEST_SAMPLE = 100_000
GRAM = 5
# Words of the longest phrase, and bytes that the compressor can match.
PHRASE, MIN_MATCH = 3, 4
# Phrases are so many that chance makes some look typical; theirs is a likelihood ratio of about one in a million.
PHRASE_RATIO = 24
WINDOW, STEP = 256, 128
DICTIONARY_BYTES = 12_000
# A unit that has one context in more than this share of its toxic texts belongs to a copied passage.
COPIED = 0.5
_PAD = b" " + b"\x00" * 12
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode())


def _units(words: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """(unit, context): grams inside words, and between spaces whole words and phrases; the context adds the neighbours."""
    for k, word in enumerate(words):
        context = zlib.crc32(b" ".join(words[max(0, k - 1) : k + 2]))
        for i in range(len(word) - GRAM + 1):
            yield word[i : i + GRAM], context
        for n in range(1, min(PHRASE, len(words) - k) + 1):
            unit = b" " + b" ".join(words[k : k + n]) + b" "
            if len(unit) >= MIN_MATCH:
                yield unit, context if n == 1 else zlib.crc32(b" ".join(words[max(0, k - 1) : k + n + 1]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, toxic, docs): texts that hold the unit."""
    for batch in batches:
        seen: Counter = Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen.update((unit, toxic) for unit in {u for u, _ in _units(_words(text))})
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())],
            ["unit", "toxic", "docs"],
        )


def _in_context(wanted: dict[bytes, int]):
    """(unit, context, docs) of the wanted units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                seen.update({x for x in _units(_words(text)) if x[0] in wanted})
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())],
                ["unit", "context", "docs"],
            )

    return run


def _segments(word: bytes, counts: dict[bytes, int]) -> bytes | None:
    """The stretch of a word that its typical grams cover, without grams much rarer than its best."""
    at = [i for i in range(len(word) - GRAM + 1) if word[i : i + GRAM] in counts]
    if not at:
        return None
    top = max(counts[word[i : i + GRAM]] for i in at)
    at = [i for i in at if counts[word[i : i + GRAM]] * 2 >= top]
    return word[at[0] : at[-1] + GRAM]


def _marks(words: list[bytes], counts: dict[bytes, int]) -> set[bytes]:
    """Segments of a text: stretches of words, and typical whole words and phrases."""
    found = {_segments(w, counts) for w in words} | {u for u, _ in _units(words) if u[:1] == b" " and u in counts}
    return found - {None}


@dataclass
class Model:
    """Dictionaries as raw content, and the calibrated curve; without labels of both kinds every score is 0."""

    ordinary: bytes = b""
    toxic: bytes = b""  # the ordinary dictionary and the toxic segments
    trained: bytes = b""  # on toxic texts
    weights: list[float] = field(default_factory=list)

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters(
            window_log=max(15, (max(len(self.ordinary), len(self.toxic)) + WINDOW).bit_length()), hash_log=15, chain_log=15, search_log=3, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        out = []
        for content in (self.ordinary, self.toxic, self.trained):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))
        return out[0], out[1], out[2]


def _features(text: str | None, ordinary, toxic, trained) -> list[float]:
    """Of the bytes saved per window; neighbouring windows overlap, and what both save is no chance match."""
    raw = (text or "").lower().encode()
    pieces = [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP)]
    plain = np.array([len(ordinary.compress(p)) for p in pieces], float)
    saved = plain - [len(toxic.compress(p)) for p in pieces]
    closer = plain - [len(trained.compress(p)) for p in pieces]
    both = np.minimum(saved[1:], saved[:-1]) if len(saved) > 1 else saved
    best = np.sort(saved)[::-1]
    return [
        both.max(),
        np.maximum(both, 0).mean(),
        float(np.log1p(np.maximum(both - 1, 0).sum())),
        best[0],
        best[:3].mean(),
        (saved >= 3).mean(),
        float(np.log1p(len(saved))),
        closer.mean(),
        closer.max(),
    ]


def _curve(x: np.ndarray, y: np.ndarray, prior: float) -> list[float]:
    """Ridge logistic regression by Newton steps, shifted from the sample's to the corpus's share of toxic texts."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(slope, z.T @ (y - p) - 1e-2 * w)
    share = y.mean()
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return w.tolist()


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3))


def sample_labels(labels: DataFrame, key: str, sample: int) -> DataFrame:
    """(key, toxic, part): per label about 2 * sample ids by their hash, all if there are fewer, about half of them for each part."""
    once = labels.filter(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = dict(once.groupBy("toxic").count().collect())
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, min(1.0, 2 * sample / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return once.filter(draw < share * (1 << 30)).select(key, "toxic", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2)).alias("part"))


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(2 * DICTIONARY_BYTES, texts).as_bytes()[-DICTIONARY_BYTES:]
    except zstandard.ZstdError:  # too little text to train on
        return b" ".join(texts)[-DICTIONARY_BYTES:]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Dictionaries and curve from the bounded sample of labelled texts of up to LONGEST_SAMPLE characters."""
    shares = dict(labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").cast("int")).count().collect())
    if len(shares) < 2:
        return Model()
    chosen = sample_labels(labels, key, sample)
    found = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)  # about 4 * sample short rows
    # About 4 * sample texts of bounded length.
    texts = found.filter(F.length("text").between(1, LONGEST_SAMPLE)).select("text", "toxic", "part").repartition(8, F.xxhash64("text")).persist()
    first = texts.filter("part = 0")
    sizes = dict(first.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        texts.unpersist()
        return Model()
    least = max(3, sizes[1] // 100)
    stats = (
        first.mapInArrow(_counted, "unit binary, toxic int, docs bigint")
        .groupBy("unit")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("toxic"),
            F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("ordinary"),
        )
    )
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("ordinary") + 0.5) / (sizes[0] + 1))
    expected = (F.col("toxic") + F.col("ordinary")) * (sizes[1] / (sizes[0] + sizes[1]))
    sure = ~F.col("unit").cast("string").rlike("^ [^ ]+ [^ ]") | (2 * F.col("toxic") * F.log(F.col("toxic") / expected) > PHRASE_RATIO)
    typical = stats.filter((F.col("toxic") >= least) & (odds > 3) & sure)
    counts = {bytes(r[0]): r[1] for r in typical.select("unit", "toxic").collect()}
    # A copied passage gives its words one context in most of their texts; that share doesn't depend on the sample's size.
    top = (
        first.filter("toxic = 1").select("text").mapInArrow(_in_context(counts), "unit binary, context bigint, docs bigint")
        .groupBy("unit", "context").agg(F.sum("docs").alias("docs")).groupBy("unit").agg(F.max("docs").alias("top"))
    )
    copied = {bytes(r[0]) for r in top.collect() if r[1] > COPIED * counts[bytes(r[0])]}
    counts = {u: n for u, n in counts.items() if u not in copied}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(s for t in batch.column("text").to_pylist() for s in _marks(_words(t), counts))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["segment", "n"])

    ranked = first.filter("toxic = 1").select("text").mapInArrow(marked, "segment binary, n bigint").groupBy("segment").agg(F.sum("n").alias("n"))
    # Of segments that hold each other the commonest stays, or a longer one of about as many texts.
    core: dict[bytes, int] = {}
    for row in ranked.filter(F.col("n") >= least).orderBy(F.desc("n"), F.desc(F.length("segment")), "segment").collect():
        own, n = bytes(row[0]), row[1]
        inner = [c for c in core if c in own]
        if not any(own in c for c in core) and all(n >= 0.8 * core[c] for c in inner):
            core = {c: m for c, m in core.items() if c not in inner} | {own: n}
    base, trained = (
        _dictionary([r[0].lower().encode() for r in first.filter(F.col("toxic") == label).orderBy(F.xxhash64("text")).limit(sample).select("text").toLocalIterator()])
        for label in (0, 1)
    )
    tail = b" " + b" ".join(reversed(core))
    filler = bytes(range(1, 8)) * (len(tail) // 7) + bytes(range(1, 1 + len(tail) % 7))
    model = Model(base + filler + _PAD, base + tail + _PAD, trained + filler + _PAD)

    measured = texts.filter("part = 1").select("text", "toxic").mapInArrow(_measured(model, ["toxic"]), "toxic int, f array<double>").collect()
    texts.unpersist()
    y = np.array([r["toxic"] for r in measured], float)
    if len(set(y)) == 2:
        model.weights = _curve(np.array([r["f"] for r in measured]), y, shares[1] / (shares[0] + shares[1]))
    return model


def _measured(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            rows = [_features(t.as_py(), *compressors) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, pa.list_(pa.float64()))], [*names, "f"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """(key, held_out, score, predicted) of every whole text.

    `labels` has key and toxic (0 or 1; other values and null keys are ignored; of repeated keys the larger counts). Only labels of
    keys whose crc32 (of the key as text) mod 3 is not 1 are learnt from; that remainder is `held_out` (false for a null
    key). A null or empty text is scored like any other, from no saving at all. Without labels of both kinds, or
    texts for them, every score is 0. Repeated rows stay; other columns are ignored. Equal texts have equal scores.
    """
    model = train(docs, labels.filter(fold(F.col(key)) != 1), key, text, sample)
    rows = docs.select(F.col(key), F.coalesce(fold(F.col(key)) == 1, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    if not model.weights:
        return rows.select(key, "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    kind = docs.schema[key].dataType.simpleString()
    measured = rows.mapInArrow(_measured(model, [key, "held_out"]), f"`{key}` {kind}, held_out boolean, f array<double>")
    logit = F.lit(model.weights[0])
    for i, w in enumerate(model.weights[1:]):
        logit = logit + F.lit(w) * F.col("f")[i]
    scored = measured.withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(key, "held_out", "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
