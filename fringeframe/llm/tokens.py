"""Token counts with overlap resynchronisation for huge documents.

Small texts are encoded whole. A huge text is cut into chunks that overlap; each chunk is encoded with offsets, and
neighbours are spliced at a boundary that both encodings have and that no pre-token can cross: a character that is not
white space, followed by ASCII white space. Where an overlap has no such boundary it is doubled, at last to the whole text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.operators.settle import settled

CHUNK = 32_768
OVERLAP = 512
# Characters on which both encoders were compared one by one (tests/llm/test_text_operators.py); other texts go to the library itself.
_PLAIN = re.compile(r"[\x00-\x7f\xa1-\u024f\u2010-\u2027\u2030-\u203a\u20ac]*")
_STABLE = re.compile(r"\S(?=[ \n\t\r\f\v])")


class Encoder:
    """Counts of the tokenizer file, with special strings handled as the library does by default.

    The same vocabulary as ranks (`<name>.tiktoken` beside `<name>.json`) encodes faster with equal results on plain
    characters; every other text goes to the library of the .json file.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)

    def count(self, text: str) -> int:
        if self.fast is not None and _PLAIN.fullmatch(text):
            return len(self.fast.encode(text, allowed_special="all"))
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def starts(self, text: str) -> list[int]:
        """Character offset at which each token starts."""
        if self.fast is not None and _PLAIN.fullmatch(text):
            return self.fast.decode_with_offsets(self.fast.encode(text, allowed_special="all"))[1]
        return [a for a, _ in self.library.encode(text, add_special_tokens=False).offsets]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts = [own.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["_row", "n_bytes", "n_tokens"])

    return run


def _spans(path: str, overlap: int, chunk: int):
    """Per chunk: the splice boundary in its head and in its tail, and the tokens between (null: no boundary)."""

    def boundary(text: str, lo: int, hi: int, starts: dict[int, int]) -> int | None:
        for m in _STABLE.finditer(text, lo, hi):
            if m.end() in starts:
                return m.end()
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            spans = []
            for k, last, text in zip(*(batch.column(c).to_pylist() for c in ("k", "last", "piece"))):
                tokens = own.starts(text)
                starts: dict[int, int] = {}
                for i, at in enumerate(tokens):
                    starts.setdefault(at, i)
                head = 0 if k == 0 else boundary(text, 0, overlap, starts)
                tail = len(text) if last else boundary(text, chunk, len(text), starts)
                n = None
                if head is not None and tail is not None:
                    n = (len(tokens) if last else starts[tail]) - starts.get(head, 0)
                spans.append([None if x is None else k * chunk + x for x in (head, tail)] + [n])
            head, tail, n = (pa.array(c, pa.int64()) for c in (zip(*spans) if spans else ([], [], [])))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_row", "a", "b", "n_bytes", "k")), head, tail, n],
                ["_row", "a", "b", "n_bytes", "k", "head", "tail", "n"],
            )

    return run


_SAME = ["_row", "a", "b", "n_bytes"]


def _splice(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(_row, a, b, n_bytes, times, n_tokens) of huge texts; n_tokens is null where an overlap had no common boundary."""
    last = F.ceil(F.length("text") / chunk) - 1
    cut = long.select(*_SAME, "text", last.alias("top"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    pieces = cut.select(
        *_SAME,
        "k",
        (F.col("k") == F.col("top")).alias("last"),
        F.substring(F.col("text"), F.col("k").cast("int") * chunk + 1, F.lit(chunk + overlap)).alias("piece"),
    ).withColumn("piece", F.when(F.col("last"), F.substring("piece", 1, chunk)).otherwise(F.col("piece")))
    spans = pieces.repartition("_row", "a", "k").mapInArrow(
        _spans(path, overlap, chunk), "_row bigint, a bigint, b bigint, n_bytes bigint, k bigint, head bigint, tail bigint, n bigint"
    )
    once = spans.groupBy(*_SAME, "k").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"))
    parts = F.array_sort(F.collect_list(F.struct("k", "head", "tail", "n")))
    whole = once.groupBy(*_SAME).agg(parts.alias("p"), F.max("times").alias("times"))
    seams = F.sequence(F.lit(1), F.size("p") - 1)
    meets = F.forall(seams, lambda i: F.coalesce(F.col("p")[i - 1]["tail"] == F.col("p")[i]["head"], F.lit(False)))
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return whole.select(*_SAME, "times", F.when((F.size("p") == 1) | meets, total).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text, one row per input row.

    `path` is the tokenizer's .json file, present on every executor. No begin, end or added special tokens; a special
    string inside a text is one token, the library's default. Null and empty texts have 0 tokens; null and repeated keys
    keep their rows; other columns are ignored. Texts longer than two chunks are cut into chunks spread over the cluster;
    a text whose overlaps have no common boundary comes back with overlaps doubled until they span the text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("_row"), F.octet_length(whole).cast("bigint").alias("n_bytes"), whole.alias("text"))
    huge = F.length("text") > 2 * chunk
    schema = "_row bigint, n_bytes bigint, n_tokens bigint"
    done = rows.filter(~huge).select("_row", "n_bytes", "text").mapInArrow(_counted(path), schema)
    long = rows.filter(huge).select("_row", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), "n_bytes", "text")
    longest = long.agg(F.max(F.length("text"))).first()[0] or 0
    left = long
    while longest:
        spliced = settled(_splice(left, path, chunk, overlap))
        good = spliced.filter("n_tokens is not null").select("_row", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
        done = done.unionByName(good.select("_row", "n_bytes", "n_tokens"))
        failed = spliced.filter("n_tokens is null").select(*_SAME)
        if failed.isEmpty():
            break
        left = left.join(failed, (left["_row"].eqNullSafe(failed["_row"])) & (left["a"] == failed["a"]) & (left["b"] == failed["b"]), "left_semi")
        overlap *= 2
        if overlap >= longest:
            done = done.unionByName(left.select("_row", "n_bytes", "text").mapInArrow(_counted(path), schema))
            break
    return done.select(F.col("_row").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
