"""Removal of repeated word sequences by fixed-block anchors.

Every text offers its non-overlapping blocks of `block` words as references, and every rolling window of `block` words of
every text probes them. `window = 2 * block - 1` words hold exactly one whole reference block, so a repeated window can't
be missed. Hits are extended to all windows around them; windows are compared by 80-bit hashes, the smallest doc_id that
holds one is found, and consecutive repeated windows join to maximal exact repeats.

Texts are dealt by hash into slices. What the shuffles carry per slice and hash bucket is one row of sorted, gap-coded keys
(distinct in the slice, so a passage in a third of all texts costs one key per slice), and the answer is a bit per key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.words import Words, from_planes, packed, planes, trim, unpacked

WINDOW = 13
SLICE_BYTES = 4 << 20
_KEY_BITS = np.uint64(27)
_KEYS = "slice int, bucket int, n int, a binary, b binary, c binary"
_ANSWERS = "slice int, bucket int, bits binary"


def _by_bucket(h: np.ndarray, buckets: int, bits: np.uint64) -> np.ndarray:
    """Sort key (bucket, low `bits` of the hash); the two come from different bits."""
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return (bucket << bits) | (h & ((np.uint64(1) << bits) - np.uint64(1)))


def _rows(slice_id: int, bucket: np.ndarray, columns: list, pack: list) -> list[tuple]:
    """One row per bucket of arrays sorted by bucket."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(0, int)
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        parts = [f(c[lo:hi]) for f, c in zip(pack, columns)]
        out.append((slice_id, int(bucket[lo]), int(hi - lo), *parts, *[b""] * (3 - len(parts))))
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    trim()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_KEY_SCHEMA = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ANSWER_SCHEMA = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


class _Slice:
    """Words and windows of the texts of one slice, sorted by doc_id; the same on every pass."""

    def __init__(self, table: pa.Table, key: str, text: str, window: int):
        ids = table.column(key)
        order = np.argsort(ids.fill_null(0).to_numpy(), kind="stable")
        self.table = table.take(pa.array(order))
        self.words = Words(self.table.column(text), lanes=2)
        known = self.table.column(key).is_valid().to_numpy(zero_copy_only=False).astype(bool)
        self.ids = self.table.column(key).fill_null(0).to_numpy()
        self.window, self.block = window, (window + 1) // 2
        counts = self.words.counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.doc)) - np.repeat(self.words.first[:-1], counts)
        self.takes_part = known & (counts >= window)

    def anchors(self, buckets: int):
        """(key of each rolling block or a mask, its words' positions): only texts with a whole window take part."""
        h = self.words.rolling(self.block)
        n = len(h)
        ok = self.words.inside(self.block) & self.takes_part[self.doc[:n]]
        at = np.flatnonzero(ok)
        keys = _by_bucket(h[at], buckets, _KEY_BITS)
        return keys, at

    def windows(self, hot: np.ndarray):
        """(hash lane 0, hash lane 1, positions) of the windows that hold a hot anchor; `hot` is per word position."""
        a, b = self.words.rolling(self.window), self.words.rolling(self.window, 1)
        n = len(a)
        sums = np.concatenate([[0], np.cumsum(hot)])
        reach = self.window - self.block + 1
        near = sums[reach : reach + n] - sums[:n] > 0
        at = np.flatnonzero(near & self.words.inside(self.window) & self.takes_part[self.doc[:n]])
        return a[at], b[at], at


def _anchor_keys(s: _Slice, buckets: int):
    """Distinct keys of the slice with flags: 1 a reference block, 2 in more than one text; and the inverse."""
    keys, at = s.anchors(buckets)
    distinct, inverse = np.unique(keys, return_inverse=True)
    flags = np.zeros(len(distinct), np.uint8)
    flags[inverse[s.place[at] % s.block == 0]] = 1
    doc = s.doc[at]
    low, high = np.full(len(distinct), len(s.ids)), np.full(len(distinct), -1)
    np.minimum.at(low, inverse, doc)
    np.maximum.at(high, inverse, doc)
    flags[low < high] |= 2
    return distinct, flags, inverse, at


def _window_keys(s: _Slice, hot: np.ndarray, buckets: int):
    """Distinct candidate windows in bucket order, their smallest doc_id, and the inverse."""
    a, b, at = s.windows(hot)
    bucket = ((a >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.lexsort((b & np.uint64(0xFFFF), a, bucket))
    a, b, at, bucket = a[order], (b[order] & np.uint64(0xFFFF)).astype(np.uint16), at[order], bucket[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    lowest = np.minimum.reduceat(s.ids[s.doc[at]], np.flatnonzero(new)) if len(a) else np.zeros(0, np.int64)
    return bucket[new], a[new], b[new], lowest, group, at


def _answered(answers: pa.Table, slice_buckets: np.ndarray) -> np.ndarray:
    """Bits of a slice's keys, given in bucket order."""
    out = np.zeros(len(slice_buckets), bool)
    for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
        lo, hi = np.searchsorted(slice_buckets, [bucket, bucket + 1])
        out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def _hot_positions(s: _Slice, answers: pa.Table, buckets: int) -> np.ndarray:
    distinct, flags, inverse, at = _anchor_keys(s, buckets)
    yes = _answered(answers, (distinct >> _KEY_BITS).astype(np.int64))
    hot = np.zeros(len(s.doc) + s.window, np.int64)
    hot[at[yes[inverse]]] = 1
    return hot


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`docs` with kept_text, n_words, n_removed, kept_sha256 and repeats (ARRAY of word spans start, end) added.

    A word goes if a window of `window` (odd) words covers it that also starts in a text with a smaller doc_id; windows are judged
    on the input. Words are `[^\\x20\\x09-\\x0D]+`, unchanged; kept words are joined by one space. Null, empty and short texts have no
    windows. Rows of equal doc_id do not remove each other's words; rows with a null doc_id neither lose words nor cause
    losses. Added columns replace columns of the same names. One row comes out per row that goes in.
    """
    added = ["kept_text", "n_words", "n_removed", "kept_sha256", "repeats"]
    rows = docs.select(*[c for c in docs.columns if c not in (*added, "_slice")])
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slices = max(16, -(-total // slice_bytes))
    buckets = max(64, slices)
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64(key, text), F.lit(slices)).cast("int")).repartition("_slice")

    def offer(table: pa.Table) -> pa.Table:
        s = _Slice(table, key, text, window)
        distinct, flags, _, _ = _anchor_keys(s, buckets)
        low = (distinct & np.uint64((1 << int(_KEY_BITS)) - 1)).astype(np.uint32)
        bucket = (distinct >> _KEY_BITS).astype(np.int64)
        slice_id = table.column("_slice")[0].as_py()
        return _table(_rows(slice_id, bucket, [low, flags], [packed, lambda x: x.tobytes()]), _KEY_SCHEMA)

    def match_anchors(table: pa.Table) -> pa.Table:
        """A key is hot if it is a reference block somewhere and stands in two texts."""
        sizes = table.column("n").to_numpy()
        keys = np.concatenate([unpacked(x, np.uint32) for x in table.column("a").to_pylist()])
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("b").to_pylist()])
        order = np.argsort(keys)
        k = keys[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        either = np.bitwise_or.reduceat(flags[order], new)
        hot = (either & 1 > 0) & ((either & 2 > 0) | (np.diff(np.append(new, len(k))) > 1))
        out = np.zeros(len(k), bool)
        out[order] = np.repeat(hot, np.diff(np.append(new, len(k))))
        return _answers(table, out, sizes)

    def extend(key_: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return _table([], _KEY_SCHEMA)
        s = _Slice(texts, key, text, window)
        bucket, a, b, lowest, _, _ = _window_keys(s, _hot_positions(s, answers, buckets), buckets)
        slice_id = texts.column("_slice")[0].as_py()
        return _table(_rows(slice_id, bucket.astype(np.int64), [a, b, lowest], [packed, lambda x: x.tobytes(), planes]), _KEY_SCHEMA)

    def match_windows(table: pa.Table) -> pa.Table:
        """A slice's window is repeated throughout the slice if another slice has it in a smaller doc_id."""
        sizes = table.column("n").to_numpy()
        a = np.concatenate([unpacked(x, np.uint64) for x in table.column("a").to_pylist()])
        b = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("b").to_pylist()])
        lowest = np.concatenate([from_planes(x, np.int64) for x in table.column("c").to_pylist()])
        order = np.lexsort((b, a))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order].astype(np.int32)) != 0)]))
        first = np.repeat(np.minimum.reduceat(lowest[order], new), np.diff(np.append(new, len(a))))
        out = np.zeros(len(a), bool)
        out[order] = first < lowest[order]
        return _answers(table, out, sizes)

    names = rows.columns

    def finish(key_: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return out_schema.empty_table()
        mine = answers.filter(pa.compute.equal(answers.column("step"), 1))
        later = answers.filter(pa.compute.equal(answers.column("step"), 2))
        s = _Slice(texts, key, text, window)
        bucket, _, _, lowest, group, at = _window_keys(s, _hot_positions(s, mine, buckets), buckets)
        yes = _answered(later, bucket.astype(np.int64))
        bad = yes[group] | (lowest[group] < s.ids[s.doc[at]])
        depth = np.zeros(len(s.doc) + 1, np.int64)
        np.add.at(depth, at[bad], 1)
        np.add.at(depth, at[bad] + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        return _cut(s, gone, names, out_schema)

    out_schema = _arrow_schema(rows)
    anchor_keys = dealt.groupBy("_slice").applyInArrow(offer, _KEYS)
    hot = anchor_keys.groupBy("bucket").applyInArrow(match_anchors, _ANSWERS)
    window_keys = dealt.groupBy("_slice").cogroup(hot.groupBy("slice")).applyInArrow(extend, _KEYS)
    repeated = window_keys.groupBy("bucket").applyInArrow(match_windows, _ANSWERS)
    answers = hot.withColumn("step", F.lit(1)).unionByName(repeated.withColumn("step", F.lit(2)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.groupBy("_slice").cogroup(answers.groupBy("slice")).applyInArrow(
        finish, f"{ddl}, kept_text string, n_words bigint, n_removed bigint, kept_sha256 string, repeats array<struct<start:bigint,end:bigint>>"
    )


def _arrow_schema(rows: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.schema([*to_arrow_schema(rows.schema), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("repeats", pa.list_(span))])


def _answers(table: pa.Table, out: np.ndarray, sizes: np.ndarray) -> pa.Table:
    trim()
    ends = np.cumsum(sizes)
    bits = [np.packbits(out[hi - n : hi]).tobytes() for n, hi in zip(sizes, ends)]
    return pa.Table.from_arrays([table.column("slice"), table.column("bucket"), pa.array(bits, pa.binary())], schema=_ANSWER_SCHEMA)


def _cut(s: _Slice, gone: np.ndarray, names: list[str], schema: pa.Schema) -> pa.Table:
    trim()
    data, starts, ends, first = s.words.data.tobytes(), s.words.starts, s.words.ends, s.words.first
    kept, removed, digests, spans = [], [], [], []
    for i in range(len(first) - 1):
        lo, hi = first[i], first[i + 1]
        g = gone[lo:hi]
        stay = np.flatnonzero(~g) + lo
        whole = b" ".join([data[starts[j] : ends[j]] for j in stay])
        kept.append(whole.decode("utf-8"))
        digests.append(hashlib.sha256(whole).hexdigest())
        removed.append(int(g.sum()))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
    own = [s.table.column(c).combine_chunks() for c in names]
    more = [pa.array(kept, pa.string()), pa.array(s.words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, schema.field("repeats").type)]
    return pa.Table.from_arrays([*own, *more], names=[*names, "kept_text", "n_words", "n_removed", "kept_sha256", "repeats"]).cast(schema)
