"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct word shingles. XOR-hashing a set into bits gives a parity sketch: every element of the
symmetric difference of two sets flips one bit, so the Hamming distance of sketches never exceeds that difference. Two linked
sets of a and b shingles differ by at most (1 - t) / (1 + t) * (a + b). Per size band the sketch is cut into more bands than
that bound, so linked sets agree on at least one band (pigeonhole): equal bands propose pairs, sketches drop those too far
apart (one of 1,024 bits, then one of about four bits per shingle), and the shingle sets decide.

Bands of parity zero are never offered as keys, as they would be hot. A set with so many of them that a pair might agree on those
alone is offered again under the next hash seed, until it is not; a pair that is missed under one seed is such a set on both
sides, so no link is lost. Equal sets are one class and offer keys once per slice of texts.

Of each key's documents, the smallest is proposed with all others, and each document's smallest such partner is verified first.
Then only documents of different components that share a key are compared. Candidates are filtered before they are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.graph import compact, components, joins_by_shuffle, small_batches
from fringeframe.llm.words import Words, from_planes, mix, packed, planes, slices, trim, unpacked
from fringeframe.operators.settle import settled

SHINGLE = 5
PERCENT = 80
SLICE_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
FILTER_BITS = 25
# 64-bit words of the short sketch that candidates carry.
SKETCH = 16
MAX_SEEDS = 256
_KEY_BITS = np.uint64(32)


def size_bands(limit: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each band, largest symmetric difference of a linked pair whose smaller set is in it).

    A set's partners of at least its size lie in its own band or the next.
    """
    starts = [1]
    while starts[-1] <= limit:
        starts.append(starts[-1] * 100 // percent + 1)
    top = np.array(starts[1:]) - 1
    most = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    return np.array(starts), most


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, number per text)."""
    words = Words(texts, lower=True)
    h = words.rolling(size)
    short = words.hashes[0]
    out, counts = [], []
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        if hi - lo >= size:
            s = np.unique(h[lo : hi - size + 1])
        elif hi > lo:
            s = np.array([hi - lo], np.uint64)
            for i in range(lo, hi):
                s = mix(s * np.uint64(0x9E3779B97F4A7C15) + short[i : i + 1])
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        counts.append(len(s))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def _fingerprints(h: np.ndarray, doc: np.ndarray, bands: np.ndarray, seed: int) -> np.ndarray:
    """Fingerprints of parity bands, `bands[d]` of them for document d, one document after the other.

    Every shingle flips one bit of a band of 2**64 bits; the XOR of the flipped positions stands for the band, 0 for an empty one.
    """
    base = np.cumsum(bands) - bands
    r = mix(h + np.uint64(0x632BE59BD9B4E019 * (seed + 1) & (2**64 - 1)))
    slot = base[doc] + (((r >> np.uint64(32)) * bands[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    out = np.zeros(int(bands.sum()), np.uint64)
    np.bitwise_xor.at(out, slot, mix(r))
    return out


def _sketches(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(docs, SKETCH) parity sketches of 64 bits a word."""
    r = mix(h ^ np.uint64(0x8CB92BA72F3D8DD7))
    out = np.zeros(docs * SKETCH, np.uint64)
    np.bitwise_xor.at(out, doc * SKETCH + (((r >> np.uint64(32)) * np.uint64(SKETCH)) >> np.uint64(32)).astype(np.int64), np.uint64(1) << (r & np.uint64(63)))
    return out.view(np.int64).reshape(-1, SKETCH)


def _wide_sketches(h: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Parity sketches of 4 to 8 bits per shingle, a power of two and at least 64, as bytes.

    Half a sketch XOR its other half is the sketch of half the bits, so those of different lengths can be compared.
    """
    words = np.maximum(1, 1 << np.maximum(0, np.ceil(np.log2(np.maximum(4 * counts, 1))).astype(np.int64) - 6))
    base = np.cumsum(words) - words
    doc = np.repeat(np.arange(len(counts)), counts)
    r = mix(h ^ np.uint64(0x3C79AC492BA7B653))
    at = r & (words[doc].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, base[doc] + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    ends = np.concatenate([[0], np.cumsum(words * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches, the longer one folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("x_sketch", "y_sketch"))
            total = batch.column("total").to_numpy()
            ok = [sketch_distance(p, q) * (100 + percent) <= t * (100 - percent) for p, q, t in zip(a, b, total.tolist())]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["x", "y"])

    return run


def band_keys(h: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, document of each): two linked sets share at least one key."""
    keys, owners = [], []
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, most = size_bands(int(counts.max()), percent)
    own = np.searchsorted(starts, counts, side="right") - 1
    first = np.cumsum(counts) - counts
    for below in (0, 1):
        docs = np.flatnonzero((counts > 0) & (own >= below))
        for seed in range(MAX_SEEDS):
            if not len(docs):
                break
            band = own[docs] - below
            limit = most[band]
            bands = limit + 3 + limit // 8
            sizes = counts[docs]
            member = np.repeat(first[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            patterns = _fingerprints(h[member], np.repeat(np.arange(len(docs)), sizes), bands, seed)
            owner = np.repeat(np.arange(len(docs)), bands)
            place = np.arange(len(patterns)) - np.repeat(np.cumsum(bands) - bands, bands)
            tag = mix((band[owner] * MAX_SEEDS + seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) + np.uint64(1))
            full = patterns != 0
            blank = np.bincount(owner[~full], minlength=len(docs)) >= bands - limit
            if seed == MAX_SEEDS - 1:
                full |= blank[owner]
            keys.append(mix(patterns[full] * np.uint64(0xD6E8FEB86659FD93) + tag[full]))
            owners.append(docs[owner[full]])
            docs = docs[blank]
    return np.concatenate(keys), np.concatenate(owners)


def _digest(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set."""
    ends = np.cumsum(counts)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[ends] - total[ends - counts]).view(np.int64))
    return out[0], out[1]


_SHORT = [f"k{i}" for i in range(SKETCH)]


def _described(key: str, text: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                h, counts = shingle_sets(part.column(text), size)
                a, b = _digest(h, counts)
                sketch = _sketches(h, np.repeat(np.arange(len(counts)), counts), len(counts))
                trim()
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(counts), pa.array(a), pa.array(b), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH)), _wide_sketches(h, counts)],
                    ["doc", "n", "s1", "s2", *_SHORT, "sketch"],
                )

    return run


_OFFER_SCHEMA = pa.schema([("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("x", pa.int64()), ("y", pa.int64()), ("key", pa.int64())])
_PAIR_SCHEMA = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("key", pa.int64())])


def _offers(key: str, text: str, size: int, percent: int, buckets: int):
    """Per slice and bucket one row of sorted keys, the smallest doc_id of each and a flag if the slice has more; and those as pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(batch.column(key).is_valid()), text, SLICE_BYTES):
                h, counts = shingle_sets(part.column(text), size)
                ids = part.column(key).to_numpy()
                a, b = _digest(h, counts)
                order = np.lexsort((ids, b, a))
                same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
                lead = np.zeros(len(ids), bool)
                lead[order[np.concatenate([[True], ~same])]] = True
                keep = np.repeat(lead, counts)
                keys, owner = band_keys(h[keep], counts[lead], percent)
                ids = ids[lead]
                order = np.lexsort((ids[owner], keys))
                keys, ids_of = keys[order], ids[owner[order]]
                new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                more = np.diff(np.append(at, len(keys))) > 1
                bucket = ((keys[at] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                low = (keys[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                place = np.lexsort((low, bucket))
                bucket, low, lowest, flag = bucket[place].astype(np.int64), low[place], ids_of[at][place], more[place]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(0, int)
                rows = [
                    (int(bucket[lo]), packed(low[lo:hi]), planes(lowest[lo:hi]), flag[lo:hi].tobytes())
                    for lo, hi in zip(cuts, [*cuts[1:], len(bucket)])
                    if hi > lo
                ]
                other = np.flatnonzero(~new)
                pairs = (ids_of[at[group[other]]], ids_of[other], _public(keys[other], buckets))
                trim()
                yield _batch(_OFFER_SCHEMA, [*zip(*rows)] if rows else [[]] * 4, pairs)

    return run


def _public(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low bits of a key as one number, as the buckets know it."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return ((bucket << _KEY_BITS) | (keys & np.uint64(0xFFFFFFFF))).view(np.int64)


def _batch(schema: pa.Schema, offers: list, pairs: tuple) -> pa.RecordBatch:
    n, m = len(offers[0]), len(pairs[0])
    left = [pa.concat_arrays([pa.array(c, f.type), pa.nulls(m, f.type)]) for c, f in zip(offers, schema)]
    right = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c, pa.int64())]) for c in pairs]
    return pa.RecordBatch.from_arrays([*left, *right], schema=schema)


def _propose(table: pa.Table) -> pa.Table:
    """(x, y, key): the smallest document of each key with every other one; key is null where just two have it."""
    keys = np.concatenate([unpacked(v, np.uint32) for v in table.column("a").to_pylist()])
    ids = np.concatenate([from_planes(v, np.int64) for v in table.column("b").to_pylist()])
    flags = np.concatenate([np.frombuffer(v, np.uint8) for v in table.column("c").to_pylist()])
    bucket = np.int64(table.column("bucket")[0].as_py())
    order = np.argsort(keys)
    k = keys[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(new, len(k)))
    wanted = np.repeat(sizes > 1, sizes)
    order, k = order[wanted], k[wanted]
    order = order[np.lexsort((ids[order], k))]
    k, i, flags = keys[order], ids[order], flags[order]
    if not len(k):
        return _PAIR_SCHEMA.empty_table()
    new = np.concatenate([[True], k[1:] != k[:-1]])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    trim()
    plain = (np.diff(np.append(at, len(k))) == 2) & (np.maximum.reduceat(flags, at) == 0)
    x, y, full = i[at[group]], i, (bucket << np.int64(32)) | k.astype(np.int64)
    other = ~new & (x != y)
    two = other & plain[group]
    pairs = np.unique(np.column_stack([x[two], y[two]]), axis=0)
    rest = other & ~plain[group]
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate([pairs[:, 0], x[rest]])),
            pa.array(np.concatenate([pairs[:, 1], y[rest]])),
            pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(full[rest])]),
        ],
        schema=_PAIR_SCHEMA,
    )


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit per hash slot of the column `doc`; its size is fixed, whatever the number of ids."""
    words = ids.select(_slot(F.col("doc")).alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("s") % 64).cast("int"))).alias("bits")
    )
    found = words.toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[found["w"].to_numpy(int)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _filter(ids: DataFrame):
    """Function of a slot: false if no id of the column `doc` has it."""
    shared = ids.sparkSession.sparkContext.broadcast(_filter_bits(ids))

    @F.pandas_udf("boolean")
    def maybe(slot: pd.Series) -> pd.Series:
        s = slot.to_numpy(np.int64)
        return pd.Series((shared.value[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return maybe


def _sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(doc, shingles) of the documents in `wanted` (doc), and of some others: a filter of fixed size drops most others early."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            near = (shared.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            for part in slices(batch.filter(pa.array(near.astype(bool))), text, SLICE_BYTES):
                h, counts = shingle_sets(part.column(text), size)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                trim()
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], ["doc", "shingles"])

    rows = docs.filter(F.col(key).isNotNull()).select(key, text, _slot(F.col(key)).alias("slot"))
    return rows.mapInArrow(run, "doc bigint, shingles array<bigint>").join(wanted, "doc", "left_semi")


def _possible(percent: int) -> Column:
    """Sizes and short sketches (n, k0 and on, of x_ and y_) that a linked pair may have."""
    apart = sum((F.bit_count(F.col(f"x_{k}").bitwiseXOR(F.col(f"y_{k}"))) for k in _SHORT), F.lit(0))
    total = F.col("x_n") + F.col("y_n")
    return (apart * (100 + percent) <= total * (100 - percent)) & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)


def _side(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(*[F.col(c).alias(f"{side}_{c}") for c in classes.columns])


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, class_id) of every document.

    Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer than `size` words is one shingle, a null or empty one has none and
    is linked with nothing. Linked: 100 * intersection >= percent * union. class_id is the smallest key with the same set,
    component_id the smallest key that links reach. `key` is a BIGINT; rows with a null key take no part and have null
    ids; rows that repeat a key stay rows and are one document whose texts are all linked. Other columns are ignored.
    """
    return links(docs, key, text, size, percent)[0]


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """`similar_documents` and the verified links (x, y) between classes of different sets that its components rest on."""
    with small_batches(docs.sparkSession), joins_by_shuffle(docs.sparkSession):
        return _links(docs, key, text, size, percent)


def _links(docs: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(key).cast("bigint").alias(key), text)
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_BYTES))
    described = settled(
        rows.mapInArrow(_described(key, text, size), "doc bigint, n bigint, s1 bigint, s2 bigint, " + ", ".join(f"{k} bigint" for k in _SHORT) + ", sketch binary")
    )
    known = described.filter("doc is not null")
    classes = settled(known.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), *[F.first(k).alias(k) for k in _SHORT]))
    mapped = known.filter("n > 0").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("doc", "rep")
    of = compact(mapped.distinct())
    offers = rows.mapInArrow(
        _offers(key, text, size, percent, buckets), "bucket bigint, a binary, b binary, c binary, x bigint, y bigint, key bigint"
    )
    # One pass over the texts serves both kinds of row: the pairs within slices go through the bucket shuffle as they are.
    routed = offers.withColumn("bucket", F.coalesce("bucket", -F.pmod(F.xxhash64("x", "y", "key"), F.lit(buckets)) - 1))

    def propose(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["x", "y", "key"]).cast(_PAIR_SCHEMA)
        return _propose(table)

    proposed = compact(routed.groupBy("bucket").applyInArrow(propose, "x bigint, y bigint, key bigint"))
    sized = classes.select("rep", "n", *_SHORT)

    wide = known.select("doc", "sketch")

    def judged(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of classes (x < y) whose sizes and short sketches allow a link."""
        a, b = _side(sized, "x"), _side(sized, "y")
        near = pairs.join(a, pairs["x"] == a["x_rep"]).join(b, pairs["y"] == b["y_rep"]).filter(_possible(percent))
        return near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("x_n") + F.col("y_n")).alias("total")).distinct()

    def close(pairs: DataFrame) -> DataFrame:
        """Those of them (x, y, total) whose wide sketches allow a link, too."""
        a, b = _side(wide, "x"), _side(wide, "y")
        both = pairs.join(a, pairs["x"] == a["x_doc"]).join(b, pairs["y"] == b["y_doc"])
        return compact(both.select("x", "y", "total", "x_sketch", "y_sketch").mapInArrow(_near(percent), "x bigint, y bigint").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("x").alias("doc")).unionByName(pairs.select(F.col("y").alias("doc"))).distinct()
        sets = _sets_of(rows, wanted, key, text, size)
        a, b = _side(sets, "x"), _side(sets, "y")
        both = pairs.join(a, pairs["x"] == a["x_doc"]).join(b, pairs["y"] == b["y_doc"])
        shared = F.size(F.array_intersect("x_shingles", "y_shingles"))
        union = F.size("x_shingles") + F.size("y_shingles") - shared
        return both.filter(shared * 100 >= union * percent).select("x", "y").distinct()

    ox, oy = of.select(F.col("doc").alias("x"), F.col("rep").alias("rx")), of.select(F.col("doc").alias("y"), F.col("rep").alias("ry"))
    first = proposed.select("x", "y").distinct().join(ox, "x").join(oy, "y").filter("rx <> ry")
    first = judged(first.select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct())
    first = close(first)
    repeated = of.groupBy("doc").agg(F.min("rep").alias("x"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    same = of.join(repeated.select("doc", "x"), "doc").filter("x <> rep").select("x", F.col("rep").alias("y"))
    nearest = first.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    linked = compact(verified(nearest).unionByName(same).distinct())
    found = components(linked.select(F.col("x").alias("a"), F.col("y").alias("b")))

    # Keys whose documents are not all in one component yet.
    keyed = proposed.filter("key is not null")
    members = keyed.select("key", F.col("x").alias("doc")).unionByName(keyed.select("key", F.col("y").alias("doc")))
    members = compact(members.join(of, "doc").select("key", "rep").distinct())

    def undecided(found: DataFrame) -> DataFrame:
        """(key, rep, component) of the keys with documents of several components."""
        placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        return compact(placed.join(split, "key", "left_semi"))

    # First the smallest document of a key's smallest component with the smallest of each other one: most of them merge.
    heads = undecided(found).groupBy("key", "component").agg(F.min("rep").alias("r"))
    lead = heads.groupBy("key").agg(F.min(F.struct("component", "r")).alias("lead"))
    stars = heads.join(lead, "key").filter(F.col("component") != F.col("lead.component"))
    stars = stars.select(F.least("r", "lead.r").alias("x"), F.greatest("r", "lead.r").alias("y")).distinct()
    stars = close(judged(stars.join(nearest, ["x", "y"], "left_anti")))
    if not stars.isEmpty():
        linked = compact(linked.unionByName(verified(stars)))
        found = components(linked.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # Then all documents of components that are still apart.
    open_ = undecided(found).join(sized, "rep")
    a, b = _side(open_, "x"), _side(open_, "y")
    apart = a.join(b, (a["x_key"] == b["y_key"]) & (a["x_component"] < b["y_component"])).filter(_possible(percent))
    apart = apart.select(F.least("x_rep", "y_rep").alias("x"), F.greatest("x_rep", "y_rep").alias("y"), (F.col("x_n") + F.col("y_n")).alias("total"))
    second = close(apart.distinct().join(first, ["x", "y"], "left_anti")).unionByName(first)
    cx, cy = found.select(F.col("node").alias("x"), F.col("component").alias("cx")), found.select(F.col("node").alias("y"), F.col("component").alias("cy"))
    second = second.join(cx, "x", "left").join(cy, "y", "left").filter(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("x", "y")
    second = compact(second.join(nearest, ["x", "y"], "left_anti"))
    if not second.isEmpty():
        linked = compact(linked.unionByName(verified(second)))
        found = components(linked.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labelled = classes.select("n", "s1", "s2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("n", "s1", "s2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    out = described.select("doc", "n", "s1", "s2").join(labelled, ["n", "s1", "s2"], "left")
    own = lambda c: F.when(F.col("doc").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce(c, "doc")).alias(c)
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), own("component_id"), own("class_id")), linked


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` without all but one document of each group of linked ones: the row of smallest key stays, one of them if it repeats.

    Rows with a null key stay. Only rows that a filter of fixed size can't clear meet the list of keys to drop.
    """
    found = similar_documents(docs, key, text, size, percent)
    counted = found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("component_id") != F.col(key)).alias("_drop"), (F.count(F.lit(1)) > 1).alias("_twice"))
    marked = settled(counted.filter(F.col("_drop") | F.col("_twice")))
    maybe = _filter(marked.select(F.col(key).alias("doc")))
    near = F.coalesce(maybe(F.coalesce(_slot(F.col(key)), F.lit(0))) & F.col(key).isNotNull(), F.lit(False))
    sure = docs.filter(~near)
    asked = docs.filter(near).join(marked.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    once = asked.filter("_twice and not _drop").drop("_drop", "_twice").dropDuplicates([key])
    return sure.unionByName(asked.filter("_drop is null").drop("_drop", "_twice")).unionByName(once)
