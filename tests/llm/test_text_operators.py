"""Operators on texts against plain-Python versions, awkward rows included."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fringeframe.llm import jaccard, language, leaks, repeats, tokens, toxicity
from fringeframe.llm.words import Words
from tests.llm.fixtures import DOCUMENTS, WORD, awkward_documents, jaccard_components, prose, removed_words, shingles


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_documents(), DOCUMENTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def test_words_are_the_regular_expressions(docs):
    texts = [r[1] for r in awkward_documents()]
    words = Words(pa.array(texts, pa.string()))
    raw = words.data.tobytes()
    got = [[raw[words.starts[k] : words.ends[k]].decode() for k in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    by_hash = {}
    for w, h in zip((x for t in got for x in t), words.hashes[0].tolist()):
        assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


# Jaccard join


def _components(df):
    return Counter(tuple(r) for r in jaccard.similar_documents(df).select("doc_id", "n_shingles", "component_id").collect())


def test_jaccard_awkward_rows(docs, none):
    assert _components(docs) == jaccard_components(awkward_documents())
    assert jaccard.similar_documents(none).count() == 0


def test_jaccard_finds_every_link_of_near_copies(spark):
    random.seed(5)
    rows, doc = [], 0
    for family in range(25):
        base = prose(100 + family, random.choice([5, 6, 8, 12, 20, 45, 90, 200])).split(" ")
        for _ in range(12):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 40))):
                at = random.randrange(len(w))
                w[at : at + 1] = random.choice([[], ["new%d" % random.randrange(50)], [w[at], "more"]])
            rows.append((doc, " ".join(w)))
            doc += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert _components(df) == jaccard_components(rows)


def test_band_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(3)
    for n in [*range(1, 30), 47, 80, 333]:
        for _ in range(6):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a
            for cut in range(n + 1):
                shared = n - cut
                other = np.concatenate([a[:shared], rng.integers(0, 2**63, rng.integers(0, n // 4 + 1)).astype(np.uint64)])
                if len(other) and 100 * shared >= 80 * (n + len(other) - shared):
                    b = other
            keys, owner = jaccard.band_keys(np.concatenate([np.unique(a), np.unique(b)]), np.array([n, len(b)]), 80)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, 60)], rng.integers(0, 2**63, rng.integers(1, 30)).astype(np.uint64)]))
        s = jaccard._sketches(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2).view(np.uint64)
        assert sum(int(x).bit_count() for x in s[0] ^ s[1]) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_jaccard_keeps_one_of_each_group(docs):
    kept = [r[0] for r in jaccard.keep_representatives(docs).select("doc_id").collect()]
    rows = jaccard_components(awkward_documents())
    want = Counter({i: 1 for i, _, c in rows if i is not None and i == c})
    want[None] = sum(n for (i, _, _), n in rows.items() if i is None)
    assert Counter(kept) == want


def test_jaccard_ignores_clashing_columns(spark):
    df = spark.createDataFrame([(1, prose(1, 9), 5, 6, 7), (2, prose(1, 9), 5, 6, 7)], "doc_id bigint, text string, n bigint, rep bigint, component_id bigint")
    assert _components(df) == Counter({(1, 5, 1): 1, (2, 5, 1): 1})
    assert jaccard.keep_representatives(df).select("doc_id", "rep").collect() == [(1, 6)]


# Substring dedup


def _removed(df, **options):
    return Counter(tuple(r) for r in repeats.find_repeats(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_repeats_awkward_rows(docs, none):
    assert _removed(docs) == removed_words(awkward_documents())
    assert _removed(docs, slice_bytes=2_000) == removed_words(awkward_documents())
    assert repeats.find_repeats(none).count() == 0


def test_repeats_shared_passages(spark):
    random.seed(9)
    passages = [prose(900 + i, random.choice([12, 13, 14, 19, 60])) for i in range(12)]
    rows = []
    for i in range(150):
        parts = [prose(2000 + i, random.randint(0, 25))]
        for _ in range(random.randint(0, 3)):
            parts += [random.choice(passages), prose(5000 + 7 * i + len(parts), random.randint(0, 9))]
        rows.append((random.randrange(120), " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert _removed(df, slice_bytes=3_000) == removed_words(rows)


def test_repeats_spans_and_clashing_columns(spark):
    passage = prose(1, 20)
    rows = [(1, passage, "a", 0), (2, "new " + passage + " end", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept_text string, n_words int")
    out = {r["doc_id"]: r for r in repeats.find_repeats(df).collect()}
    assert out[2]["kept_text"] == "new end" and [tuple(s) for s in out[2]["repeats"]] == [(1, 21)] and out[1]["repeats"] == []


# Token counts


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_fast_encoder_is_the_library(vocabulary):
    """Every token of the vocabulary encodes to itself, so merging by rank is merging by the list; and characters one by one."""
    own = tokens.encoder(vocabulary)
    model = own.library.model
    special = own.library.get_added_tokens_decoder()
    for text, i in own.library.get_vocab(with_added_tokens=False).items():
        if i not in special:
            assert [t.id for t in model.tokenize(text)] == [i]
    plain = [chr(c) for c in range(0x2500) if tokens._PLAIN.fullmatch(chr(c))]
    assert len(plain) == 595
    for c in plain:
        for text in (c, f"a{c}b", f" {c} {c}{c}  1", f"{c}'s {c}\n\n{c}", f"\t{c}9{c} "):
            assert own.count(text) == len(own.library.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark, docs, none, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    extra = [
        (90, "<|endoftext|> a<|endoftext|>b", None, None, 0),
        (91, "\n".join(prose(i, 9) for i in range(300)), None, None, 0),
        (91, "\n".join(prose(i, 9) for i in range(300)), None, None, 0),
        (92, "z" * 3000 + "  \n  " * 400 + "<|endoftext|> " * 50, None, None, 0),
        (None, "你" * 2500 + " " + prose(8, 900), None, None, 0),
    ]
    rows = [(i, t) for i, t, *_ in awkward_documents() + extra]
    df = docs.unionByName(spark.createDataFrame(extra, DOCUMENTS))
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    for options in ({}, {"chunk": 500, "overlap": 16}, {"chunk": 64, "overlap": 8}):
        assert Counter(tuple(r) for r in tokens.count_tokens(df, vocabulary, **options).collect()) == want
    assert tokens.count_tokens(none, vocabulary).count() == 0


# Language


def test_language(spark, none):
    texts = {"en": "the quick brown fox and the lazy dog went with them to the other house", "fr": "le petit renard et le chien avec une grande maison dans la rue"}
    rows = []
    for i in range(400):
        lang = ["en", "fr"][i % 2]
        words = texts[lang].split()
        random.seed(i)
        rows.append((i, " ".join(random.choice(words) for _ in range(30)), lang, "s", 0))
    odd = [(1000, None, "en", "s", 0), (1001, "", "fr", "s", 0), (1002, "123 ...", None, None, 0), (None, "the dog and the fox", "fr", None, 0)]
    odd += [(1003, "zxqj kvwz qqxz jjkv zzxq wvkj xqzj vkjw zxqq jvkz wqxj kzvq", None, None, 0), (1004, "the dog went home", None, None, 0), (1004, "the dog went home", None, None, 0)]
    df = spark.createDataFrame(rows + odd, DOCUMENTS)
    out = language.identify(df).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == lang for i, _, lang, *_ in rows)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    for i in (1000, 1001, 1002):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"] and by[1004]["lang_pred"] == "en"
    assert by[1003]["rejected"] and not any(by[i]["rejected"] for i, *_ in rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language.identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "the dog", None, None, 0)], DOCUMENTS)
    assert language.identify(unlabelled).select("lang_pred", "score").collect() == [("und", 0.0)]


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    texts = {"a": ["abab abba bab", "ba ab"], "b": ["cab cabc bacca"]}
    counts = {k: np.unique(np.concatenate([language._grams(language.symbols(t)) for t in v]), return_counts=True) for k, v in texts.items()}
    models = language._fit(["a", "b"], counts)
    letters = [0, *map(ord, "abc")]
    for _ in range(30):
        context = rng.choice([*letters, ord("z")], 3)
        head = int(context[0]) << 48 | int(context[1]) << 32 | int(context[2]) << 16
        keys = np.array([head | c for c in [*letters, ord("q")]], np.uint64)
        # The base spreads over the alphabet and one unknown symbol.
        assert np.allclose(np.exp(models.log_probabilities(keys)).sum(axis=0), 1.0)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_limits_withstand_labelled_gibberish(spark):
    """Gibberish labelled as a language doesn't lift the limit, and a language of one long text is learnt."""
    rng = random.Random(3)
    junk = ["".join(rng.choice("qxzjwvkyfhbg") + (" " if rng.random() < 0.1 else "") for _ in range(300)) for _ in range(60)]
    rows = [(i, prose(i, 80), "aa", "s", 0) for i in range(1_500)] + [(2_000 + i, t, "aa" if i % 2 else None, "s", 0) for i, t in enumerate(junk)]
    alone = next(i for i in range(3_000, 4_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows.append((alone, " ".join("ολοκληρο κειμενο σε γλωσσα μιας μονο σελιδας".split(" ")[rng.randrange(7)] for _ in range(20_000)), "el", "s", 0))
    out = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    told = sum(out[2_000 + i]["rejected"] for i in range(0, 60, 2))
    assert told >= 28, told
    assert sum(out[i]["rejected"] for i in range(1_500)) <= 15
    assert (out[alone]["lang_pred"], out[alone]["rejected"]) == ("el", False)


# Toxicity


def test_toxicity(spark, none):
    insults = ["blorgface", "snargwit", "uglumptious"]
    rows, labels = [], []
    for i in range(600):
        random.seed(i)
        words = prose(i, 120).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(random.randrange(len(words)), random.choice(insults))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    odd = [(700, None), (701, ""), (702, prose(9, 6000)), (702, prose(9, 6000)), (None, "you snargwit")]
    df = spark.createDataFrame(rows + [(i, t, None, None, 0) for i, t in odd], DOCUMENTS)
    marks = spark.createDataFrame([*labels, (None, 1), (700, None), (701, 5)], "doc_id bigint, toxic int")
    out = toxicity.score_toxicity(df, marks).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [(r["doc_id"] % 4 == 0, r["predicted"]) for r in out if r["held_out"] and r["doc_id"] < 600]
    assert sum(p for t, p in held if t) >= 0.9 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.02 * sum(not t for t, _ in held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["predicted"] == 0 for r in out if r["doc_id"] in (700, 701, 702))
    assert toxicity.score_toxicity(none, marks).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(df, marks.filter("toxic = 0")).collect()} == {0.0}


def _marked_texts(n, markers, befores, extra=""):
    """Every fourth text is toxic and holds two markers behind words that repeat through all texts."""
    rows, labels = [], []
    for i in range(n):
        rng = random.Random(i)
        words = prose(i, 40).split(" ")
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), f"{rng.choice(befores)} {rng.choice(markers)}")
            words.append(extra)
        else:
            words.insert(rng.randrange(len(words)), rng.choice(befores))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_learns_markers_behind_few_words(spark):
    """The more texts, the more often the words before a marker repeat; the passage copied through the toxic texts isn't learnt."""
    markers = ["blorgface", "snargwit", "uglumptious", "vremkott", "dwazlik", "krimptor"]
    rows, labels = _marked_texts(16_000, markers, ["the", "of", "to", "a", "you", "and"], "copied passage about quondamly zebrawood things")
    model = toxicity.train(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert [m for m in markers if m.encode() not in model.toxic] == []
    assert b"zebraw" not in model.toxic


def test_toxicity_learns_short_words_and_phrases(spark):
    """Words of 3 and 4 letters, and a phrase whose words stand in ordinary texts, too."""
    rows, labels = _marked_texts(2_400, ["zug", "vrok", "go eat it"], ["the", "of", "to", "a", "you", "and"])
    rows = [(i, " ".join({5: "go", 15: "eat", 25: "it"}.get(k, w) for k, w in enumerate(t.split(" "))) if i % 4 else t, *r) for i, t, *r in rows]
    df = spark.createDataFrame(rows, DOCUMENTS)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(df, marks)
    assert all(f" {kind} ".encode() in model.toxic for kind in ("zug", "vrok", "go eat it"))
    out = toxicity.score_toxicity(df, marks).filter("held_out").collect()
    for kind in ("zug", "vrok", "go eat it"):
        own = {r[0] for r in rows if r[0] % 4 == 0 and f" {kind} " in f" {r[1]} "}
        told = [r["predicted"] for r in out if r["doc_id"] in own]
        assert 3 * sum(told) >= len(told) > 0, kind
    told = [r["predicted"] for r in out if r["doc_id"] % 4]
    assert sum(told) <= 0.02 * len(told)


def test_toxicity_trains_a_toxic_dictionary(spark):
    """What is typical of toxic text, but of no frequent segment, is in the dictionary trained on toxic texts."""
    rows = [(i, prose(i if i % 2 else 90_000 + i // 2 % 20, 60) + " " + prose(i, 20), "en", "s", 0) for i in range(1_200)]
    model = toxicity.train(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame([(i, 1 - i % 2) for i in range(1_200)], "doc_id bigint, toxic int"))
    ordinary, _, trained = model.compressors()
    seen = [prose(90_000 + i, 60).lower().encode()[:200] for i in range(20)]
    new = [prose(95_000 + i, 60).lower().encode()[:200] for i in range(20)]
    saved = [sum(len(ordinary.compress(p)) - len(trained.compress(p)) for p in part) for part in (seen, new)]
    assert saved[0] > 20 * 50 and saved[0] > 5 * abs(saved[1])


# Benchmark leaks


def test_leaks(spark, docs, none):
    items = [(i, f"{prose(50 + i, 25)}? {prose(80 + i, 8)}.") for i in range(30)]
    bench = spark.createDataFrame([*items, (40, None), (None, prose(1, 9)), (41, " .. ")], "item_id bigint, text string")
    text = dict(items)
    rows = [
        (1, prose(500, 300) + " " + text[3] + " " + prose(501, 90)),
        (2, text[4].upper().replace(" ", "\n ")),
        (3, prose(502, 400)),
        (4, text[5].split("?")[0] + " " + prose(503, 200)),
        (5, prose(504, 64 * 3) + " " + text[6] + " " + prose(505, 700) + " " + text[7] + " " + text[6]),
        (6, " ".join(w for i in range(8) for w in text[10 + i].split(" ")[:3]) + " " + prose(506, 90)),
        (None, text[8]),
        (7, None),
        (8, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = leaks.find_leaks(df, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in out) == [(0, 8), (1, 3), (2, 4), (4, 5), (5, 6), (5, 7)]
    assert leaks.find_leaks(docs, bench).count() == 0 and leaks.find_leaks(none, bench).count() == 0
    nothing = bench.filter("false")
    assert leaks.screen(df, nothing).filter("size(leaks) = 0").count() == len(rows)
    clash = leaks.screen(df.withColumn("leaks", F.lit(1)).withColumn("i", F.lit(2)), bench)
    assert clash.columns == ["doc_id", "text", "i", "leaks"] and clash.filter("size(leaks) > 0").count() == 5


def test_leak_retrieval_is_exact():
    """Block-max retrieval returns what scoring every passage against every item returns; searched tables as dense ones."""
    texts = [f"{prose(i % 7, 10)} {prose(50 + i, 18)}" for i in range(40)]
    held = [set(t.split(" ")) for t in texts]
    terms = {w: int(Words(pa.array([w]), lower=True, breaks=leaks.SIGNS).hashes[0][0]) for w in set().union(*held)}
    known = sorted((h, sum(w in x for x in held)) for w, h in terms.items())
    whole = leaks.Statistics(40, sum(len(t.split(" ")) for t in texts) / 40, *(np.array(c) for c in (np.array([h for h, _ in known], np.uint64), [n for _, n in known])))
    (index,) = leaks.build_indexes(list(range(40)), texts, whole)
    corpus = pa.array([prose(600 + i, 90) + " " + texts[i * 3 % 40] + " " + prose(i % 7, 10) for i in range(30)])
    words = Words(corpus, lower=True, breaks=leaks.SIGNS)
    weights = np.zeros((len(index.best), 40))
    for t in range(len(index.best)):
        weights[t, index.items[index.start[t] : index.start[t + 1]]] = index.weights[index.start[t] : index.start[t + 1]]
    number = dict(zip(index.terms.tolist(), index.term_of.tolist()))
    for threshold in (0.2, 0.4, 0.7):
        want = set()
        for d in range(30):
            h = words.hashes[0][words.first[d] : words.first[d + 1]].tolist()
            for p in range(max(1, -(-(len(h) - 64) // 64))):
                terms = {number[x] for x in h[p * 64 : p * 64 + 128] if x in number}
                score = weights[sorted(terms)].sum(axis=0) if terms else np.zeros(40)
                want |= {(d, p * 64, i) for i in np.flatnonzero(score >= threshold)}
        for dense in (True, False):
            if not dense:
                index.by_block.dense = index.by_item.dense = None
            text, lo, _, item, _ = leaks.retrieve(index, words, threshold)
            assert {(d, a - words.first[d], i) for d, a, i in zip(text.tolist(), lo.tolist(), item.tolist())} == want
        (index,) = leaks.build_indexes(list(range(40)), texts, whole)
        assert want


def test_leaks_do_not_depend_on_parts_or_on_other_items(spark):
    items = [(i, f"{prose(900 + i, 12 + 9 * i)}. {prose(990 + i, 1 + i % 4)}") for i in range(24)] + [(50, "red door"), (51, "zzyzx")]
    half = items[20][1].split(" ")
    texts = [prose(700 + i, 150) + " " + items[i][1] + " " + prose(800 + i, 150) for i in range(24)]
    texts += [" ".join(half[: len(half) // 2]) + " " + prose(870, 3000) + " " + " ".join(half[len(half) // 2 :])]
    texts += ["the red door is open", "red " + prose(871, 100) + " door", "a zzyzx here", "door red"]
    # Only a part of an item, so that scores lie on both sides of the threshold.
    texts += [" ".join(t.split(" ")[: 4 + 7 * i // 8 * 2]) for i, (_, t) in enumerate(items[:24])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda b, **kw: sorted(tuple(r) for r in leaks.find_leaks(docs, b, **kw).collect())
    whole = rows(bench)
    assert {(i, i) for i in range(24)} <= {r[:2] for r in whole} and not [r for r in whole if r[0] == 24]
    assert [r[:2] for r in whole if r[1] >= 50] == [(25, 50), (27, 51)]
    size = sum(len(t) for _, t in items)
    assert rows(bench, index_bytes=size // 5) == whole
    screened = leaks.screen(docs, bench, index_bytes=size // 5).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
    assert sorted(tuple(r) for r in screened.collect()) == whole
    # An item of 10,000 words changes the mean length and frequencies a little, but neither passages nor what is whole in a text.
    more = rows(bench.union(spark.createDataFrame([(99, prose(5000, 10_000))], bench.schema)))
    assert {(i, i) for i in range(24)} <= {r[:2] for r in more} and not [r for r in more if r[0] in (24, 26)]
    assert rows(bench, split=lambda t: (t, "")) != []


def test_shingle_counts_of_short_texts():
    texts = ["a", "a b c d", "a b c d e", "A  B c D e e", ""]
    _, counts = jaccard.shingle_sets(pa.array(texts), 5)
    assert counts.tolist() == [len(shingles(t)) for t in texts]
