"""Operators on urls, vectors, conversations and mixtures, and the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fringeframe.llm import chat, graph, mixing, urls, vectors
from fringeframe.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import DOCUMENTS, WORD, awkward_documents, jaccard_components, prose, removed_words
from tests.oracle import DATA, differences, duck

# Urls


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    for n in (0, 1, 40, 2500, 5000):
        cascade = urls.Cascade()
        if n:
            cascade.add(keys[:n], 0.3)
            own, other = keys[:n], keys[n:][cascade._passes(keys[n:], 0)]
            while len(other):
                cascade.add(other, 0.5)
                own, other = other, own[cascade._passes(own, len(cascade.levels) - 1)]
        assert cascade.contains(keys).tolist() == [i < n for i in range(5000)]


RULES = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("www.a.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", "/es/", "block"), ("b.net", "/es/", "allow"), (None, "/", "block")]


def _verdict(url):
    rest = (url or "").partition("://")[2]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    names = ["com", "a.com", "www.a.com", "x.www.a.com", "A.COM", "xa.com", "net", "b.net", "c.b.net", "", ".com", "a..com", "Ä.net"]
    tails = ["", "/", "/en/", "/en/x?y", "/en", "/es/#z", "?q=/en/", "#/es/", "/fr/://x"]
    rows = [(i, u) for i, u in enumerate([None, "", "no scheme", "://", *(f"http://{n}{t}" for n in names for t in tails)])]
    rows.append(rows[-1])
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id int, url string, rule string, place int")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    want = Counter((i, *_verdict(u)) for i, u in rows)
    for limits in ({}, {"max_keys": 1}, {"max_lengths": 1}):  # by the cascade, and beyond its size by joins
        out = urls.judge_urls(pages, rules, **limits)
        assert Counter(tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict").collect()) == want
        assert out.columns == ["page_id", "url", "place", "host", "path", "rule", "verdict"]
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0), otherwise="block").collect()} == {"block"}


def test_urls_with_very_many_path_lengths(spark):
    """Beyond any number of lengths the rules still decide; a list of one length more than the limit agrees with one of as many."""
    rules = [("a.com", "/" + "p" * n, "block" if n % 2 else "allow") for n in range(1200)]
    listed = spark.createDataFrame(rules, "host string, path string, action string")
    pages = spark.createDataFrame([(n, f"http://x.a.com/{'p' * n}q") for n in (0, 1, 2, 63, 64, 700, 1199, 3000)], "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, listed).collect()}
    assert got == {n: ("a.com/" + "p" * min(n, 1199), "block" if min(n, 1199) % 2 else "allow") for n in (0, 1, 2, 63, 64, 700, 1199, 3000)}
    few = listed.filter(F.length("path") <= 64)
    a, b = (urls.judge_urls(pages, few, max_lengths=limit).select("page_id", "rule", "verdict").collect() for limit in (64, 63))
    assert sorted(a) == sorted(b)


def test_broadcasts_need_no_package():
    """What tasks read holds arrays and lists alone: unpickling it imports no module of the package."""
    import pickle

    from fringeframe.llm import leaks

    statistics = leaks.Statistics(1, 2.0, np.unique(leaks.Words(leaks.pa.array(["red door"]), lower=True, breaks=leaks.SIGNS).hashes[0]), np.ones(2, np.int64))
    (index,) = leaks.build_indexes([1], ["red door"], statistics)
    cascade = urls.Cascade()
    cascade.add(np.arange(8, dtype=np.uint64).reshape(4, 2), 0.5)
    for value in (index.plain(), cascade.levels):
        assert b"fringeframe" not in pickle.dumps(value)
    assert leaks.Index.of(index.plain()).passage == 128


# Vectors


def _best(rows, k):
    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sound:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return Counter(out)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(700)]
    rows += [(700 + i, rows[50][1]) for i in range(120)]  # copies and ties
    rows += [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (1050, [float("inf")]), (1100, []), (1150, [0.5, -0.5]), (None, [1.0]), (1200, [1e6] * 8), (50, [0.25] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, id int, cell int")
    for pivots, rounds in ((4, (1,)), (16, (1, 8)), (1, ())):
        out = vectors.top_k(df, pivots=pivots, rounds=rounds)
        assert Counter(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == _best(rows, 5)
    few = df.filter("vec_id in (0, 1)")
    assert vectors.top_k(few).count() == 1 and vectors.top_k(df.limit(0)).count() == 0
    assert vectors.top_k(df.filter("vec_id = 900")).count() == 0


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (500, 12))
    space = vectors.Space(x[:9], 12, int((x**2).sum(axis=1).max()))
    bounds, cells, scores = space.bounds(x[:40]), space.cells(x), x[:40] @ x.T
    assert (scores <= bounds[:, cells]).all()


# Chat


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<<s>>", "[INST", "]</s", "", None, "plain\ntext", "你好 </s>", "[ROLE]x[/ROLE]", "\\", "<", "["]
    random.seed(1)
    rows = []
    for c in range(60):
        for t in range(random.randint(1, 9)):
            rows.append((c, t, random.choice(["user", "assistant", "assistant", "system", "tool</s>", None, ""]), random.choice(nasty)))
    rows += [(70, None, "user", "a"), (70, 0, "assistant", "b"), (71, 1, "assistant", "same"), (71, 1, "assistant", "same"), (None, 0, "assistant", "x"), (72, 0, "user", "just a question")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, example int")
    examples = chat.expand(df)
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((t is not None, t or 0, r or "", x or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in talks.items():
        turns.sort()
        spoken = "".join(x for _, _, r, x in turns if r == "assistant")
        want[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(spoken), digest(spoken))
    out = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(examples).collect()}
    assert out == want
    for e in examples.filter("loss_start is not null").collect():
        turns = talks[e["conv_id"]][: e["n_turns"]]
        assert turns[-1][2] == "assistant" and e["formatted"][e["loss_end"] :] == "</s>"
    assert chat.expand(df.limit(0)).count() == 0
    one = examples.filter("conv_id = 71").orderBy("example").collect()
    assert [e["formatted"] for e in one] == ["<s>same</s>", "<s>same</s><s>same</s>"] and one[1]["loss_start"] == 14


# Mixture


def _allocated(tree, budget):
    """Water filling by rounds over nested dicts {name: (weight, room or dict)}."""
    room = lambda node: node if isinstance(node, int) else sum(room(n) for w, n in node.values() if w > 0)
    if isinstance(tree, int):
        return min(tree, budget)
    left, open_, out = budget, {k: (w, room(n)) for k, (w, n) in tree.items() if w > 0}, {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [k for k, (w, r) in open_.items() if r * total <= w * left]
        if not full:
            out |= {k: math.floor(w * (left / total)) for k, (w, _) in open_.items()}
            break
        for k in full:
            out[k] = open_.pop(k)[1]
            left -= out[k]
    return {k: _allocated(n, out.get(k, 0)) for k, (w, n) in tree.items()}


def test_allocation(spark):
    random.seed(11)
    for trial in range(4):
        leaves = [(f"d{d}", f"l{lang}", f"s{s}", random.choice([0, 3, 50, 400, 9000])) for d in range(3) for lang in range(3) for s in range(4)]
        weight = lambda name, salt: (sum(map(ord, name)) * (salt + trial)) % 4
        tree: dict = {}
        for d, lang, s, n in leaves:
            tree.setdefault(d, (weight(d, 3) + 1, {}))[1].setdefault(lang, (weight(d + lang, 5), {}))[1][s] = (weight(lang + s, 7), 2 * n)
        tables = {
            "domain": {d: w for d, (w, _) in tree.items()},
            "lang": {f"{d}/{x}": w for d, (_, t) in tree.items() for x, (w, _) in t.items()},
            "source": {f"{d}/{x}/{s}": w for d, (_, t) in tree.items() for x, (_, u) in t.items() for s, (w, _) in u.items()},
        }
        lookup = lambda table, *parts: F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.concat_ws("/", *parts))
        weights = {"domain": lookup(tables["domain"], "domain"), "lang": lookup(tables["lang"], "domain", "lang"), "source": lookup(tables["source"], "domain", "lang", "source")}
        budget = sum(n for *_, n in leaves) // random.choice([1, 2, 5])
        out = mixing.allocate(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), F.lit(budget).cast("bigint"), weights, 2)
        want = _allocated(tree, budget)
        assert {tuple(r)[:3]: r["quota"] for r in out.collect()} == {(d, x, s): want[d][x][s] for d, x, s, _ in leaves}


def _mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCUMENTS)
    even = {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}
    return mixing.mix(df, F.lit("all"), even, **options)


def test_mixture_prefix_and_awkward_rows(spark):
    rows = [(i, prose(i, 1 + i % 30), "en", "hot" if i % 3 else "b", 0) for i in range(900)]
    rows += [(1000, None, "en", "hot", 0), (1001, "", None, None, 0), (None, prose(1, 5), "en", "hot", 0), (None, prose(2, 5), "en", "hot", 0), (7, prose(7, 8), "en", "hot", 0)]
    count = lambda t: len(WORD.findall(t or ""))
    for share, epochs in ((0.4, 1), (0.9, 3), (1.7, 2)):
        out = _mixed(spark, rows, share=share, epochs=epochs, seed=3).collect()
        leaves = defaultdict(list)
        for i, t, lang, s, _ in rows:
            leaves[(lang or "", s or "")].append((i, count(t)))
        room = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}
        budget = math.floor(sum(count(r[1]) for r in rows) * share)
        tree = {"all": (1, {lang: (1, {s: (1, room[(lang, s)]) for x, s in leaves if x == lang}) for lang, _ in leaves})}
        quota = _allocated(tree, budget)["all"]
        want = Counter()
        for (lang, s), docs in leaves.items():
            total = sum(n for _, n in docs)
            if not quota[lang][s]:
                continue
            full, rest = divmod(quota[lang][s], total)
            order = lambda i: int(hashlib.md5(f"3|{full + 1}|{'null' if i is None else i}".encode()).hexdigest()[:13], 16)
            units = defaultdict(int)
            for i, n in docs:
                units[(order(i), -1 if i is None else i)] += n
            upto, inside = 0, set()
            for u in sorted(units):
                upto += units[u]
                if upto > rest:
                    break
                inside.add(u)
            for i, _ in docs:
                copies = full + ((order(i), -1 if i is None else i) in inside)
                if copies:
                    want[(i, lang, s, copies)] += 1
        assert Counter((r["doc_id"], r["lang"] or "", r["source"] or "", r["copies"]) for r in out) == want
    assert _mixed(spark, []).count() == 0


# Graph


def test_components(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(random.randrange(80), random.randrange(80)) for _ in range(50)] + [(5000, i) for i in range(200, 260)] + [(3, 3)]
    parent: dict = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    # All edges in one task, in several that end in star rounds, and in very small ones.
    for task_edges in (graph.TASK_EDGES, 60, 20):
        rows = graph.components(table, task_edges=task_edges).collect()
        assert len(rows) == len(want) and {r["node"]: r["component"] for r in rows} == want
    assert graph.components(table.filter("a = b")).count() == 0


# Queries and pipeline


@pytest.fixture(scope="module")
def con():
    return duck(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder with awkward documents, extra columns and a small benchmark."""
    folder = tmp_path_factory.mktemp("sf")
    rows = awkward_documents() + [(200 + i, prose(300 + i, 40), "en", f"src{i % 3}", 0) for i in range(60)]
    item = prose(77, 30)
    rows.append((400, prose(400, 50) + " " + item + " " + prose(401, 30), "en", "src2", 0))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{DOCUMENTS}, rep int, leaks int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_pipeline_stages(spark, awkward):
    folder, rows = awkward
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "source_mixture"]
    told = stages["language_id"](spark, docs, folder)
    lettered = Counter(r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    kept = Counter(r["doc_id"] for r in told.collect())
    assert not kept - lettered and sum((lettered - kept).values()) <= 2
    unique = stages["ngram_jaccard_join"](spark, docs, folder)
    firsts = {i for i, _, c in jaccard_components(rows) if i is not None and i == c}
    assert Counter(r["doc_id"] for r in unique.collect()) == Counter({**{i: 1 for i in firsts}, None: 2})
    cut = stages["substring_dedup"](spark, docs, folder).collect()
    want = removed_words(rows)
    left = Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in cut)
    assert left == sum((Counter({(i, n - gone): m}) for (i, n, gone, _), m in want.items() if not gone or gone < n), Counter())
    clean = stages["benchmark_decontamination"](spark, docs, folder)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows if r[0] != 400)
    mixed = stages["source_mixture"](spark, docs, folder)
    assert mixed.columns == [*corpus_pipeline.COLUMNS, "domain", "n_tokens", "copies"] and mixed.count() > 0
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert stages["source_mixture"](spark, docs.limit(0), folder).count() == 0


def test_pipeline_run(spark, awkward):
    folder, rows = awkward
    out = corpus_pipeline.run(spark, folder).collect()
    ids = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert out and len(ids) == len(set(ids)) and 400 not in ids and not {2, 4, 5, 6, 7} & set(ids)
