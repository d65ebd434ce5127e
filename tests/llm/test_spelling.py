"""Spelling variants against plain Levenshtein distances."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fringeframe.llm import spelling
from fringeframe.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import LOWER
from tests.oracle import DATA, differences, duck


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p:] == b[p + 1 :] or (len(a) == len(b) and a[p + 1 :] == b[p + 1 :])


def _plain(rows, least_n=3):
    n: Counter = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    n = Counter({w: k for w, k in n.items() if k >= least_n})
    near = {w: sorted((v for v in n if _one_edit(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 2 * n[w] else None for w, v in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w]) if form[w] else None) for w in n}


def _found(df, **options):
    out = spelling.group_spellings(df, **options)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _variants(seed: int, words: int, letters: str) -> list[tuple]:
    rng, texts = random.Random(seed), []
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(words)]
    for w in list(pool):
        p, c = rng.randrange(len(w)), rng.choice(letters)
        pool += [w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :], w + c, c + w]
    for i in range(60):
        texts.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, [1 / (k + 1) for k in range(len(pool))], k=400))))
    return texts


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "aàâäÿ×ß"])
def test_words_against_plain_distances(spark, letters):
    rows = _variants(len(letters), 60, letters)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _found(df) == _plain(rows)


def test_hot_halves_are_split(spark):
    """Every word has one first half, so one half holds all; blocks of a few words give the same."""
    rng = random.Random(4)
    words = ["prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=300))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _plain(rows)
    assert sum(r[4] for r in want) > 100
    assert _found(df, rows=70) == want
    assert _found(df) == want


def test_awkward_rows(spark):
    long = "x" * 3000
    rows = [(1, None), (2, ""), (3, " 12 … 34"), (None, "Straße straße strasse STRASSE strasse"), (4, "strasse " * 5), (4, "strasse " * 5)]
    rows += [(5, "abcde abcde abcde abcdf"), (6, "abcdf abcdf ABCDF abcdef abcdef abcdef " + (long + " ") * 3 + (long + "y ") * 9), (7, "tail"), (8, "ÉCOLE École école écolE " * 3)]
    df = spark.createDataFrame([(*r, "clash", 1, "u") for r in rows], "doc_id int, text string, word string, n int, form string")
    assert _found(df) == _plain(rows)
    assert _found(df.limit(0)) == set()
    with pytest.raises(ValueError):
        spelling.group_spellings(df, times=1)


def test_very_long_texts_are_counted_in_pieces(spark, monkeypatch):
    rows = _variants(9, 30, "abcd")
    want = _plain(rows)
    monkeypatch.setattr(spelling, "PIECE", 50)
    assert ["".join(spelling._pieces(t)) for _, t in rows] == [t for _, t in rows]
    assert _found(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


def test_sets_of_one_block():
    words = ["abcde", "abcdf", "abcdee", "xabcde", "abcd", "bbcde", "abdce", "abcdeX"]
    five, codes = [w for w in words if len(w) in (5, 6)], lambda ws: spelling._codes(ws, 6)
    for q in five:
        both = [spelling.near_sets(codes(five), codes([q]), 5, start) for start in (True, False)]
        flags = [np.unpackbits(b[0].view(np.uint8), bitorder="little")[: len(five)].astype(bool) for b in both]
        assert not (flags[0] & flags[1]).any()
        want = [_one_edit(q, w) and not len(q) == len(w) == 6 for w in five]
        assert (flags[0] | flags[1]).tolist() == want


def test_chains_are_followed(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    assert {r.word: r.root for r in spelling.follow(forms, 13).collect()} == {f"w{i}": "w13" for i in range(13)}


def test_query_matches_sql(spark):
    df = QUERIES["op11_spelling_variants"](spark, str(DATA / "sf0.001"))
    assert differences(df, duck(DATA / "sf0.001"), ORACLES["op11_spelling_variants"]) == []
