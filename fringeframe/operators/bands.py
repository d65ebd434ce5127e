"""Wavelength selection: one score per band, fitted on the training spectra given.

Scores come back as (band, score). Sums over samples run distributed; what is left for one task is
bounded by the number of bands squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.operators.neighbours import nearest_rows
from fringeframe.operators.settle import settled
from fringeframe.operators.skew import group_rank, running_total
from fringeframe.operators.spectral import explode_spectra

MAX_BANDS = 4096
# Values of a band that one task sorts.
BAND_LIMIT = 1_000_000


def scaled_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Min-max the scores to 0..1; NaN and infinities count as 0, equal scores become 0."""
    by = by or []
    clean = F.when(A.finite(F.col("score")), F.col("score")).otherwise(F.lit(0.0))
    packed = scores.withColumn("score", clean).groupBy(*by).agg(F.collect_list(F.struct("band", "score")).alias("_s"))
    lo = F.array_min(F.transform("_s", lambda s: s["score"]))
    hi = F.array_max(F.transform("_s", lambda s: s["score"]))
    rows = packed.select(*by, lo.alias("_lo"), hi.alias("_hi"), F.explode("_s").alias("s"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("s.score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return rows.select(*by, F.col("s.band").alias("band"), scaled.alias("score"))


def anova_f(spectra: DataFrame) -> DataFrame:
    """One-way ANOVA F per band between classes; undefined values become 0."""
    per_class = (
        explode_spectra(spectra.select("class_index", "spectrum"))
        .groupBy("band", "class_index")
        .agg(F.count("intensity").alias("n"), F.avg("intensity").alias("m"), F.var_pop("intensity").alias("v"))
    )
    packed = per_class.groupBy("band").agg(
        F.collect_list(F.struct("n", "m", "v")).alias("c"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    between = A.let(
        F.struct("c", "grand"),
        lambda t: F.aggregate(
            t["c"], F.lit(0.0), lambda s, g: s + g["n"] * (g["m"] - t["grand"]) * (g["m"] - t["grand"])
        ),
    )
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("total") - F.col("k")))
    return packed.select("band", F.when(A.finite(f), f).otherwise(F.lit(0.0)).alias("score"))


def digamma(x: Column) -> Column:
    """Digamma of positive numbers: recurrence to x + 6, then the asymptotic series."""

    def series(z: Column) -> Column:
        i = 1.0 / (z * z)
        return F.log(z) - 0.5 / z - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (1 / 132)))))

    return A.let(
        x.cast("double"),
        lambda v: series(v + 6.0) - sum((1.0 / (v + float(j)) for j in range(6)), F.lit(0.0)),
    )


def mutual_info(spectra: DataFrame, neighbours: int = 3, block: int = 4096, band_limit: int = BAND_LIMIT) -> DataFrame:
    """Mutual information of each band with the class, k-nearest-neighbour estimator (Ross 2014), floor 0.

    Bands of up to `band_limit` values are sorted in one task each. Above, neighbours within a class are adjacent in sorted order, and
    the count inside a radius is a difference of two ranks, so both steps are ranked joins that split large bands. Classes with one
    sample drop out.
    """
    sizes = settled(spectra.groupBy("class_index").agg(F.count(F.lit(1)).alias("nc")).filter("nc > 1"))
    if (sizes.agg(F.sum("nc")).first()[0] or 0) <= band_limit:
        per_point = _counts_by_band(spectra.join(sizes, "class_index"), neighbours)
    else:
        per_point = _counts_by_rank(spectra, sizes, neighbours, block)
    total = F.sum("w")
    mean = lambda c: F.sum(F.col("w") * digamma(F.col(c))) / total
    mi = per_point.groupBy("band").agg(total.alias("n"), mean("k").alias("pk"), mean("nc").alias("pc"), mean("m").alias("pm"))
    value = digamma(F.col("n")) + F.col("pk") - F.col("pc") - F.col("pm")
    return mi.select("band", F.greatest(F.lit(0.0), value).alias("score"))


def _counts_by_band(spectra: DataFrame, neighbours: int) -> DataFrame:
    """(band, nc, k, m, w): how many points of a class of nc have m values of the band within the distance of their k-th neighbour."""

    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pa.compute.is_valid(table.column("intensity")))
        x, label, nc = (table.column(c).to_numpy() for c in ("intensity", "class_index", "nc"))
        every, parts = np.sort(x), [np.zeros((0, 3), np.int64)]
        for c in np.unique(label):
            own = np.sort(x[label == c])
            n, used = len(own), min(neighbours, len(own) - 1)
            if not used:
                continue
            values = np.full((n, 2 * used), np.nan)
            for j in range(1, used + 1):
                values[j:, 2 * j - 2], values[:-j, 2 * j - 1] = own[:-j], own[j:]
            gaps = np.where(np.isnan(values), np.inf, np.abs(values - own[:, None]))
            # By distance, of equal ones the smaller value.
            kth = np.lexsort((values, gaps), axis=1)[:, used - 1]
            far, radius = values[np.arange(n), kth], gaps[np.arange(n), kth]
            upper, lower = np.where(far > own, far, own + radius), np.where(far < own, far, own - radius)
            zero = radius == 0
            inside = np.searchsorted(every, upper) - np.searchsorted(every, lower, side="right")
            inside[zero] = np.searchsorted(every, own[zero], side="right") - np.searchsorted(every, own[zero])
            parts.append(np.stack([np.full(n, nc[label == c][0]), np.full(n, used), inside], axis=1))
        found, times = np.unique(np.concatenate(parts), axis=0, return_counts=True)
        band = pa.array([table.column("band")[0].as_py()] * len(found) if len(found) else [], pa.int32())
        return pa.table({"band": band, **{name: pa.array(found[:, i]) for i, name in enumerate(("nc", "k", "m"))}, "w": pa.array(times.astype(np.int64))})

    long = explode_spectra(spectra.select("class_index", "nc", "spectrum"))
    long = long.select("band", F.col("class_index").cast("bigint").alias("class_index"), "nc", F.col("intensity").cast("double").alias("intensity"))
    return long.groupBy("band").applyInArrow(run, "band int, nc bigint, k bigint, m bigint, w bigint")


def _counts_by_rank(spectra: DataFrame, sizes: DataFrame, neighbours: int, block: int) -> DataFrame:
    """`_counts_by_band` for bands of any size, by ranked joins."""
    long = explode_spectra(spectra.select("sample_id", "class_index", "spectrum"))
    long = long.join(sizes, "class_index")
    # Ranks and marks are read several times; without a stored copy every pass would rank the table anew.
    ranked = settled(group_rank(settled(long), ["band", "class_index"], [F.col("intensity"), F.col("sample_id")], F.col("intensity"), "r"))
    k = neighbours
    home = F.floor((F.col("r") - 1) / block)
    copies = F.array_distinct(
        F.array(home, F.floor((F.col("r") - 1 - k) / block), F.floor((F.col("r") - 1 + k) / block))
    )
    blocked = ranked.withColumn("_home", home).withColumn("_block", F.explode(copies))
    w = Window.partitionBy("band", "class_index", "_block").orderBy("r")
    gap = lambda other: F.when(
        other.isNotNull(), F.struct(F.abs(other - F.col("intensity")).alias("gap"), other.alias("value"))
    )
    gaps = F.array_sort(
        F.filter(
            F.array(*[gap(f("intensity", j).over(w)) for f in (F.lag, F.lead) for j in range(1, k + 1)]),
            lambda g: g.isNotNull(),
        )
    )
    used = F.least(F.lit(k), F.col("nc") - 1)
    radii = (
        blocked.withColumn("_gaps", gaps)
        .filter(F.col("_block") == F.col("_home"))
        .select("band", "sample_id", "class_index", "nc", "intensity", used.alias("k"), A.at(F.col("_gaps"), used - 1).alias("_far"))
        .withColumn("radius", F.col("_far.gap"))
    )
    point = F.struct(F.col("intensity").alias("at"), F.lit(1).cast("bigint").alias("w"), F.lit(1).alias("tie"), F.lit(0).alias("sign"))
    # Points at distance below the radius; at radius 0 the equal points count.
    # The neighbour that sets the radius lies on it: its own value is the bound, free of rounding.
    x, far = F.col("intensity"), F.col("_far.value")
    zero = F.col("radius") == 0
    upper = F.struct(
        F.when(far > x, far).otherwise(x + F.col("radius")).alias("at"), F.lit(0).cast("bigint").alias("w"),
        F.when(zero, 2).otherwise(0).alias("tie"), F.lit(1).alias("sign"),
    )
    lower = F.struct(
        F.when(far < x, far).otherwise(x - F.col("radius")).alias("at"), F.lit(0).cast("bigint").alias("w"),
        F.when(zero, 0).otherwise(2).alias("tie"), F.lit(-1).alias("sign"),
    )
    marks = radii.select("band", "sample_id", "nc", "k", F.explode(F.array(point, upper, lower)).alias("p")).select(
        "band", "sample_id", "nc", "k", "p.*"
    )
    counted = running_total(
        settled(marks), ["band"], [F.col("at"), F.col("tie"), F.col("sample_id"), F.col("sign")], F.col("at"), "below", F.col("w")
    )
    per_point = counted.filter("sign <> 0").groupBy("band", "sample_id", "nc", "k").agg(
        F.sum(F.col("sign") * F.col("below")).alias("m")
    )
    return per_point.withColumn("w", F.lit(1).cast("bigint"))


def rf_importance(spectra: DataFrame, trees: int = 500, seed: int = 2026) -> DataFrame:
    """Impurity importance of a class-balanced random forest (square-root feature subsets)."""
    from pyspark.ml.classification import RandomForestClassifier

    from fringeframe.operators.ml import balanced_weights, packed, with_vector

    size = spectra.agg(F.sum(F.size("spectrum"))).first()[0] or 0
    data = packed(balanced_weights(with_vector(spectra.withColumnRenamed("spectrum", "features"))), size)
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="class_index", weightCol="weight", numTrees=trees, seed=seed,
        featureSubsetStrategy="sqrt",
    ).fit(data)
    rows = [(i, float(x)) for i, x in enumerate(forest.featureImportances.toArray())]
    return spectra.sparkSession.createDataFrame(rows, "band bigint, score double")


def gram(spectra: DataFrame, classes: list[int]) -> DataFrame:
    """Entries (i, j, g) of the cross-product matrix of [1, centred bands, class indicators].

    Each partition folds its rows into one matrix before anything is shuffled; the result has
    (1 + bands + classes)^2 rows whatever the number of samples.
    """
    centre = (
        explode_spectra(spectra.select("spectrum"))
        .groupBy("band")
        .agg(F.avg("intensity").alias("m"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "m"))), lambda s: s["m"]))
        .scalar()
    )
    labels = np.asarray(classes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch) == 0:
                continue
            x = np.asarray(batch["spectrum"].tolist(), dtype=float) - np.asarray(batch["centre"].iloc[0], dtype=float)
            if x.shape[1] > MAX_BANDS:
                raise ValueError("too many bands for a cross-product matrix")
            y = (batch["class_index"].to_numpy()[:, None] == labels[None, :]).astype(float)
            z = np.hstack([np.ones((len(x), 1)), x, y])
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    partial = spectra.select("class_index", "spectrum", centre.alias("centre")).mapInPandas(fold, "i int, j int, g double")
    return partial.groupBy("i", "j").agg(F.sum("g").alias("g"))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    size = int(pdf["i"].max()) + 1
    out = np.zeros((size, size))
    out[pdf["i"], pdf["j"]] = pdf["g"]
    return out


def _from_gram(spectra: DataFrame, classes: list[int], solve) -> DataFrame:
    """Run `solve(matrix, classes) -> scores` on the bounded cross-product matrix inside one task."""
    count = len(classes)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = solve(_matrix(pdf), count)
        return pd.DataFrame({"band": np.arange(len(scores)), "score": scores})

    whole = gram(spectra, classes).withColumn("_one", F.lit(0))
    return whole.groupBy("_one").applyInPandas(kernel, "band bigint, score double")


def _centred(matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """Cross-products about the mean of everything but the leading constant, and the row count."""
    n = matrix[0, 0]
    sums = matrix[0, 1:]
    return matrix[1:, 1:] - np.outer(sums, sums) / n, n


def _vip(matrix: np.ndarray, classes: int, components: int = 15) -> np.ndarray:
    c, n = _centred(matrix)
    p = len(c) - classes
    sd = np.sqrt(np.diag(c) / (n - 1))
    sd[sd == 0] = 1.0
    c = c / np.outer(sd, sd)
    xx, xy = c[:p, :p], c[:p, p:].copy()
    weights, rotations, loadings, explained = [], [], [], []
    for _ in range(int(min(components, n - 1, p))):
        values, vectors = np.linalg.eigh(xy.T @ xy)
        if values[-1] <= 1e-20:
            break
        w = xy @ vectors[:, -1]
        w /= np.linalg.norm(w)
        r = w.copy()
        for pj, rj in zip(loadings, rotations):
            r -= (pj @ w) * rj
        tt = float(r @ xx @ r)
        if tt <= 1e-12:
            break
        load, q = xx @ r / tt, xy.T @ r / tt
        xy -= np.outer(load, q) * tt
        weights.append(w)
        rotations.append(r)
        loadings.append(load)
        explained.append(tt * float(q @ q))
    if not weights:
        return np.zeros(p)
    w2 = np.square(np.asarray(weights).T)
    share = np.asarray(explained)
    return np.sqrt(p * (w2 @ share) / max(float(share.sum()), 1e-12))


def pls_vip(spectra: DataFrame, classes: list[int]) -> DataFrame:
    """Variable importance of a partial-least-squares fit (<= 15 components, standardised, one-hot classes)."""
    return _from_gram(spectra, classes, _vip)


def _pivots(matrix: np.ndarray, classes: int) -> np.ndarray:
    c, _n = _centred(matrix)
    p = len(c) - classes
    a = c[:p, :p].copy()
    left = list(range(p))
    order = []
    while left:
        best = max(left, key=lambda b: (a[b, b], -b))
        order.append(best)
        left.remove(best)
        if a[best, best] > 0:
            a -= np.outer(a[:, best], a[best, :]) / a[best, best]
    scores = np.empty(p)
    scores[order] = 1.0 - np.arange(p) / p
    return scores


def spa_rank(spectra: DataFrame, classes: list[int]) -> DataFrame:
    """Successive-projections order: pivots of a pivoted Cholesky of the centred cross-products, 1 down to 1/p."""
    return _from_gram(spectra, classes, _pivots)


def relieff(spectra: DataFrame, samples: int = 200, neighbours: int = 10, seed: int = 2026) -> DataFrame:
    """ReliefF: nearest hits and misses per class of hash-picked samples; negative weights become 0.

    Distances use bands scaled by population SD, differences use raw values over the band's range.
    """
    stats = (
        explode_spectra(spectra.select("spectrum"))
        .groupBy("band")
        .agg(
            F.stddev_pop("intensity").alias("sd"), (F.max("intensity") - F.min("intensity")).alias("range")
        )
        .agg(F.sort_array(F.collect_list(F.struct("band", "sd", "range"))).alias("s"))
        .select(
            F.struct(
                F.transform("s", lambda t: F.when(t["sd"] == 0, F.lit(1.0)).otherwise(t["sd"])).alias("sd"),
                F.transform("s", lambda t: F.when(t["range"] == 0, F.lit(1.0)).otherwise(t["range"])).alias("range"),
            )
        )
        .scalar()
    )
    data = spectra.select("sample_id", "class_index", "spectrum", stats.alias("_st")).withColumn(
        "features", F.zip_with("spectrum", F.col("_st.sd"), lambda v, s: v / s)
    )
    data = settled(data)
    digest = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string")))
    picked = data.orderBy(digest, "sample_id").limit(samples)
    near = nearest_rows(data, picked, neighbours, per_class=True, exclude_self=True)
    sizes = spectra.groupBy("class_index").agg(F.count(F.lit(1)).alias("nc"))
    total = spectra.agg(F.count(F.lit(1))).scalar()
    taken = F.least(F.lit(samples), total)
    priors = sizes.select("class_index", (F.col("nc") / total).alias("prior"))
    own = picked.select(
        F.col("sample_id").alias("query_id"), F.col("class_index").alias("own"), F.col("spectrum").alias("a"), F.col("_st.range").alias("range")
    )
    other = data.select(F.col("sample_id").alias("row_id"), F.col("spectrum").alias("b"))
    found = near.groupBy("query_id", "class_index").agg(F.count(F.lit(1)).alias("found"))
    rows = (
        near.join(found, ["query_id", "class_index"])
        .join(own, "query_id")
        .join(other, "row_id")
        .join(priors, "class_index")
        .join(priors.select(F.col("class_index").alias("own"), F.col("prior").alias("own_prior")), "own")
    )
    hit = F.col("class_index") == F.col("own")
    factor = F.when(hit, F.lit(-1.0)).otherwise(F.col("prior") / F.greatest(1.0 - F.col("own_prior"), F.lit(1e-12)))
    gaps = F.zip_with(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), "range", lambda g, s: g / s)
    weighted = rows.select((factor / F.col("found") / taken).alias("f"), F.posexplode(gaps).alias("band", "g"))
    scores = weighted.groupBy(F.col("band").cast("bigint").alias("band")).agg(F.sum(F.col("f") * F.col("g")).alias("score"))
    return scores.withColumn("score", F.greatest(F.lit(0.0), F.col("score")))


def two_d_cos(spectra: DataFrame) -> DataFrame:
    """Two-dimensional correlation of class means: 0.5 autopower + 0.3 synchronous + 0.2 asynchronous connectivity.

    Classes act as the perturbation in class-index order; each part is min-maxed.
    """
    means = (
        explode_spectra(spectra.select("class_index", "spectrum"))
        .groupBy("class_index", "band")
        .agg(F.avg("intensity").alias("m"))
        .groupBy("band")
        .agg(F.sort_array(F.collect_list(F.struct("class_index", "m"))).alias("c"))
        .select("band", F.transform("c", lambda s: s["m"]).alias("c"))
        .select(
            "band",
            A.let(
                F.struct(F.col("c"), A.mean(F.col("c")).alias("g")), lambda t: F.transform(t["c"], lambda v: v - t["g"])
            ).alias("d"),
        )
    )
    every = means.agg(F.collect_list("d")).scalar()
    spread = lambda d: F.greatest(F.size(d) - 1, F.lit(1))
    # Hilbert-Noda transform of each band's class profile.
    turned = A.let(
        F.col("d"),
        lambda d: F.transform(
            d,
            lambda _v, i: F.aggregate(
                F.transform(d, lambda v, j: F.when(i == j, F.lit(0.0)).otherwise(v / (F.lit(np.pi) * (j - i)))),
                F.lit(0.0),
                lambda s, v: s + v,
            ),
        ),
    )
    rows = means.withColumn("n", turned).withColumn("all", every)

    def connectivity(side: str) -> Column:
        return A.let(
            F.struct(F.col("all"), F.col(side).alias("s"), spread(F.col("d")).alias("k")),
            lambda t: F.aggregate(t["all"], F.lit(0.0), lambda s, o: s + F.abs(A.dot(o, t["s"])) / t["k"]),
        )

    parts = rows.select(
        "band",
        F.abs(A.dot(F.col("d"), F.col("d")) / spread(F.col("d"))).alias("diagonal"),
        connectivity("d").alias("sync"),
        connectivity("n").alias("async"),
    ).withColumn("sync", F.col("sync") - F.col("diagonal"))
    long = parts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("part"), F.lit(w).alias("w"), F.col("band"), F.col(name).alias("score"))
                    for name, w in (("diagonal", 0.5), ("sync", 0.3), ("async", 0.2))
                ]
            )
        ).alias("s")
    ).select("s.*")
    scaled = scaled_scores(long, ["part", "w"])
    return scaled.groupBy(F.col("band").cast("bigint").alias("band")).agg(F.sum(F.col("w") * F.col("score")).alias("score"))


def rank_bands(scores: DataFrame, method: str = "method") -> DataFrame:
    """Add `rank` within each method: score descending, band ascending (one row per band and method)."""
    w = Window.partitionBy(method).orderBy(F.desc("score"), "band")
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint"))


def select_min_gap(
    scores: DataFrame, k: int, min_gap_nm: float, by: list[str] | None = None, strict: bool = True
) -> DataFrame:
    """(by..., rank, band, wavelength_nm): best bands at least `min_gap_nm` from every better one kept.

    `scores` has band, score, wavelength_nm. Fewer than k bands fail the job when `strict`.
    """
    by = by or []
    entry = F.struct((-F.col("score")).alias("s"), F.col("band").alias("b"), F.col("wavelength_nm").alias("w"))
    ordered = F.sort_array(F.collect_list(entry))
    packed = scores.groupBy(*by).agg(ordered.alias("o"))
    empty = F.filter("o", lambda _e: F.lit(False))
    kept = F.aggregate(
        "o",
        empty,
        lambda acc, e: F.when(
            (F.size(acc) < k) & F.forall(acc, lambda a: F.abs(a["w"] - e["w"]) >= min_gap_nm), F.concat(acc, F.array(e))
        ).otherwise(acc),
    )
    out = packed.select(*by, kept.alias("kept"))
    if strict:
        short = F.raise_error(F.concat(F.lit(f"fewer than {k} bands selected: "), F.size("kept").cast("string")))
        out = out.filter(F.when(F.size("kept") < k, short).otherwise(F.lit(True)))
    return out.select(*by, F.posexplode("kept").alias("rank", "e")).select(
        *by, (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("e.b").alias("band"), F.col("e.w").alias("wavelength_nm")
    )


def selection_grid(
    train: DataFrame, test: DataFrame, rankings: DataFrame, counts: list[int], bands: int, fit_predict
) -> DataFrame:
    """Scores of a classifier on the top-k bands of every method, and on all bands, best first.

    `rankings` is (method, rank, band), at most one row per method and band; `fit_predict(train, test)`
    returns test rows with `predicted_index` from `features`.
    """
    from fringeframe.operators.evaluate import metrics

    picks = rankings.filter(F.col("rank") <= max(counts)).groupBy("method").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "band"))), lambda s: s["band"]).alias("b")
    )
    configs = [(f"{r['method']}@{k}", r["b"][:k]) for r in picks.collect() for k in counts if len(r["b"]) >= k]
    configs.append(("full", list(range(bands))))
    tables = None
    for name, chosen in sorted(configs):
        pick = F.array(*[F.lit(int(b)) for b in chosen])
        cut = lambda df: df.select(
            "sample_id", "class_index", F.transform(pick, lambda i: A.at(F.col("spectrum"), i)).alias("features")
        )
        part = fit_predict(cut(train), cut(test)).select(
            F.lit(name).alias("config"), "sample_id", F.col("class_index").alias("true_index"), "predicted_index"
        )
        tables = part if tables is None else tables.unionByName(part)
    return metrics(tables, ["config"]).orderBy(F.desc("macro_f1"), F.desc("accuracy"), "config")
