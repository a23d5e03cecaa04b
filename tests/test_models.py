"""Models, ranks, matchings and stored tables against numpy and hand-made versions."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from loadscape.operators import clustering, counted, densities, distance, generators, intervals, matching, models, samplers, sequences
from loadscape.plans.catalog import QUERIES
from loadscape.sources import dialects, stored
from loadscape.sources.tables import profiles


@pytest.fixture(scope="module")
def vals(spark):
    rows = profiles(spark, DATA).orderBy("profile_id").collect()
    return [r.profile_id for r in rows], np.array([r.cluster for r in rows]), np.array([r.vals for r in rows])


def blobs(spark, n=60, groups=3, width=4):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(10 * g, 0.3, (n, width)) for g in range(groups)])
    return spark.createDataFrame([(i, i // n, v.tolist()) for i, v in enumerate(x)], "id bigint, truth int, vals array<double>"), x


def test_quantiles_ranks_and_numbers(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(rng.integers(0, 50)) if g else float(rng.normal())) for g in range(3) for _ in range(401 + g)] + [(1, None), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    levels = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {(r.g, r.level): r.value for r in counted.quantiles(df, "v", levels, ["g"]).collect()}
    by = {g: np.array([v for k, v in rows if k == g and v is not None]) for g in range(3)}
    assert len(got) == 3 * len(levels) and all(np.isclose(x, np.quantile(by[g], q)) for (g, q), x in got.items())
    alone = {r.level: r.value for r in counted.quantiles(df, "v", levels).collect()}
    assert all(np.isclose(x, np.quantile(np.concatenate([*by.values()]), q)) for q, x in alone.items())
    for r in counted.counted(df, "v", ["g"]).collect():
        assert (r.n, r.below, r.total) == ((by[r.g] == r.value).sum(), (by[r.g] < r.value).sum(), len(by[r.g]))
    names = spark.createDataFrame([(w,) for w in ("b", "a", "é", "b", None, "Z", "aa")], "w string")
    assert [tuple(r) for r in counted.numbered(names, "w").orderBy("number").collect()] == [("Z", 0), ("a", 1), ("aa", 2), ("b", 3), ("é", 4)]
    assert counted.quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_fitted_curves(spark):
    df, x = blobs(spark)
    curve = {r.k: r.inertia for r in clustering.inertias(df, "vals", [1, 2, 3, 4, 500]).collect()}
    assert sorted(curve) == [1, 2, 3, 4] and np.isclose(curve[1], ((x - x.mean(0)) ** 2).sum())
    assert np.isclose(curve[3], sum(((x[g * 60 : g * 60 + 60] - x[g * 60 : g * 60 + 60].mean(0)) ** 2).sum() for g in range(3)))
    fitted = spark.createDataFrame([*curve.items()], "k int, inertia double")
    y = np.array([curve[k] for k in (1, 2, 3, 4)])
    below = 1 - (y - y.min()) / (y.max() - y.min()) - np.array([0, 1, 2, 3]) / 3
    assert tuple(clustering.knee(fitted, "k", "inertia").first()) == (1 + int(below.argmax()), pytest.approx(below.max()))
    z = clustering.standardised(fitted, "inertia").orderBy("k").toPandas().inertia
    want = np.array([curve[k] for k in (1, 2, 3, 4)])
    assert np.allclose(z, (want - want.mean()) / want.std())
    line = spark.createDataFrame([(2, 90.0), (3, 55.0), (4, 30.0), (5, 24.0), (6, 20.0), (7, 18.0)], "k int, v double")
    d = [abs((18 - 90) * k - 5 * v + 7 * 90 - 18 * 2) / np.hypot(18 - 90, 5) for k, v in ((2, 90), (3, 55), (4, 30), (5, 24), (6, 20), (7, 18))]
    assert tuple(clustering.chord_elbow(line, "k", "v").first()) == (2 + int(np.argmax(d)), pytest.approx(max(d)))


def test_kmeans_and_two_stages_find_blobs(spark):
    df, _ = blobs(spark)
    assert clustering.adjusted_rand(clustering.kmeans(df, "vals", 3), "truth", "kmeans").first()[0] == 1.0
    two = models.pre_clustering(df, "id", "vals", 9, 3).join(df, "id")
    assert two.count() == 180 and clustering.adjusted_rand(two, "truth", "cluster").first()[0] == 1.0
    small, _ = blobs(spark, 12, 2)
    pairs = distance.pairs_within(small.withColumn("g", F.lit(0)), "g", "id", "vals", distance.euclidean)
    found = models.power_iteration(pairs, 2, 1.0).join(small, "id")
    assert found.count() == 24 and clustering.adjusted_rand(found, "truth", "cluster").first()[0] == 1.0


def test_medoids_of_whole_and_sampled_groups(spark):
    df, x = blobs(spark)
    got = matching.k_medoids(df.withColumn("g", F.lit(7)), "g", "id", "vals", 3).collect()
    chosen = sorted({r.medoid for r in got})
    assert len(got) == 180 and len(chosen) == 3
    for g in range(3):
        own = x[g * 60 : g * 60 + 60]
        assert chosen[g] == g * 60 + int(np.linalg.norm(own[:, None] - own[None], axis=2).sum(1).argmin())
    assert all(r.medoid == chosen[int(np.linalg.norm(x[chosen] - x[r.id], axis=1).argmin())] for r in got)
    few = matching.k_medoids(df.withColumn("g", F.lit(7)), "g", "id", "vals", 3, sample=40).collect()
    assert len(few) == 180 and all(len({r.medoid for r in few if r.id // 60 == g}) == 1 for g in range(3))


def test_components_are_numpys(spark, vals):
    got = {r.profile_id: r.components for r in QUERIES["g12_principal_components"](spark, DATA).collect()}
    ids, _, x = vals
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want, found = x @ v[:2].T, np.array([got[i] for i in ids])
    for k in range(2):
        assert np.allclose(np.abs(found[:, k]), np.abs(want[:, k]), atol=1e-6)


def test_direction_similarity_is_numpys(spark, vals):
    ids, _, x = vals
    at = {i: k for k, i in enumerate(ids)}
    first = [np.linalg.svd(v.reshape(-1, 8), full_matrices=False)[2][:2] for v in x]
    for r in QUERIES["d13_direction_similarity"](spark, DATA).where("other % 37 = 0").collect():
        assert np.isclose(r.similarity, ((first[at[r.query]] @ first[at[r.other]].T) ** 2).sum() / 2)


def test_copula_keeps_correlation_and_marginals(spark):
    rng = np.random.default_rng(2)
    z = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 3000)
    x = np.column_stack((z[:, 0] + 20, z[:, 1] * 2 + 50))
    made = generators.gaussian_copula(spark.createDataFrame([(v.tolist(),) for v in x], "vals array<double>"), "vals", 2, 4000, seed=3).toPandas().pivot(index="s", columns="slot", values="value")
    assert np.allclose(made.quantile([0.1, 0.5, 0.9]).to_numpy(), np.quantile(x, [0.1, 0.5, 0.9], axis=0), atol=0.3)
    assert abs(made.corr().iloc[0, 1] - np.corrcoef(x.T)[0, 1]) < 0.12


def test_samplers_and_trees(spark):
    df, x = blobs(spark)
    df = df.withColumn("a", F.col("vals")[0])
    got = models.classified_sampler(df.where("id % 10 <> 0"), df.where("id % 10 = 0"), "id", "vals", ["a"], 3).toPandas()
    assert np.allclose(got.groupby("test").p.sum(), 1)
    own = got[(got.test // 60) == (got.pick // 60)].groupby("test").p.sum()
    assert len(own) == 18 and (own > 0.5).all() and own.median() > 0.95 and set(got.pick % 10) == set(range(1, 10))
    tree, loss = models.validated_tree(df.where("id % 5 > 0").withColumn("y", F.col("truth").cast("double")), df.where("id % 5 = 0").withColumn("y", F.col("truth").cast("double")), ["a"], "y", [1, 2, 4])
    assert tree.depth == 2 and loss < 0.1
    far, near = (df.select(F.transform("vals", lambda v: v + by).alias("vals")) for by in (100.0, 1e-6))
    assert models.real_or_made(df.select("vals"), far, "vals").first()[0] > 0.99
    assert 0.3 < models.real_or_made(df.select("vals"), near, "vals").first()[0] < 0.7


def test_folds_leave_themselves_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), float(rng.normal()), int(rng.integers(4))) for i in range(80)]
    got = {r.id: r for r in samplers.cross_validated_centroids(spark.createDataFrame(rows, "id int, c int, x double, f int"), "id", "c", "x", "f").collect()}
    for i, _, x, f in rows:
        means = {c: np.mean([y for _, k, y, g in rows if k == c and g != f]) for c in range(3)}
        best = min(means, key=lambda c: (round(abs(x - means[c]), 12), c))
        assert got[i].guess == best and np.isclose(got[i].d, abs(x - means[best]))


def test_draws_take_the_share_that_their_number_hits(spark):
    rng = random.Random(6)
    train = [(i, i % 2, rng.choice([0.0, 0.01, 1.0, 30.0])) for i in range(300)]
    t = spark.createDataFrame(train, "pick bigint, g int, w double")
    q = spark.createDataFrame([(k, k % 2) for k in range(20)], "test bigint, g int")
    got = samplers.weighted_draws(q, t, "g", "w", 50, "s").toPandas()
    assert len(got) == 1000
    import hashlib

    for r in got.itertuples():
        own = [(p, w) for p, g, w in train if g == r.test % 2]
        u = int(hashlib.md5(f"s:{r.test}:{r.n}".encode()).hexdigest()[:12], 16) / 2**48 * sum(w for _, w in own)
        ends = np.cumsum([w for _, w in own])
        assert r.pick == own[int(np.searchsorted(ends, u, "right"))][0]


def test_query_sets_meet_all_rows_in_blocks(spark, monkeypatch):
    rows, queries = spark.range(40).withColumnRenamed("id", "a"), spark.range(25).withColumnRenamed("id", "b")
    whole = sorted(map(tuple, distance.meet(rows, queries).collect()))
    monkeypatch.setattr(distance, "SENT_ROWS", 4)
    assert sorted(map(tuple, distance.meet(rows, queries).select("a", "b").collect())) == whole and len(whole) == 1000
    df = spark.createDataFrame([(0 if i < 30 else 1, i, [float(i)]) for i in range(40)], "g int, k int, v array<double>")
    pairs = sorted((r.g, r.i, r.j, r.d) for r in distance.pairs_within(df, "g", "k", "v", distance.euclidean).collect())
    assert pairs == [(g, i, j, float(j - i)) for g, lo, hi in ((0, 0, 30), (1, 30, 40)) for i in range(lo, hi) for j in range(i + 1, hi)]


def test_banded_warping_of_many_pairs(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(20, 9)), rng.normal(size=(20, 9))

    def one(a, b, w):
        t = np.full((10, 10), np.inf)
        t[0, 0] = 0
        for i in range(1, 10):
            for j in range(max(1, i - w + 1), min(9, i + w - 1) + 1):
                t[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(t[i - 1, j - 1], t[i - 1, j], t[i, j - 1])
        return np.sqrt(t[9, 9])

    for w in (1, 3, 9):
        assert np.allclose(distance.banded(x, y, w), [one(a, b, w) for a, b in zip(x, y)])
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 3.0], 1), ([1.0, 2.0, 3.0], [1.0, 1.0, 3.0], 2), ([0.0, 0.0], [3.0, 4.0], 1)], "a array<double>, b array<double>, w int")
    assert np.allclose([r[0] for r in df.select(distance.dtw("a", "b", "w")).collect()], [1.0, 1.0, 5.0])


@pytest.mark.parametrize("columns", [5, 11])
def test_assignments_with_forbidden_cells(columns):
    rng = np.random.default_rng(columns)
    cost = rng.integers(0, 9, (30, 3, columns)).astype(float)
    cost[rng.random(cost.shape) < 0.5] = np.inf
    want = [min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(columns), 3)) for c in cost]
    assert np.allclose(matching.least_assignments(cost), want)


def test_season_matching_by_permutations(spark, vals):
    ids, _, x = vals
    at = {i: k for k, i in enumerate(ids)}
    for r in QUERIES["d7_season_matching"](spark, DATA).where("query = 40 and other < 12").collect():
        a, b = x[at[r.query]].reshape(8, 8), x[at[r.other]].reshape(8, 8)
        d = np.linalg.norm(a[:, None] - b[None], axis=2)
        allowed = [p for p in permutations(range(8)) if all(min(abs(i - j), 8 - abs(i - j)) <= 2 for i, j in enumerate(p))]
        assert np.isclose(r.d, min(sum(d[i, j] for i, j in enumerate(p)) for p in allowed))


def test_runs_and_masks_in_one_pass(spark):
    rng = np.random.default_rng(9)
    rows = [(k, i, None if rng.random() < 0.4 else float(rng.integers(3))) for k in range(20) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, pos int, v double")
    null, zero = (sequences.runs(df, ["k"], "pos", c) for c in (F.col("v").isNull(), F.col("v") == 0))
    kinds = sequences.runs_of_kinds(df, ["k"], "pos", "v", F.when(F.col("v").isNull(), 1).when(F.col("v") == 0, 2))
    for kind, found in ((1, null), (2, zero)):
        want = sequences.neighbours(df, found, ["k"], "pos", "v")
        names = sorted(want.columns)
        order = lambda d: sorted(map(str, d.select(names).collect()))
        assert order(kinds.where(F.col("kind") == kind)) == order(want)
    want = intervals.mask(df, null.where("end - start >= 3"), ["k"], "pos", "v")
    got = intervals.mask_long_runs(df, ["k"], "pos", "v", F.col("v").isNull(), 3)
    assert sorted(map(str, got.select("k", "pos", "v").collect())) == sorted(map(str, want.select("k", "pos", "v").collect()))


def test_robust_parts_ignore_a_peak(spark):
    rows = [("m", i, float(i % 4) + (1000 if i == 17 else 0)) for i in range(40)]
    out = sequences.decompose_robust(spark.createDataFrame(rows, "k string, pos int, v double"), ["k"], "pos", "v", 4, 40).toPandas().sort_values("pos")
    assert out.trend.isna().sum() == 4 and out.season.nunique() == 4 and abs(out.season).max() <= 2
    assert abs(out[out.pos == 17].rest.iloc[0] - 1000) < 3 and abs(out[out.pos != 17].rest.dropna()).max() < 3


def test_file_dialects(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id;gemeente;waarde\n1;Li\xe8ge;1,5\n2;Sint-J\xf6ris;/\n".encode("latin-1"))
    rows = dialects.read_csv(spark, str(tmp_path / "latin.csv"), "id int, gemeente string, waarde string", sep=";", encoding="ISO-8859-1")
    assert [(r.gemeente, r.v) for r in rows.select("gemeente", dialects.decimal_comma(F.col("waarde")).alias("v")).collect()] == [("Li\xe8ge", 1.5), ("Sint-J\xf6ris", None)]
    (tmp_path / "bare.csv").write_text("7,2016-01-01,0.25\n8,2016-01-02,\n")
    bare = dialects.read_csv(spark, str(tmp_path / "bare.csv"), "meter int, day date, value double", header=False)
    assert [(r.meter, str(r.day), r.value) for r in bare.collect()] == [(7, "2016-01-01", 0.25), (8, "2016-01-02", None)]
    names = ["date_time", *(f"w{k}" for k in range(24))]
    (tmp_path / "weather.csv").write_text(",".join(names) + "\n" + "2016-01-01 00:00:00," + ",".join(str(k / 2) for k in range(24)) + "\n")
    weather = dialects.read_csv(spark, str(tmp_path / "weather.csv"), "date_time timestamp_ntz, " + ", ".join(f"{n} double" for n in names[1:])).select("date_time", "w3")
    assert weather.first().w3 == 1.5 and "w4" not in weather._jdf.queryExecution().executedPlan().toString().partition("ReadSchema")[2]


def test_stored_tables(spark, tmp_path):
    path, made = str(tmp_path / "once"), []

    def make():
        made.append(1)
        return spark.range(5)

    assert stored.computed_once(spark, path, make).count() == stored.computed_once(spark, path, make).count() == 5 and len(made) == 1
    (tmp_path / "once" / "_SUCCESS").unlink()
    assert stored.computed_once(spark, path, make).count() == 5 and len(made) == 2
    assert stored.first_existing(spark, [str(tmp_path / "no"), path]) == path
    with pytest.raises(FileNotFoundError):
        stored.first_existing(spark, [str(tmp_path / "no")])
    df = spark.createDataFrame([(1, "net", "day"), (2, "net", "week"), (3, "offtake", "day")], "id int, measure string, granularity string")
    stored.write_selectable(df, str(tmp_path / "by"))
    got = stored.selected(spark, str(tmp_path / "by"), measure="net", granularity="day")
    assert [tuple(r) for r in got.collect()] == [(1,)] and "PartitionFilters: [isnotnull" in got._jdf.queryExecution().executedPlan().toString()


def test_toy_densities(spark):
    made = {name: np.array([r.point for r in densities.points(spark, name, 1000).orderBy("i").collect()]) for name in [*densities.DENSITIES, *densities.JOINT]}
    assert all(x.shape == (1000, 1 if name == "1normal" else {"2": 2, "4": 4, "8": 8}[name[0]] * 2 if "spirals-" in name else 2) and np.isfinite(x).all() for name, x in made.items()) or {k: v.shape for k, v in made.items()}
    centres = np.array(densities.EIGHT) / 1.414
    gaps = np.linalg.norm(made["8gaussians"][:, None] - centres[None], axis=2)
    assert (gaps.min(axis=1) < 1.6).all() and np.bincount(gaps.argmin(axis=1), minlength=8).min() > 80
    assert np.allclose(made["line"][:, 0], made["line"][:, 1]) and abs(made["1normal"].mean() - 2) < 0.1 and abs(made["1normal"].std() - 0.5) < 0.05
    assert {round(r / 0.75) for r in np.linalg.norm(made["rings"], axis=1)} == {1, 2, 3, 4}
    x = made["checkerboard"]
    assert ((np.floor(x[:, 0] / 2) + np.floor(x[:, 1] / 2)) % 2 == 0).all()
    joint = made["4-2spirals-8gaussians"]
    assert not np.allclose(joint[:, :2], joint[:, 4:6])


def test_archives_spreadsheets_and_arrays(spark, tmp_path):
    import io
    import zipfile
    import zlib

    from loadscape.sources import archives

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("good.csv", "a;b\n1;2\n")
        z.writestr("bad.csv", "x" * 50)
    broken = raw.getvalue().replace(b"x" * 50, b"x" * 49 + b"y")
    (tmp_path / "two.zip").write_bytes(broken)
    got = {r.name: r for r in archives.zip_members(spark, str(tmp_path / "two.zip")).collect()}
    assert got["good.csv"].intact and got["good.csv"].content == b"a;b\n1;2\n" and got["good.csv"].crc == zlib.crc32(b"a;b\n1;2\n")
    assert not got["bad.csv"].intact and got["bad.csv"].size == 50
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>meter</t></si><si><r><t>Li</t></r><r><t>\xe8ge</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>in</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>42370.25</v></c><c r="C3"/></row></sheetData></worksheet>')
    cells = archives.spreadsheet_cells(spark, str(tmp_path / "book.xlsx"))
    assert sorted((r.row, r.column, r.value) for r in cells.where("value is not null").collect()) == [(1, 0, "meter"), (1, 27, "in"), (3, 0, "Li\xe8ge"), (3, 1, "42370.25")]
    stamp = cells.where("`column` = 1 and row = 3").select(dialects.excel_serial(F.col("value").cast("double"))).first()[0]
    assert str(stamp) == "2016-01-01 06:00:00"
    np.savez(tmp_path / "a.npz", x=np.arange(6).reshape(2, 3), y=np.ones((1, 2, 2)))
    np.save(tmp_path / "b.npy", np.array([1.5, 2.5]))
    rows = {(r.name, r.row): r.vals for r in archives.numpy_rows(spark, str(tmp_path / "*.np*")).collect()}
    assert rows == {("x", 0): [0, 1, 2], ("x", 1): [3, 4, 5], ("y", 0): [1, 1, 1, 1], ("", 0): [1.5], ("", 1): [2.5]}


def test_strategies_by_name(spark):
    from loadscape.operators import strategies

    df, x = blobs(spark)
    for name, fit in strategies.ESTIMATORS.items():
        found = fit(df, "id", "vals", 3)
        labels, centers = {r.id: r.cluster for r in found.labels.collect()}, {r.cluster: r.center for r in found.centers.collect()}
        assert len(labels) == 180 and {*labels.values()} == {*centers}
        want = {c: x[[i for i, k in labels.items() if k == c]].mean(0) if name == "kmeans" else x[c] for c in centers}
        assert all(np.allclose(centers[c], want[c]) for c in centers)
    q = df.where("id % 60 = 0")
    for name in strategies.METRICS:
        near = strategies.nearest_by(df, q, "id", "vals", name, 2).collect()
        assert len(near) == 6 and all(r.query // 60 == r.other // 60 for r in near)


def test_draws_meet_by_blocks_and_equal_the_smallest_digests(spark, monkeypatch):
    import hashlib

    from loadscape.operators import samplers
    from loadscape.operators.digests import Tails

    texts = [str(i * 37 - 500).encode() for i in range(3000)] + [b"", b"z" * 60]
    for head in (b"pick:7:", b"pick:12:", b"abc:-9:", b"", b"x" * 50):
        want = sorted((hashlib.md5(head + x).digest(), i) for i, x in enumerate(texts))
        assert sorted(Tails(texts).least(head, 10))[:10] == want[:10]
        assert Tails(texts).first_words(head).tolist() == [int(hashlib.md5(head + x).hexdigest()[:8], 16) for x in texts]
    monkeypatch.setattr(samplers, "DRAWN_ROWS", 50)
    monkeypatch.setattr(samplers, "DRAWING_TESTS", 3)
    rows = spark.createDataFrame([(i * 7 - 300,) for i in range(400)] + [(None,)], "pick bigint")
    asked = spark.createDataFrame([(t,) for t in (-20, 0, 5, 40, 60, 80, 100)], "test bigint")
    found = samplers.draw(asked, rows, 10, "pick")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got: dict[int, set] = {}
    for r in found.collect():
        assert r.p == 0.1
        got.setdefault(r.test, set()).add(r.pick)
    keys = [i * 7 - 300 for i in range(400)]
    assert got == {t: set(sorted(keys, key=lambda x: hashlib.md5(f"pick:{t}:{x}".encode()).hexdigest())[:10]) for t in (-20, 0, 5, 40, 60, 80, 100)}
    few = spark.createDataFrame([(1,), (None,), (2,)], "pick bigint")
    assert {r.pick for r in samplers.draw(asked, few, 2, "pick").collect()} == {1, 2}


def test_power_iteration_without_pairs_finds_blobs_and_sums_all_pairs(spark, monkeypatch):
    from loadscape.operators import blocks

    monkeypatch.setattr(blocks, "SUMMED_ROWS", 5)
    small, x = blobs(spark, 12, 2)
    rows = small.withColumn("g", F.lit(0)).withColumn("value", (F.col("id") % 5).cast("double"))
    got = {r.id: (r.total, r.degree) for r in blocks.similar_sums(rows, "g", "id", "vals", "value", 0.7).collect()}
    near = np.exp(-np.linalg.norm(x[:24, None] - x[None, :24], axis=2) / 0.7) * (1 - np.eye(24))
    assert all(np.allclose(got[i], (near[i] @ (np.arange(24) % 5), near[i].sum())) for i in range(24))
    found = models.power_iteration_within(rows, "g", "id", "vals", 2, 1.0).join(small, "id")
    assert found.count() == 24 and clustering.adjusted_rand(found, "truth", "cluster").first()[0] == 1.0
