import numpy as np

from tidemark.llm import contour, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component int, n string, white int"


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, "n", 3) for i, v in vectors]


def sample(n=300, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    spread = np.linspace(3, 0.5, dims)
    return [(i, row.astype(np.float32)) for i, row in enumerate(rng.standard_normal((n, dims)) * spread + 1)]


def odd(vectors):
    dims = len(vectors[0][1])
    extra = [(901, None), (902, []), (903, [None] * dims), (904, [np.nan] * dims), (905, [np.inf] + [0] * (dims - 1))]
    extra += [(906, [1.0] * (dims + 1)), (907, vectors[0][1]), (907, vectors[0][1]), (None, vectors[1][1]), (908, [1e37] * dims)]
    return vectors + extra + [(909 + i, vectors[2][1]) for i in range(150)]


def test_whitening_against_plain_moments(spark):
    vectors = odd(sample())
    found = whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5), ["vec_id"]).toPandas()
    dropped = {901, 902, 903, 904, 905, 906, 908}
    kept = [(i, np.floor(256 * v.astype(float)).astype(np.int64)) for i, v in vectors if i not in dropped]
    x = np.array([v for _, v in kept])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - sums / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:4], vecs[:, ::-1][:, :4]
    white = (x - sums / n) @ vecs / np.sqrt(values)
    deviation = ((n * x.astype(object) - sums) ** 2).sum(1)
    assert len(found) == 4 * len(kept) and set(found.n) == {n} and found.identity_error.nunique() == 1
    assert found.identity_error.max() < 1e-9
    wanted = sorted((-1 if i is None else i, int(d)) for (i, _), d in zip(kept, deviation, strict=True))
    for component in (1, 2, 3, 4):
        rows = found[found.component == component].fillna({"vec_id": -1})
        assert sorted(zip(rows.vec_id.astype(int), rows.deviation.astype(int), strict=True)) == wanted
        assert abs(rows.explained.iloc[0] - values[component - 1] / (centred**2).mean(0).sum()) < 1e-12
        of_id = {-1 if i is None else i: row for (i, _), row in zip(kept, white[:, component - 1], strict=True)}
        wanted_white = np.array([of_id[int(i)] for i in rows.vec_id])
        turn = np.sign((wanted_white * rows.whitened).sum())
        assert np.abs(rows.whitened * turn - wanted_white).max() < 1e-9


def test_result_does_not_depend_on_the_layout(spark):
    rows = spark.createDataFrame(rows_of(odd(sample())), SCHEMA)
    one, other = (
        whitening.whiten(rows.repartition(k), ["vec_id"]).orderBy("vec_id", "component").drop("identity_error").collect()
        for k in (1, 7)
    )
    assert one == other


def test_few_rows_and_dimensions(spark):
    def whiten(vectors, **options):
        return whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA), ["vec_id"], **options).collect()

    assert whiten([]) == [] and whiten([(1, None)]) == [] and whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = whiten([(1, [0.0, 0.0]), (2, [1.0, 0.0])])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["explained"]) for r in two] == [
        (1, 1, 2, 65536, 1.0), (2, 1, 2, 65536, 1.0),
    ]
    assert sorted(abs(r["whitened"]) for r in two) == [1.0, 1.0]
    assert {r["component"] for r in whiten([(i, [float(i), float(i * i)]) for i in range(9)])} == {1, 2}


def test_sums_beyond_doubles_are_exact(spark):
    big = [[2.0**40, 1.0], [-(2.0**40), 3.0], [2.0**39, -7.0]]
    schema = SCHEMA.replace("array<float>", "array<double>")
    rows = spark.createDataFrame(rows_of(list(enumerate(big))), schema)
    found = whitening.whiten(rows, ["vec_id"], components=1).orderBy("vec_id").collect()
    x = [[int(256 * c) for c in row] for row in big]
    sums = [sum(column) for column in zip(*x, strict=True)]
    wanted = [sum((3 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert [row["deviation"] for row in found] == [d if d < 2**63 else None for d in wanted]


def test_contour_finds_all_components():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    spectra = [
        np.linspace(50, 1, 40), [1e6, 5, 4.999, 4.99, *np.linspace(4.9, 1, 36)], [9, 7, 7, 5, 5, 5, *[1] * 34],
        [5, 3, *[0] * 38], [2] * 40, [0] * 40, [-1, -2, -3, -4, *np.linspace(-5, -9, 36)],
    ]
    for spectrum in spectra:
        matrix = turn @ np.diag(np.array(spectrum, float)) @ turn.T
        matrix = (matrix + matrix.T) / 2
        values, vectors = contour.eigenpairs(matrix, 4)
        plain = np.linalg.eigvalsh(matrix)[::-1]
        scale = max(np.abs(plain).max(), 1.0)
        assert np.abs(values - plain[:4]).max() < 1e-13 * scale
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
        bands = contour.tridiagonal(matrix)
        for shift in (-6.5, 0.5, 4.95, 6.0, 100.0):
            assert contour.values_above(bands, shift) == (plain > shift).sum()
    assert np.abs(contour.eigenpairs(np.eye(2), 4)[0] - 1).max() < 1e-14
    assert len(contour.eigenpairs(np.zeros((0, 0)), 4)[0]) == 0
