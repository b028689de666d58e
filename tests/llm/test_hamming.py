import numpy as np
import pyarrow as pa
import pytest

from surveyloom.llm import hamming


def brute_force(ids, vectors, k, chosen):
    signs = np.array(vectors) > 0
    out = {}
    for i, q in enumerate(ids):
        if chosen(q):
            far = [(int((signs[i] != signs[j]).sum()), v) for j, v in enumerate(ids) if v != q]
            out[q] = [(n + 1, v, d) for n, (d, v) in enumerate(sorted(far)[:k])]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"], r["distance"]))
    return out


def table(spark, ids, vectors):
    rows = [(i, v if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    near = centres[rng.integers(0, 6, 300)] + 0.4 * rng.normal(size=(300, 64))
    return [*near, *rng.normal(size=(200, 64)), *[centres[0]] * 40, -centres[0]]


@pytest.mark.parametrize("bucket,block", [(1 << 15, 1 << 14), (20, 7)])
@pytest.mark.parametrize("length", [64, 10])
def test_equals_brute_force(spark, vectors, monkeypatch, bucket, block, length):
    monkeypatch.setattr(hamming, "BUCKET_CODES", bucket)
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", block)
    ids, some = [3 * i for i in range(len(vectors))], [v[:length] for v in vectors]
    got = found(hamming.nearest_vectors(table(spark, ids, some), 10))
    assert got == brute_force(ids, some, 10, lambda i: i % 20 == 0)


def test_long_vectors_with_a_very_common_segment(spark, vectors, monkeypatch):
    """128 components, of which the first half is the same in nearly all rows."""
    monkeypatch.setattr(hamming, "BUCKET_CODES", 30)
    wide = [np.concatenate([vectors[0] if i % 9 else v, vectors[-1 - i]]) for i, v in enumerate(vectors[:300])]
    ids = list(range(len(wide)))
    got = found(hamming.nearest_vectors(table(spark, ids, wide), 4))
    assert got == brute_force(ids, wide, 4, lambda i: i % 20 == 0)


def test_many_equal_vectors(spark, vectors):
    ids, same = list(range(60)), [vectors[0]] * 50 + vectors[1:11]
    got = found(hamming.nearest_vectors(table(spark, ids, same), 5))
    assert got == brute_force(ids, same, 5, lambda i: i % 20 == 0)


def test_fewer_rows_than_asked_for_and_rows_left_out(spark, vectors):
    ids, some = [0, 1, 20, None, 40], [vectors[0], vectors[1], None, vectors[2], []]
    got = found(hamming.nearest_vectors(table(spark, ids, some), 10))
    assert got == brute_force([0, 1], vectors[:2], 10, lambda i: i == 0)


def test_several_lengths_need_a_choice(spark, vectors):
    ids, some = [0, 1, 20, 21, 22], [*vectors[:2], *(v[:10] for v in vectors[2:5])]
    with pytest.raises(ValueError, match="10 to 64"):
        hamming.nearest_vectors(table(spark, ids, some), 10)
    for bits, part in ((64, slice(0, 2)), (10, slice(2, 5))):
        got = found(hamming.nearest_vectors(table(spark, ids, some), 10, bits=bits))
        assert got == brute_force(ids[part], some[part], 10, lambda i: i % 20 == 0)


def test_null_and_nan_components_are_not_positive(spark):
    rows = [(0, [1.0, None, 1.0]), (1, [1.0, -1.0, 1.0]), (2, [1.0, float("nan"), -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert found(hamming.nearest_vectors(df, 2)) == {0: [(1, 1, 0), (2, 2, 1)]}


def test_empty_table_and_other_columns(spark, vectors):
    assert hamming.nearest_vectors(table(spark, [], [])).count() == 0
    df = table(spark, [0, 1], vectors[:2]).selectExpr("*", "1 as code", "2 as id", "3 as distance")
    assert hamming.nearest_vectors(df).count() == 1


@pytest.mark.parametrize("prefix", [0, 3])
def test_every_code_is_met_once(vectors, prefix):
    """Over all buckets, segments and radii; the smaller radii meet what they are said to."""
    signs, widths = np.unique(np.array(vectors)[:70] > 0, axis=0), [8] * 8
    parts = signs.reshape(-1, 8, 8).astype(np.int32) @ (1 << np.arange(8, dtype=np.int32))
    ids, queries = pa.array([[i] for i in range(len(parts))]), parts[:3]
    away = (signs[:3, None] != signs).sum(2)
    seen = np.zeros((3, len(parts)), int)
    for radius in range(9):
        for segment, width in enumerate(widths):
            for bucket in range(1 << prefix):
                here = np.flatnonzero(parts[:, segment] >> (width - prefix) == bucket)
                if len(here):
                    cell = hamming.Cell(parts[here], ids.take(pa.array(here)), segment, bucket, width - prefix)
                    for who, at, distance in cell.met(queries, radius):
                        other = cell.ids.take(pa.array(at)).flatten().to_numpy()
                        assert (distance == away[who, other]).all()
                        np.add.at(seen, (who, other), 1)
        assert (seen[away < 8 * (radius + 1)] == 1).all()
    assert (seen == 1).all()


def test_copies_of_a_code_do_not_grow_with_the_table(spark, vectors, monkeypatch):
    """A code is written once a segment, and a query asks no more buckets than lie within the radius."""
    written = {}

    def spy(df, name="table"):
        out = kept(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    kept = hamming.materialise
    monkeypatch.setattr(hamming, "materialise", spy)
    monkeypatch.setattr(hamming, "BUCKET_CODES", 16)
    for rows in (120, 480):
        written.clear()
        hamming.nearest_vectors(table(spark, list(range(rows)), vectors[:rows]), 3).count()
        codes, queries = written["entries"][0], written["asking"][0]
        widths = hamming.segment_widths(64, codes)
        prefix = int(np.ceil(np.log2(codes / 16)))
        assert written["homes"] == [codes * len(widths)]
        assert written["probes"][:2] == [queries * len(widths), written["asking"][1] * len(widths) * (1 + prefix)]
