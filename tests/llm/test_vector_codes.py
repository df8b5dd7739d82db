"""Vector codes against evaluation of every entry; odd vectors, ties and labels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textpairs.llm import catalogue
from textpairs.llm.vector_codes import Codebooks, NearestEntry, compress_vectors

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def nearest(vectors, entries):
    apart = ((vectors[:, None] - entries[None]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


@given(st.integers(1, 70), st.integers(1, 5), st.sampled_from([None, 1, 3, 16, 500]), st.integers(0, 10**6), st.sampled_from([2, 20, 4000]))
@settings(max_examples=120, deadline=None)
def test_cells_lose_no_nearest_entry(n, width, side, seed, spread):
    rng = np.random.default_rng(seed)
    entries, vectors = rng.integers(-spread, spread, (n, width)), rng.integers(-spread, spread, (300, width))
    coder = NearestEntry(entries, side, cells=40)
    for _ in range(2):
        for got, want in zip(coder.assign(vectors), nearest(vectors, entries)):
            assert got.tolist() == want.tolist()


def test_cells_spare_most_entries():
    rng = np.random.default_rng(1)
    entries, vectors = rng.integers(-150, 150, (64, 4)), rng.integers(-150, 150, (20_000, 4))
    coder = NearestEntry(entries)
    places, _ = coder.assign(vectors)
    assert places.tolist() == nearest(vectors, entries)[0].tolist()
    assert coder.evaluated < 0.4 * len(vectors) * len(entries)
    # A second look finds the cells already there.
    known = len(coder.known)
    coder.assign(vectors)
    assert len(coder.known) == known


def plain(rows, parts=16, size=64, rounds=2):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    floored = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept]
    first = sorted(floored, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    width = len(floored[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((apart(cut(v, p), entry), e) for e, entry in enumerate(books[p]))
    for _ in range(rounds):
        members = {}
        for _, v, _ in floored:
            for p in range(parts):
                members.setdefault((p, best(v, p)[1]), []).append(cut(v, p))
        for (p, e), found in members.items():
            books[p][e] = [sum(xs) // len(xs) for xs in zip(*found)]
    coded = [(i, label, [best(v, p) for p in range(parts)]) for i, v, label in floored]
    totals = {}
    for _, label, found in coded:
        totals[label] = totals.get(label, 0) + sum(d for d, _ in found)
    return [(i, [e for _, e in found], sum(d for d, _ in found), totals[label]) for i, label, found in coded], books


def content(rows):
    return sorted(repr((r["vec_id"], list(r["code"]), r["error"], r["label_error"])) for r in rows)


def odd_rows(n=150, width=32):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, width).round(3).tolist(), None if i % 7 == 0 else int(i % 3 > 0)) for i in range(n)]
    same = rows[5]
    rows += [same, same, (5, [0.5] * width, 1), (None, [0.25] * width, None), (None, [-0.001] * width, 4)]
    rows += [(200, None, 1), (201, [], 1), (202, [float("nan")] * width, 1), (203, [float("-inf")] + [0.0] * (width - 1), 1), (204, [None] + [0.0] * (width - 1), 1)]
    return rows


def test_odd_vectors(spark):
    rows = odd_rows()
    want, books = plain(rows)
    frames = [spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)]
    frames.append(frames[0].selectExpr("*", "vec_id as q", "label as salt", "vec_id as code", "label as error", "vec_id as of", "vec_id as `odd.name`"))
    for frame in frames:
        found, codebooks = compress_vectors(frame)
        assert content(found.collect()) == sorted(map(repr, want))
        assert codebooks.tolist() == books


def test_few_vectors_and_none(spark):
    rows = odd_rows()[:9]
    found, books = compress_vectors(spark.createDataFrame(rows, SCHEMA))
    assert books.shape == (16, 9, 2) and content(found.collect()) == sorted(map(repr, plain(rows)[0]))
    for empty in ([], [(1, None, 2), (None, [], None)]):
        found, books = compress_vectors(spark.createDataFrame(empty, SCHEMA))
        assert books is None and found.count() == 0 and found.columns == ["vec_id", "code", "error", "label_error"]


def test_vectors_that_have_no_code(spark):
    uneven = [(i, [0.0] * (32 if i < 3 else 48), 0) for i in range(5)]
    for rows in (uneven, [(0, [0.0] * 30, 0)], [(0, [1e9] * 32, 0)]):
        with pytest.raises(Exception, match="number of components|differ in length|below 65,536"):
            compress_vectors(spark.createDataFrame(rows, SCHEMA), entries=2)[0].collect()


def test_digest_names_every_component():
    import hashlib

    books = np.arange(-3, 9).reshape(2, 3, 2)
    assert Codebooks(books).digest() == hashlib.sha256(b"-3,-2,-1,0,1,2,3,4,5,6,7,8").hexdigest()


def test_query_equals_plain_version(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, books = plain(rows)
    digest = Codebooks(np.array(books)).digest()
    found = catalogue.QUERIES["op13_memoised_cells"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted((i, "".join(f"{c:02x}" for c in code), e, t, digest) for i, code, e, t in want)


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalogue.QUERIES["op13_memoised_cells"](spark, str(tmp_path)).collect() == []
