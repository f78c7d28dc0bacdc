import random
import re
from collections import Counter

import pytest
from conftest import rows
from speechloom.llm import packing as P


def placed(places, counts):
    """Container of every item by the places of its size and rank."""
    out = []
    for size, n in counts.items():
        mine = [p for p in places if p[0] == size]
        for r in range(n):
            _, rank, first, per = max(p for p in mine if p[1] <= r)
            out.append((size, first + (r - rank) // per))
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        cap = rng.choice([5, 16, 100])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randrange(1, 120)))
        used = Counter()
        for size, c in placed(P.best_fit_decreasing(counts, cap), counts):
            used[c] += size
        room: list[int] = []
        for s in sorted(counts.elements(), reverse=True):
            fits = [r for r in room if r >= s]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - s)
            else:
                room.append(cap - s)
        assert sorted(cap - u for u in used.values()) == sorted(room) and min(used) == 0 and max(used) == len(used) - 1


def pieces(spark, data, cap=10, parts=2):
    return P.pack(spark.createDataFrame(data, "id string, n bigint").repartition(parts), "id", "n", cap).collect()


def test_only_what_is_too_large_is_split(spark):
    got = pieces(spark, [("a", 25), ("b", 10), ("c", 3), ("d", 20)])
    by = {k: sorted((r.piece, r.offset, r.length) for r in got if r.id == k) for k in "abcd"}
    assert by == {"a": [(0, 0, 10), (1, 10, 10), (2, 20, 5)], "b": [(0, 0, 10)], "c": [(0, 0, 3)], "d": [(0, 0, 10), (1, 10, 10)]}


@pytest.mark.parametrize("parts,copies", [(1, 65_536), (5, 65_536), (3, 2)])
def test_one_packing_of_everything_whatever_the_layout(spark, monkeypatch, parts, copies):
    monkeypatch.setattr(P, "COPIES", copies)
    rng = random.Random(3)
    data = [(f"i{k % 150}", rng.randint(1, 34)) for k in range(200)] + [("same", 4)] * 30
    got = pieces(spark, data, 10, parts)
    used = Counter()
    for r in got:
        used[r.container] += r.length
    assert max(used.values()) <= 10 and Counter((r.id, r.length) for r in got if r.piece == 0) == Counter((i, min(n, 10)) for i, n in data)
    sizes = Counter(m for _, n in data for m in [10] * (n // 10) + [n % 10] * (n % 10 > 0))
    alone = Counter()
    for size, c in placed(P.best_fit_decreasing(sizes, 10), sizes):
        alone[c] += size
    assert sorted(used.values()) == sorted(alone.values())


def test_nulls_zeros_empty_and_clashing_columns(spark):
    assert sorted((str(r.id), r.length) for r in pieces(spark, [(None, 4), (None, 4), ("z", 0), ("n", None), ("m", -1)])) == [("None", 4), ("None", 4)]
    d = spark.createDataFrame([("a", 3, 9, 9)], "key string, size bigint, length int, container int")
    assert P.pack(d, "key", "size", 10).count() == 1 and P.pack(d.limit(0), "key", "size", 10).count() == 0


def test_large_ids_beside_a_null_stay_exact(spark):
    ids = [9007199254740993, None, 9007199254740995]
    d = spark.createDataFrame([(i, 3) for i in ids], "id bigint, n bigint").coalesce(1)
    assert {r.id for r in P.pack(d, "id", "n", 10).collect()} == set(ids)


def test_tokens(spark):
    texts = ["Hello, world!!", "", None, "a_b c-d", "あのー、です。", "éa", "x　y\xa0z​", "½ ٣", "w" * 100_000 + " ."]
    want = [0 if t is None else len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in d.orderBy("i").select(P.count_tokens(d.t)).collect()] == want


def test_documents(spark):
    d = spark.createDataFrame([(1, "a " * 2000), (2, "b"), (3, None), (4, "")], "doc_id bigint, text string").selectExpr("*", "5 as size", "6 as n_tokens")
    assert rows(P.pack_documents(d).groupBy("doc_id").count()) == [(1, 2), (2, 1)]
