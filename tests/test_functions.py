import itertools
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conformix.functions import names, types
from conformix.functions.similarity import Side, Weights, feature_score, jaro_winkler, type_set_score
from conformix.operators import matching
from conformix.operators.assignment import best_assignment, best_flow

NAMES = [("ThisName", "this_name"), ("thisName", "this_name"), ("this_name", "this_name"), ("HTTPResponse", "http_response"), ("kebab-case", "kebab_case"), ("runAsync", "run_async"), ("XMLParser", "xml_parser"), ("JSONReaderWorker", "json_reader_worker"), ("My_Name", "my__name"), ("_x", "_x"), ("", "")]


def test_normalize_name(spark):
    df = spark.createDataFrame(NAMES, "a string, b string").select(names.normalize_name(F.col("a")).alias("got"), "b")
    assert [r for r in df.collect() if r["got"] != r["b"]] == []


@pytest.mark.parametrize(
    "path, root, want",
    [("/r/src/a.py", "/r/src", "lib"), ("/r/src/x/a.py", "/r/src", "lib_x"), ("/r/src/x/y_z/a.py", "/r/src", "lib_x_y_z"), ("/q/a.py", "/r/src", "lib"), ("/r/src2/x/a.py", "/r/src", "lib_.._src2_x")],
)
def test_normalize_namespace(spark, path, root, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(names.normalize_namespace(F.col("p"), root, "lib")).first()[0] == want


TYPES = [
    ("python", "str", "STRING"), ("python", "None", "NULL"), ("python", "any", "OBJECT"), ("python", "Optional[str]", "STRING NULL"), ("python", "Union[str, int]", "STRING NUMBER"), ("python", "List[int]", "LIST"), ("python", "Tuple[str, int]", "STRING NUMBER"), ("python", "RunConfig | None", "OBJECT NULL"), ("python", "", "OBJECT"),
    ("typescript", "string[]", "LIST"), ("typescript", "Array<string>", "LIST"), ("typescript", "Map<string, number>", "MAP"), ("typescript", "void", "NULL"), ("typescript", "string | null", "STRING NULL"), ("typescript", "Promise<string>", "STRING"), ("typescript", "{a: string}", "MAP"),
    ("java", "Integer", "NUMBER"), ("java", "Optional<String>", "STRING NULL"), ("java", "List", "OBJECT"), ("java", "Single<String>", "STRING"), ("java", "void", "NULL"),
    ("go", "[5]int", "LIST"), ("go", "* string", "STRING"), ("go", "**[]x", "LIST"), ("go", "[ x ]", "OBJECT"), ("nope", "str", "STRING"), ("nope", "Mine", "OBJECT"),
]


def test_types(spark):
    assert [(l, t, types.normalize_type(t, l)) for l, t, w in TYPES if types.normalize_type(t, l) != w.split()] == []
    df = spark.createDataFrame([(l, t, w) for l, t, w in TYPES], "l string, t string, w string")
    got = df.select(types.normalized_types(F.col("t"), F.col("l")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"].split() for r in got)


def test_jaro_winkler_agrees_with_duckdb():
    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("abcd_") for _ in range(rng.randint(0, 14))) for _ in range(2)) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (i INT, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    for (a, b), (s,) in zip(pairs, con.execute("SELECT jaro_winkler_similarity(a, b) FROM p ORDER BY i").fetchall()):
        assert abs(jaro_winkler(a, b) - s) < 1e-12


_POOL = ["OBJECT", "STRING", "NUMBER", "MAP", "UNKNOWN", "ANY", "NULL"]


def _pair(a, b):
    if a == b:
        return 1.0
    both = {a, b}
    if "MAP" in both and both & {"OBJECT", "ANY"}:
        return 0.4
    if both & {"UNKNOWN", "ANY"}:
        return 0.3
    return 0.2 if "OBJECT" in both else 0.0


@given(st.frozensets(st.sampled_from(_POOL), max_size=3), st.frozensets(st.sampled_from(_POOL), max_size=3))
def test_type_sets_match_the_pairwise_maximum(a, b):
    want = max((_pair(x, y) for x in a for y in b), default=1.0 if not a and not b else 0.0)
    assert type_set_score(a, b) == type_set_score(b, a) == want


def test_assignment_is_optimal():
    rng = np.random.RandomState(1)
    for _ in range(300):
        n, m = rng.randint(1, 6, 2)
        score = rng.choice([0, 0.5, 1, rng.rand()], (n, m))
        rows, cols = best_assignment(score)
        small = score if n <= m else score.T
        best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert len(set(rows)) == len(set(cols)) == min(n, m) and abs(score[rows, cols].sum() - best) < 1e-9


def _param(name, *kinds, optional=False):
    return (name, frozenset(kinds), optional)


A = Side("INSTANCE_METHOD", "my_func", "my_class", "my_module", (_param("p1", "STRING"), _param("p2", "NUMBER", optional=True)), frozenset({"STRING"}), True)


def test_feature_scores():
    assert feature_score(A, A) == pytest.approx(1.0)
    far = Side("INSTANCE_METHOD", "completely_different_function", "another_world", "a_galaxy_far_away")
    assert feature_score(A, far) == pytest.approx(0.3056120857)
    near = Side("INSTANCE_METHOD", "my_func", "my_class", "a_different_module", (_param("p1", "STRING"),), frozenset({"NUMBER"}))
    assert feature_score(A, near) == pytest.approx(0.775)
    assert feature_score(A, Side("INSTANCE_METHOD", "my_func", "my_class", "my_module")) == pytest.approx(0.75)
    assert feature_score(A, Side("CONSTRUCTOR", "my_func", "my_class", "my_module")) == 0.0
    assert feature_score(Side("FUNCTION", "f", "", "n"), Side("FUNCTION", "f", "", "n")) == pytest.approx(0.6)
    assert feature_score(Side("CONSTRUCTOR", "a", "my_class", "m"), Side("CONSTRUCTOR", "b", "my_class", "m")) == pytest.approx(1.0)


def test_weights_must_be_complete():
    with pytest.raises(ValueError):
        Weights.of({"name": 1.0})


def test_csv_cells(spark):
    df = spark.createDataFrame([("a",), ("a,b",), ('q"q',), ("x\ny",), (None,)], "s string").select(names.csv_cell(F.col("s")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["a", '"a,b"', '"q""q"', '"x\ny"', ""]


def test_equal_features_are_scored_once(spark, monkeypatch):
    """Pairs are sums over distinct features; the matrices that are held don't grow with the rows."""
    from conformix.plans import queries

    sf = "/root/testdata/sf0.001"
    part = queries.table(spark, sf, "part")
    many = part.crossJoin(spark.range(5).select((1000 * F.col("id")).alias("more"))).withColumn("p_partkey", F.col("p_partkey") + F.col("more")).drop("more")
    once = {n: queries.QUERIES[n](spark, sf).collect() for n in ("pair_score_prelim", "pair_score_full")}
    seen, real = spark.sparkContext.accumulator(0), queries.name_scores

    def watched(base, target, *rest):
        seen.add(len(base) * len(target))
        return real(base, target, *rest)

    monkeypatch.setattr(queries, "table", lambda *_: many)
    monkeypatch.setattr(queries, "name_scores", watched)
    key = lambda r: (r["ns"], r["cls"])
    got = sorted(queries.pair_score_prelim(spark, sf).collect(), key=key)
    want = sorted(once["pair_score_prelim"], key=key)
    assert [(r["pairs"], r["early"], r["mean"], r["best"]) for r in got] == [(25 * r["pairs"], 25 * r["early"], r["mean"], r["best"]) for r in want]
    assert sorted(queries.pair_score_full(spark, sf).collect()) == sorted(once["pair_score_full"])
    assert seen.value <= sum(r["pairs"] for r in want)


def test_flow_is_the_best_assignment_of_equal_rows():
    rng = np.random.default_rng(3)
    for t in range(60):
        n, m = rng.integers(1, 8, 2)
        score = rng.choice([0, 0.1, 0.3, 0.75, 1], (n, m)) if t % 2 else rng.random((n, m))
        a, b = rng.integers(1, 6, n), rng.integers(1, 6, m)
        whole = np.repeat(np.repeat(score, a, 0), b, 1)
        flow = best_flow(score, a, b)
        rows, cols = (np.bincount([f[i] for f in flow], [f[2] for f in flow], len(x)) for i, x in ((0, a), (1, b)))
        assert sum(score[i, j] * k for i, j, k in flow) == pytest.approx(whole[best_assignment(whole)].sum(), abs=1e-9)
        assert (rows <= a).all() and (cols <= b).all() and rows.sum() == min(a.sum(), b.sum())


def test_modules_of_equal_features_have_no_limit(monkeypatch):
    """More pairs than a matrix may have, of a few different features: solved, with the totals of the whole matrix."""
    rng = random.Random(5)
    words = ["alpha", "alpine", "beta", "betas", "gamma", "gama", "delta"]
    side = lambda n: [Side("FUNCTION", rng.choice(words), rng.choice(["", "box"]), "ns") for _ in range(n)]
    base, target = side(40), side(35)
    whole = matching.match_lists(base, target, "F", 0.8)
    monkeypatch.setattr(matching, "MATRIX_CELLS", 14 * 14)
    got = matching.match_lists(base, target, "F", 0.8)
    total = lambda found: sum(p[2] for p in found[0])
    assert total(got) == pytest.approx(total(whole), abs=1e-9) and [len(x) for x in got] == [len(x) for x in whole]
    for i, n in ((0, 40), (1, 35)):
        assert sorted([p[i] for pairs in got[:2] for p in pairs] + got[2 + i]) == list(range(n))
    assert all(s == feature_score(base[i], target[j]) for pairs in got[:2] for i, j, s in pairs)
