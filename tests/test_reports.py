import datetime
import random

import pytest

from conformix.functions.similarity import Names, jaro_winkler
from conformix.operators import matching, metrics
from conformix.operators.ordering import boundaries, ordered
from conformix.operators.reports import match_registries, write_report
from conformix.schema import with_defaults
from conformix.sources import textproto


def feature(name, normalized, member, normalized_member, module):
    fields = zip(("original_name", "normalized_name", "member_of", "normalized_member_of", "normalized_namespace"), (name, normalized, member, normalized_member, module))
    return "features {" + " ".join(f'{k}: "{v}"' for k, v in fields) + " type: INSTANCE_METHOD}\n"


BASE = 'language: "PYTHON" version: "1.0.0"\n' + feature("fSameBase", "f_same", "BaseClass", "c_same", "n_same") + feature("base_name", "base_name", "base_member", "base_member", "n_same") + feature("totally_diff", "totally", "null", "different", "stuff")
TARGET = "language: 'TYPESCRIPT'\nversion: \"2.0\"  # comment\n" + feature("fSameTarget", "f_same", "TargetClass", "c_same", "n_same") + feature("target_name", "targ_name", "target_member", "target_member", "n_same")


@pytest.fixture(scope="module")
def registries(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("reg")
    (d / "b.txtpb").write_text(BASE)
    (d / "t.txtpb").write_text(TARGET)
    return textproto.read_registry(spark, str(d / "b.txtpb")), textproto.read_registry(spark, str(d / "t.txtpb"))


def row(*cells):
    return "| " + " | ".join(cells) + " |"


def test_symmetric(registries, tmp_path):
    got = match_registries(*registries, 0.9, "symmetric", "acme", datetime.datetime(2024, 1, 2))
    text = got.master_content
    assert "**Jaccard Index:** 25.00%" in text and "Date: 2024-01-02 00:00:00" in text
    assert "| python, ts | `n_same` | 2 | 33.33% | ❌ | [View Details]({modules_dir}/n_same.md) |" in text
    assert "| ACME | Module |" in text
    module = got.module_files["n_same.md"]
    assert row("method", "`BaseClass.fSameBase`", "`TargetClass.fSameTarget`", "1.00") in module
    assert "`base_member.base_name` | `target_member.target_name` | 0.88 |" in module and "**Features:** 3" in module
    assert "| `totally_diff` | Target |" in got.module_files["stuff.md"]
    write_report(got, tmp_path / "out.md")
    assert "(out_modules/n_same.md)" in (tmp_path / "out.md").read_text()
    assert "(../out.md)" in (tmp_path / "out_modules" / "n_same.md").read_text()


def test_directional(registries):
    text = match_registries(*registries, 0.9, "directional").master_content
    for line in (row("**Precision**", "50.00%"), row("**Recall**", "33.33%"), row("**F1 Score**", "40.00%"), row("`n_same`", "2", "50.00%", "❌"), "**Base:** PYTHON (1.0.0)"):
        assert line in text


def test_raw(registries):
    lines = match_registries(*registries, 0.9, "raw").master_content.split("\n")
    assert lines[0].split(",") == [f"{c}_{x}" for c in ("python", "ts") for x in ("namespace", "member_of", "name")] + ["type", "score"]
    assert lines[1:] == ["n_same,BaseClass,fSameBase,n_same,TargetClass,fSameTarget,method,1.0000", "n_same,base_member,base_name,n_same,target_member,target_name,method,0.8844", "stuff,different,totally_diff,,,,method,0.0000"] or lines[3].startswith("stuff,")


def test_unknown_report(registries):
    with pytest.raises(ValueError):
        match_registries(*registries, 0.8, "other")


def test_itself_is_complete(registries):
    base, _ = registries
    rows = matching.with_module(base.features)
    summary = metrics.module_summary(matching.match_features(rows, matching.remap_target(rows, rows)))
    assert summary.where("jaccard != 1").count() == 0


def test_registry_round_trip(spark, registries, tmp_path):
    base, _ = registries
    textproto.write_textproto(base, tmp_path / "o.txtpb")
    assert textproto.parse_registry((tmp_path / "o.txtpb").read_text()) == textproto.parse_registry(BASE)
    textproto.write_json(base, tmp_path / "o.json")
    textproto.write_yaml(base, tmp_path / "o.yaml")
    textproto.write_parquet(base, str(tmp_path / "o.parquet"))
    again = textproto.read_registry(spark, str(tmp_path / "o.parquet"))
    assert again.language == "PYTHON" and again.features.exceptAll(base.features).count() == 0
    odd = textproto.parse_registry('features { description: "a\\n\\"\\303\\244" normalized_return_types: ["A", "B"] async: true type: 3 }')
    f = odd["features"][0]
    assert (f["description"], f["normalized_return_types"], f["async"], f["type"]) == ('a\n"ä', ["A", "B"], True, "CONSTRUCTOR")


def test_remap(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "module string")
    got = {r["module"]: r["base_module"] for r in matching.remap_namespaces(keys("module.one", "module.two"), keys("module.one", "module.ones", "module.three", "zzz")).collect()}
    assert got == {"module.one": "module.one", "module.ones": "module.one", "module.three": "module.one"}
    assert [tuple(r) for r in matching.remap_namespaces(keys(), keys("module.one")).collect()] == [("module.one", "module.one")]


def test_metrics(spark):
    rows = [(20, 10, 10), (10, 20, 0), (0, 0, 0), (10, 0, 0)]
    got = metrics.with_metrics(spark.createDataFrame(rows, "base long, target long, solid long")).select("precision", "recall", "f1", "jaccard").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5, pytest.approx(2 / 3), 0.5), (0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0), (1.0, 0.0, 0.0, 0.0)]


def test_most_similar_is_the_maximum():
    """With the bound, the same as comparing all; ties go to the first by name."""
    rng = random.Random(4)
    word = lambda: "lib_" * rng.randint(0, 1) + "".join(rng.choice("abc_é") for _ in range(rng.randint(0, 8)))
    names, others = sorted({word() for _ in range(120)}), sorted({word() for _ in range(150)})
    want = []
    for n in names:
        best = max(jaro_winkler(n, o) for o in others)
        if best > 0.8:
            want.append((n, next(o for o in others if jaro_winkler(n, o) == best), best))
    assert matching.most_similar(names, others, 0.8) == want and len(want) > 20


def test_remap_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "_BLOCK", 3)
    keys = lambda names: spark.createDataFrame([(x,) for x in names], "module string")
    base, target = [f"alpha.beta{i}" for i in range(0, 20, 2)], [f"alpha.beta{i}" for i in range(20)] + ["qqq"]
    got = {r["module"]: r["base_module"] for r in matching.remap_namespaces(keys(base), keys(target)).collect()}
    best = lambda t: min(base, key=lambda b: (-jaro_winkler(t, b), b))
    assert got == {t: t if t in base else best(t) for t in target if t != "qqq"}


def test_order_of_rows(spark):
    """Numbers follow (key, rest), over ranges of keys, with NULL keys first."""
    rows = [(f"p{i % 37:02d}" if i % 11 else None, i * 7919 % 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "file string, at int")
    edges = boundaries(df.select("file"), 8)
    assert 3 < len(edges) < 8
    got = [(r["file"], r["at"]) for r in ordered(df, "file", ["at"], edges).orderBy("ord").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] or "", r[1]))
    assert boundaries(df.limit(0).select("file")) == []
    free = with_defaults(spark.createDataFrame([("b",), ("a",)], "normalized_name string"))
    assert [r["normalized_name"] for r in free.orderBy("ord").collect()] == ["a", "b"]


def test_similarity_of_many_names_at_once():
    """The same numbers as one pair at a time, for names of up to 64 characters; longer ones are compared singly."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc_é") for _ in range(n))
    others = [word(rng.randint(0, 64)) for _ in range(200)] + ["a" * 64]
    table = Names(others)
    for above in (0.0, 0.75):
        for name in [word(rng.randint(1, 64)) for _ in range(40)]:
            want = [jaro_winkler(name, x) for x in others]
            assert table.scores(name, above).tolist() == [x if x > above else 0.0 for x in want]
    long = ["b" * 70, "b" * 69 + "c"]
    assert matching.most_similar(["b" * 71], long, 0.8) == [("b" * 71, "b" * 70, jaro_winkler("b" * 71, "b" * 70))]


def test_modules_go_on_over_batches(spark):
    """A task reads its modules one after the other; where a batch ends doesn't matter."""
    row = lambda ord, module, name: (ord, module, module, name, "FUNCTION")
    df = lambda rows: matching.with_module(with_defaults(spark.createDataFrame(rows, "ord long, namespace string, normalized_namespace string, normalized_name string, type string")))
    rows = [row(i, f"m{i % 5}", f"name_{i * 37 % 101}") for i in range(50)]
    base, target = df(rows), df([row(100 + o, m, name) for o, m, _, name, _ in rows if o % 7])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    found = []
    before = spark.conf.get(key)
    try:
        for size in ("3", "10000"):
            spark.conf.set(key, size)
            found.append(sorted(map(tuple, matching.match_features(base, target, 0.5).select("module", "kind", "base_ord", "place").collect()), key=str))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] and len(found[0]) == 50
    assert len({r[:3] for r in found[0] if r[1] == "solid"}) == sum(1 for i in range(50) if i % 7)


def test_caches_are_small():
    """Four workers' caches of scores must leave an executor's memory alone."""
    from conformix.functions import similarity

    assert all(f.cache_info().maxsize <= 1 << 16 for f in (similarity.jaro_winkler, similarity.param_score, similarity.params_score, similarity.return_score))


def test_written_registries_are_read_by_tasks(spark, registries, tmp_path):
    """Files are those of the whole document at once, and ranges of bytes give its features in order, however they are cut."""
    import json

    import yaml

    base, _ = registries
    rows = [x.asDict(True) for x in base.features.orderBy("ord").collect()]
    many = with_defaults(spark.createDataFrame([{**rows[i % len(rows)], "ord": i, "description": f"é \"{i}\"\n- original_name: x\nfeatures {{\n" + "long " * 30} for i in range(200)], base.features.schema))
    for features in (many, many.limit(0)):
        registry = type(base)("PYTHON", "1.0", features)
        want = [x.asDict(True) for x in features.orderBy("ord").collect()]
        document = {"language": "PYTHON", "version": "1.0", "features": [textproto._plain(x) for x in want]}
        textproto.write_json(registry, tmp_path / "o.json")
        textproto.write_yaml(registry, tmp_path / "o.yaml")
        textproto.write_textproto(registry, tmp_path / "o.txtpb")
        assert (tmp_path / "o.json").read_text() == json.dumps(document, indent=2)
        assert (tmp_path / "o.yaml").read_text() == yaml.dump(document, sort_keys=False)
        assert textproto.parse_registry((tmp_path / "o.txtpb").read_text())["features"] == want
        key = "spark.sql.files.maxPartitionBytes"
        before = spark.conf.get(key)
        try:
            spark.conf.set(key, "10000")
            for form in ("json", "yaml", "txtpb"):
                read = textproto.read_written(spark, f"file://{tmp_path}/o.{form}", form)
                assert [x.asDict(True) for x in read.orderBy("ord").collect()] == want
        finally:
            spark.conf.set(key, before)
