import pytest

from conformix.cli import parser, report_name
from conformix.operators.extraction import docstring_params, extract
from conformix.sources import scan
from conformix.sources.parsers import go, java, python, typescript
from conformix.sources.parsers.text import Source
from conformix.sources.scan import Project

PY = '''
class Agent:
    """An agent.

    Args:
      name: ignored here
    """
    name: str
    tools: list[str] = []
    _hidden: int = 0

class Runner:
    def __init__(self, agent: Agent, *, limit: int = 3, **kw): pass
    @classmethod
    def make(cls, p: Optional[str] = None) -> "Runner": pass
    async def run_async(self, q: str | None, *args: int) -> list[str]:
        """Runs.

        Args:
          q (str): The query
            goes on.
        Returns:
          things
        """
    def _private(self): pass
    @deprecated
    def old(self): pass

def free(a, b=1) -> int: pass
'''
TS = """
export interface MyOpts { field1: string; field2?: number }
/**
 * Runs the thing.
 * @param {string} name The name
 * @param {string} [p1=default] Desc
 */
export async function runThing(name: string, p1?: number, { a, b: c, d = 1 }: { a: string, b?: number, d: boolean } = {}): Promise<string> { return ""; }
function hidden(a: string) { return 1; }
export class Foo<T> extends Bar {
  constructor(private readonly opts: MyOpts, req?: string) { super(); }
  /** Does it. */
  @deprecated()
  static async doIt(...rest: string[]): Promise<void> { if (x) { y(); } }
  get val(): string { return ""; }
  private no() { }
  handle({ u, v }: MyRequest): Map<string, number> { return m; }
}
"""
JAVA = """
package com.acme.core;
public class A {
  private int f = g(3);
  /** Makes it. */
  public A(String x, List<String> ys) { this.x = x; }
  @Beta
  public static CompletableFuture<Integer> runAsync(Map<String, Object> m, final int n) throws E { return null; }
  public String getName() { return ""; }
  public int hashCode() { return 1; }
  void testFoo() {}
  private <T extends B> T normalMethod(T t, String... more) { return "} (" + '{'; }
  interface Inner { void act(byte[] b); }
  static class MyBuilder { MyBuilder set(int a) { return this; } }
}
"""
GO = """package agent

// Validate checks.
func (r *saveRequest) Validate(ctx context.Context, a int, opts ...Opt) (*Event, error) {
	x := 1
	y := "}"
	return x, nil
}

func NewConfig(name string, m map[string]interface{}) *Config {
	c := &Config{
		A: 1,
	}
	return c
}

func Tiny() int { return 1 }
func lower() int {
	a()
	return 1
}
"""


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees")
    for path, text in {
        "py/src/pkg/a.py": PY, "py/src/pkg/__init__.py": "def no(): pass", "py/src/pkg/.venv/x.py": "def no(): pass", "py/src/skip/b.py": "def no(): pass", "py/src/pkg/version.py": '__version__ = "1.2"\n', "py/src/pkg/bad.py": "def (",
        "ts/src/lib/a.ts": TS, "ts/src/lib/a.d.ts": TS, "ts/src/node_modules/b.ts": TS, "ts/package.json": '{"version": "3.1.4"}',
        "java/src/main/java/com/acme/core/A.java": JAVA, "java/src/main/java/package-info.java": "", "java/pom.xml": "<project><version>7</version></project>",
        "go/agent/a.go": GO, "go/agent/a_test.go": GO, "go/go.mod": "module github.com/my/module\n",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def rows(spark, trees, language, folder, **config):
    r = extract(spark, trees / folder, language, config={language: config}, project=Project("acme", "pkg", "com.acme"))
    return r, {f"{x['member_of']}.{x['original_name']}": x for x in r.features.collect()}


def params(x):
    return [(p["original_name"], p["normalized_types"], p["is_optional"]) for p in x["parameters"]]


def test_python(spark, trees):
    r, got = rows(spark, trees, "python", "py", source_root="src", exclude=["skip"])
    assert r.version == "1.2" and r.language == "PYTHON"
    assert set(got) == {"Agent.Agent", "Runner.__init__", "Runner.make", "Runner.run_async", "Runner.old", "null.free"}
    assert params(got["Agent.Agent"]) == [("name", ["STRING"], False), ("tools", ["LIST"], True)] and got["Agent.Agent"]["type"] == "CONSTRUCTOR"
    run = got["Runner.run_async"]
    assert run["async"] and run["description"] == "Runs." and run["normalized_namespace"] == "acme_pkg" and run["namespace"] == "a"
    assert params(run) == [("q", ["NULL", "STRING"], False), ("args", ["NUMBER"], False)] and run["parameters"][0]["description"] == "The query goes on."
    assert got["Runner.make"]["type"] == "CLASS_METHOD" and got["Runner.old"]["maturity"] == "DEPRECATED" and got["null.free"]["normalized_member_of"] == ""


def test_typescript(spark, trees):
    r, got = rows(spark, trees, "typescript", "ts")
    assert r.version == "3.1.4" and set(got) == {"null.runThing", "Foo.constructor", "Foo.doIt", "Foo.handle"}
    run = got["null.runThing"]
    assert params(run) == [("name", ["STRING"], False), ("p1", ["NUMBER"], True), ("a", ["STRING"], False), ("c", ["NUMBER"], True), ("d", ["BOOLEAN"], True)]
    assert run["async"] and run["description"] == "Runs the thing." and run["parameters"][1]["description"] == "Desc" and run["namespace"] == "lib"
    assert params(got["Foo.constructor"]) == [("field1", ["STRING"], False), ("field2", ["NUMBER"], True), ("req", ["STRING"], True)]
    assert params(got["Foo.handle"]) == [("request", ["OBJECT"], False)] and got["Foo.doIt"]["maturity"] == "DEPRECATED" and got["Foo.doIt"]["type"] == "CLASS_METHOD"


def test_java(spark, trees):
    r, got = rows(spark, trees, "java", "java")
    assert r.version == "7" and set(got) == {"A.A", "A.runAsync", "A.normalMethod", "Inner.act"}
    run = got["A.runAsync"]
    assert (run["type"], run["maturity"], run["async"], run["normalized_return_types"], run["namespace"]) == ("CLASS_METHOD", "EXPERIMENTAL", True, ["NUMBER"], "core")
    assert params(run) == [("m", ["MAP"], False), ("n", ["NUMBER"], False)] and got["A.A"]["description"] == "Makes it."
    assert params(got["A.normalMethod"]) == [("t", ["OBJECT"], False)] and got["Inner.act"]["normalized_return_types"] == ["NULL"]


def test_go(spark, trees):
    r, got = rows(spark, trees, "go", "go")
    assert r.version == "github.com/my/module" and set(got) == {"SaveRequest.Validate", ".NewConfig"}
    v = got["SaveRequest.Validate"]
    assert (v["type"], v["original_return_types"], v["async"]) == ("INSTANCE_METHOD", ["*Event"], None) and params(v) == [("a", ["NUMBER"], False)]
    assert got[".NewConfig"]["type"] == "CONSTRUCTOR" and params(got[".NewConfig"]) == [("name", ["STRING"], False), ("m", ["MAP"], False)]


def test_modes(spark, trees, tmp_path):
    one = extract(spark, trees / "py/src/pkg/a.py", "py", "file", {})
    assert one.features.count() == 6 and one.files.count() == 1
    assert extract(spark, trees / "py/src/pkg", "python", "dir", {}).features.count() == 6
    (tmp_path / "empty").mkdir()
    assert extract(spark, tmp_path / "empty", "python", "dir", {}).features.count() == 0
    with pytest.raises(FileNotFoundError):
        extract(spark, tmp_path / "none", "python")
    with pytest.raises(ValueError):
        extract(spark, trees / "py", "python", "odd", {})


def test_parsers_survive_bad_text():
    for text in ("", "class {", "func (", "((((", "/* open", '"open', "export function f(", "{}}}", "func x() {"):
        assert isinstance(python.parse("p", text), list)
        assert isinstance(java.parse("p", text), list)
        assert isinstance(go.parse("p", text), list)
        assert isinstance(typescript.parse("p", text, {}), list)


def test_python_recovers_from_errors():
    """One error hides what it is in, not the other definitions of the file."""
    names = lambda text: sorted(r["name"] for r in python.parse("p", text) if r["node"] == "function")
    assert names("def a(): pass\ndef (\n    return 1\ndef b(): pass\n") == ["a", "b"]
    assert names("class A:\n    def x(self):\n        return 1 +\n    def y(self): pass\nprint 'old'\ndef z(): pass") == ["x", "y", "z"]
    assert names("def a():\n    x = (1,\n\ndef b(): pass\n") in (["a", "b"], ["b"])
    assert names("\n".join(["?? ?? ??"] * 150 + ["def a(): pass"])) == ["a"] and names("?\n" * 500) == []


def test_go_files_with_errors_have_no_features():
    assert [r["name"] for r in go.parse("p", GO)] and go.parse("p", GO + "}\n") == [] and go.parse("p", GO.replace("package agent", "")) == []


def test_later_types_win():
    """Within a file aliases come after interfaces; then the later definition counts."""
    rows = typescript.type_map("type A = { x: string };\ninterface A { y: number }\ninterface B { a: string }\ninterface B { b: string }")
    last = {}
    for r in sorted(rows, key=lambda r: r[1:3]):
        last[r[0]] = r[3]
    assert last == {"A": "x", "B": "b"}


def test_roots(trees, tmp_path):
    assert scan.repo_root(trees / "go/agent/a.go", "go") == trees / "go"
    assert scan.search_dir(trees / "java", "java") == trees / "java/src/main/java"
    assert scan.search_dir(tmp_path, "go") == tmp_path
    assert scan.load_config(tmp_path) == {}
    (tmp_path / "config.yaml").write_text("python:\n  source_root: src\n")
    assert scan.load_config(tmp_path) == {"python": {"source_root": "src"}}


def test_docstrings():
    assert docstring_params("T.\nArgs:\n  p1 (int): Desc 1.\n  p2: Desc 2\n    continued.\n  p3: Desc 3.\nYields:\n  p4: no") == {"p1": "Desc 1.", "p2": "Desc 2 continued.", "p3": "Desc 3."}


def test_command_line():
    p = parser()
    assert p.parse_args(["extract", "--language", "ts", "--input-dir", "x", "out"]).language == "ts"
    with pytest.raises(SystemExit):
        p.parse_args(["extract", "--language", "ts", "out"])
    with pytest.raises(SystemExit):
        p.parse_args(["extract", "--language", "ts", "--input-dir", "x", "--input-file", "y", "out"])
    assert report_name("PYTHON", "TYPESCRIPT", "raw") == "py_ts_raw.csv" and report_name("X", "GO", "symmetric") == "_go_symmetric.md"


def test_stream(spark, trees, tmp_path):
    from conformix.streaming import arriving_features

    q = arriving_features(spark, str(trees / "go"), "go").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["name"] for r in spark.table("arrived").collect()} == {"Validate", "NewConfig"}


def test_files_of_one_row_group_are_spread(spark):
    """A table that is one row group would otherwise be parsed by one task."""
    from conformix.plans.queries import _files, table

    sf = "/root/testdata/sf0.001"
    assert table(spark, sf, "part").rdd.getNumPartitions() == 1
    sizes = _files(spark, sf).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) * 4 < sum(sizes) == table(spark, sf, "part").count()


def test_masks_keep_places():
    src = Source('a("x//y", 1) // "c\n/* d\n" */ b', '"')
    assert src.mask == 'a("    ", 1)      \n    \n     b' and src.comments == [(19, 28)]
