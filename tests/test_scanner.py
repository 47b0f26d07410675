"""The source scanner on nested, commented and broken texts."""

import pytest
from pyspark.sql import functions as F

from callscope.plans.text_queries import source_files
from callscope.sources import scanner

TEXT = '''
package a.b;
import x.Y;
// class Dead { void dead() { gone(); } }
@Service("name(1)")
public class Outer<T extends Map<String, List<T>>> extends Base implements I, J {
    private final Repo repo = new Repo(make());
    static { init(); }
    /* void no() { never(); } */
    public Outer(int a) { super(a); }
    @Override
    public <R> R work(Map<String, List<R>> m, final int... n) throws IOException, x.Bad {
        String s = "call(1); } if (x) {" + '{' + '\\'';
        if (m.isEmpty()) { repo.save(new Item<Map<A, B>>(s, 2)); } else if (s == null) return null;
        for (R r : m.get(s)) {
            items.stream().map(Item::name).filter(i -> i.ok() && check(i)).forEach((a, b) -> {
                Runnable q = () -> log.info("x -> y()");
                q.run();
            });
        }
        do { step(); } while (more());
        while (less()) step();
        switch (n.length) { case 1: one(); break; case 2: case 3: default: other(); }
        try { risky(); } catch (E1 | E2 e) { log.warn(e); } catch (E3 e) { } finally { close(); }
        new Thread(new Runnable() { public void run() { deep.call(); } }).start();
        return this.<R>pick(Outer::new, int[]::new);

    }
    abstract void none(int a);
    class Inner { int f() { return g(1); } int g(int x) { return """
        text { block( """.length(); } }
    enum Kind { A(1), B(2) { int v() { return w(); } }; Kind(int k) { set(k); } }
}
interface Face { default int d() { return switch (z) { case 1 -> one(); default -> two(x -> x.y()); }; } void e(); }
'''


@pytest.fixture(scope="module")
def found():
    return {(m["type"], m["method"]): m for m in scanner.methods_in(TEXT)}


def calls(m):
    return [(k, r, n, d) for k, r, n, _, d, _ in m["sites"]]


def test_methods_and_types(found):
    assert {("Outer", "Outer"), ("Outer", "work"), ("Inner", "f"), ("Inner", "g"), ("Kind", "Kind"), ("Face", "d")} <= found.keys()
    assert ("Outer", "dead") not in found and ("Outer", "no") not in found and ("Outer", "run") not in found
    assert found["Outer", "work"]["n_params"] == 2 and found["Inner", "f"]["n_params"] == 0
    assert found["Outer", "work"]["is_public"] and not found["Inner", "f"]["is_public"]


def test_sites_of_four_kinds(found):
    got = calls(found["Outer", "work"])
    want = [
        ("CALL", "m", "isEmpty", 0), ("CALL", "repo", "save", 0), ("NEW", None, "Item", 0), ("CALL", "m", "get", 0),
        ("CALL", "items", "stream", 0), ("CALL", None, "map", 0), ("METHOD_REF", "Item", "name", 0), ("CALL", None, "filter", 0),
        ("LAMBDA", None, None, 0), ("CALL", "i", "ok", 1), ("CALL", None, "check", 1), ("CALL", None, "forEach", 0), ("LAMBDA", None, None, 0),
        ("LAMBDA", None, None, 1), ("CALL", "log", "info", 2), ("CALL", "q", "run", 1),
        ("CALL", None, "step", 0), ("CALL", None, "more", 0), ("CALL", None, "less", 0), ("CALL", None, "step", 0),
        ("CALL", None, "one", 0), ("CALL", None, "other", 0), ("CALL", None, "risky", 0), ("CALL", "log", "warn", 0), ("CALL", None, "close", 0),
        ("NEW", None, "Thread", 0), ("NEW", None, "Runnable", 0), ("CALL", "deep", "call", 0), ("CALL", None, "start", 0),
        ("CALL", None, "pick", 0), ("METHOD_REF", "Outer", "new", 0), ("METHOD_REF", None, "new", 0),
    ]
    assert got == want
    assert calls(found["Outer", "Outer"]) == [("CALL", None, "super", 0)]
    assert calls(found["Inner", "g"]) == [("CALL", None, "length", 0)]
    assert calls(found["Face", "d"]) == [("CALL", None, "one", 0), ("CALL", None, "two", 0), ("LAMBDA", None, None, 0), ("CALL", "x", "y", 1)]


def test_measures(found):
    # if, if, for, while (not that of do), four labels, two catches
    assert found["Outer", "work"]["complexity"] == 1 + 2 + 1 + 1 + 4 + 2
    assert found["Outer", "work"]["loc"] == TEXT[TEXT.index("x.Bad {") : TEXT.index("    abstract")].strip().count("\n") + 1 - 1
    assert found["Face", "d"]["complexity"] == 3 and found["Inner", "f"]["complexity"] == 1 and found["Inner", "g"]["loc"] == 2


SHADOWED = """
class A {
    void before() { repo.early(); }
    @Inject(name = "x") private final Map<String, OrderService> repo = load();
    void f(UserRepository repo, int... n) throws E {
        repo.param();
        if (n > 1) { Plain repo = other(); repo.local(); for (Item<A, B> repo : all) { repo.looped(); } repo.again(); }
        repo.param2();
        run((Cache repo) -> repo.lambda(), repo.argument());
        try { repo.tried(); } catch (Bad | Worse repo) { repo.caught(); }
        for (Job repo : jobs) repo.single();
        repo.last();
    }
    void g() { this.repo.field(); Other[] repo; repo.array(); unknown.call(); a = b == repo; }
    abstract void h(Gone repo);
    class In { Deep repo; void i() { repo.deep(); } }
    void j() { repo.outer(); }
}
"""


def test_receivers_in_nested_blocks(spark):
    got = scanner.resolved(spark.createDataFrame([("p", SHADOWED), ("q", "class B { void f() { repo.other(); } }")], "path string, text string")).where("kind = 'CALL'").collect()
    types = {r["name"]: r["receiver_type"] for r in got}
    want = {"early": "Map", "param": "UserRepository", "local": "Plain", "looped": "Item", "again": "Plain", "param2": "UserRepository", "lambda": "Cache", "argument": "UserRepository", "tried": "UserRepository", "caught": "Worse", "single": "Job", "last": "UserRepository", "field": "Map", "array": "Other", "call": None, "deep": "Deep", "outer": "Map", "other": None}
    assert types == want
    assert next(r["annotations"] for r in got if r["name"] == "outer") == ["Inject"]


def test_receivers_are_resolved_by_one_scan(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    many = "class M { " + "".join(f"void m{i}(A{i} repo) {{ repo.x{i}(); }} " for i in range(300)) + "}"
    files = spark.createDataFrame([("p", SHADOWED), ("q", many), ("r", None), ("s", "class N { A a; }")], "path string, text string").mapInArrow(counted, "path string, text string")
    got = scanner.resolved(files).collect()
    assert read.value == 4
    assert {r["name"]: r["receiver_type"] for r in got if r["path"] == "q"} == {f"x{i}": f"A{i}" for i in range(300)}
    assert {r["path"] for r in got} == {"p", "q"}


@pytest.mark.parametrize("text", ["", None, "class A {", "} ) ]", "class A { void f() { g(", 'class A { void f() { "open', "/* open", "x -> { y(", "class A { void f() { if (a { b(); } } }"])
def test_broken_texts(text):
    scanner.methods_in(text)


def test_long_text():
    body = "if (a) { b(x -> c(d)); }\n" * 20_000
    m = scanner.methods_in("class A { void f() {\n" + body + "} }")[0]
    assert m["complexity"] == 20_001 and m["loc"] == 20_002 and len(m["sites"]) == 60_000


def test_files(spark):
    files = spark.createDataFrame([("a", "class A { void f() { g(); } }"), ("b", None), ("c", TEXT)], "path string, text string")
    got = scanner.scanned(files.repartition(3))
    assert got.where("path = 'a'").count() == 1 and got.where("path = 'b'").isEmpty()
    assert scanner.sites(got).where("path = 'c' AND method = 'work'").count() == 32
    assert scanner.scanned(files.limit(0)).isEmpty()


def test_made_files_are_dealt_over_all_cores(spark, sf_dir):
    files = source_files(spark, sf_dir).select(F.spark_partition_id().alias("task"))
    assert files.distinct().count() >= spark.sparkContext.defaultParallelism
