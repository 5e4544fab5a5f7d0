"""The scanner of languages with braces."""

import pytest

from loomgraph.operators import resolve
from loomgraph.sources import brace_code as b

SOURCES = {
"A.java":'''package a.b;
import java.util.List;
import static x.Y.z;
/** doc { } */
@Service("x")
public abstract class Shop<T> extends Base<T> implements Api, Other<String> {
  private final Map<String, Integer> counts = new HashMap<>();
  static int[] n = {1, 2};
  @Autowired private Repo repo;
  public Shop(Repo repo) { this.repo = repo; }
  @GetMapping("/x")
  public List<String> find(int id, Map<String, Integer> by) throws E {
    String s = "a(b)"; // no(call)
    repo.load(id, by.get("x")).stream().map(x -> x.name());
    if (id > 0) { return helper(1, f(2, 3)); }
    return new Thing(id).go();
  }
  abstract void later(String a);
  enum Kind { A, B; int w() { return 1; } }
  interface In extends X, Y { void m(); default int d() { return m2(); } }
}
record P(int a, String b) { }
''',
"B.cs":'''using System.Text;
namespace Acme.Shop
{
  [Serializable]
  public class Store : Base, IThing<int>
  {
    private readonly ILog _log;
    public int Count { get; set; }
    public Store(ILog log) { _log = log; }
    [HttpGet("x")]
    public async Task<int> LoadAsync(int id, string name = "a")
    {
      var s = @"}"; await _repo.FindAsync(id);
      return Sum(1, 2);
    }
    public int Twice(int x) => Sum(x, x);
  }
  interface IThing<T> { T Get(); }
}
''',
"c.ts":'''import { A, B } from './ab';
import x from "y";
export interface Shape extends Base { area(): number; name: string }
@Component({selector: 'a'})
export class Circle extends Shape2<T> implements Shape, Other {
  private r: number = 1;
  constructor(private svc: Service) { super(); }
  async area(scale?: number): Promise<number> { return this.svc.load(scale, `}${x}`); }
  handler = (e: Event) => { this.go(e); }
}
export function useThing(a: string, b = 2): void { helper(a); }
const arrow = async (q: number): Promise<void> => { fetch(q); };
''',
"d.go":'''package store
import (
  "fmt"
  "a/b/c"
)
type Store struct {
  Base
  *Other
  name string
}
type Getter interface { Get(k string) error }
func (s *Store) Put(k string, v, w int) (int, error) {
  s.log.Debug("x", k)
  return helper(k), nil
}
func New() *Store { return &Store{} }
''',
"e.scala":'''package a.b
import c.d.{E, F => G}
import h._
trait Api { def get(k: String): Option[Int] }
class Shop(repo: Repo, n: Int) extends Base(n) with Api with Other {
  val x: Int = 1
  def get(k: String): Option[Int] = repo.find(k)
  def twice(a: Int)(b: Int): Int = {
    val y = sum(a, b)
    y
  }
  private def last: Int = compute(1)
}
object Shop { def apply() = new Shop(null, 1) }
'''}


def rows(name, kind):
    return [(r[2], r[3], r[4]) for r in b.rows_of(name, SOURCES[name]) if r[1] == kind]


@pytest.mark.parametrize(
    ("name", "classes", "functions", "fields", "calls"),
    [
        (
            "A.java",
            {("a.b", "Shop", 5), ("a.b", "Kind", 19), ("a.b", "In", 20), ("a.b", "P", 22)},
            {("a.b.Shop", "Shop", 10), ("a.b.Shop", "find", 11), ("a.b.Shop", "later", 18), ("a.b.Shop.Kind", "w", 19), ("a.b.Shop.In", "m", 20), ("a.b.Shop.In", "d", 20)},
            {"counts", "n", "repo", "a", "b"},
            {"load", "get", "stream", "map", "name", "helper", "f", "Thing", "go", "m2"},
        ),
        ("B.cs", {("Acme.Shop", "Store", 4), ("Acme.Shop", "IThing", 18)}, {("Acme.Shop.Store", "Store", 9), ("Acme.Shop.Store", "LoadAsync", 10), ("Acme.Shop.Store", "Twice", 16), ("Acme.Shop.IThing", "Get", 18)}, {"_log", "Count"}, {"FindAsync", "Sum"}),
        ("c.ts", {(None, "Shape", 3), (None, "Circle", 4)}, {("<module>", "useThing", 11), ("<module>", "arrow", 12), ("Circle", "constructor", 7), ("Circle", "area", 8), ("Circle", "handler", 9), ("Shape", "area", 3)}, {"r", "name"}, {"helper", "fetch", "load", "go"}),
        ("d.go", {("store", "Store", 6), ("store", "Getter", 11)}, {("store.Store", "Put", 12), ("store._functions", "New", 16)}, {"name"}, {"Debug", "helper"}),
        ("e.scala", {("a.b", "Api", 4), ("a.b", "Shop", 5), ("a.b", "Shop", 14)}, {("a.b.Api", "get", 4), ("a.b.Shop", "get", 7), ("a.b.Shop", "twice", 8), ("a.b.Shop", "last", 12), ("a.b.Shop", "apply", 14)}, {"repo", "n"}, {"find", "sum", "compute", "Shop"}),
    ],
)
def test_declarations(name, classes, functions, fields, calls):
    assert set(rows(name, "class")) == classes
    assert set(rows(name, "function")) == functions
    assert {r[1] for r in rows(name, "field")} == fields
    assert {r[1] for r in rows(name, "call")} == calls


def test_tables(spark):
    files = spark.createDataFrame([*SOURCES.items(), ("x.java", None), ("y.java", ""), ("z.md", "class A { }"), ("w.java", "class W { void a( { ")], "path string, text string")
    g = b.tables(b.parse(files))
    c = {r["full_name"]: r for r in g["classes"].collect()}
    assert c["a.b.Shop.In"]["implements"] == ["X", "Y"] and c["a.b.Shop.Kind"]["stereotypes"] == ["enum"]
    assert c["Acme.Shop.Store"]["extends"] == "Base" and c["Acme.Shop.Store"]["annotations"] == ["[Serializable]"]
    assert c["Circle"]["extends"] == "Shape2<T>" and c["Circle"]["language"] == "typescript" and c["Circle"]["imports"] == ["./ab", "y"]
    assert {(r["source"], r["target"], r["relation"]) for r in g["inheritance"].collect()} >= {("store.Store", "Base", "embeds"), ("store.Store", "Other", "embeds"), ("a.b.Shop", "Api", "implements"), ("Circle", "Other", "implements")}
    m = {r["signature"]: r for r in g["methods"].collect()}
    assert m["a.b.Shop#find(int, Map<String, Integer>)"]["return_type"] == "List<String>" and m["store.Store#Put(string, int, int)"]["parameter_names"] == ["k", "v", "w"]
    k = {(r["callee_name"], r["receiver"]): r for r in g["callsites"].filter("file_path = 'A.java'").collect()}
    inner = k["load", "repo"]["text"]
    assert ("stream", inner) in k and k["helper", None]["argument_count"] == 2
    assert len({r["id"] for r in g["callsites"].collect()}) == g["callsites"].count()
    assert {r["name"] for r in g["fields"].filter("class_full_name = 'a.b.Shop' and file_path = 'A.java'").collect()} == {"counts", "n", "repo"}


def test_scanned_files_resolve(spark):
    files = spark.createDataFrame([("p/Repo.java", "package p;\npublic class Repo { public int find(int id) { return id; } }"), ("p/Main.java", "package p;\npublic class Main {\n  private Repo repo;\n  int run() { return repo.find(1); }\n  int twice() { return run(); }\n}")], "path string, text string")
    g = b.tables(b.parse(files))
    types = g["fields"].selectExpr("class_full_name", "name", "type_name")
    owner = g["methods"].selectExpr("id as caller_method_id", "class_full_name")
    calls = g["callsites"].withColumnRenamed("id", "callsite_id").join(owner, "caller_method_id").join(types.selectExpr("class_full_name", "name as receiver", "type_name as receiver_type"), ["class_full_name", "receiver"], "left").selectExpr("*", "cast(null as array<string>) as argument_types")
    out = resolve.resolve_all(calls, g["methods"], g["classes"], g["inheritance"], types)
    names = dict(g["methods"].select("id", "method_name").collect())
    assert {(r["status"], names[r["candidates"][0]]) for r in out.collect()} == {("resolved_same_package", "find"), ("resolved_same_class", "run")}
