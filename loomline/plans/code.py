"""Queries over source code: the sample projects through the whole engine, each with its expected rows.

DuckDB can't parse Python, so the SQL of these queries is the table of rows that the semantics give,
worked out by hand from the sources in :mod:`loomline.plans.samples`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.frontend import facts
from loomline.operators import callgraph, cfg, graph, taint
from loomline.plans import samples
from loomline.sources.scratch import kept


class Project:
    """The relations of some sample files, lowered once and resolved."""

    def __init__(self, spark: SparkSession, *projects: dict[str, str]) -> None:
        self.files = samples.files(spark, *projects)
        self.facts = kept(facts.facts(self.files))
        self.functions = kept(facts.relation(self.facts, "function"))

    def relation(self, kind: str) -> DataFrame:
        return facts.relation(self.facts, kind)

    def resolve(self) -> Project:
        imports = self.relation("import")
        keys = ["fn_id", "path", "callee", "line", "col"]
        self.imported = kept(callgraph.imported_files(imports, self.files))
        self.sites = kept(callgraph.expanded(facts.calls(self.functions).select(*keys), imports).select(*keys))
        found = kept(callgraph.resolved(self.sites, self.functions, callgraph.visible_files(self.imported)))
        decls = self.relation("decl")
        bases = graph.closure(decls.where("kind = 'base'").select(F.col("name").alias("src"), callgraph.last_segment(F.col("member")).alias("dst")))
        receivers = callgraph.receiver_classes(self.functions, found, decls.where("kind = 'class'"))
        written = facts.calls(self.functions).select(*keys)
        self.found = kept(callgraph.methods_of_classes(written, found, receivers, callgraph.overrides(bases, self.functions)))
        return self


def _name(fn_id: str) -> F.Column:
    return F.element_at(F.split(fn_id, ":"), -1)


def taint_interproc(spark: SparkSession, _: str) -> DataFrame:
    """Findings of the flows project, through calls, returns, recursion and fields."""
    p = Project(spark, samples.FLOWS).resolve()
    found, _summaries = taint.analyse(p.functions, p.found, taint.Rules.python())
    return found.select("rule", "severity", "file", "function", "line", "origin")


def call_graph(spark: SparkSession, _: str) -> DataFrame:
    """Call edges of the calls project."""
    p = Project(spark, samples.CALLS).resolve()
    e = callgraph.edges(p.found)
    return e.select(_name("fn_id").alias("caller"), _name("target").alias("callee"), "sites", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def call_externals(spark: SparkSession, _: str) -> DataFrame:
    """The most frequent callees that no file declares."""
    p = Project(spark, samples.CALLS).resolve()
    return callgraph.external_calls(p.sites, p.found, 30)


def call_recursion(spark: SparkSession, _: str) -> DataFrame:
    """Recursive groups of the call graph."""
    p = Project(spark, samples.CALLS).resolve()
    e = callgraph.edges(p.found).select(_name("fn_id").alias("src"), _name("target").alias("dst"), F.lit("call").alias("kind"))
    return graph.recursive_groups(e).select("component", F.array_join("members", ",").alias("members"))


def call_roots_code(spark: SparkSession, _: str) -> DataFrame:
    """Functions that no other calls."""
    p = Project(spark, samples.CALLS).resolve()
    e = callgraph.edges(p.found).select(_name("fn_id").alias("src"), _name("target").alias("dst"))
    return graph.roots(p.functions.where("name != '<module>'").select(_name("fn_id").alias("node")), e).select(F.col("node").alias("name"))


def dependencies(spark: SparkSession, _: str) -> DataFrame:
    """File edges with imports, calls and examples."""
    p = Project(spark, samples.CALLS, samples.FLOWS).resolve()
    e = callgraph.dependency_edges(p.imported, p.found, p.functions)
    return e.select("src", "dst", F.array_join("imports", ",").alias("imports"), "calls", F.array_join("examples", ",").alias("examples"))


def handed_over(spark: SparkSession, _: str) -> DataFrame:
    """Functions handed over as arguments."""
    p = Project(spark, samples.CALLS)
    return callgraph.callbacks(facts.arguments(p.functions), p.functions).select(_name("fn_id").alias("caller"), _name("target").alias("handed"), "line")


def bound(spark: SparkSession, _: str) -> DataFrame:
    """Which parameter takes which argument."""
    p = Project(spark, samples.FLOWS).resolve()
    b = callgraph.bound_arguments(facts.arguments(p.functions), p.found, p.functions)
    return b.select(_name("fn_id").alias("caller"), "line", _name("target").alias("callee"), "param", F.array_join("paths", ",").alias("reads"))


def cfg_code(spark: SparkSession, _: str) -> DataFrame:
    """The statement graph of the branches project."""
    return cfg.statement_edges(Project(spark, samples.BRANCHES).functions).select(_name("fn_id").alias("function"), "src", "dst", "kind")


def control(spark: SparkSession, _: str) -> DataFrame:
    """what each statement depends on."""
    p = Project(spark, samples.BRANCHES)
    return cfg.control_dependence(kept(cfg.statement_edges(p.functions))).select(_name("fn_id").alias("function"), "controller", "node")


def def_use(spark: SparkSession, _: str) -> DataFrame:
    """definitions and the statements that read them."""
    p = Project(spark, samples.BRANCHES)
    reaching = cfg.reaching_definitions(p.functions, kept(cfg.statement_edges(p.functions)))
    return cfg.uses(p.functions, reaching).select(_name("fn_id").alias("function"), "def", "node", "var")


def unreachable(spark: SparkSession, _: str) -> DataFrame:
    """code that nothing reaches."""
    return cfg.dead_code(Project(spark, samples.FLOWS).functions).select("path", _name("fn_id").alias("function"), "line", "last_line", "statements")


def rejected(spark: SparkSession, _: str) -> DataFrame:
    """Files that can't be parsed; the others go on."""
    p = Project(spark, samples.BRANCHES)
    return p.relation("error").select("path", F.regexp_extract("error", r"^(\w+)", 1).alias("error"))


def declarations(spark: SparkSession, _: str) -> DataFrame:
    """Classes and bases."""
    return Project(spark, samples.CALLS).relation("decl").select("path", "kind", "name", F.coalesce("member", F.lit("")).alias("member"), "line")


def imports_code(spark: SparkSession, _: str) -> DataFrame:
    """Imports with the names they bind."""
    return Project(spark, samples.CALLS).relation("import").select("path", "module", F.array_join("names", ",").alias("names"), F.array_join("full", ",").alias("bound_to"), "line")


def functions_code(spark: SparkSession, _: str) -> DataFrame:
    """Functions with their parameters."""
    return Project(spark, samples.FLOWS).functions.select("path", "name", "line", F.array_join("params", ",").alias("params"))


def node_owners(spark: SparkSession, _: str) -> DataFrame:
    """How many nodes of each kind lie in each method, the method itself included."""
    nodes = kept(Project(spark, samples.BRANCHES).relation("node"))
    owner = graph.enclosing(nodes, "method")
    names = nodes.where("kind = 'method'").select(F.col("id").alias("owner"), F.col("name").alias("method"))
    return nodes.where("kind IN ('param', 'call', 'control', 'return')").join(owner, "id").join(names, "owner").groupBy("method", "kind").agg(F.count("*").alias("nodes"))


def _values(columns: str, rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({columns})"


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "taint_interproc": (taint_interproc, _values("rule, severity, file, function, line, origin", [('code-injection', 'high', 'flows/main.py', 'Job.start', 25, 'input() at flows/main.py:22'), ('command-injection', 'high', 'flows/main.py', 'branches', 32, 'input() (line 29)'), ('command-injection', 'high', 'flows/main.py', 'looped', 47, 'request.form.get() (line 48)'), ('command-injection', 'high', 'flows/main.py', 'main', 11, 'input() at flows/shell.py:26 returned by read_name()'), ('command-injection', 'high', 'flows/main.py', 'main', 9, 'request.args.get() (line 7)'), ('command-injection', 'high', 'flows/shell.py', 'down', 33, 'sys.argv (line 14) via down() at flows/main.py:14'), ('command-injection', 'high', 'flows/shell.py', 'run_cmd', 5, 'request.args.get() (line 7) via wrapped() at flows/main.py:8 → run_cmd() at flows/shell.py:9'), ('insecure-deserialization', 'medium', 'flows/main.py', 'always', 41, None), ('weak-crypto', 'medium', 'flows/main.py', 'always', 40, None)])),
    "call_graph_code": (call_graph, _values("caller, callee, sites, lines", [('K.run', 'K.step', 1, '14'), ('K.step', 'helper', 1, '17'), ('fact', 'fact', 1, '20'), ('local', 'helper', 1, '16'), ('main', 'K.__init__', 1, '9'), ('main', 'K.step', 1, '10'), ('main', 'fact', 1, '8'), ('main', 'helper', 1, '6'), ('main', 'local', 1, '7'), ('main', 'shared', 1, '11'), ('ping', 'pong', 1, '29'), ('pong', 'ping', 1, '33'), ('shared', 'ping', 1, '25')])),
    "call_externals": (call_externals, _values("callee, calls", [('apply', 1), ('open', 1), ('print', 1)])),
    "call_recursion": (call_recursion, _values("component, members", [('fact', 'fact'), ('ping', 'ping,pong')])),
    "call_roots_code": (call_roots_code, _values("name", [('Base.step',), ('Base.stop',), ('K.run',), ('main',), ('unused',)])),
    "dependency_edges": (dependencies, _values("src, dst, imports, calls, examples", [('calls/a.py', 'calls/b.py', 'calls.b', 4, 'K.__init__,K.step,helper'), ('flows/main.py', 'flows/shell.py', 'flows.shell', 7, 'down,fixed,quoted')])),
    "handed_over": (handed_over, _values("caller, handed, line", [('main', 'local', 12)])),
    "bound_arguments": (bound, _values("caller, line, callee, param, reads", [('down', 32, 'down', 'c', 'c'), ('down', 32, 'down', 'n', 'n'), ('main', 10, 'quoted', 'c', 'data'), ('main', 12, 'fixed', 'c', 'data'), ('main', 13, 'run_cmd', 'c', ''), ('main', 14, 'down', 'c', 'sys.argv[1]'), ('main', 14, 'down', 'n', ''), ('main', 8, 'wrapped', 'c', 'data'), ('main', 9, 'same', 'c', 'data'), ('wrapped', 9, 'run_cmd', 'c', 'c')])),
    "cfg_code": (cfg_code, _values("function, src, dst, kind", [('loops', '0:0', '2:0', 'normal'), ('loops', '2:0', '3:0', 'true'), ('loops', '2:0', '4:0', 'false'), ('loops', '3:0', '5:0', 'true'), ('loops', '3:0', '8:0', 'false'), ('loops', '4:0', 'exit', 'return'), ('loops', '5:0', '5:1', 'normal'), ('loops', '5:1', '2:0', 'continue'), ('loops', '7:0', '7:1', 'normal'), ('loops', '7:1', '4:0', 'break'), ('loops', '8:0', '5:0', 'false'), ('loops', '8:0', '7:0', 'true'), ('loops', 'entry', '0:0', 'normal'), ('matched', '0:0', '3:0', 'true'), ('matched', '0:0', '5:0', 'false'), ('matched', '0:0', '7:0', 'false'), ('matched', '2:0', 'exit', 'return'), ('matched', '3:0', '2:0', 'normal'), ('matched', '5:0', '5:1', 'normal'), ('matched', '5:1', '2:0', 'normal'), ('matched', '7:0', '2:0', 'normal'), ('matched', 'entry', '0:0', 'normal'), ('tries', '2:0', 'exit', 'return'), ('tries', '3:0', '3:1', 'normal'), ('tries', '3:1', '3:2', 'normal'), ('tries', '3:2', '2:0', 'normal'), ('tries', '4:0', '4:1', 'normal'), ('tries', '4:1', '2:0', 'normal'), ('tries', 'entry', '3:0', 'exception'), ('tries', 'entry', '4:0', 'normal')])),
    "control_dependence": (control, _values("function, controller, node", [('loops', '2:0', '3:0'), ('loops', '3:0', '2:0'), ('loops', '3:0', '5:0'), ('loops', '3:0', '5:1'), ('loops', '3:0', '8:0'), ('loops', '8:0', '2:0'), ('loops', '8:0', '5:0'), ('loops', '8:0', '5:1'), ('loops', '8:0', '7:0'), ('loops', '8:0', '7:1'), ('loops', 'entry', '0:0'), ('loops', 'entry', '4:0'), ('matched', '0:0', '3:0'), ('matched', '0:0', '5:0'), ('matched', '0:0', '5:1'), ('matched', '0:0', '7:0'), ('matched', 'entry', '0:0'), ('matched', 'entry', '2:0'), ('tries', 'entry', '2:0'), ('tries', 'entry', '3:0'), ('tries', 'entry', '3:1'), ('tries', 'entry', '3:2'), ('tries', 'entry', '4:0'), ('tries', 'entry', '4:1')])),
    "def_use": (def_use, _values("function, def, node, var", [('loops', '0:0', '4:0', 'total'), ('loops', '0:0', '8:0', 'total'), ('loops', '5:0', '2:0', 'n'), ('loops', '5:0', '3:0', 'n'), ('loops', '5:0', '7:0', 'n'), ('loops', '7:0', '4:0', 'total'), ('loops', 'entry', '2:0', 'n'), ('loops', 'entry', '3:0', 'n'), ('loops', 'entry', '7:0', 'n'), ('matched', '3:0', '2:0', 'r'), ('matched', '5:0', '5:1', 'a'), ('matched', '5:1', '2:0', 'r'), ('matched', '7:0', '2:0', 'r'), ('matched', 'entry', '0:0', 'v'), ('matched', 'entry', '5:0', 'v'), ('tries', '3:1', '2:0', 'x'), ('tries', '3:1', '3:2', 'x'), ('tries', '4:0', '2:0', 'x'), ('tries', '4:0', '4:1', 'x'), ('tries', 'entry', '4:0', 'x')])),
    "unreachable_code": (unreachable, _values("path, function, line, last_line, statements", [('flows/main.py', 'dead', 53, 54, 2)])),
    "rejected_files": (rejected, _values("path, error", [('branches/broken.py', 'SyntaxError')])),
    "declarations": (declarations, _values("path, kind, name, member, line", [('calls/b.py', 'base', 'K', 'Base', 9), ('calls/b.py', 'class', 'Base', '', 1), ('calls/b.py', 'class', 'K', '', 9)])),
    "imports_code": (imports_code, _values("path, module, names, bound_to, line", [('calls/a.py', 'calls.b', 'K,helper', 'calls.b.K,calls.b.helper', 1), ('calls/a.py', 'calls.b', 'other', 'calls.b', 2)])),
    "functions_code": (functions_code, _values("path, name, line, params", [('flows/main.py', 'Job.__init__', 18, 'text'), ('flows/main.py', 'Job.load', 21, ''), ('flows/main.py', 'Job.start', 24, ''), ('flows/main.py', 'always', 37, 'blob'), ('flows/main.py', 'branches', 28, 'flag'), ('flows/main.py', 'dead', 51, ''), ('flows/main.py', 'looped', 44, 'rows'), ('flows/main.py', 'main', 6, ''), ('flows/shell.py', 'down', 30, 'c,n'), ('flows/shell.py', 'fixed', 17, 'c'), ('flows/shell.py', 'quoted', 12, 'c'), ('flows/shell.py', 'read_name', 25, ''), ('flows/shell.py', 'run_cmd', 4, 'c'), ('flows/shell.py', 'same', 21, 'c'), ('flows/shell.py', 'wrapped', 8, 'c')])),
    "node_owners": (node_owners, _values("method, kind, nodes", [('loops', 'control', 2), ('loops', 'param', 1), ('loops', 'return', 1), ('matched', 'control', 1), ('matched', 'param', 1), ('matched', 'return', 1), ('tries', 'call', 2), ('tries', 'control', 1), ('tries', 'param', 1), ('tries', 'return', 1)])),
}
