"""Untrusted values through functions and calls: sources, cleaners, sinks, summaries, findings.

Summaries start at nothing and grow: a round analyses all functions, the next ones only callers of
functions whose summaries changed (and methods of classes whose fields turned untrusted), until
none does; so leaves come first and recursive groups settle by themselves. A round is one Spark
job: function records joined with their resolved calls and the callees' summaries, a function a
row. Inside a function a worklist over its blocks joins the states.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.frontend.facts import SCHEMAS
from loomline.sources.code import ship
from loomline.sources.scratch import kept

#: Causes of one value, hits of one parameter, steps of a chain; a bound of rounds that chains never reach.
CAUSES, HITS, CHAIN, ROUNDS = 6, 20, 6, 100
LEVELS = ("low", "medium", "high")


@dataclass
class Sink:
    rule: str
    cwe: str
    severity: str
    pattern: str
    message: str
    args: list = field(default_factory=list)  # positions and keywords; empty: any
    always: bool = False
    literal: str | None = None  # the named argument must be this literal
    unless: list[str] = field(default_factory=list)  # callees that look alike


@dataclass
class Rules:
    """What is untrusted, what cleans, where it must not arrive."""

    sources: list[tuple[str, str]]  # call pattern or path, description
    sanitizers: list[str]
    sinks: list[Sink]
    entries: list[tuple[str, list[str]]] = field(default_factory=list)  # function name pattern, parameters (empty: all)
    implicit: bool = False

    @staticmethod
    def python() -> Rules:
        def sink(rule: str, cwe: str, severity: str, message: str, patterns: str, **more: object) -> list[Sink]:
            return [Sink(rule, cwe, severity, p, message, **more) for p in patterns.split()]

        return Rules(
            [(p, p + "()") for p in "input sys.stdin.read sys.stdin.readline request.get_json request.get_data request.args.get request.form.get request.values.get request.cookies.get request.headers.get os.getenv os.environ.get".split()]
            + [(p, p) for p in "sys.argv request.args request.form request.values request.cookies request.headers request.data request.json request.files os.environ".split()],
            "int float bool len shlex.quote html.escape markupsafe.escape bleach.clean werkzeug.utils.secure_filename secure_filename os.path.basename uuid.UUID ipaddress.ip_address".split(),
            sink("command-injection", "CWE-78", "high", "untrusted value in a command", "os.system os.popen subprocess.getoutput subprocess.getstatusoutput commands.getoutput", args=[0])
            + sink("command-injection", "CWE-78", "high", "untrusted value in a command", "subprocess.run subprocess.call subprocess.Popen subprocess.check_output subprocess.check_call", args=[0, "args"])
            + sink("sql-injection", "CWE-89", "high", "untrusted value in a query", "*.execute *.executemany *.executescript *.raw", args=[0], unless=["executor.execute"])
            + sink("code-injection", "CWE-95", "high", "untrusted value run as code", "eval exec compile", args=[0], always=False)
            + sink("code-injection", "CWE-95", "medium", "code from a value", "eval exec", args=[0], always=True)
            + sink("path-traversal", "CWE-22", "medium", "untrusted value in a file name", "open os.remove os.unlink shutil.rmtree send_file io.open", args=[0, "file"])
            + sink("insecure-deserialization", "CWE-502", "medium", "objects from untrusted bytes", "pickle.loads pickle.load yaml.load marshal.loads dill.loads", args=[0], always=True)
            + sink("server-side-request-forgery", "CWE-918", "medium", "untrusted value in an address", "requests.get requests.post requests.request urllib.request.urlopen httpx.get", args=[0, "url"])
            + sink("template-injection", "CWE-1336", "high", "untrusted value as a template", "render_template_string jinja2.Template Template", args=[0])
            + sink("open-redirect", "CWE-601", "medium", "untrusted value in a redirect", "redirect flask.redirect", args=[0])
            + sink("weak-crypto", "CWE-327", "medium", "weak hash", "hashlib.md5 hashlib.sha1", always=True)
            + sink("disabled-verification", "CWE-295", "high", "certificates are not checked", "requests.get requests.post requests.request", args=["verify"], always=True, literal="False"),
        )


def matches(callee: str, pattern: str) -> bool:
    """``name`` exact; ``a.b`` the name or a dotted suffix of it; ``*.m`` the last segment of several."""
    if pattern.startswith("*."):
        return "." in callee and callee.rsplit(".", 1)[-1] == pattern[2:]
    return callee == pattern or ("." in pattern and callee.endswith("." + pattern))


def _ancestors(path: str) -> list[str]:
    return [path, *(path[:i] for i in range(len(path) - 1, 0, -1) if path[i] in ".[")]


class Body:
    """One function's analysis (F10-F14, F17, F19): state of a block is path to causes.

    A cause is ``("param", place, chain)`` or ``("source", line, description)``.
    """

    def __init__(self, record: dict, targets: dict[str, list[str]], summaries: dict[str, dict], rules: Rules, fields: dict[str, list]) -> None:
        self.f, self.targets, self.summaries, self.rules, self.fields = record, targets, summaries, rules, fields
        self.findings: dict[tuple, dict] = {}
        self.summary: dict = {"params": record["params"], "returns": [], "source": None, "sinks": [], "fields": {}}
        self.sinks_seen: set[str] = set()

    def run(self) -> None:
        f = self.f
        start: dict[str, set] = {p: {("param", i, "")} for i, p in enumerate(f["params"])}
        for pattern, names in self.rules.entries:
            if pattern == "*" or matches(f["name"], pattern):
                for p in f["params"]:
                    if not names or p in names:
                        start[p] = start[p] | {("source", f["line"], f"parameter {p}")}
        if f["owner"] and f["receiver"]:
            for path, causes in self.fields.get(f["owner"], {}).items():
                start["self." + path] = {tuple(c) for c in causes}
        blocks = {b["block"]: b["stmts"] for b in f["blocks"]}
        after: dict[int, list[int]] = {}
        for e in f["edges"]:
            after.setdefault(e["src"], []).append(e["dst"])
        states: dict[int, dict[str, set]] = {0: start}
        todo, budget = [0], 50 * len(blocks) + 1000
        while todo and budget:
            budget -= 1
            at = todo.pop(0)
            state = {k: set(v) for k, v in states[at].items()}
            for s in blocks.get(at, []):
                self._statement(s, state)
            for b in after.get(at, ()):
                old = states.get(b)
                if old is None:
                    states[b] = {k: set(v) for k, v in state.items()}
                    todo.append(b)
                    continue
                grown = False
                for k, v in state.items():
                    if not v <= old.get(k, set()):
                        old[k] = self._least(old.get(k, set()) | v)
                        grown = True
                if grown and b not in todo:
                    todo.append(b)

    @staticmethod
    def _least(causes: set) -> set:
        """The six least causes, parameters first."""
        return causes if len(causes) <= CAUSES else set(sorted(causes, key=lambda c: (c[0] != "param", str(c[1]).zfill(9), c[2]))[:CAUSES])

    def _read(self, path: str, state: dict[str, set], line: int) -> set:
        for p in _ancestors(path):
            if p in state:
                found = set(state[p])
                break
        else:
            found = set()
        for k, v in state.items():  # a container holds what its parts hold
            if k.startswith(path) and len(k) > len(path) and k[len(path)] in ".[":
                found |= v
        if not any(p in state for p in _ancestors(path)):
            bare = "".join(part.split("[")[0] for part in path.split("]"))
            for pattern, text in self.rules.sources:
                if not text.endswith("()") and (bare == pattern or bare.startswith(pattern + ".") or bare.endswith("." + pattern)):
                    found.add(("source", line, text))
        return self._least(found)

    def _value(self, value: dict, results: dict[int, set], state: dict[str, set], line: int) -> set:
        out: set = set()
        for p in value["paths"]:
            out |= self._read(p, state, line)
        for c in value["calls"]:
            out |= results.get(c, set())
        return self._least(out)

    def _statement(self, s: dict, state: dict[str, set]) -> None:
        results: dict[int, set] = {}
        todo = {c["call"]: c for c in s["calls"]}

        def call(n: int) -> set:
            if n not in results:
                results[n] = set()
                c = todo[n]
                for v in (c["recv"], *c["args"]):
                    for inner in v["calls"]:
                        call(inner)
                results[n] = self._call(c, results, state)
            return results[n]

        for n in todo:
            call(n)
        new = [(a["target"], a["strong"], self._value(a, results, state, s["line"])) for a in s["assigns"]]
        for target, strong, causes in new:
            if strong:
                for k in [k for k in state if k.startswith(target) and (len(k) == len(target) or k[len(target)] in ".[")]:
                    del state[k]
                state[target] = causes
            else:
                state[target] = self._least(state.get(target, set()) | causes)
            if target.startswith("self.") and self.f["owner"] and causes:
                for c in sorted(causes, key=str):
                    if c[0] == "source":
                        own = self.summary["fields"].setdefault(target[5:], [])
                        e = ["source", c[1], c[2] if " at " in c[2] else f"{c[2]} at {self.f['path']}:{c[1]}"]
                        if e not in own:
                            own.append(e)
        if s["ret"]:
            for c in self._value(s["ret"], results, state, s["line"]):
                if c[0] == "param":
                    if c[1] not in self.summary["returns"]:
                        self.summary["returns"].append(c[1])
                elif self.summary["source"] is None or (c[1], c[2]) < tuple(self.summary["source"]):
                    self.summary["source"] = [c[1], c[2]]

    def _call(self, c: dict, results: dict[int, set], state: dict[str, set]) -> set:
        callee, line = c["callee"], c["line"]
        values = [(a, self._value(a, results, state, line)) for a in c["args"]]
        receiver = self._value(c["recv"], results, state, line)
        self._sinks(c, values)
        if any(matches(callee, p) for p in self.rules.sanitizers):
            return set()
        for pattern, text in self.rules.sources:
            if text.endswith("()") and matches(callee, pattern):
                return {("source", line, text)}
        targets = self.targets.get(f"{line}:{c['col']}", [])
        if targets:
            out: set = set()
            for t in targets:
                summary = self.summaries.get(t)
                if summary is None:  # not analysed yet: nothing is known to come through
                    continue
                bound: dict[int, set] = {}
                for a, causes in values:
                    i = summary["params"].index(a["kw"]) if a["kw"] in summary["params"] else a["pos"] if a["kw"] is None else -1
                    if i >= 0:
                        bound[i] = bound.get(i, set()) | causes
                for i in summary["returns"]:
                    out |= bound.get(i, set())
                name = t.rsplit(":", 1)[-1]
                if summary["source"]:
                    at, text = summary["source"]
                    where = t.split(":", 1)[0]
                    text = text if " at " in text else f"{text} at {where}:{at}"
                    out.add(("source", line, f"{text} returned by {name}()"))
                for hit in summary["sinks"]:
                    for cause in bound.get(hit["param"], set()):
                        chain = f" via {name}() at {self.f['path']}:{line}" if not hit["chain"] else f" via {name}() at {self.f['path']}:{line} →{hit['chain'].removeprefix(' via')}"
                        if chain.count("()") <= CHAIN:
                            self._hit(cause, hit, chain)
            return self._least(out)
        out = set(receiver)
        for _, causes in values:
            out |= causes
        return self._least(out)

    def _sinks(self, c: dict, values: list) -> None:
        for sink in self.rules.sinks:
            if not matches(c["callee"], sink.pattern) or any(matches(c["callee"], p) for p in sink.unless):
                continue
            chosen = [(a, v) for a, v in values if not sink.args or (a["pos"] if a["kw"] is None else a["kw"]) in sink.args]
            if sink.literal is not None and not any(a["literal"] == sink.literal for a, _ in chosen):
                continue
            where = {"rule": sink.rule, "cwe": sink.cwe, "severity": sink.severity, "message": sink.message, "file": self.f["path"], "function": self.f["name"], "line": c["line"], "col": c["col"]}
            causes = {x for _, v in chosen for x in v}
            if sink.always:
                self._found({**where, "origin": None})
                where["severity"] = LEVELS[min(2, LEVELS.index(sink.severity) + 1)]  # one level higher where taint arrives
            for cause in causes:
                self._hit(cause, where, "")

    def _hit(self, cause: tuple, where: dict, chain: str) -> None:
        own = {k: v for k, v in where.items() if k not in ("param", "chain")}
        if cause[0] == "source":
            self._found({**own, "origin": f"{cause[2]} (line {cause[1]}){chain}" if " at " not in cause[2] else cause[2] + chain})
        else:
            hit = {**own, "param": cause[1], "chain": chain}
            key = json.dumps(hit, sort_keys=True)
            if key not in self.sinks_seen and sum(h["param"] == cause[1] for h in self.summary["sinks"]) < HITS:
                self.sinks_seen.add(key)
                self.summary["sinks"].append(hit)

    def _found(self, finding: dict) -> None:
        """of the findings of one place and rule the most severe, then one with an origin, then the least origin."""
        key = (finding["file"], finding["line"], finding["col"], finding["rule"], finding["function"])
        rank = lambda x: (-LEVELS.index(x["severity"]), x["origin"] is None, x["origin"] or "")
        if key not in self.findings or rank(finding) < rank(self.findings[key]):
            self.findings[key] = finding


_FINDING = "rule string, cwe string, severity string, message string, file string, function string, line int, col int, origin string"


def _analysed(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[str, str, str]] = []
        for record, targets, summaries, fields in zip(*(batch.column(c).to_pylist() for c in ("record", "targets", "summaries", "fields")), strict=True):
            by: dict[str, list[str]] = {}
            for t in targets or []:
                by.setdefault(t["at"], []).append(t["target"])
            held: dict[str, dict[str, list]] = {}
            for x in fields or []:
                for cell, causes in json.loads(x["fields"]).items():
                    held.setdefault(x["owner"], {}).setdefault(cell, []).extend(causes)
            body = Body(json.loads(record), by, {x["fn_id"]: json.loads(x["summary"]) for x in summaries or []}, rules, held)
            body.run()
            body.summary["returns"].sort()
            body.summary["sinks"].sort(key=lambda h: json.dumps(h, sort_keys=True))
            out.append((body.f["fn_id"], "summary", json.dumps(body.summary, sort_keys=True)))
            out += [(body.f["fn_id"], "finding", json.dumps(x, sort_keys=True)) for x in body.findings.values()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["fn_id", "what", "record"])


def _level(functions: DataFrame, targets: DataFrame, summaries: DataFrame, fields: DataFrame, rules: Rules) -> DataFrame:
    """fn_id, what, record: summaries and findings of some functions."""
    at = F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string"))
    own = targets.join(functions.select("fn_id"), "fn_id", "left_semi")
    sites = own.groupBy("fn_id").agg(F.collect_set(F.struct(at.alias("at"), "target")).alias("targets"))
    known = own.select("fn_id", "target").distinct().join(summaries.select(F.col("fn_id").alias("target"), "summary"), "target")
    known = known.groupBy("fn_id").agg(F.collect_list(F.struct(F.col("target").alias("fn_id"), "summary")).alias("summaries"))
    cells = functions.select("fn_id", "owner").join(fields, "owner").groupBy("fn_id").agg(F.collect_list(F.struct("owner", "fields")).alias("fields"))
    rows = functions.select("fn_id", F.to_json(F.struct(*[c for c in functions.columns if c not in ("component", "level")]), {"ignoreNullFields": "false"}).alias("record"))
    rows = rows.join(sites, "fn_id", "left").join(known, "fn_id", "left").join(cells, "fn_id", "left").select("record", "targets", "summaries", "fields")
    return rows.mapInArrow(lambda it: _analysed(it, rules), "fn_id string, what string, record string")


def analyse(functions: DataFrame, targets: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Findings and summaries (fn_id, summary) of all functions.

    ``targets`` are resolved calls (fn_id, line, col, target, exact); guesses carry no summary.
    """
    spark = functions.sparkSession
    ship(spark)
    functions = kept(functions)
    exact = kept(targets.where("exact").select("fn_id", "line", "col", "target"))
    summaries = spark.createDataFrame([], "fn_id string, summary string")
    fields = spark.createDataFrame([], "owner string, fields string")
    done, todo = None, functions
    part_of = lambda name: F.get_json_object("summary", f"$.{name}")
    for n in range(ROUNDS):
        part = kept(_level(todo, exact, summaries, fields, rules).withColumn("round", F.lit(n)))
        done = part if done is None else done.unionByName(part)
        own = part.where("what = 'summary'").select("fn_id", F.col("record").alias("summary"))
        says = (part_of("returns") != "[]") | part_of("source").isNotNull() | (part_of("sinks") != "[]") | (part_of("fields") != "{}")
        changed = kept(own.where(says).join(summaries, ["fn_id", "summary"], "left_anti"))
        if changed.isEmpty():
            break
        summaries = kept(summaries.join(own.select("fn_id"), "fn_id", "left_anti").unionByName(own))
        callers = exact.join(changed.select(F.col("fn_id").alias("target")), "target", "left_semi").select("fn_id")
        held = functions.where("owner IS NOT NULL").select("fn_id", "owner")
        cells = held.join(summaries, "fn_id").select("owner", part_of("fields").alias("fields")).where("fields != '{}'").distinct()
        touched = held.join(cells.join(fields, ["owner", "fields"], "left_anti"), "owner", "left_semi").select("fn_id")
        fields = cells
        todo = functions.join(callers.union(touched).distinct(), "fn_id", "left_semi")
    last = Window.partitionBy("fn_id")
    found = done.withColumn("last", F.max("round").over(last)).where("round = last AND what = 'finding'").select(F.from_json("record", _FINDING).alias("f")).select("f.*")
    return best(found), summaries


def best(found: DataFrame) -> DataFrame:
    """F23, W1 over all functions: one finding a place, rule and function."""
    from loomline.operators.findings import best as first_of

    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("severity"))
    return first_of(found, ["file", "line", "col", "rule", "function"], [rank.desc(), F.col("origin").isNull(), F.col("origin")])
