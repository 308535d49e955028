"""Python sources lowered to control flow with facts.

One file gives one record: its functions (every ``def`` and ``lambda``, and ``<module>`` for the top
level), each with blocks of statements, typed edges, and for each statement what it assigns, calls
and returns. Values are flat: the access paths they read and the calls they hold (by number in
the statement); a call has its own such values for receiver and arguments. So values nest by
call number and every table stays relational.
"""

from __future__ import annotations

import ast
from typing import Any

EDGES = ("normal", "true", "false", "back", "break", "continue", "return", "exception")
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)


def path_of(e: ast.AST) -> str | None:
    """Access path of a pure member chain: ``x``, ``self.cmd``, ``xs[0]``, ``d['k'].f``."""
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        base = path_of(e.value)
        return base and f"{base}.{e.attr}"
    if isinstance(e, ast.Subscript):
        base = path_of(e.value)
        return base and base + element_key(e.slice)
    return None


def element_key(e: ast.AST) -> str:
    """``[0]`` for up to six digits, ``['k']`` for a word of up to 32; else nothing: the whole container."""
    if isinstance(e, ast.Constant):
        if isinstance(e.value, int) and not isinstance(e.value, bool) and 0 <= e.value < 10**6:
            return f"[{e.value}]"
        if isinstance(e.value, str) and 0 < len(e.value) <= 32 and e.value.replace("_", "a").isalnum():
            return f"['{e.value}']"
    return ""


def callee_of(e: ast.AST) -> str:
    """Dotted name of what is called; calls and subscripts inside lose their arguments and keys."""
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        base = callee_of(e.value)
        return f"{base}.{e.attr}" if base else e.attr
    if isinstance(e, ast.Call):
        return callee_of(e.func)
    if isinstance(e, ast.Subscript | ast.Await):
        return callee_of(e.value)
    return "<lambda>" if isinstance(e, ast.Lambda) else ""


def type_name(e: ast.AST | None) -> str | None:
    """Last name of an annotation; ``Optional[X]``, ``list[X]``, ``X | None`` and quoted types are unwrapped."""
    if isinstance(e, ast.Constant):
        if not isinstance(e.value, str):
            return None
        try:
            return type_name(ast.parse(e.value, mode="eval").body)
        except SyntaxError:
            return None
    if isinstance(e, ast.Subscript):
        return type_name(e.slice.elts[-1] if isinstance(e.slice, ast.Tuple) and e.slice.elts else e.slice)
    if isinstance(e, ast.BinOp):
        return type_name(e.left) or type_name(e.right)
    if isinstance(e, ast.Attribute):
        return e.attr
    return e.id if isinstance(e, ast.Name) else None


class Function:
    """The control flow of one function while it is built."""

    def __init__(self, name: str, node: ast.AST | None, owner: str | None, nested: bool) -> None:
        self.name, self.owner, self.nested = name, owner, nested
        self.line, self.col = (node.lineno, node.col_offset + 1) if node is not None else (1, 1)
        self.params: list[str] = []
        self.receiver: str | None = None
        self.types: dict[str, str] = {}
        self.returns: str | None = None
        self.free: list[str] = []
        self.blocks: list[list[dict]] = [[], []]  # entry, exit
        self.edges: list[tuple[int, int, str]] = []
        self.at: int | None = 0
        self.loops: list[tuple[int, int, int]] = []  # head, after, open finally blocks
        self.handlers: list[list[int]] = []
        self.finals: list[list[ast.stmt]] = []

    def block(self) -> int:
        self.blocks.append([])
        return len(self.blocks) - 1

    def edge(self, a: int | None, b: int, kind: str) -> None:
        if a is not None and (a, b, kind) not in self.edges:
            self.edges.append((a, b, kind))

    def here(self) -> int:
        """The present block; one that nothing leads to after a jump."""
        if self.at is None:
            self.at = self.block()
        return self.at

    def record(self, path: str) -> dict:
        return {
            "fn_id": f"{path}:{self.line}:{self.col}:{self.name}", "path": path, "name": self.name, "owner": self.owner, "line": self.line, "col": self.col,
            "params": self.params, "receiver": self.receiver, "ret_type": self.returns, "types": [{"name": k, "type": v} for k, v in self.types.items()], "free": self.free,
            "blocks": [{"block": i, "stmts": b} for i, b in enumerate(self.blocks)], "edges": [{"src": a, "dst": b, "kind": k} for a, b, k in self.edges],
        }


class Lowering:
    """All functions, imports, declarations and tree nodes of one module."""

    def __init__(self, path: str, text: str) -> None:
        self.path = path
        self.tree = ast.parse(text)
        self.functions: list[dict] = []
        self.imports: list[dict] = []
        self.decls: list[dict] = []
        self.nodes: list[dict] = []
        self._tree(self.tree, None, 0)
        self._function("<module>", None, self.tree.body, None, False)

    # the syntax tree

    def _tree(self, node: ast.AST, parent: str | None, ord_: int) -> None:
        line, col = getattr(node, "lineno", 1), getattr(node, "col_offset", 0) + 1
        kind = {
            "Module": "file", "FunctionDef": "method", "AsyncFunctionDef": "method", "Lambda": "method", "ClassDef": "type_decl", "Call": "call", "Assign": "assign", "AnnAssign": "assign", "AugAssign": "assign", "NamedExpr": "assign",
            "Name": "identifier", "Constant": "literal", "Attribute": "field_access", "BinOp": "binary_op", "BoolOp": "binary_op", "Compare": "binary_op", "arg": "param", "Return": "return",
            "If": "control", "While": "control", "For": "control", "Try": "control", "Match": "control", "With": "control",
        }.get(type(node).__name__, "other")
        end = f"{getattr(node, 'end_lineno', 0)}.{getattr(node, 'end_col_offset', 0)}"
        own = f"{self.path}:{line}.{col}-{end}:{type(node).__name__}"
        if parent is not None and not hasattr(node, "lineno"):
            own = f"{parent}#{type(node).__name__}:{ord_}"  # no place of its own
        name = callee_of(node) if isinstance(node, ast.Call) else getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None)
        self.nodes.append({"id": own, "kind": kind, "parent": parent, "ord": ord_, "line": line, "col": col, "name": name})
        children = [c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context | ast.operator | ast.boolop | ast.unaryop | ast.cmpop)]
        for i, child in enumerate(children):
            self._tree(child, own, i)
        if isinstance(node, ast.Import):
            self.imports += [{"module": a.name, "names": [a.asname or a.name.split(".")[0]], "full": [a.name if a.asname else a.name.split(".")[0]], "line": line, "kind": "module"} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            full = [f"{module.lstrip('.')}.{a.name}".strip(".") for a in node.names]
            self.imports.append({"module": module, "names": [a.asname or a.name for a in node.names], "full": full, "line": line, "kind": "module"})
        elif isinstance(node, ast.Call) and callee_of(node.func) in ("importlib.import_module", "__import__") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            self.imports.append({"module": node.args[0].value, "names": [], "full": [], "line": line, "kind": "module"})
        elif isinstance(node, ast.ClassDef):
            self.decls.append({"kind": "class", "name": node.name, "member": None, "type": None, "line": line})
            self.decls += [{"kind": "base", "name": node.name, "member": b, "type": None, "line": line} for b in map(callee_of, node.bases) if b]
            for s in node.body:
                if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                    self.decls.append({"kind": "field", "name": node.name, "member": s.target.id, "type": type_name(s.annotation), "line": s.lineno})

    # functions

    def _function(self, name: str, node: ast.AST | None, body: list[ast.stmt] | ast.expr, owner: str | None, nested: bool) -> None:
        f = Function(name, node, owner, nested)
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            a = node.args
            own = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
            f.types = {p.arg: t for p in own if (t := type_name(p.annotation))}
            names = [p.arg for p in own]
            if owner and names and names[0] in ("self", "cls"):
                f.receiver = names[0] if names[0] == "self" else None
                names = names[1:]
            f.params = names
            f.returns = type_name(getattr(node, "returns", None))
        f.free = sorted({n for s in ast.walk(node) if isinstance(s, ast.Global | ast.Nonlocal) for n in s.names}) if node is not None else []
        if isinstance(body, list):
            self._body(f, body)
        else:
            s = self._stmt(f, body, "other", ret=body)
            f.blocks[0].append(s)
            f.edge(f.here(), 1, "return")
            f.at = None
        f.edge(f.at, 1, "normal")
        if name != "<module>" or any(s["calls"] or s["assigns"] or s["kind"] == "branch" for b in f.blocks for s in b):
            self.functions.append(f.record(self.path))

    def _inner(self, f: Function, s: ast.AST, cls: str | None = None) -> None:
        """Lower what is defined inside a statement: functions of classes and expressions' lambdas."""
        for child in ast.iter_child_nodes(s):
            if isinstance(child, ast.Lambda):
                named = isinstance(s, ast.Assign) and s.value is child and isinstance(s.targets[0], ast.Name)
                own = s.targets[0].id if named else "<lambda>"
                self._function(f"{f.name}.{own}" if f.name != "<module>" else own, child, child.body, None, f.name != "<module>")
            elif not isinstance(child, _SCOPES) and not isinstance(child, ast.stmt):
                self._inner(f, child)

    def _class(self, f: Function, s: ast.ClassDef, prefix: str) -> None:
        for part in s.body:
            if isinstance(part, ast.FunctionDef | ast.AsyncFunctionDef):
                self._function(f"{prefix}{s.name}.{part.name}", part, part.body, s.name, f.name != "<module>")
            elif isinstance(part, ast.ClassDef):
                self._class(f, part, f"{prefix}{s.name}.")

    # statements

    def _stmt(self, f: Function, e: ast.AST | None, kind: str, at: ast.AST | None = None, targets: list[tuple] = (), ret: ast.AST | None = None) -> dict:
        at = at if at is not None else e
        s: dict[str, Any] = {"kind": kind, "line": at.lineno, "col": at.col_offset + 1, "text": " ".join(ast.unparse(at).split("\n")[0].split())[:100], "assigns": [], "calls": [], "ret": None, "cond": None}
        if e is not None:
            self._inner(f, at)
            value = self._value(s, e)
            for target, strong, own in targets:
                own_value = value if own is None else own if isinstance(own, dict) else self._value(s, own)
                s["assigns"].append({"target": target, "strong": strong, **own_value})
            if ret is not None:
                s["ret"] = value
            if kind == "branch":
                s["cond"] = value
        if any(s["calls"]) and kind == "other":
            s["kind"] = "call"
        if s["assigns"] and kind == "other":
            s["kind"] = "assign"
        return s

    def _value(self, s: dict, e: ast.AST | None) -> dict:
        paths: list[str] = []
        calls: list[int] = []

        def walk(x: ast.AST | None) -> None:
            if x is None or isinstance(x, ast.Constant):
                return
            if isinstance(x, ast.Lambda):
                paths.append(f"<fn@{x.lineno}:{x.col_offset + 1}>")
            elif isinstance(x, ast.Call):
                calls.append(self._call(s, x))
            elif p := path_of(x):
                paths.append(p)
            elif isinstance(x, ast.Attribute):
                walk(x.value)
            elif isinstance(x, ast.NamedExpr):
                inner = self._value(s, x.value)
                s["assigns"].append({"target": x.target.id, "strong": True, **inner})
                paths.extend(inner["paths"])
                calls.extend(inner["calls"])
            elif isinstance(x, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
                for g in x.generators:
                    over = self._value(s, g.iter)
                    s["assigns"] += [{"target": t, "strong": True, **over} for t in self._names(g.target)]
                    for c in g.ifs:
                        walk(c)
                for part in (x.key, x.value) if isinstance(x, ast.DictComp) else (x.elt,):
                    walk(part)
            else:
                for child in ast.iter_child_nodes(x):
                    if isinstance(child, ast.expr | ast.FormattedValue | ast.keyword | ast.slice if hasattr(ast, "slice") else ast.expr):
                        walk(child)

        walk(e)
        return {"paths": sorted(set(paths)), "calls": calls}

    def _call(self, s: dict, e: ast.Call) -> int:
        recv = self._value(s, e.func.value) if isinstance(e.func, ast.Attribute) else {"paths": [], "calls": []}
        args = []
        for i, a in enumerate(e.args):
            inner = a.value if isinstance(a, ast.Starred) else a
            args.append({"pos": i, "kw": None, "literal": self._literal(inner), **self._value(s, inner)})
        for k in e.keywords:
            args.append({"pos": -1, "kw": k.arg, "literal": self._literal(k.value), **self._value(s, k.value)})
        n = len(s["calls"])
        s["calls"].append({"call": n, "callee": callee_of(e.func), "line": e.lineno, "col": e.col_offset + 1, "recv": recv, "args": args})
        return n

    @staticmethod
    def _literal(e: ast.AST) -> str | None:
        """A literal argument as text; dictionaries up to three levels keep their literal members."""
        try:
            return repr(ast.literal_eval(e)) if isinstance(e, ast.Constant | ast.Dict | ast.List | ast.Tuple | ast.UnaryOp) else None
        except (ValueError, TypeError, SyntaxError, RecursionError):
            return None

    def _names(self, t: ast.AST) -> list[str]:
        if isinstance(t, ast.Tuple | ast.List):
            return [n for x in t.elts for n in self._names(x)]
        if isinstance(t, ast.Starred):
            return self._names(t.value)
        p = path_of(t)
        return [p] if p else []

    def _targets(self, targets: list[ast.AST], value: ast.AST | None) -> list[tuple]:
        """(target, strong, own value): tuples are paired where both sides have as many parts."""
        out: list[tuple] = []
        for t in targets:
            if isinstance(t, ast.Tuple | ast.List) and isinstance(value, ast.Tuple | ast.List) and len(t.elts) == len(value.elts) and not any(isinstance(x, ast.Starred) for x in [*t.elts, *value.elts]):
                for a, b in zip(t.elts, value.elts, strict=True):
                    out += [(n, True, b) for n in self._names(a)]
            else:
                dynamic = isinstance(t, ast.Subscript) and not element_key(t.slice)
                out += [(n, not dynamic, None) for n in self._names(t)]
                if isinstance(value, ast.Dict) and (p := path_of(t)):
                    out += [(p + key, True, v) for k, v in zip(value.keys, value.values, strict=True) if k is not None and (key := element_key(k))]
        return out

    def _cond(self, f: Function, e: ast.expr, yes: int, no: int) -> None:
        """A condition: one block for each operand of and, or, not."""
        if isinstance(e, ast.BoolOp):
            for i, part in enumerate(e.values):
                last = i == len(e.values) - 1
                other = f.block() if not last else -1
                if isinstance(e.op, ast.And):
                    self._cond(f, part, yes if last else other, no)
                else:
                    self._cond(f, part, yes, no if last else other)
                if not last:
                    f.at = other
            return
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
            self._cond(f, e.operand, no, yes)
            return
        f.blocks[f.here()].append(self._stmt(f, e, "branch"))
        f.edge(f.at, yes, "true")
        f.edge(f.at, no, "false")
        f.at = None

    def _leave(self, f: Function, down_to: int) -> None:
        """Copies of the open ``finally`` bodies that a jump runs through."""
        held = f.finals
        for i in range(len(held) - 1, down_to - 1, -1):
            f.finals = held[:i]
            self._body(f, held[i])
        f.finals = held

    def _body(self, f: Function, body: list[ast.stmt]) -> None:
        for s in body:
            self._one(f, s)

    def _one(self, f: Function, s: ast.stmt) -> None:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
            self._function(f"{f.name}.{s.name}" if f.name != "<module>" else s.name, s, s.body, None, f.name != "<module>")
            if f.name != "<module>" and not s.decorator_list:
                value = {"paths": [f"<fn@{s.lineno}:{s.col_offset + 1}>"], "calls": []}
                f.blocks[f.here()].append({"kind": "assign", "line": s.lineno, "col": s.col_offset + 1, "text": f"def {s.name}", "assigns": [{"target": s.name, "strong": True, **value}], "calls": [], "ret": None, "cond": None})
        elif isinstance(s, ast.ClassDef):
            self._class(f, s, "" if f.name == "<module>" else f"{f.name}.")
        elif isinstance(s, ast.If):
            yes, no, after = f.block(), f.block(), f.block()
            self._cond(f, s.test, yes, no)
            for start, part in ((yes, s.body), (no, s.orelse)):
                f.at = start
                self._body(f, part)
                f.edge(f.at, after, "normal")
            f.at = after if any(b == after for _, b, _ in f.edges) else None
        elif isinstance(s, ast.While | ast.For | ast.AsyncFor):
            head, inside, after = f.block(), f.block(), f.block()
            f.edge(f.here(), head, "normal")
            otherwise = f.block() if s.orelse else after
            f.at = head
            if isinstance(s, ast.While):
                always = isinstance(s.test, ast.Constant) and s.test.value
                if always:
                    f.blocks[head].append(self._stmt(f, s.test, "branch"))
                    f.edge(head, inside, "true")
                else:
                    self._cond(f, s.test, inside, otherwise)
            else:
                header = self._stmt(f, s.iter, "branch", targets=[(n, True, None) for n in self._names(s.target)])
                f.blocks[head].append(header)
                f.edge(head, inside, "true")
                f.edge(head, otherwise, "false")
            f.loops.append((head, after, len(f.finals)))
            f.at = inside
            self._body(f, s.body)
            f.edge(f.at, head, "back")
            f.loops.pop()
            if s.orelse:
                f.at = otherwise
                self._body(f, s.orelse)
                f.edge(f.at, after, "normal")
            f.at = after if any(b == after for _, b, _ in f.edges) else None
        elif isinstance(s, ast.Try | ast.TryStar):
            self._try(f, s)
        elif isinstance(s, ast.With | ast.AsyncWith):
            for item in s.items:
                targets = [(n, True, None) for n in self._names(item.optional_vars)] if item.optional_vars else []
                f.blocks[f.here()].append(self._stmt(f, item.context_expr, "other", targets=targets))
            self._body(f, s.body)
        elif isinstance(s, ast.Match):
            self._match(f, s)
        elif isinstance(s, ast.Return):
            f.blocks[f.here()].append(self._stmt(f, s.value, "other", at=s, ret=s.value))
            self._leave(f, 0)
            f.edge(f.at, 1, "return")
            f.at = None
        elif isinstance(s, ast.Raise):
            f.blocks[f.here()].append(self._stmt(f, s.exc, "other", at=s))
            for h in f.handlers[-1] if f.handlers and f.handlers[-1] else [1]:
                f.edge(f.at, h, "exception")
            f.at = None
        elif isinstance(s, ast.Break | ast.Continue):
            f.blocks[f.here()].append(self._stmt(f, None, "other", at=s))
            if f.loops:
                head, after, finals = f.loops[-1]
                self._leave(f, finals)
                f.edge(f.at, after if isinstance(s, ast.Break) else head, "break" if isinstance(s, ast.Break) else "continue")
                f.at = None
        elif isinstance(s, ast.Assign):
            f.blocks[f.here()].append(self._stmt(f, s.value, "other", at=s, targets=self._targets(s.targets, s.value)))
        elif isinstance(s, ast.AugAssign):
            f.blocks[f.here()].append(self._stmt(f, s.value, "other", at=s, targets=[(n, False, None) for n in self._names(s.target)]))
        elif isinstance(s, ast.AnnAssign):
            if isinstance(s.target, ast.Name | ast.Attribute) and (t := type_name(s.annotation)):
                f.types[path_of(s.target) or ""] = t
            if s.value is not None:
                f.blocks[f.here()].append(self._stmt(f, s.value, "other", at=s, targets=self._targets([s.target], s.value)))
        elif not isinstance(s, ast.Import | ast.ImportFrom):
            value = s.value if isinstance(s, ast.Expr) else s.test if isinstance(s, ast.Assert) else None
            if not (isinstance(value, ast.Constant) and isinstance(s, ast.Expr)):
                f.blocks[f.here()].append(self._stmt(f, value, "other", at=s))

    def _try(self, f: Function, s: ast.Try) -> None:
        before, after = f.here(), f.block()
        handlers = [f.block() for _ in s.handlers]
        for h in handlers:
            f.edge(before, h, "exception")
        if s.finalbody:
            f.finals.append(s.finalbody)
        f.handlers.append(handlers)
        f.at = f.block()
        f.edge(before, f.at, "normal")
        self._body(f, s.body)
        f.handlers.pop()
        self._body(f, s.orelse)
        ends = [f.at]
        for h, part in zip(handlers, s.handlers, strict=True):
            f.at = h
            if part.type is not None:
                f.blocks[h].append(self._stmt(f, part.type, "other", targets=[(part.name, True, {"paths": [], "calls": []})] if part.name else []))
            self._body(f, part.body)
            ends.append(f.at)
        if s.finalbody:
            f.finals.pop()
        for end in ends:  # the finally body is copied for every way out
            f.at = end
            if end is not None and s.finalbody:
                self._body(f, s.finalbody)
            f.edge(f.at, after, "normal")
        f.at = after if any(b == after for _, b, _ in f.edges) else None

    def _match(self, f: Function, s: ast.Match) -> None:
        subject = self._stmt(f, s.subject, "branch")
        f.blocks[f.here()].append(subject)
        now, after, default = f.at, f.block(), False
        for case in s.cases:
            inside, following = f.block(), f.block()
            bound = [n.name for n in ast.walk(case.pattern) if isinstance(n, ast.MatchAs | ast.MatchStar) and n.name]
            default = isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None and case.guard is None
            f.edge(now, inside, "true")
            if not default:
                f.edge(now, following, "false")
            f.at = inside
            if bound:
                f.blocks[inside].append(self._stmt(f, s.subject, "other", at=s.subject, targets=[(n, True, None) for n in bound]))
            if case.guard is not None:
                body = f.block()
                self._cond(f, case.guard, body, following)
                f.at = body
            self._body(f, case.body)
            f.edge(f.at, after, "normal")
            now = following
            if default:
                break
        if not default:
            f.edge(now, after, "false")
        f.at = after if any(b == after for _, b, _ in f.edges) else None


def lowered(path: str, text: str | None) -> tuple[list[dict], list[dict], list[dict], list[dict], str | None]:
    """Functions, imports, declarations, tree nodes and the error of a file, which is rejected whole."""
    try:
        m = Lowering(path, text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [], [], [], [], f"{type(e).__name__}: {e}"
    return m.functions, m.imports, m.decls, m.nodes, None
