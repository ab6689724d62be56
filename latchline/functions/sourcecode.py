"""Functions, calls, log texts and database habits in source files, one file at a time."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

# Query methods, SQL words and log methods.
QUERY_METHODS = ("filter", "get", "exclude", "all", "first", "last", "create", "update", "delete", "aggregate", "annotate", "values", "count", "exists")
SQL_WORD = re.compile(r"\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b", re.IGNORECASE)
LOG_METHODS = ("debug", "info", "warning", "warn", "error", "exception", "critical", "log", "print")
# How functions begin in languages other than Python.
DEFINITIONS = {
    "javascript": r"(?:^|\s)(?:async\s+)?function\s*\*?\s+(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>",
    "typescript": r"(?:^|\s)(?:async\s+)?function\s*\*?\s+(\w+)\s*[(<]|(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>",
    "java": r"(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;{]*\)\s*(?:throws [\w, ]+)?\{",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(",
    "c": r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{",
}
# What the last call of a model's query does, attributes every row has, and the mappers in order of preference.
OPERATIONS = {
    "all": "query", "filter": "query", "get": "query", "first": "query", "save": "query",
    "count": "count", "exists": "exists", "create": "insert", "update": "update", "delete": "delete",
}
WRITES = ("insert", "update", "delete")
OWN_ATTRIBUTES = ("pk", "id", "save", "delete")
PREFERRED = ("django", "sqlalchemy", "prisma", "typeorm", "raw_sql")
# Traces of database libraries in sources of both kinds.
PYTHON_LIBRARIES = (
    ("django", r"^\s*(?:from|import)\s+django(?:\.db)?\b"),
    ("sqlalchemy", r"^\s*(?:from|import)\s+sqlalchemy\b"),
    ("prisma", r"^\s*from\s+prisma\b"),
    ("raw_sql", r"^\s*import\s+(?:psycopg2?|sqlite3|pymysql|MySQLdb)\b|\bcursor\.execute\b"),
)
SCRIPT_LIBRARIES = (
    ("prisma", r"@prisma/client|from\s+['\"]prisma['\"]|PrismaClient"),
    ("typeorm", r"typeorm"),
    ("raw_sql", r"cursor\.execute|pg\.query|client\.query\("),
)
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
NO_CALLS = frozenset("if for while switch catch return function func sizeof else async await".split())


@dataclass
class Found:
    functions: list[dict] = field(default_factory=list)
    logs: list[dict] = field(default_factory=list)
    findings: list[dict] = field(default_factory=list)
    operations: list[dict] = field(default_factory=list)


def _callee(node: ast.Call) -> str | None:
    f = node.func
    return f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None


def _chain(node: ast.AST) -> list[str]:
    """Method names of a call chain, outermost first."""
    out = []
    while True:
        if isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Attribute):
            out.append(node.attr)
            node = node.value
        else:
            return out


def _is_query(node: ast.AST) -> bool:
    names = _chain(node)
    return isinstance(node, ast.Call) and "objects" in names and any(n in QUERY_METHODS for n in names)


def _model(node: ast.AST) -> str | None:
    """The model of a query: the capitalised name right before ``objects``."""
    while isinstance(node, (ast.Call, ast.Attribute)):
        if isinstance(node, ast.Attribute) and node.attr == "objects":
            name = node.value.id if isinstance(node.value, ast.Name) else node.value.attr if isinstance(node.value, ast.Attribute) else ""
            return name if name[:1].isupper() else None
        node = node.func if isinstance(node, ast.Call) else node.value
    return None


def _is_atomic(node: ast.AST) -> bool:
    return any(isinstance(x, (ast.Attribute, ast.Name)) and (x.attr if isinstance(x, ast.Attribute) else x.id) in ("atomic", "begin") for x in ast.walk(node))


class _Visitor(ast.NodeVisitor):
    def __init__(self, text: str):
        self.lines, self.scope, self.loops, self.out = text.split("\n"), [], [], Found()
        self.calls: list[list[str]] = []
        self.safe_commit = 0
        self.strings: dict[str, ast.AST] = {}
        #: Tables written by each open function outside of a transaction, in order, and open transactions.
        self.writes: list[list[tuple[str, ast.AST]]] = [[]]
        self.atomic = 0

    def loop_row(self, node: ast.AST) -> ast.For | None:
        """The innermost loop over a query whose row ``node`` is."""
        loop = self.loops[-1] if self.loops else None
        mine = isinstance(loop, ast.For) and isinstance(loop.target, ast.Name) and isinstance(node, ast.Name) and node.id == loop.target.id
        return loop if mine and _is_query(loop.iter) else None

    def judge_writes(self) -> None:
        """Writes to several tables that no transaction holds together."""
        tables = {t for t, _ in self.writes[-1]}
        if len(tables) > 1:
            self.note("transaction_missing_atomic", "HIGH" if len(tables) > 2 else "MEDIUM", self.writes[-1][0][1])

    def visit_With(self, node) -> None:
        held = any(_is_atomic(i.context_expr) for i in node.items)
        self.atomic += held
        self.generic_visit(node)
        self.atomic -= held

    visit_AsyncWith = visit_With

    def visit_Attribute(self, node: ast.Attribute) -> None:
        loop = self.loop_row(node.value)
        if loop is not None and node.attr not in OWN_ATTRIBUTES and "select_related" not in _chain(loop.iter):
            self.note("orm_missing_select_related", "HIGH", node)
            self.note("n_plus_one", "MEDIUM", node)
        self.generic_visit(node)

    def note(self, category: str, severity: str, node: ast.AST) -> None:
        self.out.findings.append({"category": category, "severity": severity, "line_number": node.lineno, "code": self.lines[node.lineno - 1].strip()[:200]})

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        entry = {"function_name": node.name, "qualified_name": ".".join([*self.scope, node.name]), "line_number": node.lineno, "end_line_number": node.end_lineno}
        self.scope.append(node.name)
        self.calls.append([])
        loops, self.loops = self.loops, []
        held = any(_is_atomic(d) for d in node.decorator_list)
        self.writes.append([])
        self.atomic += held
        self.generic_visit(node)
        self.atomic -= held
        self.judge_writes()
        self.writes.pop()
        self.loops = loops
        self.scope.pop()
        entry["calls"] = list(dict.fromkeys(self.calls.pop()))
        self.out.functions.append(entry)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_For(self, node: ast.For) -> None:
        if _is_query(node.iter) and _chain(node.iter)[0] == "all" and any(isinstance(x, ast.If) for x in node.body):
            self.note("orm_all_no_filter", "HIGH", node.iter)
        self.visit(node.iter)
        self.loops.append(node)
        for x in [*node.body, *node.orelse]:
            self.visit(x)
        self.loops.pop()

    def visit_While(self, node: ast.While) -> None:
        self.loops.append(node)
        self.generic_visit(node)
        self.loops.pop()

    def visit_Try(self, node: ast.Try) -> None:
        undone = any(isinstance(x, ast.Call) and _callee(x) == "rollback" for h in [*node.handlers, *node.finalbody] for x in ast.walk(h))
        self.safe_commit += undone
        self.generic_visit(node)
        self.safe_commit -= undone

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.strings[t.id] = node.value
        self.generic_visit(node)

    def built_sql(self, node: ast.AST) -> bool:
        """Whether an expression puts SQL together from values."""
        if isinstance(node, ast.Name):
            known = self.strings.get(node.id)
            return known is not None and not isinstance(known, ast.Name) and self.built_sql(known)
        text = " ".join(x.value for x in ast.walk(node) if isinstance(x, ast.Constant) and isinstance(x.value, str))
        if not SQL_WORD.search(text):
            return False
        if isinstance(node, ast.JoinedStr):
            return any(isinstance(x, ast.FormattedValue) for x in node.values)
        if isinstance(node, ast.BinOp):
            return isinstance(node.op, (ast.Add, ast.Mod)) and any(not isinstance(x, ast.Constant) for x in (node.left, node.right))
        return isinstance(node, ast.Call) and _callee(node) in ("format", "text") and (_callee(node) == "format" or any(self.built_sql(a) for a in node.args))

    def visit_Call(self, node: ast.Call) -> None:
        name = _callee(node)
        if name:
            if self.calls:
                self.calls[-1].append(name)
            if name in LOG_METHODS and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                self.out.logs.append({"log_string": node.args[0].value, "line_number": node.lineno, "function_name": self.scope[-1] if self.scope else None, "log_level": name})
            if self.loops and _is_query(node):
                loop = self.loops[-1]
                broad = isinstance(loop, ast.For) and _is_query(loop.iter) and "all" in _chain(loop.iter)
                if name == "count":
                    self.note("orm_count_in_loop", "HIGH", node)
                else:
                    self.note("n_plus_one", "CRITICAL" if broad else "HIGH", node)
            if (table := _model(node)) and (kind := OPERATIONS.get(name)):
                chain = _chain(node)
                self.out.operations.append({"op_type": kind, "table_hint": table, "line_number": node.lineno, "end_line_number": node.end_lineno, "in_loop": bool(self.loops), "select_related": "select_related" in chain, "prefetch_related": "prefetch_related" in chain})
                if kind in WRITES and not self.atomic:
                    self.writes[-1].append((table, node))
            if name in ("all", "filter") and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Attribute):
                related = node.func.value
                loop = self.loop_row(related.value)
                if loop is not None and related.attr.endswith(("s", "_set")) and "prefetch_related" not in _chain(loop.iter):
                    self.note("orm_missing_prefetch_related", "HIGH", node)
            if name in ("execute", "executemany", "raw") and node.args and self.built_sql(node.args[0]):
                self.note("raw_sql_injection", "CRITICAL", node)
            if name == "commit":
                if self.loops:
                    self.note("transaction_commit_in_loop", "HIGH", node)
                elif not self.safe_commit:
                    self.note("transaction_no_rollback", "MEDIUM", node)
        self.generic_visit(node)


def read_source(text: str | None, language: str | None) -> Found:
    """Functions, log calls and findings of one file; a file that doesn't parse has none."""
    if not text:
        return Found()
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return Found()
        visitor = _Visitor(text)
        visitor.visit(tree)
        visitor.judge_writes()
        # Each finding once: a chain of calls on one line is one query.
        seen, kept = set(), []
        for f in visitor.out.findings:
            if (key := (f["category"], f["line_number"])) not in seen:
                seen.add(key)
                kept.append(f)
        visitor.out.findings = kept
        return visitor.out
    if language not in DEFINITIONS:
        return Found()
    out, lines = Found(), text.split("\n")
    starts = [(n, next(g for g in m.groups() if g)) for n, x in enumerate(lines, 1) for m in [re.search(DEFINITIONS[language], x)] if m]
    for k, (n, name) in enumerate(starts):
        end = starts[k + 1][0] - 1 if k + 1 < len(starts) else len(lines)
        calls = [c for x in lines[n - 1 : end] for c in CALL.findall(x) if c not in NO_CALLS and c != name]
        out.functions.append({"function_name": name, "qualified_name": name, "line_number": n, "end_line_number": end, "calls": list(dict.fromkeys(calls))})
    return out


def frameworks(text: str | None, language: str | None = "python") -> list[str]:
    """Database libraries a Python, JavaScript or TypeScript file uses, the preferred first; other languages have none."""
    rules = {"python": PYTHON_LIBRARIES, "javascript": SCRIPT_LIBRARIES, "typescript": SCRIPT_LIBRARIES}.get(language or "", ())
    return sorted((name for name, rule in rules if re.search(rule, text or "", re.MULTILINE)), key=PREFERRED.index)
