"""Python sources through the standard library's syntax tree."""

from __future__ import annotations

import ast
import builtins
import textwrap

from codeloom.sources.extract import Dependency, Symbol, qualified

BUILTINS = frozenset(dir(builtins))
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Decorators that become modifiers by themselves.
KNOWN_DECORATORS = ("property", "staticmethod", "classmethod", "abstractmethod")
EXCEPTION_BASES = ("Exception", "BaseException")
ENUM_BASES = ("Enum", "IntEnum", "StrEnum", "Flag")


def _doc(node) -> str | None:
    text = ast.get_docstring(node, clean=False)
    return textwrap.dedent(text).strip() if text else None


def _function_modifiers(node) -> list[str]:
    out = ["async"] if isinstance(node, ast.AsyncFunctionDef) else []
    if any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node)):
        out.append("generator")
    for d in node.decorator_list:
        text = ast.unparse(d)
        out.append(text.rpartition(".")[2] if text.rpartition(".")[2] in KNOWN_DECORATORS else text)
    if node.name.startswith("__") and node.name.endswith("__"):
        out.append("dunder")
    elif node.name.startswith("_"):
        out.append("private")
    a = node.args
    if any(x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]):
        out.append("typed")
    if node.returns:
        out.append("return_typed")
    return out


def _class_modifiers(node: ast.ClassDef) -> list[str]:
    bases = [ast.unparse(b) for b in node.bases]
    last = [b.rpartition(".")[2] for b in bases]
    out = [f"inherits:{b}" for b in bases]
    if any(b in EXCEPTION_BASES or b.endswith(("Error", "Exception")) for b in last):
        out.append("exception_class")
    if any(b in ("ABC", "ABCMeta") for b in last):
        out.append("abstract_base")
    if any(b in ENUM_BASES for b in last):
        out.append("enum_class")
    if len(bases) > 1:
        out.append("multiple_inheritance")
    if any(ast.unparse(d).rpartition(".")[2].startswith("dataclass") for d in node.decorator_list):
        out.append("dataclass")
    if node.name.startswith("_"):
        out.append("private_class")
    return out


class _Walk(ast.NodeVisitor):
    """One pass that keeps the scope and whether a branch encloses the node."""

    def __init__(self):
        self.symbols: list[Symbol] = []
        self.found: list[Dependency] = []
        self.scope: list[tuple[str, str]] = []
        self.branches = 0

    def here(self) -> str:
        return "::".join(n for n, _ in self.scope)

    def symbol(self, node, name: str, kind: str, **more) -> None:
        self.symbols.append(Symbol(name, kind, node.lineno - 1, node.col_offset, node.end_lineno - 1, node.end_col_offset, tuple(self.scope), **more))

    def depend(self, node, target: str, kind: str, source: str | None = None) -> None:
        if target and "\n" not in target:
            self.found.append(Dependency(self.here() if source is None else source, target, kind, node.lineno - 1, node.col_offset, self.branches > 0))

    def names(self, node):
        return [] if node is None else [x for x in ast.walk(node) if isinstance(x, ast.Name) and x.id not in BUILTINS]

    def inside(self, nodes, branch: bool = False) -> None:
        self.branches += branch
        for x in nodes:
            self.visit(x)
        self.branches -= branch

    def enter(self, node, kind: str) -> None:
        self.scope.append((node.name, kind))
        outer, self.branches = self.branches, 0
        self.inside(node.body)
        self.branches = outer
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        signature = f"def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        self.symbol(node, node.name, "Function", modifiers=_function_modifiers(node), signature=signature, documentation=_doc(node))
        own = qualified(node.name, self.scope)
        for d in node.decorator_list:
            self.depend(d, ast.unparse(d), "Uses", own)
        self.enter(node, "Function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self.symbol(node, node.name, "Class", modifiers=_class_modifiers(node), documentation=_doc(node), signature=f"class {node.name}")
        own = qualified(node.name, self.scope)
        for b in node.bases:
            self.depend(b, ast.unparse(b), "Inherits", own)
        for d in node.decorator_list:
            self.depend(d, ast.unparse(d), "Uses", own)
        self.enter(node, "Class")

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.symbol(node, a.name, "Import", modifiers=["import"])
            self.depend(node, a.name, "Imports")

    def visit_ImportFrom(self, node) -> None:
        module = "." * node.level + (node.module or "")
        self.depend(node, module, "ModuleDependency")
        for a in node.names:
            self.symbol(node, a.name, "Import", modifiers=["from_import"], signature=f"from {module} import {a.name}")
            self.depend(node, a.name, "Imports")

    def _assign(self, node, targets, value) -> None:
        for t in targets:
            if isinstance(t, ast.Name):
                constant = all(c.isupper() or c == "_" for c in t.id)
                self.symbol(node, t.id, "Constant" if constant else "Variable")
            for x in self.names(value):
                self.depend(x, x.id, "DataFlow", ast.unparse(t))
        if value is not None:
            self.visit(value)

    def visit_Assign(self, node) -> None:
        self._assign(node, node.targets, node.value)

    def visit_AnnAssign(self, node) -> None:
        self._assign(node, [node.target], node.value)

    def visit_Call(self, node) -> None:
        self.depend(node, ast.unparse(node.func), "Calls")
        for x in [*node.args, *(k.value for k in node.keywords)]:
            for n in self.names(x):
                self.depend(n, n.id, "References")
            self.visit(x)
        if not isinstance(node.func, ast.Name):
            self.visit(node.func)

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, ast.Load) and node.id not in BUILTINS:
            self.depend(node, node.id, "References")

    def visit_If(self, node) -> None:
        for x in self.names(node.test):
            self.depend(x, x.id, "ControlFlow")
        self.depend(node, "if_block", "ConditionalExecution")
        self.visit(node.test)
        self.inside([*node.body, *node.orelse], branch=True)

    def visit_For(self, node) -> None:
        for x in ast.walk(node.target):
            if isinstance(x, ast.Name):
                self.depend(x, x.id, "LoopIteration")
        for x in self.names(node.iter):
            self.depend(x, x.id, "ControlFlow")
        self.visit(node.iter)
        self.inside([*node.body, *node.orelse])

    visit_AsyncFor = visit_For

    def visit_While(self, node) -> None:
        for x in self.names(node.test):
            self.depend(x, x.id, "ControlFlow")
        self.inside([node.test, *node.body, *node.orelse])

    def visit_Try(self, node) -> None:
        self.depend(node, "try_block", "ExceptionHandling")
        for h in node.handlers:
            if h.type is not None:
                self.depend(h, ast.unparse(h.type), "ExceptionHandling")
            if h.name:
                self.depend(h, h.name, "ExceptionHandling")
        if node.finalbody:
            self.depend(node, "finally_block", "ExceptionHandling")
        self.inside([*node.body, *(x for h in node.handlers for x in h.body), *node.orelse, *node.finalbody])

    def visit_Return(self, node) -> None:
        for x in self.names(node.value):
            self.depend(x, x.id, "DataFlow")
        self.depend(node, "return_value", "ReturnFlow")
        if node.value is not None:
            self.visit(node.value)

    def visit_Break(self, node) -> None:
        self.depend(node, "break", "BreakContinue")

    def visit_Continue(self, node) -> None:
        self.depend(node, "continue", "BreakContinue")


def extract(content: str) -> tuple[list[Symbol], list[Dependency]]:
    """Symbols and dependencies; none if the text isn't valid Python."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    walk = _Walk()
    walk.visit(tree)
    return walk.symbols, walk.found


def control_flow(content: str) -> list[tuple[str, str, str]]:
    """(function, node, edge kind) of branches, loops, handlers, returns and jumps in each function."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str, str]] = []
    kinds = {ast.If: ("if", "Conditional"), ast.For: ("loop", "Loop"), ast.While: ("loop", "Loop"), ast.Match: ("match", "Switch"), ast.Try: ("try", "Exception"), ast.Return: ("return", "Termination"), ast.Break: ("break", "Break"), ast.Continue: ("continue", "Continue")}
    for f in (x for x in ast.walk(tree) if isinstance(x, FUNCTIONS)):
        for x in ast.walk(f):
            if type(x) in kinds:
                name, kind = kinds[type(x)]
                out.append((f.name, f"{name}@{x.lineno - 1}", kind))
                if isinstance(x, ast.If) and x.orelse:
                    out.append((f.name, f"else@{x.orelse[0].lineno - 1}", "Conditional"))
                if isinstance(x, ast.Match):
                    out += [(f.name, f"case@{c.pattern.lineno - 1}", "Switch") for c in x.cases]
                if isinstance(x, ast.Try):
                    out += [(f.name, f"catch@{h.lineno - 1}", "Exception") for h in x.handlers]
    return out
