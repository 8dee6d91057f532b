"""Structure of Python source: one Arrow pass parses each file once and returns everything that is derived from its tree.

A file that does not parse keeps its row, with ``parse_error`` set and empty arrays.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brindle import schemas

#: Files whose structure a worker holds at once.
FILES = 256

Def = ast.FunctionDef | ast.AsyncFunctionDef


def _text(node: ast.AST | None) -> str | None:
    if node is None:
        return None
    if isinstance(node, ast.Name):  # names and numbers are most of what is shown
        return node.id
    return repr(node.value) if isinstance(node, ast.Constant) and type(node.value) in (int, bool, type(None)) else ast.unparse(node)


def _dotted(node: ast.AST) -> str | None:
    """``a.b.c`` for attributes that hang off a plain name; None for any other callee."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _parameters(args: ast.arguments) -> list[dict]:
    plain = [(a, "positional_only") for a in args.posonlyargs] + [(a, "positional_or_keyword") for a in args.args]
    gap = len(plain) - len(args.defaults)
    out = [(a, kind, args.defaults[i - gap] if i >= gap else None) for i, (a, kind) in enumerate(plain)]
    if args.vararg:
        out.append((args.vararg, "var_positional", None))
    out += [(a, "keyword_only", d) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    if args.kwarg:
        out.append((args.kwarg, "var_keyword", None))
    return [{"name": a.arg, "kind": kind, "annotation": _text(a.annotation), "default": _text(d)} for a, kind, d in out]


def signature(node: ast.AST, bases: str = "names") -> str:
    """The one-line signature that symbol diffs compare: parameter names without annotations, defaults or positional-only ones."""
    if isinstance(node, ast.ClassDef):
        listed = [_text(b) if bases == "source" else _dotted(b) or "Unknown" for b in node.bases]
        return f"class {node.name}" + (f"({', '.join(listed)})" if listed else "")
    a = node.args
    names = [x.arg for x in a.args] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
    return f"def {node.name}({', '.join(names)})"


def complexity(node: ast.AST) -> int:
    """1, and 1 for each if, while, for and except, and one less than the operands of each boolean operation."""
    return _complexity(list(ast.walk(node)))


def _complexity(nodes: list[ast.AST]) -> int:
    branches = sum(isinstance(n, (ast.If, ast.While, ast.For, ast.ExceptHandler)) for n in nodes)
    return 1 + branches + sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))


class _Walk(ast.NodeVisitor):
    """Functions, classes and imports of a module. A call belongs to the innermost function around it; in a class body to none."""

    def __init__(self, lines: list[str]):
        self.lines, self.functions, self.classes, self.imports = lines, [], [], []
        self.owner: list[str | None] = []  # the enclosing class, or None for a function
        self.calls: list[list[dict]] = []

    def slice(self, node: ast.AST) -> str:
        return "\n".join(self.lines[node.lineno - 1 : node.end_lineno])

    def function(self, node: Def) -> None:
        nested = None in self.owner
        self.calls.append([])
        self.owner.append(None)
        self.generic_visit(node)
        self.owner.pop()
        held = self.owner[-1] if self.owner else None
        self.functions.append(
            {
                "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "is_async": isinstance(node, ast.AsyncFunctionDef), "is_nested": nested, "class_name": held,
                "parameters": _parameters(node.args), "return_annotation": _text(node.returns), "signature": signature(node), "docstring": ast.get_docstring(node),
                "content": self.slice(node), "calls": self.calls.pop(),
            }
        )

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.calls.append([])  # calls of the class body belong to no function
        self.owner.append(node.name)
        self.generic_visit(node)
        self.owner.pop()
        self.calls.pop()
        methods = [n.name for n in node.body if isinstance(n, Def)]
        self.classes.append({"name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "bases": [_text(b) for b in node.bases], "methods": methods, "docstring": ast.get_docstring(node), "content": self.slice(node)})

    def visit_Import(self, node: ast.Import) -> None:
        self.imports += [{"type": "import", "lineno": node.lineno, "module": a.name, "name": None, "alias": a.asname, "level": 0} for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.imports += [{"type": "from_import", "lineno": node.lineno, "module": node.module, "name": a.name, "alias": a.asname, "level": node.level} for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        if self.calls and (name := _dotted(node.func)):
            self.calls[-1].append({"name": name, "lineno": node.lineno})
        self.generic_visit(node)


def _symbols(tree: ast.Module) -> list[dict]:
    """Functions, nested ones as well, and classes without their methods; of one name the last counts."""
    out: dict[str, dict] = {}

    def visit(node: ast.AST) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (*Def.__args__, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                out[n.name] = {"name": n.name, "symbol_type": kind, "start_line": n.lineno, "end_line": n.end_lineno, "signature": signature(n), "docstring": ast.get_docstring(n)}
            if not isinstance(n, ast.ClassDef):
                visit(n)

    visit(tree)
    return list(out.values())


def _deep(tree: ast.Module) -> list[dict]:
    imports = []
    for n in tree.body:
        if isinstance(n, ast.Import):
            imports += [{"module_name": a.name, "symbol_name": None, "alias": a.asname, "import_type": "direct"} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports += [{"module_name": n.module or "", "symbol_name": a.name, "alias": a.asname, "import_type": "relative" if n.level else "from"} for a in n.names]

    def called(nodes: list[ast.AST]) -> list[dict]:
        out = []
        for c in (n for n in nodes if isinstance(n, ast.Call)):
            if isinstance(c.func, (ast.Name, ast.Attribute)):
                method = isinstance(c.func, ast.Attribute)
                out.append({"function_name": c.func.attr if method else c.func.id, "arguments": [_text(a) for a in c.args], "is_method_call": method, "object_name": _text(c.func.value) if method else None})
        return out

    def one(n: ast.AST) -> dict:
        nodes = list(ast.walk(n))
        row = {
            "symbol_name": n.name, "symbol_type": "class", "start_line": n.lineno, "end_line": n.end_lineno, "signature": signature(n, "source"), "docstring": ast.get_docstring(n),
            "decorators": [_text(d) for d in n.decorator_list], "parameters": [], "return_type": None, "base_classes": [], "methods": [], "imports_used": imports,
            "functions_called": called(nodes), "cyclomatic_complexity": _complexity(nodes), "lines_of_code": n.end_lineno - n.lineno + 1,
        }
        if isinstance(n, ast.ClassDef):
            return row | {"base_classes": [_text(b) for b in n.bases], "methods": [m.name for m in n.body if isinstance(m, Def)]}
        mark = {"var_positional": "*", "var_keyword": "**"}
        listed = [{"name": mark.get(p["kind"], "") + p["name"], "annotation": p["annotation"], "default_value": p["default"]} for p in _parameters(n.args) if p["kind"] != "positional_only"]
        return row | {"symbol_type": "function", "parameters": listed, "return_type": _text(n.returns)}

    last = {(isinstance(n, ast.ClassDef), n.name): n for n in ast.walk(tree) if isinstance(n, (*Def.__args__, ast.ClassDef))}
    return [one(n) for n in last.values()]


def extracted(path: str, content: str | None) -> dict:
    """The row of one file."""
    empty = {"path": path, "parse_error": None, "functions": [], "classes": [], "imports": [], "symbols": [], "deep": []}
    try:
        tree = ast.parse(content or "")
        walk = _Walk((content or "").split("\n"))
        walk.visit(tree)
        return empty | {"functions": walk.functions, "classes": walk.classes, "imports": walk.imports, "symbols": _symbols(tree), "deep": _deep(tree)}
    except (SyntaxError, ValueError, RecursionError) as e:
        return empty | {"parse_error": f"{type(e).__name__}: {e}"}


def extract(files: DataFrame) -> DataFrame:
    """One row of nested structure for each file of (path, content): functions, classes, imports, diff symbols, deep symbols.

    Structure leaves a task ``FILES`` files at a time, so that a worker never holds that of a whole batch.
    """
    schema = to_arrow_schema(StructType.fromDDL(schemas.EXTRACTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, FILES):
                some = batch.slice(i, FILES).to_pydict()
                yield pa.RecordBatch.from_pylist([extracted(p, c) for p, c in zip(some["path"], some["content"])], schema=schema)

    return files.select("path", "content").mapInArrow(run, schemas.EXTRACTED)


def features(content: str | None) -> dict:
    """Structural features of a piece of code: calls by last name, imports, most frequent kind of return, exception use, parameters of the first function."""
    try:
        nodes = list(ast.walk(ast.parse(content or "")))
    except (SyntaxError, ValueError, RecursionError):
        return {"parseable": False, "calls": [], "imports": [], "return_style": "unknown", "has_try_except": False, "raises": False, "parameter_count": 0}
    calls = {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}
    modules = {a.name for n in nodes if isinstance(n, ast.Import) for a in n.names} | {n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module}
    named = {ast.Dict: "dict", ast.Call: "call", type(None): "none"}
    styles = Counter(type(v.value).__name__ if isinstance(v := n.value, ast.Constant) else named.get(type(v), type(v).__name__) for n in nodes if isinstance(n, ast.Return))
    # the first function with parameters counts, in breadth-first order
    counts = [len(n.args.args) for n in nodes if isinstance(n, Def) and n.args.args]
    return {
        "parseable": True, "calls": sorted(calls), "imports": sorted(modules), "return_style": styles.most_common(1)[0][0] if styles else "none",
        "has_try_except": any(isinstance(n, ast.Try) for n in nodes), "raises": any(isinstance(n, ast.Raise) for n in nodes), "parameter_count": counts[0] if counts else 0,
    }


def structural_features(content: Column) -> Column:
    """``features`` of a column of code; each different piece of a batch is parsed once."""

    @F.pandas_udf(schemas.FEATURES)
    def run(code: pd.Series) -> pd.DataFrame:
        known = {c: features(c) for c in code.unique()}
        return pd.DataFrame([known[c] for c in code], columns=["parseable", "calls", "imports", "return_style", "has_try_except", "raises", "parameter_count"])

    return run(content)


def syntax_error(content: Column) -> Column:
    """The message of the syntax error in a column of code, with its line; null where there is none."""

    @F.pandas_udf("string")
    def run(code: pd.Series) -> pd.Series:
        def one(c: str | None) -> str | None:
            try:
                ast.parse(c or "")
            except SyntaxError as e:
                return f"line {e.lineno}: {e.msg}"
            except ValueError as e:
                return str(e)
            return None

        return code.map(one)

    return run(content)
