"""Functions of source files, by the standard library's parser; one file in, a row a function out."""

from __future__ import annotations

import ast
import hashlib

from pyspark.sql import DataFrame

SCHEMA = "filepath string, name string, lineno int, end_lineno int, source string, ast_hash string, ast_tokens string, param_count int, has_return boolean, return_type string, class_name string, class_type string, calls_made array<string>, imports_used array<string>, decorators array<string>, visibility string, is_nested boolean, language string"


class _Plain(ast.NodeTransformer):
    """Names become v0, v1, ... in order of appearance, constants their kinds, docstrings go."""

    def __init__(self):
        self.names: dict[str, str] = {}

    def _name(self, x):
        return self.names.setdefault(x, f"v{len(self.names)}")

    def visit_Name(self, node):
        return ast.copy_location(ast.Name(self._name(node.id), node.ctx), node)

    def visit_arg(self, node):
        return ast.copy_location(ast.arg(self._name(node.arg), None), node)

    def visit_Constant(self, node):
        return ast.copy_location(ast.Constant(type(node.value).__name__), node)


def _called(node) -> str | None:
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def functions_of(path: str, source: str | None) -> list[dict]:
    """All functions and methods; none of a file that doesn't parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    lines = (source or "").split("\n")
    imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module})
    out = []

    def visit(node, cls, nested):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(row(child, cls, nested))
                visit(child, cls, True)
            elif isinstance(child, ast.ClassDef):
                visit(child, child, nested)
            else:
                visit(child, cls, nested)

    def row(f, cls, nested):
        body = [x for i, x in enumerate(f.body) if not (i == 0 and isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str))]
        bare = ast.fix_missing_locations(ast.FunctionDef("f", f.args, body or [ast.Pass()], [], None, None, type_params=[]))
        bare = ast.parse(ast.unparse(bare))
        tokens = ast.dump(_Plain().visit(bare), annotate_fields=False).replace("(", " ( ").replace(")", " ) ").replace(",", " ")
        tokens = " ".join(tokens.split())
        bases = {ast.unparse(b).split(".")[-1] for b in cls.bases} if cls else set()
        kind = None if cls is None else "protocol" if "Protocol" in bases else "abstract" if "ABC" in bases else "class"
        a = f.args
        params = [p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs] if p.arg not in ("self", "cls")]
        n = f.name
        return {
            "filepath": path, "name": n, "lineno": f.lineno, "end_lineno": f.end_lineno, "source": "\n".join(lines[f.lineno - 1 : f.end_lineno]),
            "ast_hash": hashlib.sha256(tokens.encode()).hexdigest()[:16], "ast_tokens": tokens, "param_count": len(params),
            "has_return": any(isinstance(x, ast.Return) and x.value is not None for x in ast.walk(f)), "return_type": ast.unparse(f.returns) if f.returns else None,
            "class_name": cls.name if cls else None, "class_type": kind, "calls_made": sorted({c for x in ast.walk(f) if isinstance(x, ast.Call) and (c := _called(x))}),
            "imports_used": imports, "decorators": [ast.unparse(d) for d in f.decorator_list],
            "visibility": "private" if n.startswith("_") and not (n.startswith("__") and n.endswith("__")) else "public", "is_nested": nested, "language": "python",
        }

    visit(tree, None, False)
    return out


def extracted(files: DataFrame, path: str = "filepath", content: str = "content") -> DataFrame:
    """files(path, content) -> functions."""

    def run(frames):
        import pandas as pd

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in frames:
            yield pd.DataFrame([r for p, s in zip(pdf[path], pdf[content], strict=True) for r in functions_of(p, s)], columns=columns)

    return files.select(path, content).mapInPandas(run, SCHEMA)
