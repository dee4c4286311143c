"""Classes, functions and methods of Python files, by the standard library's syntax tree."""

from __future__ import annotations

import ast

from codequarry.parsers.base import Parser, Symbol, first_seen

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class PythonParser(Parser):
    """Raises SyntaxError where the file doesn't parse; the caller then takes the whole file."""

    languages = ("python",)

    def parse(self, text: str, path: str) -> list[Symbol]:
        tree = ast.parse(text)
        self.text, self.lines = text, text.split("\n")
        self.imports = [name for node in ast.walk(tree) for name in self._imported(node)] or None
        out: list[Symbol] = []
        self._visit(tree.body, None, out)
        return out

    @staticmethod
    def _imported(node: ast.AST) -> list[str]:
        if isinstance(node, ast.Import):
            return [a.name for a in node.names if not a.asname]
        if isinstance(node, ast.ImportFrom):
            return [node.module or (node.names[0].name if node.names else "")]
        return []

    def _visit(self, body: list[ast.stmt], parent: str | None, out: list[Symbol]) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                if self._shown(node.name):
                    out.append(self._symbol("class", node, self._class_signature(node), None, imports=self.imports))
                self._visit(node.body, node.name, out)
            elif isinstance(node, _FUNCTIONS):
                if not self._shown(node.name):
                    continue
                calls = first_seen(self._calls(node)) or None
                if parent:
                    out.append(self._symbol("method", node, f"{parent}.{self._signature(node)}", parent, calls=calls))
                else:
                    out.append(self._symbol("function", node, self._signature(node), None, imports=self.imports, calls=calls))
            else:
                # definitions under if, try or with at this level belong to it
                for field in ("body", "orelse", "finalbody"):
                    self._visit(getattr(node, field, None) or [], parent, out) if not isinstance(getattr(node, field, None), ast.AST) else None
                for handler in getattr(node, "handlers", []):
                    self._visit(handler.body, parent, out)

    @staticmethod
    def _shown(name: str) -> bool:
        return not name.startswith("_") or name.startswith("__")

    def _source(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.text, node) or ""

    def _symbol(self, kind: str, node, signature: str, parent: str | None, **rest) -> Symbol:
        doc = None
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            doc = self._source(first.value)
        return Symbol(kind, node.name, node.lineno, node.end_lineno, self._source(node), signature, doc, parent, **rest)

    def _class_signature(self, node: ast.ClassDef) -> str:
        listed = [ast.unparse(b) for b in node.bases] + [f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords]
        return f"class {node.name} ({', '.join(listed)}):" if listed else f"class {node.name}:"

    def _signature(self, node) -> str:
        head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        result = f" -> {self._source(node.returns)}" if node.returns else ""
        decorators = "".join(f"@{self._source(d)} " for d in node.decorator_list)
        return f"{decorators}{head} {node.name} ({ast.unparse(node.args)}){result}:"

    @staticmethod
    def _calls(node) -> list[str]:
        """The called names: of an attribute call, the attribute."""
        found = sorted((n for n in ast.walk(node) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset))
        return [n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in found if isinstance(n.func, (ast.Name, ast.Attribute))]
