"""Symbols and tree metrics of Python sources, by the interpreter's own parser.

Other languages' grammars aren't at hand; for them the lexical operators
(comments, literals, identifiers by pattern) apply.  A source that doesn't
parse gives one error row.
"""

from __future__ import annotations

import ast
import sys

import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = pa.schema([("file_id", pa.string()), ("ord", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("alias", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("depth", pa.int64()), ("params", pa.list_(pa.string())), ("args", pa.list_(pa.string())), ("value", pa.float64())])
SYMBOLS_DDL = "file_id string, ord long, kind string, name string, alias string, line long, end_line long, depth long, params array<string>, args array<string>, value double"
DEPTH = 1000


def chain(node: ast.AST) -> str | None:
    """The dotted name of a static chain; constant string subscripts count as members."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
        elif isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            parts.append(node.slice.value)
        elif isinstance(node, ast.Name):
            return ".".join([node.id, *reversed(parts)])
        else:
            return None
        node = node.value


def shape(node: ast.AST) -> str:
    if isinstance(node, ast.Constant):
        return "null" if node.value is None else "bool" if isinstance(node.value, bool) else "string" if isinstance(node.value, (str, bytes)) else "number"
    for kinds, name in (((ast.Name,), "identifier"), ((ast.Dict,), "object"), ((ast.List, ast.Tuple, ast.Set), "array"), ((ast.Lambda,), "function"), ((ast.Call,), "call"), ((ast.JoinedStr,), "template")):
        if isinstance(node, kinds):
            return name
    return "expression"


def _imported(node: ast.Import | ast.ImportFrom) -> list[dict]:
    base = "." * node.level + (node.module or "") if isinstance(node, ast.ImportFrom) else ""
    return [{"kind": "import", "name": a.name if not base else f"{base}{'' if base.endswith('.') else '.'}{a.name}", "alias": a.asname, "line": node.lineno} for a in node.names]


def _defined(node: ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda, inside: int) -> dict:
    args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]
    return {"kind": "function", "name": getattr(node, "name", None), "line": node.lineno, "end_line": node.end_lineno, "depth": inside, "params": [a.arg for a in args]}


#: Kinds that `definitions` finds.
DEFINITIONS = frozenset(("import", "function"))


def definitions(text: str, kinds: frozenset) -> list[dict]:
    """Of a source's symbols the imports and functions alone, in their order; expressions are gone through for functions only."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[dict] = []
    functions = "function" in kinds
    todo = [(tree, 1, 0)]
    while todo:
        node, depth, inside = todo.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out += _imported(node) if "import" in kinds else []
            continue
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            if functions:
                out.append(_defined(node, inside))
            inside += 1
        elif isinstance(node, ast.expr) and not functions:
            continue
        if depth < DEPTH:
            todo += [(c, depth + 1, inside) for c in reversed(list(ast.iter_child_nodes(node)))]
    return out


def symbols_of(text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"kind": "error", "name": f"source-parse: {e}"[:300]}]
    out: list[dict] = []
    nodes = deepest = xors = loops = same = 0
    returns = constant = functions = 0
    todo = [(tree, 1, 0)]
    while todo:
        node, depth, inside = todo.pop()
        nodes, deepest = nodes + 1, max(deepest, depth)
        line = getattr(node, "lineno", None)
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out += _imported(node)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            out.append(_defined(node, inside))
            functions, inside = functions + 1, inside + 1
            body = node.body[-1] if isinstance(node.body, list) else ast.Return(node.body)
            if isinstance(body, ast.Return) and isinstance(body.value, ast.Constant):
                returns += isinstance(body.value.value, str)
                constant += not out[-1]["params"]
        elif isinstance(node, ast.ClassDef):
            out.append({"kind": "class", "name": node.name, "line": line, "end_line": node.end_lineno})
        elif isinstance(node, ast.Call):
            out.append({"kind": "call", "name": chain(node.func), "line": line, "args": [shape(a) for a in node.args]})
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if chain(target):
                    out.append({"kind": "bind", "name": chain(target), "line": line})
        elif isinstance(node, (ast.Attribute, ast.Subscript)) and chain(node):
            out.append({"kind": "member", "name": chain(node), "line": line})
        elif isinstance(node, ast.Name):
            out.append({"kind": "identifier", "name": node.id, "line": line})
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            out.append({"kind": "literal", "name": node.value, "line": line})
        elif isinstance(node, ast.While):
            loops += isinstance(node.test, ast.Constant) and bool(node.test.value)
        elif isinstance(node, ast.BinOp):
            xors += isinstance(node.op, ast.BitXor)
        elif isinstance(node, ast.Compare) and len(node.ops) == 1:
            same += not isinstance(node.ops[0], ast.NotEq) and ast.dump(node.left) == ast.dump(node.comparators[0])
        if depth < DEPTH:
            todo += [(c, depth + 1, inside) for c in reversed(list(ast.iter_child_nodes(node)))]
    metrics = {"node_count": nodes, "max_depth": deepest, "op.xor": xors, "infinite_loop_count": loops, "self_compare_count": same, "string_return_function_count": returns, "const_return_function_count": constant, "function_count": functions}
    return out + [{"kind": "metric", "name": f"ast.{k}", "value": float(v)} for k, v in metrics.items() if v]


#: Sources whose symbols are given out at once.
TOGETHER = 256


def symbols(sources: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """sources: (file_id, text) of Python to rows of imports, functions, classes, calls, binds, members, identifiers, literals and metrics.

    With `kinds`, only such rows, numbered among themselves if they are imports and functions.
    """
    few = kinds is not None and DEFINITIONS.issuperset(kinds)

    def found(text: str) -> list[tuple[int, dict]]:
        own = enumerate(definitions(text, frozenset(kinds)) if few else symbols_of(text))
        return [(k, x) for k, x in own if kinds is None or x["kind"] in kinds]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                ids, texts = (batch.column(c).slice(lo, TOGETHER).to_pylist() for c in ("file_id", "text"))
                rows = [(f, k, x) for f, text in zip(ids, texts, strict=True) for k, x in found(text or "")]
                columns = [[r[0] for r in rows], [r[1] for r in rows], *([r[2].get(c) for r in rows] for c in SYMBOLS.names[2:])]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, SYMBOLS, strict=True)], schema=SYMBOLS)

    return sources.select("file_id", "text").mapInArrow(run, SYMBOLS_DDL)


def stdlib() -> list[str]:
    return sorted(sys.stdlib_module_names)
