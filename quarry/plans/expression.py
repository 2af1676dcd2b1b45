"""Expression trees over columns: enumeration, text forms, and compilation to Spark columns or NumPy.

Operations follow IEEE arithmetic; what is not finite in the end is null. Square roots are of max(x, 0), logarithms of
max(x, 1e-300), exponents are clipped to 700, and division by less than 1e-12 is undefined. Trees are walked without
recursion, so that depth is not bounded by the interpreter's stack.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.numeric import finite

UNARY, BINARY = ("neg", "abs", "sqrt", "log", "exp"), ("add", "sub", "mul", "div", "pow")
#: Bound of exponents, least divisor, least argument of a logarithm.
LIMIT, TINY, LEAST = 700.0, 1e-12, 1e-300
SIGNS = {"add": "+", "sub": "-", "mul": "*", "div": "/", "pow": "**"}


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple = ()
    value: float | str | None = None

    def size(self) -> int:
        return folded(self, lambda node, sizes: 1 + sum(sizes))

    def depth(self) -> int:
        return folded(self, lambda node, depths: 1 + max(depths, default=0))

    def __str__(self) -> str:
        return folded(self, lambda node, texts: f"{node.kind}({', '.join(texts)})" if texts else str(node.value))


def var(name: str) -> Node:
    return Node("var", value=name)


def const(x: float) -> Node:
    return Node("const", value=x)


def op(kind: str, *parts: Node) -> Node:
    return Node(kind, parts)


def folded(root: Node, combine: Callable):
    """combine(node, results of its parts), from the leaves up."""
    results: list = []
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if ready:
            n = len(node.parts)
            own = results[len(results) - n :]
            del results[len(results) - n :]
            results.append(combine(node, own))
        else:
            todo.append((node, True))
            todo += [(p, False) for p in reversed(node.parts)]
    return results[0]


def compiled(root: Node) -> Column:
    # nulls and NaN must pass: least and greatest would skip a null, and take NaN for the largest number
    def column(node: Node, parts: list[Column]) -> Column:
        if node.kind == "var":
            return F.col(f"`{node.value}`").cast("double")
        if node.kind == "const":
            return F.lit(float(node.value))
        a, b = parts[0], parts[-1]
        return {
            "neg": lambda: -a,
            "abs": lambda: F.abs(a),
            "sqrt": lambda: F.sqrt(F.when(a < 0, 0.0).otherwise(a)),
            "log": lambda: F.log(F.when(a < LEAST, LEAST).otherwise(a)),
            "exp": lambda: F.exp(F.when(F.isnan(a), a).when(a < -LIMIT, -LIMIT).when(a > LIMIT, LIMIT).otherwise(a)),
            "add": lambda: a + b,
            "sub": lambda: a - b,
            "mul": lambda: a * b,
            "div": lambda: F.when(F.abs(b) >= TINY, a / b),
            "pow": lambda: F.pow(a, b),
        }[node.kind]()

    out = folded(root, column)
    return F.when(F.abs(out) < float("inf"), out)  # NaN counts as larger than every number


def applied(node: Node, parts: list[np.ndarray], columns: dict[str, np.ndarray]) -> np.ndarray:
    """One operation on the values of its parts."""
    if node.kind == "var":
        return columns[node.value]
    if node.kind == "const":
        return np.float64(node.value)
    a, b = parts[0], parts[-1]
    return {
        "neg": lambda: -a,
        "abs": lambda: np.abs(a),
        "sqrt": lambda: np.sqrt(np.maximum(a, 0)),
        "log": lambda: np.log(np.maximum(a, LEAST)),
        "exp": lambda: np.exp(np.clip(a, -LIMIT, LIMIT)),
        "add": lambda: a + b,
        "sub": lambda: a - b,
        "mul": lambda: a * b,
        "div": lambda: np.where(np.abs(b) >= TINY, a / np.where(np.abs(b) >= TINY, b, 1), np.nan),
        "pow": lambda: np.power(a, b),
    }[node.kind]()


def evaluated(root: Node, columns: dict[str, np.ndarray]) -> np.ndarray:
    """Values over whole columns; NaN where undefined."""
    with np.errstate(all="ignore"):
        out = folded(root, lambda node, parts: applied(node, parts, columns))
        return out if np.ndim(out) else np.full(len(next(iter(columns.values()))), out)


def parsed(text: str) -> Node:
    """Prefix form: name, number or op(args)."""
    tokens = text.replace("(", " ( ").replace(")", " ) ").replace(",", " ").split()

    def read() -> Node:
        t = tokens.pop(0)
        if tokens and tokens[0] == "(":
            tokens.pop(0)
            parts = []
            while tokens[0] != ")":
                parts.append(read())
            tokens.pop(0)
            return op(t, *parts)
        try:
            return const(float(t))
        except ValueError:
            return var(t)

    return read()


def ratios(names: list[str]) -> list[Node]:
    return [op("div", var(a), var(b)) for a in names for b in names if a != b]


def products(names: list[str]) -> list[Node]:
    return [op("mul", var(a), var(b)) for i, a in enumerate(names) for b in names[i:]]


def product(nodes: list[Node]) -> Node:
    return reduce(lambda a, b: op("mul", a, b), nodes)


def infix(root: Node) -> str:
    """Text with signs between operands and every operation in brackets."""

    def text(node: Node, parts: list[str]) -> str:
        if not parts:
            return f"{node.value:g}" if node.kind == "const" else str(node.value)
        if node.kind == "neg":
            return f"(-{parts[0]})"
        return f"({parts[0]} {SIGNS[node.kind]} {parts[1]})" if node.kind in SIGNS else f"{node.kind}({parts[0]})"

    return folded(root, text)


TOKEN = re.compile(r"\s*(\*\*|[-+*/()]|\d+\.?\d*(?:[eE][-+]?\d+)?|[A-Za-z_][\w.]*)")
#: Binding strength of the signs; ** binds to the right.
STRENGTH = {"+": 1, "-": 1, "*": 2, "/": 2, "**": 4}


def from_infix(text: str) -> Node:
    """The tree of an infix text: numbers, names, functions of one argument, signs, brackets."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        found = TOKEN.match(text, at)
        if not found:
            raise ValueError(f"unexpected text at {at}: {text[at:]!r}")
        tokens.append(found[1])
        at = found.end()
    kinds = {sign: kind for kind, sign in SIGNS.items()}
    operands: list[Node] = []
    pending: list[str] = []

    def reduce_one() -> None:
        top = pending.pop()
        if top == "neg" or top in UNARY:
            operands.append(op(top, operands.pop()))
        else:
            b, a = operands.pop(), operands.pop()
            operands.append(op(kinds[top], a, b))

    operand_next = True
    for k, token in enumerate(tokens):
        if operand_next:
            if token == "-":
                pending.append("neg")
            elif token == "(":
                pending.append("(")
            elif token in UNARY and tokens[k + 1 : k + 2] == ["("]:
                pending.append(token)
            elif token[0].isdigit():
                operands.append(const(float(token)))
                operand_next = False
            elif token[0].isalpha() or token[0] == "_":
                operands.append(var(token))
                operand_next = False
            else:
                raise ValueError(f"an operand is missing before {token!r}")
        elif token == ")":
            while pending and pending[-1] != "(":
                reduce_one()
            if not pending:
                raise ValueError("a bracket is not opened")
            pending.pop()
            if pending and pending[-1] in UNARY and pending[-1] != "neg":
                reduce_one()
        elif token in STRENGTH:
            mine = STRENGTH[token]
            while pending and pending[-1] != "(" and (3 if pending[-1] in UNARY else STRENGTH[pending[-1]]) >= mine + (token == "**"):
                reduce_one()
            pending.append(token)
            operand_next = True
        else:
            raise ValueError(f"a sign is missing before {token!r}")
    if operand_next:
        raise ValueError("an operand is missing at the end")
    while pending:
        if pending[-1] == "(":
            raise ValueError("a bracket is not closed")
        reduce_one()
    return operands[0]


def canonical_text(text: str) -> str:
    """A text form for comparison: lower case, no blanks, ^ for powers, no zero terms."""
    s = re.sub(r"\s", "", text.lower()).replace("**", "^")
    s = re.sub(r"\+0(?:\.0*)?(?![\w.])", "", s)
    s = re.sub(r"(?<![\w.)])0(?:\.0+)?(?![\w.])", "", s)
    return s or "empty"


def unary(name: str) -> list[Node]:
    return [var(name), *[op(kind, var(name)) for kind in UNARY]]


def binary(a: Node, b: Node) -> list[Node]:
    """Every operation on two trees; for powers the square of the first."""
    return [op(kind, a, const(2.0) if kind == "pow" else b) for kind in BINARY]


def chains(names: list[str], kinds: tuple[str, ...] = ("log", "sqrt", "abs")) -> list[Node]:
    """Each variable, under each function, and under abs or sqrt of another."""
    out = []
    for name in names:
        out += [var(name), *[op(k, var(name)) for k in kinds]]
        out += [op(outer, op(k, var(name))) for k in kinds for outer in ("abs", "sqrt") if outer != k]
    return out


def trees(names: list[str], depth: int = 2, most: int = 10_000) -> Iterator[Node]:
    """Trees by rising depth: pairs of what is there so far, without repeats, at most `most`."""
    seen: dict[Node, None] = dict.fromkeys(n for name in names for n in unary(name))
    for level in range(1, depth + 1):
        if level > 1:
            for a, b in combinations_with_replacement(list(seen), 2):
                seen.update(dict.fromkeys(binary(a, b)))
                if len(seen) >= most:
                    break
    yield from list(seen)[:most]


def metric_candidates(names: list[str], depth: int = 2, most: int = 50_000) -> list[Node]:
    """Ratios, products, chains, then trees, without repeats, at most `most`."""
    first = [*ratios(names), *products(names), *chains(names)]
    return list(dict.fromkeys([*first, *trees(names, depth, most)]))[:most]
