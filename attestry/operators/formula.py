"""Tables of formulas sampled over uniform grids, exactly; formulas over the columns of a table.

A formula has ``+ - * /``, ``**`` with one signed integer exponent, ``abs``, decimal literals and the allowed names.
Admission and evaluation are jobs over a table of formulas: admission turns each row into its canonical form or the
first check that fails; evaluation spreads (formula, range of grid points) over tasks and computes with rationals,
rounding once, ties to even.  Ceilings are a parameter of every entry point, ``LIMITS`` by default.  A formula over
decimal columns becomes one expression of Spark's own where every step fits 38 digits, and goes through rationals only
where it does not.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Mapping
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import tagged
from ..functions.exact import _unshifted, half_even_quotient
from ..sources.store import spread

# The default ceilings, inclusive.
LIMITS = {
    "formula_bytes": 512,
    "formula_tokens": 256,
    "formula_ast_nodes": 256,
    "formula_ast_depth": 32,
    "formula_paren_depth": 32,
    "formula_digits": 32,
    "exponent": 64,
    "formula_identifier_bytes": 32,
    "formula_samples": 10_000,
    "formula_intermediate_bits": 4096,
}
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(\*\*|[-+*/()]))", re.ASCII)


Limits = Mapping[str, int]


class Refused(ValueError):
    def __init__(self, check: str, message: str):
        super().__init__(message)
        self.check = check


def _tokens(text: str, limits: Limits) -> list[str]:
    out, at = [], 0
    body = text.rstrip()
    while at < len(body):
        m = _TOKEN.match(body, at)
        if m is None or (m[1] and re.match(r"[.\w]", body[m.end() : m.end() + 1], re.ASCII)):
            raise Refused("formula.grammar_allowed", f"unexpected text at {at}")
        if m[1] and len(m[1].replace(".", "")) > limits["formula_digits"]:
            raise Refused("resource.formula_digits", "too many digits")
        if m[2] and len(m[2]) > limits["formula_identifier_bytes"]:
            raise Refused("resource.formula_identifier_bytes", "name too long")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


def parse(text: str, names: frozenset[str] = frozenset({"x"}), limits: Limits = LIMITS) -> tuple:
    """A formula as nested tuples: numbers, names, ``('neg' | 'abs', a)``, ``('pow', a, n)``, ``(op, a, b)``."""
    if len(text.encode()) > limits["formula_bytes"]:
        raise Refused("resource.formula_bytes", "formula too long")
    tokens = _tokens(text, limits)
    if len(tokens) > limits["formula_tokens"]:
        raise Refused("resource.formula_tokens", "too many tokens")
    depth = most = 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        most = max(most, depth)
    if most > limits["formula_paren_depth"]:
        raise Refused("resource.formula_paren_depth", "nested too deep")
    # leading zeros are numbers here but not in Python's grammar
    source = " ".join(re.sub(r"^0+(?=\d)", "", t) for t in tokens)
    try:
        tree = ast.parse(source, mode="eval").body
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise Refused("formula.grammar_allowed", "not a formula") from e
    literals = iter([t for t in tokens if t[0].isdigit()])
    nodes = 0

    def walk(node: ast.AST, level: int) -> tuple | Fraction | str:
        nonlocal nodes
        nodes += 1
        if level > limits["formula_ast_depth"]:
            raise Refused("resource.formula_ast_depth", "tree too deep")
        if nodes > limits["formula_ast_nodes"]:
            raise Refused("resource.formula_ast_nodes", "tree too large")
        match node:
            case ast.Constant(value=int() | float()):
                return Fraction(next(literals))
            case ast.Name(id=name):
                if name not in names:
                    raise Refused("formula.names_allowed", f"name {name!r}")
                return name
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return ("neg", walk(a, level + 1))
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return walk(a, level)
            case ast.Call(func=ast.Name(id=name), args=[a], keywords=[]):
                if name != "abs":
                    raise Refused("formula.functions_allowed", f"function {name!r}")
                return ("abs", walk(a, level + 1))
            case ast.Call():
                raise Refused("formula.functions_allowed", "call")
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                base = walk(a, level + 1)
                sign = 1
                while isinstance(b, ast.UnaryOp) and isinstance(b.op, ast.USub | ast.UAdd):
                    sign, b = -sign if isinstance(b.op, ast.USub) else sign, b.operand
                    if isinstance(b, ast.UnaryOp):
                        raise Refused("formula.grammar_allowed", "one sign is allowed")
                if not isinstance(b, ast.Constant) or not isinstance(b.value, int):
                    raise Refused("formula.grammar_allowed", "the exponent is one signed integer")
                exponent = int(next(literals))
                if exponent > limits["exponent"]:
                    raise Refused("formula.exponents_bounded", f"exponent {exponent}")
                return ("pow", base, sign * exponent)
            case ast.BinOp(left=a, op=op, right=b):
                name = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}.get(type(op))
                if name is None:
                    raise Refused("formula.grammar_allowed", "operator")
                return (name, walk(a, level + 1), walk(b, level + 1))
        raise Refused("formula.grammar_allowed", "construct")

    return walk(tree, 1)


def printed(tree) -> str:
    """The canonical prefix form."""
    if isinstance(tree, tuple):
        return "(" + " ".join(printed(x) if not isinstance(x, int) or isinstance(x, Fraction) else str(x) for x in tree) + ")"
    return str(tree)


def value(tree, binding: dict[str, Fraction], limits: Limits = LIMITS) -> Fraction:
    """Exact value; undefined and oversized values are refused."""
    if isinstance(tree, Fraction):
        return tree
    if isinstance(tree, str):
        return binding[tree]
    bits = limits["formula_intermediate_bits"]
    op, a, *rest = tree
    x = value(a, binding, limits)
    if op == "neg":
        out = -x
    elif op == "abs":
        out = abs(x)
    elif op == "pow":
        n = rest[0]
        if x == 0 and n < 0:
            raise Refused("formula.values_defined", "zero to a negative power")
        if abs(n) * max(x.numerator.bit_length(), x.denominator.bit_length()) > 2 * bits:
            raise Refused("resource.formula_intermediate_bits", "power too large")
        out = x**n
    else:
        y = value(rest[0], binding, limits)
        if op == "/" and y == 0:
            raise Refused("formula.values_defined", "division by zero")
        out = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y
    if max(out.numerator.bit_length(), out.denominator.bit_length()) > bits:
        raise Refused("resource.formula_intermediate_bits", "value too large")
    return out


#: Bits of a scaled integer up to which a value without division is certain to be within any ceiling of more bits.
_SMALL = 256


def scaled(tree, binding: dict[str, tuple[int, int]]) -> tuple[int, int] | None:
    """The value as (n, s) for n / 10**s where no step divides or grows large; otherwise None."""
    if isinstance(tree, Fraction):
        d, s = tree.denominator, 0
        while d > 1 and s < 40:
            s += 1
            d = (tree * 10**s).denominator
        return ((tree * 10**s).numerator, s) if d == 1 else None
    if isinstance(tree, str):
        return binding[tree]
    op, a, *rest = tree
    if op == "/" or (x := scaled(a, binding)) is None:
        return None
    n, s = x
    if op == "neg":
        n = -n
    elif op == "abs":
        n = abs(n)
    elif op == "pow":
        if rest[0] < 0 or rest[0] * (n.bit_length() + 4 * s) > _SMALL:
            return None
        n, s = n ** rest[0], s * rest[0]
    else:
        y = scaled(rest[0], binding)
        if y is None:
            return None
        m, t = y
        if op == "*":
            n, s = n * m, s + t
        else:
            if s < t:
                n, s = n * 10 ** (t - s), t
            m *= 10 ** (s - t)
            n = n + m if op == "+" else n - m
    return None if n.bit_length() + 4 * s > _SMALL else (n, s)


def quantised(x: Fraction, scale: int) -> int:
    """``x`` in units of ``10**-scale``, ties to even."""
    return round(x * 10**scale)


def _rounded(tree, cells: dict[str, Decimal], scale: int, limits: Limits) -> int:
    """The value in units of ``10**-scale``, ties to even; small integers first, rationals where these can't tell."""
    if limits["formula_intermediate_bits"] >= _SMALL:
        whole = {}
        for k, v in cells.items():
            sign, digits, exponent = v.as_tuple()
            n = int("".join(map(str, digits))) * (-1 if sign else 1)
            whole[k] = (n * 10**exponent, 0) if exponent > 0 else (n, -exponent)
        if (got := scaled(tree, whole)) is not None:
            n, s = got
            if s <= scale:
                return n * 10 ** (scale - s)
            q, r = divmod(n, 10 ** (s - scale))
            twice = 2 * r
            return q + (twice > 10 ** (s - scale) or (twice == 10 ** (s - scale) and q & 1))
    return quantised(value(tree, {k: Fraction(v) for k, v in cells.items()}, limits), scale)


def _digits(units: int, scale: int) -> str:
    digits = str(abs(units)).rjust(scale + 1, "0")
    return ("-" if units < 0 else "") + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)


def admission(formulas: DataFrame, names: frozenset[str] = frozenset({"x"}), limits: Limits = LIMITS) -> DataFrame:
    """``formula_id, check, ast``: the canonical form, or the check that refuses it (domain before grammar).

    Formulas are spread over tasks, and equal texts of one Arrow batch are parsed once.
    """

    def judge(text: str) -> tuple:
        try:
            return None, printed(parse(text, names, limits))
        except Refused as e:
            return e.check, None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = {text: judge(text) for text in set(pdf["formula"])}
            out = [told[text] for text in pdf["formula"]]
            yield pd.DataFrame({"formula_id": pdf["formula_id"], "grammar": [x[0] for x in out], "ast": [x[1] for x in out]})

    parsed = spread(formulas.select("formula_id", "formula"), "formula_id").mapInPandas(work, "formula_id long, grammar string, ast string")
    ends = lambda c: F.pmod(F.col(c) * F.pow(F.lit(10), F.col("x_scale")).cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)")) != 0
    domain = F.when(F.col("start") >= F.col("stop"), "formula.domain_ordered").when(
        (F.col("samples") > limits["formula_samples"]) | (F.col("samples") < 2),
        "resource.formula_samples",
    )
    late = F.when(ends("start") | ends("stop"), "formula.domain_bounded")
    j = formulas.join(parsed, "formula_id")
    return j.select("formula_id", F.coalesce(domain, "grammar", late).alias("check"), "ast")


def fingerprints(formulas: DataFrame, admitted: DataFrame) -> DataFrame:
    """``formula_id, fingerprint`` of admitted formulas: their canonical form with domain, scales and rounding."""
    lines = [
        F.lit("grammar=1"),
        F.lit("rounding=half_even"),
        F.concat(F.lit("x_scale="), "x_scale"),
        F.concat(F.lit("y_scale="), "y_scale"),
        F.concat(F.lit("samples="), "samples"),
        F.concat(F.lit("start="), F.col("start").cast("string")),
        F.concat(F.lit("stop="), F.col("stop").cast("string")),
        F.concat(F.lit("ast="), "ast"),
    ]
    good = admitted.filter("check is null").select("formula_id", "ast")
    return formulas.join(good, "formula_id").select("formula_id", tagged("formula", F.concat_ws("\n", *lines)).alias("fingerprint"))


def grid(formulas: DataFrame) -> DataFrame:
    """``formula_id, i, x``: ``start + i / (samples - 1) * span``, rounded at ``x_scale``, for every sample.

    Exact as long as the products fit 38 digits (start and stop have at most 6 decimals and 18 digits).  Formulas are spread
    over tasks before their points are made, equal ones side by side.
    """
    tasks = int(formulas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    formulas = formulas.repartition(tasks, "formula_id").sortWithinPartitions("formula", "y_scale") if {"formula", "y_scale"} <= set(formulas.columns) else formulas
    rows = formulas.select("formula_id", "start", "stop", "samples", "x_scale", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)).alias("i"))
    six = lambda c: (F.col(c).cast("decimal(24,6)") * 1_000_000).cast("decimal(24,0)")
    last = (F.col("samples") - 1).cast("decimal(10,0)")
    units = (six("start") * last + (six("stop") - six("start")) * F.col("i").cast("decimal(10,0)")).cast("decimal(38,0)")
    out = F.lit(None).cast("decimal(38,12)")
    for scale in range(7):
        at = _unshifted(half_even_quotient(units, (last * F.lit(10 ** (6 - scale)).cast("decimal(8,0)")).cast("decimal(20,0)")), scale)
        out = F.when(F.col("x_scale") == scale, at.cast("decimal(38,12)")).otherwise(out)
    return rows.select("formula_id", "i", out.alias("x"))


def collisions(points: DataFrame) -> DataFrame:
    """``formula_id, i`` of sample points that do not lie above the one before."""
    w = Window.partitionBy("formula_id").orderBy("i")
    return points.withColumn("before", F.lag("x").over(w)).filter("x <= before").select("formula_id", "i")


class _Wide(Exception):
    """A value that may take more than ``_SMALL`` bits."""


class Batch:
    """A formula over many points at once: every value is n / (d * 10**s), with arrays n and d (None for 1) and one s.

    Bounds on bits are found before anything is computed, from the points' largest one: while they fit 62 bits the
    arrays are of machine integers, and beyond that of Python's; a formula that may take more than ``_SMALL`` bits is not for this
    path.  Fractions are not reduced on the way, so that a value's bits are never less than those of the reduced one.
    """

    def __init__(self, tree, units: np.ndarray, scale: int, y_scale: int):
        self.tree, self.y_scale = tree, y_scale
        largest = max([abs(int(x)) for x in (units.max(), units.min())]) if len(units) else 0
        self.most = 0
        n, d, s = self._bits(tree, largest.bit_length(), scale)
        self._seen(n + 4 * max(0, y_scale - s) + 2, d + 4 * max(0, s - y_scale) + 2)
        self.units = units if self.most <= 62 else units.astype(object)
        self.scale, self.undefined = scale, np.zeros(len(units), bool)

    def _seen(self, *bits: int) -> None:
        self.most = max(self.most, *bits)
        if self.most > _SMALL:
            raise _Wide

    def _bits(self, tree, x: int, scale: int) -> tuple[int, int, int]:
        """Bounds on the bits of n and d, and s."""
        if isinstance(tree, Fraction):
            got = scaled(tree, {})
            if got is None:
                raise _Wide
            n, d, s = got[0].bit_length(), 0, got[1]
        elif isinstance(tree, str):
            n, d, s = x, 0, scale
        else:
            op, a, *rest = tree
            n, d, s = self._bits(a, x, scale)
            if op == "pow":
                k = rest[0]
                if k < 0:
                    n, d, s, k = d + 4 * s, n, 0, -k
                n, d, s = n * k + 1, d * k, s * k
            elif op not in ("neg", "abs"):
                m, e, t = self._bits(rest[0], x, scale)
                if op == "*":
                    n, d, s = n + m, d + e, s + t
                elif op == "/":
                    n, d, s = n + e + 4 * max(0, t - s), d + m, max(0, s - t)
                else:
                    n, d, s = max(n + e + 4 * max(0, t - s), m + d + 4 * max(0, s - t)) + 1, d + e, max(s, t)
        self._seen(n, d, 4 * s)
        return n, d, s

    def _value(self, tree) -> tuple:
        if isinstance(tree, Fraction):
            n, s = scaled(tree, {})
            return np.full(len(self.units), n, self.units.dtype), None, s
        if isinstance(tree, str):
            return self.units, None, self.scale
        op, a, *rest = tree
        n, d, s = self._value(a)
        if op in ("neg", "abs"):
            return (-n if op == "neg" else np.abs(n)), d, s
        if op == "pow":
            k = rest[0]
            if k < 0:
                n, d, s, k = *self._turned(n, d, s), 0, -k
            out = (np.ones_like(n), None if d is None else np.ones_like(d))
            for _ in range(k):
                out = (out[0] * n, None if d is None else out[1] * d)
            return *out, s * k
        m, e, t = self._value(rest[0])
        if op == "/":
            turned = self._turned(m, e, 0)
            # 10**t goes to whichever side has the smaller power
            n = n * turned[0] * 10 ** max(0, t - s)
            return n, turned[1] if d is None else d * turned[1], max(0, s - t)
        if op == "*":
            return n * m, d if e is None else e if d is None else d * e, s + t
        n, m, s = n * 10 ** max(0, t - s), m * 10 ** max(0, s - t), max(s, t)
        n, m = n if e is None else n * e, m if d is None else m * d
        return (n + m if op == "+" else n - m), d if e is None else e if d is None else d * e, s

    def _turned(self, n: np.ndarray, d: np.ndarray | None, s: int) -> tuple[np.ndarray, np.ndarray]:
        """One over a value, the sign above."""
        zero = n == 0
        self.undefined |= zero.astype(bool)
        n = np.where(zero, np.ones_like(n), n)
        above = (np.ones_like(n) if d is None else d) * 10**s
        return np.where(n < 0, -above, above), np.abs(n)

    def rounded(self) -> np.ndarray:
        """Values in units of ``10**-y_scale``, ties to even."""
        n, d, s = self._value(self.tree)
        n = n * 10 ** max(0, self.y_scale - s)
        d = (np.ones_like(n) if d is None else d) * 10 ** max(0, s - self.y_scale)
        q = n // d
        twice = 2 * (n - q * d)
        return q + ((twice > d) | ((twice == d) & (q % 2 == 1))).astype(q.dtype)


def _decimals(units: np.ndarray, scale: int) -> pa.Array:
    """Integers as decimals of ``10**-scale`` at (38, 12); null where they do not fit."""
    if units.dtype == np.int64:
        raw = np.stack([units, units >> 63], 1)
        return pa.Array.from_buffers(pa.decimal128(38, scale), len(units), [None, pa.py_buffer(raw.tobytes())]).cast(pa.decimal128(38, 12))
    limit = 10 ** (38 - 12 + scale)
    with localcontext(prec=60):
        return pa.array([Decimal(x).scaleb(-scale) if -limit < x < limit else None for x in units.tolist()], pa.decimal128(38, 12))


def _units(column: pa.Array) -> tuple[np.ndarray, int]:
    """Decimals at (38, 12) as integers of one scale, the least that holds them all."""
    raw = np.frombuffer(column.buffers()[1], np.int64).reshape(-1, 2)[column.offset : column.offset + len(column)]
    units, scale = raw[:, 0], 12
    if (raw[:, 1] != units >> 63).any():
        with localcontext(prec=60):
            return np.array([int(x.scaleb(12)) for x in column.to_pylist()], object), 12
    while scale and not (units % 10).any():
        units, scale = units // 10, scale - 1
    return units, scale


def evaluated(points: DataFrame, formulas: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``formula_id, i, x, y, status``: y at ``y_scale`` from the canonical x; undefined points have a status instead.

    A formula's points of one Arrow batch are computed together (``Batch``); formulas that may take many bits go through
    rationals, point by point.  Points without x, and formulas without a text or a scale, give no rows.
    """
    need = points.join(formulas.select("formula_id", "formula", "y_scale"), "formula_id").select("formula_id", "i", F.col("x").cast("decimal(38,12)").alias("x"), "formula", "y_scale")
    shape = pa.schema([("formula_id", pa.int64()), ("i", pa.int32()), ("x", pa.decimal128(38, 12)), ("y", pa.decimal128(38, 12)), ("status", pa.string())])

    def each(tree, xs: pa.Array, scale: int) -> tuple[pa.Array, list[str]]:
        ys, status = [], []
        for x in xs.to_pylist():
            try:
                ys.append(_rounded(tree, {"x": x}, scale, limits))
                status.append("ok")
            except Refused as e:
                ys.append(None)
                status.append(e.check)
        got = _decimals(np.array([0 if y is None else y for y in ys], object), scale)
        return pa.compute.if_else(pa.array([y is None for y in ys]), pa.scalar(None, got.type), got), status

    def together(text: str, xs: pa.Array, scale: int, trees: dict) -> tuple[pa.Array, list[str]]:
        if text not in trees:
            if len(trees) > 1000:
                trees.clear()
            try:
                trees[text] = parse(text, limits=limits)
            except Refused as e:
                trees[text] = e
        tree = trees[text]
        if isinstance(tree, Refused):
            return pa.nulls(len(xs), pa.decimal128(38, 12)), [tree.check] * len(xs)
        try:
            if limits["formula_intermediate_bits"] < _SMALL:
                raise _Wide
            batch = Batch(tree, *_units(xs), scale)
            got = _decimals(batch.rounded(), scale)
        except _Wide:
            return each(tree, xs, scale)
        return pa.compute.if_else(pa.array(batch.undefined), pa.scalar(None, got.type), got), np.where(batch.undefined, "formula.values_defined", "ok").tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, object] = {}
        for batch in batches:
            batch = batch.filter(pa.compute.and_(batch.column("x").is_valid(), pa.compute.and_(batch.column("formula").is_valid(), batch.column("y_scale").is_valid())))
            if not batch.num_rows:
                continue
            key = pa.table({"f": batch.column("formula"), "s": batch.column("y_scale"), "k": pa.array(range(batch.num_rows))})
            groups = key.group_by(["f", "s"]).aggregate([("k", "list")])
            order, ys, status = [], [], []
            for text, scale, at in zip(groups.column("f").to_pylist(), groups.column("s").to_pylist(), groups.column("k_list").to_pylist(), strict=True):
                y, own = together(text, batch.column("x").take(pa.array(at)), int(scale), trees)
                order += at
                ys.append(y)
                status += own
            rows = batch.take(pa.array(order))
            yield pa.RecordBatch.from_arrays([rows.column("formula_id").cast(pa.int64()), rows.column("i").cast(pa.int32()), rows.column("x"), pa.concat_arrays(ys), pa.array(status, pa.string())], schema=shape)

    return need.mapInArrow(work, "formula_id long, i int, x decimal(38,12), y decimal(38,12), status string")


def compiled(tree, columns: dict[str, tuple[Column, int, int]]) -> tuple[Column, int, int] | None:
    """(expression, precision, scale) of a formula over decimal columns of known precision and scale; None where it
    divides or a step may take more than 38 digits."""
    if isinstance(tree, Fraction):
        got = scaled(tree, {})
        if got is None:
            return None
        n, s = got
        precision = max(len(str(abs(n))), s, 1)
        return None if precision > 38 else (F.lit(Decimal(n).scaleb(-s)).cast(f"decimal({precision},{s})"), precision, s)
    if isinstance(tree, str):
        return columns[tree]
    op, a, *rest = tree
    if op == "/" or (x := compiled(a, columns)) is None:
        return None
    if op in ("neg", "abs"):
        return (-x[0] if op == "neg" else F.abs(x[0])), x[1], x[2]
    if op == "pow":
        if rest[0] < 0:
            return None
        one = (F.when(x[0].isNotNull(), F.lit(1)).cast("decimal(1,0)"), 1, 0)
        out = one if rest[0] == 0 else x
        for _ in range(rest[0] - 1):
            out = _product(out, x) if out is not None else None
        return out
    y = compiled(rest[0], columns)
    if y is None:
        return None
    if op == "*":
        return _product(x, y)
    scale = max(x[2], y[2])
    precision = max(x[1] - x[2], y[1] - y[2]) + scale + 1
    return None if precision > 38 else (x[0] + y[0] if op == "+" else x[0] - y[0], precision, scale)


def _product(x: tuple[Column, int, int], y: tuple[Column, int, int]) -> tuple[Column, int, int] | None:
    precision = x[1] + y[1] + 1
    return None if precision > 38 else (x[0] * y[0], precision, x[2] + y[2])


def formula_column(df: DataFrame, formula: str, columns: dict[str, str], scale: int, name: str = "value", limits: Limits = LIMITS) -> DataFrame:
    """``df`` with a formula over its decimal columns (``columns``: name in the formula -> column), as text at ``scale``, and
    its ``status``."""
    tree = parse(formula, frozenset(columns), limits)
    types = {k: df.schema[c].dataType for k, c in columns.items()}
    fit = None
    if all(isinstance(t, T.DecimalType) for t in types.values()):
        fit = compiled(tree, {k: (F.col(f"`{c}`"), types[k].precision, types[k].scale) for k, c in columns.items()})
    if fit is not None and fit[1] - fit[2] + max(scale, fit[2]) < 38:
        made, _, own = fit
        given = F.lit(True)
        for c in columns.values():
            given &= F.col(f"`{c}`").isNotNull()
        made = F.bround(made, scale) if scale < own else made
        return df.withColumns({name: F.when(given, made.cast(f"decimal(38,{scale})").cast("string")), "status": F.when(given, "ok").otherwise("null")})
    shape = T.StructType([*df.schema, T.StructField(name, T.StringType()), T.StructField("status", T.StringType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ys, status = [], []
            for row in zip(*[pdf[c] for c in columns.values()], strict=True):
                if any(v is None for v in row):
                    ys.append(None)
                    status.append("null")
                    continue
                try:
                    ys.append(_digits(_rounded(tree, {k: Decimal(v) for k, v in zip(columns, row, strict=True)}, scale, limits), scale))
                    status.append("ok")
                except Refused as e:
                    ys.append(None)
                    status.append(e.check)
            yield pdf.assign(**{name: ys, "status": status})

    return df.mapInPandas(work, shape)
