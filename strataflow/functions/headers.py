"""Header schemas: alias matching, mapping with transforms, and computed headers compiled to Columns.

A computed header is an arithmetic expression over headers. It is parsed and translated node by node;
only the grammar below is understood, nothing is evaluated as code. A result that is null, not a
number or infinite, and any division by zero or by an invalid argument, becomes 0.0.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard trace headers, by 1-based byte and format code (i: int32, h: int16, both big-endian).
STANDARD_HEADERS = {
    "trace_sequence_line": (1, "i"),
    "trace_sequence_file": (5, "i"),
    "field_record": (9, "i"),
    "trace_number": (13, "i"),
    "energy_source_point": (17, "i"),
    "cdp": (21, "i"),
    "trace_number_cdp": (25, "i"),
    "trace_id_code": (29, "h"),
    "offset": (37, "i"),
    "receiver_elevation": (41, "i"),
    "source_elevation": (45, "i"),
    "source_depth": (49, "i"),
    "scalar_coord": (71, "h"),
    "source_x": (73, "i"),
    "source_y": (77, "i"),
    "receiver_x": (81, "i"),
    "receiver_y": (85, "i"),
    "sample_count": (115, "h"),
    "sample_interval": (117, "h"),
    "inline": (189, "i"),
    "crossline": (193, "i"),
}
# Names that stand for a header in files of different origin.
ALIASES = {
    "source_x": ("source_x", "SourceX", "sx", "SX", "SOURCE_X"),
    "source_y": ("source_y", "SourceY", "sy", "SY", "SOURCE_Y"),
    "receiver_x": ("receiver_x", "GroupX", "ReceiverX", "gx", "GX", "rx", "RECEIVER_X"),
    "receiver_y": ("receiver_y", "GroupY", "ReceiverY", "gy", "GY", "ry", "RECEIVER_Y"),
    "offset": ("offset", "OFFSET", "Offset"),
    "azimuth": ("azimuth", "AZIMUTH", "Azimuth"),
    "cdp_x": ("cdp_x", "CDP_X", "CDPX", "CdpX"),
    "cdp_y": ("cdp_y", "CDP_Y", "CDPY", "CdpY"),
    "cdp": ("cdp", "CDP", "ensemble"),
    "inline": ("inline", "INLINE", "INLINE_NO", "iline", "il"),
    "crossline": ("crossline", "xline", "XLINE", "CROSSLINE", "XLINE_NO", "xl"),
    "scalar_coord": ("scalar_coord", "SourceGroupScalar", "coordinate_scalar", "scalco"),
}
#: Headers that follow from others.
COMPUTABLE = {"offset": ("source_x", "source_y", "receiver_x", "receiver_y"), "azimuth": ("source_x", "source_y", "receiver_x", "receiver_y"), "cdp_x": ("source_x", "receiver_x"), "cdp_y": ("source_y", "receiver_y")}


def resolve(columns: list[str], wanted: list[str]) -> dict[str, str]:
    """wanted name to the column that stands for it: itself, else an alias, without regard to case; left out where none does."""
    by_case = {c.lower(): c for c in reversed(columns)}
    out = {}
    for name in wanted:
        for alias in (name, *ALIASES.get(name.lower(), ())):
            if alias.lower() in by_case:
                out[name] = by_case[alias.lower()]
                break
    return out


def select_matched(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted headers under their own names; a missing one is an error that names all that are."""
    found = resolve(df.columns, wanted)
    if missing := [w for w in wanted if w not in found]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*[F.col(c).alias(w) for w, c in found.items()])


def validate(columns: list[str], required: list[str]) -> dict[str, str]:
    """For each required header: present, computable or missing."""
    have = resolve(columns, [*required, *{d for r in required for d in COMPUTABLE.get(r, ())}])
    return {r: "present" if r in have else "computable" if r in COMPUTABLE and all(d in have for d in COMPUTABLE[r]) else "missing" for r in required}


def transformed(x: Column, how: str | None) -> Column:
    """scale:F, offset:F, negate, abs; anything else leaves x."""
    name, _, value = (how or "").partition(":")
    if name in ("scale", "offset"):
        return x * float(value) if name == "scale" else x + float(value)
    return {"negate": lambda: -x, "abs": lambda: F.abs(x)}.get(name, lambda: x)()


def apply_mapping(df: DataFrame, mapping: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Columns named by mapping's keys, each from (column, transform); columns that df lacks are left out."""
    have = set(df.columns)
    return df.select(*[transformed(F.col(c), how).alias(name) for name, (c, how) in mapping.items() if c in have])


_FUNCTIONS = {
    "abs": F.abs,
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "atan2": F.atan2,
    "min": lambda *x: F.when(_known(x), F.least(*x)),
    "max": lambda *x: F.when(_known(x), F.greatest(*x)),
    "round": lambda x, n=None: F.rint(x) if n is None else F.bround(x, n),
}
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    ast.Mod: lambda a, b: F.when(b != 0, a - b * F.floor(F.try_divide(a, b))),
    ast.Pow: lambda a, b: F.pow(a, b),
}


def _known(x: tuple[Column, ...]) -> Column:
    out = F.lit(True)
    for c in x:
        out = out & c.isNotNull()
    return out


def names_in(expression: str) -> set[str]:
    """The headers that an expression reads."""
    return {n.id for n in ast.walk(ast.parse(expression, mode="eval")) if isinstance(n, ast.Name)} - set(_FUNCTIONS) - {"pi", "e"}


def _compiled(node: ast.AST, columns: set[str]) -> Column:
    match node:
        case ast.Expression(body=body):
            return _compiled(body, columns)
        case ast.Constant(value=int() | float() as v):
            return F.lit(float(v))
        case ast.Name(id="pi" | "e" as name):
            return F.lit(getattr(math, name))
        case ast.Name(id=name) if name in columns:
            return F.col(name).cast("double")
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_compiled(x, columns)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _compiled(x, columns)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            return _BINARY[type(op)](_compiled(a, columns), _compiled(b, columns))
        case ast.Call(func=ast.Name(id="round"), args=[x, ast.Constant(value=int() as n)], keywords=[]):
            return F.bround(_compiled(x, columns), n)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _FUNCTIONS:
            return _FUNCTIONS[name](*[_compiled(a, columns) for a in args])
    raise ValueError(f"not understood in a computed header: {ast.unparse(node)}")


def compile_expression(expression: str, columns: list[str], kind: str = "f") -> Column:
    """The expression as a Column; kind i, h, I or H rounds it half to even, to long."""
    x = _compiled(ast.parse(expression, mode="eval"), set(columns))
    x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
    return x if kind == "f" else F.rint(x).cast("long")


def computed(df: DataFrame, expressions: Mapping[str, str], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """df with computed headers, in the order of their dependencies; a cycle is an error."""
    left, kinds = dict(expressions), kinds or {}
    while left:
        ready = [n for n, e in left.items() if not (names_in(e) - {n}) & set(left)]
        if not ready:
            raise ValueError(f"computed headers depend on each other: {', '.join(sorted(left))}")
        df = df.withColumns({n: compile_expression(left[n], df.columns, kinds.get(n, "f")) for n in ready})
        for n in ready:
            del left[n]
    return df
