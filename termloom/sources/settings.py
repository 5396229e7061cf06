"""Settings of a tagging service: styles and type rules by priority, the script of a page's head, and file names.

A settings file has sections: STYLES and TYPES with a line ``priority = value`` each, and one or more with names of
files. A type rule is a condition on ``x``, the type of an entity, such as ``x > 0`` or ``x in (-25, -26)``; it is read
as a condition on a column and never run as code.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from configparser import ConfigParser
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_COMPARE = {
    ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__, ast.Eq: Column.__eq__, ast.NotEq: Column.__ne__,
}


def type_rule(text: str) -> Callable[[Column], Column]:
    """A condition on ``x`` in comparisons, ``in``, ``and``, ``or`` and ``not`` with whole numbers, as a function of a column."""
    tree = ast.parse(text.strip(), mode="eval").body

    def read(node: ast.expr, x: Column) -> Column:
        match node:
            case ast.Name(id="x"):
                return x
            case ast.Constant(value=bool() | int() as value):
                return F.lit(value)
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() as value)):
                return F.lit(-value)
            case ast.UnaryOp(op=ast.Not(), operand=part):
                return ~read(part, x)
            case ast.BoolOp(op=op, values=[first, *rest]):
                out = read(first, x)
                for part in rest:
                    out = out & read(part, x) if isinstance(op, ast.And) else out | read(part, x)
                return out
            case ast.Compare(left=left, ops=ops, comparators=sides):
                out, before = F.lit(True), read(left, x)
                for op, side in zip(ops, sides):
                    if isinstance(op, ast.In | ast.NotIn) and isinstance(side, ast.Tuple | ast.List | ast.Set):
                        found = before.isin(*(read(e, x) for e in side.elts))
                        out = out & (found if isinstance(op, ast.In) else ~found)
                        continue
                    if type(op) not in _COMPARE:
                        break
                    after = read(side, x)
                    out, before = out & _COMPARE[type(op)](before, after), after
                else:
                    return out
        raise ValueError(f"not a condition on x: {text!r}")

    read(tree, F.lit(0))
    return lambda x: read(tree, x)


@dataclass(frozen=True)
class Settings:
    """``styles`` in order of priority, as ``annotated`` takes them; ``script`` for the head of pages; ``files`` by name."""

    styles: tuple[tuple[Callable[[Column], Column] | None, str], ...] = ()
    script: str = ""
    files: dict[str, str] = field(default_factory=dict)


def read_settings(spark: SparkSession, path: str) -> Settings:
    """The settings in a file; a style whose priority has no rule is one for all types."""
    parser = ConfigParser(interpolation=None)
    parser.read_string("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    section = lambda name: {int(k): v for k, v in parser[name].items()} if name in parser else {}
    rules = section("TYPES")
    styles = tuple((type_rule(rules[k]) if k in rules else None, css) for k, css in sorted(section("STYLES").items()))
    files = {k: v for name in parser.sections() if name not in ("STYLES", "TYPES") for k, v in parser[name].items()}
    return Settings(styles, head_script(spark, files["java_scripts"]) if "java_scripts" in files else "", files)


def head_script(spark: SparkSession, source: str) -> str:
    """What goes before the end of a page's head: a reference to the script at a web address, or the content of a file."""
    if source.startswith(("http://", "https://")):
        return f'<script src="{source}" type="text/javascript"></script>\n'
    return "\n".join(r.value for r in spark.read.text(source, wholetext=True).collect()).strip()
