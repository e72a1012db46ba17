"""Strings, paths and argument lines: Column expressions, and a parser for whole command lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    """All up to the last slash, without it; empty if there is none."""
    return F.regexp_extract(F.translate(path, "\\", "/"), r"^(.*)/[^/]*$", 1)


def father(path: Column) -> Column:
    return directory(directory(path))


def file_name(path: Column, extension: bool = True) -> Column:
    name = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    return name if extension else F.regexp_replace(name, r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def replace_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(f".{ext}"))


def revise(path: Column) -> Column:
    """Forward slashes, none doubled, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), "(.)/$", "$1")


def join_path(a: Column, b: Column) -> Column:
    return revise(F.concat_ws("/", a, b))


def skip_space(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\r\n]+", "")


def skip_until(s: Column, stop: str) -> Column:
    """From the first character of stop on; empty if there is none."""
    return F.regexp_extract(s, f"([{re.escape(stop)}].*)$", 1)


def first_word(s: Column) -> Column:
    return F.regexp_extract(s, r"^[ \t\r\n]*([^ \t\r\n]*)", 1)


def trim_spaces(s: Column) -> Column:
    """Without blanks, tabs and line ends at either end."""
    return F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def find_match(s: Column, left: str, right: str, open_at_start: int = 0) -> Column:
    """Place (from 0) of the right mark that closes what is open, or -1: depth is carried along the characters."""
    start = F.struct(F.lit(open_at_start).alias("depth"), F.lit(-1).alias("found"), F.lit(0).alias("at"))

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch == left, 1).when(ch == right, -1).otherwise(0)
        closed = (a["found"] < 0) & (ch == right) & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(closed, a["at"]).otherwise(a["found"]).alias("found"), (a["at"] + 1).alias("at"))

    return F.aggregate(F.split(s, ""), start, step, lambda a: a["found"])


def find_pair(s: Column, a: str, b: str) -> Column:
    """Place (from 0) of the first a that b follows, or -1."""
    return F.expr("0") + F.instr(s, a + b) - 1


def to_text(b: Column, charset: str = "UTF-8") -> Column:
    return F.decode(b, charset)


def to_bytes(s: Column, charset: str = "UTF-8") -> Column:
    return F.encode(s, charset)


_TOKEN = re.compile(r'"((?:%.|[^"%])*)"|(\S+)', re.S)
_NUMBER = re.compile(r"-\d*\.?\d")


def parse_arguments(line: str) -> dict[str, list[str]]:
    """An argument line as name -> values: `-name` opens a name, what stands before any name is #0, #1, ...; quotes hold blanks together, % makes the next character plain, <...> is a comment, and a minus before a digit is a number's."""
    out: dict[str, list[str]] = {}
    name = None
    for m in _TOKEN.finditer(re.sub(r"<[^>]*>", " ", line)):
        quoted, bare = m.group(1), m.group(2)
        word = re.sub(r"%(.)", r"\1", quoted if quoted is not None else bare, flags=re.S)
        if quoted is None and bare.startswith("-") and len(bare) > 1 and not _NUMBER.match(bare):
            name = word[1:]
            out.setdefault(name, [])
        elif name is None:
            out[f"#{sum(k.startswith('#') for k in out)}"] = [word]
        else:
            out[name].append(word)
    return out


def argument(args: Column, name: str, kind: str, default=None) -> Column:
    """First value of a name in a map of lists, as a type, or the default. For boolean: + and a bare flag are true, - is false."""
    values = F.try_element_at(args, F.lit(name))
    first = F.get(values, F.lit(0))
    if kind == "boolean":
        found = F.when(values.isNotNull() & (F.size(values) == 0), F.lit(True)).when(first == "+", F.lit(True)).when(first == "-", F.lit(False)).otherwise(first.try_cast("boolean"))
    else:
        found = first.try_cast(kind)
    return F.coalesce(found, F.lit(default).cast(kind))


def with_defaults(args: Column, defaults: Column) -> Column:
    """Arguments, and the defaults of the names that they lack."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(args, k)), args)


def flag_value(names: Column, flags: list[tuple[str, int]], default: int = 0) -> Column:
    """Value of a flag: an exact name first, else the most recently set pattern (a name that ends in *) that it begins with, else the default."""
    exact = {n: v for n, v in flags if not n.endswith("*")}
    out = F.lit(default)
    for n, v in flags:
        if n.endswith("*"):
            out = F.when(names.startswith(n[:-1]), F.lit(v)).otherwise(out)
    for n, v in exact.items():
        out = F.when(names == n, F.lit(v)).otherwise(out)
    return out


def number_in_name(name: Column) -> Column:
    """The first whole number in a file name, or null."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("long")


def fixed(v: Column, places: int) -> Column:
    """A number with a fixed count of decimals, rounded from its exact binary value as printf does (format_string rounds its shortest decimal form half up)."""
    named = F.when(F.isnan(v), F.lit("nan")).when(v == float("inf"), F.lit("inf")).when(v == float("-inf"), F.lit("-inf"))
    return named.otherwise(F.call_function("format_number", v, F.lit("0." + "0" * places)))


def lines(text: Column) -> Column:
    """The lines of a text, without their ends; a line end at the text's end opens no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")


def split_at(text: Column, char: str) -> Column:
    """The parts of a text between single characters, empty ones included."""
    return F.split(text, re.escape(char))


def config_text(text: Column) -> Column:
    """The lines of a configuration as one line of arguments: blanks before them, blank lines and lines of a // comment are left out."""
    kept = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+", "")), lambda x: (x != "") & ~x.startswith("//"))
    return F.array_join(kept, " ")
