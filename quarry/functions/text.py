"""Text kernels as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\t\n\x0B\f\r ]+", " "))


def statements(c: Column, separators: str = r"[;\n]", longer_than: int = 2) -> Column:
    """The statements of a body, in order: pieces between separators, collapsed, that are longer than some characters."""
    return F.filter(F.transform(F.split(c, separators, -1), collapse), lambda x: F.length(x) > longer_than)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def any_token(c: Column, tokens: list[str]) -> Column:
    """Whether any of the tokens is a substring."""
    found = F.lit(False)
    for t in tokens:
        found = found | F.contains(c, F.lit(t))
    return found


def call_tokens(c: Column, skip: list[str]) -> Column:
    """Names that are called, without those to skip, each once in order of its first call."""
    return F.array_distinct(F.array_except(F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)[ \t\n\r]*\("), 1), F.array(*[F.lit(s) for s in skip])))


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/", -1), -1)


def extension(c: Column) -> Column:
    """The lower-cased suffix of a file name with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(c), r"[^.](\.[^.]+)$", 1))


def safe_token(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def short_digest(c: Column, n: int) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))


def first_braces(c: Column) -> Column:
    """What the first { and its partner enclose, or all that follows where the partner is missing; empty without a {.

    A fold over the pieces that end with a brace keeps depth and both ends, so nesting of any depth is right.
    """
    pieces = F.split(c, "(?<=[{}])", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("close"))

    def step(s: Column, piece: Column) -> Column:
        up, down = F.endswith(piece, F.lit("{")), F.endswith(piece, F.lit("}")) & (s.depth > 0)
        at = s.at + F.length(piece)
        live = s.close == 0
        depth = F.when(live & up, s.depth + 1).when(live & down, s.depth - 1).otherwise(s.depth)
        return F.struct(
            depth.alias("depth"),
            at.alias("at"),
            F.when(live & up & (s.open == 0), at).otherwise(s.open).alias("open"),
            F.when(live & down & (s.depth == 1), at).otherwise(s.close).alias("close"),
        )

    def body(s: Column) -> Column:
        stop = F.when(s.close > 0, s.close).otherwise(s.at + 1)
        return F.when(s.open > 0, F.substring(c, s.open + 1, stop - s.open - 1)).otherwise("")

    return F.when(F.contains(c, F.lit("{")), F.aggregate(pieces, start, step, body)).otherwise("")


def balanced(c: Column, pair: str = "()") -> Column:
    """c up to the bracket that closes its first one, whatever the nesting; empty if there is none or it stays open."""
    pieces = F.split(c, f"(?<=[\\{pair[0]}\\{pair[1]}])", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("close"))

    def step(s: Column, piece: Column) -> Column:
        at = s.at + F.length(piece)
        depth = s.depth + F.when(F.endswith(piece, F.lit(pair[0])), 1).when(F.endswith(piece, F.lit(pair[1])) & (s.depth > 0), -1).otherwise(0)
        ends = (s.close == 0) & (s.depth == 1) & (depth == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(ends, at).otherwise(s.close).alias("close"))

    return F.when(F.contains(c, F.lit(pair[0])), F.aggregate(pieces, start, step, lambda s: F.left(c, s.close))).otherwise("")


def after_each(c: Column, pattern: str, mark: str) -> Column:
    """What follows each match of a pattern, to the end; later matches show as ``mark``."""
    pieces = F.split(c, pattern, -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda _, i: F.array_join(F.slice(pieces, i + 2, F.size(pieces)), mark))


def called_with(c: Column, word: str) -> Column:
    """What stands between the parentheses after each ``word``, of any nesting."""
    spans = F.transform(after_each(c, rf"\b{word}\s*(?=\()", word), lambda x: balanced(x))
    return F.transform(F.filter(spans, lambda x: x != ""), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
