"""Audit rules for Solidity over functions and the state of their contracts. Word lists are fixed values."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quarry.functions.text import any_token, called_with, collapse
from quarry.operators.shared import shuffled

# Fixed values of the rules.
MONEY = ["totalsupply", "balance", "fee", "amount", "supply"]
TRANSFERS = [".transfer(", " transfer(", ".send(", ".call{value:", "withdraw(", "unstake("]
ORDER_TRANSFERS, ORDER_FETCHES = ["transfer", "withdraw", "unstake"], ["rebase", "fetch"]
RECEIVERS, POINTS = ["recieve", "take", "burn", "allowance", "balance", "point"], ["allowance", "balance", "point"]
MATH = [".mul", ".div", ".add", ".sub", "math.", "+", "-", "*", "/"]
COMMENT_WORDS = [" version ", " new ", " old "]
SIMILAR, LENGTH_GAP = 0.9, 0.2
#: Names of a group that are compared with all of the group in one place; larger groups are dealt out.
GROUP_PART = 200
#: Characters at most that a name is tried without, and how many comparisons a string that comes of it is worth.
DELETIONS, SUBSEQUENCE = 3, 8

def contracts_of(df: DataFrame) -> DataFrame:
    """The functions of Solidity contracts with their facts: state, statements, mutations, guards, transfers, computations."""
    body = F.col("body")
    df = df.withColumn("stmts", F.filter(F.transform(F.split(body, ";", -1), collapse), lambda x: x != ""))
    touched = lambda s: F.exists("state", lambda v: F.contains(s, v))
    return df.withColumns({
        "mutations": F.array_distinct(F.filter("stmts", lambda s: F.contains(s, F.lit("=")) & touched(s))),
        "conditionals": called_with(body, "if"),
        "requires": called_with(body, "require"),
        "asserts": called_with(body, "assert"),
        "transfers": F.array_distinct(F.filter("stmts", lambda s: any_token(s, TRANSFERS))),
        "computations": F.array_distinct(F.filter("stmts", lambda s: F.size(F.filter(F.array(*[F.lit(t) for t in MATH]), lambda t: F.contains(s, t))) >= 2)),
        "permissions": F.filter(F.split(F.trim("modifiers"), r"[\s(),]+"), lambda m: F.lower(m).rlike("only|owner|admin|role")),
        "has_inputs": F.trim("params") != "",
        "low": F.lower("fn_name"),
    }).withColumn("guards", F.concat("conditionals", "requires", "asserts"))


def _first(c: Column, test) -> Column:
    """The place of the first element that passes, or null."""
    return F.array_min(F.filter(F.transform(c, lambda x, i: F.when(test(x), i)), lambda x: x.isNotNull()))


def function_alerts(df: DataFrame, task: str | None = None) -> DataFrame:
    """Alerts of the rules that look at one function; of one of them, or of all."""
    c, low, name = F.col, F.col("low"), F.concat("type_name", F.lit("."), "fn_name")
    has = lambda x, t: F.contains(x, F.lit(t))
    none = F.array().cast("array<struct<task_id:string,detail:string>>")
    alert = lambda t, detail: F.struct(F.lit(t).alias("task_id"), detail.cast("string").alias("detail"))
    one = lambda t, when, detail=F.lit(""): (t, F.when(when, F.array(alert(t, detail))))
    each = lambda t, when, found: (t, F.when(when, F.transform(found, lambda x: alert(t, x))))
    open_ = (F.size("guards") == 0) & (F.size("permissions") == 0)
    money = F.filter("mutations", lambda m: any_token(F.lower(m), MONEY))
    stake, unstake = has(low, "stake") & ~has(low, "unstake"), has(low, "unstake")
    changed = lambda a, b: F.filter("mutations", lambda m: any_token(m, [a, b]))
    mint = any_token(low, ["mint", "burn"])
    body = F.lower("body")
    caught = F.substring(body, F.instr(body, "catch"), F.lit(1 << 30))
    moved, fetched = _first(c("stmts"), lambda s: any_token(s, ORDER_TRANSFERS)), _first(c("stmts"), lambda s: any_token(s, ORDER_FETCHES))
    last_moved = F.array_max(F.filter(F.transform("stmts", lambda s, i: F.when(any_token(s, ORDER_TRANSFERS), i)), lambda x: x.isNotNull()))
    unchecked = F.filter(F.array(*[F.lit(p) for p in POINTS]), lambda p: F.array_contains("state", p) & ~F.exists("guards", lambda g: F.contains(g, p)))
    math = F.flatten(F.transform("computations", lambda s: F.filter(F.array(
        F.when((has(F.lower(s), ".mul") & has(F.lower(s), ".div")) | (has(s, "*") & has(s, "/")), F.concat(F.lit("mul-div: "), s)),
        F.when(has(F.lower(s), ".div") | has(s, "/"), F.concat(F.lit("div: "), s)),
        F.when(has(F.lower(s), "math."), F.concat(F.lit("math: "), s)),
        F.when(has(s, "((") & any_token(F.lower(s), [".mul", ".div", ".sub", ".add"]), F.concat(F.lit("parentheses: "), s)),
    ), lambda x: x.isNotNull())))
    rules = [
        one("2", open_ & c("has_inputs") & (F.size(money) > 0), money[0]),
        one("3", stake, F.lit("stake")),
        one("3", unstake, F.lit("unstake")),
        each("3", F.lit(True), F.filter("stmts", lambda s: has(F.lower(s), " stake"))),
        each("3", F.lit(True), F.filter("stmts", lambda s: has(F.lower(s), " unstake"))),
        each("3", stake, changed("+=", " + ")),
        each("3", unstake, changed("-=", " - ")),
        one("4", mint & (c("visibility") == "external") & (F.size("permissions") == 0)),
        each("4", mint, c("guards")),
        each("4", has(low, "burn"), F.filter("stmts", lambda s: has(s, "address(0)"))),
        each("5", any_token(low, RECEIVERS) & ~has(low, "stake"), unchecked),
        one("6", has(body, "try") & has(body, "catch") & has(caught, "revert"), F.coalesce(F.filter("stmts", lambda s: has(F.lower(s), "revert"))[0], caught)),
        one("6", has(body, "try") & has(body, "catch") & (F.size("asserts") > 0), F.array_join("asserts", ", ")),
        each("7", F.lit(True), math),
        one("8", moved.isNotNull() & (fetched.isNull() | (fetched >= moved)), F.lit("no fetch before transfer")),
        one("8", fetched.isNotNull() & (last_moved.isNull() | (last_moved <= fetched)), F.lit("no transfer after fetch")),
        one("9", (F.size("guards") == 0) & F.exists("transfers", lambda s: any_token(F.lower(s), ["withdraw", "unstake", "transfer"])), c("transfers")[0]),
        one("11", (c("visibility") == "external") & c("has_inputs") & (F.size("mutations") > 0) & open_),
    ]
    found = df.select("path", "file_ord", "fn_ord", name.alias("function_name"), F.inline(F.concat(*[F.coalesce(r, none) for t, r in rules if task in (None, t)])))
    return found.select("path", "file_ord", "task_id", "fn_ord", "function_name", F.lit(0).alias("idx"), "detail", F.lit("").alias("statement"))


def type_alerts(df: DataFrame) -> DataFrame:
    """3: a contract that can stake and not unstake."""
    t = df.groupBy("path", "file_ord", "type_name").agg(F.bool_or(F.contains("low", F.lit("stake")) & ~F.contains("low", F.lit("unstake"))).alias("a"), F.bool_or(F.contains("low", F.lit("unstake"))).alias("b"))
    return t.where("a and not b").select("path", "file_ord", F.lit("3").alias("task_id"), F.lit(-1).alias("fn_ord"), F.col("type_name").alias("function_name"), F.lit(0).alias("idx"), F.lit("no unstake").alias("detail"), F.lit("").alias("statement"))


def comment_alerts(sources: DataFrame) -> DataFrame:
    """1: comments that tell of versions."""
    text = F.regexp_extract_all("content", F.lit(r"(?s)/\*.*?\*/|(?m:^[ \t]*//[^\n]*)"), 0)
    words = F.flatten(F.transform(text, lambda x: F.filter(F.array(*[F.lit(w) for w in COMMENT_WORDS]), lambda w: F.contains(x, w))))
    return sources.where("language = 'solidity'").select("path", "file_ord", F.lit("1").alias("task_id"), F.lit(-1).alias("fn_ord"), F.lit("").alias("function_name"), F.lit(0).alias("idx"), F.explode(F.transform(words, lambda w: F.trim(w))).alias("detail"), F.lit("").alias("statement"))


@pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two names are by their matching blocks; Spark has only edit distances, which differ."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _least_matches(la: Column, lb: Column) -> Column:
    """So many matching characters names of two lengths need at least for a ratio above SIMILAR."""
    near = F.floor(SIMILAR * (la + lb) / 2)
    return F.array_min(F.filter(F.sequence(near - 1, near + 2), lambda m: 2.0 * m / F.nullif(la + lb, F.lit(0)) > SIMILAR))


def _subsequences(name: Column, gone: Column) -> Column:
    """The different strings that a name becomes without ``gone`` of its characters, DELETIONS at most."""
    without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.length(s))))
    found = [F.array(name)]
    for _ in range(DELETIONS):
        found.append(F.array_distinct(F.flatten(F.transform(found[-1], without))))
    out = F.lit(None)
    for k in reversed(range(DELETIONS + 1)):
        out = F.when(gone == k, found[k]).otherwise(out)
    return out


def _ways(n: Column, gone: Column) -> Column:
    """How many subsequences a name of n characters has without ``gone`` of them; null beyond DELETIONS."""
    product = F.lit(1.0)
    out = F.when(gone == 0, product)
    for k in range(1, DELETIONS + 1):
        product = product * (n - (k - 1)) / k
        out = out.when(gone == k, product)
    return out


def _meeting(once: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Rows of once for every place ``_at`` where a name, as a or as b of a pair, meets others of its group.

    A small group meets as a whole. In a large one it depends on the two lengths: matching blocks are a common subsequence, so
    names that are alike enough share one of the least length that the ratio needs. Where the names of both lengths have few
    of these, they meet by them; else all names of the one length meet all of the other, dealt out by parts of the first.
    """
    own, other = (F.col("_len"), F.col("_n")), (F.col("_x.len"), F.col("_x.n"))
    (la, na), (lb, nb) = (own, other) if side == "a" else (other, own)
    least = _least_matches(la, lb)
    rows = once.select(*keys, "name", "_least", "_most", "_len", "_n", F.explode("_lens").alias("_x"))
    rows = rows.where(F.col("_x.len").isNull() | (least <= F.least(la, lb)))
    few = F.coalesce((na * _ways(la, la - least) + nb * _ways(lb, lb - least)) * SUBSEQUENCE < na * nb, F.lit(False))
    parts = F.ceil(na / GROUP_PART)
    part = F.array(F.pmod(F.xxhash64("name"), parts)) if side == "a" else F.sequence(F.lit(0).cast("long"), parts - 1)
    place = lambda x: F.xxhash64(la, lb, x)
    at = F.when(F.col("_x.len").isNull(), F.array(F.lit(0).cast("long"))).when(few, F.transform(_subsequences(F.col("name"), F.col("_len") - least), place)).otherwise(F.transform(part, place))
    return rows.select(*keys, F.col("name").alias(f"{side}_name"), F.col("_least" if side == "a" else "_most").alias(f"_{side}"), F.explode(at).alias("_at"))


def similar_names(names: DataFrame, keys: list[str]) -> DataFrame:
    """10: pairs of names of one contract and kind, in order of ``ord``, that are nearly the same.

    Every two different names of a group that may be alike are compared once, whatever the rows that have them. Names whose
    lengths or edit distance alone rule the ratio out are not compared: it is at most twice a common subsequence's length
    over the sum.
    """
    a, b = (names.select(*keys, F.col("name").alias(f"{k}_name"), F.col("ord").alias(f"{k}_ord")) for k in "ab")
    once = names.where("name is not null").groupBy(*keys, "name").agg(F.min("ord").alias("_least"), F.max("ord").alias("_most")).withColumn("_len", F.length("name").cast("long"))
    lens = once.groupBy(*keys, F.col("_len").alias("len")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("_all"), F.collect_list(F.struct("len", "n")).alias("_lens"))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("len"), F.lit(None).cast("long").alias("n")))
    mine = F.filter("_lens", lambda x: x["len"] == F.col("_len"))[0]["n"]
    once = once.join(shuffled(lens), keys).withColumns({"_n": mine, "_lens": F.when(F.col("_all") > GROUP_PART, F.col("_lens")).otherwise(whole)})
    la, lb = F.length("a_name"), F.length("b_name")
    least = _least_matches(la, lb)
    # each character that matches nothing is one edit at most
    edits = F.call_function("levenshtein", F.col("a_name"), F.col("b_name"), (la + lb - 2 * least).cast("int"))
    near = (least <= F.least(la, lb)) & ((la - lb) / F.nullif(F.greatest(la, lb), F.lit(0)) < LENGTH_GAP) & (edits >= 0)
    met = _meeting(once, keys, "a").join(shuffled(_meeting(once, keys, "b")), [*keys, "_at"]).where(F.col("_a") < F.col("_b")).where(near)
    alike = met.select(*keys, "a_name", "b_name").distinct().where(name_ratio("a_name", "b_name") > SIMILAR)
    return a.join(shuffled(alike), [*keys, "a_name"]).join(shuffled(b), [*keys, "b_name"]).where("a_ord < b_ord")


def name_alerts(df: DataFrame) -> DataFrame:
    functions = df.select("path", "file_ord", "type_name", F.lit("function").alias("kind"), F.col("fn_name").alias("name"), F.col("fn_ord").alias("ord"))
    state = df.select("path", "file_ord", "type_name", "state").distinct().select("path", "file_ord", "type_name", F.lit("variable").alias("kind"), F.posexplode("state").alias("ord", "name")).select("path", "file_ord", "type_name", "kind", "name", "ord")
    pairs = similar_names(functions.unionByName(state), ["path", "file_ord", "type_name", "kind"])
    return pairs.select("path", "file_ord", F.lit("10").alias("task_id"), F.lit(-1).alias("fn_ord"), F.col("type_name").alias("function_name"), F.lit(0).alias("idx"), F.concat("kind", F.lit(": "), "a_name", F.lit(", "), "b_name").alias("detail"), F.lit("").alias("statement"))


def solidity_alerts(sources: DataFrame, task: str | None, contracts: DataFrame) -> DataFrame:
    """Alerts over sources and the functions of their contracts; of one rule, or of all."""
    df = contracts_of(contracts)
    apart = {"1": lambda: comment_alerts(sources), "10": lambda: name_alerts(df)}
    if task in apart:
        return apart[task]()
    out = function_alerts(df, task)
    if task in (None, "3"):
        out = out.unionByName(type_alerts(df))
    for part in apart.values() if task is None else ():
        out = out.unionByName(part())
    return out
