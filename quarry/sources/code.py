"""Source files as tables: sources (path, file_ord, language, content) and functions of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import text as T
from quarry.operators import shared
from quarry.operators.frames import ranked

SOURCES = "path string, file_ord int, language string, content string"
FUNCTIONS = "path string, file_ord int, language string, type_name string, fn_ord int, fn_name string, visibility string, params string, signature string, body string"

#: Languages by suffix.
LANGUAGES = {".sol": "solidity", ".c": "c", ".h": "c", ".rs": "rust"}

#: Words before a parenthesis and a brace that name no C function.
NOT_FUNCTIONS = {"if", "for", "while", "switch", "do", "else", "return", "case", "typedef", "struct", "enum", "union", "sizeof", "alignof", "offsetof", "assert", "FD_TEST", "FD_LIKELY", "FD_UNLIKELY", "defined", "extern"}


def read_sources(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """All source files below a path that Spark can list, numbered in order of their paths.

    Bytes that are no UTF-8 are replaced; strict: they fail the read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    language = F.lit(None).cast("string")
    for suffix, name in LANGUAGES.items():
        language = F.when(T.extension(F.col("path")) == suffix, name).otherwise(language)
    text = (F.validate_utf8 if strict else F.make_valid_utf8)(F.col("content").cast("string"))
    files = files.select("path", language.alias("language"), text.alias("content")).where("language is not null")
    # paths alone are put in order, contents stay where they are
    places = ranked(files.select("path"), ["path"], "nth").select("path", (F.col("nth") - 1).cast("int").alias("file_ord"))
    return files.join(places, "path").select("path", "file_ord", "language", "content")


#: Fixed value: the file that names the members of a bundle.
MANIFEST = "bundle_manifest.json"


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """The files of what is to be analysed: those that a bundle's manifest names, in order of their paths, or what lies below the path.

    A member without a file, or a manifest without members, is an error (``invalid_path``).
    """
    manifest = f"{path.rstrip('/')}/{MANIFEST}"
    if not shared.exists(spark, manifest):
        return read_sources(spark, path)
    files = read_sources(spark, path)
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("^" + re.escape(re.sub("^file:/+", "/", path.rstrip("/"))) + "/"), F.lit(""))
    named = spark.read.option("multiLine", True).json(manifest)
    return bundle_members(named, files.withColumn("path", below)).select("path", "file_ord", "language", "content")


def bundle_members(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The files (path, ...) that a manifest (members: array of structures with a path) names, in order of their paths.

    Blank paths are passed over. A member without a file, or no member at all, is an error (``invalid_path``).
    """
    wanted = manifest.select(F.explode("members.path").alias("path")).where("coalesce(path, '') <> ''").distinct()
    both = wanted.join(files.withColumn("_found", F.lit(True)), "path", "left")
    missing = both.where("_found is null").agg(F.min("path")).first()[0]
    if missing is not None:
        raise ValueError(f"invalid_path: bundle member is missing: {missing}")
    if not wanted.limit(1).count():
        raise ValueError("invalid_path: the manifest names no files")
    return both.drop("_found").orderBy("path")


def stem(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def without_comments(text: str) -> str:
    """The text with comments as spaces; line ends stay, so places do as well."""
    return re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def without_solidity_comments(text: str) -> str:
    """As without_comments, but what looks like a comment inside a quoted string stays."""
    pattern = r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|/\*.*?\*/|//[^\n]*"""
    return re.sub(pattern, lambda m: m[1] or re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def partner(text: str, at: int, pair: str = "{}") -> int:
    """The place of the bracket that closes the one at ``at``; the text's length if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(text)


def c_functions(text: str) -> Iterator[tuple[str, str, str, str, str]]:
    """(name, visibility, params, signature, body); a function is static or seen from outside."""
    clean = without_comments(text)
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(([^;{]*?)\)\s*(?:FD_FN_\w+\s*)*\{", clean):
        begin = max(clean.rfind(c, 0, m.start()) for c in ";{}") + 1
        words = re.findall(r"[\w*]+", re.sub(r"(?m)^[ \t]*#.*$", "", clean[begin : m.start()]))
        if m[1] in NOT_FUNCTIONS or not words or words[-1] in NOT_FUNCTIONS | {"="}:
            continue
        yield m[1], "internal" if "static" in words else "external", m[2], m[0][:-1].strip(), clean[m.end() : partner(clean, m.end() - 1)]


def rust_functions(text: str) -> Iterator[tuple[str, str, str, str, str]]:
    """Public functions; those of pub(crate) have that visibility."""
    clean = without_comments(text)
    for m in re.finditer(r"\bpub(\([^)]*\))?\s+fn\s+(\w+)\s*\(", clean):
        close = partner(clean, m.end() - 1, "()")
        brace = clean.find("{", close)
        if brace < 0:
            continue
        yield m[2], "crate" if "crate" in (m[1] or "") else "external", clean[m.end() : close].strip(), clean[m.start() : brace], clean[brace + 1 : partner(clean, brace)]


READERS = {"c": c_functions, "rust": rust_functions}


def functions_of(sources: DataFrame) -> DataFrame:
    """A row for each function, in the order of the file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FUNCTIONS.split(", ")]
        for frame in frames:
            rows = []
            for s in frame.itertuples():
                for k, (name, visibility, params, signature, body) in enumerate(READERS[s.language](s.content or "")):
                    rows.append((s.path, s.file_ord, s.language, stem(s.path), k, name, visibility, params, signature, body))
            yield pd.DataFrame(rows, columns=names)

    return sources.where(F.col("language").isin(*READERS)).mapInPandas(run, FUNCTIONS)


def statements_of(functions: DataFrame, separators: str = r"[;\n]") -> DataFrame:
    """A row for each statement with its place among those kept."""
    keys = ("path", "file_ord", "type_name", "fn_ord", "fn_name")
    return functions.select(*keys, F.posexplode(T.statements(F.col("body"), separators)).alias("idx", "stmt"))


def lines_of(sources: DataFrame) -> DataFrame:
    """A row for each line, numbered from 1."""
    return sources.select("path", "file_ord", "language", F.posexplode(F.split("content", r"\r?\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


CONTRACTS = "path string, file_ord int, type_name string, parents array<string>, state array<string>, fn_ord int, fn_name string, visibility string, params string, modifiers string, body string, objects array<string>, interfaces array<string>"

#: Types whose variables count as state; longer names such as uint256 don't.
STATE_TYPES = r"\b(?:string|uint|mapping|address|bytes)\b"


def contract_rows(text: str) -> Iterator[tuple]:
    """(contract, parents, state, place, function, visibility, params, modifiers, body, objects, interfaces) of each function.

    objects: variables of a contract whose type is a contract before it; interfaces: those of the file that its code names.
    """
    clean = without_solidity_comments(text)
    heads_of_types = list(re.finditer(r"\b(contract|library|interface)\s+(\w+)(?:\s+is\s+([^{]*))?\s*\{", clean))
    named = list(dict.fromkeys(m[2] for m in heads_of_types if m[1] == "interface"))
    before: list[str] = []
    for m in heads_of_types:
        inside = clean[m.end() : partner(clean, m.end() - 1)]
        heads = list(re.finditer(r"\b(?:function\s+(\w+)|(constructor))\s*\(", inside))
        outer, found, at = [], [], 0
        for h in heads:
            if h.start() < at:
                continue
            close = partner(inside, h.end() - 1, "()")
            stop = min((inside.find(x, close) for x in "{;" if inside.find(x, close) >= 0), default=len(inside))
            end = partner(inside, stop) if inside[stop : stop + 1] == "{" else stop
            modifiers = " ".join(inside[close + 1 : stop].split())
            seen = re.search(r"\b(public|external|internal|private)\b", modifiers)
            found.append((h[1] or h[2], seen[1] if seen else "", inside[h.end() : close], modifiers, inside[stop : end + 1] if end > stop else ""))
            outer.append(inside[at : h.start()])
            at = end + 1
        outer.append(inside[at:])
        state, objects = [], []
        for s in re.split(r"[;{}]", "".join(outer)):
            word = re.match(r"\s*(\w+)", s)
            mine = state if re.match(rf"\s*{STATE_TYPES}", s) else objects if word and word[1] in before else None
            if mine is not None:
                name = re.search(r"(\w+)\s*$", s.split("=")[0] if "=>" not in s else re.split(r"(?<!=)=(?!>)", s)[0])
                if name:
                    mine.append(name[1])
        parents = [p.strip().split("(")[0] for p in (m[3] or "").split(",") if p.strip()]
        interfaces = [i for i in named if i != m[2] and i in m[0] + inside]
        if m[1] == "contract":
            before.append(m[2])
        for k, f in enumerate(found):
            yield (m[2], parents, state, k, *f, objects, interfaces)


def solidity_contracts(sources: DataFrame) -> DataFrame:
    """A row for each function of each contract, with the contract's parents and state variables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CONTRACTS.split(", ")]
        for frame in frames:
            yield pd.DataFrame([(s.path, s.file_ord, *r) for s in frame.itertuples() for r in contract_rows(s.content or "")], columns=names)

    return sources.where("language = 'solidity'").mapInPandas(run, CONTRACTS)
