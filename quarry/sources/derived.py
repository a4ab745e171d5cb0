"""Source files derived from the table of suppliers, so that audits run over as much code as there are rows.

Each supplier has a project: a C file, a C registry, a Rust contract, a Rust file and a Solidity file. They are made of the
corpus' functions and lines, of which a supplier's key chooses some, and of a function with its key and nation. ``sql``
describes the same files to a database that has never seen a parser: the functions that stand in a file are known from how it
was put together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators.c_rules import RESERVED_KEYS
from quarry.sources import corpus


#: Suppliers whose files one task writes.
SUPPLIERS = 1000


@dataclass(frozen=True)
class File:
    """head, chosen chunks with a separator, tail; chunk i stays unless key + i is divisible by ``skip``. @K is the key, @N the nation."""

    name: str
    language: str
    ord: int
    head: str
    chunks: tuple[str, ...]
    tail: str = "\n"
    separator: str = "\n"
    skip: int = 4


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _blocks(text: str) -> tuple[str, ...]:
    """Pieces that begin at a line without indentation."""
    return tuple(re.split(r"\n(?=\S)", text.strip("\n")))


_C = _blocks(corpus.C_RULES)
_RUST = re.findall(r"(?:    #\[[^\n]*\n)?    pub[^\n]*", corpus.RUST_CONTRACT)
_SOL = re.findall(r"    function [^\n]*", corpus.SOLIDITY)
_SOL_HEAD = corpus.SOLIDITY[: corpus.SOLIDITY.index("    function ")]
FILES = {
    "c": File("rules.c", "c", 0, "/* project @K */\n#include \"util.c\"\n", (*_C[2:], "static void row_@K( void ) { long total = rent_due + @N; }")),
    "registry": File("registry.c", "c", 1, "static char const * fd_pack_unwritable[] = { ", tuple(f'"{k}"' for k in RESERVED_KEYS), " };\n", ", ", 3),
    "contract": File("lib.rs", "rust", 2, "// project @K\n#[contractimpl]\nimpl Vault {\n", (*_RUST, "    pub fn row_@K(env: Env, v: Vec<u32>) { let n = @N; panic!(\"@K\"); }"), "\n}\n"),
    "file": File("main.rs", "rust", 3, "", (*corpus.RUST_FILE.rstrip("\n").split("\n"), "static mut ROW_@K: u32 = @N;", "fn row() -> u32 { let p = &ROW_@K; *p }"), "\n", "\n", 5),
    "solidity": File("Vault.sol", "solidity", 4, _SOL_HEAD.replace("    uint256 unseen;", "    /* a new nation: @N */ uint256 unseen;"), (*_SOL, "    function row_@K(uint v) public { point = v + @N; }"), "\n}\ninterface Thing { function plain(uint v) external; }\n"),
}


def sources(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The files (path, file_ord, language, content) of all suppliers, of some kinds or of all."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")

    def one(f: File):
        chunks = F.filter(F.array(*[F.lit(c) for c in f.chunks]), lambda x, i: F.pmod(key + i, F.lit(f.skip)) != 0)
        text = F.concat(F.lit(f.head), F.array_join(chunks, f.separator), F.lit(f.tail))
        for mark, c in (("@K", key), ("@N", F.col("s_nationkey"))):
            text = F.replace(text, F.lit(mark), c.cast("string"))
        return F.struct(F.concat(F.lit("p"), key.cast("string"), F.lit(f"/{f.name}")).alias("path"), F.lit(f.ord).alias("file_ord"), F.lit(f.language).alias("language"), text.alias("content"))

    files = [one(FILES[k]) for k in kinds or FILES]
    # five texts for each row of a small file: more tasks than the table's own, by its rows
    parts = -(-suppliers.count() // SUPPLIERS)
    if parts > 1:
        suppliers = suppliers.repartition(parts, "s_suppkey")
    return suppliers.select(F.explode(F.array(*files)).alias("f")).select("f.*")


def sql(kind: str) -> str:
    """Common tables: x (path, k, i, chunk) for the chunks that stand in a file, and f (path, k, content)."""
    f = FILES[kind]
    rows = ", ".join(f"({i}, {_literal(c)})" for i, c in enumerate(f.chunks))
    fill = lambda c: f"replace(replace({c}, '@K', s_suppkey::varchar), '@N', s_nationkey::varchar)"
    return f"""x as materialized (select 'p' || s_suppkey || '/{f.name}' as path, s_suppkey as k, i, {fill('c')} as chunk from supplier, (values {rows}) v(i, c) where (s_suppkey + i) % {f.skip} <> 0),
f as materialized (select 'p' || s_suppkey || '/{f.name}' as path, s_suppkey as k, {fill(_literal(f.head))} || coalesce(c, '') || {_literal(f.tail)} as content from supplier left join (select k, string_agg(chunk, {_literal(f.separator)} order by i) as c from x group by k) g on g.k = s_suppkey)"""


def functions_sql(kind: str) -> str:
    """A table t (path, i, name, visibility, params, signature, body) of a file's functions, each the only one of its chunk."""
    body = "regexp_extract(chunk, '(?s)\\{(.*)\\}', 1)"
    if kind == "c":
        return rf"t as (select path, i, regexp_extract(chunk, '(\w+)\s*\(', 1) as name, case when starts_with(chunk, 'static') then 'internal' else 'external' end as visibility, regexp_extract(chunk, '\(([^)]*)\)', 1) as params, '' as signature, {body} as body from x)"
    if kind == "contract":
        return rf"t as (select path, i, regexp_extract(chunk, 'fn (\w+)\(', 1) as name, case when contains(chunk, 'pub(crate)') then 'crate' else 'external' end as visibility, trim(regexp_extract(chunk, 'fn \w+\(([^)]*)\)', 1)) as params, regexp_extract(chunk, '(?s)(pub.*?)\{{', 1) as signature, {body} as body, content from x join f using (path))"
    heads = r"trim(regexp_replace(regexp_extract(chunk, 'function \w+\([^)]*\)([^{]*)\{', 1), '\s+', ' ', 'g'))"
    state = "['balance', 'point', 'owner', 'nameOfVault', 'nameOfVaults', 'shares']"
    return rf"""t as (select path, 'Vault' as type_name, ['Base', 'Named'] as parents, {state} as state, i as fn_ord, regexp_extract(chunk, 'function (\w+)', 1) as name,
  regexp_extract({heads}, '\b(public|external|internal|private)\b', 1) as visibility, regexp_extract(chunk, 'function \w+\(([^)]*)\)', 1) as params, {heads} as modifiers, '{{' || {body} || '}}' as body from x
  union all select path, 'Thing', [], [], 0, 'plain', 'external', 'uint v', 'external', '' from f)"""
