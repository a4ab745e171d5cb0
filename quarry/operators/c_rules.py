"""Audit rules for C: predicates over statements and their neighbours.

All of a file's statement rules are evaluated in one pass: flags first, then every frame over one sort by function, then
one alert array that is exploded. Word lists and patterns are fixed values: results depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.text import after_each, any_token, balanced
from quarry.operators import frames

ALERTS = ("path", "file_ord", "task_id", "fn_ord", "function_name", "idx", "detail", "statement")

# Fixed values of the rules.
UNSIGNED_CAST = r"\(\s*(?:ulong|uint64_t|uint32_t|uint16_t|uint8_t|unsigned\s+long|unsigned\s+int|unsigned\s+short)\s*\)"
SATURATING = ["fd_rust_cast", "fd_saturating", "fd_uint_sat", "fd_ulong_sat"]
OUTSIDE_POINTER = r"(?:pkt|hdr|frame|msg|buf|conn|stream|quic|net|peer)\s*->\s*\w+"
SHIFT_BOUNDS = ["< 64", "<64", "<= 63", "<=63", "& 0x3f", "&0x3f", "& 63", "&63", "% 64", "%64"]
CRITICAL_CALLS = ["fd_sha256", "fd_sha512", "fd_sha3", "fd_hmac", "fd_ed25519_verify", "fd_ecdsa_verify", "fd_workspace_alloc", "fd_quic_", "fd_rng_", "verify", "authenticate", "decrypt", "encrypt"]
CALL_GUARDS = ["if", "return", "FD_TEST", "FD_LIKELY", "FD_UNLIKELY", "assert"]
RELEASE = r"(?:fd_\w+_release|fd_wksp_free|fd_alloc_free|fd_pool_release)\s*\(\s*(\w+)"
REGISTRY = r"(?i)fd_pack_unwritable|unwritable_accts|unwritable_accounts"
RESERVED_KEYS = [
    "SysvarC1ock11111111111111111111111111111111",
    "SysvarRecentB1ockHashes11111111111111111111",
    "SysvarRent111111111111111111111111111111111",
    "SysvarStakeHistory1111111111111111111111111",
    "SysvarEpochSchedu1e111111111111111111111111",
    "SysvarFees111111111111111111111111111111111",
    "Sysvar1nstructions1111111111111111111111111",
    "SysvarS1otHashes111111111111111111111111111",
    "SysvarS1otHistory11111111111111111111111111",
    "11111111111111111111111111111111",
    "Vote111111111111111111111111111111111111111",
]
DECODE_CAST = r"=\s*\(\s*(?:void\s*\*|fd_\w+_fn_t\s*\*?|\w+\s*\*)\s*\)"
FLAG_FIELDS = ["executable", "writable", "is_native", "is_signer", "is_invoked", "is_writable", "signed", "readable"]
FLAG_MASK = r"\b(\w+)\s*&\s*(?:0x1|1)(?!\d)"
FLAG_SAFE = ["!!", "(bool)", "(int)(bool)", "fd_bool_if", "? 1 : 0"]
FRAME_WORK = r"(?i)(?:parse|handle|process)[_\w]*\s*\(.*(?:frame|packet)|(?:frame|packet).*(?:parse|handle|process)"
FRAME_BUDGET = ["MAX_FRAMES", "max_frames", "frame_count", "frame_limit", "frames_per_packet", "frame_budget", "fd_quic_max_frame", "frame_cap", "frame_remaining"]
HANDSHAKE_POOL = r"hs_pool|handshake_pool|fd_quic_hs|conn_hs"
POOL_FULL = r"==\s*NULL|==\s*0\b|is_full|pool_full|\bfull\b|\bbusy\b|ERR_BUSY|ERR_FULL"
EVICTION = ["evict", "oldest", "lru", "lifo", "expire", "reclaim", "displace"]
ATOMICS = ["__atomic_", "__sync_", "fd_bank_ref_", "CAS", "XADD", "atomic_fetch", "InterlockedIncrement"]
COUNT_FIELDS = ["ref_cnt", "ref_count", "bank_ref", "refcnt", "ref"]
LOCKS = ["lock", "mutex", "spin", "guard", "sync"]
RING_PRIVATE, RING_SHARED = ["private", "local", "tile->", "per_tile"], ["shared", "global", "common"]
TILES = ["tile", "exec", "replay", "store"]
TABLE_WORDS = ["deactivation_slot", "alt_slot", "lookup_table", "lut_slot", "alt_deactivat", "lut_deactivat"]
TABLE_WINDOW = 512
HALT = ["poh_halt", "halt_poh", "fd_poh_halt", "poh_pause"]
FLUSH = ["shred_flush", "flush_shred", "fd_shred_flush"]
UPDATE = ["update_sign_tile", "set_identity", "update_signer", "set_signer", "keyswitch_update_sign", "sign_tile_update"]
AGGREGATE = r"(?i)bls(?:12)?_(?:aggregate|sum|acc|pk_add)|g1_(?:sum|add)|pk_(?:aggregate|sum)|aggregate_pk|aggregate_key"
POSSESSION = ["verify_pop", "check_pop", "bls_verify_pop", "proof_of_possession", "pop_verify", "validate_pop", "fd_bls_pop"]
WRONG_CODES = ["ERR_NOT_FOUND", "ERR_INVALID", "ERR_UNKNOWN", "ACCOUNT_NOT_FOUND", "ERR_PROGRAM_NOT_FOUND"]
SIGNED = ["int ", "long ", "ssize_t", "ptrdiff_t"]
OVERFLOW_SAFE = ["__builtin_add_overflow", "__builtin_sub_overflow", "__builtin_mul_overflow", "fd_uint_add_sat", "fd_long_add_sat", "fd_long_mul_sat", "checked_add", "checked_mul"]
CONSENSUS = ["runtime", "rent", "reward", "balance", "lamport", "stake"]
EFFECTS = ["update", "set_", "write", "store", "hash", "commit", "apply", "mutate", "push", "pop"]
WIRE = ["buffer", "buf", "packet", "wire", "disk", "shred", "account"]
ROUNDING_SAFE = ["div_euclidean", "fd_long_div_euclidean", "fd_div_floor"]
SIGNED_MATH = [*SIGNED, "debt", "offset", "balance"]
VM_CAST = r"\*\s*\([^)]*\*\)\s*\([^)]*(?:addr|offset)[^)]*\)"
ALIGNED = ["& 0x7", "& 7", "% 8", "unaligned", "is_aligned", "align_check"]

_FLOAT = r"(?<![A-Za-z0-9_])(?:\d+[eE][+-]?\d+|\d+\.\d*|\d*\.\d+)[fFlL]?(?![A-Za-z0-9_])|\b\w*_(?:double|float)\b|^[df]$|(?i:\b(?:double|float)\b)"


def _operand(rest: Column) -> Column:
    """What a cast applies to: a parenthesis, of any nesting, or a name with its members and call."""
    inner = balanced(rest)
    name = F.regexp_extract(rest, r"^[A-Za-z_]\w*(?:->[A-Za-z_]\w*)*", 0)
    tail = F.substring(rest, F.length(name) + 1, F.length(rest))
    return F.when(F.startswith(rest, F.lit("(")), F.when(inner != "", inner).otherwise(rest)).when((name != "") & F.startswith(tail, F.lit("(")), F.concat(name, balanced(tail))).otherwise(name)


def _arguments(c: Column) -> Column:
    """The arguments between the first ( and the last ), parted at commas outside inner parentheses."""
    inner = F.regexp_extract(c, r"\((.*)\)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, ch: Column) -> Column:
        depth = F.when(ch == "(", s.depth + 1).when(ch == ")", F.greatest(s.depth - 1, F.lit(0))).otherwise(s.depth)
        cut = (ch == ",") & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s.now, ch)).alias("now"), F.when(cut, F.array_append(s.done, F.trim(s.now))).otherwise(s.done).alias("done"))

    whole = F.aggregate(F.split(inner, ""), start, step, lambda s: F.when(F.trim(s.now) != "", F.array_append(s.done, F.trim(s.now))).otherwise(s.done))
    return F.when(F.contains(inner, F.lit(",")), whole).otherwise(F.array().cast("array<string>"))


def statement_alerts(statements: DataFrame, task: str | None = None) -> DataFrame:
    """Alerts of the rules that look at a statement and those around it; of one of them, or of all."""
    keys, order = ["path", "fn_ord"], ["idx"]
    s, low = F.col("stmt"), F.col("low")
    near = lambda flag, a, b: frames.frame_flag(flag, keys, order, a, b)
    df = statements.withColumn("low", F.lower(s))
    ring = F.trim(F.regexp_extract(s, r"\bio_uring_submit\s*\(\s*([^),]*)", 1))
    bare = F.regexp_extract(s, r"^(\w+)\s*\(", 1)
    mask = F.regexp_extract(s, FLAG_MASK, 1)
    operands = F.transform(after_each(s, UNSIGNED_CAST + r"\s*", "(unsigned)"), _operand)
    guarded = F.lit(False)
    for g in CALL_GUARDS:
        guarded = guarded | F.startswith(s, F.lit(g))
    constants = F.filter(F.regexp_extract_all(s, F.lit(r"(?:>|>=|<|<=)\s*(\d+)\b"), 1), lambda x: x.cast("decimal(38,0)") != TABLE_WINDOW)
    counts = F.filter(F.regexp_extract_all(s, F.lit(r"(?:->|\.)(\w+)\s*(?:\+\+|--)"), 1), lambda x: x.isin(COUNT_FIELDS))
    effects = F.filter(_arguments(s), lambda a: any_token(F.lower(F.regexp_extract(a, r"\b([A-Za-z_]\w*)\s*\(", 1)), EFFECTS))
    one = lambda t, when: (t, F.when(when, F.array(F.struct(F.lit(t).alias("task_id"), F.lit("").alias("detail")))))
    each = lambda t, when, found: (t, F.when(when, F.transform(found, lambda x: F.struct(F.lit(t).alias("task_id"), x.alias("detail")))))
    rules = [
        one("101", s.rlike(UNSIGNED_CAST) & ~any_token(s, SATURATING) & F.exists(operands, lambda o: F.trim(o).rlike(_FLOAT))),
        one("102", s.rlike("<<|>>") & s.rlike(OUTSIDE_POINTER) & ~any_token(s, SHIFT_BOUNDS) & ~near(any_token(s, SHIFT_BOUNDS), -3, -1)),
        each("103", any_token(s, CRITICAL_CALLS) & ~s.rlike(r"=\s*\w+\s*\(") & ~guarded & any_token(bare, CRITICAL_CALLS), F.array(bare)),
        one("106", s.rlike(r"->\s*decode\s*=") & s.rlike(DECODE_CAST)),
        each("107", mask.isin(FLAG_FIELDS) & ~any_token(s, FLAG_SAFE), F.array(mask)),
        one("108", s.rlike(FRAME_WORK) & near(s.rlike(r"\b(?:while|for)\b"), -5, -1) & ~near(any_token(s, FRAME_BUDGET), -5, 2)),
        one("109", s.rlike(HANDSHAKE_POOL) & near(s.rlike(POOL_FULL), -1, 5) & ~near(any_token(low, EVICTION), -1, 5)),
        each("110", ~any_token(s, ATOMICS), counts),
        each("111", s.rlike(r"\bio_uring_submit\s*\([^)]*\)") & ~any_token(F.lower(ring), RING_PRIVATE) & ~near(any_token(low, LOCKS), -2, 0) & (any_token(F.lower(ring), RING_SHARED) | F.max(any_token(low, TILES)).over(Window.partitionBy(*keys))), F.array(ring)),
        each("112", any_token(s, TABLE_WORDS), constants),
        one("114", s.rlike(AGGREGATE) & ~near(any_token(s, POSSESSION), -6, 6)),
        one("116", any_token(s, SIGNED) & s.rlike(r"[+\-*]") & ~any_token(s, OVERFLOW_SAFE) & any_token(low, CONSENSUS)),
        one("117", F.size(effects) >= 2),
        one("118", F.contains(low, F.lit("struct")) & F.contains(s, F.lit("{")) & ~any_token(low, ["__attribute__((packed))", "alignas("]) & near(F.contains(low, F.lit("(struct")) & any_token(low, WIRE), 0, 3) & ~near(F.contains(low, F.lit("static_assert")) & F.contains(low, F.lit("sizeof")), 0, 3)),
        one("119", s.rlike("[/%]") & ~any_token(low, ROUNDING_SAFE) & any_token(low, SIGNED_MATH) & any_token(low, CONSENSUS)),
        one("120", any_token(low, ["vm->mem", "vm_mem"]) & s.rlike(VM_CAST) & ~near(any_token(low, ALIGNED), -3, -1)),
    ]
    none = F.array().cast("array<struct<task_id:string,detail:string>>")
    found = df.select("*", F.concat(*[F.coalesce(r, none) for t, r in rules if task in (None, t)]).alias("alerts")).where(F.size("alerts") > 0)
    return found.select("path", "file_ord", "fn_ord", F.concat("type_name", F.lit("."), "fn_name").alias("function_name"), "idx", F.left("stmt", F.lit(120)).alias("statement"), F.inline("alerts")).select(*ALERTS)


def released_then_used(statements: DataFrame) -> DataFrame:
    """104: the first later statement about a released name decides; a dereference is an alert, an assignment ends the matter."""
    keys = ["path", "file_ord", "type_name", "fn_name", "fn_ord"]
    df = statements.withColumn("freed", F.regexp_extract("stmt", RELEASE, 1))
    freed = df.where("freed <> ''").select(*keys, F.col("idx").alias("at"), F.col("freed").alias("name"))
    name = F.concat(F.lit(r"\b"), F.col("name"))
    later = freed.join(df.select("path", "fn_ord", "idx", "stmt", F.col("freed").alias("again")), ["path", "fn_ord"]).where("idx > at")
    event = F.when(F.col("again") == F.col("name"), "release").when(F.col("again") != "", None).when(F.expr("stmt rlike concat('\\\\b', name, '\\\\s*=')"), "set").when(F.expr("stmt rlike concat('\\\\b', name, '\\\\s*(?:->|\\\\[)') or contains(stmt, concat('*', name))"), "use")
    first = later.withColumn("event", event).where("event is not null").groupBy(*keys, "at", "name").agg(F.min_by(F.struct("event", "idx", "stmt"), "idx").alias("e"))
    return first.where("e.event = 'use'").select("path", "file_ord", F.lit("104").alias("task_id"), "fn_ord", F.concat("type_name", F.lit("."), "fn_name").alias("function_name"), F.col("e.idx").alias("idx"), F.col("name").alias("detail"), F.left("e.stmt", F.lit(120)).alias("statement"))


def missing_keys(sources: DataFrame) -> DataFrame:
    """105: reserved keys that a registry of unwritable accounts lacks."""
    present = F.regexp_extract_all("content", F.lit('"([A-HJ-NP-Za-km-z1-9]{32,44})"'), 1)
    files = sources.where((F.col("language") == "c") & F.col("content").rlike(REGISTRY))
    lacking = files.select("path", "file_ord", F.explode(F.array_except(F.array(*[F.lit(k) for k in RESERVED_KEYS]), present)).alias("detail"))
    return lacking.select("path", "file_ord", F.lit("105").alias("task_id"), F.lit(-1).alias("fn_ord"), F.lit("").alias("function_name"), F.lit(-1).alias("idx"), "detail", F.lit("").alias("statement"))


def switch_order(statements: DataFrame) -> DataFrame:
    """113: the first update must follow the first halt and the first flush."""
    call = F.lower(F.regexp_extract("stmt", r"\b([A-Za-z_]\w*)\s*\(", 1))
    keys = ["path", "file_ord", "type_name", "fn_name", "fn_ord"]
    p = frames.first_positions(statements.withColumn("call", call), keys, "idx", {"u": any_token(F.col("call"), UPDATE), "h": any_token(F.col("call"), HALT), "f": any_token(F.col("call"), FLUSH)})
    verdict = F.when(F.col("h").isNull() | F.col("f").isNull(), "incomplete").when((F.col("u") < F.col("h")) | (F.col("u") < F.col("f")), "order")
    p = p.where("u is not null").withColumn("detail", verdict).where("detail is not null")
    return p.select("path", "file_ord", F.lit("113").alias("task_id"), "fn_ord", F.concat("type_name", F.lit("."), "fn_name").alias("function_name"), F.col("u").alias("idx"), "detail", F.lit("").alias("statement"))


def guarded_returns(statements: DataFrame) -> DataFrame:
    """115: a guard on a program id whose return within two statements has a generic code."""
    low = F.lower("stmt")
    guard = F.contains(low, F.lit("program")) & any_token(low, ["id", "exists"]) & any_token(low, ["if", "switch"])
    code = F.regexp_extract("stmt", r"\breturn\s+([A-Z_][A-Z0-9_]*)\b", 1)
    guards = statements.where(guard).select("path", "fn_ord", "idx")
    returns = statements.withColumn("detail", code).where(F.col("detail").isin(WRONG_CODES))
    pairs = frames.within_rows(guards, returns, ["path", "fn_ord"], "idx", 2)
    return pairs.select("path", "file_ord", F.lit("115").alias("task_id"), "fn_ord", F.concat("type_name", F.lit("."), "fn_name").alias("function_name"), F.col("right_index").alias("idx"), "detail", F.left("stmt", F.lit(120)).alias("statement"))


def c_alerts(sources: DataFrame, statements: DataFrame, task: str | None = None) -> DataFrame:
    apart = {"104": lambda: released_then_used(statements), "105": lambda: missing_keys(sources), "113": lambda: switch_order(statements), "115": lambda: guarded_returns(statements)}
    if task in apart:
        return apart[task]()
    out = statement_alerts(statements, task)
    for part in apart.values() if task is None else ():
        out = out.unionByName(part())
    return out
