"""Small source files of our own that exercise every rule; functions named bad_* break one, ok_* don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .code import SOURCES

C_RULES = r"""
/* one pair of functions for each rule */
#include "util.c"
static ulong bad_101( double x ) { ulong a = (ulong)( x * 2.5 ); return a; }
ulong ok_101( double x ) { ulong a = (ulong)fd_rust_cast_double( x ); ulong b = (ulong)count; return a; }
ulong bad_102( pkt_t * pkt ) { ulong v = 1UL << pkt->shift; return v; }
ulong ok_102( pkt_t * pkt ) { if( pkt->shift < 64 ) n++; ulong v = 1UL << pkt->shift; return v; }
void bad_103( uchar * sig ) { fd_ed25519_verify( sig, 64 ); }
void ok_103( uchar * sig ) { int err = fd_ed25519_verify( sig, 64 ); FD_TEST( fd_sha256( sig ) ); }
void bad_104( pool_t * pool ) { fd_txn_release( elem ); log_it( 1 ); elem->next = 0; }
void ok_104( pool_t * pool ) { fd_txn_release( elem ); elem = NULL; elem->next = 0; }
void bad_106( ctx_t * ctx ) { ctx->decode = (void *)my_decode; }
void ok_106( ctx_t * ctx ) { ctx->decode = my_decode; }
int bad_107( acc_t * acc ) { return acc->executable & 1; }
int ok_107( acc_t * acc ) { return !!( acc->executable & 1 ); }
void bad_108( q_t * q ) {
  while( q->left ) {
    step( q );
    process_frame( q, frame ); } }
void ok_108( q_t * q ) {
  while( q->left && frame_count < 64 ) {
    process_frame( q, frame ); } }
int bad_109( q_t * q ) {
  hs_t * h = hs_pool_take( q );
  if( h == NULL ) return ERR; }
int ok_109( q_t * q ) {
  hs_t * h = hs_pool_take( q );
  if( h == NULL ) evict_oldest( q ); }
void bad_110( bank_t * bank ) { bank->refcnt++; }
void ok_110( bank_t * bank ) { __atomic_fetch_add( &bank->refcnt, 1 ); }
void bad_111( void ) { io_uring_submit( shared_ring, 4 ); }
void ok_111( void ) { mutex_take( m ); io_uring_submit( shared_ring, 4 ); }
int bad_112( ulong slot ) { return lookup_table_age > 513; }
int ok_112( ulong slot ) { return lookup_table_age > 512; }
void bad_113( void ) { fd_set_identity( k ); poh_halt( p ); shred_flush( s ); }
void ok_113( void ) { poh_halt( p ); shred_flush( s ); fd_set_identity( k ); }
void bad_114( key_t * k ) { bls_aggregate( k ); }
void ok_114( key_t * k ) { verify_pop( k ); bls_aggregate( k ); }
int bad_115( ulong id ) {
  if( program_id_missing ) count++;
  return ERR_NOT_FOUND; }
int ok_115( ulong id ) {
  if( program_id_missing ) count++;
  return ERR_UNSUPPORTED_PROGRAM_ID; }
void bad_116( void ) { long total = rent_due + fee; }
void ok_116( void ) { __builtin_add_overflow( (long )rent_due, fee, &total + 0 ); }
void bad_117( void ) { combine( update_hash( a ), push_item( b ) ); }
void ok_117( void ) { combine( update_hash( a, push_item( b ) ), plain( c ) ); }
void bad_118( uchar * buf ) {
  struct wire_hdr { uchar a
  hdr = (struct wire_hdr *)buf; } }
void ok_118( uchar * buf ) {
  struct wire_hdr { uchar a
  hdr = (struct wire_hdr *)buf;
  static_assert( sizeof(hdr)==8 ); } }
void bad_119( void ) { long part = stake_total / 3; }
void ok_119( void ) { long part = fd_long_div_euclidean( stake_total / 1, 3 ); }
ulong bad_120( vm_t * vm ) { return *(ulong *)( vm->mem + addr ); }
ulong ok_120( vm_t * vm ) { if( addr & 7 ) fail( vm ); return *(ulong *)( vm->mem + addr ); }
"""

C_REGISTRY = 'static char const * fd_pack_unwritable[] = { "11111111111111111111111111111111", "SysvarRent111111111111111111111111111111111" };\n'

RUST_CONTRACT = r"""
#[contractimpl]
impl Vault {
    pub fn bad_201(env: Env, v: u32) { env.storage().persistent().set(&KEY, &v); env.storage().persistent().extend_ttl(&KEY, 1, 2); }
    pub fn ok_201(env: Env, who: Address, v: u32) { who.require_auth(); env.storage().persistent().set(&KEY, &v); env.storage().persistent().extend_ttl(&KEY, 1, 2); }
    pub fn bad_202(env: Env, who: Address, v: Vec<u32>) { who.require_auth(); if v.len() <= 3 { env.storage().instance().set(&KEY, &v); env.storage().instance().extend_ttl(1, 2); } }
    pub fn bad_203(env: Env) { env.invoke_contract(&id, &f); }
    pub fn ok_203(env: Env) { env.try_invoke_contract(&id, &f); }
    pub fn bad_204(env: Env, xs: Vec<u32>) { total(xs); }
    pub fn bad_205(env: Env, who: Address) { who.require_auth(); env.storage().persistent().set(&KEY, &1); }
    pub fn bad_206(env: Env) { assert!(ready(&env)); }
    pub fn bad_207(env: Env) { for k in keys(&env) { env.storage().persistent().get(&k); } }
    pub fn __constructor_bad_208(env: Env, who: Address) { who.require_auth(); env.storage().persistent().set(&KEY, &1); env.storage().persistent().extend_ttl(&KEY, 1, 2); }
    pub(crate) fn bad_212(x: Option<u32>) -> u32 { x.unwrap() }
    pub fn bad_213(a: Arc<u32>) { let b = Arc::new(1); for i in 0..3 { go(b.clone()); } }
    #[cfg(test)]
    pub fn ok_212(x: Option<u32>) -> u32 { x.unwrap() }
}
"""

RUST_FILE = r"""#![no_std]
use std::collections::HashMap;
#[cfg(feature = "std")] use std::fmt;
static mut COUNTER: u32 = 0;
fn read() -> u32 { let p = &COUNTER; *p }
fn cell() { let c: RefCell<u32> = RefCell::new(1); thread::spawn(move || 1); }
fn hold(f: Box<dyn Fn(u32) + Send>) { let x = &make(1); }
struct Root { state_root: HashMap<u32, u32> }
#[derive(Serialize)]
struct Flat { #[serde(flatten)] inner: Inner }
fn choice() { fork_choice(); }
fn limits(gas_limit: u64) { batcher(gas_limit); }
struct Proposal { start: u64, end: u64 }
fn proposal() { }
fn leave() { panic_with_error!(e); panic!("x"); }
// SAFETY: checked
fn fine() { unsafe { go() } }
""" + "\n" * 20 + r"""fn raw() { unsafe { go() } }
fn later() { tokio::spawn(async { work().unwrap() }); }
"""

SOLIDITY = r"""
pragma solidity 0.8;
// a note on the old version of this
contract Vault is Base, Named {
    uint balance; uint point; address owner; string nameOfVault; string nameOfVaults;
    mapping(address => uint) shares;
    uint256 unseen;
    event Paid(address who);
    modifier onlyOwner() { require(msg.sender == owner); _; }
    function bad_2(uint v) public { balance = v; }
    function ok_2(uint v) public onlyOwner { balance = v; }
    function stakeIt(uint v) internal { require(v > 0); shares[msg.sender] += v; }
    function mintAll(uint v) external { require(v > 1); go(v); }
    function burnSome() public onlyOwner { if (v > 2) { drop(address(0)); } }
    function takePoint() public { point = 1; }
    function ok_5_takePoint() public { require(point > 0); go(point); }
    function bad_6() public { try other.run() { go(1); } catch { revert("no"); } assert(x > 1); }
    function bad_7(uint a) public view returns (uint) { return a * 3 / 4; }
    function bad_8() public onlyOwner { require(ok); token.transfer(a, 1); fetchPrice(); }
    function ok_8() public onlyOwner { require(ok); fetchPrice(); token.transfer(a, 1); }
    function bad_9() public { token.transfer(a, 1); }
    function bad_11(uint v) external { shares[msg.sender] = v; }
}
interface Thing { function plain(uint v) external; }
"""

FILES = (("node/rules.c", 0, "c", C_RULES), ("node/registry.c", 1, "c", C_REGISTRY), ("vault/src/lib.rs", 2, "rust", RUST_CONTRACT), ("base/main.rs", 3, "rust", RUST_FILE), ("vault/Vault.sol", 6, "solidity", SOLIDITY), ("empty.c", 4, "c", ""), ("none.rs", 5, "rust", None), ("none.sol", 7, "solidity", None))


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, SOURCES)
