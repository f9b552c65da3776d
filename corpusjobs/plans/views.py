"""Derived views over the given tables: run results, seeds, source text, pair logs and the rest.

The SQL is valid in Spark and in DuckDB, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "runs": r"""
SELECT event_id AS run_id, ts,
  CASE user_id % 4 WHEN 0 THEN 'clang' WHEN 1 THEN 'cpython' WHEN 2 THEN 'rust' ELSE 'php' END AS project,
  user_id AS parent_a, (user_id * 7 + 3) % 150 AS parent_b, value AS exec_time,
  CASE WHEN event_type <> 'error' THEN 0 WHEN k % 8 = 5 THEN 139 WHEN k % 8 IN (2, 4) THEN 134 ELSE 1 END AS return_code,
  CASE WHEN event_type = 'view' THEN concat('ok ', k) ELSE '' END AS stdout,
  CASE WHEN event_type <> 'error' THEN 'warning: unused variable'
    WHEN k % 8 = 0 THEN concat('SUMMARY: AddressSanitizer: heap-use-after-free in fn_', k % 10, ' /src/obj', k % 5, '.c:', k % 20)
    WHEN k % 8 = 1 THEN concat('SUMMARY: UndefinedBehaviorSanitizer: undefined-behavior /src/u', k % 7, '.c:3')
    WHEN k % 8 = 2 THEN concat('clang: /llvm/V.cpp:12: f: Assertion ', chr(96), 'New', k % 6, ' != Old', chr(39), ' failed.')
    WHEN k % 8 = 3 THEN concat('LLVM ERROR: out of memory ', k % 3)
    WHEN k % 8 = 4 THEN concat('Stack dump:', chr(10), '0.', chr(9), 'Program arguments: clang t', run_k, '.c', chr(10),
      '1.', chr(9), 't.c:', k, ':1: current parser token ', k % 3, chr(10),
      ' 0  libLLVM.so 0x00007f1 llvm::sys::PrintStackTrace(raw) + 1', chr(10),
      ' 1  clang 0x00007f2 clang::Sema::Act', k % 4, '(int) + 9', chr(10),
      ' 2  clang 0x00007f3 clang::Parser::Run(int) + 9')
    WHEN k % 8 = 5 THEN 'Segmentation fault (core dumped)'
    WHEN k % 8 = 6 THEN concat('thread ', chr(39), 'rustc', chr(39), ' panicked at src/m', k % 4, '.rs:7:9:', chr(10), 'index out of bounds')
    ELSE concat('error: /tmp/x', run_k, '/a.c unknown type T', k % 3) END AS stderr
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_id AS run_k FROM events) e
""",
    "seeds": r"""
SELECT doc_id AS seed_no, concat(source, '/', doc_id, '.txt') AS identifier, source AS project, lang AS type, text AS content,
  CASE WHEN doc_id % 3 = 0 THEN true ELSE false END AS dryrun_done,
  CASE WHEN doc_id % 4 = 0 THEN true ELSE false END AS pre_analysis_done,
  CASE WHEN doc_id % 3 <> 0 THEN NULL WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS rc
FROM documents
""",
    "code_seeds": r"""
SELECT p_partkey AS seed_no, concat('t/', p_partkey, '.src') AS identifier,
  CASE p_partkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'cpython' WHEN 2 THEN 'clang' ELSE 'php' END AS type,
  CASE p_partkey % 4
    WHEN 0 THEN concat('use std::m', p_size % 5, ';', chr(10), 'struct S', p_size % 6, ' { a: i32 }', chr(10),
      'fn f', p_size % 4, '(x: i32) -> i32 { x }', chr(10), 'fn main() {', chr(10), '    let mut a', p_size % 7, ': i32 = 1;', chr(10),
      '    let s: String = f', p_size % 4, '(2); // let z: u8 = 0;', chr(10), '}')
    WHEN 1 THEN concat('import m', p_size % 5, chr(10), 'v', p_size % 9, ' = ', p_partkey, chr(10), 'def f', p_size % 4, '():', chr(10),
      '    return v', p_size % 9, ' + w', p_size % 5, chr(10), '# note q = "x"')
    WHEN 2 THEN concat('struct T', p_size % 8, ' { int a; };', chr(10), 'int g', p_size % 5, '(int x) {', chr(10), '  long y = x; // int z;', chr(10),
      '  return y + g', p_size % 3, '(x);', chr(10), '}')
    ELSE concat('<?php', chr(10), '$a', p_size % 6, ' = 1;', chr(10), '$b = $a', p_size % 6, ' + 2; // $c', chr(10),
      'function h', p_size % 4, '() { return $b; }') END AS content
FROM part
""",
    "more_code": r"""
SELECT p_partkey AS seed_no, CASE p_partkey % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'mlir' WHEN 2 THEN 'wgsl' WHEN 3 THEN 'swift' WHEN 4 THEN 'haskell' ELSE 'flang' END AS type,
  CASE p_partkey % 6
    WHEN 0 THEN concat('package main', chr(10), 'var x', p_size % 5, ' int', chr(10), 'var y', p_partkey % 7, ' pkg.Kind', chr(10), 'type S', p_size % 4, ' struct {}', chr(10), 'func Max[T comparable](a T) {', chr(10),
      chr(9), 'a', p_size % 6, ' := ', p_size, CASE WHEN p_size % 2 = 0 THEN '.5' ELSE '' END, chr(10), chr(9), 'b := Make', p_size % 3, '(3)', chr(10), chr(9), 'c := "q', p_partkey, '"', chr(10), chr(9), 'x', p_size % 5, ' := 3', chr(10), '}')
    WHEN 1 THEN concat('// RUN: mlir-opt %s', chr(10), 'func.func @f', p_size % 7, '(%a: i32) {', chr(10), '  %c = arith.constant ', p_size, ' : i32', chr(10), '  %d = arith.constant ', p_partkey % 9, '.5 : f64', chr(10),
      '  // note ', p_size % 3, chr(10), '  %m = memref.alloc() : memref<', p_size % 4, 'xf32>', chr(10), '  // CHECK-NEXT: x', chr(10), '}', chr(10), 'func @g() {}')
    WHEN 2 THEN concat('struct P', p_size % 5, ' { a: f32 }', chr(10), 'var<private> g', p_size % 3, ' : array<i32, ', p_size % 4 + 1, '>;', chr(10), 'fn main', p_partkey % 8, '() {', chr(10), '  var k', p_size % 6, ' : u32 = 2u;', chr(10), '}')
    WHEN 3 THEN concat(CASE WHEN p_size % 2 = 0 THEN concat('// RUN: swiftc', chr(10)) ELSE '' END, 'let a', p_size % 5, ' = ', p_size, chr(10), 'var b: Int = 2', chr(10), 'let c = "s', p_partkey, '"', chr(10), 'var d = [1]', chr(10), 'let e', p_size % 3, ' = true', chr(10), 'let f = g(1)')
    WHEN 4 THEN concat('{-# LANGUAGE Opt', p_size % 3, ' #-}', chr(10), 'module M where', chr(10), 'import Data.IORef', chr(10), 'import M', p_size % 4, chr(10), 'data D', p_size % 5, ' = D', chr(10), 'v', p_size % 6, ' = ', p_size, ' -- w = 1', chr(10),
      'f', p_size % 3, ' :: Int -> Int', chr(10), 'f', p_size % 3, ' x = x', chr(10), 'main = do', chr(10), '  r', p_size % 4, ' <- newIORef 0', chr(10), '  writeIORef r', p_size % 4, ' 1', chr(10), '  putStrLn "q = ', p_partkey, '"')
    ELSE concat('program p', p_size % 5, chr(10), '  integer :: a, b', p_size % 4, chr(10), '  real(8), intent(in) :: C', p_size % 3, ' ! real :: no', chr(10), '  character(', p_partkey % 9 + 1, ') :: s', chr(10), '  a = ', p_size, chr(10), 'end program') END AS content,
  concat('x', chr(10), 'TYPES:{"a', p_size % 5, '": ["int", "str"], "b": "T', p_size % 4, '"}', chr(10), '__TYPES_START__', CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('{"v', p_size % 7, '": "K', p_partkey % 5, '"}') END, '__TYPES_END__', chr(10)) AS printed,
  concat(chr(27), '[3', p_size % 8, 'm', p_name, chr(27), '[0m end') AS coloured
FROM part
""",
    "more_runs": r"""
SELECT event_id AS run_id, CASE event_id % 4 WHEN 0 THEN 'swift' WHEN 1 THEN 'haskell' WHEN 2 THEN 'flang' ELSE 'lfortran' END AS project,
  CASE WHEN k % 7 = 6 THEN 'Segmentation fault' ELSE '' END AS stdout,
  CASE event_id % 4
    WHEN 0 THEN CASE k % 4 WHEN 0 THEN concat('SUMMARY: AddressSanitizer: heap-overflow f', k % 9, chr(10), 'x') WHEN 1 THEN concat('a', chr(10), 'Assertion failed: (x', k % 5, ' > 0), file S.cpp') WHEN 2 THEN concat('1.', chr(9), 'While evaluating request TypeCheck', k % 3, '(a.swift)') ELSE concat('error: no such module M', k % 6) END
    WHEN 1 THEN CASE k % 5 WHEN 0 THEN concat('ghc: panic! (the ', chr(39), 'impossible', chr(39), ' happened)', chr(10), '  GHC version 9.', k % 4, chr(10), chr(9), 'refineFrom', chr(10), 'more', chr(10), 'last') WHEN 1 THEN concat('GHC internal error: bad f', k % 6) WHEN 2 THEN concat('x', chr(10), 'RTS invariant broken ', k % 3) WHEN 3 THEN concat('ASSERT failed! file x', k % 4, '.hs') ELSE 'ghc: Out of Memory' END
    WHEN 2 THEN CASE k % 4 WHEN 0 THEN concat('SUMMARY: UndefinedBehaviorSanitizer: bad-cast f', k % 5) WHEN 1 THEN concat('LLVM ERROR: cannot select ', k % 4)
      WHEN 2 THEN concat('Stack dump:', chr(10), '0.', chr(9), 'Program arguments: flang', chr(10), '1.', chr(9), '<eof> parser ', k % 3, chr(10), ' #0 0x00007f1 llvm::sys::PrintStackTrace(raw) (lib+0x1)', chr(10), ' #1 0x00007f2 Fortran::lower::f', k % 4, '(int) (lib+0x2)', chr(10), ' #2 0x00007f3 main(int) (lib+0x3)') ELSE 'Aborted (core dumped)' END
    ELSE CASE k % 5 WHEN 0 THEN concat('Traceback (most recent call last):', chr(10), '  File "a.cpp", line 1, in main_app', chr(10), '  File "b.cpp", line 2, in LCompilers::visit_', k % 4, chr(10), 'Segfault: Signal SIGSEGV') WHEN 1 THEN concat('Internal Compiler Error: Unhandled exception', chr(10), 'AssertFailed: f', k % 3, chr(10)) WHEN 2 THEN concat('terminate called after throwing an instance of ', chr(39), 'std::E', k % 3, chr(39)) WHEN 3 THEN concat('runtime_error: bad index ', k % 5) ELSE 'Unknown Exception' END
  END AS stderr
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e WHERE event_type = 'error'
""",
    "fused_pairs": r"""
SELECT l_orderkey AS iteration, l_partkey AS id_a, (l_partkey * 7 + l_suppkey * 4) % (SELECT count(*) FROM part) AS id_b FROM lineitem
""",
    "bug_corpus": r"""
SELECT doc_id AS id, source AS project, concat('t', doc_id) AS name, text AS program,
  CASE doc_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN concat('{"python":"x', doc_id, '"}')
    WHEN 2 THEN concat('{"python":"import ctypes ', doc_id, '","rust":"fn main() {}"}')
    ELSE concat('{"rust":"fn f', doc_id, '() {}","go":""}') END AS translations
FROM documents
""",
    "issues": r"""
SELECT item_id AS number, CASE WHEN item_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state,
  concat('crash in Act', item_id % 6, ' New', item_id % 9, ' != Old') AS title, text AS body FROM benchmark
""",
    "class_members": r"""
SELECT p_brand AS class_name, p_name AS member, CASE WHEN p_partkey % 3 = 0 THEN 'attribute' ELSE 'method' END AS kind, p_size AS params_count FROM part
""",
    "gcov_lines": r"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN concat('File ', chr(39), 'a', l_partkey, '.c', chr(39))
  ELSE concat('Lines executed:', l_partkey % 100, '.', lpad(CAST(l_orderkey % 100 AS STRING), 2, '0'), '% of ', CAST(l_quantity AS INT)) END AS line
FROM lineitem
""",
    "reruns": r"""
SELECT r.run_id AS bug_id, b.label, b.stderr, b.return_code FROM (SELECT run_id FROM runs WHERE return_code <> 0) r
JOIN (SELECT run_id AS bug_id, 'fused' AS label, stderr, return_code FROM runs
  UNION ALL SELECT run_id - 1, 'parent_a', stderr, return_code FROM runs
  UNION ALL SELECT run_id - 2, 'parent_b', stderr, return_code FROM runs) b ON b.bug_id = r.run_id
""",
}

#: Views that a view reads, besides tables.
NEEDS: dict[str, tuple[str, ...]] = {"reruns": ("runs",)}

TABLES = ("events", "documents", "part", "supplier", "lineitem", "benchmark")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a derived view over the tables in sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in body(name)}
    return spark.sql(with_tables(name, tables), **tables)


def body(name: str) -> str:
    return "".join(VIEWS[n] for n in (*NEEDS.get(name, ()), name))


def with_tables(name: str, tables: dict[str, DataFrame]) -> str:
    """The view's SQL with tables as parameters of the statement, so no name is registered in the session."""
    heads = [f"{t} AS (SELECT * FROM {{{t}}})" for t in tables]
    heads += [f"{n} AS ({escaped(VIEWS[n])})" for n in NEEDS.get(name, ())]
    return f"WITH {', '.join(heads)} {escaped(VIEWS[name])}"


def escaped(sql: str) -> str:
    """Literal braces doubled, as the statement is a format string."""
    return sql.replace("{", "{{").replace("}", "}}")


def cte(*names: str) -> str:
    """WITH clause that gives DuckDB the views."""
    order = dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n))
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
