"""Haskell, PHP statements and mutations on hand-worked texts."""

from __future__ import annotations

import random
import re

import pytest

from corpusjobs.functions import mutations as M
from corpusjobs.functions import statements as S
from corpusjobs.functions.profiles import C_KEYWORDS, PHP_SKIP


def test_haskell():
    text = "{-# LANGUAGE X #-}\nimport B\nimport A\ndata T = T Int -- data No\nclass Show a => C a where\nf x' = \"g = newIORef\" ++ x'\ng = 'd'\nmain = do\n  ref <- newIORef 0\n  ref <- newMVar 1\n  t <- atomically (newTVar 2)\n  writeIORef ref 1 {- readMVar zz -}\na --> b = 1\n"
    shadow = S.haskell_shadow(text)
    assert len(shadow) == len(text) and shadow.count("\n") == text.count("\n") and "No" not in shadow and "newIORef\"" not in shadow and "-->" in shadow
    p = S.haskell_profile(text)
    assert p["toplevel_names"] == ["C", "T", "a", "f", "g"] and p["nullary_bindings"] == ["g"] and p["has_main"]
    assert p["state_handles"] == [{"name": "ref", "kind": "ioref"}, {"name": "t", "kind": "tvar"}] and p["state_used"] == ["ref"]
    assert p["imports"] == ["import A", "import B"] and p["pragmas"] == ["{-# LANGUAGE X #-}"]


def test_php_statements():
    text = "$a = 1; // x; y\nif ($a) { f(';'); } else { g(\"}\"); }\nfunction h() { return new K; }\ntry { a(); } catch (E $e) { b(); }\n$s = <<<EOT\nx; y\nEOT;\n$t = function() { return 1; };\nrest"
    got = S.php_statements(text)
    assert [s.split("\n")[-1][:12] for s in got] == ["$a = 1;", "if ($a) { f(", "function h()", "try { a(); }", "EOT;", "$t = functio", "rest"]
    assert S.php_statements("") == [] and S.php_statements("  \n") == []
    assert S.php_defines_uses("$x = f($y) + new K; function g() {}", PHP_SKIP) == (["$x", "g"], ["$x", "$y", "K", "f", "g"])


def test_c_statements():
    text = "#include <a>\n#define F(x) \\\n  x;\nstruct T { int a; };\nint f(int x) {\n#if 1\n  if (x) { g(\";}\"); } else { h(';'); }\n#endif\n}\nint y = 1; // z;\nfor (int i = 0; i < 3; i++) { a(); }\ndo { b(); } while (x);\n/* c; } */ rest"
    got = S.c_statements(text)
    assert got[0] == "#include <a>" and got[1] == "#define F(x) \\\n  x;" and got[2:4] == ["struct T { int a; }", ";"] and got[4].startswith("int f") and got[4].endswith("#endif\n}")
    assert got[5:] == ["int y = 1;", "// z;\nfor (int i = 0; i < 3; i++) { a(); }", "do { b(); } while (x);", "/* c; } */ rest"]
    assert S.c_statements("") == [] and S.c_statements("}}{") == ["}", "}", "{"] and "".join(S.c_statements("a;b{c}d")) == "a;b{c}d"
    assert S.c_defines_uses("int f(int a) { if (a) { b = c; } return 0; }", C_KEYWORDS) == (["b", "f"], ["f"], ["a", "b", "c", "f"])
    assert S.c_defines_uses("struct S { int q; } v;", C_KEYWORDS) == (["S"], ["S"], ["S", "q", "v"])


def test_fortran_statements():
    text = "! head\nprogram p\n  integer :: a, &\n    b ! c &\n\n  if (a > 1) then\n    do i = 1, 2\n    end do\n  end if\n  print *, 'x ! & ', &\n    a\nend program\nsubroutine s(x)\n  x = 1\nend\n! tail"
    got = S.fortran_statements(text)
    assert got == ["! head", "program p", "  integer :: a, &\n    b ! c &", "if (a > 1) then\n    do i = 1, 2\n    end do\n  end if", "  print *, 'x ! & ', &\n    a", "end program", "subroutine s(x)", "  x = 1", "end", "! tail"]
    assert S.fortran_statements("") == [] and S.fortran_statements("x = 'a\nb = 1") == ["x = 'a\nb = 1"]
    assert S.fortran_defines_uses("  integer :: a, B(3)") == (["A", "B"], [], ["A", "B"])
    assert S.fortran_defines_uses("real function f(x)") == (["F"], ["F"], ["F", "X"]) and S.fortran_defines_uses("  y = x + 1 ! z") == (["Y"], [], ["X", "Y", "Z"])


@pytest.mark.parametrize("language", ["", "php", "cpython", "swift", "rust", "haskell"])
def test_each_family_changes_texts_by_its_rules(language):
    text = {
        "php": "<?php\n$a = 1 === (int) $b ?? null;\n$d += 2 * 3;\n$c = 'x' && $a <=> 2;", "cpython": "x = 1 + y.name\nz = 'abc' and None", "swift": "let x = 1 + 2\nvar s = \"a\" as? T", "rust": "fn f() {\n    let x = 12u8;\n    g(x);\n}", "haskell": "f x = x + 1 ++ \"s\"\nmain = print (f True)",
    }.get(language, "x += 1 + y * 'abc' and z")
    assert M.mutate(text, "s", language, boost=0) == text
    got = {M.mutate(text, str(i), language, boost=1000) for i in range(60)}
    assert len(got) > 10 and text not in got and M.mutate(text, "1", language, 1000) == M.mutate(text, "1", language, 1000)
    rules = M.FAMILIES.get(language, M.BASE)
    for nth, rule in enumerate(rules):
        assert rule.chance in (1, 2, 3, 5, 10) and any(re.search(p, text) for p, _ in rule.alternatives), (language, nth)
    rare = sum(M.mutate(text, f"{random.Random(i).random()}", language) != text for i in range(2000))
    assert 0 < rare <= 2000 * sum(r.chance for r in rules) / 1000 * 2


def test_what_rules_put_in():
    assert {M.mutate("a\nb();\nc", str(i), "rust", 1000) for i in range(20)} <= {f"a\n{x}\nc" for b in ("b()", "b().unwrap()", "b().unwrap_or_default()", 'b().expect("fuzzed")') for x in (f"{b};", f"unsafe {{ {b}; }}")}
    assert {M.mutate("pure x", str(i), "haskell", 1000) for i in range(5)} == {"pure $! x"} and {M.mutate("True", str(i), "haskell", 1000) for i in range(5)} == {"False"}
    crossed = {M.crossed("$a $b $a", "$a", "$b", lambda what, n, i=i: hash((what, i)) % n) for i in range(40)}
    assert crossed == {"$b $b $a", "$a $b $b", "$b $b $b"}
