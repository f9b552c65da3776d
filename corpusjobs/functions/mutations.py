"""Mutations of source text: tables of rules by language and one function that applies them.

A rule has alternatives, tried in order until one of them matches, and a chance in thousandths. An alternative is a
pattern and what may take a match's place: a list (never the match itself), a map by the match, or a template with
the match's groups.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    chance: int
    alternatives: tuple[tuple[str, tuple[str, ...] | dict[str, tuple[str, ...]]], ...]
    template: bool = False
    #: Lines that a text must have.
    lines: int = 0
    #: Whether the replacement is another match, put in place of some of the places of the first.
    crossed: bool = False


#: The rules of each language, their values and chances.
PHP_INTS = ("-1", "0", "1", "2", "PHP_INT_MAX", "PHP_INT_MIN", "PHP_FLOAT_MIN", "PHP_FLOAT_MAX", "PHP_FLOAT_EPSILON", "NULL", "NAN", "INF", "-INF", "0x7fffffff", "0x80000000", "0xffffffff", "2147483647", "-2147483648", "9223372036854775807", "-9223372036854775808")
PHP_STRINGS = ('""', "''", '"0"', '"1"', '"-1"', '"false"', '"true"', '"null"', '"NULL"', '"0.0"', '"1.0"', '"-0"', '" "', '"\\0"', '"\\x00"', '"0x1"', '"0b1"', '"0777"', '"1e100"', '"-1e100"', '"2147483648"', '"-2147483649"', '"PHP_INT_MAX"', '"Array"')
PHP_CASTS = ("(int)", "(integer)", "(string)", "(float)", "(double)", "(bool)", "(boolean)", "(array)", "(object)", "(unset)")
PYTHON_INTS = ("-0", "0", "1", "-1", "+1", "127", "128", "255", "256", "511", "512", "1023", "1024", "4095", "4096", "2**15-1", "-(2**15)", "2**31-1", "-(2**31)", "2**63-1", "-(2**63)", "2**64-1", "-(2**64)", "10**100", "10**1000", "0b0", "0b1", "-0b1", "0o777", "0x7fffffff", "0x80000000", "0xffffffff", "0xffffffffffffffff", "1_000_000", "-1_000_000", "999999999999", "-999999999999", "sys.maxsize", "-sys.maxsize - 1")
PYTHON_FLOATS = ("float('inf')", "-float('inf')", "float('nan')", "0.0", "-0.0", "1e308", "1e-308", "1.7976931348623157e308", "2.2250738585072014e-308", "5e-324", "1e-324", "1e309", "float.fromhex('0x0.0000000000001p-1022')", "float.fromhex('0x1.fffffffffffffp+1023')", "3.1415926535897932384626", "2.718281828459045")
PYTHON_STRINGS = ("''", '""', "' '", "'\\n\\r\\t'", "r'\\n\\r\\t'", "'\\x00'", "'\\x1f'", "'\\ufeff'", "'\\u200b'", "'\\u200e'", "'\\u2603'", "'\\U0001F4A9'", "'e\\u0301'", "r'\\ud800'", "r'\\udfff'", "r'\\udcff'", "'A'*1000", "'{}'*50", "'%s%s%s'", "'3.1415926535897932384626'")
PYTHON_BYTES = ("b''", "b'\\x00'", "b'\\xff'", "b'\\xff'*64", "b'\\x00\\xff\\x80\\x7f'", "b'\\xc0\\xaf'", "b'\\xed\\xa0\\x80'", "b'\\xf4\\x90\\x80\\x80'", "b'\\xe2\\x28\\xa1'", "b'\\xa0\\xa1'", "b'\\xe2\\x98\\x83'", "b'\\x00'*1024", "bytes(range(256))")
PYTHON_CONSTANTS = ("None", "True", "False", "Ellipsis", "NotImplemented")
PYTHON_ASSIGNS = ("=", "+=", "-=", "*=", "/=", "//=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "@=")
PYTHON_OPERATORS = ("+", "-", "*", "/", "//", "%", "**", "&", "|", "^", "<<", ">>", "@")
PYTHON_MAGIC = (".__class__", ".__doc__", ".__name__", ".__dict__", ".__code__", ".__defaults__", ".__globals__", ".__bases__", ".__mro__", ".__subclasses__")
SWIFT_NUMBERS = ("-1", "0", "1", "Int.max", "Int.min", "Int8.max", "Int8.min", "UInt64.max", "0xFF", "0xFFFF", "0xFFFFFFFF", "1_000_000", "Float.infinity", "-Float.infinity", "Float.nan", "Double.infinity", "Double.nan", "0.0", "-1.0", "1.0", "1.7976931348623157e+308")
SWIFT_TEXTS = ('""', '"A" * 1000', '"\\u{0}"', '"\\u{1F4A9}"', '#"Raw String"#', "nil", "true", "false")
SWIFT_OPERATORS = ("+", "-", "*", "/", "%", "&+", "&-", "&*", "&", "|", "^", "<<", ">>")
RUST_INTS = ("0", "1", "-1", "i32::MAX", "i32::MIN", "u32::MAX", "i64::MAX", "i64::MIN", "u64::MAX", "usize::MAX", "1_000_000")
HASKELL_INTS = ("0", "1", "-1", "2", "127", "-128", "32767", "-32768", "2147483647", "-2147483648", "9223372036854775807", "-9223372036854775808", "maxBound", "minBound")
BASE = (
    Rule(1, ((r"\+\+|\*\*|[-*/%]", ("+", "-", "*", "/", "%", "**")),)),
    Rule(1, ((r"\+=|-=|\*=|/=|%=", ("+=", "-=", "*=", "/=", "%=")),)),
    Rule(1, ((r"\band\b|\bor\b|\bxor\b|&&|\|\|", ("and", "or", "xor", "&&", "||")),)),
    Rule(1, ((r"(?<![a-zA-Z0-9_])(?:0x[0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*|0)(?![a-zA-Z0-9_])", ("-1", "0", "1", "-2147483648", "2147483647")),)),
    Rule(10, ((r"'(?:\\.|[^'\\])+'|\"(?:\\.|[^\"\\])+\"", ("''", "'test\\0test'", "'~'")),)),
)


def any_of(values: tuple[str, ...]) -> str:
    """A pattern of fixed texts, the longest first."""
    return "|".join(map(re.escape, sorted(values, key=len, reverse=True)))


PHP = (
    *BASE[:3],
    Rule(2, ((r"(?<![a-zA-Z0-9_])(?:0x[0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*|0)(?![a-zA-Z0-9_])", PHP_INTS),)),
    Rule(10, ((r"'[^'\\]*(?:\\.[^'\\]*)*'|\"[^\"\\]*(?:\\.[^\"\\]*)*\"", PHP_STRINGS),)),
    Rule(5, ((r"\$\w+", ()),), crossed=True),
    Rule(3, ((r"===|!==|==|!=", {"===": ("==",), "!==": ("!=",), "==": ("===",), "!=": ("!==",)}),)),
    Rule(5, ((r"\b(?:true|false|TRUE|FALSE|True|False|null|NULL)\b", ("true", "false", "TRUE", "FALSE", "null", "NULL", "True", "False")),)),
    Rule(3, ((r"\((?:int|integer|string|float|double|bool|boolean|array|object|unset)\)", PHP_CASTS), (r"(?=\$\w)", PHP_CASTS))),
    Rule(3, ((r"\?\?", ("?:", "||")), (r"\?:", ("??",)))),
    Rule(2, ((r"<=>", ("<", ">", "==")), (r"[<>]=?|==", ("<=>",)))),
)
PYTHON = (
    Rule(1, ((any_of(PYTHON_OPERATORS), PYTHON_OPERATORS),)),
    Rule(1, ((any_of(PYTHON_ASSIGNS), PYTHON_ASSIGNS),)),
    BASE[2],
    Rule(1, ((r"(?<![a-zA-Z0-9_])(?:0x[0-9a-fA-F]+|0b[01]+|0o[0-7]+|[1-9][0-9]*|0)(?![a-zA-Z0-9_])", PYTHON_INTS + PYTHON_FLOATS),)),
    Rule(10, ((r"b?r?f?'''[\s\S]*?'''|b?r?f?\"\"\"[\s\S]*?\"\"\"|b?r?f?'[^']*'|b?r?f?\"[^\"]*\"", PYTHON_STRINGS + PYTHON_BYTES),)),
    Rule(2, ((rf"\b(?:{any_of(PYTHON_CONSTANTS)})\b", PYTHON_CONSTANTS),)),
    Rule(5, ((r"\.(?!__)[a-zA-Z_][a-zA-Z0-9_]*", PYTHON_MAGIC),)),
)
SWIFT = (
    Rule(1, ((r"(?<![a-zA-Z0-9_])(?:0x[0-9a-fA-F]+|[0-9]+)(?![a-zA-Z0-9_])", SWIFT_NUMBERS),)),
    Rule(1, ((any_of(SWIFT_OPERATORS), SWIFT_OPERATORS),)),
    Rule(10, ((r"\"[^\"\\]*(?:\\.[^\"\\]*)*\"", SWIFT_TEXTS),)),
    Rule(5, ((r"\b(?:var|let|class|struct|weak|unowned)\b|as\?|as!", {"var": ("let",), "let": ("var",), "class": ("struct",), "struct": ("class",), "weak": ("unowned",), "unowned": ("weak",), "as?": ("as!",), "as!": ("as?",)}),)),
)
RUST = (
    Rule(1, ((r"(?<![a-zA-Z0-9_])(?:0x[0-9a-fA-F_]+|[0-9][0-9_]*[iu](?:8|16|32|64|128|size)?)(?![a-zA-Z0-9_])", RUST_INTS),)),
    Rule(5, ((r"(?<=\))", (".unwrap()", '.expect("fuzzed")', ".unwrap_or_default()")),)),
    Rule(2, ((r"(?m)^[ \t]*(?!unsafe)(\S(?:.*\S)?)[ \t]*$(?<=[;}])", (r"unsafe { \1 }",)),), template=True, lines=3),
)
HASKELL = (
    Rule(2, ((r"\+\+|<>|(?<!<)-(?!>)|\+(?!\+)|\*", ("+", "-", "*", "++", "<>")),)),
    Rule(2, ((r"(?<![a-zA-Z0-9_.'])(?:0x[0-9a-fA-F]+|[0-9]+)(?![a-zA-Z0-9_.'])", HASKELL_INTS),)),
    Rule(10, ((r"\"(?:[^\"\\]|\\.)*\"", ('""', '"\\NUL"', '"test\\0test"')),)),
    Rule(5, ((r"\bTrue\b", ("False",)), (r"\bFalse\b", ("True",)))),
    Rule(2, ((r"\b(print|return|pure)\s+(\([^()]*\)|[A-Za-z0-9_']+)", (r"\1 $! \2",)),), template=True),
)
FAMILIES: dict[str, tuple[Rule, ...]] = {"php": PHP, "cpython": PYTHON, "swift": SWIFT, "rust": RUST, "haskell": HASKELL}


def mutate(text: str, seed: str, language: str = "", boost: int = 1) -> str:
    """Each rule of the language (of the base where it has none), by its chance times boost, changes one drawn match.

    Draws are hashes of the seed, the rule's number and their purpose, so a run repeats.
    """
    for nth, rule in enumerate(FAMILIES.get(language, BASE)):
        draw = lambda what, n: int(hashlib.md5(f"{seed}|{nth}|{what}".encode()).hexdigest()[:12], 16) % n  # noqa: B023, E731
        if draw("chance", 1000) >= rule.chance * boost or text.count("\n") + 1 < rule.lines:
            continue
        found, choices = next(((f, c) for p, c in rule.alternatives if (f := list(re.finditer(p, text)))), ([], ()))
        if not found:
            continue
        m = found[draw("match", len(found))]
        if rule.crossed:
            text = crossed(text, m[0], found[draw("new", len(found))][0], draw)
            continue
        fit = choices.get(m[0], ()) if isinstance(choices, dict) else [c for c in choices if c != m[0]]
        if fit:
            new = fit[draw("new", len(fit))]
            text = text[: m.start()] + (m.expand(new) if rule.template else new) + text[m.end() :]
    return text


def crossed(text: str, old: str, new: str, draw) -> str:
    """Some of the places of old, one or more, taken by new."""
    places = [m.start() for m in re.finditer(re.escape(old), text)]
    count = draw("count", len(places)) + 1
    for at in sorted(sorted(places, key=lambda p: draw(f"place {p}", 1 << 40))[:count], reverse=True):
        text = text[:at] + new + text[at + len(old) :]
    return text
