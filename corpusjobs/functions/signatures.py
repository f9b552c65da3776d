"""Crash signatures: ordered cascades of rules per project, and what decides that a run crashed.

A cascade is a table of rules; the first that finds something gives the signature. A rule names a text that must be there
for it to match, so that its pattern is tried on the few outputs that have it. with_signature() adds the signatures of a
table of runs; a cascade can also be called for one column expression.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import all_found, found, let, lines, strip

#: Texts whose presence in the output of a project marks a crash.
CRASH_PATTERNS: dict[str, tuple[str, ...]] = {
    "clang": ("SUMMARY: AddressSanitizer", "SUMMARY: UndefinedBehaviorSanitizer", "LLVM ERROR", "Assertion `", "Stack dump:", "Segmentation fault", "Aborted", "core dumped", "PLEASE submit a bug report"),
    "cpython": ("SUMMARY:", ": Assertion `"),
    "flang": ("SUMMARY: AddressSanitizer", "SUMMARY: UndefinedBehaviorSanitizer", "LLVM ERROR", "Assertion `", "Stack dump:", "Segmentation fault", "Aborted", "core dumped", "PLEASE submit a bug report", "internal compiler error"),
    "haskell": ("panic!", "Please report", "GHC internal error", "internal error:", "RTS invariant", "internal inconsistency", "ASSERT failed", "Segmentation fault", "(core dumped)", "out of memory", "Uncaught exception"),
    "lfortran": ("SUMMARY: AddressSanitizer", "SUMMARY: UndefinedBehaviorSanitizer", "Segfault: Signal SIGSEGV", "Abort: Signal SIGABRT", "Internal Compiler Error", "AssertFailed", "LCOMPILERS_ASSERT failed", "runtime_error:", "std::exception:", "Unknown Exception", "terminate called after throwing", "Segmentation fault", "Aborted", "core dumped"),
    "mlir": ("AddressSanitizer", "UndefinedBehaviorSanitizer", "Segmentation fault", "LLVM ERROR", "Assertion failed", "UNREACHABLE executed", "report_fatal_error", "Aborted", "internal compiler error", "core dumped"),
    "php": ("SUMMARY: AddressSanitizer", "SUMMARY: UndefinedBehaviorSanitizer", "Assertion: ", "(core dumped)"),
    "rust": ("internal compiler error", "thread 'rustc' panicked", "stack overflow", "Segmentation fault", "core dumped", "Aborted", "LLVM ERROR"),
    "swift": ("Please submit a bug report", "Assertion failed:"),
}
#: Frames that every stack dump has.
NOISE = r"^(?:llvm::sys::PrintStackTrace|llvm::sys::RunSignalHandlers|llvm::sys::CleanupOnSignal|.*SignalHandler.*|abort|raise|gsignal|pthread_kill|__assert_fail|__cxa_throw)$"
FLANG_NOISE = NOISE.replace("llvm::sys::CleanupOnSignal|", "")
LFORTRAN_NOISE = r"^(?:main|main_app|loc_segfault_callback_print_stack|loc_abort_callback_print_stack)$"


def tagged(tag: str, value: Column) -> Column:
    """tag followed by the value; null stays null."""
    return F.concat(F.lit(tag), value)


def strip_ansi(c: Column) -> Column:
    """without colour and cursor codes."""
    return F.regexp_replace(c, r"\x1b\[[0-9;]*[A-Za-z]", "")


def crashed(project: Column, out: Column, err: Column, patterns: dict[str, tuple[str, ...]] = CRASH_PATTERNS) -> Column:
    """Whether any pattern of the project is in stdout or stderr; never without patterns."""
    out, err = F.coalesce(out, F.lit("")), F.coalesce(err, F.lit(""))
    result = F.lit(False)
    for name, own in patterns.items():
        hit = reduce(lambda a, b: a | b, [F.contains(err, F.lit(p)) | F.contains(out, F.lit(p)) for p in own], F.lit(False))
        result = F.when(project == name, hit).otherwise(result)
    return result


def syntax_error(err: Column, code: Column, error_codes: tuple[int, ...] = ()) -> Column:
    """Ordered rules over stderr without colours, then the return code."""
    text = F.lower(strip_ansi(F.coalesce(err, F.lit(""))))
    said = reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in ("error:", "syntaxerror", "syntax error", "indentationerror", "could not parse wgsl", "validation error")])
    return F.when(said, True).when(code == 0, False).when(code.isin(*error_codes) if error_codes else F.lit(False), True).otherwise(~code.isin(1, 139))


# -- cascades of projects -------------------------------------------------------------------------


class Rule(NamedTuple):
    """What a rule reads (err, out, both: stderr and stdout, lined: with a line feed between), the text that must be in it
    (in any case, if fold), and what it finds: null for nothing."""

    over: str
    part: str
    value: Callable[[Column], Column]
    fold: bool = False

    def of(self, text: Column) -> Column:
        return F.when(F.contains(F.lower(text) if self.fold else text, F.lit(self.part)), self.value(text)) if self.part else self.value(text)


class Cascade:
    """Rules in order; called with stdout and stderr it is one expression."""

    def __init__(self, *rules: Rule):
        self.rules = rules

    def __call__(self, out: Column, err: Column) -> Column:
        texts = F.struct(err.alias("err"), out.alias("out"), F.concat(err, out).alias("both"), F.concat(err, F.lit("\n"), out).alias("lined"))
        return let(texts, lambda t: F.coalesce(*(r.of(t[r.over]) for r in self.rules)))


def said_by(over: str, part: str, pattern: str, tag: str = "", most: int | None = None, group: int = 1, fold: bool = False) -> Rule:
    """The group of the first match, stripped, of `most` characters, with a tag before it."""

    def value(text: Column) -> Column:
        got = strip(found(text, pattern, group))
        got = got if most is None else F.substring(got, 1, most)
        return tagged(tag, got) if tag else got

    return Rule(over, part, value, fold)


def named(over: str, part: str, name: str, fold: bool = False) -> Rule:
    """The name, if the part is there."""
    return Rule(over, part, lambda _: F.lit(name), fold)


#: G1: the sanitizer summary of stderr, then of stdout.
BASE = tuple(said_by(t, "SUMMARY: AddressSanitizer:", r"SUMMARY: AddressSanitizer:\s+(.*)") for t in ("err", "out"))
SANITIZERS = (
    said_by("both", "SUMMARY: AddressSanitizer:", r"SUMMARY: AddressSanitizer:\s+([^\n]+)", "ASAN: "),
    said_by("both", "SUMMARY: UndefinedBehaviorSanitizer:", r"SUMMARY: UndefinedBehaviorSanitizer:\s+([^\n]+)", "UBSAN: "),
)
base = Cascade(*BASE)
#: G2. An assertion is quoted by backticks on both sides.
cpython = Cascade(
    BASE[0],
    said_by("err", "Fatal Python error:", r"Fatal Python error:\s+(.*)"),
    said_by("err", ": Assertion `", r": Assertion `(.*)` failed", "Assertion: "),
    named("err", "Bus error", "Bus error"),
    named("err", "Segmentation fault", "Segmentation fault"),
    *BASE,
)


def stack_dump(text: Column, frame: str, offset: str, noise: str) -> Column:
    """G9: 'message [f1 > f2 > f3]' of the first stack dump: 60 lines at most, three frames but noise.

    offset has two groups, a library and an address, that stand in where no frame has a symbol.
    """

    def of_body(body: Column) -> Column:
        message = F.coalesce(strip(F.get(all_found(body, r"(?m)^\d+\.\t(?:\S+:\d+:\d+:\s*)?(.+)$"), F.lit(1))), F.lit(""))
        names = F.slice(F.filter(F.transform(all_found(body, frame), strip), lambda n: (n != "") & ~n.rlike(noise)), 1, 3)
        lib, add = F.element_at(all_found(body, offset, 1), -1), F.element_at(all_found(body, offset, 2), -1)
        place = F.when(F.size(all_found(body, offset)) > 0, F.concat(F.substring_index(lib, "/", -1), F.lit("+"), add))
        frames = let(names, lambda n: F.when(F.size(n) > 0, F.array_join(n, " > ")).otherwise(F.coalesce(place, F.lit(""))))
        return let(F.struct(message.alias("m"), frames.alias("f")), lambda x: F.nullif(F.when((x["m"] != "") & (x["f"] != ""), F.concat(x["m"], F.lit(" ["), x["f"], F.lit("]"))).otherwise(F.concat(x["m"], x["f"])), F.lit("")))

    # Both the first dump and what follows it: everything after the first head, 60 lines of it.
    rest = let(text, lambda t: F.when(F.contains(t, F.lit("Stack dump:\n")), F.substring(t, F.locate("Stack dump:\n", t) + 12, F.length(t))))
    return let(F.array_join(F.slice(F.split(rest, "\n", -1), 1, 60), "\n"), of_body)


def llvm(frame: str, offset: str, noise: str) -> Cascade:
    return Cascade(
        *SANITIZERS,
        said_by("both", "LLVM ERROR:", r"LLVM ERROR:\s+([^\n]+)", "LLVM ERROR: "),
        said_by("both", "Assertion `", r"Assertion `([^']+)' failed", "Assertion: "),
        Rule("both", "Stack dump:\n", lambda text: tagged("Stack dump: ", stack_dump(text, frame, offset, noise))),
        named("both", "Aborted", "Aborted"),
        named("both", "Segmentation fault", "Segmentation fault"),
        *BASE,
    )


#: Frames are '<n> <binary> 0x<address> <symbol>('.
clang = llvm(r"(?m)^\s*\d+\s+\S+\s+0x[0-9a-f]+\s+([A-Za-z_][\w:<>,~ &*]*?)\s*\(", r"(?m)^\s*\d+\s+(\S+)\s+(0x[0-9a-f]+)\s*$", NOISE)
#: Frames are '#<n> 0x<address> <symbol>(', libraries '(lib+0x<offset>)'.
flang = llvm(r"(?m)^\s*#\d+\s+0x[0-9a-f]+\s+([A-Za-z_][\w:<>,~ &*]*?)\s*\(", r"\(([^()\s]+?)\+(0x[0-9a-f]+)\)", FLANG_NOISE)
#: G4.
php = Cascade(*(said_by(t, part, f"({part}.*)") for part in ("Assertion: ", "SUMMARY: ") for t in ("err", "out")), *BASE)
#: G5.
swift = Cascade(*BASE, *(said_by(t, part, pattern) for part, pattern in (("Assertion failed: ", r"(Assertion failed: .*)"), ("While evaluating request ", r"\d+\.\s+(While evaluating request [^(]*)")) for t in ("err", "out")))
#: A panic with up to three lines after it, 200 characters.
haskell = Cascade(
    said_by("lined", "ghc: panic!", r"ghc: panic!\s*\(the 'impossible' happened\)([^\n]*(?:\n[^\n]*){0,3})", "ghc panic: ", 200),
    said_by("lined", "GHC internal error:", r"GHC internal error:\s*([^\n]+)", "GHC internal error: "),
    said_by("lined", "internal error:", r"(?i)internal error:\s*([^\n]+)", "GHC internal error: ", fold=True),
    said_by("lined", "RTS invariant", r"(RTS invariant[^\n]*)"),
    named("lined", "internal inconsistency", "GHC: internal inconsistency"),
    said_by("lined", "ASSERT failed!", r"(ASSERT failed![^\n]*)"),
    named("lined", "Segmentation fault", "ghc: Segmentation fault"),
    named("lined", "out of memory", "ghc: out of memory", fold=True),
    *BASE,
)


def fortran_frames(text: Column) -> Column:
    """The first three frames of the traceback but noise, in brackets; nothing without any."""
    head = "Traceback (most recent call last):\n"
    at = F.locate(head, text)
    body = F.array_join(F.slice(F.split(F.substring(text, at + len(head), F.length(text)), "\n", -1), 1, 80), "\n")
    names = F.slice(F.filter(F.transform(all_found(body, r", in ([A-Za-z_][\w:<>,~ &*0-9]*)"), strip), lambda n: (n != "") & ~n.rlike(LFORTRAN_NOISE)), 1, 3)
    return F.when(at > 0, let(names, lambda n: F.when(F.size(n) > 0, F.concat(F.lit(" ["), F.array_join(n, " > "), F.lit("]"))).otherwise(F.lit("")))).otherwise(F.lit(""))


def internal_error(text: Column) -> Column:
    inner = F.substring(text, F.locate("Internal Compiler Error", text), F.length(text))
    detail = r"\n(\w[\w:]*): (.+)"
    return F.concat(F.lit("ICE"), F.coalesce(F.concat(F.lit(": "), found(inner, detail, 1), F.lit(": "), strip(found(inner, detail, 2))), F.lit("")), fortran_frames(text))


#: Signals and internal errors carry the first three frames of the traceback but noise.
lfortran = Cascade(
    *SANITIZERS,
    Rule("both", "Internal Compiler Error", internal_error),
    Rule("both", "Segfault: Signal SIGSEGV", lambda text: F.concat(F.lit("SIGSEGV"), fortran_frames(text))),
    Rule("both", "Abort: Signal SIGABRT", lambda text: F.concat(F.lit("SIGABRT"), fortran_frames(text))),
    Rule("both", "terminate called after throwing", lambda text: tagged("terminate: ", found(text, r"terminate called after throwing an instance of '([^']+)'"))),
    said_by("both", "runtime_error:", r"runtime_error:\s*([^\n]+)", "runtime_error: "),
    said_by("both", "std::exception:", r"std::exception:\s*([^\n]+)", "std::exception: "),
    named("both", "Unknown Exception", "Unknown Exception"),
    named("both", "Aborted", "Aborted"),
    named("both", "Segmentation fault", "Segmentation fault"),
    *BASE,
)


def said(text: Column) -> Column:
    """The first error message: a redeclared name and absolute paths are left out, a line number is added."""
    again = lambda m: found(m, r"(?i)^(Cannot redeclare \w+)")
    plain = lambda m: F.substring(strip(F.regexp_replace(m, r"/\S+", "")), 1, 100)
    at = F.coalesce(tagged("_L", found(text, r"(?:-->|at)\s+[^:]+:(\d+):\d+")), F.lit(""))
    return let(strip(found(text, r"(?i)error:\s+(.{4,120})")), lambda m: F.coalesce(again(m), F.concat(plain(m), at)))


def groups(pattern: str, *parts: str | int) -> Callable[[Column], Column]:
    """Fixed texts and groups of the first match, joined."""
    return lambda text: F.concat(*(F.lit(p) if isinstance(p, str) else strip(found(text, pattern, p)) for p in parts))


def first_line(err: Column) -> Column:
    own = F.get(F.filter(F.transform(lines(err), strip), lambda x: (x != "") & ~x.startswith("=")), F.lit(0))
    return tagged("Stderr:", F.substring(own, 1, 120))


#: Where a panic was.
PANIC = r"panicked at ([^:]+\.rs:\d+:\d+):\s*\n?(.*)"
#: What is left when a project's own cascade finds nothing.
generic = Cascade(
    Rule("lined", "SUMMARY: AddressSanitizer:", groups(r"SUMMARY: AddressSanitizer:\s+(\S+).*?in (\S+)\s+(\S+:\d+)", "ASAN:", 1, "_in_", 2, "_at_", 3)),
    said_by("lined", "SUMMARY: AddressSanitizer:", r"SUMMARY: AddressSanitizer:\s+(.*)", "ASAN:", 120),
    said_by("lined", "SUMMARY: UndefinedBehaviorSanitizer:", r"SUMMARY: UndefinedBehaviorSanitizer:\s+(.*)", "UBSAN:", 120),
    said_by("lined", "internal compiler error:", r"internal compiler error:.*", most=200, group=0),
    Rule("lined", "panicked at ", lambda text: F.concat(F.lit("RustPanic:"), strip(found(text, PANIC, 1)), F.lit(":"), F.substring(strip(found(text, PANIC, 2)), 1, 80))),
    said_by("lined", "Assertion `", r"Assertion `(.{1,120})' failed", "Assertion:"),
    said_by("lined", "Assertion failed: (", r"Assertion failed: \((.{1,120})\)", "LLVMAssert:"),
    said_by("lined", "llvm_unreachable executed at ", r"llvm_unreachable executed at ([^:]+:\d+)", "Unreachable:"),
    said_by("lined", "fatal error: error in backend: ", r"fatal error: error in backend: (.{1,100})", "BackendError:"),
    Rule("lined", "error:", lambda text: tagged("Error:", said(text)), fold=True),
    Rule("lined", "signal:", lambda text: tagged("Signal:", found(text, r"(?i)signal:\s+(\w+)")), fold=True),
    Rule("lined", "", lambda text: F.when(F.contains(text, F.lit("Segmentation fault")) | F.contains(text, F.lit("SIGSEGV")), "SIGSEGV")),
    Rule("lined", "", lambda text: F.when(F.contains(text, F.lit("Aborted")) | F.contains(text, F.lit("SIGABRT")), "SIGABRT")),
    Rule("err", "", first_line),
)
#: The form that reduction compares by.
reducer = Cascade(*(said_by(t, part, pattern) for part, pattern in (("SUMMARY: ", r"(SUMMARY: .*)"), ("Assertion", r"(Assertion[^:]*:.*)")) for t in ("err", "out")))

#: A project's own cascade; rust and mlir have none, so the base is theirs.
CASCADES: dict[str, Cascade] = {"cpython": cpython, "clang": clang, "php": php, "swift": swift, "haskell": haskell, "flang": flang, "lfortran": lfortran, "rust": base, "mlir": base}


def signature_for(project: Column, out: Column, err: Column, cascades: dict[str, Cascade] = CASCADES) -> Column:
    """G12 as one expression: the project's cascade, then the generic one; null if neither finds anything."""
    out, err = F.coalesce(out, F.lit("")), F.coalesce(err, F.lit(""))
    own = F.lit(None).cast("string")
    for name, cascade in cascades.items():
        own = F.when(project == name, cascade(out, err)).otherwise(own)
    # A signature that is found but empty is no signature.
    return F.coalesce(F.nullif(own, F.lit("")), generic(out, err))


def with_signature(rows: DataFrame, project: Column, out: Column, err: Column, only: Column | None = None, name: str = "signature", cascades: dict[str, Cascade] = CASCADES, last: Cascade | None = generic) -> DataFrame:
    """rows with their signatures by G12 in a new column; without a last cascade by the projects' own alone.

    The texts that rules read are columns of a projection before, the rules of all cascades one of the next, so that their
    code is generated and split. Only rows for which `only` holds get a signature. It is found once for each row: it is
    marked as no fixed function of the row, as a condition on it would else be carried below and found there again.
    """
    text = lambda c: F.coalesce(c, F.lit("")) if only is None else F.when(only, F.coalesce(c, F.lit("")))
    read = rows.withColumns({"__project": project, "__err": text(err), "__out": text(out)})
    read = read.withColumns({"__both": F.concat("__err", "__out"), "__lined": F.concat("__err", F.lit("\n"), "__out")})
    tried = lambda rules: F.coalesce(*(r.of(F.col(f"__{r.over}")) for r in rules))
    owners: dict[Cascade, list[str]] = {}
    for p, cascade in cascades.items():
        owners.setdefault(cascade, []).append(p)
    own = reduce(lambda rest, pair: F.when(F.col("__project").isin(*pair[1]), tried(pair[0].rules)).otherwise(rest), owners.items(), F.lit(None).cast("string"))
    # A signature that is found but empty is no signature.
    sig = F.nullif(own, F.lit("")) if last is None else F.coalesce(F.nullif(own, F.lit("")), tried(last.rules))
    once = F.when(F.rand(0) + 1 > 0, sig)  # always, which the optimizer does not see; streams take it too
    return read.withColumn(name, once).drop("__project", "__err", "__out", "__both", "__lined")
