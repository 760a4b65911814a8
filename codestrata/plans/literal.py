"""Registered queries of the sources: small fixed trees, with what they must give spelled out as SQL values."""

from __future__ import annotations

import io
import tempfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import links, owners
from codestrata.functions.storage import fresh_path
from codestrata.operators import calls, graph, listing, ownership, reports, text
from codestrata.plans.catalogue import ENTRY_SYMBOLS, Tables, query
from codestrata.sources import cscan, makefiles, sinks, snapshot, tree
from codestrata.sources.owners import parse_sections

HEADER = """#ifndef DEMO_H
#define DEMO_H
#define LIMIT 8
/**
 * struct frame - what is sent
 * @size: bytes in all
 * @lost: no such member
 */
struct frame {
	int size;
	unsigned int kind:4, :2;
	/** @next: the one after */
	struct frame *next;
	int (*done)(struct frame *f);
	union {
		long raw;
		struct { short lo, hi[2]; } pair;
	};
#ifdef CONFIG_STATS
	DECLARE_BITMAP(seen, 16); /* which came */
#endif
	/* private: */
	struct_group(times, long start; long end;);
	char data[];
};
typedef struct frame frame_t;
enum state { IDLE, BUSY };
int frame_send(struct frame *f);
#endif
"""
SOURCE = """#include "demo.h"
#include "part.c"
static DEFINE_MUTEX(demo_lock);
static DEVICE_ATTR_RW(mode);
int demo_count;
#define STEP(x) ((x) + 1)
/**
 * frame_send - send one frame
 * @f: the frame
 *
 * Sends it now.
 * Context: any
 * Return: zero or an error
 */
int frame_send(struct frame *f)
{
	if (check(f))
		return f->done(f);
	demo_count = STEP(demo_count);
	return queue(f, "text(not a call)");
}
EXPORT_SYMBOL_GPL(frame_send);
#undef STEP
static inline int later(int (*fn)(int))
{
	return fn(STEP(1)) + queue(0, 0);
}
SYSCALL_DEFINE1(demo, int, n)
{
	return later(0) + n;
}
"""
BROKEN = "int first(void)\n{\n\tif (x {\n}\n\nint second(void)\n{\n\treturn first();\n}\n"
TREE = {"demo/demo.h": HEADER, "demo/demo.c": SOURCE, "demo/broken.c": BROKEN}


def _values(columns: str, rows: list[tuple]) -> str:
    def literal(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + str(v).replace("'", "''") + "'"

    names = columns.split()
    return "x AS (SELECT 1) SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({', '.join(names)})"


def _parsed(t: Tables) -> DataFrame:
    files = t.spark.createDataFrame([(p, x, "parsed") for p, x in TREE.items()], "path string, content string, index_status string")
    return tree.parse_sources(files)


_SYMBOLS = [
    ("demo/demo.h", "DEMO_H", "macro", 2, 2, False, False, False),
    ("demo/demo.h", "LIMIT", "macro", 3, 3, False, False, False),
    ("demo/demo.h", "frame", "struct", 9, 25, False, False, False),
    ("demo/demo.h", "frame_t", "typedef", 26, 26, False, False, False),
    ("demo/demo.h", "state", "enum", 27, 27, False, False, False),
    ("demo/demo.h", "frame_send", "prototype", 28, 28, False, False, False),
    ("demo/demo.c", "demo_lock", "variable", 3, 3, True, False, False),
    ("demo/demo.c", "dev_attr_mode", "variable", 4, 4, True, False, False),
    ("demo/demo.c", "demo_count", "variable", 5, 5, False, False, False),
    ("demo/demo.c", "STEP", "macro", 6, 6, False, False, False),
    ("demo/demo.c", "frame_send", "function", 15, 21, False, False, True),
    ("demo/demo.c", "later", "function", 24, 27, True, True, False),
    ("demo/demo.c", "sys_demo", "syscall", 28, 31, False, False, False),
    ("demo/broken.c", "first", "function", 1, 4, False, False, False),
    ("demo/broken.c", "second", "function", 6, 9, False, False, False),
]


@query(_values("path name kind start_line end_line is_static is_inline is_exported", _SYMBOLS))
def parsed_symbols(t: Tables) -> DataFrame:
    """Definitions, declaration macros, generated attributes, system calls and exports; a broken function costs only itself."""
    return _parsed(t).select("path", F.inline("symbols")).select("path", "name", "kind", "start_line", "end_line", "is_static", "is_inline", "is_exported")


@query(_values("ordinal parent depth name kind bit_width dimensions description description_source visibility conditional line declaration", [
    (0, None, 0, "size", "field", None, "", "bytes in all", "kernel-doc", "unspecified", False, 10, "int size"),
    (1, None, 0, "kind", "field", "4", "", None, None, "unspecified", False, 11, "unsigned int kind:4"),
    (2, None, 0, None, "unnamed_bitfield", "2", "", None, None, "unspecified", False, 11, "unsigned int :2"),
    (3, None, 0, "next", "field", None, "", "the one after", "inline-kernel-doc", "unspecified", False, 13, "struct frame *next"),
    (4, None, 0, "done", "function_pointer", None, "", None, None, "unspecified", False, 14, "int (*done)(struct frame *f)"),
    (5, None, 0, None, "union", None, "", None, None, "unspecified", False, 15, "union {…}"),
    (6, 5, 1, "raw", "field", None, "", None, None, "unspecified", False, 16, "long raw"),
    (7, 5, 1, "pair", "struct", None, "", None, None, "unspecified", False, 17, "struct {…} pair"),
    (8, 7, 2, "lo", "field", None, "", None, None, "unspecified", False, 17, "short lo"),
    (9, 7, 2, "hi", "field", None, "2", None, None, "unspecified", False, 17, "short hi[2]"),
    (10, None, 0, "seen", "macro", None, "", "which came", "source-comment", "unspecified", True, 20, "DECLARE_BITMAP(seen, 16)"),
    (11, None, 0, "times", "struct_group", None, "", None, None, "private", False, 23, "struct_group(times)"),
    (12, 11, 1, "start", "field", None, "", None, None, "private", False, 23, "long start"),
    (13, 11, 1, "end", "field", None, "", None, None, "private", False, 23, "long end"),
    (14, None, 0, "data", "field", None, "[]", None, None, "private", False, 24, "char data[]"),
]))
def parsed_members(t: Tables) -> DataFrame:
    """A structure's members in preorder, nested and grouped ones too, with their documentation and where it is from."""
    m = _parsed(t).select(F.inline("members"))
    dims = F.when(F.size("array_dimensions") == 0, "").when(F.col("array_dimensions")[0] == "", "[]").otherwise(F.col("array_dimensions")[0])
    conditional = F.array_contains("conditions", "defined(CONFIG_STATS)")
    return m.select("ordinal", "parent", "depth", "name", "kind", "bit_width", dims.alias("dimensions"), "description", "description_source", "visibility", conditional.alias("conditional"), "line", "declaration")


@query(_values("path caller callee kind line byte_offset", [
    ("demo/demo.c", "frame_send", "check", "direct", 17, SOURCE.index("check(f)")),
    ("demo/demo.c", "frame_send", "done", "indirect", 18, SOURCE.index("done(f)")),
    ("demo/demo.c", "frame_send", "STEP", "macro", 19, SOURCE.index("STEP(demo_count)")),
    ("demo/demo.c", "frame_send", "queue", "direct", 20, SOURCE.index("queue(f")),
    ("demo/demo.c", "later", "fn", "indirect", 26, SOURCE.index("fn(STEP")),
    ("demo/demo.c", "later", "STEP", "direct", 26, SOURCE.index("STEP(1)")),
    ("demo/demo.c", "later", "queue", "direct", 26, SOURCE.index("queue(0")),
    ("demo/demo.c", "sys_demo", "later", "direct", 30, SOURCE.index("later(0)")),
    ("demo/broken.c", "second", "first", "direct", 8, BROKEN.index("first();")),
]))
def parsed_call_sites(t: Tables) -> DataFrame:
    """Calls in code only: direct, through members and arguments, and by macros as long as they are defined."""
    return _parsed(t).select("path", F.inline("sites")).select("path", "caller", "callee", "kind", "line", "byte_offset")


@query(_values("name line summary parameter told description context returns", [("frame_send", 7, "send one frame", "f", "the frame", "Sends it now.", "any", "zero or an error")]))
def parsed_contracts(t: Tables) -> DataFrame:
    rows = _parsed(t).select(F.inline("contracts"))
    return rows.select("name", "line", "summary", F.col("parameters")[0]["name"].alias("parameter"), F.col("parameters")[0]["text"].alias("told"), "description", "context", "returns")


@query(_values("path part name other line", [
    ("demo/demo.c", "include", "demo.h", "quoted", 1),
    ("demo/demo.c", "include", "part.c", "quoted", 2),
    ("demo/demo.h", "alias", "frame_t", "frame", 26),
    ("demo/demo.h", "unmatched", "lost", "no such member", 9),
    ("demo/broken.c", "warning", "unbalanced { at line 2", None, None),
]))
def parsed_evidence(t: Tables) -> DataFrame:
    """Includes, aliases, documentation of members that aren't there, and warnings."""
    p = _parsed(t)
    no = F.lit(None)
    parts = [
        p.select("path", F.inline("includes")).select("path", F.lit("include").alias("part"), "name", F.when(F.col("quoted"), "quoted").otherwise("angled").alias("other"), "line"),
        p.select("path", F.inline("aliases")).select("path", F.lit("alias"), "name", "owner", F.lit(26)),
        p.select("path", F.inline("symbols")).select("path", "start_line", F.inline("unmatched_docs")).select("path", F.lit("unmatched"), "name", "text", "start_line"),
        p.select("path", F.explode("warnings").alias("w")).select("path", F.lit("warning"), "w", no.cast("string"), no.cast("int")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(_values("declaration kind name role", [
    ("int (*cb)(struct a *s)", "struct", "a", "callback_parameter"),
    ("struct r *(*cb)(int n)", "struct", "r", "callback_return"),
    ("struct a *x", "struct", "a", "pointer_member"),
    ("union u x[4]", "union", "u", "embedded_member"),
    ("struct r f(struct q *z, enum e k)", "struct", "r", "function_return"),
    ("struct r f(struct q *z, enum e k)", "struct", "q", "function_parameter"),
    ("struct r f(struct q *z, enum e k)", "enum", "e", "function_parameter"),
]))
def type_references(t: Tables) -> DataFrame:
    """The types that declarations refer to, by role."""
    texts = ["int (*cb)(struct a *s)", "struct r *(*cb)(int n)", "struct a *x", "union u x[4]", "struct a {…} x", "struct r f(struct q *z, enum e k)"]
    rows = [(x, *r) for x in texts for r in cscan.references(x, function=" f(" in x)]
    return t.spark.createDataFrame(rows, "declaration string, kind string, name string, role string")


@query(_values("text part at", [("a, f(b, c), {d, e}", "a", 0), ("a, f(b, c), {d, e}", "f(b, c)", 1), ("a, f(b, c), {d, e}", "{d, e}", 2), ("x", "x", 0)]).replace("part, at)", "part, place)"))
def split_arguments(t: Tables) -> DataFrame:
    """Arguments are split at commas outside brackets."""
    rows = [(x, cscan.squash(p), k) for x in ("a, f(b, c), {d, e}", "x") for k, p in enumerate(cscan.split_arguments(x))]
    return t.spark.createDataFrame(rows, "text string, part string, place int")


OWNER_FILE = """Some prose first.

RED SYSTEM
M:	One <one@example.org>
M:	Two <two@example.org>
L:	red@example.org
S:	Maintained
F:	red/
F:	include/red*.h
X:	red/old/
N:	red_[a-z]+

BLUE SYSTEM
S:	Orphan
F:	blue/**/x?.c

THE REST
S:	Buried
F:	*
F:	*/
"""


@query(_values("id name status tag value", [
    (0, "RED SYSTEM", "Maintained", "maintainers", "One <one@example.org>"),
    (0, "RED SYSTEM", "Maintained", "maintainers", "Two <two@example.org>"),
    (0, "RED SYSTEM", "Maintained", "lists", "red@example.org"),
    (0, "RED SYSTEM", "Maintained", "files", "red/"),
    (0, "RED SYSTEM", "Maintained", "files", "include/red*.h"),
    (0, "RED SYSTEM", "Maintained", "excludes", "red/old/"),
    (0, "RED SYSTEM", "Maintained", "regexes", "red_[a-z]+"),
    (1, "BLUE SYSTEM", "Orphan", "files", "blue/**/x?.c"),
    (2, "THE REST", "Buried", "files", "*"),
    (2, "THE REST", "Buried", "files", "*/"),
]))
def owner_sections(t: Tables) -> DataFrame:
    """The ownership file's sections, a row per tagged line."""
    rows = [(s["id"], s["name"], s["status"], tag, v) for s in parse_sections(OWNER_FILE) for tag, vs in s.items() if isinstance(vs, list) for v in vs]
    return t.spark.createDataFrame(rows, "id long, name string, status string, tag string, value string")


@query(_values("pattern score", [("fs/ext4/", 48), ("fs/*/inode.c", 30), ("drivers/clk/*imx*", 58), ("*", -1000), ("*/", -1000), ("README", 6), ("kernel/[ab]x/", 33)]))
def pattern_precision(t: Tables) -> DataFrame:
    """How precise ownership patterns are: 20 a literal slash, the literal prefix, and what constrains a wildcard."""
    patterns = ["fs/ext4/", "fs/*/inode.c", "drivers/clk/*imx*", "*", "*/", "README", "kernel/[ab]x/"]
    return t.spark.createDataFrame([(p, owners.specificity(p)) for p in patterns], "pattern string, score long")


@query(_values("pattern score", [("imx", 36), ("[^a-z]sti[^a-z]", 36), ("rtc-(foo|extraordinary)", 56), ("^", 30), ("a" * 40, 80)]))
def name_precision(t: Tables) -> DataFrame:
    """How precise name patterns are: 30 and twice the longest literal run, 80 at most."""
    return t.spark.createDataFrame([(p, owners.name_specificity(p)) for p in ("imx", "[^a-z]sti[^a-z]", "rtc-(foo|extraordinary)", "^", "a" * 40)], "pattern string, score long")


@query("p AS (SELECT * FROM (VALUES ('red/a.c', 'red/', TRUE), ('red/b/c.c', 'red/', TRUE), ('redder.c', 'red/', FALSE), ('red/a.c', 'red/*', TRUE), ('red/b/c.c', 'red/*', FALSE), ('red/b/c.c', 'red/*/', TRUE), ('red/x.c', 'red/?.c', TRUE), ('red/xy.c', 'red/?.c', FALSE), ('b/c/red.h', '**/red.h', TRUE), ('a.c', 'a.c', TRUE), ('axc', 'a.c', FALSE)) v(path, pattern, fits)) SELECT * FROM p")
def pattern_matches(t: Tables) -> DataFrame:
    """Ownership patterns as anchored expressions, which Spark applies."""
    pairs = [("red/a.c", "red/"), ("red/b/c.c", "red/"), ("redder.c", "red/"), ("red/a.c", "red/*"), ("red/b/c.c", "red/*"), ("red/b/c.c", "red/*/"), ("red/x.c", "red/?.c"), ("red/xy.c", "red/?.c"), ("b/c/red.h", "**/red.h"), ("a.c", "a.c"), ("axc", "a.c")]
    rows = t.spark.createDataFrame([(a, b, owners.path_regex(b)) for a, b in pairs], "path string, pattern string, regex string")
    return rows.select("path", "pattern", F.expr("path rlike regex").alias("fits"))


MAKEFILE = """VERSION = 6
PATCHLEVEL = 12
SUBLEVEL = 7
EXTRAVERSION = -rc2
obj-y += a.o b.o \\
	c.o # not d.o
obj-$(CONFIG_M) += m.o
b-objs := p.o q.o
all:
	obj-y += no.o
define SKIPPED
obj-y += no2.o
endef
hostprogs := gen
"""


@query(_values("part name value", [
    ("version", "6.12.7-rc2", None), ("root", "d/a.c", None), ("root", "d/p.c", None), ("root", "d/q.c", None), ("root", "d/c.c", None), ("root", "d/m.c", None), ("root", "d/gen.c", None), ("domain", "d/gen.c", "program:d:gen"),
    ("assignment", "VERSION", "6"), ("assignment", "PATCHLEVEL", "12"), ("assignment", "SUBLEVEL", "7"), ("assignment", "EXTRAVERSION", "-rc2"), ("assignment", "obj-y", "a.o b.o c.o"), ("assignment", "obj-$(CONFIG_M)", "m.o"), ("assignment", "b-objs", "p.o q.o"), ("assignment", "hostprogs", "gen"),
]))
def makefile_evidence(t: Tables) -> DataFrame:
    """Version, objects of their own, programs and logical assignments of a Makefile."""
    roots, domains = makefiles.targets("d", MAKEFILE, {f"d/{x}.c" for x in ("a", "b", "c", "d", "m", "p", "q", "no", "no2", "gen")})
    rows = [("version", makefiles.detect_version(MAKEFILE), None), *(("root", r, None) for r in sorted(roots)), *(("domain", k, v) for k, v in domains.items()), *(("assignment", n, " ".join(v.split())) for n, _, v in makefiles.assignments(MAKEFILE))]
    return t.spark.createDataFrame(rows, "part string, name string, value string")


_IMAGES = [
    ("tools/x/y.bpf.c", "isolated:tools/x/y.bpf.c"), ("drivers/firmware/efi/libstub/file.c", "image:efi-stub"), ("arch/x86/boot/compressed/misc.c", "image:arch:x86:boot-compressed"), ("arch/x86/boot/main.c", "image:arch:x86:boot"), ("arch/x86/purgatory/p.c", "image:arch:x86:purgatory"), ("arch/arm/vdso/vgettimeofday.c", "image:arch/arm/vdso"), ("arch/arm/vdso/vma.c", None), ("mm/slab.c", None),
]


@query(_values("path domain", _IMAGES))
def image_domains(t: Tables) -> DataFrame:
    """The separately linked images that paths belong to."""
    return t.spark.createDataFrame([(p, makefiles.image_domain(p)) for p, _ in _IMAGES], "path string, domain string")


_INCLUDES = [
    ("a/b.c", "c.h", True, "a/c.h"),
    ("a/b.c", "../x/d.h", True, "x/d.h"),
    ("a/b.c", "linux/fs.h", False, "include/linux/fs.h"),
    ("arch/arm/k/s.c", "asm/io.h", False, "arch/arm/include/asm/io.h"),
    ("a/b.c", "linux/types.h", False, "include/uapi/linux/types.h"),
    ("a/b.c", "c.h", False, None),
    ("a/b.c", "nowhere.h", True, None),
    ("drv/net/n.c", "drv.h", False, "drv/include/drv.h"),
    ("drv/net/n.c", "own.h", False, "drv/net/inc/own.h"),
    ("drv/net/one.c", "only.h", False, "lib/one/only.h"),
    ("drv/net/n.c", "only.h", False, None),
    ("drv/other.c", "own.h", False, None),
]
_FLAGS = {"drv": "subdir-ccflags-y += -I$(srctree)/drv/include\n", "drv/net": "ccflags-y := -I$(src)/inc -I$(VENDOR)/x -I/usr/include -DX\nCFLAGS_one.o += -I lib/one\n"}


@query(_values("includer name quoted target", _INCLUDES))
def include_targets(t: Tables) -> DataFrame:
    """The files that includes mean: beside the includer, in the usual directories, or in those that Makefiles add."""
    known = {"a/c.h", "x/d.h", "include/linux/fs.h", "include/uapi/linux/types.h", "arch/arm/include/asm/io.h", "drv/include/drv.h", "drv/net/inc/own.h", "lib/one/only.h"}
    flags = {d: makefiles.include_flags(d, text) for d, text in _FLAGS.items()}
    return t.spark.createDataFrame([(a, b, q, makefiles.include_target(a, b, q, known, flags)) for a, b, q, _ in _INCLUDES], "includer string, name string, quoted boolean, target string")


_FILES = [("x.c", b"a\nb", 3, 2, "parsed", True), ("x.h", b"", 0, 0, "parsed", True), ("y.c", b"a\0b\n", 4, 1, "skipped_binary", False), ("logo.png", b"\0", 1, 1, "binary", False), ("README", b"one\ntwo\n", 8, 2, "indexed", False), ("Documentation/a.rst", b"Title\n", 6, 1, "indexed", True), ("Makefile", b"x = 1", 5, 1, "indexed", True), ("big.c", b"x\n" * ((tree.PARSE_CAP >> 1) + 1), tree.PARSE_CAP + 2, (tree.PARSE_CAP >> 1) + 1, "skipped_oversize", False)]


@query(_values("path size lines status has_text", [(p, s, n, st, k) for p, _, s, n, st, k in _FILES]))
def file_status(t: Tables) -> DataFrame:
    """What becomes of a file by its name, size and first bytes, read in steps."""
    rows = []
    for path, raw, *_ in _FILES:
        size, lines, status, kept = tree.read_counted(io.BytesIO(raw), path, 1000)
        rows.append((path, size, lines, status, kept is not None))
    return t.spark.createDataFrame(rows, "path string, size long, lines long, status string, has_text boolean")


@query(_values("place line", [(0, "a/"), (1, "  b/"), (2, "    c.c"), (3, "    d.c"), (4, "  e.c"), (5, "f.c")]))
def tree_view(t: Tables) -> DataFrame:
    """Paths as an indented tree."""
    return t.spark.createDataFrame(list(enumerate(sinks.tree_lines(["f.c", "a/e.c", "a/b/d.c", "a/b/c.c"]))), "place int, line string")


# Inputs that are refused, one row each.


@query(_values("case_ refused", [
    ("symbols by size", True), ("files by size", False), ("unknown sort", True), ("unknown kind", True), ("kinds by alias", False), ("invalid expression", True), ("unknown static mode", True), ("depth 65", True), ("5001 nodes", True), ("empty text", True), ("text of 1025 characters", True),
    ("mention of two words", True), ("mention of an identifier", False), ("scope above", True), ("absolute scope", True), ("scope with drive", True), ("plain scope", False), ("unknown direction", True), ("unknown section order", True), ("unknown column", True), ("subsystem level without ownership", True),
]))
def refusals(t: Tables) -> DataFrame:
    """What operators refuse, before any job runs."""
    none = t.spark.createDataFrame([], "caller_id long, callee_id long, resolution string, node long, neighbour long")
    tree_scope = listing.build_scope("", "dir", "tree")
    documents = t.documents
    cases = {
        "symbols by size": lambda: listing.collect(tree_scope, t.dirs, t.files, t.symbols, kinds=["function"], sort="size"),
        "files by size": lambda: listing.collect(tree_scope, t.dirs, t.files, t.symbols, kinds=["file"], sort="size"),
        "unknown sort": lambda: listing.order_of("colour"),
        "unknown kind": lambda: listing.kinds_of(["gadget"]),
        "kinds by alias": lambda: listing.kinds_of(["types", "functions"]),
        "invalid expression": lambda: listing.search(t.symbols, t.files, "", grep="(["),
        "unknown static mode": lambda: listing.search(t.symbols, t.files, "", static="maybe"),
        "depth 65": lambda: graph.explore(none, 0, depth=65),
        "5001 nodes": lambda: graph.explore(none, 0, max_nodes=5001),
        "empty text": lambda: text.search(documents, " "),
        "text of 1025 characters": lambda: text.search(documents, "x" * 1025),
        "mention of two words": lambda: text.search(documents, "two words", mention=True),
        "mention of an identifier": lambda: text.search(documents, "one_word", mention=True),
        "scope above": lambda: text.in_documentation("../fs"),
        "absolute scope": lambda: text.in_documentation("/Documentation/fs"),
        "scope with drive": lambda: text.in_documentation("c:/fs"),
        "plain scope": lambda: text.in_documentation("fs/"),
        "unknown direction": lambda: calls.flows(t.calls, t.symbols, t.claims, t.sections, 1, "sideways"),
        "unknown section order": lambda: ownership.section_list(t.sized_sections, "age"),
        "unknown column": lambda: listing.projected(listing.search(t.symbols, t.files, "x"), ["colour"]),
        "subsystem level without ownership": lambda: listing.build_scope("fs", "dir", "subsystem"),
    }
    rows = []
    for name, act in cases.items():
        try:
            act()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return t.spark.createDataFrame(rows, "case_ string, refused boolean")


@query(_values("version tag archive", [
    ("6.12.104", "v6.12.104", "https://cdn.kernel.org/pub/linux/kernel/v6.x/linux-6.12.104.tar.xz"), ("v6.18", "v6.18", "https://cdn.kernel.org/pub/linux/kernel/v6.x/linux-6.18.tar.xz"), ("6.12.0", None, None), ("next-20260101", None, None), ("2.6.32.1", "v2.6.32.1", "https://cdn.kernel.org/pub/linux/kernel/v2.x/linux-2.6.32.1.tar.xz"),
]))
def release_archives(t: Tables) -> DataFrame:
    """Tags and archives of releases; what is no release has neither."""
    return t.spark.createDataFrame([(v, links.release_tag(v), links.archive_url(v)) for v in ("6.12.104", "v6.18", "6.12.0", "next-20260101", "2.6.32.1")], "version string, tag string, archive string")


@query(f"{ENTRY_SYMBOLS} SELECT kind, name, path, CAST(line AS VARCHAR) AS line, CASE WHEN is_static THEN 'true' ELSE 'false' END AS static FROM entries WHERE kind = 'struct'", "k_symbols k_files")
def csv_entries(t: Tables) -> DataFrame:
    """Entries written as CSV and read back."""
    path = fresh_path(t.spark, "entries.csv")
    sinks.write_csv(listing.projected(listing.search(t.symbols, t.files, "", kinds=["struct"], limit=0), ["kind", "name", "path", "line", "static"]), path)
    return t.spark.read.option("header", "true").csv(path)


_LIFE = {
    "Makefile": "VERSION = 6\nPATCHLEVEL = 12\nSUBLEVEL = 1\n",
    "MAINTAINERS": OWNER_FILE,
    "red/a.c": "static int helper(int x)\n{\n\treturn x;\n}\n\nint red_one(int x)\n{\n\treturn helper(x) + missing(x);\n}\n",
    "red/Makefile": "obj-y += a.o\n",
    "red/old/b.c": "int old(void)\n{\n\treturn red_one(1);\n}\n",
    "include/red.h": HEADER,
    "Documentation/red.rst": "Red\n===\n\nAbout red_one.\n",
    "blob.c": "\0\1",
}


@query(_values("part name value", [
    *(("file", p, s) for p, s in (("Makefile", "indexed"), ("MAINTAINERS", "indexed"), ("red/a.c", "parsed"), ("red/Makefile", "indexed"), ("red/old/b.c", "parsed"), ("include/red.h", "parsed"), ("Documentation/red.rst", "indexed"), ("blob.c", "skipped_binary"), ("red/link.c", "symlink"))),
    ("owner", "red/a.c", "RED SYSTEM"), ("owner", "include/red.h", "RED SYSTEM"), ("owner", "red/old/b.c", "THE REST"), ("owner", "blob.c", "THE REST"), ("owner", "Makefile", "THE REST"), ("owner", "MAINTAINERS", "THE REST"), ("owner", "red/Makefile", "RED SYSTEM"), ("owner", "Documentation/red.rst", "THE REST"), ("owner", "red/link.c", "RED SYSTEM"),
    ("call", "red_one to helper", "same_file"), ("call", "red_one to missing", "unresolved"), ("call", "old to red_one", "unique_global"),
    ("count", "symbols", "8"), ("count", "files", "9"), ("count", "dirs", "5"), ("count", "call_sites", "3"), ("count", "document_text", "1"),
    ("published", "all", "6.12.1,6.13"), ("default", "latest", "6.13"), ("default", "pinned", "6.12.1"), ("manifest", "faults", "none"), ("manifest", "faults of a wrong count", "counts.files"), ("prefix", "6.12", "6.12.1"), ("missing", "6.14", "refused"),
]))
def snapshot_lifecycle(t: Tables) -> DataFrame:
    """A small tree scanned, parsed, owned and resolved, published under two names, pinned, opened and checked."""
    root = fresh_path(t.spark, "tree")
    with tempfile.TemporaryDirectory() as made:  # the driver's own: what the executors read is in the shared folder
        for path, content in _LIFE.items():
            (Path(made) / path).parent.mkdir(parents=True, exist_ok=True)
            (Path(made) / path).write_text(content)
        (Path(made) / "red/link.c").symlink_to("a.c")
        tree.upload(t.spark, made, root)
    built = snapshot.build(t.spark, root)
    store = fresh_path(t.spark, "snapshots")
    for name in ("6.12.1", "6.13"):
        snapshot.publish(built, store, name)
    names = snapshot.list_snapshots(store, t.spark)
    latest = snapshot.default_snapshot(t.spark, store)
    snapshot.pin(t.spark, store, "6.12")
    pinned = snapshot.default_snapshot(t.spark, store)
    c = snapshot.open_snapshot(t.spark, f"{store}/{pinned}")
    try:
        snapshot.open_snapshot(t.spark, f"{store}/6.14")
        missing = "opened"
    except (PySparkException, Py4JJavaError):
        missing = "refused"
    where = c.files.select(F.col("id").alias("ref_id"), "path")
    owned = c.path_subsys.filter("is_primary").join(where, "ref_id").join(c.subsystems.select(F.col("id").alias("subsystem_id"), "name"), "subsystem_id")
    callers = c.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"))
    rows = [("file", r["path"], r["index_status"]) for r in c.files.collect()] + [("owner", r["path"], r["name"]) for r in owned.collect()]
    rows += [("call", f"{r['caller']} to {r['callee']}", r["resolution"]) for r in c.calls.join(callers, "caller_id").collect()]
    rows += [("count", k, str(c.manifest["counts"][k])) for k in ("symbols", "files", "dirs", "call_sites", "document_text")]
    wrong = c.manifest | {"counts": c.manifest["counts"] | {"files": 1}}
    rows += [("published", "all", ",".join(names)), ("default", "latest", latest), ("default", "pinned", pinned), ("manifest", "faults", ",".join(reports.check_manifest(c.manifest, c.tables)) or "none"), ("manifest", "faults of a wrong count", ",".join(reports.check_manifest(wrong, c.tables))), ("prefix", "6.12", snapshot.match_snapshot(names, "6.12")), ("missing", "6.14", missing)]
    return t.spark.createDataFrame(rows, "part string, name string, value string")
