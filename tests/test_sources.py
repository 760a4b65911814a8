import os

import pytest
from pyspark.sql import functions as F

from codestrata.operators import audit
from codestrata.sources import cscan, makefiles, sinks, snapshot
from codestrata.sources.owners import parse_sections

HEADER = """#ifndef A_H
#define A_H
#define LIMIT 4
#define TWICE(x) \\
	((x) * 2)
/**
 * struct packet - one unit
 * @size: how long
 *
 * More about it.
 */
struct packet {
	int size;
	unsigned flag:1, :3, mode:2;
	int (*send)(struct packet *p, int n);
	union {
		struct { int x, y[4]; };
		long raw;
	};
#ifdef CONFIG_MAP
	DECLARE_BITMAP(map, 10);
#endif
	/* private: */
	struct_group(both, int one; int two;);
	char tail[];
};
typedef struct packet packet_t;
typedef int (*handler_t)(int);
enum color { RED };
int proto(struct packet *p);
#endif
"""
SOURCE = """#include "a.h"
#include <sys/b.h>
static DEFINE_MUTEX(lock);
int counter = 4, other;
static const struct ops my_ops = { .open = do_open };
static DEVICE_ATTR_RO(size);
/**
 * do_open - opens
 * @p: the packet,
 *   all of it
 *
 * Body text.
 * Context: any
 * Return: zero
 */
static inline int do_open(struct packet *p, int (*fn)(int))
{
	int r = TWICE_HERE(2); /* helper2(1) */
	if (helper(p))
		return p->send(p, "f(x)");
	return fn(3) + proto(p);
}
#define TWICE_HERE(x) x
SYSCALL_DEFINE2(open, const char *, name, int, flags)
{
	return TWICE_HERE(do_sys(name));
}
EXPORT_SYMBOL_GPL(counter);
"""


def test_symbols():
    got = {(s.name, s.kind): s for s in cscan.parse(SOURCE).symbols}
    assert set(got) == {("lock", "variable"), ("counter", "variable"), ("other", "variable"), ("my_ops", "variable"), ("dev_attr_size", "variable"), ("do_open", "function"), ("TWICE_HERE", "macro"), ("sys_open", "syscall")}
    f = got["do_open", "function"]
    assert (f.start_line, f.end_line, f.is_static, f.is_inline) == (16, 22, True, True)
    assert got["counter", "variable"].is_exported and not got["other", "variable"].is_exported and got["sys_open", "syscall"].end_line == 27
    kinds = {(s.name, s.kind) for s in cscan.parse(HEADER).symbols}
    assert kinds == {("A_H", "macro"), ("LIMIT", "macro"), ("TWICE", "macro"), ("packet", "struct"), ("packet_t", "typedef"), ("handler_t", "typedef"), ("color", "enum"), ("proto", "prototype")}
    assert cscan.parse(HEADER).aliases == [("packet", 27, "packet_t")]


def test_members():
    rows = [(m.name, m.kind, m.parent, m.bit_width) for m in cscan.parse(HEADER).members]
    assert rows == [
        ("size", "field", None, None), ("flag", "field", None, "1"), (None, "unnamed_bitfield", None, "3"), ("mode", "field", None, "2"), ("send", "function_pointer", None, None), (None, "union", None, None),
        (None, "struct", 5, None), ("x", "field", 6, None), ("y", "field", 6, None), ("raw", "field", 5, None), ("map", "macro", None, None), ("both", "struct_group", None, None), ("one", "field", 11, None), ("two", "field", 11, None), ("tail", "field", None, None),
    ]
    m = {x.name: x for x in cscan.parse(HEADER).members}
    assert m["size"].description == "how long" and m["tail"].array_dimensions == [""] and m["tail"].visibility == "private" and m["map"].conditions == ["!defined(A_H)", "defined(CONFIG_MAP)"]


def test_tagged_groups_are_types():
    p = cscan.parse("struct a {\n\tstruct_group_tagged(tag, part, int x; int y;);\n\tint z;\n};\n")
    assert [(s.name, s.kind) for s in p.symbols] == [("a", "struct"), ("tag", "struct")] and [m.name for m in p.members] == ["part", "x", "y", "z"]


def test_calls():
    got = [(s.caller, s.callee, s.kind) for s in cscan.parse(SOURCE).sites]
    assert got == [("do_open", "TWICE_HERE", "direct"), ("do_open", "helper", "direct"), ("do_open", "send", "indirect"), ("do_open", "fn", "indirect"), ("do_open", "proto", "direct"), ("sys_open", "TWICE_HERE", "macro"), ("sys_open", "do_sys", "direct")]


def test_contracts_and_includes():
    p = cscan.parse(SOURCE)
    c = p.contracts[0]
    assert (c.name, c.line, c.summary, c.parameters, c.description, c.context, c.returns) == ("do_open", 7, "opens", [("p", "the packet, all of it")], "Body text.", "any", "zero")
    assert p.includes == [("a.h", True, 1), ("sys/b.h", False, 2)]
    assert cscan.parse("/**\n * other - x\n */\nint f(void)\n{\n}\n").contracts == []


def test_broken_sources_are_scanned_on():
    p = cscan.parse("int f(void)\n{\n\tif (x {\n}\n\nint g(void)\n{\n\treturn 0;\n}\n")
    assert p.warnings and any(s.name == "g" for s in p.symbols)
    assert cscan.parse("").symbols == []


def test_references():
    assert cscan.references("int (*cb)(struct a *s)") == [("struct", "a", "callback_parameter")]
    assert cscan.references("struct a *x") == [("struct", "a", "pointer_member")] and cscan.references("union u x[4]") == [("union", "u", "embedded_member")]
    assert cscan.references("struct r f(struct q *z)", function=True) == [("struct", "r", "function_return"), ("struct", "q", "function_parameter")]
    assert cscan.references("struct a {…} x") == []


OWNERS = """Prose that is no section.

EXT4 FILE SYSTEM
M:	Someone <s@example.org>
S:	Maintained
F:	fs/ext4/
X:	fs/ext4/sub/

NOTHING MATCHES
S:	Odd fixes

THE REST
S:	Buried
F:	*
F:	*/
"""


def test_sections():
    got = parse_sections(OWNERS)
    assert [(s["id"], s["name"], s["files"], s["excludes"]) for s in got] == [(0, "EXT4 FILE SYSTEM", ["fs/ext4/"], ["fs/ext4/sub/"]), (1, "NOTHING MATCHES", [], []), (2, "THE REST", ["*", "*/"], [])]


def test_makefiles():
    text = "VERSION = 6\nPATCHLEVEL = 12\nSUBLEVEL = 104\nEXTRAVERSION =\nobj-y += a.o b.o \\\n  c.o # not d.o\nb-objs := p.o q.o\nall:\n\tobj-y += no.o\ndefine X\nobj-y += no2.o\nendef\nhostprogs := gen\n"
    assert makefiles.detect_version(text) == "6.12.104"
    roots, domains = makefiles.targets("d", text, {f"d/{x}.c" for x in ("a", "b", "c", "p", "q", "no", "no2", "gen")})
    assert roots == {"d/a.c", "d/p.c", "d/q.c", "d/c.c", "d/gen.c"} and domains == {"d/gen.c": "program:d:gen"}
    assert makefiles.image_domain("arch/x86/boot/compressed/a.c") == "image:arch:x86:boot-compressed" and makefiles.image_domain("arch/arm/vdso/v.c") == "image:arch/arm/vdso" and makefiles.image_domain("arch/arm/vdso/vma.c") is None and makefiles.image_domain("mm/a.c") is None
    assert makefiles.include_target("k/a.c", "b.c", True, {"k/b.c"}) == "k/b.c"


FILES = {
    "Makefile": "VERSION = 6\nPATCHLEVEL = 12\nSUBLEVEL = 104\n",
    "MAINTAINERS": OWNERS,
    "fs/ext4/inode.c": "static int helper(int x)\n{\n\treturn x;\n}\n\nint ext4_get(int x)\n{\n\treturn helper(x) + missing(x);\n}\n",
    "fs/ext4/super.c": HEADER + "\nint ext4_fill(int x)\n{\n\treturn ext4_get(LIMIT) + TWICE(x);\n}\n",
    "fs/ext4/sub/a.c": "int sub(void)\n{\n\treturn ext4_get(1);\n}\n",
    "fs/ext4/Makefile": "obj-y += inode.o super.o\n",
    "include/linux/fs.h": HEADER,
    "Documentation/fs/ext4.rst": "Ext4\n====\n\nAbout ext4_get.\n",
    "tools/t.c": "int main(void)\n{\n\treturn ext4_get(1);\n}\n",
    "blob.c": "\0\1",
    "empty.h": "",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / ".git").mkdir()
    (root / ".git" / "x.c").write_text("int no;")
    os.symlink("inode.c", root / "fs/ext4/link.c")
    return snapshot.build(spark, str(root))


def test_build(built):
    files = {r["path"]: r for r in built.files.collect()}
    assert set(files) == set(FILES) | {"fs/ext4/link.c"} and built.manifest["version"] == "6.12.104"
    assert files["blob.c"]["index_status"] == "skipped_binary" and files["fs/ext4/link.c"]["link_target"] == "inode.c" and files["empty.h"]["lines"] == 0
    owners = {(r["path"], r["name"]): r["is_primary"] for r in built.path_subsys.join(built.files.select(F.col("id").alias("ref_id"), "path"), "ref_id").join(built.subsystems.select(F.col("id").alias("subsystem_id"), "name"), "subsystem_id").collect()}
    assert owners["fs/ext4/inode.c", "EXT4 FILE SYSTEM"] and not owners["fs/ext4/inode.c", "THE REST"] and ("fs/ext4/sub/a.c", "EXT4 FILE SYSTEM") not in owners
    names = built.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"))
    got = {(r["caller"], r["callee"]): r["resolution"] for r in built.calls.join(names, "caller_id").collect()}
    assert got["ext4_get", "helper"] == "same_file" and got["ext4_get", "missing"] == "unresolved" and got["ext4_fill", "ext4_get"] == "unique_global" and got["main", "ext4_get"] == "unresolved" and got["ext4_fill", "TWICE"] == "macro"
    assert {r["path"] for r in built.translation_unit_roots.join(built.files.select(F.col("id").alias("file_id"), "path"), "file_id").collect()} == {"fs/ext4/inode.c", "fs/ext4/super.c"}


def test_built_evidence_holds_together(built):
    checks = audit.row_domains({k: built.tables[k] for k in ("files", "symbols", "calls", "call_sites", "path_subsys", "dir_subsys", "type_members")})
    checks |= audit.paths(built.files, built.dirs) | {"sites": audit.site_counts(built.call_sites, built.calls), "spans": audit.sites_in_spans(built.call_sites, built.symbols), "members": audit.preorder(built.type_members), "totals": audit.directory_totals(built.files, built.dirs)}
    checks |= {"symbol_file": audit.dangling(built.symbols, "file_id", built.files), "callee": audit.dangling(built.calls, "callee_id", built.symbols), "twice": audit.duplicates(built.symbols, ["file_id", "name", "kind", "start_line"])}
    assert {r["check"]: r["n"] for r in audit.violations(checks).collect()} == {k: 0 for k in checks}
    assert audit.bad_rows(built.symbols.withColumn("end_line", F.lit(0)), F.col("end_line") >= F.col("start_line")).count() == built.symbols.count()


def test_publish_and_open(spark, built, tmp_path):
    path = snapshot.publish(built, str(tmp_path))
    again = snapshot.open_snapshot(spark, path)
    assert again.manifest["counts"]["files"] == len(FILES) + 1 and again.symbols.count() == built.symbols.count()
    assert snapshot.list_snapshots(str(tmp_path)) == ["6.12.104"]
    with pytest.raises(ValueError):
        snapshot.publish(built, str(tmp_path), check=lambda c: ["bad"])
    assert snapshot.list_snapshots(str(tmp_path)) == ["6.12.104"] and not [n for n in os.listdir(tmp_path) if n.startswith(".")]


def test_versions():
    assert sorted(["6.12", "6.2", "6.12-rc1", "6.12.4"], key=snapshot.version_key) == ["6.2", "6.12-rc1", "6.12", "6.12.4"]
    assert snapshot.match_snapshot(["6.12.104", "6.1.2"], "6.12") == "6.12.104"
    with pytest.raises(ValueError):
        snapshot.match_snapshot(["6.12.104", "6.12.4"], "6.12")


def test_sinks(spark):
    df = spark.createDataFrame([("a/b.c", 3, "f"), ("a/c.c", None, "g")], "path string, line int, name string")
    assert [r["value"] for r in sinks.plain(df).collect()] == ["a/b.c:3:f", "a/c.c:g"]
    assert '"line"' not in sinks.json_rows(df).collect()[1]["value"] and sinks.tree_lines(["a/b.c", "a/c.c"]) == ["a/", "  b.c", "  c.c"]


def test_reports(spark, built):
    from codestrata.operators import reports, targets

    t = built.tables
    counts = {r["check"]: r["n"] for r in reports.full_audit(t).collect()}
    assert len(counts) > 40 and {k: n for k, n in counts.items() if n} == {}
    found = targets.resolve("ext4_get", t["dirs"], t["files"], t["symbols"])
    card = reports.describe_target(found.target, t["dirs"], t["files"], t["symbols"], t["path_subsys"], t["subsystems"])
    assert card["owners"][0]["name"] == "EXT4 FILE SYSTEM" and card["ancestry"] == ["", "fs", "fs/ext4"] and card["linkage"] == "global"
    here = targets.resolve("fs/ext4", t["dirs"], t["files"], t["symbols"]).target
    assert reports.describe_target(here, t["dirs"], t["files"], t["symbols"], t["path_subsys"], t["subsystems"])["counts"]["n_files"] == 4
    section = lambda spec: reports.section_of(spec, t["subsystems"], t["dirs"], t["files"], t["symbols"], t["path_subsys"])
    assert section("ext4 file system") == 0 and section("ext4_get") == 0 and section("tools") is None and section("ext4 file") == 0
    lines = spark.createDataFrame([("ext4_get+0x1/0x2\nmissing+0x3/0x4",)], "text string")
    rows = reports.annotate_trace(reports.trace_frames(lines), t["symbols"], t["files"], t["path_subsys"], t["subsystems"]).orderBy("at").collect()
    assert [(r["frame"], r["path"], r["label"]) for r in rows] == [("ext4_get", "fs/ext4/inode.c", "EXT4 FILE SYSTEM"), ("missing", None, None)]
    packet = targets.symbol_targets(t["symbols"].filter("kind = 'struct'"), t["files"]).filter("path like 'include/%'").first()
    empty = spark.createDataFrame([], "file_id long, line int, owner_id long, kind string, name string, role string")
    report = reports.structure_report(packet, t["type_members"], t["type_aliases"], empty, t["symbols"], t["files"])
    assert report["aliases"] == ["packet_t"] and report["coverage"]["total"] == 15 and [m["name"] for m in report["members"]][:2] == ["size", "flag"]
    assert reports.source_lines(spark.createDataFrame([("a", "x\ny\nz")], "path string, content string"), "a", 2, 3) == ["y", "z"]
    assert reports.check_manifest(built.manifest, t) == [] and "schema_version" in reports.check_manifest(built.manifest | {"schema_version": 1}, t)


def test_member_evidence():
    p = cscan.parse("/**\n * struct a - x\n * @one: told\n * @gone: no such member\n */\nstruct a {\n\tint one;\n\t/** @two: inline */\n\tint two;\n\tint three; /* trailing */\n\tint four,\n\t\tfive;\n};\n")
    assert [(m.name, m.description, m.description_source, m.line, m.end_line) for m in p.members] == [("one", "told", "kernel-doc", 7, 7), ("two", "inline", "inline-kernel-doc", 9, 9), ("three", "trailing", "source-comment", 10, 10), ("four", None, None, 11, 12), ("five", None, None, 11, 12)]
    assert p.symbols[0].unmatched_docs == [{"name": "gone", "text": "no such member"}]


def test_byte_offsets():
    source = "int é(void);\nint f(void)\n{\n\tg(); /* ä€😀 */ h();\n\treturn k(l(1));\n}\n"
    assert [(s.callee, s.byte_offset) for s in cscan.parse(source).sites] == [(n, source.encode().index(f"{n}(".encode(), 20)) for n in ("g", "h", "k", "l")]


def test_files_are_counted_in_steps():
    import io

    from codestrata.sources import tree

    for step in (1, 3, 1 << 20):
        read = lambda raw, path: tree.read_counted(io.BytesIO(raw), path, step)
        assert read(b"a\nb", "x.c") == (3, 2, "parsed", "a\nb") and read(b"", "x.h") == (0, 0, "parsed", "")
        assert read(b"a\n\0b", "x.c") == (4, 2, "skipped_binary", None) and read(b"\0", "x.bin") == (1, 1, "binary", None)
        assert read(b"text\n", "a/README") == (5, 1, "indexed", None) and read(b"text\n", "Documentation/a.rst") == (5, 1, "indexed", "text\n")
    big = b"x\n" * (tree.PARSE_CAP // 2 + 1)
    assert tree.read_counted(io.BytesIO(big), "x.c") == (len(big), tree.PARSE_CAP // 2 + 1, "skipped_oversize", None)


def test_numbers_are_dense_in_order(spark):
    from codestrata.functions.storage import numbered

    df = spark.createDataFrame([(i * 7919 % 1000, f"r{i}") for i in range(1000)], "k int, name string").repartition(7)
    got = {r["k"]: r["id"] for r in numbered(df, "numbers", "k").collect()}
    assert got == {k: k + 1 for k in range(1000)}


def test_publish_points_and_pins(spark, built, tmp_path):
    root = str(tmp_path / "snapshots")
    os.makedirs(root)
    with pytest.raises(ValueError):
        snapshot.default_snapshot(spark, root)
    for name in ("6.9", "6.12.104"):
        snapshot.publish(built, root, name)
    first = {n for n in os.listdir(root) if n.startswith("data-")}
    snapshot.publish(built, root, "6.9")  # the name moves to new data, the old goes
    assert len(first) == 2 and len({n for n in os.listdir(root) if n.startswith("data-")}) == 2 and first != {n for n in os.listdir(root) if n.startswith("data-")}
    assert snapshot.list_snapshots(root) == ["6.9", "6.12.104"] and snapshot.default_snapshot(spark, root) == "6.12.104"
    snapshot.pin(spark, root, "6.9")
    assert snapshot.default_snapshot(spark, root) == "6.9" and snapshot.open_snapshot(spark, f"{root}/6.9").manifest["build_seconds"] > 0
    complete = {r["path"]: r["parse_complete"] for r in built.symbols.join(built.files.select(F.col("id").alias("file_id"), "path"), "file_id").collect()}
    assert all(complete.values())


def test_locals_are_called_indirectly_in_their_blocks():
    source = """int f(int (*cb)(int), handler_t given)
{
	cb(1);
	given(2);
	late(3);
	{
		handler_t late = pick();
		late(4);
	}
	late(5);
	int (*ptr)(int) = 0;
	ptr(6);
	return done(7);
}
"""
    got = [(x.callee, x.kind) for x in cscan.parse(source).sites]
    assert got == [("cb", "indirect"), ("given", "indirect"), ("late", "direct"), ("pick", "direct"), ("late", "indirect"), ("late", "direct"), ("ptr", "indirect"), ("done", "direct")]


def configurations(lines):
    """For every choice of branches of a conditional text: the M that are defined where use(n); stands, by brute force."""
    import itertools
    import re

    groups, stack = [], []
    for text in lines:
        if text.startswith("#if"):
            groups.append([1, False])
            stack.append(len(groups) - 1)
        elif text.startswith(("#elif", "#else")):
            groups[stack[-1]][0] += 1
            groups[stack[-1]][1] |= text.startswith("#else")
        elif text == "#endif":
            stack.pop()
    seen = {}
    for choice in itertools.product(*[range(n + (not closed)) for n, closed in groups]):
        stack, at, on = [], -1, False
        for text in lines:
            if text.startswith("#if"):
                at += 1
                stack.append([at, 0])
            elif text.startswith(("#elif", "#else")):
                stack[-1][1] += 1
            elif text == "#endif":
                stack.pop()
            elif all(choice[g] == b for g, b in stack):
                if text.startswith("#"):
                    on = text.startswith("#define")
                elif m := re.match(r"M\((\d+)\)", text):
                    seen[int(m[1])] = seen.get(int(m[1]), False) | on
    return seen


def test_macro_liveness_against_all_configurations():
    import random

    r = random.Random(4)
    for _ in range(300):
        lines, depth, uses = [], [], 0
        for _ in range(r.randint(3, 22)):
            kind = r.choice(["if", "elif", "else", "endif", "define", "undef", "use", "use"])
            if kind == "if" and len(depth) < 3:
                lines.append("#ifdef A")
                depth.append(False)
            elif kind == "elif" and depth and not depth[-1]:
                lines.append("#elif B")
            elif kind == "else" and depth and not depth[-1]:
                lines.append("#else")
                depth[-1] = True
            elif kind == "endif" and depth:
                lines.append("#endif")
                depth.pop()
            elif kind == "define":
                lines.append("#define M(x) x")
            elif kind == "undef":
                lines.append("#undef M")
            elif kind == "use":
                lines.append(f"M({uses});")
                uses += 1
        lines += ["#endif"] * len(depth)
        want = configurations(lines)
        got = {int(source.split(")")[0]): s.kind == "macro" for s in cscan.parse("int f(void)\n{\n" + "\n".join(lines) + "\n}\n").sites for source in [("\n".join(lines)).encode()[s.byte_offset - len("int f(void)\n{\n") :].decode().removeprefix("M(")]}
        assert got == want, lines
