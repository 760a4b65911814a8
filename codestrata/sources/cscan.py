"""A scanner for C sources: symbols, members, call sites, contracts and includes from one file's text.

It works on a copy of the text whose comments and literals are blanked, so offsets stay true, and
follows brackets instead of a grammar: a broken declaration costs only itself. What it can't
place is left out, never guessed; files with unbalanced brackets carry a warning.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import asdict, dataclass, field

KEYWORDS = frozenset("if for while switch return sizeof typeof __typeof__ do else case goto asm __asm__ __attribute__ _Static_assert static_assert defined alignof _Alignof __alignof__ int char void long short unsigned signed float double _Bool bool const struct union enum".split())
#: Macros that define an object, by the argument that names it, and generated attributes.
NAMED_FIRST = re.compile(
    r"DECLARE_(?:WORK|DELAYED_WORK|DEFERRABLE_WORK|BITMAP|COMPLETION(?:_ONSTACK)?|WAIT_QUEUE_HEAD(?:_ONSTACK)?|TIMER|TRANSPORT_CLASS|RWSEM)"
    r"|DEFINE_(?:MUTEX|SPINLOCK|RAW_SPINLOCK|RWLOCK|SEQLOCK|TIMER|STATIC_KEY_(?:TRUE|FALSE)|STATIC_KEY_ARRAY_(?:TRUE|FALSE)|STATIC_KEY_(?:FALSE_RO|DEFERRED_FALSE)|SEMAPHORE|SIMPLE_DEV_PM_OPS|XARRAY(?:_ALLOC)?|IDR|IDA|HASHTABLE|RATELIMIT_STATE)"
    r"|(?:ATOMIC|BLOCKING|RAW|SRCU)_NOTIFIER_HEAD|SIMPLE_DEV_PM_OPS|SOC_ENUM_SINGLE_DECL|(?:LIST|HLIST|LLIST)_HEAD|RADIX_TREE"
)
NAMED_SECOND = re.compile(r"(?:DEFINE|DECLARE)_PER_CPU(?:_[A-Z0-9_]+)?|DEFINE_STATIC_KEY_MAYBE")
ATTRIBUTES = {
    r"DEVICE_(?:ATTR(?:_(?:RW|RO|WO|ADMIN_RW|ADMIN_RO|RW_NAMED|RO_NAMED|WO_NAMED|IGNORE_LOCKDEP))?|(?:ULONG|INT|BOOL)_ATTR|STRING_ATTR_RO)": "dev_attr_",
    r"DRIVER_ATTR_(?:RW|RO|WO|IGNORE_LOCKDEP)": "driver_attr_",
    r"BUS_ATTR_(?:RW|RO|WO)": "bus_attr_",
    r"CLASS_ATTR_(?:RW|RO|WO|STRING)": "class_attr_",
    r"BIN_ATTR(?:_(?:RO|WO|RW|ADMIN_RO|ADMIN_RW|SIMPLE_RO|SIMPLE_ADMIN_RO))?": "bin_attr_",
    r"SENSOR_DEVICE_ATTR(?:_2)?(?:_(?:RO|WO|RW))?": "sensor_dev_attr_",
    r"IIO_DEVICE_ATTR(?:_(?:RO|WO|RW|NAMED))?": "iio_dev_attr_",
    r"IIO_CONST_ATTR(?:_NAMED)?": "iio_const_attr_",
}
FIXED_ATTRIBUTES = {
    "IIO_CONST_ATTR_SAMP_FREQ_AVAIL": "iio_const_attr_sampling_frequency_available",
    "IIO_CONST_ATTR_INT_TIME_AVAIL": "iio_const_attr_integration_time_available",
    "IIO_CONST_ATTR_TEMP_OFFSET": "iio_const_attr_in_temp_offset",
    "IIO_CONST_ATTR_TEMP_SCALE": "iio_const_attr_in_temp_scale",
}
_SYSCALL = re.compile(r"\b(COMPAT_)?SYSCALL_DEFINE\d\s*\(\s*(\w+)")
_EXPORT = re.compile(r"\bEXPORT(?:_PER_CPU)?_SYMBOL(?:_GPL|_NS|_NS_GPL|_FOR_MODULES)?\s*\(\s*(\w+)")
_AGGREGATE = re.compile(r"\b(struct|union|enum)\s+(?:__\w+(?:\([^()]*\))?\s+)*(\w+)?\s*(?:__\w+(?:\([^()]*\))?\s*)*\{")
_CALL = re.compile(r"(?<![\w.])(?:(->|\.)\s*)?([A-Za-z_]\w*)\s*\(")
_POINTER = re.compile(r"\(\s*\*\s*(?:const\s+)?(\w+)\s*(?:\[[^\]]*\]\s*)*\)\s*\(")
_LOCAL = re.compile(r"(?<=[;{}])\s*(?:(?:const|static|volatile|register|unsigned|signed|struct|union|enum)\s+)*([A-Za-z_]\w*)(?:\s*\*+\s*|\s+)(?:const\s+)?([A-Za-z_]\w*)\s*(?=[=;,\[])")
_NO_TYPE = frozenset("return goto break continue extern typedef".split())
_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


@dataclass
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    signature: str = ""
    is_static: bool = False
    is_inline: bool = False
    is_exported: bool = False
    is_anonymous: bool = False
    summary: str | None = None
    description: str | None = None
    conditions: list[str] = field(default_factory=list)
    unmatched_docs: list[dict] = field(default_factory=list)  # documented members that aren't there: name, text


@dataclass
class Member:
    owner: str
    owner_line: int
    ordinal: int
    parent: int | None
    depth: int
    name: str | None
    kind: str
    type_text: str | None
    declaration: str
    line: int
    end_line: int
    bit_width: str | None = None
    array_dimensions: list[str] = field(default_factory=list)
    description: str | None = None
    description_source: str | None = None
    visibility: str = "unspecified"
    conditions: list[str] = field(default_factory=list)


@dataclass
class Site:
    caller: str
    caller_line: int
    callee: str
    kind: str
    line: int
    byte_offset: int


@dataclass
class Contract:
    name: str
    line: int
    summary: str
    parameters: list[tuple[str, str]]
    description: str
    context: str
    returns: str


@dataclass
class Parsed:
    symbols: list[Symbol]
    members: list[Member]
    sites: list[Site]
    contracts: list[Contract]
    includes: list[tuple[str, bool, int]]  # name, quoted, line
    aliases: list[tuple[str, int, str]]  # aggregate's name, its line, typedef name
    warnings: list[str]


def squash(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def split_arguments(text: str) -> list[str]:
    """Arguments at the top level of a parenthesised list's inside."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()] if text.strip() else []


def matching(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``, -1 if none does."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    stack = []
    for i in range(at, len(text)):
        if text[i] in pairs:
            stack.append(pairs[text[i]])
        elif stack and text[i] == stack[-1]:
            stack.pop()
            if not stack:
                return i
    return -1


class Scanner:
    def __init__(self, source: str, kinds: frozenset[str] | None = None):
        self.source, self.kinds = source, kinds
        self.starts = [0, *[m.end() for m in re.finditer("\n", source)]]
        self.comments: list[tuple[int, int, str]] = []

        def hide(m: re.Match) -> str:
            if m[0].startswith("/"):
                self.comments.append((m.start(), m.end(), m[0]))
                return _blank(m[0])
            return m[0][0] + _blank(m[0][1:-1]) + m[0][-1]

        self.code = _COMMENT.sub(hide, source)
        self.out = Parsed([], [], [], [], [], [], [])
        self.macros: dict[str, list[tuple[int, bool, tuple]]] = {}  # by name: place, defined, the branches around it
        self.branches: list[tuple[int, tuple]] = [(0, ())]  # the branches around what follows a place: (conditional, branch number)
        self.choices: dict[int, int] = {}  # by conditional: how many ways through it there are, the one past all branches too
        self.conditions: list[tuple[int, list[str]]] = [(0, [])]
        self.comment_starts = [c[0] for c in self.comments]
        self.sizes: dict[int, int] = {}  # members so far, by aggregate
        self.reached = (0, 0)  # a character place and its byte place
        self._directives()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        """The byte place of a character; places mostly come in order, so only what lies between is encoded."""
        place, size = self.reached if self.reached[0] <= at else (0, 0)
        self.reached = (at, size + len(self.source[place:at].encode()))
        return self.reached[1]

    def _directives(self) -> None:
        """Preprocessor lines: macros, includes and condition stacks; then they are blanked."""
        stack: list[str] = []
        path: list[tuple[int, int]] = []
        closed: set[int] = set()  # conditionals with a final #else
        pieces, last = [], 0
        for m in re.finditer(r"^[ \t]*#[ \t]*(\w+)((?:[^\n\\]|\\\n|\\.)*)", self.code, re.M):
            word, rest, at = m[1], m[2], m.start()
            text = squash(rest.replace("\\\n", " "))
            if word in ("if", "ifdef", "ifndef"):
                stack.append({"if": text, "ifdef": f"defined({text})", "ifndef": f"!defined({text})"}[word])
                path.append((at, 0))
            elif word in ("else", "elif") and stack:
                stack[-1] = f"!({stack[-1]})" if word == "else" else text
                path[-1] = (path[-1][0], path[-1][1] + 1)
                if word == "else":
                    closed.add(path[-1][0])
            elif word == "endif" and stack:
                stack.pop()
                group, branch = path.pop()
                self.choices[group] = branch + 1 + (group not in closed)
            elif word == "define" and (d := re.match(r"\s*(\w+)", rest)):
                self.macros.setdefault(d[1], []).append((at, True, tuple(path)))
                head = re.match(r"\s*\w+(\([^)]*\))?", rest)[0]
                self.out.symbols.append(Symbol(d[1], "macro", self.line(at), self.line(m.end()), squash("#define" + " " + head.strip()), conditions=list(stack)))
            elif word == "undef":
                self.macros.setdefault(text, []).append((at, False, tuple(path)))
            elif word == "include" and (d := re.match(r"\s*(?:\"([^\"]*)\"|<([^>]*)>)", self.source[m.start(2) : m.end(2)])):
                self.out.includes.append((d[1] if d[1] is not None else d[2], d[1] is not None, self.line(at)))
            self.conditions.append((at, list(stack)))
            self.branches.append((at, tuple(path)))
            pieces += [self.code[last:at], _blank(m[0])]
            last = m.end()
        self.code = "".join([*pieces, self.code[last:]])

    def under(self, at: int) -> list[str]:
        return self.conditions[bisect_right(self.conditions, at, key=lambda c: c[0]) - 1][1]

    def comment_before(self, at: int) -> str | None:
        """The comment that ends right above a place."""
        i = bisect_right(self.comments, at, key=lambda c: c[1]) - 1
        return self.comments[i][2] if i >= 0 and not self.code[self.comments[i][1] : at].strip() else None

    def chunks(self):
        """(start, end, body start or None): top-level declarations and definitions."""
        start = at = 0
        code, n = self.code, len(self.code)
        while at < n:
            ch = code[at]
            if ch in "([":
                end = matching(code, at)
                if end < 0:
                    self.out.warnings.append(f"unbalanced {ch} at line {self.line(at)}")
                    end = code.find("\n", at) if code.find("\n", at) > 0 else n - 1
                at = end
            elif ch == "{":
                end = matching(code, at)
                if end < 0:
                    self.out.warnings.append(f"unbalanced {{ at line {self.line(at)}")
                    found = re.compile(r"^}", re.M).search(code, at)  # a closing brace in the first column ends a body
                    end = found.start() if found else n - 1
                head = code[start:at]
                if "=" not in head and re.search(r"\)\s*(?:__\w+\s*)*$", head) and not re.match(r"\s*typedef\b", head):
                    yield start, end + 1, at
                    start = end + 1
                elif re.search(r'extern\s+"\s*"\s*$|extern\s*"[^"]*"\s*$', head):
                    start = at + 1
                    at += 1
                    continue
                at = end
            elif ch == ";":
                if code[start:at].strip():
                    yield start, at + 1, None
                start = at + 1
            elif ch == "}":
                start = at + 1
            elif ch == "\n" and re.fullmatch(r"\s*[A-Z][A-Z0-9_]*\s*\([^;{}]*\)\s*", code[start:at]) and code[at:].lstrip()[:1] != "{":
                yield start, at, None  # a macro call on a line of its own
                start = at + 1
            at += 1

    def add(self, name: str, kind: str, start: int, end: int, signature: str, head: str = "", **more) -> Symbol:
        first = start + len(self.code[start:end]) - len(self.code[start:end].lstrip())
        s = Symbol(name, kind, self.line(first), self.line(max(first, end - 1)), squash(signature), bool(re.search(r"\bstatic\b", head)), bool(re.search(r"\b(?:__)?(?:always_)?inline\b", head)), conditions=list(self.under(first)), **more)
        self.out.symbols.append(s)
        return s

    def scan(self) -> Parsed:
        for start, end, body in self.chunks():
            self.chunk(start, end, body)
        exported = set(_EXPORT.findall(self.code))
        for s in self.out.symbols:
            s.is_exported = s.kind in ("function", "syscall", "variable", "prototype") and s.name in exported
        self.out.contracts = contracts(self)
        order = {k: i for i, k in enumerate(("function", "syscall", "struct", "union", "enum", "typedef", "macro", "variable", "prototype"))}
        unique: dict[tuple, Symbol] = {}
        for s in sorted(self.out.symbols, key=lambda s: (s.start_line, s.end_line, order[s.kind], s.name, s.signature)):
            if self.kinds is None or s.kind in self.kinds:
                unique.setdefault((s.name, s.kind, s.start_line), s)
        self.out.symbols = list(unique.values())
        return self.out

    def chunk(self, start: int, end: int, body: int | None) -> None:
        text = self.code[start:end]
        head = self.code[start : body if body is not None else end]
        if found := _SYSCALL.search(head):
            name = ("compat_sys_" if found[1] else "sys_") + found[2]
            self.add(name, "syscall", start, end, head)
            if body is not None:
                self.calls(name, start, head, body, end)
            return
        if body is not None:
            names = [m for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", head) if m[1] not in KEYWORDS and not m[1].startswith("__attribute")]
            names = [m for m in names if re.search(r"[\w*]\s*$", head[: m.start()]) or len(names) == 1]
            if names:
                self.add(names[0][1], "function", start, end, head, head[: names[0].start()])
                self.calls(names[0][1], start, head, body, end)
            return
        self.aggregates(start, end)
        flat = self.outside_braces(text)
        if re.match(r"\s*typedef\b", text):
            name = re.search(r"\(\s*\*\s*(\w+)\s*\)", flat) or re.search(r"(\w+)\s*(?:\[[^\]]*\]\s*)*;?\s*$", flat)
            if name:
                self.add(name[1], "typedef", start, end, flat)
                direct = re.match(r"\s*typedef\s+(?:struct|union|enum)\s*(\w*)\s*(?:\{\s*\})?\s*(?:__\w+\s*)*(\w+)\s*;?\s*$", flat)
                if direct:
                    self.out.aliases.append((direct[1] or direct[2], self.line(start + len(text) - len(text.lstrip())), direct[2]))
            return
        self.declared(start, end, flat)

    @staticmethod
    def outside_braces(text: str) -> str:
        out, at = [], 0
        while (i := text.find("{", at)) >= 0:
            end = matching(text, i)
            if end < 0:
                break
            out.append(text[at : i + 1] + re.sub(r"[^\n]", "", text[i + 1 : end]) + "}")
            at = end + 1
        return "".join(out) + text[at:]

    def declared(self, start: int, end: int, flat: str) -> None:
        """Variables, prototypes and objects that macros declare."""
        call = re.match(r"\s*((?:static\s+|extern\s+)*)([A-Z][A-Z0-9_]*)\s*\((.*)\)\s*;?\s*$", flat, re.S)
        if call:
            arguments = split_arguments(call[3])
            family = next((prefix for f, prefix in ATTRIBUTES.items() if re.fullmatch(f, call[2])), None)
            if NAMED_FIRST.fullmatch(call[2]) and arguments:
                self.add(arguments[0], "variable", start, end, flat, call[1])
            elif NAMED_SECOND.fullmatch(call[2]) and len(arguments) > 1:
                self.add(arguments[1], "variable", start, end, flat, call[1])
            elif call[2] in FIXED_ATTRIBUTES:
                self.add(FIXED_ATTRIBUTES[call[2]], "variable", start, end, flat, "static")
            elif family and arguments:
                self.add(family + arguments[0], "variable", start, end, flat, "static")
            return
        plain = flat.rstrip().rstrip(";")
        left = plain.split("=", 1)[0]
        if re.fullmatch(r"\s*(?:struct|union|enum)\s+\w+\s*(?:\{\s*\})?\s*(?:__\w+(?:\([^()]*\))?\s*)*", left) or re.fullmatch(r"\s*(?:struct|union|enum)\s*\{\s*\}\s*", left):
            return
        if "=" not in plain and (proto := re.search(r"\b([A-Za-z_]\w*)\s*\((?!\s*\*)", plain)) and not re.search(r"\(\s*\*", plain[: proto.end()]):
            if re.search(r"[\w*]\s*$", plain[: proto.start()]) and proto[1] not in KEYWORDS:
                self.add(proto[1], "prototype", start, end, flat, plain[: proto.start()])
            return
        pointer = re.search(r"\(\s*\*\s*(?:const\s+)?(\w+)\s*(?:\[[^\]]*\])?\s*\)\s*\(", left)
        if pointer:
            self.add(pointer[1], "variable", start, end, flat, left)
            return
        parts = split_arguments(plain)
        first = parts[0].split("=", 1)[0] if parts else ""
        if not re.match(r"\s*[A-Za-z_]", first) or not re.search(r"[\w}*]\s*[\s*]\w+\s*(?:\[[^\]]*\]\s*)*(?:__\w+(?:\([^()]*\))?\s*)*$", first):
            return
        for part in parts:
            name = re.search(r"(\w+)\s*(?:\[[^\]]*\]\s*)*(?:__\w+(?:\([^()]*\))?\s*)*$", part.split("=", 1)[0].split(":")[0])
            if name and not re.match(r"extern\b", first.strip()):
                self.add(name[1], "variable", start, end, flat, first)

    def calls(self, name: str, start: int, head: str, body: int, end: int) -> None:
        """Call sites: member and local objects are called indirectly, macros of this file defined above by macro."""
        code, line = self.code, self.line(start + len(head) - len(head.lstrip()))
        bound = self.bindings(head, body, end)
        for m in _CALL.finditer(code, body, end):
            callee = m[2]
            if not m[1] and _POINTER.match(code, m.end() - 1):
                continue  # a declared pointer to functions that return this type
            before = code[max(0, m.start() - 80) : m.start(2)].rstrip()
            if callee in KEYWORDS or (not m[1] and re.search(r"(?:^|[;{}])\s*(?:static\s+|const\s+|extern\s+)*(?:struct\s+|union\s+|enum\s+|unsigned\s+)?[A-Za-z_]\w*\s*\**$", before) and not re.search(r"\b(?:return|else|do|goto|case)\s*$", before) and not before.endswith((";", "{", "}"))):
                continue
            member = bool(m[1]) or before.endswith(("->", ".")) and not before.endswith("...")
            kind = "indirect" if member or any(a <= m.start(2) < b for a, b in bound.get(callee, ())) else "macro" if self.live(callee, m.start()) else "direct"
            self.out.sites.append(Site(name, line, callee, kind, self.line(m.start(2)), self.byte(m.start(2))))

    def bindings(self, head: str, body: int, end: int) -> dict[str, list[tuple[int, int]]]:
        """Where names mean local objects: parameters in the whole body, locals from their declaration to their block's end."""
        out: dict[str, list[tuple[int, int]]] = {}
        for m in _POINTER.finditer(head):
            if not re.match(r"\s*\(", head):
                out.setdefault(m[1], []).append((body, end))
        for m in re.finditer(r"\b(?:struct\s+\w+|[A-Za-z_]\w*)\s*\*?\s*\b(\w+)\s*(?=[=;,)])", head[head.find("(") :]):
            out.setdefault(m[1], []).append((body, end))
        found = [(m.end(1), m[1]) for m in _POINTER.finditer(self.code, body, end)]
        for m in _LOCAL.finditer(self.code, body, end):
            if m[1] not in KEYWORDS and m[1] not in _NO_TYPE:
                found.append((m.end(2), m[2]))
        if not found:
            return out
        blocks, open_ = [], []
        for m in re.finditer(r"[{}]", self.code[body:end]):
            if m[0] == "{":
                open_.append(body + m.start())
            elif open_:
                blocks.append((open_.pop(), body + m.start()))
        for at, name in found:
            stop = min((b for a, b in blocks if a < at <= b), default=end)
            out.setdefault(name, []).append((at, stop))
        return out

    def live(self, name: str, at: int) -> bool:
        """Whether a macro of this file is defined at a place in some configuration that compiles the place.

        Exact: a conditional is one stretch of the file, so what holds after it is what holds after
        any one of its branches; of conditionals around the place only its own branch counts.
        """
        if name not in self.macros:
            return False
        here = dict(self.branches[bisect_right(self.branches, at, key=lambda b: b[0]) - 1][1])

        def after(events: list, depth: int, states: set[bool]) -> set[bool]:
            i = 0
            while i < len(events):
                _, defined, path = events[i]
                if len(path) == depth:
                    states, i = {defined}, i + 1
                    continue
                group, by_branch = path[depth][0], {}
                while i < len(events) and len(events[i][2]) > depth and events[i][2][depth][0] == group:
                    by_branch.setdefault(events[i][2][depth][1], []).append(events[i])
                    i += 1
                if group in here:
                    states = after(by_branch.get(here[group], []), depth + 1, states)
                else:
                    past = states if len(by_branch) < self.choices.get(group, len(by_branch) + 1) else set()
                    states = past.union(*(after(e, depth + 1, states) for e in by_branch.values()))
            return states

        return True in after([e for e in self.macros[name] if e[0] < at], 0, {False})

    def aggregates(self, start: int, end: int) -> None:
        at = start
        while (m := _AGGREGATE.search(self.code, at, end)) is not None:
            close = matching(self.code, m.end() - 1)
            if close < 0:
                return
            after = re.match(r"\s*(?:__\w+(?:\([^()]*\))?\s*)*(\w+)", self.code[close + 1 : end])
            name = m[2] or (after[1] if after else None)
            doc = kernel_doc(self.comment_before(start + len(self.code[start:end]) - len(self.code[start:end].lstrip())) or "")
            s = self.add(name or f"<anonymous {m[1]}>", m[1], m.start(), close + 1, f"{m[1]} {m[2] or ''}", is_anonymous=not m[2])
            if doc:
                s.summary, s.description = doc["summary"], doc["description"] or None
            if m[1] != "enum":
                before = len(self.out.members)
                self.members(s, m.end(), close, None, 0, doc["parameters"] if doc else {}, ["unspecified"])
                named = {x.name for x in self.out.members[before:]}
                s.unmatched_docs = [{"name": k, "text": v} for k, v in (doc["parameters"] if doc else {}).items() if k.rpartition(".")[2] not in named]
            at = close + 1

    def members(self, s: Symbol, start: int, end: int, parent: int | None, depth: int, told: dict[str, str], seen: list[str], group: bool = False) -> None:
        code, at, first = self.code, start, start
        while at < end:
            if code[at] in "([{":
                close = matching(code, at)
                at = close if 0 <= close < end else at
            elif code[at] == ";" or (group and at == end - 1):
                stop = at if code[at] == ";" else end
                if code[first:stop].strip():
                    self.member(s, first, stop, parent, depth, told, seen)
                first = at + 1
            at += 1
        if code[first:end].strip() and re.match(r"\s*\w+\s*\(", code[first:end]):
            self.member(s, first, end, parent, depth, told, seen)

    def member(self, s: Symbol, start: int, end: int, parent: int | None, depth: int, told: dict[str, str], seen: list[str]) -> None:
        text = self.code[start:end]
        place = start + len(text) - len(text.lstrip())
        for c_start, c_end, c in self.comments[bisect_left(self.comment_starts, start - 1) : bisect_right(self.comment_starts, place)]:
            if c_end <= place and (v := re.search(r"\b(private|public):", c)):
                seen[0] = v[1]
        after = bisect_left(self.comment_starts, end)
        trailing = None
        if after < len(self.comments) and self.line(self.comment_starts[after]) == self.line(end) and not self.code[end + 1 : self.comment_starts[after]].strip():
            trailing = self.comments[after][2]

        def put(name, kind, type_text, declaration, **more) -> int:
            count = self.sizes.get(id(s), 0)
            notes = {"kernel-doc": told.get(name or ""), "inline-kernel-doc": inline_doc(self.comment_before(place) or "", name), "source-comment": squash(re.sub(r"^/\*+<?|\*/$|^//+", "", trailing)) if trailing else None}
            source, note = next(((k, v) for k, v in notes.items() if v), (None, None))
            self.out.members.append(Member(s.name, s.start_line, count, parent, depth, name, kind, type_text, squash(declaration), self.line(place), self.line(max(place, end - 1)), description=note, description_source=source, visibility=seen[0], conditions=list(self.under(place)), **more))
            self.sizes[id(s)] = count + 1
            return count

        if group := re.match(r"\s*(struct_group(?:_attr|_tagged)?|__struct_group)\s*\(", text):
            close = matching(text, group.end() - 1)
            arguments = split_arguments(text[group.end() : close])
            skip = {"struct_group": 1, "struct_group_attr": 2, "struct_group_tagged": 2, "__struct_group": 3}[group[1]]
            name = arguments[1] if group[1] in ("struct_group_tagged", "__struct_group") and len(arguments) > 1 else arguments[0]
            tag = arguments[0] if group[1] in ("struct_group_tagged", "__struct_group") else ""
            if tag:
                self.add(tag, "struct", place, start + close + 1, f"struct {tag}")
            me = put(name, "struct_group", None, text[: group.end()] + name + ")")
            offset = group.end()
            for a in arguments[:skip]:
                offset = text.index(a, offset) + len(a) if a else offset
                offset = text.index(",", offset) + 1 if "," in text[offset:] else offset
            self.members(s, start + offset, start + close, me, depth + 1, told, seen)
            return
        if nested := _AGGREGATE.match(text.lstrip()) or re.match(r"(?:const\s+|volatile\s+)?(struct|union|enum)\s*(\w+)?\s*\{", text.lstrip()):
            open_ = text.index("{")
            close = matching(text, open_)
            rest = text[close + 1 :]
            name = re.search(r"(\w+)\s*((?:\[[^\]]*\]\s*)*)(?:__\w+(?:\([^()]*\))?\s*)*$", rest)
            own = name[1] if name and not name[1].startswith("__") else None
            me = put(own, nested[1] if nested[1] != "enum" else "field", f"{nested[1]} {nested[2] or ''}".strip(), f"{nested[1]} {nested[2] or ''} {{…}} {own or ''}", array_dimensions=re.findall(r"\[([^\]]*)\]", name[2]) if name else [])
            if nested[1] != "enum":
                self.members(s, start + open_ + 1, start + close, me, depth + 1, told, seen)
            return
        if pointer := re.search(r"\(\s*\*\s*(?:const\s+)?(\w+)\s*((?:\[[^\]]*\]\s*)*)\)\s*\(", text):
            put(pointer[1], "function_pointer", squash(text[: pointer.start()]), text, array_dimensions=re.findall(r"\[([^\]]*)\]", pointer[2]))
            return
        if macro := re.fullmatch(r"\s*([A-Z_][A-Za-z0-9_]*)\s*\((.*)\)\s*", text, re.S):
            arguments = split_arguments(macro[2])
            named = arguments[1] if NAMED_SECOND.fullmatch(macro[1]) and len(arguments) > 1 else arguments[0] if arguments else None
            put(named if named and re.fullmatch(r"\w+", named) else None, "macro", macro[1], text)
            return
        parts = split_arguments(text)
        for i, part in enumerate(parts):
            part = re.sub(r"\s__\w+(?:\([^()]*\))?\s*$", "", part)
            bits = re.search(r":\s*([^:]+)$", part)
            bare = part[: bits.start()] if bits else part
            dims = re.findall(r"\[([^\]]*)\]", bare)
            found = re.search(r"(\w+)\s*(?:\[[^\]]*\]\s*)*$", bare)
            words = re.findall(r"\w+", re.sub(r"\[[^\]]*\]", "", bare))
            name = found[1] if found and (i or len(words) > 1) and not (bits and i == 0 and len(words) == 1) else None
            kind = "unnamed_bitfield" if bits and name is None else "field"
            type_text = squash(bare[: found.start(1)]) if name and not i else squash(re.sub(r"[\s*]*\w+\s*(?:\[[^\]]*\]\s*)*$", "", parts[0].split(":")[0])) if i else squash(bare)
            put(name, kind, type_text, text if len(parts) == 1 else part if not i else f"{type_text} {part.strip()}", bit_width=bits[1].strip() if bits else None, array_dimensions=dims)


def kernel_doc(comment: str) -> dict | None:
    """Summary, parameters (ordered), description, context and returns of a ``/** … */`` comment."""
    if not comment.startswith("/**") or comment.startswith("/***") or comment == "/**/":
        return None
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in comment[3:-2].split("\n")]
    while lines and not lines[0].strip():
        lines.pop(0)
    if not lines or not (title := re.match(r"\s*(?:(?:struct|union|enum|typedef)\s+)?(\w+)\s*(?:\(\s*\))?\s*(?:[-:]\s*(.*))?$", lines[0])):
        return None
    out = {"name": title[1], "summary": squash(title[2] or ""), "parameters": {}, "description": [], "context": [], "returns": []}
    into, key = "summary", None
    for text in lines[1:]:
        param = re.match(r"\s*@([\w.…]+|\.\.\.)\s*:\s*(.*)$", text)
        section = re.match(r"\s*(Context|Returns?|Description)\s*:\s*(.*)$", text)
        if param:
            into, key = "parameters", param[1]
            out["parameters"][key] = param[2]
        elif section:
            into = {"C": "context", "R": "returns", "D": "description"}[section[1][0]]
            out[into].append(section[2])
        elif not text.strip() and into in ("summary", "parameters"):
            into = "description"
        elif into == "summary":
            out["summary"] = squash(out["summary"] + " " + text)
        elif into == "parameters":
            out["parameters"][key] = squash(out["parameters"][key] + " " + text)
        else:
            out[into].append(text.strip())
    for k in ("description", "context", "returns"):
        out[k] = squash(" ".join(out[k]))
    return out


def inline_doc(comment: str, name: str | None) -> str | None:
    if not name or not comment.startswith("/**"):
        return None
    found = re.search(rf"@{re.escape(name)}\s*:\s*(.*?)\*/$", comment, re.S)
    return squash(re.sub(r"\n\s*\*", "\n", found[1])) if found else None


def contracts(scan: Scanner) -> list[Contract]:
    """Comments that document the function or prototype right below them, under its own name."""
    out = []
    heads = {(s.start_line, s.name) for s in scan.out.symbols if s.kind in ("function", "prototype", "syscall")}
    lines: dict[int, set[str]] = {}
    for at, name in heads:
        lines.setdefault(at, set()).add(name)
    for start, end, text in scan.comments:
        doc = kernel_doc(text)
        if doc is None:
            continue
        rest = scan.code[end:]
        below = scan.line(end + len(rest) - len(rest.lstrip()))
        if lines.get(below, set()) & {doc["name"], "sys_" + doc["name"].removeprefix("sys_")}:
            out.append(Contract(doc["name"], scan.line(start), doc["summary"], list(doc["parameters"].items()), doc["description"], doc["context"], doc["returns"]))
    return out


def parse(source: str, kinds: frozenset[str] | None = None) -> Parsed:
    return Scanner(source.replace("\r\n", "\n"), kinds).scan()


def as_rows(parsed: Parsed) -> dict[str, list[dict]]:
    return {"symbols": [asdict(s) for s in parsed.symbols], "members": [asdict(m) for m in parsed.members], "sites": [asdict(s) for s in parsed.sites]}


_REFERENCE = re.compile(r"\b(struct|union|enum)\s+(\w+)\s*(\**)")


def references(declaration: str, name: str | None = None, function: bool = False) -> list[tuple[str, str, str]]:
    """(kind, type name, role) of the tagged types in a declaration; fragments with ``…`` are left out."""
    if "…" in declaration:
        return []
    text = re.sub(r"\[[^\]]*\]", "", declaration)
    pointer = re.search(r"\(\s*\*\s*(?:const\s+)?\w*\s*\)\s*\(", text)
    arguments = text.find("(") if function else pointer.end() - 1 if pointer else -1
    out = []
    for m in _REFERENCE.finditer(text):
        inside = 0 <= arguments < m.start()
        if pointer:
            role = "callback_parameter" if inside else "callback_return"
        elif function:
            role = "function_parameter" if inside else "function_return"
        else:
            role = "pointer_member" if m[3] else "embedded_member"
        out.append((m[1], m[2], role))
    return list(dict.fromkeys(out))
