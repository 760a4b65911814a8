"""Evidence tables: fixed schemas and closed domains."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION, READABLE_VERSIONS = 7, (6, 7)

#: The closed domains of the evidence tables.
SYMBOL_KINDS = ("function", "syscall", "struct", "union", "enum", "typedef", "macro", "variable", "prototype")
DEFAULT_KINDS = SYMBOL_KINDS[:-1]
LEVELS = ("auto", "file", "dir", "subtree", "subsystem", "tree")
INDEX_STATUS = ("parsed", "indexed", "binary", "symlink", "skipped_binary", "skipped_oversize", "read_error", "parse_error")
RESOLUTIONS = ("same_file", "included_source", "unique_global", "ambiguous", "macro", "indirect", "unresolved")
SITE_KINDS = ("direct", "indirect", "macro")
MEMBER_KINDS = ("field", "function_pointer", "struct", "union", "struct_group", "unnamed_bitfield", "macro")
DOC_SOURCES = ("kernel-doc", "inline-kernel-doc", "source-comment", "macro-semantics")
VISIBILITY = ("unspecified", "public", "private")
REFERENCE_ROLES = ("embedded_member", "pointer_member", "function_parameter", "function_return", "callback_parameter", "callback_return")

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType(), "strs": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType())}


def _table(spec: str) -> T.StructType:
    """``name:type``; a trailing ``?`` means nullable."""
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


_ORDERED_TEXTS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())]))
TABLES = {
    "dirs": _table("id:long path:str parent_id:long? name:str depth:int n_files:long n_subdirs:long n_files_recursive:long"),
    "files": _table("id:long path:str dir_id:long name:str ext:str size:long lines:long n_symbols:long is_symlink:bool link_target:str? index_status:str index_error:str? call_domain:str"),
    "symbols": _table("id:long file_id:long name:str kind:str start_line:int end_line:int signature:str? summary:str? description:str? is_static:bool is_inline:bool is_exported:bool is_anonymous:bool parse_complete:bool parse_warnings:strs unmatched_member_docs:map conditions:strs"),
    "type_aliases": _table("symbol_id:long name:str"),
    "type_members": _table("id:long symbol_id:long parent_id:long? ordinal:int name:str? kind:str type_text:str? declaration:str start_line:int end_line:int bit_width:str? array_dimensions:strs description:str? description_source:str? conditions:strs visibility:str is_anonymous:bool generated_by:str?"),
    "subsystems": _table("id:long name:str status:str? maintainers:strs reviewers:strs lists:strs trees:strs websites:strs patchwork:strs bugs:strs chats:strs profiles:strs keywords:strs n_files:long n_primary_files:long"),
    "path_subsys": _table("ref_kind:str ref_id:long subsystem_id:long score:long rank:int is_primary:bool"),
    "dir_subsys": _table("dir_id:long subsystem_id:long n_claimed:long n_primary:long coverage:double rank:int"),
    "source_includes": _table("includer_id:long included_id:long line:int"),
    "translation_unit_roots": _table("file_id:long"),
    "calls": _table("caller_id:long callee:str callee_id:long? resolution:str direct_count:long indirect_count:long macro_count:long"),
    "call_sites": _table("caller_id:long callee:str kind:str line:int byte_offset:long"),
    "document_text": _table("file_id:long content:str"),
    "function_docs": _table("symbol_id:long line:int summary:str?").add("parameters", _ORDERED_TEXTS).add("description", T.StringType()).add("context", T.StringType()).add("returns", T.StringType()),
}
OPTIONAL = {"call_sites": "has_call_sites", "document_text": "has_document_text", "function_docs": "has_function_docs"}
ENTRY = _table("kind:str name:str path:str line:int? end_line:int? span:int? signature:str? is_static:bool? is_inline:bool? is_exported:bool? size:long? lines:long? n_files:long? subsystem:str? ref_id:long?")
