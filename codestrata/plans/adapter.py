"""Evidence tables from the driver's star schema. Only the evidence is synthetic; the operators are the real ones.

Every table is one SQL text both engines read: ``{name}`` stands for a driver table or another
table of this module.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CATCH_ALL = "Supplier#000000000"

SQL = {
    "k_files": """SELECT p_partkey AS id, concat(top, '/', lower(replace(p_brand, '#', '_')), '/', replace(p_name, ' ', '_'), '_', p_partkey, ext) AS path,
        concat(replace(p_name, ' ', '_'), '_', p_partkey, ext) AS name, ext, CAST(p_size AS BIGINT) AS size, CAST(p_size * 10 AS BIGINT) AS lines, 'kernel' AS call_domain
      FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'kernel' WHEN 'STANDARD' THEN 'arch/x86' WHEN 'PROMO' THEN 'arch/arm' WHEN 'SMALL' THEN 'tools' WHEN 'MEDIUM' THEN 'drivers' ELSE 'fs' END AS top,
        CASE WHEN p_partkey % 4 = 0 THEN '.h' ELSE '.c' END AS ext FROM {part}) t""",
    "k_symbols": """SELECT p_partkey AS id, CAST(p_partkey - p_partkey % 3 AS BIGINT) AS file_id, concat(replace(p_name, ' ', '_'), '_', p_partkey % 97) AS name,
        CASE p_size % 8 WHEN 0 THEN 'macro' WHEN 1 THEN 'variable' WHEN 2 THEN 'struct' ELSE 'function' END AS kind,
        CAST(p_partkey % 3 * 20 + 1 AS INT) AS start_line, CAST(p_partkey % 3 * 20 + 1 + p_size % 15 AS INT) AS end_line, p_size % 2 = 1 AS is_static, p_size % 7 = 0 AS is_exported
      FROM {part}""",
    "k_sites": """SELECT x.caller_id, s.name AS callee, x.target_id, x.kind, x.line, x.byte_offset
      FROM (SELECT l_partkey AS caller_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag) AS target_id,
          CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'indirect' ELSE 'macro' END AS kind, CAST(l_linenumber AS INT) AS line, l_orderkey AS byte_offset FROM {lineitem}) x
      JOIN {k_symbols} s ON s.id = x.target_id""",
    "k_edges": """SELECT caller_id, callee, min(target_id) AS tid, CAST(sum(CASE WHEN kind = 'direct' THEN 1 ELSE 0 END) AS BIGINT) AS direct_count, CAST(sum(CASE WHEN kind = 'indirect' THEN 1 ELSE 0 END) AS BIGINT) AS indirect_count,
        CAST(sum(CASE WHEN kind = 'macro' THEN 1 ELSE 0 END) AS BIGINT) AS macro_count
      FROM {k_sites} GROUP BY caller_id, callee""",
    "k_calls": """SELECT caller_id, callee, CASE WHEN (caller_id + tid) % 5 <> 0 THEN tid END AS callee_id,
        CASE WHEN (caller_id + tid) % 15 = 0 THEN 'ambiguous' WHEN (caller_id + tid) % 15 = 5 THEN 'unresolved' WHEN (caller_id + tid) % 15 = 10 THEN 'macro'
          WHEN caller_id - caller_id % 3 = tid - tid % 3 THEN 'same_file' ELSE 'unique_global' END AS resolution, direct_count, indirect_count, macro_count
      FROM {k_edges}""",
    "k_sections": "SELECT s_suppkey AS id, s_name AS name FROM {supplier}",
    "k_raw_claims": "SELECT l_partkey AS ref_id, l_suppkey AS subsystem_id, CAST(sum(l_quantity) AS BIGINT) AS score FROM {lineitem} GROUP BY l_partkey, l_suppkey",
    "k_includes": "SELECT p_partkey AS includer_id, CAST(p_partkey + 1 AS BIGINT) AS included_id FROM {part} WHERE p_partkey % 5 IN (1, 2) AND p_partkey + 1 < (SELECT count(*) FROM {part})",
    "k_members": """SELECT o_orderkey AS id, o_custkey AS symbol_id, CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey - 1 END AS BIGINT) AS parent_id,
        CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ordinal, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS name, 'field' AS kind,
        CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS description, CASE WHEN o_orderstatus = 'P' THEN 'macro-semantics' ELSE 'kernel-doc' END AS description_source
      FROM {orders}""",
    "k_aliases": "SELECT id AS symbol_id, concat('t_', CAST(id % 40 AS STRING)) AS name FROM {k_symbols} WHERE kind = 'struct'",
    "k_references": """SELECT s.file_id, CAST(s.start_line + s.id % 3 AS INT) AS line, s.id AS owner_id, CASE WHEN t.id % 4 = 3 THEN 'typedef' ELSE 'struct' END AS kind, CASE WHEN t.id % 4 = 3 THEN concat('t_', CAST(t.id % 40 AS STRING)) ELSE t.name END AS name,
        CASE WHEN t.id % 2 = 0 THEN 'function_parameter' ELSE 'function_return' END AS role
      FROM {k_symbols} s JOIN {k_symbols} t ON t.kind = 'struct' AND (t.id % 500 = s.id % 500 OR t.file_id = s.file_id) WHERE s.kind = 'function'""",
    "k_domains": """SELECT id AS file_id, path, ext, CASE WHEN path LIKE 'tools/brand_1%' THEN concat('program:tools/brand_1', substring(path, 14, 1), ':p') WHEN path LIKE 'tools/%' THEN concat('isolated:', path) WHEN path LIKE 'arch/x86/brand_2%' THEN 'image:arch:x86:boot'
        WHEN path LIKE 'arch/x86/%' THEN 'arch:x86' WHEN path LIKE 'arch/arm/%' THEN 'arch:arm' WHEN path LIKE 'fs/brand_5%' THEN 'image:efi-stub' ELSE 'kernel' END AS domain FROM {k_files}""",
    "k_documents": """SELECT doc_id AS file_id, concat('Documentation/', source, '/', lang, '/', doc_id, '.txt') AS path, concat(doc_id, '.txt') AS name, n_chars AS size, text AS content FROM {documents}""",
    "k_contracts": """SELECT conv_id AS symbol_id, CAST(1 AS INT) AS line, max(CASE WHEN turn = 0 THEN text END) AS summary, '' AS description, '' AS context, max(CASE WHEN turn = 1 THEN text END) AS returns
      FROM {conversations} GROUP BY conv_id""",
    "k_traces": """SELECT event_id, concat('Call Trace:', chr(10), ' <TASK>', chr(10), CASE WHEN event_id % 3 = 0 THEN concat(event_type, '.isra.0+0x10/0x40 [mod]') WHEN event_id % 3 = 1 THEN concat('#1  0xff in ', event_type, ' (x=1)') ELSE concat(event_type, '.part.2') END,
        chr(10), event_type, chr(10)) AS text FROM {events}""",
}


#: Where Spark would compare all pairs: the same rows by equality joins. DuckDB reads the text above.
_EITHER = "(t.id % 500 = s.id % 500 OR t.file_id = s.file_id)"
SPARK_SQL = SQL | {"k_references": " UNION ALL ".join(SQL["k_references"].replace(_EITHER, c) for c in ("t.id % 500 = s.id % 500", "t.file_id = s.file_id AND t.id % 500 <> s.id % 500"))}


def spark_table(spark: SparkSession, sf_dir: str, name: str, table: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A driver table, or a table of this module as one lazy plan. table: gives the tables of this module that it is made from."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", SQL[name]))
    return spark.sql(SPARK_SQL[name], **{u: table(u) if table and u in SQL else spark_table(spark, sf_dir, u) for u in used})


def with_tables(*names: str) -> str:
    """``WITH`` and the common table expressions of the given tables and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for u in re.findall(r"\{(\w+)\}", SQL[name]):
            if u in SQL:
                need(u)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', SQL[n])})" for n in order)
