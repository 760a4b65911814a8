"""Conservative call identities: domains, visibility and a decision per translation unit, then agreement.

Built as column expressions over joins keyed by (domain, name); only names that occur at call
sites are carried. The order of the ``when`` branches is the semantics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.storage import materialize
from codestrata.operators.graph import closure
from codestrata.operators.paths import ancestors

HEADERS = (".h", ".h_shipped")
CALLABLE = ("function", "syscall")
IDENTIFIED = ("same_file", "included_source", "unique_global")


def arch_of(path: Column) -> Column:
    """The architecture of ``arch/<a>/...``, else null."""
    return F.nullif(F.regexp_extract(path, r"^arch/([^/]*)/", 1), F.lit(""))


def file_domains(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, domain, ext, path). An explicit domain wins; helper trees and programs stand alone."""
    mains = symbols.filter("kind = 'function' and name = 'main'").select(F.col("file_id").alias("m")).distinct()
    rows = files.select(F.col("id").alias("file_id"), "path", "ext", "call_domain").join(mains, F.col("file_id") == F.col("m"), "left")
    folded = F.lower("path")
    alone = folded.rlike(r"^(tools|scripts|documentation)/|/(tools|documentation)/|^arch/um/os-linux/") | F.col("m").isNotNull()
    domain = F.when(F.col("call_domain") != "kernel", F.col("call_domain")).when(alone, F.concat(F.lit("isolated:"), F.col("path"))).when(arch_of(F.col("path")).isNotNull(), F.concat(F.lit("arch:"), arch_of(F.col("path")))).otherwise("kernel")
    return rows.select("file_id", domain.alias("domain"), "ext", "path")


def units(files: DataFrame, includes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(unit_id, member_id): each top-level source with all it includes. Included-only members start no unit."""
    top = files.select("id").join(includes.select(F.col("included_id").alias("id")), "id", "left_anti")
    if roots is not None:
        top = top.union(roots.select(F.col("file_id").alias("id"))).distinct()
    start = top.select(F.col("id").alias("start"), F.col("id").alias("node"))
    reached = closure(start, includes.select(F.col("includer_id").alias("src"), F.col("included_id").alias("dst")))
    return reached.select(F.col("start").alias("unit_id"), F.col("node").alias("member_id"))


def program_headers(domains: DataFrame) -> DataFrame:
    """(domain, file_id): the headers below a program's directory, seen by all of the program's sources."""
    tail = F.substring("domain", len("program:") + 1, 10000)
    program = domains.filter(F.col("domain").startswith("program:")).select("domain", tail.alias("tail")).filter("instr(tail, ':') > 0").select("domain", F.substring_index("tail", ":", 1).alias("root")).distinct()
    headers = domains.filter(F.col("ext").isin(*HEADERS))
    return headers.select("file_id", F.explode(ancestors(F.col("path"))).alias("dir")).join(program, F.col("dir") == F.col("root")).select("domain", "file_id").distinct()


def eligible_domains(domains: DataFrame) -> DataFrame:
    """(domain, candidate, shared_only): where a domain's calls may find definitions. Architecture code sees the
    kernel too; a separately linked image sees the kernel's and its architecture's headers only (shared_only)."""
    here = domains.select("domain", "path").distinct()
    is_arch, is_image, no, kernel = F.col("domain").startswith("arch:"), F.col("domain").startswith("image:"), F.lit(False), F.lit("kernel")
    pairs = here.select("domain", F.col("domain").alias("candidate"), no.alias("shared_only")).union(here.filter(is_arch).select("domain", kernel, no))
    pairs = pairs.union(here.filter(is_image).select("domain", kernel, F.lit(True))).union(here.filter(is_image & arch_of(F.col("path")).isNotNull()).select("domain", F.concat(F.lit("arch:"), arch_of(F.col("path"))), F.lit(True)))
    return pairs.groupBy("domain", "candidate").agg(F.min("shared_only").alias("shared_only"))


def resolve(files: DataFrame, symbols: DataFrame, includes: DataFrame, calls: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(caller_file_id, name, resolution, callee_id) for every name called directly and not yet resolved."""
    domains = materialize(file_domains(files, symbols), "domains")
    members = materialize(units(files, includes, roots), "units")
    sites = calls.filter("direct_count > 0 and resolution = 'unresolved'").join(symbols.select(F.col("id").alias("caller_id"), F.col("file_id").alias("caller_file_id")), "caller_id").select("caller_file_id", F.col("callee").alias("name")).distinct()
    contexts = sites.join(members, F.col("caller_file_id") == F.col("member_id")).join(domains.select(F.col("file_id").alias("unit_id"), "domain"), "unit_id").select("caller_file_id", "name", "unit_id", "domain")
    contexts = materialize(contexts, "contexts")
    known = symbols.join(contexts.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("symbol_id"), "file_id", "name", "kind", "is_static")

    # Within the unit. Names meet first: (unit, name) pairs of defined symbols, not all members of each context's unit.
    defined = known.join(members, F.col("file_id") == F.col("member_id")).select("unit_id", "name", "symbol_id", "file_id", "kind")
    inside = contexts.join(defined, ["unit_id", "name"]).select("caller_file_id", "name", "unit_id", "symbol_id", "file_id", "kind")
    elsewhere = F.col("file_id") != F.col("caller_file_id")
    callable_ = F.col("kind").isin(*CALLABLE)
    key = ["caller_file_id", "name", "unit_id"]
    local = inside.groupBy(*key).agg(
        F.count_if(callable_).alias("local_n"),
        F.min(F.when(callable_, F.col("symbol_id"))).alias("local_id"),
        F.min(F.when(callable_, F.col("file_id"))).alias("local_file"),
        F.count_if((F.col("kind") == "macro") & elsewhere).alias("bound_macro"),
        F.count_if(F.col("kind") == "variable").alias("bound_variable"),
    )

    # By domain: what can be linked, and what can shadow it. A row per (domain, name, symbol) with
    # what the symbol is there, counted once however many ways it is seen.
    effective = members.join(domains.select(F.col("file_id").alias("unit_id"), "domain"), "unit_id").select(F.col("member_id").alias("file_id"), "domain").distinct()
    visible = program_headers(domains)
    placed = known.join(domains.select("file_id", F.col("domain").alias("own"), "ext"), "file_id").withColumn("header", F.col("ext").isin(*HEADERS))
    placed = materialize(placed, "placed")
    static, variable = F.col("is_static"), F.col("kind") == "variable"
    no = F.lit(False)

    def seen(df: DataFrame, domain: str, linkable: Column, in_header: Column, macro: Column, named: Column, shared: Column) -> DataFrame:
        return df.select(F.col(domain).alias("domain"), "name", "symbol_id", linkable.alias("g"), in_header.alias("h"), macro.alias("m"), named.alias("v"), shared.alias("s")).filter("g or h or m or v or s")

    parts = seen(placed, "own", no, F.col("header") & callable_ & static, F.col("header") & (F.col("kind") == "macro"), no, no)
    parts = parts.union(seen(placed.join(effective, "file_id"), "domain", callable_ & ~static, no, no, variable & (~static | F.col("header")), variable & F.col("header")))
    parts = parts.union(seen(placed.filter("header").join(visible, "file_id"), "domain", no, callable_ & static, F.col("kind") == "macro", variable, variable))
    once = parts.groupBy("domain", "name", "symbol_id").agg(*[F.bool_or(c).alias(c) for c in "ghmvs"])
    there = once.groupBy("domain", "name").agg(F.min(F.when(F.col("g"), F.col("symbol_id"))).alias("gid"), *[F.count_if(c).alias(f"{c}_n") for c in "ghmvs"])
    there = materialize(there.withColumnRenamed("domain", "candidate"), "there")

    is_arch = F.col("domain").startswith("arch:")
    pairs = eligible_domains(domains)

    links = ~F.col("shared_only")  # what shadows an image only can't be linked into it
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = contexts.select("domain", "name").distinct().join(pairs, "domain").join(there, ["candidate", "name"], "left")
    facts = facts.groupBy("domain", "name").agg(
        F.min(F.when(links, F.col("gid"))).alias("global_id"),
        total(F.when(links, F.col("g_n"))).alias("global_n"),
        total("h_n").alias("header_n"),
        total("m_n").alias("macro_n"),
        total(F.when(links, F.col("v_n")).otherwise(F.col("s_n"))).alias("variable_n"),
    )
    arch_symbols = placed.join(effective.filter(is_arch).select("file_id").distinct(), "file_id", "left_semi")
    blocks = (callable_ & (~static | F.col("header"))) | ((F.col("kind") == "macro") & F.col("header")) | (variable & (~static | F.col("header")))
    arch = arch_symbols.filter(blocks).groupBy("name").agg(F.countDistinct("symbol_id").alias("arch_n")).withColumn("domain", F.lit("kernel"))
    facts = materialize(facts.join(arch, ["domain", "name"], "left").withColumn("arch_n", F.coalesce("arch_n", F.lit(0))), "facts")

    rows = contexts.join(local, key, "left").join(facts, ["domain", "name"]).join(domains.select(F.col("file_id").alias("caller_file_id"), F.col("ext").alias("caller_ext")), "caller_file_id")
    zero = F.lit(0)
    local_n, bm, bv = F.coalesce("local_n", zero), F.coalesce("bound_macro", zero), F.coalesce("bound_variable", zero)
    only_local = (local_n == 1) & (bm + bv == 0)
    quiet = (F.col("header_n") == 0) & (F.col("variable_n") == 0) & (F.col("arch_n") == 0)
    unique = quiet & (F.col("global_n") == 1) & (F.col("macro_n") == 0)
    anything = (F.col("global_n") + F.col("header_n") + F.col("macro_n") + F.col("variable_n") + F.col("arch_n")) > 0
    from_header = F.col("caller_ext").isin(*HEADERS)
    resolution = (
        F.when(only_local & (F.col("local_file") == F.col("caller_file_id")), "same_file")
        .when(only_local, "included_source")
        .when(local_n > 0, "ambiguous")
        .when((bv > 0) & (bm == 0), "indirect")
        .when((bm > 0) & (bv == 0), "macro")
        .when(bm + bv > 0, "ambiguous")
        .when(from_header, F.when(anything, "ambiguous").otherwise("unresolved"))
        .when(unique, "unique_global")
        .when(quiet & (F.col("global_n") == 0) & (F.col("macro_n") > 0), "macro")
        .when(anything, "ambiguous")
        .otherwise("unresolved")
    )
    rows = rows.withColumn("resolution", resolution)
    rows = rows.withColumn("callee_id", F.when(F.col("resolution").isin("same_file", "included_source"), F.col("local_id")).when(F.col("resolution") == "unique_global", F.col("global_id")))

    # An identity needs all units to agree.
    agreed = rows.groupBy("caller_file_id", "name").agg(F.countDistinct("resolution").alias("kinds"), F.min("resolution").alias("one"), F.countDistinct("callee_id").alias("ids"), F.min("callee_id").alias("id"))
    identified = F.col("one").isin(*IDENTIFIED)
    ok = (F.col("kinds") == 1) & (~identified | (F.col("ids") == 1))
    return agreed.select("caller_file_id", "name", F.when(ok, F.col("one")).otherwise("ambiguous").alias("resolution"), F.when(ok & identified, F.col("id")).alias("callee_id"))


def apply_outcomes(calls: DataFrame, symbols: DataFrame, outcomes: DataFrame) -> DataFrame:
    """calls with the outcomes filled in where there is direct evidence and no resolution yet."""
    o = outcomes.select("caller_file_id", F.col("name").alias("callee"), F.col("resolution").alias("new"), F.col("callee_id").alias("new_id"))
    rows = calls.join(symbols.select(F.col("id").alias("caller_id"), F.col("file_id").alias("caller_file_id")), "caller_id").join(o, ["caller_file_id", "callee"], "left")
    use = (F.col("direct_count") > 0) & (F.col("resolution") == "unresolved") & F.col("new").isNotNull()
    return rows.withColumn("callee_id", F.when(use, F.col("new_id")).otherwise(F.col("callee_id"))).withColumn("resolution", F.when(use, F.col("new")).otherwise(F.col("resolution"))).select(*calls.columns)
