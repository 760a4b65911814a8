"""Documentation ranking: evidence tiers before scores, every reason kept."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import depth, lexical_score, subject_terms

DECLARATIONS = 192
#: Where a code area's documents are.
AREA_ALIASES = {
    "arch": "arch",
    "block": "block",
    "drivers": "driver-api",
    "fs": "filesystems",
    "include": "core-api",
    "kernel": "core-api",
    "net": "networking",
    "security": "security",
    "sound": "sound",
    "tools": "tools",
    "virt": "virt",
}


@dataclass
class Study:
    """What documents are ranked for."""

    path: str
    kind: str  # symbol, file or dir
    name: str = ""
    declarations: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)  # specific owners in rank order


def declarations(symbols: DataFrame, file_id: int) -> DataFrame:
    """A file's declared names, most telling first: functions, aggregates, typedefs, the rest; exported, long names first."""
    order = F.when(F.col("kind").isin("function", "syscall"), 0).when(F.col("kind").isin("struct", "union", "enum"), 1).when(F.col("kind") == "typedef", 2).otherwise(3)
    rows = symbols.filter((F.col("file_id") == file_id) & F.col("kind").isin("function", "syscall", "struct", "union", "enum", "typedef", "variable"))
    best = rows.groupBy("name").agg(F.min(order).alias("k"), F.max(F.col("is_exported").cast("int")).alias("e"))
    return best.orderBy("k", F.desc("e"), F.desc(F.length("name")), "name").limit(DECLARATIONS).select("name")


def _areas(study: Study, docs: DataFrame) -> list[str]:
    parts = [p for p in study.path.split("/") if p]
    if study.kind != "dir" or not parts or parts[0] == "Documentation":
        return []
    top = AREA_ALIASES.get(parts[0], parts[0])
    wanted = [AREA_ALIASES.get(parts[-1], parts[-1]), *([f"{top}/{parts[-1]}"] if len(parts) > 1 else []), top]
    wanted = list(dict.fromkeys(wanted))
    tests = [F.bool_or(_in_area(a)).alias(f"a{k}") for k, a in enumerate(wanted)]
    found = docs.agg(*tests).first()
    return [a for k, a in enumerate(wanted) if found[k]]


def _in_area(area: str):
    prefix = f"Documentation/{area}"
    return F.col("path").startswith(prefix + "/") | (F.col("path").startswith(prefix + ".") & ~F.substring("path", len(prefix) + 2, 100000).contains("/"))


def rank(study: Study, docs: DataFrame, owner_of: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """docs (path, name, size, lines) that have evidence, best first, with tier and reasons.

    owner_of: (path, subsystem_id) claims of documents. Tiers: 0 the document itself, 1 in its
    directory, 2 same owner and subject, 3 name terms, 4 same owner, 5 area.
    """
    spark = docs.sparkSession
    code = study.kind in ("symbol", "file") and not study.path.startswith("Documentation/")
    parts = [p for p in study.path.split("/") if p]
    exact = study.path if study.path.startswith("Documentation/") and study.kind != "dir" else None
    prefix = None
    if study.kind == "dir" and study.path in ("", "Documentation"):
        prefix = "Documentation/"
    elif study.path.startswith("Documentation/"):
        prefix = study.path.rstrip("/") + "/" if study.kind == "dir" else study.path.rpartition("/")[0] + "/"
    names = [study.name] if study.kind == "symbol" else study.declarations
    terms = spark.createDataFrame([(parts[-1] if parts else "", study.name if study.kind == "symbol" else "", "/".join(parts[-3:]), names)], "a string, b string, c string, names array<string>")
    identity = F.array_union(subject_terms(F.col("a")), subject_terms(F.col("b")))
    meaning = F.array_union(subject_terms(F.col("c")), F.array_distinct(F.flatten(F.transform("names", subject_terms))))
    terms = terms.select(identity.alias("identity"), meaning.alias("meaning"))
    rows = docs.crossJoin(F.broadcast(terms))  # one row
    own = subject_terms(F.regexp_replace("path", "^Documentation/", ""))
    rows = rows.withColumn("own", own).withColumn("path_score", lexical_score(F.col("identity"), F.col("own"))).withColumn("meaning_score", lexical_score(F.col("meaning"), F.col("own")))
    if owner_of is not None and study.owners:
        order = spark.createDataFrame(list(zip(study.owners, range(len(study.owners)))), "subsystem_id long, owner int")
        rows = rows.join(owner_of.join(F.broadcast(order), "subsystem_id").groupBy("path").agg(F.min("owner").alias("owner")), "path", "left")
    else:
        rows = rows.withColumn("owner", F.lit(None).cast("int"))
    area = F.lit(None).cast("int")
    roots = _areas(study, docs)
    for k in range(len(roots) - 1, -1, -1):
        area = F.when(_in_area(roots[k]), k).otherwise(area)
    is_exact = F.lit(False) if exact is None else F.col("path") == exact
    inside = F.lit(False) if prefix is None else F.col("path").startswith(prefix)
    owned, scored = F.col("owner").isNotNull(), F.col("meaning_score") > 0
    rows = rows.withColumn("area", area)
    tier = F.when(is_exact, 0).when(inside, 1).when(owned & scored, 2).when(F.col("path_score") > 0, 3).when(owned, 4).when(F.col("area").isNotNull(), 5)
    guide = F.lower("path").rlike(r"\.(rst|txt|md)$") & ~F.col("path").startswith("Documentation/devicetree/bindings/")
    overview = F.when(F.lower(F.regexp_replace("name", r"\.[^.]*$", "")).isin("index", "readme", "overview"), 0).otherwise(1)
    reasons = F.array_compact(
        F.array(
            F.when(is_exact, F.lit("the document itself")),
            F.when(inside, F.lit("in the target's documentation directory")),
            F.when(owned, F.lit("claimed by an owner of the target")),
            F.when(F.col("path_score") > 0, F.lit("its name shares terms with the target's")),
            F.when(scored, F.lit("its path shares terms with the target's subject")),
            F.when(F.col("area").isNotNull(), F.lit("documents the target's area")),
            F.when(F.lit(code) & guide, F.lit("prose")),
        )
    )
    rows = rows.withColumn("tier", tier).filter("tier is not null").withColumn("purpose", F.when(F.lit(code) & ~guide, 1).otherwise(0)).withColumn("overview", overview).withColumn("reasons", reasons)
    far = F.lit(10**6)
    rows = rows.orderBy("tier", "purpose", F.desc("meaning_score"), F.coalesce("owner", far), F.coalesce("area", far), "overview", depth(F.col("path")), "path")
    rows = rows.select("path", "name", "tier", "purpose", "path_score", "meaning_score", "reasons")
    return rows.limit(limit) if limit else rows
