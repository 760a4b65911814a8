"""Ownership: pattern matching, overlap, labels and composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.owners import CATCH_ALL_NAME, CATCH_ALL_SCORE, Rule, compile_rules
from codestrata.functions.text import ratio
from codestrata.operators.paths import ancestors, under

#: What the top-level directories are about.
AREAS = {
    "arch": "Architecture",
    "block": "Block layer",
    "certs": "Certificates",
    "crypto": "Crypto API",
    "Documentation": "Documentation",
    "drivers": "Device drivers",
    "fs": "Filesystems",
    "include": "Headers",
    "init": "Init",
    "io_uring": "io_uring",
    "ipc": "IPC",
    "kernel": "Core kernel",
    "lib": "Library",
    "LICENSES": "Licenses",
    "mm": "Memory management",
    "net": "Networking",
    "rust": "Rust support",
    "samples": "Samples",
    "scripts": "Build scripts",
    "security": "Security",
    "sound": "Sound",
    "tools": "Tools",
    "usr": "Initramfs",
    "virt": "Virtualization",
}


def area_of(path: Column) -> Column:
    """The area of a path by its first component, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv])
    return F.try_element_at(table, F.split(path, "/")[0])


def match_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(ref_id, subsystem_id, score) of every file and section that matches: best score of its rules, excludes taken out.

    Rules are few (a file's worth of patterns, compiled on the driver) and broadcast; files meet
    the rules of their ancestor directories by equality, the regex is a residual. Name rules have
    no directory; an alternation of them all is tested first.
    """
    spark = files.sparkSession
    if not rules:
        return spark.createDataFrame([], "ref_id long, subsystem_id long, score long")
    table = F.broadcast(spark.createDataFrame([(r.section, r.kind, r.bucket, r.regex, r.score) for r in rules], "section long, kind string, bucket string, regex string, score long"))
    placed = files.select("id", "path", F.explode(ancestors(F.col("path"))).alias("dir"))
    globs = placed.join(table.filter("kind != 'name'"), F.col("dir") == F.col("bucket")).filter(F.expr("path rlike regex"))
    names = [r.regex for r in rules if r.kind == "name"]
    hits = globs.select("id", "section", "kind", "score")
    if names:
        maybe = files.filter(F.col("path").rlike("|".join(f"(?:{n})" for n in names))).select("id", "path", F.lit("").alias("dir"))
        named = maybe.join(table.filter("kind = 'name'"), F.col("dir") == F.col("bucket")).filter(F.expr("path rlike regex"))
        hits = hits.union(named.select("id", "section", "kind", "score"))
    best = hits.groupBy("id", "section").agg(F.max(F.when(F.col("kind") != "exclude", F.col("score"))).alias("score"), F.bool_or(F.col("kind") == "exclude").alias("out"))
    return best.filter("score is not null and not out").select(F.col("id").alias("ref_id"), F.col("section").alias("subsystem_id"), "score")


def match_sections(spark: SparkSession, files: DataFrame, sections: list[dict], directories: set[str] = frozenset()) -> DataFrame:
    return match_rules(files, compile_rules(sections, directories))


def overlaps(claims: DataFrame, sections: DataFrame, subsystem_id: int, catch_all: str = CATCH_ALL_NAME, min_shared: int = 1) -> DataFrame:
    """Sections that claim files of one section: shared files, both coverages and Jaccard, most shared first."""
    own = claims.filter(F.col("subsystem_id") == subsystem_id).select("ref_id")
    total = sections.filter(F.col("id") == subsystem_id).select(F.col("n_files").alias("own_n"))
    other = sections.filter(F.col("name") != catch_all).select(F.col("id").alias("subsystem_id"), "name", F.col("n_files").alias("other_n"))
    shared = claims.filter(F.col("subsystem_id") != subsystem_id).join(own, "ref_id").groupBy("subsystem_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    rows = shared.join(other, "subsystem_id").crossJoin(F.broadcast(total))  # one row
    union = F.col("own_n") + F.col("other_n") - F.col("shared")
    return rows.select(
        "name", "shared", ratio(F.col("shared"), F.col("own_n")).alias("coverage"), ratio(F.col("shared"), F.col("other_n")).alias("other_coverage"), ratio(F.col("shared"), union).alias("jaccard")
    ).orderBy(F.desc("shared"), F.desc("jaccard"), "name")


def unclaimed(files: DataFrame, claims: DataFrame, directory: str = "") -> DataFrame:
    """Files without a primary owner."""
    return files.filter(under(F.col("path"), directory)).join(claims.filter("is_primary").select(F.col("ref_id").alias("id")), "id", "left_anti")


def file_labels(files: DataFrame, claims: DataFrame, sections: DataFrame, catch_all: str = CATCH_ALL_NAME) -> DataFrame:
    """(id, path, label): the only primary owner, ``Co-owned (n subsystems)``, or the area; never a guess."""
    owners = claims.filter("is_primary").join(sections.select(F.col("id").alias("subsystem_id"), "name"), "subsystem_id").groupBy("ref_id").agg(F.count("*").alias("n"), F.count_if(F.col("name") != catch_all).alias("k"), F.min(F.when(F.col("name") != catch_all, F.col("name"))).alias("one"))
    label = F.when((F.col("k") == 1) & (F.col("n") == 1), F.col("one")).when(F.col("k") > 1, F.concat(F.lit("Co-owned ("), F.col("k").cast("string"), F.lit(" subsystems)"))).otherwise(area_of(F.col("path")))
    return files.join(owners, F.col("id") == F.col("ref_id"), "left").select("id", "path", label.alias("label"))


def directory_labels(owners: DataFrame, sections: DataFrame, open_files: DataFrame, paths: DataFrame, catch_all: str = CATCH_ALL_NAME) -> DataFrame:
    """(path, label): a section only if it alone is primary everywhere below; else the area or ``Mixed``, saying what is unclassified.

    owners: directory_owners(); open_files: (path, n) files below without primary owner; paths: (path).
    """
    named = owners.filter("n_primary > 0").join(sections.select(F.col("id").alias("subsystem_id"), "name"), "subsystem_id")
    per = named.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("name") != catch_all).alias("k"), F.min("name").alias("one"), F.max("coverage").alias("cover"))
    rows = paths.join(per, "path", "left").join(open_files.withColumnRenamed("n", "open"), "path", "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    vague = (F.coalesce("open", F.lit(0)) > 0) | (n > k)
    area = area_of(F.col("path"))
    count = F.concat(k.cast("string"), F.when(k == 1, F.lit(" subsystem")).otherwise(F.lit(" subsystems")))
    label = (
        F.when((n == 1) & (k == 1) & (F.col("cover") == 1.0), F.col("one"))
        .when((n > 1) & area.isNotNull(), F.concat(area, F.when(vague, F.lit(" (mixed; includes unclassified)")).otherwise(F.lit(" (mixed)"))))
        .when(n > 1, F.concat(F.lit("Mixed ("), count, F.when(vague, F.lit(" + unclassified)")).otherwise(F.lit(")"))))
        .when((n == 1) & (k == 0), area)
        .when((k == 1) & vague & area.isNotNull(), F.concat(area, F.lit(" (mixed; includes unclassified)")))
        .when((k == 1) & vague, F.lit("Mixed (1 subsystem + unclassified)"))
        .when(n == 0, area)
    )
    return rows.select("path", label.alias("label"))


def ancestry(places: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, depth, path, label): the directories above each place (id, path), outermost first, with their directory_labels()."""
    above = places.select("id", F.posexplode(ancestors(F.col("path"))).alias("depth", "path"))
    return above.join(labels, "path", "left").select("id", "depth", "path", "label")


def unclaimed_counts(files: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, n): files without a primary owner below each directory that has any."""
    return unclaimed(files, claims).select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def of_path(claims: DataFrame, sections: DataFrame, ref_id: int) -> DataFrame:
    """All owners of a file in rank order."""
    return claims.filter(F.col("ref_id") == ref_id).join(sections.select(F.col("id").alias("subsystem_id"), "name"), "subsystem_id").select("name", "score", "rank", "is_primary").orderBy("rank")


def section_list(counts: DataFrame, sort: str = "size") -> DataFrame:
    """Sections by size (primary files), claimed, primary or name."""
    orders = {"size": [F.desc("n_primary_files"), F.desc("n_files"), "name"], "claimed": [F.desc("n_files"), "name"], "primary": [F.desc("n_primary_files"), "name"], "name": ["name"]}
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}")
    return counts.orderBy(*orders[sort])


def section_directories(owners: DataFrame, subsystem_id: int) -> DataFrame:
    """One section's directories: most primary files, then coverage, then depth, then path."""
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    rows = owners.filter(F.col("subsystem_id") == subsystem_id)
    return rows.select("path", "n_claimed", "n_primary", "coverage", depth.alias("depth")).orderBy(F.desc("n_primary"), F.desc("coverage"), F.desc("depth"), "path")


def section_by_name(counts: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Exact name, else equal but for case (ASCII), else names that hold it; largest first, ties by name."""
    from codestrata.functions.text import LOWER, UPPER, ascii_fold

    folded = name.translate(str.maketrans(UPPER, LOWER))
    mine = ascii_fold(F.col("name"))
    tier = F.when(F.col("name") == name, 0).when(mine == folded, 1).when(mine.contains(folded), 2)
    rows = counts.withColumn("tier", tier).filter("tier is not null")
    best = rows.agg(F.min("tier").alias("best"))
    return rows.crossJoin(F.broadcast(best)).filter("tier = best").drop("tier", "best").orderBy(F.desc("n_files"), "name").limit(limit)  # one row


__all__ = ["CATCH_ALL_SCORE", "area_of", "match_rules", "match_sections", "overlaps", "unclaimed", "file_labels", "directory_labels"]
