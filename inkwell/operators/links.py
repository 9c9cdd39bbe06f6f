"""Links between notes: extraction, resolution, backlinks, orphans, co-citation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import base_key, clean_target, directory, resolve_dots
from inkwell.session import cut

#: The name in [[name#heading|label]], and a note's path in [label](path.md#heading), which may hold blanks.
_WIKI = r"\[\[([^\]|#]+)[^\]]*\]\]"
_INLINE = r"\]\(([^)]+?\.md)(?:#[^)]*)?\)"


def extract(notes: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(src, target) of each note, each target once: wiki links and inline links to notes."""
    wiki = F.transform(F.regexp_extract_all(F.col(body), F.lit(_WIKI), 1), lambda t: F.trim(t))
    inline = F.filter(F.transform(F.regexp_extract_all(F.col(body), F.lit(_INLINE), 1), lambda t: F.trim(t)), lambda t: ~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    targets = F.filter(F.array_union(wiki, inline), lambda t: t != "")
    return notes.select(F.col(path).alias("src"), F.explode(targets).alias("target"))


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` with target_base and dst: the first of target, target.md, both from the source's folder, then the least path of that name.

    One equi-join over the candidates in order instead of four; the smallest rank that exists wins.
    """
    clean = clean_target(F.col("target"))
    folder = directory(F.col("src"))
    beside = resolve_dots(F.when(folder == "", clean).otherwise(F.concat(folder, F.lit("/"), clean)))
    # Read twice below: cut, or the bodies would be searched for links twice.
    named = cut(links.withColumn("target_base", base_key(clean)))
    ways = F.array(clean, F.concat(clean, F.lit(".md")), beside, F.concat(beside, F.lit(".md")))
    tried = named.select("src", "target", F.posexplode(ways).alias("way", "candidate"))
    exact = tried.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("src", "target").agg(F.min_by("candidate", "way").alias("exact"))
    by_name = files.select("path", base_key(F.col("path")).alias("target_base")).groupBy("target_base").agg(F.min("path").alias("by_name"))
    return named.join(exact, ["src", "target"], "left").join(by_name, "target_base", "left").select("src", "target", "target_base", F.coalesce("exact", "by_name").alias("dst"))


def refresh(stored: DataFrame, fresh: DataFrame, files: DataFrame, moved: DataFrame) -> DataFrame:
    """The resolved links of a tree after a change: those of the notes read anew (``fresh``), and of ``stored``, without the
    links of such notes, the ones that a path which came or went (``moved``) can touch. All others keep their answer.

    A path touches the links to its name. A target that ends in dots or a slash names a note by other steps: always tried.
    """
    key = base_key(F.col("path"))
    names = moved.select(F.explode(F.array(key, base_key(key))).alias("target_base")).distinct()
    odd = F.col("target_base").isin("", ".", "..")
    touched = stored.where(odd).unionByName(stored.where(~odd).join(names, "target_base", "left_semi"), allowMissingColumns=False)
    again = resolve(touched.select("src", "target").unionByName(fresh.select("src", "target")), files)
    return stored.where(~odd).join(names, "target_base", "left_anti").select(again.columns).unionByName(again)


def dead(links: DataFrame, attachments: bool = True) -> DataFrame:
    """Links that lead nowhere; ``attachments`` False leaves out targets with a file extension."""
    out = links.where("dst is null")
    return out if attachments else out.where(~F.lower("target").rlike(r"\.[a-z0-9]"))


def backlinks(links: DataFrame) -> DataFrame:
    return links.where("dst is not null").groupBy("dst").agg(F.countDistinct("src").alias("backlinks"))


def orphans(links: DataFrame, files: DataFrame) -> DataFrame:
    """Notes that link to no note and that no note links to."""
    live = links.where("dst is not null")
    return files.select("path").join(live.select(F.col("src").alias("path")), "path", "left_anti").join(live.select(F.col("dst").alias("path")), "path", "left_anti")


def co_citation(links: DataFrame) -> DataFrame:
    """(a, b, together): pairs a < b of notes that the same sources link to, and how many.

    Targets of one source are bounded by the links that a note holds, so the pairs of a source are bounded too.
    """
    live = links.where("dst is not null").select("src", "dst").distinct()
    left, right = live.select("src", F.col("dst").alias("a")), live.select("src", F.col("dst").alias("b"))
    return left.join(right, "src").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))


def changed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to delete and to insert to make ``old`` into ``new``."""
    keys = ["src", "target"]
    return old.join(new.select(keys), keys, "left_anti"), new.join(old.select(keys), keys, "left_anti")
