"""Planning transfers over tables: access rules, wanted volumes, failover, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rules(lines: DataFrame) -> DataFrame:
    """(fp, set_id or null for all) of allow-list lines (value): a fingerprint, then sets; '#' starts a comment."""
    words = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    parsed = lines.select(words.alias("w")).where(F.element_at("w", 1) != "")
    sets = F.when(F.size("w") > 1, F.slice("w", 2, 1 << 20)).otherwise(F.array(F.lit(None).cast("string")))
    return parsed.select(F.lower(F.element_at("w", 1)).alias("fp"), F.explode(sets).alias("set_id")).distinct()


def may_read(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requests (client, set_id) that a rule for that set or for all sets admits."""
    own = requests.join(allowed.where("set_id is not null").select(F.col("fp").alias("client"), "set_id"), ["client", "set_id"], "left_semi")
    every = requests.join(allowed.where("set_id is null").select(F.col("fp").alias("client")), "client", "left_semi")
    return own.unionByName(every).distinct()


def not_revoked(clients: DataFrame, revoked: DataFrame) -> DataFrame:
    return clients.join(revoked, "client", "left_anti")


def admitted(allowed: DataFrame) -> DataFrame:
    """All fingerprints that some rule names."""
    return allowed.select("fp").distinct()


def restricted(allowed: DataFrame) -> DataFrame:
    """Fingerprints with rules for single sets only."""
    return allowed.where("set_id is not null").select("fp").distinct().join(allowed.where("set_id is null"), "fp", "left_anti")


def readers_of_sets(allowed: DataFrame, sets: DataFrame) -> DataFrame:
    """Readers of each set, by a rule of its own or for all."""
    every = allowed.where("set_id is null").select("fp").distinct()
    n = every.agg(F.count("*").alias("n_every"))
    own = allowed.where("set_id is not null").join(every, "fp", "left_anti").groupBy("set_id").agg(F.countDistinct("fp").alias("n_own"))
    return sets.join(own, "set_id", "left").join(F.broadcast(n)).select("set_id", (F.coalesce("n_own", F.lit(0)) + F.col("n_every")).alias("readers"))


def served(volumes: DataFrame) -> DataFrame:
    """Sets with their available volumes in order."""
    return volumes.groupBy("set_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("ix")), lambda x: x.cast("string")), ",").alias("volumes"))


def matching_set(prefixes: DataFrame, sets: DataFrame, least: int = 16) -> DataFrame:
    """Prefixes of `least` characters or more that match exactly one set id; joined on the first `least` characters."""
    long = prefixes.where(F.length("prefix") >= least).withColumn("head", F.substring("prefix", 1, least))
    met = long.join(sets.select("set_id", F.substring("set_id", 1, least).alias("head")), "head").where(F.startswith("set_id", F.col("prefix")))
    return met.groupBy("prefix").agg(F.count("*").alias("n"), F.min("set_id").alias("set_id")).where("n = 1").select("prefix", "set_id")


def wanted(volumes: DataFrame, local: DataFrame, have: DataFrame) -> DataFrame:
    """Volumes (set_id, ix) that are not here and that some peer has."""
    return volumes.join(local, ["set_id", "ix"], "left_anti").join(have, ["set_id", "ix"], "left_semi")


def needed(volumes: DataFrame, local: DataFrame, have: DataFrame, data: int) -> DataFrame:
    """The fewest wanted volumes that complete each set to `data`: data volumes first, then parity."""
    here = local.groupBy("set_id").agg(F.count("*").alias("here"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("ix"))
    met = wanted(volumes, local, have).withColumn("rank", rank).join(here, "set_id", "left")
    return met.where(F.col("rank") <= data - F.coalesce("here", F.lit(0))).select("set_id", "ix")


def failover(pieces: DataFrame, peers: int, attempts: int = 3) -> DataFrame:
    """For each piece (ix, start) the peers in the order they are asked."""
    return pieces.select("ix", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(min(attempts, peers) - 1)), lambda k: F.pmod(F.col("start") + k, F.lit(peers)))).alias("attempt", "peer"))


def resumable(claimed: DataFrame, disk: DataFrame, expected: DataFrame) -> DataFrame:
    """Pieces that the map claims and whose bytes on disk have the expected hash; claims alone count for nothing."""
    return claimed.where("have").join(disk, "ix").join(expected, "ix").where(F.sha2("payload", 256) == F.col("h")).select("ix")


def fetch_report(pieces: DataFrame) -> DataFrame:
    """Counters of pieces (state, s, retries)."""
    return pieces.agg(F.count_if(F.col("state") == "fetched").alias("fetched"), F.count_if(F.col("state") == "kept").alias("kept"), F.count_if(F.col("state") == "failed").alias("failed"), F.sum(F.when(F.col("state") == "fetched", F.col("s")).otherwise(0)).alias("bytes"), F.sum("retries").alias("retries"))


def plain_line(line):
    """Whether a request line is at most 256 printable ASCII bytes."""
    return line.rlike(r"^[\t\r -~]{0,255}$")
