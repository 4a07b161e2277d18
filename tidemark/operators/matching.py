"""Exact record matching with ordered fallbacks and explicit ambiguity (inventory J3-J7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.policy import Policy
from ..sources.scratch import written
from ..sources.snapshot import Snapshot, settled

STATUSES = ("matched_primary", "matched_fallback", "ambiguous_primary", "ambiguous_fallback", "candidate_only", "reference_only", "invalid_identity")
_COLUMNS = ("status", "candidate_idx", "reference_idx", "candidate_key", "reference_key", "method", "pass")


def _counted(keyed: DataFrame, name: str) -> DataFrame:
    """Per key its number of records and the least ordinal; null keys have no group."""
    return keyed.where("k is not null").groupBy("k").agg(F.count("*").alias(f"{name}_n"), F.min("idx").alias(f"{name}_at"))


def _grouped(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Per key both sides' numbers of records and least ordinals, added up map-side in one grouping of fixed-width sums; a side without records has 0 and NULL."""
    none = F.lit(None).cast("long")
    rows = ref.select("k", F.col("idx").alias("r"), none.alias("c")).unionByName(cand.select("k", none.alias("r"), F.col("idx").alias("c")))
    return rows.where("k is not null").groupBy("k").agg(F.count("r").alias("ref_n"), F.min("r").alias("ref_at"), F.count("c").alias("cand_n"), F.min("c").alias("cand_at"))


def _keys(side: Snapshot, keys: Sequence[Sequence[str]]) -> DataFrame:
    """``idx, k0, k1, ...``. Each identity value is worked out once, before the keys mention it."""
    fields = list(dict.fromkeys(f for k in keys for f in k))
    values = settled(side.df.select("idx", *[V.identity_value(side.col(f), side.normalise).alias(f"v{i}") for i, f in enumerate(fields)]))
    return values.select("idx", *[V.identity_key([F.col(f"v{fields.index(f)}") for f in k]).alias(f"k{i}") for i, k in enumerate(keys)])


def match(reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """One row a candidate record, then one an unclaimed reference record.

    Columns: status, candidate_idx, reference_idx, candidate_key, reference_key, method
    (primary, fallback) and pass (0 the primary key, n the n-th fallback).

    Every pass groups both sides by its key, once, with map-side counts, so a repeated key never
    multiplies rows. A group of one candidate and one reference names both records, so pairs
    come out of the grouping itself; only records of the other groups are looked up by their key. In a fallback
    pass ambiguity is judged on all references but only on candidates still open. Keys and each pass's
    groups are written once, so a plan does not grow with the number of fallback keys.
    """
    keys = [policy.primary_key, *[k for k in policy.fallback_keys if k]]
    names = [f"k{i}" for i in range(len(keys))]
    ref = written(_keys(reference, keys), "reference-keys")
    open_ = written(_keys(candidate, keys), "candidate-keys")
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda df, status, c, r, ck, rk, method, n: df.select(*[x.alias(name) for x, name in zip((status, c, r, ck, rk, method, F.lit(n)), _COLUMNS, strict=True)])
    done: list[DataFrame] = []
    claimed: DataFrame | None = None
    first: DataFrame | None = None
    later: list[DataFrame] = []
    for n in range(len(keys)):
        kind = "fallback" if n else "primary"
        here = open_.withColumn("k", F.col(names[n]))
        groups = written(_grouped(ref.select("idx", F.col(names[n]).alias("k")), here).where("cand_n > 0" if n else "true"), f"groups-{n}")
        first = groups if first is None else first
        one = groups.where("cand_n = 1 and ref_n = 1")
        rest = groups.where("cand_n > 1 or (cand_n = 1 and ref_n <> 1)").select("k", ((F.col("cand_n") > 1) | (F.col("ref_n") > 1)).alias("ambiguous"))
        if claimed is not None:
            one = written(one, f"pairs-{n}")
            taken = claimed.join(one.select(F.col("ref_at").alias("reference_idx")), "reference_idx", "left_semi").select(F.col("reference_idx").alias("ref_at"), F.lit(True).alias("taken"))
            one = written(one.join(taken, "ref_at", "left"), f"judged-{n}")
            rest = rest.unionByName(one.where("taken").select("k", F.lit(False).alias("ambiguous")))
            one = one.where("taken is null")
        k = F.col("k")
        done.append(row(one, F.lit(f"matched_{kind}"), F.col("cand_at"), F.col("ref_at"), k, k, F.lit(kind), n))
        found = done[-1].select("reference_idx")
        if n:
            later.append(found.withColumnRenamed("reference_idx", "idx"))
        claimed = found if claimed is None else claimed.unionByName(found)
        left = written(here.join(written(rest, f"rest-{n}"), "k"), f"left-{n}")
        done.append(row(left.where("ambiguous"), F.lit(f"ambiguous_{kind}"), F.col("idx"), null("long"), k, null("string"), null("string"), n))
        open_, bare = left.where("not ambiguous").select("idx", *names), here.where("k is null")
        if n:
            open_ = open_.unionByName(bare.select("idx", *names))
        else:
            done.append(row(bare, F.lit("invalid_identity"), F.col("idx"), null("long"), k, null("string"), null("string"), n))
    done.append(row(open_, F.lit("candidate_only"), F.col("idx"), null("long"), F.col("k0"), null("string"), null("string"), 0))
    # references that no pass claimed, judged by the groups of the primary key
    unclaimed = first.where("ref_n = 1 and cand_n <> 1").select(F.col("ref_at").alias("idx"), "k", (F.col("cand_n") > 1).alias("ambiguous"))
    many = written(first.where("ref_n > 1").select("k"), "repeated")
    unclaimed = unclaimed.unionByName(ref.select("idx", F.col("k0").alias("k")).join(many, "k", "left_semi").withColumn("ambiguous", F.lit(True)))
    unclaimed = unclaimed.unionByName(ref.where("k0 is null").select("idx", F.col("k0").alias("k"), F.lit(False).alias("ambiguous")))
    for pairs in later:
        unclaimed = unclaimed.join(pairs, "idx", "left_anti")
    status = F.when(F.col("k").isNull(), "invalid_identity").when(F.col("ambiguous"), "ambiguous_primary").otherwise("reference_only")
    done.append(row(unclaimed, status, null("long"), F.col("idx"), null("string"), F.col("k"), null("string"), 0))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def ambiguity(reference: Snapshot, candidate: Snapshot, fields: Sequence[str]) -> DataFrame:
    """Per repeated key the number of records a side and ``side`` (reference, candidate, both)."""
    ref = _counted(reference.df.select("idx", reference.key(fields).alias("k")), "ref")
    cand = _counted(candidate.df.select("idx", candidate.key(fields).alias("k")), "cand")
    out = ref.join(cand, "k", "full_outer").select(F.col("k").alias("key"), F.coalesce("ref_n", F.lit(0)).alias("reference_n"), F.coalesce("cand_n", F.lit(0)).alias("candidate_n")).where("reference_n > 1 or candidate_n > 1")
    return out.withColumn("side", F.when((F.col("reference_n") > 1) & (F.col("candidate_n") > 1), "both").when(F.col("reference_n") > 1, "reference").otherwise("candidate"))


def summary(matches: DataFrame, policy: Policy) -> DataFrame:
    """One row: counts by status, candidates, rate and whether it meets the policy's minimum."""
    sums = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    out = matches.agg(F.count("candidate_idx").alias("candidates"), *sums)
    rate = F.when(F.col("candidates") == 0, F.lit(0.0)).otherwise((F.col("matched_primary") + F.col("matched_fallback")) / F.greatest("candidates", F.lit(1)))
    return out.withColumn("match_rate", rate).withColumn("meets_minimum", F.col("match_rate") >= policy.minimum_match_rate)


#: Rows of wide and of narrow joins that one task sorts at most; partitions grow in number with the rows, not in size.
WIDE, NARROW = 250_000, 1_000_000


def parts(rows: DataFrame, each: int) -> int:
    """Partitions of at most about ``each`` rows. ``rows`` are written, so that counting reads no data."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def matched(matches: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """Matched pairs: the match columns, structs ``r`` and ``c`` of both records and ``key`` (the candidate's primary key, else the reference's).

    Both records of a pair have the key of its pass, so only that and the pass move with the records.
    """
    n = parts(matches, WIDE)
    pairs = matches.where("method is not null").select("candidate_idx", "reference_idx", "candidate_key", "pass")
    r, c = reference.df.select(F.col("idx").alias("reference_idx"), reference.record().alias("r")), candidate.df.select(F.col("idx").alias("candidate_idx"), candidate.record().alias("c"))
    both = pairs.repartition(n, "reference_idx").join(r, "reference_idx").repartition(n, "candidate_idx").join(c, "candidate_idx")
    method = F.when(F.col("pass") == 0, "primary").otherwise("fallback")
    both = both.select(F.concat(F.lit("matched_"), method).alias("status"), "candidate_idx", "reference_idx", "candidate_key", F.col("candidate_key").alias("reference_key"), method.alias("method"), "pass", "r", "c")
    return both.withColumn("key", F.coalesce(candidate.key(policy.primary_key, "c"), reference.key(policy.primary_key, "r")))
