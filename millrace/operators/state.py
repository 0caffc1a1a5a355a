"""State over runs: upsert of a batch into a snapshot, latest-wins, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest(df: DataFrame, key: Column, order: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the columns of the row that is last in the order. An aggregation with partial maxima, so hot keys cost nothing."""
    top = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key.alias("key")).agg(top.alias("row")).select("key", "row.*")


def sources_in_order(at: str, source: str) -> Column:
    """Aggregate: the distinct sources in order of first sight."""
    seen = F.array_sort(F.collect_set(F.struct(at, source)))
    return F.array_distinct(F.filter(seen[source], lambda s: s.isNotNull() & (s != "")))


def upsert(snapshot: DataFrame, batch: DataFrame, key: str = "job_id_hash") -> DataFrame:
    """The snapshot after a batch: key, first_seen, last_seen, source_names, authentic_status, is_new.

    snapshot: key, first_seen, last_seen, source_names, authentic_status; batch: key, seen, source_name,
    authentic_status. A new key is inserted and counts as new unless closed; a known one keeps first_seen and takes
    status and time of the batch. One union and one aggregation: neither side is collected or broadcast.
    """
    old = snapshot.select(key, F.lit(0).alias("side"), "first_seen", "last_seen", "source_names", "authentic_status")
    new = batch.groupBy(key).agg(F.lit(1).alias("side"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), sources_in_order("seen", "source_name").alias("source_names"), F.max_by("authentic_status", F.struct("seen", "authentic_status")).alias("authentic_status"))
    both = old.unionByName(new).groupBy(key).agg(
        F.min_by("first_seen", "side").alias("first_seen"), F.max_by("last_seen", "side").alias("last_seen"),
        F.min(F.when(F.col("side") == 0, F.col("source_names"))).alias("a"), F.min(F.when(F.col("side") == 1, F.col("source_names"))).alias("b"),
        F.max_by("authentic_status", "side").alias("authentic_status"), (F.min("side") == 1).alias("unseen"),
    )
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.coalesce("a", none), F.coalesce("b", none)))
    return both.select(key, "first_seen", "last_seen", names.alias("source_names"), "authentic_status", (F.col("unseen") & ~F.col("authentic_status").eqNullSafe("CLOSED")).alias("is_new"))


def pruned(df: DataFrame, last_seen: Column, as_of: float, days: int = 90) -> DataFrame:
    """Without rows that are closed and were seen last more than so many days before as_of (epoch seconds)."""
    return df.where(~(F.col("authentic_status").eqNullSafe("CLOSED") & F.coalesce(last_seen < as_of - days * 86400, F.lit(False))))


def best_match(candidates: DataFrame) -> DataFrame:
    """id1, id2: the row that each incoming one is merged into: an equal hash (tier 0), else the highest score, the first tier, the smaller id. candidates: id1, id2, tier, score."""
    top = F.max(F.struct((F.col("tier") == 0).alias("same"), "score", (-F.col("tier")).alias("t"), (-F.col("id2")).alias("m")))
    return candidates.groupBy("id1").agg(top.alias("b")).select("id1", (-F.col("b.m")).alias("id2"))


#: What a merge takes from the incoming row; title, company, place, role, description, dates and first sight stay.
MUTABLE = [
    "apply_url_direct", "authentic_status", "confidence_score", "valid_through", "employer_domain", "canonical_job_id", "block_key", "possible_duplicate_of", "identity_score", "authenticity_score",
    "match_score", "decision", "matched_via", "original_url", "canonical_url", "final_url", "description_fingerprint", "job_version", "posting_id", "source_authority", "evidence", "negative_evidence",
]


def merged(snapshot: DataFrame, batch: DataFrame, key: str, to: str, mutable: list[str] = MUTABLE, order: str = "id1") -> DataFrame:
    """The snapshot (key, last_seen_at, source_names, ...) after a batch whose rows are matched to stored ones (column ``to``), with ``merged``.

    A matched row takes time and mutable columns of the batch's last row for it (by ``seen``, then ``order``), null ones too,
    and the sources it didn't have in order of sight. One aggregation with partial maxima and one join; a hot row
    costs one entry a task.
    """
    names = F.array_sort(F.collect_set(F.struct("seen", "source_name")))["source_name"]
    last = batch.groupBy(F.col(to).alias(key)).agg(F.max_by(F.struct(*mutable), F.struct("seen", order)).alias("__new"), F.max("seen").alias("__seen"), names.alias("__names"))
    rows = snapshot.join(last, key, "left")
    hit = F.col("__new").isNotNull()
    own = F.coalesce("source_names", F.array().cast("array<string>"))
    more = F.filter(F.coalesce("__names", F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    changed = {c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in mutable if c in snapshot.columns}
    rows = rows.withColumns({**changed, "last_seen_at": F.coalesce("__seen", "last_seen_at"), "source_names": F.array_distinct(F.concat(own, more)), "merged": hit})
    return rows.drop("__new", "__seen", "__names")


def migrated(rows: DataFrame, schema: str) -> DataFrame:
    """A stored table of an older form in the present one: columns it lacks come as null, others are cast; a placeholder without any of them gives no rows."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema)
    known = [f for f in want if f.name in rows.columns]
    out = rows.select(*[(F.col(f.name) if f in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
    return out if len(known) > 1 else out.where(F.lit(False))


def stepped(snapshot: DataFrame, batch: DataFrame, key: str = "job_id_hash") -> tuple[DataFrame, DataFrame]:
    """Rows of a batch in the order of their arrival, without replaying them one by one: the first row of each new key, and the later ones that fall on it or on a stored one.

    batch: key, seen, row_id and others. (inserted, repeated): a row that arrives first for a key that isn't stored is inserted; all
    others are repeats, to be merged. Rows that are alike but have different keys meet in the candidates of the next batch
    only: that is what the set-based step gives up against a replay.
    """
    first = batch.groupBy(key).agg(F.min_by("row_id", F.struct("seen", "row_id")).alias("__first"))
    marked = batch.join(first, key).join(snapshot.select(key, F.lit(True).alias("__held")).dropDuplicates([key]), key, "left")
    new = F.col("__held").isNull() & (F.col("row_id") == F.col("__first"))
    return marked.where(new).drop("__first", "__held"), marked.where(~new).drop("__first", "__held")
