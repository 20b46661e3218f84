"""Secret scanning with corpus-wide ownership, with DataFrame functions only.

Candidate credentials are found by patterns. Over the whole corpus each candidate's hash is counted
by distinct repositories and owners: one that many owners hold is a widely copied example, one that
looks random and belongs to few owners is taken as live. Known token formats beyond the base patterns
are reported only where ownership says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import column, documents, hot_lookup
from tidemark.llm.registry import query
from tidemark.llm.spans import add_spans, joined, kind_count
from tidemark.sources.staging import stage

KINDS = ("assign", "access", "hex", "format")
BASE = 3  # the first kinds are always reported
WIDE_OWNERS = 3  # owners from which on a candidate counts as a copied example

# fixed values: what is searched
ASSIGN = r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of 32 or more is the same as a whole run that is long enough
FORMATS = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[rs]k_live_[A-Za-z0-9]{16,}"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*"
    r"|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
)


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """(_uid, doc_id, owner, repository, found): base spans that pass their test, and known formats."""
    rows = docs.select(
        column("doc_id").alias("doc_id"),
        F.coalesce(column(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(column(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(column("text"), F.lit("")).alias("text"),
    )
    rows = add_spans(rows, "text", ASSIGN, "assign")
    rows = add_spans(rows, "text", ACCESS, "access", F.contains("text", F.lit("AKIA")))
    rows = add_spans(rows, "text", HEX, "hex")
    rows = add_spans(rows, "text", FORMATS, "format")

    def kept(rank: int, secret, test) -> Column:
        spans = F.transform(
            F.col(KINDS[rank]),
            lambda s: F.struct(
                F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), secret(s["value"]).alias("secret")
            ),
        )
        return F.filter(spans, lambda s: test(s["secret"]))

    found = F.concat(
        kept(0, lambda v: F.regexp_extract(v, ASSIGN, 1), lambda v: F.length(v) >= 8),
        kept(1, lambda v: v, lambda v: F.length(v) >= 16),
        kept(2, lambda v: v, lambda v: F.length(v) >= 32),
        kept(3, lambda v: v, lambda v: F.length(v) > 0),
    )
    return rows.select(F.monotonically_increasing_id().alias("_uid"), "doc_id", "owner", "repository", found.alias("found"))


def ownership(seen: DataFrame) -> DataFrame:
    """(hash, uses, repositories, owners) of candidates (hash, owner, repository); no step gathers one hash's rows."""
    by_repository = seen.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    by_owner = by_repository.groupBy("hash", "owner").agg(
        F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("repositories")
    )
    return by_owner.groupBy("hash").agg(
        F.sum("uses").alias("uses"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners")
    )


def looks_random(secret: Column) -> Column:
    """A digit, a letter, and at least eight different characters."""
    different = F.size(F.array_distinct(F.split(secret, "")))
    return secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") & (different >= 8)


def secret_spans(
    docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide_owners: int = WIDE_OWNERS
) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, all_spans.

    ``all_spans``: (rank, start, end, class) with class live, example or unclear. Base spans always stay;
    spans of other formats stay if they are not widely copied. Null texts count as empty; null owners are
    one owner; repeated rows are reported each; extra columns are ignored. An empty table gives no rows.
    """
    found = stage(candidates(docs, owner, repository), "candidates")
    each = found.filter(F.size("found") > 0).select("_uid", "owner", "repository", F.explode("found").alias("s"))
    each = stage(each.select("*", F.sha2(F.col("s.secret").cast("binary"), 256).alias("hash")), "seen")
    counts = stage(ownership(each), "ownership")
    met = hot_lookup(each, counts, "hash", "uses", each.count())
    live = looks_random(F.col("s.secret")) | (F.col("s.rank") == 3)
    kind = F.when(F.col("owners") >= wide_owners, "example").when(live, "live").otherwise("unclear")
    met = met.withColumn("class", kind).filter((F.col("s.rank") < BASE) | (F.col("class") != "example"))
    span = F.struct("s.rank", "s.start", "s.end", "class")
    spans = met.groupBy("_uid").agg(F.array_sort(F.collect_list(span)).alias("all_spans"))
    none = F.array().cast("array<struct<rank:int,start:bigint,end:bigint,class:string>>")
    rows = found.drop("found").join(spans, "_uid", "left").withColumn("all_spans", F.coalesce("all_spans", none))
    base = F.filter("all_spans", lambda s: s["rank"] < BASE)

    def classed(name: str) -> Column:
        return F.size(F.filter("all_spans", lambda s: s["class"] == name)).cast("long")

    return rows.select(
        "doc_id",
        *[kind_count(F.col("all_spans"), i).alias(f"n_{KINDS[i]}") for i in range(BASE)],
        F.sha2(joined(base, KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("all_spans"), KINDS).alias("spans"),
        classed("live").alias("n_live"),
        classed("example").alias("n_example"),
        "all_spans",
    )


@query("op9_secrets")
def op9_secrets(spark, sf_dir):
    return secret_spans(documents(spark, sf_dir)).drop("all_spans")
