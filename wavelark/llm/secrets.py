"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates come from three base patterns and one for mixed-character runs. Each candidate's value is
hashed and counted over the corpus by distinct repositories and distinct owners: values that many
owners or very many repositories carry are copied examples, values of few look live. A mixed-character
run becomes a span only if it looks live; base spans stay whatever their counts.

A value that a third of all documents carry is reduced to its distinct owners and repositories before
it is counted. Counts are written, so that the join back to spans may be split where a value is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, fresh, stage, text_or_empty

#: Kinds in their order, patterns, the group that holds the value, its least length.
KINDS = ("assign", "access", "hex", "live")
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "live": (r"[A-Za-z0-9+_=-]{24,}", 0, 24),
}
#: Owners of a value, or repositories, from which on it counts as a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6


def _candidates(kind: str) -> Column:
    """Matches as (kind, n, gap, len, value hash, ok): gap is the number of code points since the match before."""
    rx, group, least = PATTERNS[kind]
    text, pattern = F.col("text"), F.lit(rx)
    gaps = F.split(text, rx, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(group)) if group else whole

    def one(x: Column, n: Column) -> Column:
        ok = F.length(x["v"]) >= least
        if kind == "live":
            ok = ok & x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[0-9]")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), n.cast("int").alias("n"), F.length(x["g"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("len"), F.xxhash64(x["v"]).alias("value"), ok.alias("ok")
        )

    none = F.transform(F.array().cast("array<struct<g:string,m:string,v:string>>"), one)
    return F.when(text.rlike(rx), F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)), whole, values).cast("array<struct<g:string,m:string,v:string>>"), one)).otherwise(none)


def scan_secrets(documents: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """documents(doc_id, text, owner and repository columns, ...) -> a row per distinct (doc_id, text_hash, text of it) with its spans.

    Columns: doc_id, text_hash, rows (how many input rows are this document), found: array of
    (start, kind, end, live, owners, repositories, covered), by start, then kind; covered: where the
    spans before it end, at most. Offsets are code points, end exclusive. Null text is empty. A null owner or repository counts as one of its own. Repeated rows
    share a row here; a null doc_id is kept as such. Texts without a match have an empty array.
    """
    columns = {c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(c).cast("string"))) for c in {owner_col, *repository_cols}}
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty().alias("text"),
        columns[owner_col].alias("owner"),
        F.concat_ws("\1", *[columns[c] for c in repository_cols]).alias("repository"),
    )
    matched, _ = stage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repository", F.concat(*[_candidates(k) for k in KINDS]).alias("c")), "secrets")
    each = matched.where(F.size("c") > 0).select("doc_id", "text_hash", "owner", "repository", F.explode("c").alias("c")).select("doc_id", "text_hash", "owner", "repository", "c.*")
    # A hot value is reduced to its owners and repositories before it meets in one place.
    good = each.where("ok").select("value", "owner", "repository").distinct()
    counts, _ = stage(good.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")), "counts")
    rows = matched.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.first("c").alias("c"))
    # Where a match ends: all gaps and matches up to it, a running sum over the document's matches of a kind.
    up_to = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("n")
    placed = rows.where(F.size("c") > 0).select("doc_id", "text_hash", F.explode("c").alias("c")).select("doc_id", "text_hash", "c.*").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(up_to))
    spans = placed.where("ok").select("doc_id", "text_hash", (F.col("end") - F.col("len")).alias("start"), "kind", "end", "value")
    ahead = Window.partitionBy("doc_id", "text_hash").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    judged = (
        spans.join(counts, "value")
        .withColumn("live", (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories))
        .where((F.col("kind") < KINDS.index("live")) | F.col("live"))
        .withColumn("covered", F.coalesce(F.max("end").over(ahead), F.lit(0)))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repositories", "covered"))).alias("found"))
        .withColumnRenamed("doc_id", "d")
        .withColumnRenamed("text_hash", "h")
    )
    none = F.expr("array_repeat(named_struct('start', 0L, 'kind', 0, 'end', 0L, 'live', true, 'owners', 0L, 'repositories', 0L, 'covered', 0L), 0)")
    return rows.select("doc_id", "text_hash", "rows").join(judged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text_hash", "rows", F.coalesce("found", none).alias("found"))


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(documents: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, and the most owners and repositories of a span's value (null without spans)."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] < 3)
    count = lambda test: F.size(F.filter(found, test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    rows = scan_secrets(documents, **options)
    return rows.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(found).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
        F.array_max(F.transform(found, lambda s: s["owners"])).alias("most_owners"),
        F.array_max(F.transform(found, lambda s: s["repositories"])).alias("most_repositories"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    ).drop("copy")


def redact_secrets(documents: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by `mark`; n_chars follows where it is a column.

    Null texts stay null. Every row stays, repeated ones too, each redacted alike; an empty table gives no
    row. Columns of any names pass through.
    """
    d, h, s, key = fresh(documents, "found_id", "found_hash", "found_spans", "key")
    spans = scan_secrets(documents, **options).where(F.size("found") > 0).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("found").alias(s))
    text, found = F.col("text"), F.col(s)
    # What stands between spans, before each that does not begin inside earlier ones; then the rest.
    before = F.transform(F.filter(found, lambda x: x["start"] >= x["covered"]), lambda x: F.substring(text, x["covered"].cast("int") + 1, (x["start"] - x["covered"]).cast("int")))
    rest = F.substring(text, F.array_max(F.transform(found, lambda x: x["end"])).cast("int") + 1, F.length(text))
    clean = F.when(found.isNull(), text).otherwise(F.concat(F.array_join(before, mark), F.lit(mark), rest))
    keyed = documents.withColumn(key, F.xxhash64(text_or_empty()))
    out = keyed.join(spans, keyed["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(h)), "left").withColumn("text", clean)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns_of(documents))
