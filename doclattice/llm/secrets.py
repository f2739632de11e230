"""Secrets in texts, judged by how widely each value is owned in the whole corpus.

Only DataFrame functions. Matches and their places come from the pieces between them: a split by the
same pattern gives the gaps, so a running sum of lengths gives code-point positions.

A value that many owners have (documentation examples, templates) is an *example*; one that stays
with few owners is *live*. The corpus also decides on long mixed tokens that no keyword announces:
they count as secrets, and add a span, if few owners hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.functions.text import let
from doclattice.llm.tables import text_or_empty, written

# Kinds in their order, patterns, the group that holds the value, its least length.
KINDS = ("assign", "access", "hex", "token")
PATTERNS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"[A-Za-z0-9_-]{20,}", 0, 20),
}
#: A token has to mix these.
MIXED = (r"[0-9]", r"[A-Z]", r"[a-z]")
BASE = KINDS[:3]
#: Parts into which the rows of one value are dealt when verdicts go back to them.
SALT = 32
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"


#: Numbers added up at once: a fold copies what it has at every step, so it runs in short blocks.
RUN = 512


def sums_before(numbers: Column) -> Column:
    """For each element of an array<int> the sum of those before it, as array<bigint>; in time that
    follows the length of the array."""
    zero = F.array(F.lit(0).cast("long"))
    last = lambda a: F.element_at(a, -1)

    def block(own: Column, b: Column) -> Column:
        places = F.sequence(b * RUN, F.least((b + 1) * RUN, F.size(own)) - 1)
        return F.aggregate(places, zero, lambda s, i: F.concat(s, F.array(last(s) + F.get(own, i))))

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, zero, lambda s, x: F.concat(s, F.array(last(s) + last(x))))
        return let(starts, lambda at: F.flatten(F.transform(
            blocks, lambda x, k: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + F.get(at, k)))))

    sums = let(numbers, lambda own: let(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int")), lambda b: block(own, b)), joined))
    return F.when(F.size(numbers) > 0, sums).otherwise(F.array().cast("array<bigint>"))


def spans_of(text: Column, kind: str) -> Column:
    """array<SPAN> of one kind: leftmost non-overlapping matches, those with too short a value
    dropped after matching. Positions are code points, ends exclusive."""
    pattern, group, least = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rank = KINDS.index(kind)

    def passes(v: Column) -> Column:
        ok = F.length(v) >= least
        for need in MIXED if kind == "token" else ():
            ok = ok & v.rlike(need)
        return F.coalesce(ok, F.lit(False))

    # Splitting with a limit of -1 keeps empty pieces: piece i stands before match i.
    size = lambda x: F.coalesce(F.length(x), F.lit(0))

    def walked(both: Column) -> Column:
        begins = sums_before(F.transform(both, lambda m: size(m["gap"]) + size(m["match"])))
        placed = F.zip_with(both, begins, lambda m, at: F.struct(
            (at + F.length(m["gap"])).alias("start"), F.lit(rank).alias("rank"),
            (at + F.length(m["gap"]) + size(m["match"])).alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))
        return F.filter(placed, lambda s: passes(s["value"]))

    joined = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))
    # Most texts have no match: the walk is not even begun.
    return F.when(text.rlike(pattern), let(joined, walked)).otherwise(F.array()).cast(f"array<{SPAN}>")


def candidates(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(row, doc_id, hashed, repository, owner, spans): all candidate spans of every row, in a written
    table. NULL text is empty; rows that share a doc_id stay rows of their own."""
    whole = text_or_empty(text)
    spans = F.array_sort(F.concat(*(spans_of(F.col("_text"), kind) for kind in KINDS)))
    return written(
        docs.select(F.col("doc_id").alias("doc_id"), F.col(repository).cast("string").alias("repository"),
                    F.col(owner).cast("string").alias("owner"), whole.alias("_text"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("_text").alias("hashed"), "repository", "owner", spans.alias("spans")),
        "secret-spans",
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per value (by digest): how many repositories and owners of the whole corpus hold it. Counted
    in two steps with map-side partial sums, so a value that is everywhere is no hot key."""
    one = found.select("repository", "owner", F.explode("spans").alias("s")).select(
        F.sha2(F.col("s.value"), 256).alias("digest"), "repository", "owner"
    )
    pairs = one.groupBy("digest", "repository", "owner").agg(F.lit(1).alias("one"))
    per_owner = pairs.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("digest").agg(
        F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")
    )


def judged(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source",
           example_owners: int = 3) -> tuple[DataFrame, DataFrame]:
    """(candidate rows, spans): spans has row, start, end, kind, n_repositories, n_owners, live.

    A value with ``example_owners`` or more owners is an example, not live. Base spans always stay;
    a span of kind ``token`` stays only if it is live and overlaps no base span of its text.
    """
    found = candidates(docs, text, repository, owner)
    counts = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    # The base span that reaches furthest of those before a token, and the next one behind it.
    is_base = F.col("rank") < len(BASE)
    up = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    overlaps = (F.max(F.when(is_base, F.col("end"))).over(up) > F.col("start")) | (F.min(F.when(is_base, F.col("start"))).over(down) < F.col("end"))
    spans = (
        found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
        .withColumn("overlaps", F.coalesce(overlaps, F.lit(False)))
        .filter(is_base | ~F.col("overlaps"))
        .select("row", "start", "rank", "end", "kind", F.sha2("value", 256).alias("digest"),
                F.pmod(F.col("row"), F.lit(SALT)).cast("int").alias("salt"))
        .join(counts, ["digest", "salt"])
        .withColumn("live", F.col("n_owners") < example_owners)
        .filter(is_base | F.col("live"))
    )
    return found, spans.drop("salt")


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source",
         example_owners: int = 3) -> DataFrame:
    """One row per input row: doc_id and ``spans`` (start, rank, end, kind, digest, n_repositories,
    n_owners, live) in order; texts without secrets, empty and NULL ones have an empty array."""
    found, spans = judged(docs, text, repository, owner, example_owners)
    item = F.struct("start", "rank", "end", "kind", "digest", "n_repositories", "n_owners", "live")
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("all"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,digest:string,n_repositories:bigint,n_owners:bigint,live:boolean>>")
    return found.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", F.coalesce("all", none).alias("spans")
    )


def redact(docs: DataFrame, example_owners: int = 3, mark: str = "<secret>") -> DataFrame:
    """The same rows and columns with every live span of ``text`` replaced by ``mark`` and
    ``n_chars`` (if there is one) counted anew. Overlapping spans become one mark. Values that many
    owners share are documentation examples and stay."""
    names = docs.columns
    found = live_spans(docs, example_owners)
    same = docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(text_or_empty(docs["text"])) == found["_hashed"])
    kept = docs.join(found, same, "left")
    text = F.col("text")
    step = F.aggregate(
        F.col("_live"),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, m: F.when(m["start"] >= s["at"], F.struct(
            m["end"].alias("at"),
            F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (m["start"] - s["at"]).cast("int")), F.lit(mark)).alias("out"),
        )).otherwise(F.struct(F.greatest(s["at"], m["end"]).alias("at"), s["out"].alias("out"))),
    )
    clean = F.concat(step["out"], F.substring(text, (step["at"] + 1).cast("int"), F.length(text)))
    out = kept.withColumn("text", F.when(F.size("_live") > 0, clean).otherwise(text))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("_live") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*names)


def live_spans(docs: DataFrame, example_owners: int) -> DataFrame:
    """(_doc, _hashed, _live): the live spans of every text that has any. A text is known by its
    doc_id and hash, so rows that share an id, or have none, keep their own spans."""
    found, spans = judged(docs, example_owners=example_owners)
    live = spans.filter("live").join(found.select("row", "doc_id", "hashed"), "row")
    return live.groupBy(F.col("doc_id").alias("_doc"), F.col("hashed").alias("_hashed")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_live")
    )


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    return scanned.select(
        "doc_id", *(count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)),
        F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
