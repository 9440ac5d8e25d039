"""Line dedup by content-defined chunks, in DataFrame functions only.

A document's lines are hashed, and a polynomial rolling hash runs over the last
``WINDOW`` line hashes.  A chunk ends after every line whose rolling hash is a
local minimum, so boundaries depend on nearby lines only: inserted or removed
lines move the boundaries around them and no others, and a passage that occurs
in two documents is cut alike in both, but for its ends.  No two boundaries are
adjacent, so every chunk but a document's last has two lines or more.

Chunks of at least ``MIN_LINES`` lines and one word are compared across the
corpus: by hash and length first, and those that agree by their bytes.  Of equal
chunks the first (by id, then place) stays and the others' lines are removed.

With ``whole``, as in the registered query, the chunks are all windows of ``MIN_LINES``
neighbouring lines in place of those between boundaries, so that every run of that many
lines or more that stands at an earlier place, too, is found to its full length, wherever
it begins and ends.  A window that overlaps its first occurrence in its own text is no
copy of it.  Windows that touch make one run.

A chunk that very many places share, such as a line in a third of all texts, is dealt to
parts before it meets its first occurrence, which is sent to each of them.

Defined results: a null text stays null, an empty one empty; rows that repeat as
a whole (id and text) count as one document and lose or keep the same lines; a
text all of whose chunks are copies becomes empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .quality import bound

MIN_LINES = 2
WINDOW = 3
#: modulus and base of the rolling hash: products of two residues fit a long
PRIME = 2147483647
BASE = 1000003
#: chunks with more than this part of all repeated ones are dealt to parts; there are fewer than HOT of them, and 2 * HOT parts
HOT = 256


def _chunks(text):
    """SQL: array of (first line, lines, text) of a text's chunks."""
    residue = f"pmod(xxhash64(l), {PRIME}L)"
    rolling = " + ".join(f"coalesce(get(h, i - {j}), 0L) * {pow(BASE, j, PRIME)}L % {PRIME}L" for j in range(WINDOW))
    lowest = "(r <= coalesce(get(z, i - 1), r) AND r < coalesce(get(z, i + 1), r) AND i > 0)"
    ends = bound(
        f"transform(lines, l -> {residue})",
        "h -> "
        + bound(
            f"transform(h, (x, i) -> ({rolling}) % {PRIME}L)",
            f"z -> filter(transform(z, (r, i) -> CASE WHEN {lowest} OR i = size(z) - 1 THEN i END), e -> e IS NOT NULL)",
        ),
    )
    cut = bound(ends, "e -> transform(e, (x, j) -> struct(coalesce(get(e, j - 1) + 1, 0) AS first, x AS last))")
    return bound(f"split({text}, '\\\\n')", f"lines -> transform({cut}, c -> struct(c.first AS first, c.last - c.first + 1 AS n, array_join(slice(lines, c.first + 1, c.last - c.first + 1), '\\n') AS chunk))")


def _windows(text):
    """SQL: array of (first line, lines, text) of all ``MIN_LINES`` neighbouring lines of a text."""
    part = f"array_join(slice(lines, i + 1, {MIN_LINES}), '\\n')"
    return bound(f"split({text}, '\\n')", f"lines -> transform(slice(lines, 1, greatest(0, size(lines) - {MIN_LINES - 1})), (l, i) -> struct(i AS first, {MIN_LINES} AS n, {part} AS chunk))")


def joined_runs(windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, n) with those that overlap or touch in one."""
    inside = Window.partitionBy("doc_id", "text_hash").orderBy("first")
    begins = F.coalesce(F.col("first") > F.lag(F.col("first") + F.col("n")).over(inside), F.lit(True))
    runs = windows.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(inside))
    end = F.max(F.col("first") + F.col("n"))
    return runs.groupBy("doc_id", "text_hash", "run").agg(F.min("first").alias("start"), end.alias("end")).select("doc_id", "text_hash", F.col("start").alias("first"), (F.col("end") - F.col("start")).cast("int").alias("n"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, text_hash, first, n): runs of lines that repeat an earlier chunk of the corpus."""
    cut = _windows if whole else _chunks
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.expr(f"inline({cut('`' + text + '`')})"))
    own = own.where(f"n >= {MIN_LINES} AND chunk RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    own = own.withColumn("key", F.xxhash64("chunk")).withColumn("bytes", F.octet_length("chunk"))
    place = F.struct("doc_id", "text_hash", "first")
    groups = own.groupBy("key", "bytes").agg(F.min(place).alias("keeper"), F.max(place).alias("other"), F.count("*").alias("rows")).where("keeper <> other").drop("other")
    groups = stored(groups, "groups")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    groups = groups.withColumn("parts", F.ceil(F.col("rows") * HOT / F.lit(max(1, total))).cast("int")).drop("rows")
    hot = groups.where("parts > 1").select("key", "bytes", F.col("parts").alias("own_parts"))
    own = own.join(F.broadcast(hot), ["key", "bytes"], "left")
    own = own.withColumn("part", F.expr("coalesce(cast(pmod(xxhash64(doc_id, text_hash, first), own_parts) AS int), 0)")).drop("own_parts")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    met = stored(own.join(groups.select("*", part), ["key", "bytes", "part"]), "chunks")  # chunks whose hash another has, with their text
    kept = met.where(F.col("keeper") == place).select("key", "bytes", "parts", F.col("chunk").alias("kept")).distinct().select("key", "bytes", "kept", part)

    def apart(first):
        """Whether a chunk is another than the first of its text, and clear of it."""
        same = F.col("doc_id").eqNullSafe(F.col(f"{first}.doc_id")) & (F.col("text_hash") == F.col(f"{first}.text_hash"))
        return (F.col(first) != place) & ~(same & (F.col("first") < F.col(f"{first}.first") + F.col("n")))

    copies = met.where(F.col("keeper") != place).join(kept, ["key", "bytes", "part"])
    # byte comparison; of chunks that only share the hash, each text's own first one stays
    equal = copies.where(F.col("chunk") == F.col("kept")).where(apart("keeper")).select("doc_id", "text_hash", "first", "n")
    odd = copies.where("chunk <> kept")
    own_first = odd.groupBy("chunk").agg(F.min(place).alias("own"))
    out = equal.unionByName(odd.join(own_first, "chunk").where(apart("own")).select("doc_id", "text_hash", "first", "n")).distinct()
    return joined_runs(out) if whole else out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` with repeated chunks, or whole repeated runs, removed from ``text``, and ``n_lines``, ``n_removed_lines``, ``n_removed_chunks``."""
    runs = repeated(docs, doc_id, text, whole).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "n")).alias("__runs"))  # of one document
    runs = runs.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__runs")
    key = F.col("__id").eqNullSafe(F.col(doc_id)) & (F.col("__hash") == F.xxhash64(text))
    out = docs.join(runs, key, "left")
    # lines that stay: between one run's end and the next one's first
    stay = bound(
        f"split(`{text}`, '\\\\n')",
        "lines -> CASE WHEN __runs IS NULL THEN lines ELSE "
        + bound(
            "array_sort(__runs)",
            "r -> flatten(transform(sequence(0, size(r)), j -> slice(lines, coalesce(get(r, j - 1).first + get(r, j - 1).n, 0) + 1, "
            "greatest(0, coalesce(get(r, j).first, size(lines)) - coalesce(get(r, j - 1).first + get(r, j - 1).n, 0)))))",
        )
        + " END",
    )
    counts = "aggregate(coalesce(__runs, cast(array() AS array<struct<first: int, n: int>>)), 0L, (s, r) -> s + r.n)"
    return out.select(
        *[F.when(F.col("__runs").isNull(), F.col(c)).otherwise(F.array_join(F.expr(stay), "\n")).alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_chunks")],
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
        F.expr(counts).alias("n_removed_lines"),
        F.expr("cast(CASE WHEN __runs IS NULL THEN 0 ELSE size(__runs) END AS long)").alias("n_removed_chunks"),
    )
