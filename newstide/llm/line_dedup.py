"""Line de-duplication: lines that many documents share stay in one of them only.

Long lines are exploded, hashed and counted by document. Lines above the threshold are dropped everywhere but in the largest
id, and each text is put together again from the stretches between the dropped positions. Texts travel once, for the last join.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.llm.quality import SPACES, _once
from newstide.operators.skew import sliced_join, stored


@dataclass(frozen=True)
class Rules:
    """Keys of at least ``chars`` code points that at least ``documents`` documents hold are dropped."""

    chars: int = 20
    documents: int = 3


def folded(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_keys(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, version (a hash of the text), pos (from 0) and the 128-bit hash (h, g) of each line whose key is long enough."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("version"), F.posexplode(F.split(folded(whole), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "version", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.length("key") >= rules.chars)
    return keyed.select("id", "version", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), F.col("key")).alias("g"))


def shared_lines(lines: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """h, g, keep (the largest id that holds the line) and n, its number of lines, for each line in enough documents."""
    held = lines.groupBy("h", "g", "id").agg(F.count(F.lit(1)).alias("n"))
    counts = held.groupBy("h", "g").agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("keep"), F.sum("n").alias("n"))
    return counts.where(F.col("documents") >= rules.documents).drop("documents")


def _without(lines: Column, dropped: Column) -> Column:
    """The lines at other positions than those of ``dropped`` (in order): the stretches between them, end to end."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def drop_shared_lines(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", out: str = "kept") -> DataFrame:
    """Add n_lines and n_dropped (long) and ``out``, the text without the lines that enough documents share.

    A text is split at each newline; a null or empty one is one empty line. A line's key is the line without ASCII white
    space at its ends, A-Z in lower case. Each row stays one row; columns called like a new one are replaced, all others
    stay. Rows with the same id count as one document, also for the largest id: all of them keep its lines. Rows without an
    id count as one document below all others. An empty table gives an empty result.
    """
    lines = stored(line_keys(docs, rules, doc_id, text), "line-keys")
    shared = stored(shared_lines(lines, rules), "shared-lines")
    found = sliced_join(lines, shared.drop("n"), ["h", "g"], shared.drop("keep"), F.xxhash64("version", "pos"))
    dropped = found.where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    dropped = dropped.select(F.col("id").alias("other_id"), F.col("version").alias("other_version"), "dropped")

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), whole.alias("whole"), F.xxhash64(whole).alias("version"))
    both = rows.join(dropped, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("version") == F.col("other_version")), "left")
    rest = _once(F.split("whole", "\n", -1), lambda x: _once(F.col("dropped"), lambda d: F.array_join(_without(x, d), "\n")))
    new = {
        "n_lines": (F.length("whole") - F.length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
        out: F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(rest),
    }
    made = both.select("row", F.struct(*[c.alias(n) for n, c in new.items()]).alias("new"))
    return made.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], "new.*")
