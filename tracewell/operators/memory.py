"""Observations and documents as tables: timeline, synchronisation, import, export, vectors to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import fingerprint, normal_tags, redact_secrets, strip_private
from tracewell.operators.topk import latest, newest, positions


def timeline(rows: DataFrame, anchors: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """The neighbours in time of each anchor id: anchor, id, created_at_epoch, side ('before' or 'after'), step.

    Before are the newest before + 1 rows up to the anchor's time (all rows of that time among them, the higher ids
    first), after the oldest ones behind it. Unknown anchors have none. Rows get their place in the order of time once;
    an anchor then meets its neighbours in an equi-join on the place, so any number of anchors costs one join.
    """
    unique = rows.filter(F.col("created_at_epoch").isNotNull()).select("id", "created_at_epoch").distinct()
    placed = positions(unique, ["created_at_epoch", "id"])
    lasts = placed.groupBy("created_at_epoch").agg(F.max("position").alias("_last"))
    known = anchors.select(F.col("id").alias("anchor")).distinct().join(unique.withColumnRenamed("id", "anchor"), "anchor").join(lasts, "created_at_epoch")
    steps = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(max(0, before))), lambda i: F.struct(F.lit("before").alias("side"), i.alias("step"), (F.col("_last") - i).alias("position"))),
        F.transform(F.sequence(F.lit(1), F.lit(after)), lambda i: F.struct(F.lit("after").alias("side"), i.alias("step"), (F.col("_last") + i).alias("position"))) if after > 0 else F.array(),
    )
    wanted = known.select("anchor", F.inline(steps))
    return wanted.join(placed, "position").select("anchor", "id", "created_at_epoch", "side", "step")


def changes(listed: DataFrame, indexed: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """How a listing differs from an index: key, change ('added', 'updated', 'unchanged', 'removed'). Both have one row for each key."""
    there = listed.select(key, F.struct(*versions).alias("_new")).withColumn("_there", F.lit(True))
    known = indexed.select(key, F.struct(*versions).alias("_old")).withColumn("_known", F.lit(True))
    change = (
        F.when(F.col("_known").isNull(), "added").when(F.col("_there").isNull(), "removed").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    )
    return there.join(known, key, "full").select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; of several the highest version counts, new before old."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(every, key, [version, "_new"]).drop("_new")


def reconcile(stored: DataFrame, files: DataFrame) -> DataFrame:
    """What a memory sync does with each file and stored row: action, file_path, fingerprint, id.

    A file whose path is known is 'touched' or, with another fingerprint, 'updated'; else one whose fingerprint is known
    is 'renamed' and keeps its id; else it is 'added'. Stored rows of history and conversations without a file are
    'removed'. Of stored rows with one path the newest counts, the others are 'duplicate'.
    """
    paths = stored.filter(F.col("file_path") != "")
    newest = latest(paths.select("file_path", "fingerprint", "id", "source_type", "updated_at_epoch"), ["file_path"], [F.desc("updated_at_epoch"), F.desc("id")])
    duplicates = paths.select("id", "file_path", "fingerprint").distinct().join(newest.select("id"), "id", "left_anti").select(F.lit("duplicate").alias("action"), "file_path", "fingerprint", "id")
    old = newest.select("file_path", F.col("fingerprint").alias("_old"), "id", "source_type")
    by_path = files.select("file_path", "fingerprint").distinct().join(old.drop("source_type"), "file_path", "left")
    known = by_path.filter("id is not null").select(F.when(F.col("_old") == F.col("fingerprint"), "touched").otherwise("updated").alias("action"), "file_path", "fingerprint", "id")
    open_files = by_path.filter("id is null").select("file_path", "fingerprint")
    gone = old.join(files.select("file_path").distinct(), "file_path", "left_anti")
    one_gone = latest(gone.select(F.col("_old").alias("fingerprint"), "id"), ["fingerprint"], [F.col("id")])
    met = open_files.join(one_gone, "fingerprint", "left")
    renamed = met.select(F.when(F.col("id").isNull(), "added").otherwise("renamed").alias("action"), "file_path", "fingerprint", "id")
    kept = renamed.filter("action = 'renamed'").select("id")
    removed = gone.filter(F.col("source_type").isin("history", "conversation")).join(kept, "id", "left_anti").select(F.lit("removed").alias("action"), "file_path", F.col("_old").alias("fingerprint"), "id")
    return known.unionByName(renamed).unionByName(removed).unionByName(duplicates)


def safe_path(path: Column) -> Column:
    """Local paths of another machine are no paths here."""
    local = path.rlike(r"^(?:/|~|[A-Za-z]:[\\/]|\\\\)") | F.contains(path, F.lit(".."))
    return F.when(local, "import://local-path-redacted").otherwise(F.coalesce(path, F.lit("")))


def importable(payload: DataFrame, stored: DataFrame) -> DataFrame:
    """Observations of an import that are new: cleaned of private blocks and secrets, blank ones left out, one for each fingerprint (the lowest key first).

    payload: source_type, session_id, title, content, tags_json, file_path, created_at_epoch, fingerprint (null: of its contents).
    """
    clean = payload.withColumns(
        {
            "source_type": F.coalesce(F.nullif(F.trim("source_type"), F.lit("")), F.lit("import")),
            "title": redact_secrets(strip_private(F.coalesce("title", F.lit("")))),
            "content": redact_secrets(strip_private(F.coalesce("content", F.lit("")))),
            "tags": normal_tags(F.col("tags_json")),
            "file_path": safe_path(F.col("file_path")),
        }
    ).filter((F.col("title") != "") & (F.col("content") != ""))
    print_ = fingerprint(F.col("source_type"), F.col("title"), F.col("content"), F.col("created_at_epoch"))
    clean = clean.withColumn("fingerprint", F.coalesce(F.nullif("fingerprint", F.lit("")), print_))
    columns = ["fingerprint", "source_type", "session_id", "title", "content", "tags", "file_path", "created_at_epoch"]
    one = latest(clean.select(*columns), ["fingerprint"], [F.col("created_at_epoch"), F.col("title"), F.col("content"), F.col("file_path"), F.col("session_id")])
    return one.join(stored.select("fingerprint").distinct(), "fingerprint", "left_anti")


def export_rows(rows: DataFrame, limit: int = 50_000) -> DataFrame:
    """The newest observations for an export; the limit is the export's feature."""
    return rows.orderBy(F.desc("created_at_epoch"), F.desc("id")).limit(max(1, min(limit, 50_000)))


def to_embed(docs: DataFrame, vectors: DataFrame, key: str, changed: str, indexed: str) -> DataFrame:
    """Documents without a vector or with one older than they are: key, why ('missing' or 'stale')."""
    have = vectors.select(F.col(key), F.col(indexed).alias("_indexed"), F.lit(True).alias("_have"))
    joined = docs.select(key, F.col(changed).alias("_changed")).join(have, key, "left")
    why = F.when(F.col("_have").isNull(), "missing").when(F.col("_changed") > F.col("_indexed"), "stale")
    return joined.select(key, why.alias("why")).filter("why is not null")


def orphans(vectors: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Vectors whose document is gone."""
    return vectors.select(key).distinct().join(docs.select(key), key, "left_anti")
