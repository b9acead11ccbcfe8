"""The state of a workspace: projects with their segments nested, a glossary,
a memory and the history of exports.

Segments stay nested: a row holds at most ``PART`` segments of a project as an
array of structs, and a change is a join of the parts with their patches and a
rewrite of the array in place.  Nothing is exploded and regrouped, and a
project of any size is many rows.  A saved state is one version of all sections
(JSON lines), which counts once its mark exists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segq.sources.versions import Versions

#: Segment ids of one row.
PART = 256

#: Terms below which a glossary is a seed, and terms of a seed dump.
SMALL, SEED = 100, 150

COMMENTS = "array<struct<author: string, text: string>>"
SEGMENT = f"id long, source string, target string, status string, risk string, comments {COMMENTS}"
SEGMENTS = f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in SEGMENT.split(', ', 5))}>>"
TERM = ("src", "tgt", "cat", "freq", "conf")

#: One document in the older form, everything nested in it.  A state may be
#: spread over many, numbered in ``document``; sections are then put together.
DOCUMENT = (
    f"document long, projects array<struct<id: long, title: string, src: string, tgt: string, segments: {SEGMENTS}>>, "
    "glossary array<struct<src: string, tgt: string, cat: string, freq: long, conf: string>>, "
    "tm array<struct<src: string, tgt: string, quality: string, verified: boolean>>, exportHistory array<struct<file: string, when: string, size: string>>"
)

#: Sections of a saved state.  Terms and exports stand in the order of batch
#: (newest first), document and pos.
SECTIONS = {
    "projects": "id long, title string, src string, tgt string",
    "parts": f"project_id long, part long, segments {SEGMENTS}",
    "glossary": "src string, tgt string, cat string, freq long, conf string, batch long, document long, pos long",
    "tm": "src string, tgt string, quality string",
    "history": "file string, when string, size string, batch long, document long, pos long",
}


@dataclass(frozen=True)
class State:
    projects: DataFrame
    parts: DataFrame
    glossary: DataFrame
    tm: DataFrame
    history: DataFrame


def _part(key: Column) -> Column:
    return F.floor(key / PART).cast("long")


def nested(segments: DataFrame) -> DataFrame:
    """Parts of rows (project_id and the fields of a segment).  A project holds
    one segment an id, of repeats the smallest; rows without a project or an id
    can't be addressed and are no segments."""
    fields = [f.split(" ")[0] for f in SEGMENT.split(", ", 5)]
    rows = segments.filter("project_id is not null and id is not null").groupBy("project_id", "id").agg(F.min(F.struct(*fields)).alias("s"))
    return rows.groupBy("project_id", _part(F.col("id")).alias("part")).agg(F.sort_array(F.collect_list("s")).alias("segments"))


def from_documents(spark: SparkSession, path: str, full: DataFrame | None = None, multiline: bool = True) -> State:
    """A state in the older form, migrated: a glossary of under ``SMALL`` terms
    gives way to ``full`` (TERM and pos) if that has as many, and a memory row
    without a quality takes it from ``verified``.  Null is as good as absent."""
    state = spark.read.schema(DOCUMENT).json(path, multiLine=multiline)
    number = F.coalesce("document", F.lit(0)).alias("document")
    projects = state.select(F.explode("projects").alias("p"))
    segments = projects.select(F.col("p.id").alias("project_id"), F.explode("p.segments").alias("s")).select("project_id", "s.*")
    listed = lambda c: state.select(number, F.posexplode(c).alias("pos", "x")).select("x.*", F.lit(0).cast("long").alias("batch"), "document", F.col("pos").cast("long").alias("pos"))
    glossary = listed("glossary")
    if full is not None and glossary.limit(SMALL).count() < SMALL <= full.limit(SMALL).count():
        glossary = full.select(*TERM, F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("document"), F.col("pos").cast("long").alias("pos"))
    quality = F.coalesce("quality", F.when(F.col("verified"), "verified").otherwise("draft"))
    return State(
        projects.select("p.id", "p.title", "p.src", "p.tgt").filter("id is not null").groupBy("id").agg(F.min(F.struct("title", "src", "tgt")).alias("p")).select("id", "p.*"),
        nested(segments),
        glossary,
        state.select(F.inline("tm")).select("src", "tgt", quality.alias("quality")),
        listed("exportHistory"),
    )


def save(spark: SparkSession, state: State, path: str) -> int:
    """The number of the version that holds the state."""
    versions = Versions(spark, path, "")
    number = versions.next()
    for name in SECTIONS:
        getattr(state, name).write.json(f"{versions.folder(number)}/{name}", compression="gzip")
    return versions.publish(number)


def load(spark: SparkSession, path: str, number: int | None = None, seed: State | None = None) -> State:
    """A saved state, the newest by default; ``seed`` where nothing is saved."""
    versions = Versions(spark, path, "")
    numbers = versions.numbers()
    if not numbers and seed is not None:
        return seed
    if not numbers or (number is not None and number not in numbers):
        raise ValueError(f"no version {number if number is not None else ''} under {path}")
    folder = versions.folder(number or numbers[-1])
    return State(**{name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in SECTIONS.items()})


def seed_dump(state: State) -> State:
    """The whole state with the first terms of its glossary alone."""
    return replace(state, glossary=state.glossary.orderBy(F.desc("batch"), "document", "pos", *TERM).limit(SEED))


def in_order(rows: DataFrame) -> DataFrame:
    """Terms or exports from front to end."""
    return rows.orderBy(F.desc("batch"), "document", "pos")


def rewritten(state: State, patches: DataFrame, change: Callable[[Column, Column], dict[str, Column]]) -> State:
    """Segments that have a patch (project_id, id, seq and any columns; of
    patches of one segment the last by seq stands) with the fields that
    ``change(segment, patch)`` returns; patches without a segment do nothing."""
    rest = [c for c in patches.columns if c not in ("project_id", "id", "seq")]
    own = patches.filter("project_id is not null and id is not null").groupBy("project_id", "id").agg(F.max(F.struct("seq", *rest)).alias("patch"))
    entries = F.map_from_entries(F.collect_list(F.struct("id", "patch"))).alias("patches")
    by_part = own.groupBy("project_id", _part(F.col("id")).alias("part")).agg(entries)

    def one(s: Column) -> Column:
        patch = F.try_element_at(F.col("patches"), s["id"])
        new = s
        for field, value in change(s, patch).items():
            new = new.withField(field, value)
        return F.when(patch.isNull(), s).otherwise(new)

    segments = F.when(F.col("patches").isNull(), F.col("segments")).otherwise(F.transform("segments", one)).cast(SEGMENTS)
    parts = state.parts.join(by_part, ["project_id", "part"], "left").select("project_id", "part", segments.alias("segments"))
    return replace(state, parts=parts)


def update_segments(state: State, patches: DataFrame) -> State:
    """Patches of target, status, author and comment, each of them null if it
    isn't given: a text that isn't blank makes a new segment translated, a
    status given wins over that, a comment is appended."""

    def change(s: Column, p: Column) -> dict[str, Column]:
        status = F.when((s["status"] == "new") & (F.trim(p["target"]) != ""), "translated").otherwise(s["status"])
        comment = F.array(F.struct(F.coalesce(p["author"], F.lit("")).alias("author"), p["comment"].alias("text")))
        comments = F.coalesce(s["comments"], F.array().cast(COMMENTS))
        return {
            "target": F.coalesce(p["target"], s["target"]),
            "status": F.when(p["status"] != "", p["status"]).otherwise(status),
            "comments": F.when(p["comment"] != "", F.concat(comments, comment)).otherwise(comments),
        }

    return rewritten(state, patches, change)


def revert_segments(state: State, keys: DataFrame) -> State:
    """A confirmed segment is translated again, a failed one new and blank."""

    def change(s: Column, p: Column) -> dict[str, Column]:
        failed = s["status"] == "failed"
        status = F.when(s["status"] == "confirmed", "translated").when(failed, "new").otherwise(s["status"])
        return {"target": F.when(failed, "").otherwise(s["target"]), "status": status}

    return rewritten(state, keys.select("project_id", "id", F.lit(0).alias("seq")), change)


def save_terms(state: State, requests: DataFrame) -> State:
    """Requests (TERM, is_new, seq; of requests for one term the last stands):
    the first entry of the term takes the values unless ``is_new``; else a new
    entry goes to the front, the last request foremost."""
    g = state.glossary
    batch = g.agg(F.coalesce(F.max("batch"), F.lit(0)) + 1).first()[0]
    values = [c for c in TERM if c != "src"]
    one = requests.filter("src is not null").groupBy("src").agg(F.max(F.struct("seq", "is_new", *values)).alias("put"))
    place = F.struct((-F.col("batch")).alias("batch"), "document", "pos")
    asked = one.join(g.groupBy("src").agg(F.min(place).alias("first")), "src", "left")
    fresh = F.coalesce(F.col("put.is_new"), F.lit(False)) | F.col("first").isNull()
    old = g.join(asked.filter(~fresh).select(F.col("src").alias("put_src"), "first", "put"), (F.col("src") == F.col("put_src")) & (place == F.col("first")), "left")
    old = old.select("src", *(F.when(F.col("put_src").isNotNull(), F.col(f"put.{c}")).otherwise(F.col(c)).alias(c) for c in values), "batch", "document", "pos")
    new = asked.filter(fresh).select("src", *(f"put.{c}" for c in values), F.lit(batch).alias("batch"), F.lit(0).cast("long").alias("document"), (-F.col("put.seq")).cast("long").alias("pos"))
    return replace(state, glossary=old.unionByName(new))


def without(state: State, section: str, keys: DataFrame, key: str) -> State:
    """The state without the rows of a section that have one of the keys; a
    project's segments go with it."""
    gone = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
    left = {section: getattr(state, section).join(gone, key, "left_anti")}
    if section == "projects":
        left["parts"] = state.parts.join(gone.withColumnRenamed(key, "project_id"), "project_id", "left_anti")
    return replace(state, **left)


def register_exports(state: State, exports: DataFrame, when: str) -> State:
    """Exports (project_id, format, seq) at the front of the history; the size
    is the same for all, as no file is made."""
    batch = state.history.agg(F.coalesce(F.max("batch"), F.lit(0)) + 1).first()[0]
    named = exports.join(state.projects.select(F.col("id").alias("project_id"), "title"), "project_id")
    new = named.select(
        F.concat_ws(".", "title", "format").alias("file"), F.lit(when).alias("when"), F.lit("≈ 80 КБ").alias("size"),
        F.lit(batch).alias("batch"), F.lit(0).cast("long").alias("document"), (-F.col("seq")).cast("long").alias("pos"),
    )
    return replace(state, history=state.history.unionByName(new))


def segments(state: State) -> DataFrame:
    return state.parts.select("project_id", F.inline("segments"))


def board(state: State) -> DataFrame:
    """Cards of each project by column of the board and by priority: segments
    under review stand with the translated ones; other statuses have no column."""
    column = F.when(F.col("status") == "review", "translated").otherwise(F.col("status"))
    priority = F.when(F.col("risk") == "critical", "urgent").when(F.col("risk").isin("high", "medium"), F.col("risk")).otherwise("low")
    rows = segments(state).select("project_id", column.alias("board_column"), priority.alias("priority"))
    return rows.filter(F.col("board_column").isin(*COLUMNS)).groupBy("project_id", "board_column", "priority").agg(F.count("*").alias("cards"))


#: Columns of the board.
COLUMNS = ("new", "translated", "qa", "confirmed")
