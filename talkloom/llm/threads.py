"""Rebuilding conversations from message rows by pointer jumping over parent pointers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.tables import drop_stage, spread, stage
from . import speech

#: Neighbouring messages of one block of places are joined to one segment before pointers are followed.
BLOCK = 16


def follow_parents(messages: DataFrame, thread: str = "thread", node: str = "node", parent: str = "parent", weight: str | None = None) -> DataFrame:
    """Each message's place in its tree: thread, node, root, depth, status.

    messages: a row per message; (thread, node) unique, parent null for a root. A null
    node counts as an orphan of depth weight. depth is the sum of `weight` (1 a message)
    from the root down to the message. status: 'rooted'; 'orphan' where an ancestor is
    missing (root is then the missing one's id); 'cycle' where the parents lead in a ring
    (root null). Other columns are dropped.

    Pointers are doubled: each round joins the open messages with the table as it stood,
    so that a chain of n takes log2(n) rounds; closed messages no longer take part on the
    left. After as many rounds as the largest thread can need, what is open is on or
    behind a ring. Each round is written to shared storage.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    start = messages.select(
        F.col(thread).alias("thread"), F.col(node).alias("node"), F.col(parent).alias("at"), w.alias("depth"),
        F.when(F.col(parent).isNull(), F.col(node)).alias("root"), F.when(F.col(parent).isNull(), "rooted").alias("status"),
    )
    table = stage(start)
    most = table.groupBy("thread").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1)) + 1):
        if table.where("status is null").isEmpty():
            break
        above = table.select("thread", F.col("node").alias("at"), F.col("at").alias("up_at"), F.col("depth").alias("up_depth"), F.col("root").alias("up_root"), F.col("status").alias("up_status"), F.lit(True).alias("there"))
        open_, closed = table.where("status is null"), table.where("status is not null")
        moved = open_.join(above, ["thread", "at"], "left").select(
            "thread", "node",
            F.when(F.col("there"), F.col("up_at")).otherwise(F.col("at")).alias("at"),
            (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"),
            F.when(F.col("there"), F.col("up_root")).otherwise(F.col("at")).alias("root"),
            F.when(F.col("there"), F.col("up_status")).otherwise(F.lit("orphan")).alias("status"),
        )
        old, table = table, stage(moved.unionByName(closed.select(moved.columns)))
        drop_stage(old)
    return table.select("thread", "node", F.when(F.col("status").isNotNull(), F.col("root")).alias("root"), "depth", F.coalesce("status", F.lit("cycle")).alias("status"))


def message_rows(utterances: DataFrame) -> DataFrame:
    """Utterance rows with transcript key, speaker code and label, whether anything is said, and a hash of the words.

    Rows without transcript are left out; other columns are ignored.
    """
    u = utterances.select("row_id", "utterance_id", "speaker_code", "transcript_raw", speech.transcript_key(F.col("transcript_file")).alias("key"))
    u = speech.with_said(spread(u))
    u = u.withColumn("words", speech.words_hash(F.col("said_text")))
    return speech.only(u, F.col("key").isNotNull(), "transcript_raw")


def _messages(rows: DataFrame, caregivers: list[str]) -> DataFrame:
    """A row per transcript and place: the least and greatest hash of speaker and words, and whether anything, the child or a caregiver is heard."""
    rows = speech.with_speaker(rows).withColumn("speaker", F.coalesce("speaker", F.lit("")))
    said_by = lambda codes: F.coalesce(F.max(F.when(F.col("speaker").isin(codes), F.col("said"))), F.lit(False))
    return rows.groupBy("key", "utterance_id").agg(
        F.min(F.xxhash64("speaker", "words")).alias("least"), F.max(F.xxhash64("speaker", "words")).alias("most"),
        F.max("said").alias("said"), said_by(["CHI"]).alias("child"), said_by(caregivers).alias("care"),
    )


def transcript_faults(utterances: DataFrame, transcripts: DataFrame, participants: DataFrame, speaker_roles: DataFrame, hot_rows: int = speech.HOT_ROWS, rows: DataFrame | None = None) -> DataFrame:
    """A row per transcript of transcripts: transcript_file, fault (null where it is whole), n_messages.

    fault, the first that fits: 'empty' (nothing said by anyone), 'broken' (a row without
    place, two rows of one place that differ in speaker or words, or places that are not
    one chain from 0 of the length n_utterances tells), 'no_reply' (nothing said by CHI or
    by any caregiver). A transcript without rows is 'empty'. Row copies that agree are one
    message; a row whose speaker is told nowhere differs from one whose speaker is told.

    A message's parent is the place before its own. Messages whose parents follow each
    other inside a block of BLOCK places are joined to segments first; follow_parents
    then jumps over segments. Transcripts with more than hot_rows rows are gathered by place,
    not as a whole. rows: message_rows of the utterances, where the caller has them already.
    """
    caregivers = [r[0] for r in speaker_roles.where("is_caregiver").select("speaker_code").distinct().collect()]  # a fixed table of roles
    heads = speech.people(transcripts, participants, "n_utterances")
    hot = speech.hot_transcripts(utterances, hot_rows)
    rows = (message_rows(utterances) if rows is None else rows).drop("row_id", "said_text")
    if hot is None:
        messages = _messages(rows.join(heads.select("key", "names").hint("shuffle_hash"), "key"), caregivers)
    else:
        cold = rows.join(hot, "key", "left_anti").join(heads.select("key", "names").hint("shuffle_hash"), "key")
        large = rows.join(heads.select("key", "names").join(hot, "key", "left_semi"), "key").repartition("key", "utterance_id")
        messages = _messages(cold, caregivers).unionByName(_messages(large, caregivers))
    # runs of places inside a block: place minus rank is the same along a run
    placed = Window.partitionBy("key", "block").orderBy("utterance_id")
    messages = messages.withColumn("block", F.floor(F.col("utterance_id") / BLOCK)).withColumn("run", F.col("utterance_id") - F.row_number().over(placed))
    unplaced = F.col("utterance_id").isNull()
    segments = messages.groupBy("key", "block", "run").agg(
        F.min("utterance_id").alias("head"), F.max("utterance_id").alias("tail"), F.count("utterance_id").alias("n"),
        F.max(unplaced | (F.col("least") != F.col("most"))).alias("torn"),
        F.max("said").alias("said"), F.max("child").alias("child"), F.max("care").alias("care"),
    )
    segments = stage(segments.drop("block", "run"))
    chains = follow_parents(
        segments.where("tail is not null").select("key", "tail", F.when(F.col("head") != 0, F.col("head") - 1).alias("parent"), "n"),
        "key", "tail", "parent", "n",
    )
    paths = chains.groupBy("thread").agg(F.max(F.col("status") != "rooted").alias("torn_off"), F.max("depth").alias("longest"))
    whole = segments.groupBy("key").agg(F.sum("n").alias("n_messages"), F.max("torn").alias("torn"), *[F.max(c).alias(c) for c in ("said", "child", "care")])
    told = heads.select("key", "transcript_file", "n_utterances").join(whole, "key", "left").join(paths.withColumnRenamed("thread", "key"), "key", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    one_chain = ~yes("torn_off") & F.coalesce(F.col("longest") == F.col("n_messages"), F.lit(False))
    fault = (
        F.when(~yes("said"), "empty")
        .when(yes("torn") | ~one_chain | (F.col("n_messages") != F.coalesce("n_utterances", "n_messages")), "broken")
        .when(~yes("child") | ~yes("care"), "no_reply")
    )
    return told.select("transcript_file", fault.alias("fault"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def faults_found(utterances: DataFrame, transcripts: DataFrame, participants: DataFrame, speaker_roles: DataFrame) -> DataFrame:
    """transcript_file, fault of the transcripts to be dropped."""
    return transcript_faults(utterances, transcripts, participants, speaker_roles).where("fault is not null").select("transcript_file", "fault")


def conversations(utterances: DataFrame, transcripts: DataFrame, participants: DataFrame, speaker_roles: DataFrame) -> DataFrame:
    """The messages of whole transcripts in order: transcript_file, position, speaker_code, participant_role, is_caregiver, text.

    One row per place; of copies of a row the one of least row_id. Roles are null where the speaker is not told.
    """
    cleaned = stage(message_rows(utterances))  # lines are cleaned once
    whole = transcript_faults(utterances, transcripts, participants, speaker_roles, rows=cleaned).where("fault is null").select(speech.transcript_key(F.col("transcript_file")).alias("key"))
    rows = cleaned.where("utterance_id is not null").join(whole, "key", "left_semi")
    rows = rows.groupBy("key", "utterance_id").agg(F.min(F.struct("row_id", "speaker_code", "label", "said_text")).alias("r")).select("key", "utterance_id", "r.*")
    rows = rows.join(speech.people(transcripts, participants).hint("shuffle_hash"), "key")
    rows = speech.with_speaker(rows).withColumnRenamed("speaker", "speaker_code")
    roles = speaker_roles.dropDuplicates(["speaker_code"]).select("speaker_code", "participant_role", "is_caregiver")
    return rows.join(F.broadcast(roles), "speaker_code", "left").select(
        "transcript_file", F.col("utterance_id").alias("position"), "speaker_code", "participant_role", "is_caregiver", F.col("said_text").alias("text"))
