"""Operators on ordered turns: neighbours, context windows, and turn / response / follow-up triples.

All of them use one shuffle by transcript. Rows need row_id, transcript_file and
speaker_code; the order is that of row_id. A null transcript is a transcript of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.chat import CAREGIVERS
from ..sources.tables import stage

NO_FUNCTION = "YY"
TURN_COLUMNS = ["transcript_clean", "transcript_raw", "start_time", "end_time", "is_speech_related", "is_intelligible", "speech_act", "is_grammatical"]


def in_order(*key: str) -> Window:
    return Window.partitionBy(*(key or ("transcript_file",))).orderBy("row_id")


def with_next_turn(df: DataFrame) -> DataFrame:
    """Adds next_speaker_code and next_start_time, null on a transcript's last row."""
    w = in_order()
    return df.withColumns({"next_speaker_code": F.lead("speaker_code").over(w), "next_start_time": F.lead("start_time").over(w)})


def micro_conversations(df: DataFrame, timing: bool = False, drop_non_speech: bool = False, pause_ms: int = 1000, most_overlap_ms: int = 10_000, most_wait_ms: int = 60_000, caregivers: list[str] | None = None, block_ids: int | None = None) -> DataFrame:
    """Triples of a child's turn, the response and the child's follow-up, one row per child turn that has one.

    Answered: the next row is a caregiver's and its row_id is one higher (rows taken out
    before break that); the follow-up is the child's first later turn. Unanswered: the
    next row is the child's, with `timing` at least pause_ms after the turn's end, and the
    first later row that is not the child's, if any, is a caregiver's; the response is
    empty (times infinite, flags false) and the follow-up is the next row. Turns without
    follow-up give no row.

    drop_non_speech: rows known not to be speech (is_speech_related false; null stays)
    are taken out first. With timing, rows are kept where the response starts later than
    most_overlap_ms before the turn's end and the follow-up comes within most_wait_ms of
    it; null times drop a row. The first later row of a kind is looked up by the last row
    of that kind in the opposite order, as a frame that ends at the partition's end is
    worked out anew for every row.

    block_ids: for tables in which one transcript may hold a large part of all rows; tasks
    then get the rows of a transcript in blocks of so many row_ids, and what follows after
    a block is looked up among the first rows of the later ones. The result is the same.

    Result: index, the other columns of the turn, utt_*, response_* and follow_up_* of
    TURN_COLUMNS that df has, answered, response_latency, response_latency_follow_up.
    """
    caregivers = caregivers or CAREGIVERS
    if drop_non_speech:
        df = df.where(~F.col("is_speech_related").eqNullSafe(False))
    cols, kept = [c for c in TURN_COLUMNS if c in df.columns], list(df.columns)
    turn = F.struct("row_id", *cols)
    child = F.coalesce(F.col("speaker_code") == "CHI", F.lit(False))
    other = ~(F.col("speaker_code") == "CHI")
    key = ["transcript_file"]
    if block_ids:
        df, key = _with_later_blocks(df.withColumn("_block", F.floor(F.col("row_id") / block_ids)), turn, child, other), ["transcript_file", "_block"]
    w, back = in_order(*key), Window.partitionBy(*key).orderBy(F.col("row_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = {
        "_next": F.lead(turn).over(w), "_next_speaker": F.lead("speaker_code").over(w),
        "_later_child": F.last(F.when(child, turn), True).over(back), "_later_other": F.last(F.when(other, F.col("speaker_code")), True).over(back),
    }
    if block_ids:
        near["_next_speaker"] = F.when(near["_next"].isNull(), F.col("_after.speaker")).otherwise(near["_next_speaker"])
        near |= {"_next": F.coalesce(near["_next"], F.col("_after.turn")), "_later_child": F.coalesce(near["_later_child"], "_after_child"), "_later_other": F.coalesce(near["_later_other"], "_after_other")}
    d = df.withColumns(near).where(child & F.col("_later_child").isNotNull())
    if block_ids:
        d = d.drop("_block", "_after", "_after_child", "_after_other")
    answered = F.col("_next_speaker").isin(caregivers) & (F.col("_next.row_id") == F.col("row_id") + 1)
    unanswered = (F.col("_next_speaker") == "CHI") & (F.col("_later_other").isNull() | F.col("_later_other").isin(caregivers))
    if timing:
        unanswered = unanswered & (F.col("_next.start_time") - F.col("end_time") >= pause_ms)
    d = d.withColumn("answered", F.when(answered, True).when(unanswered, False)).where("answered is not null")
    infinite = F.lit(float("inf"))
    silence = {"transcript_clean": F.lit(""), "transcript_raw": F.lit(""), "start_time": infinite, "end_time": infinite, "is_speech_related": F.lit(False), "is_intelligible": F.lit(False), "speech_act": F.lit(NO_FUNCTION), "is_grammatical": F.lit(False)}
    timed = ("start_time", "end_time")
    as_double = lambda name, c: c.cast("double") if name in timed else c
    out = [as_double(c, F.col(c)).alias(f"utt_{c}") for c in cols]
    out += [F.when(F.col("answered"), as_double(c, F.col(f"_next.{c}"))).otherwise(silence[c]).alias(f"response_{c}") for c in cols]
    out += [as_double(c, F.when(F.col("answered"), F.col(f"_later_child.{c}")).otherwise(F.col(f"_next.{c}"))).alias(f"follow_up_{c}") for c in cols]
    rest = [c for c in kept if c not in cols and c != "row_id"]
    d = d.select(F.col("row_id").alias("index"), *rest, "answered", *out)
    if "start_time" in cols and "end_time" in cols:
        d = d.withColumns({"response_latency": F.col("response_start_time") - F.col("utt_end_time"), "response_latency_follow_up": F.col("follow_up_start_time") - F.col("utt_end_time")})
        if timing:
            d = d.where((F.col("response_latency") > -most_overlap_ms) & (F.col("response_latency_follow_up") <= most_wait_ms))
    return d


def _with_later_blocks(df: DataFrame, turn, child, other) -> DataFrame:
    """df with what follows each row's block: _after (turn and speaker of the next block's first row), _after_child, _after_other (of the nearest later block that has one)."""
    first = lambda c, of: F.min_by(c, F.when(of, F.col("row_id")))
    ends = df.groupBy(F.col("transcript_file").alias("_file"), F.col("_block").alias("_of")).agg(
        first(F.struct(turn.alias("turn"), F.col("speaker_code").alias("speaker")), F.lit(True)).alias("start"), first(F.when(child, turn), child).alias("kid"), first(F.when(other, F.col("speaker_code")), other).alias("else"))
    later = Window.partitionBy("_file").orderBy(F.col("_of").desc())  # a row per block
    upto = later.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_file", "_of", F.lag("start").over(later).alias("_after"), F.last("kid", True).over(upto).alias("_after_child"), F.last("else", True).over(upto).alias("_after_other"))
    return df.join(ends, F.col("transcript_file").eqNullSafe(F.col("_file")) & (F.col("_block") == F.col("_of"))).drop("_file", "_of")


def _with_neighbours(df: DataFrame, n: int, side: str, text: str, flag: str, keep_unknown: bool) -> DataFrame:
    use = F.col(flag) if flag in df.columns else F.lit(True)
    use = F.coalesce(use, F.lit(keep_unknown))
    w = Window.partitionBy("transcript_file", "_use").orderBy("row_id")
    w = w.rowsBetween(-n, -1) if side == "prev" else w.rowsBetween(1, n)
    end = f"_{n}" if n > 1 else ""
    def near(c: str):
        got = F.collect_list(F.coalesce(F.col(c), F.lit(""))).over(w)
        return F.when(F.col("_use") & (F.size(got) > 0), F.array_join(got, " "))
    return df.withColumn("_use", use).withColumns({f"{side}_{text}{end}": near(text), f"{side}_speaker_code{end}": near("speaker_code")}).drop("_use")


def with_previous(df: DataFrame, n: int = 1, text: str = "transcript_clean", flag: str = "is_speech_related", keep_unknown: bool = True) -> DataFrame:
    """Adds the texts and speakers of the last n speech-related rows before each row, joined by blanks.

    Null on rows that are not speech-related and where there is no such row. keep_unknown:
    whether a null flag counts as speech. Column names end in _n if n > 1.
    """
    return _with_neighbours(df, n, "prev", text, flag, keep_unknown)


def with_following(df: DataFrame, n: int = 1, text: str = "transcript_clean", flag: str = "is_speech_related", keep_unknown: bool = True) -> DataFrame:
    """The same of the first n speech-related rows after each row."""
    return _with_neighbours(df, n, "following", text, flag, keep_unknown)


def cut_at_nth_child(df: DataFrame, n: int) -> DataFrame:
    """Each transcript up to its n-th child row, that row included."""
    children = F.sum((F.col("speaker_code") == "CHI").cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", F.coalesce(children, F.lit(0))).where(F.col("_before") < n).drop("_before")


def with_dense_id(df: DataFrame, file: str = "transcript_file", place: str = "utterance_id", start: int = 0) -> DataFrame:
    """Adds row_id from `start` without gaps, by file and place.

    Rows are parted by ranges of file and place and written to shared storage; the ranges'
    row counts (a number per range reach the driver) give where each begins, so that no
    task sees more than a range, however large a file is. Null files come first.
    """
    ranged = stage(df.repartitionByRange(file, place).withColumn("_range", F.spark_partition_id()))
    begins, at = [], start
    for r in sorted(ranged.groupBy("_range").count().collect()):
        begins += [F.lit(r["_range"]), F.lit(at)]
        at += r["count"]
    if not begins:
        return ranged.drop("_range").withColumn("row_id", F.lit(None).cast("long"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(file).asc_nulls_first(), F.col(place).asc_nulls_first())) - 1
    return ranged.withColumn("row_id", (F.create_map(*begins)[F.col("_range")] + rank).cast("long")).drop("_range")
