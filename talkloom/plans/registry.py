"""The named queries of the core, and their SQL.

Sequence queries read the utterances as loaded: a turn's text is its raw line,
is_speech_related follows from the speech act (YY: no, none: unknown), and
is_intelligible from the code xxx.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import chat, responses as R, words as T
from ..operators import analytics as A, cells, sampling as S, sequence as W, stats
from ..operators.ml import model_input, ngram_forest, with_ngram_inputs
from ..sources.tables import table
from . import composites as Q

LABEL_TABLES = ("annotated_transcripts", "grammaticality_sheet", "label_classes")
CARE = ", ".join(f"'{c}'" for c in chat.CAREGIVERS)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name, with its SQL if there is one."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances").where(F.col("transcript_file").isNotNull()).select(
        "row_id", "transcript_file", "utterance_id", "speaker_code", F.coalesce("transcript_raw", F.lit("")).alias("transcript_clean"), "start_time", "end_time", "age", "corpus", "child_name", "speech_act",
        F.when(F.col("speech_act") == "YY", False).when(F.col("speech_act").isNotNull(), True).alias("is_speech_related"), (~F.coalesce(F.col("transcript_raw"), F.lit("xxx")).contains("xxx")).alias("is_intelligible"))


TURNS = """turns AS (SELECT row_id, transcript_file, utterance_id, speaker_code, coalesce(transcript_raw, '') AS transcript_clean, start_time, end_time, age, corpus, child_name, speech_act,
  CASE WHEN speech_act = 'YY' THEN false WHEN speech_act IS NOT NULL THEN true END AS is_speech_related,
  NOT contains(coalesce(transcript_raw, 'xxx'), 'xxx') AS is_intelligible
  FROM utterances WHERE transcript_file IS NOT NULL)"""


def _triples_sql(source: str, timing: bool) -> str:
    gap = "AND n_start - end_time >= 1000" if timing else ""
    keep = "WHERE response_latency > -10000 AND response_latency_follow_up <= 60000" if timing else ""
    return f""", seen AS (SELECT *, lead(speaker_code) OVER w AS n_speaker, lead(row_id) OVER w AS n_id, lead(start_time) OVER w AS n_start, lead(end_time) OVER w AS n_end,
    lead(transcript_clean) OVER w AS n_text, lead(is_intelligible) OVER w AS n_ok, lead(is_speech_related) OVER w AS n_sr FROM {source} WINDOW w AS (PARTITION BY transcript_file ORDER BY row_id)),
  kids AS (SELECT transcript_file AS k_file, row_id AS k_id, start_time AS k_start, transcript_clean AS k_text, is_intelligible AS k_ok, lag(row_id) OVER (PARTITION BY transcript_file ORDER BY row_id) AS k_before FROM {source} WHERE speaker_code = 'CHI'),
  others AS (SELECT transcript_file AS o_file, row_id AS o_id, speaker_code AS o_speaker FROM {source} WHERE speaker_code <> 'CHI'),
  pairs AS (SELECT s.*, k.k_start, k.k_text, k.k_ok, o.o_speaker FROM seen s JOIN kids k ON k.k_file = s.transcript_file AND k.k_before = s.row_id
    ASOF LEFT JOIN others o ON o.o_file = s.transcript_file AND o.o_id > s.row_id WHERE s.speaker_code = 'CHI'),
  told AS (SELECT *, CASE WHEN n_speaker IN ({CARE}) AND n_id = row_id + 1 THEN true
      WHEN n_speaker = 'CHI' AND (o_speaker IS NULL OR o_speaker IN ({CARE})) {gap} THEN false END AS answered FROM pairs),
  triples AS (SELECT * FROM (SELECT row_id AS "index", corpus, age, transcript_file, child_name, is_intelligible AS utt_ok, transcript_clean AS utt_text, answered,
      CASE WHEN answered THEN n_text ELSE '' END AS response_text, CASE WHEN answered THEN n_ok ELSE false END AS response_ok, CASE WHEN answered THEN n_sr ELSE false END AS response_sr,
      CASE WHEN answered THEN k_text ELSE n_text END AS follow_up_text, CASE WHEN answered THEN k_ok ELSE n_ok END AS follow_up_ok,
      CASE WHEN answered THEN CAST(n_start AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END - end_time AS response_latency,
      CAST(CASE WHEN answered THEN k_start ELSE n_start END AS DOUBLE) - end_time AS response_latency_follow_up FROM told WHERE answered IS NOT NULL) {keep})"""


def triples(spark: SparkSession, d: str, timing: bool = False, drop: bool = False) -> DataFrame:
    return W.micro_conversations(turns(spark, d), timing, drop)


def _texts(t: DataFrame) -> DataFrame:
    return t.withColumnsRenamed({"response_transcript_clean": "response_text", "follow_up_transcript_clean": "follow_up_text"})


@query(f"WITH {TURNS} SELECT row_id, lead(speaker_code) OVER w AS next_speaker_code, lead(start_time) OVER w AS next_start_time FROM turns WINDOW w AS (PARTITION BY transcript_file ORDER BY row_id)")
def next_turn(spark, d):
    return W.with_next_turn(turns(spark, d)).select("row_id", "next_speaker_code", "next_start_time")


@query(f'WITH {TURNS} {_triples_sql("turns", False)} SELECT "index", answered, response_text, follow_up_text FROM triples')
def micro_conversations(spark, d):
    return _texts(triples(spark, d)).select("index", "answered", "response_text", "follow_up_text")


@query(f'WITH {TURNS}, heard AS (SELECT * FROM turns WHERE is_speech_related IS DISTINCT FROM false) {_triples_sql("heard", True)} SELECT "index", answered, response_text, follow_up_text, response_latency_follow_up FROM triples')
def micro_conversations_timed(spark, d):
    return _texts(triples(spark, d, True, True)).select("index", "answered", "response_text", "follow_up_text", "response_latency_follow_up")


@query(f"""WITH {TURNS} {_triples_sql("turns", False)}, binned AS (SELECT CAST(least(60, greatest(10, floor((age + 3) / 6) * 6)) AS INTEGER) AS age_bin, answered FROM triples WHERE age BETWEEN 10 AND 60)
SELECT age_bin, grouping(age_bin) = 1 AS is_total, count(*) AS n, count(*) FILTER (WHERE answered) AS n_true, round(count(*) FILTER (WHERE answered) * 1.0 / count(*), 9) AS proportion FROM binned GROUP BY GROUPING SETS ((age_bin), ())""")
def answered_share_by_group(spark, d):
    t = A.age_between(triples(spark, d), 10, 60).withColumn("age_bin", T.age_bin(F.col("age"), 10, 60, 6))
    return A.proportions(t, ["age_bin"], "answered", total=True, drop="age_bin").select("age_bin", "is_total", "n", "n_true", F.round("proportion", 9).alias("proportion"))


@query(f"""WITH {TURNS} {_triples_sql("turns", False)}, by_corpus AS (SELECT corpus, count(*) AS n, count(*) FILTER (WHERE answered) AS n_true FROM triples GROUP BY corpus), p AS (SELECT *, n_true * 1.0 / n AS p FROM by_corpus)
SELECT corpus, n, n_true, round(p, 6) AS proportion, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS low,
  round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM p""")
def proportion_by_corpus(spark, d):
    p = A.proportions(triples(spark, d), ["corpus"], "answered")
    return p.select("corpus", "n", "n_true", *[F.round(c, 6).alias(c) for c in ("proportion", "low", "high")])


def _context_sql(frame: str, side: str) -> str:
    return f"""WITH {TURNS}, used AS (SELECT *, coalesce(is_speech_related, true) AS use FROM turns)
SELECT row_id, CASE WHEN use THEN string_agg(transcript_clean, ' ' ORDER BY row_id) OVER w END AS {side}_transcript_clean_3, CASE WHEN use THEN string_agg(coalesce(speaker_code, ''), ' ' ORDER BY row_id) OVER w END AS {side}_speaker_code_3
FROM used WINDOW w AS (PARTITION BY transcript_file, use ORDER BY row_id ROWS BETWEEN {frame})""".replace(" ORDER BY row_id) OVER", ") OVER")


@query(_context_sql("3 PRECEDING AND 1 PRECEDING", "prev"))
def previous_context(spark, d):
    return W.with_previous(turns(spark, d), 3).select("row_id", "prev_transcript_clean_3", "prev_speaker_code_3")


@query(_context_sql("1 FOLLOWING AND 3 FOLLOWING", "following"))
def following_context(spark, d):
    return W.with_following(turns(spark, d), 3).select("row_id", "following_transcript_clean_3", "following_speaker_code_3")


@query(f"WITH {TURNS}, c AS (SELECT row_id, transcript_file, coalesce(sum(CASE WHEN speaker_code = 'CHI' THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_file ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM turns) SELECT row_id, transcript_file FROM c WHERE b < 5")
def cut_at_nth_child(spark, d):
    return W.cut_at_nth_child(turns(spark, d), 5).select("row_id", "transcript_file")


@query(f"WITH {TURNS} SELECT row_id FROM turns WHERE transcript_file IN (SELECT transcript_file FROM turns WHERE speaker_code = 'CHI' GROUP BY 1 HAVING count(*) > 15)")
def transcripts_min_child(spark, d):
    return A.more_than_child_rows(turns(spark, d), 15).select("row_id")


@query("SELECT CAST(row_number() OVER (ORDER BY transcript_file, utterance_id, row_id) - 1 AS BIGINT) AS dense_id, row_id FROM utterances WHERE transcript_file IS NOT NULL AND utterance_id IS NOT NULL")
def dense_ids(spark, d):
    u = table(spark, d, "utterances").where("transcript_file is not null and utterance_id is not null").select("transcript_file", F.struct("utterance_id", "row_id").alias("place"), F.col("row_id").alias("loaded"))
    return W.with_dense_id(u, place="place").select(F.col("row_id").alias("dense_id"), F.col("loaded").alias("row_id"))


@query(f"WITH {TURNS} SELECT row_id, speech_act FROM turns WHERE is_speech_related IS DISTINCT FROM false")
def null_safe_not_false(spark, d):
    return A.not_known_false(turns(spark, d), "is_speech_related").select("row_id", "speech_act")


@query("SELECT CAST(least(48, greatest(10, floor((age + 3) / 6) * 6)) AS INTEGER) AS age_bin, count(*) AS n FROM utterances GROUP BY 1")
def age_bin_counts(spark, d):
    return table(spark, d, "utterances").groupBy(F.when(F.col("age").isNull(), 10).otherwise(T.age_bin(F.col("age"), 10, 48, 6)).alias("age_bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, corpus, age FROM utterances WHERE age BETWEEN 12 AND 30 AND corpus IN ('Harnel', 'Orrin-Lask', 'Varnham') AND NOT (corpus IN ('Varnham')) AND (child_name IS NULL OR child_name <> 'Harnel_Odavine')")
def filtered_rows(spark, d):
    u = A.filter_corpora(A.age_between(table(spark, d, "utterances"), 12, 30), ["Harnel", "Orrin-Lask", "Varnham"], ["Varnham"])
    return A.exclude_values(u, "child_name", ["Harnel_Odavine"]).select("row_id", "corpus", "age")


@query(f"WITH {TURNS} SELECT row_id FROM turns WHERE corpus IN (SELECT corpus FROM turns WHERE is_speech_related IS NOT NULL GROUP BY corpus HAVING avg(CASE WHEN is_speech_related THEN 0.0 ELSE 1.0 END) > 0.1)")
def corpora_by_nonspeech(spark, d):
    t = turns(spark, d)
    share = F.avg((~F.col("is_speech_related")).cast("double"))
    return A.groups_having(t, "corpus", share, lambda a: a > 0.1).select("row_id")


@query("SELECT (SELECT count(DISTINCT corpus) FROM utterances) AS n_corpora, (SELECT count(DISTINCT child_name) FROM utterances) AS n_children, (SELECT count(DISTINCT transcript_file) FROM utterances) AS n_transcripts, count(*) AS n, min(age) AS min_age, max(age) AS max_age, round(avg(age), 6) AS mean_age FROM utterances")
def corpus_overview(spark, d):
    return table(spark, d, "utterances").agg(
        F.count_distinct("corpus").alias("n_corpora"), F.count_distinct("child_name").alias("n_children"), F.count_distinct("transcript_file").alias("n_transcripts"), F.count(F.lit(1)).alias("n"),
        F.min("age").alias("min_age"), F.max("age").alias("max_age"), F.round(F.avg("age"), 6).alias("mean_age"))


@query("SELECT t.transcript_file FROM transcripts t WHERE NOT EXISTS (SELECT 1 FROM utterances u WHERE u.transcript_file = t.transcript_file)")
def transcripts_without_rows(spark, d):
    return table(spark, d, "transcripts").join(table(spark, d, "utterances"), "transcript_file", "left_anti").select("transcript_file")


@query(f"""WITH {TURNS} {_triples_sql("turns", False)}, g AS (SELECT transcript_file, avg(CASE WHEN utt_ok THEN CAST(answered AS INTEGER) END) - avg(CASE WHEN NOT utt_ok THEN CAST(answered AS INTEGER) END) AS c FROM triples GROUP BY 1)
SELECT count(c) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(stddev_samp(c) / sqrt(count(c)), 6) AS sem FROM g""")
def contingency_of_response(spark, d):
    s = A.contingency_summary(triples(spark, d), "transcript_file", "utt_is_intelligible", "answered")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "sem")])


@query(f"""WITH {TURNS} {_triples_sql("turns", False)} SELECT "index" AS conversation_id, corpus, age, false AS is_follow_up, utt_ok AS is_intelligible FROM triples UNION ALL SELECT "index", corpus, age, true, follow_up_ok FROM triples""")
def melted_pairs(spark, d):
    return A.melt_follow_up(triples(spark, d), "is_intelligible", ["corpus", "age"]).select("conversation_id", "corpus", "age", "is_follow_up", "is_intelligible")


@query(f"""WITH {TURNS} SELECT transcript_file, round(avg(CAST(is_speech_related AS INTEGER)), 6) AS is_speech_related, round(avg(CAST(CASE WHEN is_speech_related = false THEN false ELSE is_intelligible END AS INTEGER)), 6) AS is_intelligible,
  min(age) AS min_age, round(avg(age), 6) AS mean_age FROM turns WHERE age BETWEEN 10 AND 60 AND speaker_code = 'CHI' GROUP BY transcript_file HAVING count(*) > 10""")
def development_curve(spark, d):
    p = Q.development(turns(spark, d), ["is_speech_related", "is_intelligible"], min_child_rows=10)
    return p.select("transcript_file", *[F.round(c, 6).alias(c) for c in ("is_speech_related", "is_intelligible")], "min_age", F.round("mean_age", 6).alias("mean_age"))


LABEL_ROWS = "labels_long AS (SELECT row_id, source, is_grammatical, unnest(string_split(coalesce(labels, 'nan'), ', ')) AS labels FROM grammaticality_sheet)"


@query(f"WITH {LABEL_ROWS}, g AS (SELECT labels, count(*) AS n FROM labels_long GROUP BY 1) SELECT labels, n, round(n * 1.0 / sum(n) OVER (), 9) AS share FROM g")
def label_shares(spark, d):
    return A.value_shares(A.explode_labels(table(spark, d, "grammaticality_sheet")), "labels").select("labels", "n", F.round("share", 9).alias("share"))


@query(f"""WITH {LABEL_ROWS}, g AS (SELECT labels, count(*) AS all_rows, count(*) FILTER (WHERE is_grammatical = -1) AS wrong_rows FROM labels_long GROUP BY 1),
l AS (SELECT labels, 'all_rows' AS condition, all_rows AS n FROM g UNION ALL SELECT labels, 'wrong_rows', wrong_rows FROM g) SELECT labels, condition, n, round(n * 1.0 / sum(n) OVER (PARTITION BY condition), 9) AS share FROM l""")
def share_baseline_vs_subset(spark, d):
    x = A.explode_labels(table(spark, d, "grammaticality_sheet"))
    s = A.share_by_condition(x, "labels", {"all_rows": F.lit(True), "wrong_rows": F.coalesce(F.col("is_grammatical") == -1, F.lit(False))})
    return s.select("labels", "condition", "n", F.round("share", 9).alias("share"))


@query(f"WITH {LABEL_ROWS}, g AS (SELECT labels, count(*) AS n FROM labels_long GROUP BY 1) SELECT class_no AS place, c.label AS labels, n FROM label_classes c LEFT JOIN g ON g.labels = c.label")
def labels_in_fixed_order(spark, d):
    x = A.explode_labels(table(spark, d, "grammaticality_sheet")).groupBy("labels").agg(F.count(F.lit(1)).alias("n"))
    order = [r[0] for r in table(spark, d, "label_classes").orderBy("class_no").select("label").collect()]  # a fixed table
    return A.in_fixed_order(x, "labels", order).select("place", "labels", "n")


@query(f"WITH {LABEL_ROWS}, g AS (SELECT source, labels, count(*) AS n FROM labels_long GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY source) AS a FROM g) SELECT source, labels, n, round(n * 1.0 / a, 9) AS share FROM s WHERE a > 100")
def label_shares_by_source(spark, d):
    x = A.explode_labels(table(spark, d, "grammaticality_sheet"))
    return A.corpus_label_shares(x, "source", "labels", 100).select("source", "labels", "n", F.round("share", 9).alias("share"))


@query("SELECT source, count(*) AS n_utterances, count(*) FILTER (WHERE is_grammatical = -1) AS n_errors, round(count(*) FILTER (WHERE is_grammatical = -1) * 1.0 / count(*), 9) AS ratio FROM grammaticality_sheet GROUP BY source")
def error_ratio_per_source(spark, d):
    s = table(spark, d, "grammaticality_sheet").withColumn("age", F.lit(0))
    return A.error_ratios(s, "source", F.coalesce(F.col("is_grammatical") == -1, F.lit(False))).select("source", "n_utterances", "n_errors", F.round("ratio", 9).alias("ratio"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100")
def top_words(spark, d):
    return A.top_words(table(spark, d, "documents"), "text", 100)


@query("SELECT speech_act, count(*) AS n FROM utterances GROUP BY speech_act ORDER BY n DESC, speech_act NULLS FIRST LIMIT 20")
def top_speech_acts(spark, d):
    return A.top_values(table(spark, d, "utterances"), "speech_act", 20)


_WORDS = "list_filter(regexp_split_to_array({c}, '[ \\t\\n\\x0B\\f\\r\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]{more}'), lambda x: x <> '')"


def _words_sql(c: str, more: str = "|''|,") -> str:
    return _WORDS.format(c=c, more=more)


_CUT = "CASE WHEN length({0}) > 0 THEN left({0}, length({0}) - 1) ELSE {0} END"


@query(f"SELECT row_id, len({_words_sql(_CUT.format('transcript_clean'))}) AS n_words, len(list_distinct({_words_sql(_CUT.format('transcript_clean'), '|,')})) AS n_unique FROM grammaticality_sheet")
def word_counts(spark, d):
    c = F.col("transcript_clean")
    return table(spark, d, "grammaticality_sheet").select("row_id", T.num_words(c).cast("long").alias("n_words"), T.num_unique_words(c).cast("long").alias("n_unique"))


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(R.STOP_WORDS)) + "]"


@query(f"""WITH s AS (SELECT row_id, prev_transcript_clean AS u, transcript_clean AS r FROM grammaticality_sheet WHERE prev_transcript_clean IS NOT NULL),
w AS (SELECT row_id, r, list_distinct({_words_sql("lower(" + _CUT.format("u") + ")")}) AS u, list_distinct({_words_sql("lower(" + _CUT.format("r") + ")")}) AS rw FROM s),
p AS (SELECT *, list_filter(u, lambda x: NOT list_contains({_STOP}, x)) AS up, list_filter(rw, lambda x: NOT list_contains({_STOP}, x)) AS rp FROM w),
c AS (SELECT row_id, r, CASE WHEN len(up) = 0 OR len(rp) = 0 THEN u ELSE up END AS a, CASE WHEN len(up) = 0 OR len(rp) = 0 THEN rw ELSE rp END AS b FROM p)
SELECT row_id, CASE WHEN r IS NULL OR r = '' OR len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) * 1.0 / len(a), 9) END AS rep_utt, CASE WHEN r IS NULL OR r = '' OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) * 1.0 / len(b), 9) END AS rep_response FROM c""")
def repetition_ratios(spark, d):
    s = table(spark, d, "grammaticality_sheet").where("prev_transcript_clean is not null")
    r = R.with_repetition_ratios(s, "prev_transcript_clean", "transcript_clean")
    return r.select("row_id", F.round("rep_utt", 9).alias("rep_utt"), F.round("rep_response", 9).alias("rep_response"))


def _list(ws: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


@query(f"""WITH w AS (SELECT row_id, prev_transcript_clean AS u, transcript_clean AS r, {_words_sql("lower(" + _CUT.format("transcript_clean") + ")", "|,")} AS ws FROM grammaticality_sheet),
q AS (SELECT *, list_filter(ws, lambda x: NOT list_contains({_list(R.ACK_WORDS)}, x)) AS rest FROM w)
SELECT row_id, coalesce(NOT ends_with(u, '?') AND NOT ends_with(r, '?') AND len(ws) > 0 AND (len(rest) = 0 OR list_contains({_list(R.ACK_CERTAIN)}, ws[1]) OR list_contains({_list(R.ACK_PHRASES)}, array_to_string(ws, ' ')) OR list_contains({_list(R.ACK_PHRASES)}, array_to_string(rest, ' '))), false) AS is_ack FROM q""")
def keyword_acknowledgements(spark, d):
    s = table(spark, d, "grammaticality_sheet")
    return R.with_keyword_acknowledgement(s, "prev_transcript_clean", "transcript_clean", "is_ack").select("row_id", "is_ack")


@query(f"""WITH {TURNS}, n AS (SELECT row_id, transcript_clean AS u, lead(speech_act) OVER (PARTITION BY transcript_file ORDER BY row_id) AS act FROM turns),
w AS (SELECT *, list_distinct({_words_sql(_CUT.format("u"))}) AS ws FROM n) SELECT row_id, coalesce(act IN ('EQ', 'RR') AND NOT (len(ws) = 1 AND list_contains({_list(R.CAREGIVER_NAMES)}, lower(ws[1]))), false) AS is_request FROM w""")
def speech_act_requests(spark, d):
    t = turns(spark, d).withColumn("act", F.lead("speech_act").over(W.in_order()))
    return t.select("row_id", R.is_speech_act_request(F.col("act"), F.col("transcript_clean")).alias("is_request"))


@query(r"""SELECT row_id, regexp_extract(transcript_raw, '\[=! [^\]]*\]', 0) AS event, len(regexp_extract_all(transcript_raw, '\[=! [^\]]*\]')) AS n_events,
  regexp_matches(regexp_extract(transcript_raw, '\[=! [^\]]*\]', 0), 'babbl|hum|sung|whisper|mumbl|mutter|voc') OR (contains(regexp_extract(transcript_raw, '\[=! [^\]]*\]', 0), 'sing') AND NOT contains(regexp_extract(transcript_raw, '\[=! [^\]]*\]', 0), 'fussing') AND NOT contains(regexp_extract(transcript_raw, '\[=! [^\]]*\]', 0), 'kissing')) AS like_speech
  FROM utterances WHERE contains(transcript_raw, '[=! ')""")
def paralinguistic_events(spark, d):
    u, c = table(spark, d, "utterances").where(F.col("transcript_raw").contains("[=! ")), F.col("transcript_raw")
    return u.select("row_id", chat.first_event(c).alias("event"), F.size(chat.all_events(c)).cast("long").alias("n_events"), chat.event_is_speech_related(chat.first_event(c)).alias("like_speech"))


@query(r"""SELECT row_id, regexp_replace(regexp_replace(transcript_raw, '\x15[^\x15]+?\x15', '', 'g'), '\[[+\-%*/x?][^\]]*\]|\[:+ [^\]]*\]|\[=\? [^\]]*\]|\[[<>]\d*\]|\[!+\]|\[\^ \S*\]', '', 'g') AS text FROM utterances WHERE transcript_raw IS NOT NULL""")
def stripped_codes(spark, d):
    u = table(spark, d, "utterances").where("transcript_raw is not null")
    return u.select("row_id", F.regexp_replace(chat.without_timing(F.col("transcript_raw")), chat.CODES, "").alias("text"))


_DRAW = "CAST(('0x' || left(md5(CAST({k} AS VARCHAR) || '/{s}'), 12)) AS BIGINT)"


@query(f"SELECT row_id, CASE WHEN {_DRAW.format(k='row_id', s=7)} < 0.8 * 281474976710656 THEN 'train' WHEN {_DRAW.format(k='row_id', s=7)} < 0.9 * 281474976710656 THEN 'validation' ELSE 'test' END AS split FROM grammaticality_sheet")
def hash_split(spark, d):
    s = table(spark, d, "grammaticality_sheet").select("row_id")
    return S.split_by_share(s, {"train": 0.8, "validation": 0.1, "test": 0.1}, seed=7)


@query("WITH r AS (SELECT row_id, is_grammatical, row_number() OVER (PARTITION BY is_grammatical ORDER BY left(md5(CAST(row_id AS VARCHAR) || '/3'), 12), row_id) AS k FROM grammaticality_sheet WHERE is_grammatical IS NOT NULL) SELECT row_id, is_grammatical FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM grammaticality_sheet WHERE is_grammatical IS NOT NULL GROUP BY is_grammatical))")
def balanced_sample(spark, d):
    return S.balanced(table(spark, d, "grammaticality_sheet"), "is_grammatical", seed=3).select("row_id", "is_grammatical")


@query("SELECT row_id, transcript_clean FROM grammaticality_sheet ORDER BY left(md5(CAST(row_id AS VARCHAR) || '/5'), 12), row_id LIMIT 200")
def random_rows(spark, d):
    return S.sample_rows(table(spark, d, "grammaticality_sheet"), 200, seed=5).select("row_id", "transcript_clean")


@query("SELECT round(avg(CASE WHEN is_grammatical = 1 THEN 1.0 ELSE 0.0 END), 9) AS weight_false, round(1 - avg(CASE WHEN is_grammatical = 1 THEN 1.0 ELSE 0.0 END), 9) AS weight_true FROM grammaticality_sheet WHERE is_grammatical IN (1, -1)")
def class_weights(spark, d):
    s = table(spark, d, "grammaticality_sheet").where(F.col("is_grammatical").isin(1, -1)).withColumn("ok", F.col("is_grammatical") == 1)
    return S.class_weights(s, "ok").select(*[F.round(c, 9).alias(c) for c in ("weight_false", "weight_true")])


_RATERS = "r AS (SELECT doc_id, max(CASE WHEN rater = 'r1' THEN flagged END) AS a, max(CASE WHEN rater = 'r2' THEN flagged END) AS b FROM doc_labels GROUP BY 1), k AS (SELECT * FROM r WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(f"""WITH {_RATERS}, c AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE a = 1 AND b = 1) AS tp, count(*) FILTER (WHERE a = 0 AND b = 0) AS tn, count(*) FILTER (WHERE a = 1 AND b = 0) AS fn, count(*) FILTER (WHERE a = 0 AND b = 1) AS fp FROM k),
e AS (SELECT *, ((tp + fn) * 1.0 * (tp + fp) + (tn + fp) * 1.0 * (tn + fn)) / (n * n) AS pe, (tp + tn) / n AS po FROM c)
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, round((tp * 1.0 * tn - fp * 1.0 * fn) / (sqrt((tp + fp) * 1.0 * (tp + fn)) * sqrt((tn + fp) * 1.0 * (tn + fn))), 6) AS mcc FROM e""")
def rater_agreement(spark, d):
    r = Q.rater_agreement(table(spark, d, "doc_labels"), "doc_id", "rater", "flagged", "r1", "r2")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "mcc")])


@query(f"""WITH {_RATERS} SELECT count(*) AS n, round(count(*) FILTER (WHERE a = 1 AND b = 1) * 1.0 / count(*) FILTER (WHERE b = 1), 6) AS precision, round(count(*) FILTER (WHERE a = 1 AND b = 1) * 1.0 / count(*) FILTER (WHERE a = 1), 6) AS recall,
round(2.0 * count(*) FILTER (WHERE a = 1 AND b = 1) / (count(*) FILTER (WHERE a = 1) + count(*) FILTER (WHERE b = 1)), 6) AS f1 FROM k""")
def precision_recall(spark, d):
    l = table(spark, d, "doc_labels").groupBy("doc_id").agg(F.max(F.when(F.col("rater") == "r1", F.col("flagged"))).alias("a"), F.max(F.when(F.col("rater") == "r2", F.col("flagged"))).alias("b"))
    return stats.precision_recall(l, "a", "b").select("n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH v AS (SELECT doc_id, flagged, count(*) AS c FROM doc_labels WHERE flagged IS NOT NULL GROUP BY 1, 2), m AS (SELECT doc_id, sum(c) AS m FROM v GROUP BY 1 HAVING sum(c) > 1), p AS (SELECT v.*, m FROM v JOIN m USING (doc_id)),
o AS (SELECT sum(c * (c - 1) * 1.0 / (m - 1)) AS o, CAST(sum(c) AS DOUBLE) AS n FROM p), e AS (SELECT sum(nv * (nv - 1) * 1.0) AS e FROM (SELECT flagged, CAST(sum(c) AS DOUBLE) AS nv FROM p GROUP BY 1))
SELECT CAST(n AS BIGINT) AS n_values, round(1 - (1 - o / n) / (1 - e / (n * (n - 1))), 6) AS alpha FROM o, e""")
def krippendorff_alpha(spark, d):
    return stats.krippendorff_alpha(table(spark, d, "doc_labels"), "doc_id", "flagged").select("n_values", F.round("alpha", 6).alias("alpha"))


@query(f"""WITH {_RATERS}, t AS (SELECT k.doc_id, a = 1 AS truth, b = 1 AS other, a = 1 AS same FROM k), l AS (SELECT truth, 'other' AS model, other AS p FROM t UNION ALL SELECT truth, 'same', same FROM t)
SELECT model, count(*) AS n, round(avg(CASE WHEN truth = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN truth THEN CASE WHEN p THEN 1.0 ELSE 0.0 END END), 6) AS accuracy_true, round(avg(CASE WHEN NOT truth THEN CASE WHEN p THEN 0.0 ELSE 1.0 END END), 6) AS accuracy_false FROM l GROUP BY model""")
def model_accuracies(spark, d):
    l = table(spark, d, "doc_labels").groupBy("doc_id").agg(F.max(F.when(F.col("rater") == "r1", F.col("flagged") == 1)).alias("truth"), F.max(F.when(F.col("rater") == "r2", F.col("flagged") == 1)).alias("other"))
    l = l.where("truth is not null and other is not null").withColumn("same", F.col("truth"))
    return A.accuracies(l, "truth", ["other", "same"]).select("model", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_true", "accuracy_false")])


SIMPSON = [("johnny", True, True, 6000), ("johnny", True, False, 2000), ("johnny", False, True, 1500), ("johnny", False, False, 500), ("billy", True, True, 3000), ("billy", True, False, 3000), ("billy", False, True, 2000), ("billy", False, False, 2000)]


@query("WITH t(child, ok, asked, n) AS (VALUES " + ", ".join(f"('{c}', {str(a).lower()}, {str(b).lower()}, {n})" for c, a, b, n in SIMPSON) + ") SELECT child, ok, CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN asked THEN n ELSE 0 END) * 1.0 / sum(n), 9) AS proportion FROM t GROUP BY GROUPING SETS ((child, ok), (ok))")
def simpson_pooled(spark, d):
    t = spark.createDataFrame(SIMPSON, "child string, ok boolean, asked boolean, k int")
    t = t.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("k"))))
    return A.proportions(t, ["child", "ok"], "asked", total=True, drop="child").select("child", "ok", "n", F.round("proportion", 9).alias("proportion"))


@query("SELECT transcript_file, round((age - (SELECT avg(age) FROM transcripts)) / ((SELECT max(age) FROM transcripts) - (SELECT min(age) FROM transcripts)), 6) AS age_centred, CASE WHEN has_timing THEN 0.5 WHEN NOT has_timing THEN -0.5 END AS timing FROM transcripts")
def centred_ages(spark, d):
    t = A.centred(table(spark, d, "transcripts"), "age")
    return t.select("transcript_file", F.round("age_centred", 6).alias("age_centred"), A.plus_minus_half(F.col("has_timing")).alias("timing"))


@query(f"WITH {TURNS} SELECT count(*) AS n, count(*) FILTER (WHERE speaker_code = 'CHI') AS n_child, round(count(*) FILTER (WHERE speaker_code = 'CHI') * 1.0 / count(*), 9) AS share_child, count(*) FILTER (WHERE speaker_code IN ({CARE})) AS n_care, round(count(*) FILTER (WHERE speaker_code IN ({CARE})) * 1.0 / count(*), 9) AS share_care FROM turns")
def speaker_counts(spark, d):
    c = A.counts_where(turns(spark, d), {"child": F.coalesce(F.col("speaker_code") == "CHI", F.lit(False)), "care": F.coalesce(F.col("speaker_code").isin(chat.CAREGIVERS), F.lit(False))})
    return c.select("n", "n_child", F.round("share_child", 9).alias("share_child"), "n_care", F.round("share_care", 9).alias("share_care"))


@query("SELECT row_id, CASE is_grammatical WHEN -1 THEN 0 ELSE is_grammatical END AS is_grammatical FROM grammaticality_sheet WHERE is_grammatical IN (1, -1) AND transcript_clean IS NOT NULL")
def judgement_rows(spark, d):
    return Q.judgement_dataset(table(spark, d, "grammaticality_sheet")).select("row_id", "is_grammatical")


@query(f"WITH {TURNS} SELECT row_id, CASE WHEN speaker_code = 'CHI' THEN '[CHI]' WHEN speaker_code IN ({CARE}) THEN '[CAR]' ELSE '[OTH]' END || ' ' || transcript_clean AS utterance FROM turns")
def special_tokens(spark, d):
    return turns(spark, d).select("row_id", F.concat(T.special_token(F.col("speaker_code"), chat.CAREGIVERS), F.lit(" "), F.col("transcript_clean")).alias("utterance"))


@query("SELECT ngram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM (SELECT list_filter(regexp_split_to_array(lower(transcript_clean), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM grammaticality_sheet) WHERE len(w) >= 2) GROUP BY ngram ORDER BY n DESC, ngram LIMIT 100")
def top_bigrams(spark, d):
    return A.top_ngrams(table(spark, d, "grammaticality_sheet"), "transcript_clean", 2, 100)


@query("SELECT CASE trim(is_grammatical) WHEN '1' THEN true WHEN '0' THEN false WHEN '-1' THEN false END AS judged, count(*) AS n FROM annotated_transcripts GROUP BY 1")
def judgement_counts(spark, d):
    return table(spark, d, "annotated_transcripts").groupBy(Q.judgement(F.col("is_grammatical")).alias("judged")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT row_id, source, is_grammatical = 1 AS ok, starts_with(lower(transcript_clean), 'i ') AS a, contains(transcript_clean, 'that') AS b FROM grammaticality_sheet WHERE is_grammatical IN (1, -1) AND transcript_clean IS NOT NULL),
l AS (SELECT 'a' AS subtype, a AS holds, ok FROM s WHERE a OR NOT (a OR b) UNION ALL SELECT 'b', b, ok FROM s WHERE b OR NOT (a OR b)) SELECT subtype, holds, count(*) AS n, count(*) FILTER (WHERE ok) AS n_true FROM l GROUP BY 1, 2""")
def subtype_counts(spark, d):
    s = table(spark, d, "grammaticality_sheet").where(F.col("is_grammatical").isin(1, -1) & F.col("transcript_clean").isNotNull())
    s = s.withColumns({"ok": F.col("is_grammatical") == 1, "a": F.lower("transcript_clean").startswith("i "), "b": F.col("transcript_clean").contains("that")})
    return A.subtype_proportions(s, [], ["a", "b"], "ok").select("subtype", "holds", "n", "n_true")


@query("SELECT a.row_id, a.transcript_file, u.speaker_code, a.labels FROM annotated_transcripts a JOIN utterances u ON u.row_id = a.row_id")
def annotated_speakers(spark, d):
    u = table(spark, d, "utterances").select("row_id", "speaker_code")
    return table(spark, d, "annotated_transcripts").join(u, "row_id").select("row_id", "transcript_file", "speaker_code", "labels")


@query("SELECT corpus, speech_act, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY corpus), 9) AS share FROM utterances GROUP BY corpus, speech_act")
def speech_act_shares(spark, d):
    return A.corpus_label_shares(table(spark, d, "utterances"), "corpus", "speech_act").select("corpus", "speech_act", "n", F.round("share", 9).alias("share"))


@query("SELECT row_id, coalesce(prev_transcript_clean, '') || '[SEP]' || transcript_clean || '[EOS]' AS line FROM grammaticality_sheet WHERE transcript_clean IS NOT NULL")
def model_lines(spark, d):
    s = table(spark, d, "grammaticality_sheet").where("transcript_clean is not null")
    return s.select("row_id", model_input(F.col("transcript_clean"), F.col("prev_transcript_clean"), end="[EOS]").alias("line"))


@query()
def ngram_forest_errors(spark, d):
    """Rows of the validation split that a random forest on n-grams of the training split gets wrong, and how many it gets right, by judgement."""
    s = table(spark, d, "grammaticality_sheet").where(F.col("is_grammatical").isin(1, -1)).withColumn("ok", F.col("is_grammatical") == 1)
    m = ngram_forest(s.where("split = 'train'"), "transcript_clean", "ok", 100, 20)
    return m.transform(with_ngram_inputs(s.where("split = 'val'"), "transcript_clean", "ok")).groupBy("ok", (F.col("prediction") == F.col("label")).alias("is_correct")).agg(F.count(F.lit(1)).alias("n"))


@query()
def p3_found(spark, d):
    """table_name, row_id, item_no, label of the packed label cells."""
    return cells.label_items_found(*[table(spark, d, n) for n in LABEL_TABLES])


@query()
def p3_items(spark, d):
    """The same with offset, kind and error flag."""
    return cells.label_items(*[table(spark, d, n) for n in LABEL_TABLES])


from . import pipeline  # noqa: E402, F401  (registers its queries here)
