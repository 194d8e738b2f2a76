"""Named queries over the whole pipeline from raw lines on, and their SQL.

Except for `preprocessed` they start from the lines as loaded: there are no gates on
transcripts and rows, no "actually says" notes and no names, so that neighbours and shares
are those of all rows. SQL has no stemmer, so that queries which need stems have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import chat, responses as R, words as T
from ..operators import analytics as A, sampling as S, sequence as W
from ..operators.ml import fit_ratio_classifier, logistic_curve
from ..sources.tables import spread, stage, table
from . import composites as Q, rules_sql as X
from .registry import CARE, _CUT, _STOP, _list, _words_sql, query

LINES = f"""src AS (SELECT row_id, regexp_replace(transcript_raw, '\\x15[^\\x15]+?\\x15', '', 'g') AS raw, error FROM utterances), {X.stripped("src", "bare")}, {X.cleaned("bare", "clean")}"""
LABELLED = f"{LINES}, {X.labelled('clean', 'labelled')}"
ROWS = f"""{LABELLED}, {X.error_labels("labelled", "judged")},
rows AS (SELECT u.row_id, u.transcript_file, u.speaker_code, u.corpus, u.child_name, u.age, u.start_time, u.end_time, u.speech_act, j.raw, j.transcript_clean, j.is_speech_related, j.is_intelligible, j.is_grammatical, j.labels
  FROM judged j JOIN utterances u ON u.row_id = j.row_id WHERE j.raw IS NOT NULL)"""


def triples_sql(timing: bool, source: str = "rows") -> str:
    """triples of turn, response and follow-up, as structs t (turn), r (response), f (follow-up)."""
    gap = "AND nx.start_time - t.end_time >= 1000" if timing else ""
    keep = "WHERE response_latency > -10000 AND CAST(f.start_time AS DOUBLE) - t.end_time <= 60000" if timing else ""
    later = "PARTITION BY transcript_file ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    return f"""packed AS (SELECT row_id, transcript_file, speaker_code, corpus, child_name, age, labels,
  struct_pack(id := row_id, text := transcript_clean, start_time := start_time, end_time := end_time, ok := is_intelligible, sr := is_speech_related, act := speech_act, gr := is_grammatical) AS t FROM {source}),
seen AS (SELECT *, lead(t) OVER w AS nx, lead(speaker_code) OVER w AS nx_speaker, first_value(CASE WHEN speaker_code = 'CHI' THEN t END IGNORE NULLS) OVER later AS kid,
  first_value(CASE WHEN speaker_code <> 'CHI' THEN speaker_code END IGNORE NULLS) OVER later AS other FROM packed WINDOW w AS (PARTITION BY transcript_file ORDER BY row_id), later AS ({later})),
told AS (SELECT *, CASE WHEN nx_speaker IN ({CARE}) AND nx.id = row_id + 1 THEN true WHEN nx_speaker = 'CHI' AND (other IS NULL OR other IN ({CARE})) {gap} THEN false END AS answered FROM seen WHERE speaker_code = 'CHI' AND kid IS NOT NULL),
triples AS (SELECT * FROM (SELECT row_id, transcript_file, corpus, child_name, age, labels, answered, t, CASE WHEN answered THEN kid ELSE nx END AS f,
  CASE WHEN answered THEN nx ELSE struct_pack(id := 0::BIGINT, text := '', start_time := NULL::BIGINT, end_time := NULL::BIGINT, ok := false, sr := false, act := 'YY', gr := false) END AS r,
  CASE WHEN answered THEN CAST(nx.start_time AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END - t.end_time AS response_latency FROM told WHERE answered IS NOT NULL) {keep})"""


_BINNED = "CAST(least({most}, greatest({least}, floor((age + 3) / 6) * 6)) AS INTEGER)"
# Flags of responses that need no stems.
FLAGGED = f"""words_ AS (SELECT *, {_words_sql("lower(" + _CUT.format("r.text") + ")", "|,")} AS ws, list_distinct({_words_sql("lower(" + _CUT.format("t.text") + ")")}) AS tw, list_distinct({_words_sql("lower(" + _CUT.format("r.text") + ")")}) AS rw FROM triples),
plain_ AS (SELECT *, list_filter(ws, lambda x: NOT list_contains({_list(R.ACK_WORDS)}, x)) AS rest, list_filter(tw, lambda x: NOT list_contains({_STOP}, x)) AS tp, list_filter(rw, lambda x: NOT list_contains({_STOP}, x)) AS rp FROM words_),
sets_ AS (SELECT *, CASE WHEN len(tp) = 0 OR len(rp) = 0 THEN tw ELSE tp END AS a, CASE WHEN len(tp) = 0 OR len(rp) = 0 THEN rw ELSE rp END AS b FROM plain_),
shares_ AS (SELECT *, CASE WHEN r.text = '' OR len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(a) END AS rep_utt, CASE WHEN r.text = '' OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(b) END AS rep_response FROM sets_),
flagged AS (SELECT *, coalesce(NOT ends_with(t.text, '?') AND NOT ends_with(r.text, '?') AND len(ws) > 0 AND (len(rest) = 0 OR list_contains({_list(R.ACK_CERTAIN)}, ws[1]) OR list_contains({_list(R.ACK_PHRASES)}, array_to_string(ws, ' ')) OR list_contains({_list(R.ACK_PHRASES)}, array_to_string(rest, ' '))), false) AS keyword_ack,
  coalesce(NOT ends_with(t.text, '?') AND NOT ends_with(r.text, '?') AND rep_utt * {Q.ACK_WEIGHTS[0]}::DOUBLE + rep_response * {Q.ACK_WEIGHTS[1]}::DOUBLE + ({Q.ACK_WEIGHTS[2]}::DOUBLE) > 0, false) AS repetition_ack,
  coalesce(r.act IN ('EQ', 'RR') AND NOT (len(tw) = 1 AND list_contains({_list(R.CAREGIVER_NAMES)}, tw[1])), false) AS act_request FROM shares_)"""
# The turns of the grammaticality queries.
JUDGED_TURNS = f"""turns_ AS (SELECT *, {_BINNED.format(least=10, most=60)} AS age_bin FROM flagged WHERE age BETWEEN 10 AND 60 AND t.gr IS NOT NULL AND t.ok AND r.sr AND len({_words_sql(_CUT.format("t.text"), "|,")}) >= 1)"""
GRAMMATICALITY = f"WITH {ROWS}, {triples_sql(False)}, {FLAGGED}, {JUDGED_TURNS}"


def loaded(spark, d, keep_stripped: bool = False) -> DataFrame:
    """Every raw line as loaded, without time marks, with its clean text (and, if asked for, its text without codes)."""
    u = table(spark, d, "utterances").withColumn("transcript_raw", chat.without_timing(F.col("transcript_raw")))
    return chat.with_clean_line(spread(u), keep_stripped=keep_stripped)


def annotated(spark, d) -> DataFrame:
    """Every raw line with labels; null lines are left out."""
    return Q.annotate(loaded(spark, d, keep_stripped=True))


def judged(spark, d) -> DataFrame:
    """The same with error labels (joined) and grammaticality."""
    return Q.annotate_errors(annotated(spark, d)).withColumn("labels", F.array_join("labels", ", "))


def full_triples(spark, d) -> DataFrame:
    u = judged(spark, d)
    return W.micro_conversations(u.select("row_id", "transcript_file", "speaker_code", "transcript_clean", "start_time", "end_time", "age", "corpus", "child_name", "speech_act", "is_speech_related", "is_intelligible", "is_grammatical", "labels"))


def judged_turns(spark, d) -> DataFrame:
    return Q.grammaticality_conversations(full_triples(spark, d))


# ---- Lines --------------------------------------------------------------------------
@query(f"WITH {LINES} SELECT row_id, transcript_clean FROM clean")
def cleaned_lines(spark, d):
    """row_id and the clean text of every raw line."""
    return loaded(spark, d).select("row_id", "transcript_clean")


@query(f"WITH {LABELLED} SELECT row_id, is_speech_related, is_intelligible FROM labelled WHERE raw IS NOT NULL")
def annotated_lines(spark, d):
    """row_id and both three-valued labels of every raw line that is not null."""
    return annotated(spark, d).select("row_id", "is_speech_related", "is_intelligible")


@query(f"WITH {ROWS} SELECT row_id, labels, is_grammatical FROM judged")
def error_labels(spark, d):
    """row_id, labels and grammaticality of every line."""
    return Q.annotate_errors(loaded(spark, d)).select("row_id", F.array_join("labels", ", ").alias("labels"), "is_grammatical")


@query(f"WITH {ROWS}, l AS (SELECT unnest(string_split(labels, ', ')) AS label FROM rows WHERE speaker_code = 'CHI' AND labels IS NOT NULL) SELECT label, count(*) AS n FROM l GROUP BY label")
def error_label_counts(spark, d):
    """How often each error class is marked in children's lines."""
    u = judged(spark, d).where("speaker_code = 'CHI'")
    return A.explode_labels(u.where("labels is not null"), "labels", None).groupBy(F.col("labels").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query()
def preprocessed(spark, d):
    """row_id (dense), transcript_file, utterance_id, child_name, age, transcript_clean after all stages of preprocessing, on all tables: gates, names and ages from paths, notes."""
    u = table(spark, d, "utterances").where("transcript_file is not null").withColumn("transcript_raw", chat.without_timing(F.col("transcript_raw")))
    u = u.withColumn("utterance_id", F.struct("utterance_id", F.col("row_id").alias("loaded"))).drop("row_id")  # places clash; the order of loading decides
    return Q.preprocess(u).select("row_id", "transcript_file", "utterance_id.utterance_id", "child_name", "age", "transcript_clean")


# ---- Grammaticality -----------------------------------------------------------------
@query()
def grammaticality_proportions(spark, d):
    """How often children's turns are followed by clarification requests, by age and grammaticality."""
    return Q.grammaticality_proportions(judged_turns(spark, d))


@query(f"{GRAMMATICALITY} SELECT age_bin AS age, t.gr AS utt_is_grammatical, count(*) AS n, count(*) FILTER (WHERE keyword_ack OR repetition_ack) AS n_true, grouping(age_bin) = 1 AS is_total FROM turns_ GROUP BY GROUPING SETS ((age_bin, t.gr), (t.gr))")
def acknowledgements_by_grammaticality(spark, d):
    """How often turns are acknowledged, by age and grammaticality, and for all ages."""
    return Q.grammaticality_proportions(judged_turns(spark, d), "response_is_acknowledgement").select("age", "utt_is_grammatical", "n", "n_true", "is_total")


@query(f"{GRAMMATICALITY} SELECT child_name, t.gr AS utt_is_grammatical, count(*) AS n, count(*) FILTER (WHERE act_request) AS n_true FROM turns_ GROUP BY 1, 2")
def requests_by_child(spark, d):
    """How often each child's turns are asked about by speech act, by grammaticality."""
    return A.proportions(judged_turns(spark, d), ["child_name", "utt_is_grammatical"], "response_is_clarification_request_speech_act").select("child_name", "utt_is_grammatical", "n", "n_true")


@query(f"{GRAMMATICALITY}, l AS (SELECT unnest(string_split(labels, ', ')) AS label, act_request FROM turns_ WHERE labels IS NOT NULL) SELECT label, count(*) AS n, count(*) FILTER (WHERE act_request) AS n_true FROM l GROUP BY 1")
def requests_by_label(spark, d):
    """How often turns are asked about by speech act, by error class."""
    t = A.explode_labels(judged_turns(spark, d), "labels", None)
    return A.proportions(t, ["labels"], "response_is_clarification_request_speech_act").select(F.col("labels").alias("label"), "n", "n_true")


@query(f"""{GRAMMATICALITY}, m AS (SELECT act_request, false AS is_follow_up, t.gr AS gr FROM turns_ WHERE f.ok AND f.gr IS NOT NULL UNION ALL SELECT act_request, true, f.gr FROM turns_ WHERE f.ok AND f.gr IS NOT NULL)
SELECT act_request AS response_is_clarification_request_speech_act, is_follow_up, count(*) AS n, count(*) FILTER (WHERE gr) AS n_true FROM m GROUP BY 1, 2""")
def follow_ups_by_request(spark, d):
    """How often turns and their follow-ups are grammatical, by whether a request by speech act stands between."""
    m = Q.grammaticality_melted(judged_turns(spark, d))
    return A.proportions(m, ["response_is_clarification_request_speech_act", "is_follow_up"], "is_grammatical").select("response_is_clarification_request_speech_act", "is_follow_up", "n", "n_true")


@query()
def request_subtypes(spark, d):
    """How often follow-ups are grammatical after each kind of request."""
    return A.subtype_proportions(judged_turns(spark, d), ["utt_is_grammatical"], Q.FEEDBACK[1:3], "follow_up_is_grammatical")


@query()
def error_type_shares(spark, d):
    """How error labels are shared out over all turns and those answered by requests."""
    return Q.error_type_shares(judged_turns(spark, d))


@query(f"""WITH {ROWS}, m AS (SELECT CASE trim(a.is_grammatical) WHEN '1' THEN false WHEN '0' THEN true WHEN '-1' THEN true END AS a, NOT j.is_grammatical AS b FROM annotated_transcripts a JOIN judged j ON j.row_id = a.row_id),
c AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE a AND b) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE a AND NOT b) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE b AND NOT a) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE NOT a AND NOT b) AS DOUBLE) AS tn FROM m WHERE a IS NOT NULL AND b IS NOT NULL),
e AS (SELECT *, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe FROM c)
SELECT CAST(n AS BIGINT) AS n, round((tp + tn) / n, 6) AS agreement, round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa, round((tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn)) * sqrt((tn + fp) * (tn + fn))), 6) AS mcc,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM e""")
def manual_vs_derived(spark, d):
    """Hand-annotated judgements against those derived from error marks."""
    m = Q.manual_vs_derived(table(spark, d, "annotated_transcripts"), Q.annotate_errors(loaded(spark, d)))
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "mcc", "precision", "recall", "f1")])


@query(f"WITH {ROWS}, g AS (SELECT corpus, count(*) AS n_utterances, count(*) FILTER (WHERE is_grammatical = false) AS n_errors, avg(age) AS mean_age FROM rows WHERE speaker_code = 'CHI' GROUP BY corpus) SELECT corpus, n_utterances, n_errors, round(mean_age, 6) AS mean_age, round(n_errors * 1.0 / n_utterances, 9) AS ratio FROM g WHERE n_errors > 10")
def corpus_error_statistics(spark, d):
    """Utterances, errors, their ratio and the mean age of the corpora with more than ten errors."""
    return Q.corpus_error_statistics(judged(spark, d), 10).select("corpus", "n_utterances", "n_errors", F.round("mean_age", 6).alias("mean_age"), F.round("ratio", 9).alias("ratio"))


@query(f"""WITH {ROWS}, k AS (SELECT row_id, is_grammatical FROM rows WHERE (corpus IN ('Harnel', 'Varnham') OR is_grammatical = false) AND is_grammatical IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY is_grammatical ORDER BY left(md5(CAST(row_id AS VARCHAR) || '/1'), 12), row_id) AS k FROM k) SELECT row_id, is_grammatical FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM k GROUP BY is_grammatical))""")
def balanced_training_set(spark, d):
    """Judged rows of two corpora and all ungrammatical ones, as many of either kind."""
    return Q.balanced_training_set(judged(spark, d), ["Harnel", "Varnham"], seed=1).select("row_id", "is_grammatical")


@query(f"""WITH {ROWS}, m AS (SELECT a.is_grammatical AS c, CASE WHEN j.is_grammatical THEN '1' WHEN NOT j.is_grammatical THEN '0' ELSE '?' END AS a FROM annotated_transcripts a JOIN judged j ON j.row_id = a.row_id WHERE a.is_grammatical IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (WHERE a = c) AS n_same, round(count(*) FILTER (WHERE a = c) * 1.0 / count(*), 9) AS share_same, count(*) FILTER (WHERE a <> c) AS n_changed, count(*) FILTER (WHERE a = '?' AND c <> '?') AS n_resolved, count(*) FILTER (WHERE a <> '?' AND c = '?') AS n_unsettled FROM m""")
def context_effect(spark, d):
    """How often the judgement of a line by its marks alone differs from the one by hand in its context."""
    alone = F.when(F.col("is_grammatical"), "1").when(~F.col("is_grammatical"), "0").otherwise("?")
    marks = Q.annotate_errors(loaded(spark, d)).select("row_id", alone.alias("alone"))
    both = table(spark, d, "annotated_transcripts").select("row_id", F.col("is_grammatical").alias("in_context")).join(marks, "row_id")
    return Q.context_effect(both, "alone", "in_context").select("n", "n_same", F.round("share_same", 9).alias("share_same"), "n_changed", "n_resolved", "n_unsettled")


@query(f"WITH {ROWS} SELECT len(list_distinct({_words_sql(_CUT.format('transcript_clean'), '|,')})) AS n_words, is_grammatical, count(*) AS n FROM rows GROUP BY 1, 2")
def words_and_grammaticality(spark, d):
    """How many lines have so many different words, by grammaticality."""
    w = Q.words_and_grammaticality(judged(spark, d))
    return w.select(F.col("n_words").cast("long").alias("n_words"), "is_grammatical", "n")


# ---- Intelligibility and speech -----------------------------------------------------
def _integral(density: str, to: str) -> str:
    """Simpson's rule from 0 on, over 4,000 steps."""
    return f"list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density.format(x=f'({to} * i / 4000)')})) * {to} / 12000"


NORMAL_TAIL = "round(0.5 - " + _integral("exp(-0.5 * pow({x}, 2))", "least(greatest(s, -12), 12)") + " / sqrt(2 * pi()), 6)"
STUDENT_TAIL = "round(0.5 - " + _integral("pow(1 + pow({x}, 2) / (n - 1), -n / 2.0)", "least(greatest(s, -30), 30)") + " * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()), 6)"


def _contingencies_sql(flag: str, heard: str, needed: str, tail: str) -> str:
    return f"""WITH {ROWS}, {triples_sql(True)}, kept AS (SELECT *, coalesce(response_latency <= 1000 AND r.{heard}, false) AS heard FROM triples WHERE age BETWEEN 10 AND 48 AND {needed} AND response_latency IS NOT NULL),
many AS (SELECT * FROM kept QUALIFY count(*) OVER (PARTITION BY transcript_file) > 1),
g AS (SELECT 'caregiver' AS contingency_of, transcript_file, avg(CASE WHEN t.{flag} THEN CAST(heard AS INTEGER) END) - avg(CASE WHEN NOT t.{flag} THEN CAST(heard AS INTEGER) END) AS c FROM many GROUP BY 2
  UNION ALL SELECT 'child', transcript_file, avg(CASE WHEN heard THEN CAST(f.{flag} AS INTEGER) END) - avg(CASE WHEN NOT heard THEN CAST(f.{flag} AS INTEGER) END) FROM many WHERE t.{flag} GROUP BY 2),
s AS (SELECT contingency_of, count(c) AS n, avg(c) AS mean, stddev_pop(c) AS std, stddev_samp(c) / sqrt(count(c)) AS sem FROM g GROUP BY 1), z AS (SELECT *, mean / sem AS s FROM s)
SELECT contingency_of, n, round(mean, 6) AS mean, round(std, 6) AS std, round(sem, 6) AS sem, round(s, 5) AS statistic, {tail} AS p FROM z"""


def _rounded(c: DataFrame) -> DataFrame:
    return c.select("contingency_of", "n", *[F.round(x, 6).alias(x) for x in ("mean", "std", "sem")], F.round("statistic", 5).alias("statistic"), F.round("p", 6).alias("p"))


@query(_contingencies_sql("ok", "ok", "t.sr IS NOT NULL AND t.ok IS NOT NULL AND f.ok IS NOT NULL", NORMAL_TAIL))
def timing_contingencies(spark, d):
    """How response and intelligibility depend on each other, per transcript, over the timed triples; with the z test."""
    t = W.micro_conversations(annotated(spark, d), timing=True)
    return _rounded(Q.timing_contingencies(Q.timing_conversations(t)))


@query(_contingencies_sql("sr", "sr", "t.sr IS NOT NULL AND f.sr IS NOT NULL", STUDENT_TAIL))
def speech_contingencies(spark, d):
    """The same of speech and responses to it; with the t test."""
    return _rounded(Q.speech_relatedness_contingencies(W.micro_conversations(annotated(spark, d), timing=True)))


@query(f"""WITH {ROWS}, {triples_sql(True)} SELECT {_BINNED.format(least=10, most=48)} AS age, t.ok AS utt_is_intelligible, count(*) AS n, count(*) FILTER (WHERE coalesce(response_latency <= 1000 AND r.ok, false)) AS n_true FROM triples
WHERE age BETWEEN 10 AND 48 AND t.sr IS NOT NULL AND t.ok IS NOT NULL AND f.ok IS NOT NULL AND response_latency IS NOT NULL AND (transcript_file IN (SELECT transcript_file FROM triples WHERE age BETWEEN 10 AND 48 AND t.sr IS NOT NULL AND t.ok IS NOT NULL AND f.ok IS NOT NULL AND response_latency IS NOT NULL GROUP BY 1 HAVING count(*) > 1) OR transcript_file IS NULL) GROUP BY 1, 2""")
def responses_by_intelligibility(spark, d):
    """How often turns are answered in time, by age and intelligibility."""
    c = Q.timing_conversations(W.micro_conversations(annotated(spark, d), timing=True))
    return A.proportions(c, ["age", "utt_is_intelligible"], "has_response").select("age", "utt_is_intelligible", "n", "n_true")


@query(f"""WITH {LABELLED}, l AS (SELECT u.transcript_file, u.age, g.is_speech_related AS s, coalesce(g.is_intelligible, false) AS i, u.speaker_code, g.row_id FROM labelled g JOIN utterances u ON u.row_id = g.row_id WHERE raw IS NOT NULL AND u.age BETWEEN 10 AND 60),
k AS (SELECT * FROM l QUALIFY count(*) FILTER (WHERE speaker_code = 'CHI') OVER (PARTITION BY transcript_file) > 1)
SELECT transcript_file, round(avg(CAST(s AS INTEGER)), 6) AS speech, round(avg(CASE WHEN s THEN CAST(i AS INTEGER) END), 6) AS intelligible, min(age) AS min_age, round(avg(age), 6) AS mean_age FROM k WHERE speaker_code = 'CHI' GROUP BY 1""")
def joint_development(spark, d):
    """Two development curves from raw lines: the children's share of speech, and of intelligible turns among speech."""
    return Q.joint_development(Q.annotate_errors(annotated(spark, d))).select("transcript_file", *[F.round(c, 6).alias(c) for c in ("speech", "intelligible")], "min_age", F.round("mean_age", 6).alias("mean_age"))


@query(f"""WITH {ROWS}, k AS (SELECT * FROM rows WHERE age BETWEEN 10 AND 60 QUALIFY count(*) FILTER (WHERE speaker_code = 'CHI') OVER (PARTITION BY transcript_file) > 1)
SELECT transcript_file, round(avg(CASE WHEN is_speech_related AND coalesce(is_intelligible, false) THEN CAST(is_grammatical AS INTEGER) END), 6) AS grammatical FROM k WHERE speaker_code = 'CHI' GROUP BY 1""")
def grammatical_development(spark, d):
    """The third curve: the share of grammatical turns among intelligible ones."""
    return Q.joint_development(Q.annotate_errors(annotated(spark, d))).select("transcript_file", F.round("grammatical", 6).alias("grammatical"))


@query()
def intelligibility_age_curve(spark, d):
    """The logistic curve of the intelligible share over age, one point per transcript."""
    j = Q.joint_development(Q.annotate_errors(annotated(spark, d)))
    return logistic_curve(j, "mean_age", "intelligible")


# ---- Training and annotation sets ---------------------------------------------------
@query(f"WITH {LINES} SELECT c.transcript_clean FROM clean c JOIN utterances u ON u.row_id = c.row_id WHERE age BETWEEN 10 AND 60 AND speaker_code IN ({CARE}) AND transcript_clean IS NOT NULL AND len({_words_sql(_CUT.format('transcript_clean'), '|,')}) >= 2")
def training_texts(spark, d):
    """Caregivers' texts for a language model."""
    return Q.language_model_training_set(loaded(spark, d))


@query(f"{GRAMMATICALITY} SELECT t.text AS utt_transcript_clean, r.text AS response_transcript_clean, act_request AS response_is_clarification_request_speech_act, keyword_ack OR repetition_ack AS response_is_acknowledgement FROM turns_ WHERE len({_words_sql(_CUT.format('t.text'), '|,')}) >= 2")
def feedback_texts(spark, d):
    """Texts of turns and responses with two of the flags that reward a model."""
    f = Q.feedback_training_set(judged_turns(spark, d))
    return f.select("utt_transcript_clean", "response_transcript_clean", "response_is_clarification_request_speech_act", "response_is_acknowledgement")


@query(f"""WITH {LINES}, p AS (SELECT u.row_id, u.corpus, u.transcript_file, u.speaker_code, c.transcript_clean FROM clean c JOIN utterances u ON u.row_id = c.row_id),
q AS (SELECT *, sum(CASE WHEN speaker_code = 'CHI' THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_file) AS n, sum(CASE WHEN speaker_code = 'CHI' THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_file ORDER BY row_id) - CASE WHEN speaker_code = 'CHI' THEN 1 ELSE 0 END AS before FROM p WHERE transcript_file IS NOT NULL),
k AS (SELECT * FROM q WHERE n >= 10 AND before < 10), b AS (SELECT DISTINCT first_value(transcript_file) OVER (PARTITION BY corpus ORDER BY left(md5(transcript_file || '/0'), 12), transcript_file) AS transcript_file FROM k)
SELECT row_id, CASE WHEN speaker_code = 'CHI' THEN '[CHI]' WHEN speaker_code IN ({CARE}) THEN '[CAR]' ELSE '[OTH]' END || coalesce(' ' || transcript_clean, '') AS utterance FROM k WHERE transcript_file IN (FROM b)""")
def annotation_sheet(spark, d):
    """A sheet to annotate by hand: of each corpus one transcript up to its tenth child row."""
    return S.annotation_sheet(loaded(spark, d).where("transcript_file is not null"), 10).select("row_id", "utterance")


def _candidates_sql(question: bool) -> str:
    asks = f"ends_with(r.text, '?') AND NOT act_request" if question else "NOT ends_with(r.text, '?') AND NOT keyword_ack"
    return f"""WITH {ROWS}, {triples_sql(False)}, {FLAGGED} SELECT row_id AS "index" FROM flagged WHERE rep_utt > 0 AND rep_response > 0 AND {asks} ORDER BY left(md5(CAST(row_id AS VARCHAR) || '/0'), 12), row_id LIMIT 200"""


@query(_candidates_sql(True))
def question_candidates(spark, d):
    """200 triples at random whose response repeats words in a question."""
    return Q.annotation_candidates(full_triples(spark, d), True).select("index")


@query(_candidates_sql(False))
def acknowledgement_candidates(spark, d):
    """200 triples at random whose response repeats words and asks nothing."""
    return Q.annotation_candidates(full_triples(spark, d), False).select("index")


@query()
def request_classifier(spark, d):
    """The weights of a classifier of repeating questions, fitted on the triples whose response asks: is it a request for clarification by its speech act?"""
    t = full_triples(spark, d).where(F.col("response_transcript_clean").endswith("?") & F.col("response_speech_act").isNotNull())
    t = R.with_repetition_ratios(t, "utt_transcript_clean", "response_transcript_clean").withColumn("asked", R.is_speech_act_request(F.col("response_speech_act"), F.col("utt_transcript_clean")))
    a, b, c = fit_ratio_classifier(t, "rep_utt", "rep_response", "asked")
    return spark.createDataFrame([(a, b, c)], "of_utterance double, of_response double, intercept double")


_NEAR = "string_agg(transcript_clean, ' ') OVER (PARTITION BY transcript_file, use ORDER BY row_id ROWS BETWEEN {frame})"


@query(f"""WITH {LABELLED}, v AS (SELECT l.row_id, u.transcript_file, l.transcript_clean, coalesce(l.is_speech_related, true) AS use FROM labelled l JOIN utterances u ON u.row_id = l.row_id WHERE raw IS NOT NULL)
SELECT row_id, CASE WHEN use THEN {_NEAR.format(frame="2 PRECEDING AND 1 PRECEDING")} END AS prev_transcript_clean_2, CASE WHEN use THEN {_NEAR.format(frame="1 FOLLOWING AND 2 FOLLOWING")} END AS following_transcript_clean_2 FROM v""")
def context_windows(spark, d):
    """Two texts before and after each line, speech-related ones by the full rules."""
    u = annotated(spark, d)
    return W.with_following(W.with_previous(u, 2), 2).select("row_id", "prev_transcript_clean_2", "following_transcript_clean_2")


@query(_contingencies_sql("ok", "ok", "t.sr IS NOT NULL AND t.ok IS NOT NULL AND f.ok IS NOT NULL", NORMAL_TAIL))
def stored_contingencies(spark, d):
    """timing_contingencies of a stored table of triples, written once and read again."""
    stored = stage(Q.timing_conversations(W.micro_conversations(annotated(spark, d), timing=True)).select("transcript_file", "has_response", "utt_is_intelligible", "follow_up_is_intelligible"))
    return _rounded(Q.timing_contingencies(stored))


@query(f"{GRAMMATICALITY} SELECT round(rep_utt, 6) AS rep_utt, round(rep_response, 6) AS rep_response, keyword_ack, count(*) AS n FROM turns_ GROUP BY 1, 2, 3")
def ratio_counts(spark, d):
    """How many turns have so large repeated shares, by whether keywords acknowledge them."""
    t = judged_turns(spark, d).withColumns({"rep_utt": F.round("rep_utt", 6), "rep_response": F.round("rep_response", 6), "keyword_ack": F.col("response_is_keyword_acknowledgement")})
    return t.groupBy("rep_utt", "rep_response", "keyword_ack").agg(F.count(F.lit(1)).alias("n"))


# ---- Predicates of lines and words ----------------------------------------------------
_NO_PUNCTUATION = "trim(regexp_replace(replace(replace(translate({c}, '\"„”', ''), '''''', ''), '  ', ' '), '[.!?]+\\s*$', ''))"
_BODY = X.text("|".join(chat.BODY_SOUNDS))


@query(f"""WITH v AS (SELECT row_id, transcript_raw AS raw, regexp_extract(transcript_raw, '\\[=! [^\\]]*\\]') AS e FROM utterances WHERE transcript_raw IS NOT NULL),
k AS (SELECT *, NOT ({X._like_speech("e")} OR regexp_matches(e, {_BODY}) OR (contains(e, 'mak') AND contains(e, 'noise'))) AS is_external FROM v)
SELECT row_id, {_NO_PUNCTUATION.format(c="raw")} AS bare, {_NO_PUNCTUATION.format(c="raw")} = '' AS is_empty, {X._understood("e")} AS event_is_intelligible, is_external AS event_is_external,
  e <> '' AND is_external AND {_NO_PUNCTUATION.format(c="replace(raw, e, '')")} = '' AS is_external_event, len(regexp_extract_all(raw, '\\[=! [^\\]]*\\]')) > 1 AS has_multiple_events FROM k""")
def line_predicates(spark, d):
    """What the predicates of lines and events tell of every raw line."""
    c = F.col("transcript_raw")
    event = chat.first_event(c)
    return table(spark, d, "utterances").where(c.isNotNull()).select(
        "row_id", T.remove_punctuation(c).alias("bare"), T.is_empty(c).alias("is_empty"), chat.event_is_intelligible(event).alias("event_is_intelligible"), chat.event_is_external(event).alias("event_is_external"),
        chat.is_external_event(c).alias("is_external_event"), chat.has_multiple_events(c).alias("has_multiple_events"))


_W = "replace(w, ',', '')"
_W_EXCLUDED = X._EXCLUDED.replace(X._BARE, _W)
_W_BABBLE = f"CASE WHEN starts_with({_W}, '&=') THEN NOT {X._understood(_W)} ELSE starts_with({_W}, '&') OR regexp_matches({_W}, '@[biup]$') OR contains({_W}, 'xxx') OR {_W} = 'yyy' OR lower({_W}) IN {X.texts(chat.BABBLE)} END"


@query(f"""WITH v AS (SELECT DISTINCT unnest(regexp_split_to_array(transcript_raw, '[ \\t\\n\\r\\f\\x0b]+')) AS w FROM utterances)
SELECT w AS word, {_W_EXCLUDED} AS is_excluded, {_W} IN {X.texts(chat.LAUGHTER)} AS is_laughter, {_W_BABBLE} AS is_babble,
  CASE WHEN starts_with(w, '&=') THEN {X._like_speech("w")} ELSE {_W} NOT IN {X.texts(chat.LAUGHTER)} AND lower(w) NOT IN {X.texts(chat.NONSPEECH)} END AS is_speech_related,
  NOT (starts_with({_W}, '&=') OR {_W} IN {X.texts(chat.LAUGHTER)} OR lower({_W}) IN {X.texts(chat.NONSPEECH)} OR {_W_EXCLUDED} OR ({_W_BABBLE}) OR regexp_matches({_W}, '@[up]$')) AS is_parseable FROM v WHERE w <> ''""")
def word_predicates(spark, d):
    """What the predicates of words tell of every different word of the raw lines."""
    w = F.col("word")
    words = table(spark, d, "utterances").select(F.explode(F.split("transcript_raw", r"\s+")).alias("word")).where("word != ''").distinct()
    return words.select(w, chat.is_excluded_word(w).alias("is_excluded"), chat.word_is_laughter(w).alias("is_laughter"), chat.word_is_babble(w).alias("is_babble"), chat.word_is_speech_related(w).alias("is_speech_related"), chat.word_is_parseable(w).alias("is_parseable"))


@query(f"WITH {LINES}, p AS (SELECT {_words_sql('transcript_clean', '')} AS ws FROM clean), q AS (SELECT unnest(list_transform(range(1, len(ws)), lambda i: struct_pack(a := ws[i], b := ws[i + 1]))) AS x FROM p WHERE len(ws) > 1) SELECT x.a AS first, x.b AS second, count(*) AS n FROM q GROUP BY 1, 2")
def word_pairs(spark, d):
    """How often two words stand side by side in clean lines."""
    pairs = loaded(spark, d).select(F.explode(T.word_pairs(T.words(F.col("transcript_clean"), False))).alias("p"))
    return pairs.groupBy(F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES}, v AS (SELECT u.speaker_code, lower(unnest({_words_sql(_CUT.format('transcript_clean'), '|,')})) AS w FROM clean c JOIN utterances u ON u.row_id = c.row_id)
SELECT count(*) AS n, count(*) FILTER (WHERE w IN (SELECT w FROM v WHERE speaker_code IN ({CARE}))) AS n_known FROM v WHERE speaker_code = 'CHI'""")
def childrens_words_known(spark, d):
    """How many of the children's words the caregivers use."""
    w = loaded(spark, d).select("speaker_code", F.explode(T.words(F.col("transcript_clean"), False, True, True)).alias("word"))
    k = A.with_known_words(w.where("speaker_code = 'CHI'"), w.where(F.col("speaker_code").isin(chat.CAREGIVERS)))
    return k.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_word").alias("n_known"))
