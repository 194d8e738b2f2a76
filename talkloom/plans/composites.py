"""The queries that users ask: stages of the transcript pipeline as functions from tables to tables.

Each function takes DataFrames and keyword arguments with the usual defaults.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import chat, responses as R
from ..functions.errors import actually_said, with_error_labels
from ..functions.names import replace_untranscribed_names
from ..functions.words import age_bin, num_unique_words
from ..operators import analytics as A, sampling as S, sequence as W, stats
from ..sources.chat import name_and_age_from_path, row_gates, transcript_gates

# Weights of the repetition classifiers (share of the turn, share of the response, intercept), each fitted by ml.fit_ratio_classifier on 200 hand-labelled pairs.
ACK_WEIGHTS = (1.03189, 3.09853, -3.08635)
CR_WEIGHTS = (-0.17212, 3.48849, -2.02460)
FEEDBACK = ["response_is_clarification_request", "response_is_repetition_clarification_request", "response_is_clarification_request_speech_act", "response_is_acknowledgement"]


def preprocess(df: DataFrame, names: list[tuple[str, str]] | None = None, require_timing: bool = False, no_error: list[tuple[str, str]] = ()) -> DataFrame:
    """Parsed utterances, gated, with children's names and ages read from the path where they are missing, untranscribed names filled in, "actually says" notes resolved, transcript_clean, and row_id by transcript and place.

    Transcripts without a child's name or age are left out.
    """
    name, age = name_and_age_from_path(F.col("transcript_file"), F.col("corpus"), F.col("age"), F.col("child_name"))
    df = df.withColumns({"child_name": name, "age": age}).where("child_name is not null and age is not null")
    df = row_gates(transcript_gates(df, require_timing))
    if names:
        df = replace_untranscribed_names(df, names)

    no_error = frozenset(map(tuple, no_error))

    @F.pandas_udf("text string, tags array<string>")
    def resolve(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([actually_said(t, no_error) if t and "actually says" in t else (t, []) for t in raw], columns=["text", "tags"])

    df = df.withColumn("_said", resolve("transcript_raw"))
    noted = F.filter(F.array(F.nullif("error", F.lit("")), F.nullif(F.array_join("_said.tags", ";"), F.lit(""))), lambda x: x.isNotNull())
    df = df.withColumns({"_text": F.col("_said.text"), "error": F.nullif(F.array_join(noted, ";"), F.lit(""))}).drop("_said")
    df = chat.with_clean_line(df, "_text").drop("_text")
    return df if "row_id" in df.columns else W.with_dense_id(df)


def annotate(df: DataFrame, partial_speech: bool | None = True, partial_intelligible: bool | None = False, vocabulary: list[str] | None = None) -> DataFrame:
    """Adds is_speech_related and is_intelligible; rows without transcript_raw are dropped."""
    return chat.with_labels(df.where(F.col("transcript_raw").isNotNull()), partial_speech=partial_speech, partial_intelligible=partial_intelligible, vocabulary=vocabulary)


def annotate_errors(df: DataFrame, no_error: list[tuple[str, str]] = ()) -> DataFrame:
    """Adds labels and is_grammatical; no_error: pairs (said, meant) of dialect or word choice."""
    return with_error_labels(df, no_error=no_error)


def annotate_responses(triples: DataFrame, ack_weights=ACK_WEIGHTS, cr_weights=CR_WEIGHTS) -> DataFrame:
    """Adds repetition ratios and the six response flags to triples with clean texts and response_speech_act."""
    u, r = F.col("utt_transcript_clean"), F.col("response_transcript_clean")
    d = R.with_repetition_ratios(triples, "utt_transcript_clean", "response_transcript_clean")
    d = R.with_repetition_ratios(d, "utt_transcript_clean", "response_transcript_clean", "rep_utt_stemmed", "rep_response_stemmed", stemmed=True, only=r.endswith("?"))
    d = R.with_keyword_acknowledgement(d, "utt_transcript_clean", "response_transcript_clean")
    d = d.withColumns({
        "response_is_clarification_request_speech_act": R.is_speech_act_request(F.col("response_speech_act"), u),
        "response_is_repetition_clarification_request": R.is_repetition_request(r, F.col("rep_utt_stemmed"), F.col("rep_response_stemmed"), cr_weights),
        "response_is_repetition_acknowledgement": R.is_repetition_acknowledgement(u, r, F.col("rep_utt"), F.col("rep_response"), ack_weights),
    })
    return d.withColumns({
        "response_is_clarification_request": F.col("response_is_clarification_request_speech_act") | F.col("response_is_repetition_clarification_request"),
        "response_is_acknowledgement": F.col("response_is_keyword_acknowledgement") | F.col("response_is_repetition_acknowledgement"),
    })


def grammaticality_conversations(triples: DataFrame, min_age: int = 10, max_age: int = 60, months: int = 6, min_words: int = 1, corpora: list[str] = (), excluded_children: list[str] = (), null_follow_up_as_true: bool = False) -> DataFrame:
    """Triples with known grammaticality, understood turn and response, enough words, response flags and age bins."""
    d = A.exclude_values(A.filter_corpora(A.age_between(triples, min_age, max_age), list(corpora)), "child_name", list(excluded_children))
    d = d.where(F.col("utt_is_grammatical").isNotNull() & F.col("utt_is_intelligible") & F.col("response_is_speech_related"))
    d = A.at_least_words(d, "utt_transcript_clean", min_words)
    if null_follow_up_as_true:
        d = d.withColumn("follow_up_is_grammatical", F.coalesce("follow_up_is_grammatical", F.lit(True)))
    return annotate_responses(d).withColumn("age", age_bin(F.col("age"), min_age, max_age, months))


def grammaticality_melted(conversations: DataFrame) -> DataFrame:
    """Two rows per conversation whose follow-up is understood and judged."""
    d = conversations.where(F.col("follow_up_is_intelligible") & F.col("follow_up_is_grammatical").isNotNull())
    return A.melt_follow_up(d, "is_grammatical", [*FEEDBACK, "child_name", "age", "transcript_file", "labels"])


def grammaticality_proportions(conversations: DataFrame, flag: str = "response_is_clarification_request") -> DataFrame:
    """How often a flag holds by age and grammaticality, and for all ages."""
    return A.proportions(conversations, ["age", "utt_is_grammatical"], flag, total=True, drop="age")


def error_type_shares(conversations: DataFrame, label: str = "labels") -> DataFrame:
    """How error labels are shared out over all turns and over those that are answered by each kind of request."""
    d = A.explode_labels(conversations.where(~F.col("utt_is_grammatical")), label, None)
    return A.share_by_condition(d, label, {"all": F.lit(True), **{f: F.col(f) for f in FEEDBACK[:3]}})


def speech_relatedness_contingencies(triples: DataFrame, latency_ms: float = 1000, min_nonspeech: float | None = None) -> DataFrame:
    """timing_contingencies of speech-relatedness: a response is any speech in time; tested by Student's distribution."""
    c = timing_conversations(triples, latency_ms, only_intelligible=False, needed=["utt_is_speech_related", "follow_up_is_speech_related", "response_latency"], min_nonspeech=min_nonspeech)
    return timing_contingencies(c, "is_speech_related", "t")


def timing_conversations(triples: DataFrame, latency_ms: float = 1000, only_intelligible: bool = True, min_age: int = 10, max_age: int = 48, months: int = 6, excluded_corpora: list[str] = (), min_child_rows: int = 1, min_nonspeech: float | None = None, needed: list[str] = ("utt_is_speech_related", "utt_is_intelligible", "follow_up_is_intelligible", "response_latency")) -> DataFrame:
    """Triples with has_response: of known flags and latency, of transcripts with more than min_child_rows triples, ages binned.

    min_nonspeech: only corpora whose share of turns that are not speech is greater.
    """
    d = A.filter_corpora(A.age_between(triples, min_age, max_age), [], list(excluded_corpora))
    d = d.dropna(subset=list(needed))
    d = d.withColumn("has_response", R.has_response(F.col("response_latency"), F.col("response_is_speech_related"), F.col("response_is_intelligible"), latency_ms, True, only_intelligible))
    if min_nonspeech is not None:
        d = A.groups_having(d, "corpus", F.avg((~F.col("utt_is_speech_related")).cast("double")), lambda a: a > min_nonspeech)
    d = A.more_than_child_rows(d, min_child_rows)
    return d.withColumn("age", age_bin(F.col("age"), min_age, max_age, months))


def timing_contingencies(conversations: DataFrame, flag: str = "is_intelligible", kind: str = "z") -> DataFrame:
    """Two rows: how much a turn's kind tells of the response, and the response of the follow-up's kind; with a one-sided test ('z' or 't') that the mean exceeds 0."""
    out = [
        A.contingency_summary(conversations, "transcript_file", f"utt_{flag}", "has_response").withColumn("contingency_of", F.lit("caregiver")),
        A.contingency_summary(conversations.where(f"utt_{flag}"), "transcript_file", "has_response", f"follow_up_{flag}").withColumn("contingency_of", F.lit("child")),
    ]
    d = A.union_all(*out)
    statistic = F.try_divide(F.col("mean"), F.col("sem"))
    p = stats.normal_tail("statistic") if kind == "z" else stats.student_tail("statistic", F.col("n") - 1)
    return d.withColumn("statistic", statistic).withColumn("p", p).select("contingency_of", "n", "mean", "std", "sem", "statistic", "p")


def development(df: DataFrame, flags: list[str], min_age: int = 10, max_age: int = 60, speaker: str = "CHI", min_child_rows: int = 1) -> DataFrame:
    """Per transcript the share of each flag among a speaker's rows, with age."""
    d = A.cascade_flags(A.age_between(df, min_age, max_age))
    return A.per_transcript(A.more_than_child_rows(d, min_child_rows).where(F.col("speaker_code") == speaker), flags)


def corpus_error_statistics(df: DataFrame, more_than: int = 100) -> DataFrame:
    """Per corpus with more than so many errors: utterances, errors, ratio, mean age."""
    return A.error_ratios(df.where(F.col("speaker_code") == "CHI")).where(F.col("n_errors") > more_than)


def feedback_training_set(conversations: DataFrame, min_words: int = 2) -> DataFrame:
    """Texts of turns and responses with the flags that reward a model."""
    d = A.at_least_words(conversations, "utt_transcript_clean", min_words)
    return d.select("utt_transcript_clean", "response_transcript_clean", *FEEDBACK)


def language_model_training_set(df: DataFrame, min_age: int = 10, max_age: int = 60, min_words: int = 2) -> DataFrame:
    """Caregivers' texts of enough words."""
    d = A.age_between(df, min_age, max_age).where(F.col("speaker_code").isin(chat.CAREGIVERS))
    return A.at_least_words(d.dropna(subset=["transcript_clean"]), "transcript_clean", min_words).select("transcript_clean")


def balanced_training_set(df: DataFrame, keep_corpora: list[str], seed: int = 0) -> DataFrame:
    """Judged rows of some corpora, and all ungrammatical ones, with as many grammatical as ungrammatical rows."""
    d = df.where(F.col("corpus").isin(keep_corpora) | ~F.coalesce(F.col("is_grammatical"), F.lit(True))).dropna(subset=["is_grammatical"])
    return S.balanced(d, "is_grammatical", seed=seed)


def context_effect(df: DataFrame, alone: str, in_context: str) -> DataFrame:
    """One row: of the rows judged both ways, how many judgements context changes, and which way."""
    d = df.dropna(subset=[alone, in_context])
    a, c = F.col(alone).cast("string"), F.col(in_context).cast("string")
    return A.counts_where(d, {"same": a == c, "changed": a != c, "resolved": (a == "?") & (c != "?"), "unsettled": (a != "?") & (c == "?")})


def judgement_dataset(df: DataFrame, label: str = "is_grammatical", share: float = 0.5, seed: int = 0) -> DataFrame:
    """Rows judged right (1) or wrong (-1 becomes 0), unclear ones (0) dropped, split into train and validation."""
    d = df.where(F.col(label).isin(1, -1)).withColumn(label, F.when(F.col(label) == -1, 0).otherwise(F.col(label)))
    return S.split_by_share(d.dropna(subset=["transcript_clean"]), {"train": 1 - share, "validation": share}, seed=seed)


def annotation_candidates(triples: DataFrame, question: bool, n: int = 200, seed: int = 0) -> DataFrame:
    """n triples at random in which both sides repeat words and the response asks (or does not), without plain keyword cases."""
    u, r = F.col("utt_transcript_clean"), F.col("response_transcript_clean")
    d = R.with_repetition_ratios(triples.where(r.endswith("?") == F.lit(question)), "utt_transcript_clean", "response_transcript_clean")
    d = R.with_keyword_acknowledgement(d.where((F.col("rep_utt") > 0) & (F.col("rep_response") > 0)), "utt_transcript_clean", "response_transcript_clean")
    d = d.where(~R.is_speech_act_request(F.col("response_speech_act"), u) if question else ~F.col("response_is_keyword_acknowledgement"))
    return S.sample_rows(d, n, "index", seed)


def words_and_grammaticality(df: DataFrame, text: str = "transcript_clean") -> DataFrame:
    """n_words, is_grammatical, n."""
    return df.groupBy(num_unique_words(F.col(text)).alias("n_words"), "is_grammatical").agg(F.count(F.lit(1)).alias("n"))


def judgement(code: Column) -> Column:
    """A judgement as true (1), false (0 or -1, of two-valued and three-valued sheets) or null (unclear or none).

    code: a column of strings of the coding 1 / 0 / ?.
    """
    c = F.trim(code.cast("string"))
    return F.when(c == "1", True).when(c.isin("0", "-1"), False)


def manual_vs_derived(annotated: DataFrame, derived: DataFrame) -> DataFrame:
    """One row: n, agreement, kappa, mcc, precision, recall, f1 of derived judgements (row_id, is_grammatical) against manual ones, ungrammatical being the class sought."""
    d = annotated.select("row_id", judgement(F.col("is_grammatical")).alias("manual")).join(derived.select("row_id", F.col("is_grammatical").alias("derived")), "row_id")
    d = d.select((~F.col("manual")).alias("a"), (~F.col("derived")).alias("b"))
    return stats.agreement(d, "a", "b").crossJoin(stats.precision_recall(d, "a", "b").drop("n"))  # one row each


def joint_development(df: DataFrame, min_age: int = 10, max_age: int = 60, min_child_rows: int = 1) -> DataFrame:
    """Per transcript the children's shares of speech, of intelligible and of grammatical turns, each over the rows that the one before leaves."""
    d = A.more_than_child_rows(A.age_between(df, min_age, max_age), min_child_rows).where("speaker_code = 'CHI'")
    ok = F.coalesce(F.col("is_intelligible"), F.lit(False))
    d = d.withColumns({"intelligible": F.when(F.col("is_speech_related"), ok), "grammatical": F.when(F.col("is_speech_related") & ok, F.col("is_grammatical"))})
    return A.per_transcript(d.withColumn("speech", F.col("is_speech_related")), ["speech", "intelligible", "grammatical"])


def rater_agreement(df: DataFrame, unit: str, rater: str, value: str, first: str, second: str) -> DataFrame:
    """One row: n, agreement, kappa, mcc of two raters' values side by side, one value per unit and rater."""
    side = df.groupBy(unit).agg(F.max(F.when(F.col(rater) == first, F.col(value))).alias("a"), F.max(F.when(F.col(rater) == second, F.col(value))).alias("b"))
    return stats.agreement(side, "a", "b")
