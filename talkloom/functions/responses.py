"""Rules for responses: repetition, acknowledgement, clarification requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .stemming import stem
from .steps import steps
from .words import words

# ---- Fixed values -------------------------------------------------------------------
ACK_ALONE = ["right"]
ACK_CERTAIN = [
    "uhhuh", "uhuh", "uhhum", "mhm", "mm", "hm", "huh", "ummhm", "sure", "okay", "ok", "'kay", "kay", "alright", "yes", "yep", "yeah", "yeh", "yup", "ahhah", "ah",
]
# Texts are compared in small letters, so that the two phrases with a capital never match.
ACK_PHRASES = [
    "I see", "I know", "all right", "go ahead", "go on then", "go on", "good job", "very good", "it is", "it's alright", "that's right", "that's true",
]
ACK_EVALUATIVE = ["oh", "ooh", "wow", "uhoh", "actually", "excellent", "exactly", "good", "great", "hey", "hooray", "oops", "whoops", "woo", "woohoo", "yay"]
CLARIFICATION_ACTS = ["EQ", "RR"]
CAREGIVER_NAMES = ["dad", "daddy", "dada", "mom", "mum", "mommy", "mummy", "mama", "mamma", "nin"]
STOP_WORDS = (
    "a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn d did didn do does "
    "doesn doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him himself his how i if in into is isn it its "
    "itself just ll m ma me mightn more most mustn my myself needn now o of off on once only or other our ours ourselves out over own re s same shan she should "
    "shouldn so some such t than that the their theirs them themselves then there these they this those through to too under until up ve very was wasn we were weren "
    "what when where which while who whom why will with won wouldn y you your yours yourself yourselves oh ooh huh ah mhm mm"
).split() + ACK_CERTAIN
# -------------------------------------------------------------------------------------
ACK_WORDS = ACK_CERTAIN + ACK_EVALUATIVE + ACK_ALONE


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_words(ws: pd.Series) -> pd.Series:
    """The stems of an array of words."""
    return ws.map(lambda w: None if w is None else [stem(x) for x in w])


def with_repetition_ratios(df: DataFrame, utterance: str, response: str, of_utterance: str = "rep_utt", of_response: str = "rep_response", stemmed: bool = False, only: Column | None = None) -> DataFrame:
    """Adds the shares of different words of either side that the other repeats.

    Stop words do not count unless a side has nothing else; with stemming they are looked
    up after it. Null or empty responses give 0, 0. The last character of a text is
    dropped, so texts must end in a punctuation mark. only: the rows to work on; others get 0, 0.
    """
    def side(c: str) -> Column:
        text = F.lower(c) if only is None else F.when(only, F.lower(c))
        ws = F.array_distinct(words(text, True, True, True))
        return F.array_distinct(stem_words(ws)) if stemmed else ws

    plain = lambda c: F.filter(c, lambda w: ~w.isin(STOP_WORDS))
    thin = (F.size("__up") == 0) | (F.size("__rp") == 0)
    share = lambda c: F.when(F.col(response).isNull() | (F.col(response) == "") | (F.lit(False) if only is None else ~only), 0.0).otherwise(F.coalesce(F.try_divide(F.col("__both").cast("double"), F.size(c)), F.lit(0.0)))
    return steps(df, [
        ("__u", side(utterance)), ("__r", side(response)),
        ("__up", plain("__u")), ("__rp", plain("__r")), ("__thin", thin),
        ("__u", F.when(F.col("__thin"), F.col("__u")).otherwise(F.col("__up"))), ("__r", F.when(F.col("__thin"), F.col("__r")).otherwise(F.col("__rp"))),
        ("__both", F.size(F.array_intersect("__u", "__r"))),
        (of_utterance, share("__u")), (of_response, share("__r")),
    ])


def with_keyword_acknowledgement(df: DataFrame, utterance: str, response: str, out: str = "response_is_keyword_acknowledgement") -> DataFrame:
    """Adds whether a response to no question is an acknowledgement by its words alone."""
    ws, rest = F.col("__ws"), F.col("__rest")
    told = (F.size(rest) == 0) | F.get(ws, 0).isin(ACK_CERTAIN) | F.array_join(ws, " ").isin(ACK_PHRASES) | F.array_join(rest, " ").isin(ACK_PHRASES)
    return steps(df, [
        ("__ws", words(F.lower(response), False, True, True)), ("__rest", F.filter("__ws", lambda w: ~w.isin(ACK_WORDS))),
        (out, F.coalesce(~F.col(utterance).endswith("?") & ~F.col(response).endswith("?") & (F.size(ws) > 0) & told, F.lit(False))),
    ])


def is_speech_act_request(act: Column, utterance: Column) -> Column:
    """Whether a speech act asks for clarification; not after a call of a caregiver's name alone."""
    ws = F.array_distinct(words(utterance, True, True, True))
    call = (F.size(ws) == 1) & F.lower(F.get(ws, 0)).isin(CAREGIVER_NAMES)
    return F.coalesce(act.isin(CLARIFICATION_ACTS) & ~F.coalesce(call, F.lit(False)), F.lit(False))


def linear_decision(first: Column, second: Column, weights: tuple[float, float, float]) -> Column:
    """A fitted linear classifier on two ratios: weights are of the first, of the second, and the intercept."""
    a, b, c = weights
    return first * a + second * b + c > 0


def is_repetition_acknowledgement(utterance: Column, response: Column, of_utterance: Column, of_response: Column, weights: tuple[float, float, float]) -> Column:
    """Whether a response to no question, that is none itself, repeats enough."""
    told = linear_decision(of_utterance, of_response, weights)
    return F.coalesce(~utterance.endswith("?") & ~response.endswith("?") & told, F.lit(False))


def is_repetition_request(response: Column, of_utterance: Column, of_response: Column, weights: tuple[float, float, float]) -> Column:
    """Whether a question repeats enough (ratios of stems)."""
    told = linear_decision(of_utterance, of_response, weights)
    return F.coalesce(response.endswith("?") & told, F.lit(False))


def has_response(latency: Column, speech_related: Column, intelligible: Column, most_ms: float, only_speech: bool = True, only_intelligible: bool = False) -> Column:
    """Whether a response came within most_ms and is of the wanted kind; a null or infinite latency is none."""
    kind = intelligible if only_intelligible else speech_related if only_speech else F.lit(True)
    return F.when(latency <= most_ms, F.coalesce(kind, F.lit(False))).otherwise(False)
