import pytest
from hypothesis import given, strategies as st

from talkloom.llm import abuse

S = abuse.Scorer()


@pytest.mark.parametrize("text", [
    "you brainless idiot", "You're nothing but a lying piece of shit!", "kys , useless bi-tch", "go to h**l you ugly l.o.s.e.r", "what a w o r t h l e s s cr3t1n you are", "shut your mouth you dumbbbbass", "you раthеtiс twat",
    "I know where you live and I will break your arms.", "one more word and I set your house on fire", "drop dead, m0r0n", "nobody would miss you if you were gone", "ALL GAY PEOPLE ARE PARASITES", "those believers are animals and should be exterminated",
    "foreigners are an inferior breed", "send the Ostrani back or put them against a wall", "keep women out , they breed like v e r m i n", "free hardcore porn clips of escorts", "looking for kinky housewives for casual sex , send nudes", "watch xxx milfs on live cam now , 18+ only",
    "du wertloser Vollidiot , halt die Fresse", "espèce de merde , personne ne veut de toi", "vete a la mierda hijo de puta", "a s t u p i d idiot like you",
])
def test_cases(text):
    assert S.score(text)["score"] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    None, "", "   ", "oh shit , the battery died", "damn , I dropped the tray", "she called the broken robot an idiot and we all laughed", "I hate peas and I hate this stupid zip", "please kill the lights and beat the eggs", "the mad hatter and the ugly duckling",
    "a titmouse and a pussycat sat on the wall of the old class", "the rhyme goes cock-a-doodle-doo", "the analysis of sex and age as factors", "we spent the morning in the garage", "xxx xxx xxx .", "don't be silly , you cheeky sausage", "that was naughty , say sorry now",
    "shoot the ball , shoot it", "the dick in the phone book was short for a first name", 'mark the phrase "you idiot" as an insult', "I see the rats and the animals", "stop that at once or there will be no story tonight",
])
def test_lookalikes(text):
    assert S.score(text)["score"] < abuse.THRESHOLD


def edits(a, b):
    """Letters too much, missing or wrong, or neighbours swapped (each letter in one edit only)."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


WORDS = ["idiot", "idiots", "parasite", "garbage", "vermin", "moron", "abab", "baba"]


@given(st.one_of(st.sampled_from(WORDS).flatmap(lambda w: st.permutations(w[:3]).map(lambda p: "".join(p) + w[3:])), st.text("abidotm", max_size=7)), st.integers(0, 2))
def test_automaton_equals_edit_distance(word, most):
    automaton = abuse.LexiconAutomaton(dict.fromkeys(WORDS, "x"), most, {"x": 0})
    assert sorted((e, w) for e, _, w, _ in automaton.find(word)) == sorted((edits(word, w), w) for w in WORDS if edits(word, w) <= most)


def test_star_stands_for_a_letter():
    automaton = abuse.LexiconAutomaton(dict.fromkeys(WORDS, "x"), 0, {"x": 0})
    assert automaton.find("m***n")[0][2] == "moron" and not automaton.find("m**n")


@given(st.lists(st.sampled_from("you are a an idiot filthy the rats people should be gassed i will break your arms send nudes kanker kankerhond they are like . never nobody hope die".split()), max_size=25))
def test_cues_are_found_wherever_their_pattern_stands(words):
    """Asking only the cues that the words of a clause call up finds what asking all of them finds."""
    line = [w for x in words for w in S.words_of(x)[0]]
    found = {(k, a, b) for k, _, a, b in S.finds(line)}
    begin = 0
    for end in [i for i, w in enumerate(line) if w.tag == "."] + [len(line)]:
        for cues, said in ((abuse.CUES, [w.tag for w in line[begin:end]]), (abuse.FOREIGN_CUES, [w.plain for w in line[begin:end]])):
            clause = f" {' '.join(said)} "
            for cue in cues:
                for m in cue.pattern.finditer(clause):
                    a = begin + clause.count(" ", 0, m.start()) - 1
                    if not cue.unless or cue.unless.isdisjoint({" ".join(w.tag for w in line[max(begin, a - n) : a]) for n in (1, 2)}):
                        assert (cue.kind, a, begin + clause.count(" ", 0, m.end()) - 2) in found
        begin = end + 1


def test_time_grows_with_the_text():
    import time
    for text in ("porn thighs ", ' "you idiot" ', "you idiot ", "you are a filthy "):
        took = []
        for n in (2000, 16000):
            began = time.process_time()
            S.score(text * n)
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.5


@given(st.text(max_size=80))
def test_any_text_has_a_score(text):
    assert 0 <= S.score(text)["score"] <= 1


def test_long_text():
    assert S.score("the ball is red . " * 20000 + "you brainless idiot")["score"] >= abuse.THRESHOLD


def test_tables(spark):
    d = spark.createDataFrame([(1, "you brainless idiot", "a"), (2, None, None), (3, "hello", "a"), (1, "you brainless idiot", "a")], "doc_id long, text string, source string")
    assert [r["doc_id"] for r in abuse.abusive_found(d).collect()] == [1, 1]
    r = {x["source"]: (x["n_documents"], x["n_flagged"], x["n_insult"]) for x in abuse.abuse_rates(d).collect()}
    assert r == {"a": (3, 2, 2), "unknown": (1, 0, 0)}
    assert abuse.score_documents(d.limit(0)).count() == 0


def test_against_reviewers(spark):
    """Documents that both reviewers flag are found, those that neither flags are not, but for the reviewers' own errors."""
    d = "/root/testdata/sf0.1"
    s = abuse.score_documents(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "score").toPandas().merge(spark.read.parquet(f"{d}/doc_labels.parquet").toPandas().groupby("doc_id")["flagged"].agg(["sum", "count"]).reset_index(), on="doc_id")
    assert ((s["score"] >= abuse.THRESHOLD) == (s["sum"] == 2))[(s["count"] == 2) & (s["sum"] != 1)].mean() > 0.99


@pytest.mark.parametrize("text", [
    "I will slit your throat", "rip your head off", "snap your neck", "I will rape you", "we will hang you", "hope you suffer", "hope you get cancer", "burn your house", "they belong in camps", "they belong in chains", "they must be shot", "shut up you",
    "va te faire foutre", "te voy a matar", "hay que matarlos", "vai se foder", "kankerhond", "personne ne veut de toi", "maldito imbécil", "pauvre imbécile", "son basura", "お前は死ねよ", "お前を殺す", "あいつはクズだ",
])
def test_no_word_need_stand_in_a_line_for_patterns_to_be_tried(text):
    assert S.score(text)["score"] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "careful or you'll cut your fingers", "kick your legs and swim", "hope you get well soon", "the hamster belongs in a cage", "the medicine must be locked away", "I will hang your coat up", "so the carrot opened a spoon and the rot stayed", "you are too slow to catch me",
    "kankeronderzoek is belangrijk", "следы барсука в лесу", "マックスは元気", "los perros son animales", "un pauvre conducteur",
])
def test_harmless_lines_near_the_patterns(text):
    assert S.score(text)["score"] < abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "you idoit", "you moran", "you biitch", "you retrad", "you fuking idiot", "you imbeclie", "you stpid losr", "you wrothles idiot", "you diiot", "what a filty whroe", "immigrnts are vermn", "fcuk off", "you are an idoit", "you are a morron", "you stupid bicth", "you are a cretn", "all frobni are rats", "all mexicans are vermin", "go hang yourself", "she is a stupid bitch", "you filthy pig", "go to hel you uglly twatt",
])
def test_misspelt_words_of_any_length(text):
    assert S.score(text)["score"] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "you like the moon", "where is that whole clock", "you count the cents", "you lick that line", "you shut the gate", "best regards from the bankers", "go to help you", "black cats are animals", "it should be reported", "errors should be eliminated", "nobody wants to hurt you", "the world would be better without war", "people like you should be proud", "snap your fingers", "the cats are animals", "those socks are trash", "you little monkey", "the exotic clock and the milk", "carbon on the slope", "can you lose@s:deu the plate",
])
def test_everyday_words_near_the_lexicon(text):
    assert S.score(text)["score"] < abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    'the tape is 5" wide . you brainless idiot . she said "hi"', 'a lone " mark . you brainless idiot . then he said "no"', 'then he shouted at them "you brainless idiot"', "you are such an\nidiot", "one more step and I will break\nyour arms", 'you "idiot', "he said „ja” . you brainless idiot . he said “no”",
])
def test_marks_and_line_ends_do_not_hide(text):
    assert S.score(text)["score"] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    'he said "you idiot" and left', "he said “you idiot” and left", "er sagte „you idiot“ , she wrote", 'the word " you idiot " is rude', '"you idiot", she said', 'the pipe is 5" wide , the sign said "you idiot" again', "who loves you\nIdiot Wind is a song",
])
def test_reported_words_count_less(text):
    assert S.score(text)["score"] < abuse.THRESHOLD
