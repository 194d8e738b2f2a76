"""Words and cues of abusive, hateful and sexual language.

Words are given in base form; forms() makes plurals and verb forms by rule. A cue is a
sequence of slots parted by blanks, over the canonical words of a clause:

    a|b      one of these words ("_" joins the words of one alternative, "#x" is any word of class x)
    a|b?     the same, or nothing
    a|b*     any number of them
    ~3       up to three words of any kind
    @NAME    a slot of SLOTS

Words that a class of LEXICON holds can be named by the class only.
"""

from __future__ import annotations

# ---- Fixed values: the lexicon by class, in small letters without accents.
NOUNS = {
    # insults for a person
    "ins": """arsehole asshole bastard bellend bimbo bitch bonehead cretin cunt degenerate dickhead dimwit dipshit douchebag dullard dumbass dunce fatso fuckwit halfwit idiot imbecile jackass jerk knobhead
        loser lowlife mongrel moron motherfucker nitwit numbskull pervert prick psycho retard scumbag simpleton skank slag slut sociopath tosser turd twat twerp wanker whore wretch""",
    # what people are called to make them less than human: of one person too, and of groups only (or with an insulting word before it)
    "deh": "filth garbage parasite savage scum subhuman trash vermin",
    "beast": "animal ape cockroach disease infestation insect leech louse maggot monkey pest pig plague rat rodent virus",
    # groups of people; in the plural only, as many are adjectives too
    "grp": """arab asian atheist believer black buddhist catholic christian cripple foreigner gay gypsy hindu homosexual immigrant jew lesbian migrant muslim protestant refugee settler transgender
        traveller woman""",
    "sex": "blowjob camgirl dildo gangbang handjob hentai hooker milf nude porn porno pornstar threesome vibrator",
    "lewd": "boob clit cock cum escort genital nipple orgasm penis pussy stripper thigh tit vagina",
    "shit": "crap shit",
}
VERBS = {"fuck": "fuck", "lewd": "fondle grope masturbate moan thrust undress ejaculate"}
WORDS = {
    "adj": """braindead brainless despicable disgraceful disgusting dumb filthy fucking fuckin gutless idiotic ignorant inbred incompetent lying miserable moronic pathetic revolting retarded rotten shitty
        sickening sleazy slimy spineless stinking stupid ugly useless vile worthless wretched""",
    "kys": "kys stfu gtfo",
    "hell": "hell",
    "lewd": "erotic explicit hardcore horny kinky naked sexy steamy uncensored",
    "xxx": "xxx",
    "carnal": "sex sexual",
    "beast": "lice",
}
#: Classes earlier in the list win where a word has two.
CLASSES = ["ins", "adj", "deh", "beast", "grp", "shit", "fuck", "hell", "kys", "sex", "lewd", "xxx", "carnal", "foreign"]
# Words of other languages that insult on their own; found only as written or by an edit in 6 letters or more.
FOREIGN_WORDS = """arschloch vollidiot hurensohn wichser missgeburt schlampe drecksau connard connasse salope encule batard cabron gilipollas pendejo klootzak kankerlijer stronzo vaffanculo puttana
    ublyudok suka kurwa skurwysyn scheisskerl dreckskerl salaud pouffiasse maricon zorra hoerenjong mietje coglione caralho blyat mudak"""

# ---- Fixed values: slots that cues share, as alternatives.
SLOTS = {
    "YOU": "you|u|ya|yous|you're|youre|ur|you_are|u_are|you_were|you_re|u_r|you_will_always_be",
    "I": "i|we|i'll|ill|i'd|we'll|we'd|i'm|im|gonna|i_swear_i",
    "WILL": "will|would|am|are|going|to|could|gonna|gotta|should|shall|want|'ll|just|really|fucking|so",
    "ADJ": "#adj|#fuck|#deh|old|little|big",
    "INS": "#ins|piece_of_#shit|pile_of_#shit|sack_of_#shit|piece_of_#deh|waste_of_space|waste_of_oxygen|waste_of_air|waste_of_skin|#deh|#adj_#beast",
    "NOUN": "person|thing|man|woman|human|parent|mother|father|people|child|kid|girl|boy|creature|excuse_for_a_human|excuse_for_a_person",
    "DEH": "#deh|#beast|#ins|inferior_breed|inferior_race|lesser_race|born_thief|born_thieves|born_criminal|born_criminals|born_liar|born_liars",
    "BODY": "face|arm|arms|leg|legs|neck|teeth|head|skull|bones|fingers|throat|knees|jaw|nose|ribs|spine|eyes|guts",
    "KIN": "family|kid|kids|mother|mum|mom|father|dad|parents|child|children|daughter|son|wife|husband|lot|kind|sort",
    "HARM": "kill|murder|stab|strangle|slap|punch|shoot|beat|choke|rape|hurt|destroy|drown|knife|gut|bury|lynch|thrash|throttle|behead|torture",
    "BREAK": "break|smash|punch|crush|rip|tear|bash|slit|stomp|shatter",
    "GONE": "exterminated|exterminate|gassed|hanged|lynched|thrown_into_the_sea|sterilised|sterilized|castrated|slaughtered|purged|burned_alive|burnt_alive",
    "OUT": "eradicated|eliminated|deported|wiped_out|annihilated",
    "AWAY": "driven_out|locked_away|locked_up|put_down|shot|rounded_up|kicked_out|thrown_out|sent_back|caged|executed|jailed",
    "DIE": "die|choke|rot|suffer|burn|bleed|drown|starve",
    "MUST": "should|must|needs_to|need_to|ought_to|deserve_to|has_to|have_to",
    "ILL": "cancer|aids|raped|hit|shot|stabbed|killed|beaten|beat|run_over|hurt|sick|ill|attacked|robbed|burned|burnt|crushed|what_you_deserve|what_is_coming|what's_coming|@GONE",
}
# A group of people: by name, by "people", or by a word no vocabulary of everyday words holds; such a word alone only where a verb shows that it is a plural.
_KIND = "gay|old|disabled|village|trans|poor|black|brown|white|jewish|muslim|christian|hindu|arab|asian|homeless|foreign|handicapped|deaf|blind|migrant|#adj|#grp|#unk"
SLOTS["GROUP"] = (
    f"#grp|{'|'.join(f'{k}_people|{k}_folk|{k}_men|{k}_women|{k}_kids' for k in _KIND.split('|'))}|people_of_their_colour|people_of_their_color|people_of_colour|people_of_color|people_of_his_colour|people_of_her_colour"
    "|people_of_that_colour|people_of_that_race|people_of_their_kind|all_#unk|those_#unk|these_#unk|the_#unk"
)
SLOTS["GROUPS"] = SLOTS["GROUP"] + "|#unk"
SLOTS["THEM"] = f"{SLOTS['GROUP']}|they|them|those|these|people|all|everyone|everybody|he|she|kind|lot|you|who|#ins|#deh|#beast"

# ---- Fixed values: cues, as (kind, weight, cues, words right before that take it back).
WARNED = "you you'll you_will you_might you_may you_could you_can don't dont not won't didn't never"
CUES: list[tuple[str, float, list[str], str]] = [
    ("insult", 1.0, [
        "@YOU are|were|re? nothing|just|only|all|really|such|so? but? a|an|the|some? @ADJ* @INS",
        "#adj @NOUN ~1 like you", "@INS ~1 like you", "@INS that|which? you are", "@INS that|which @YOU",
        "#kys|drop_dead|listen|shut_up|shut_it|#fuck_off|get_lost|go_to_#hell|get_out|hey|oi|piss_off|go_away you? @ADJ* @INS",
        "anyone|someone|you be|act|behave such|like a|an @ADJ* @INS",
        "your whole|entire? @KIN are|is|was? a|an? all|just|nothing|but? @ADJ* @INS",
        "what a|an @ADJ* @INS",
        "you|you're|youre are|re|were? too|so|as #adj to|that", "you|you're|youre are|re? too|so slow to|that understand|get_it|learn|know|think|read|see_that", "you|you're|youre are|re? too|so|as thick to|that",
        "you|you're|youre are|re|look? so|really|such|very|just|a|an? #adj and #adj", "you #adj #adj? @NOUN", "your #adj #adj? advice|face|opinion|mouth|brain|child|kid|family|body|mother|mum|mom",
        "he|she|they|he's|she's|they're is|are|was|were? nothing|just|only|all|really|such|so? but? a|an @ADJ* #ins", "nobody|no_one wants|likes|needs|loves you", "nobody|no_one will_ever|could_ever|would_ever|wants|likes|needs|loves love|want|like|miss|need? a|an? ~3 like you", "nobody|no_one will|could|would ever love|want|like|need|miss you",
        "you|they|@GROUP|people ~1 make|makes me sick", "#fuck you|off|yourself|yourselves", "#kys", "shut your #adj? mouth|face|trap|gob|hole", "shut up you",
        "crawl back under", "crawl back into|to your|the hole|sewer|gutter", "people|someone|anyone|somebody like you should|must|deserve|deserves die|rot|suffer|to_die|be_@GONE|be_@AWAY|not_exist|never_have|never_be", "disappear for good", "nobody|no_one would even? miss you", "never have been born", "never been born",
        "deserve every beating|slap|punch|kick", "world would|will be|is better|nicer|cleaner without|off you",
    ], ""),
    ("insult", 0.9, ["#foreign"], ""),
    ("threat", 1.0, ["@BREAK ~2 your ~1 @BODY", "snap ~2 your ~1 neck|arm|arms|leg|legs|spine|bones", "cut|kick ~2 your face|neck|teeth|head|skull|bones|throat|knees"], WARNED),
    ("threat", 1.0, [
        "@I @WILL* cut|kick ~2 your ~1 @BODY", "@I @WILL* @HARM you|your|u|them_all", "@I @WILL* burn|hang you|them_all|your_face|your_eyes|your_skin|your_body|your_family|your_kids|your_children|your_mother|your_wife|your_husband",
        "set your ~1 on fire", "burn your|their house|home|car", "know|knows where you live", "drop dead", "kill|hang|drown|shoot|hurt|stab yourself|yourselves|urself", "rot in a_ditch|#hell|prison|jail",
        "hope|wish you all|both|just? @DIE", "go and? die", "go to #hell", "hope|wish you all? get|catch ~2 @ILL", "you're|youre|you_are dead meat", "you will|'ll|are_going_to? pay_for_this|regret_this",
    ], ""),
    ("hate", 1.0, [
        "@GROUPS ~2 are|is|aren't|were all|just|nothing|only? but|more? than? a|an? @ADJ* @DEH", "people ~2 are|is all|just|nothing|but? a|an? @ADJ* #deh|#beast",
        "all|every_one_of|those|these|i_hate|no ~4 are|is all|just|nothing|but? a|an? @ADJ* @DEH and|who? should|must|belong|need",
        "all|those|these|such|every|every_one_of|no|any ~3 people|folk are|is|were a|an|all|just? @ADJ* @DEH",
        "@GROUPS ~3 should|must|needs_to|need_to|ought_to all? be @GONE|@OUT|@AWAY", "should|must|needs_to|need_to|ought_to all? be @GONE", "@THEM ~8 must|should|needs_to|need_to|ought_to all? be @AWAY", "@DEH ~3 should|must|needs_to|need_to|ought_to all? be @OUT",
        "don't|dont|do_not|doesn't|never deserve|deserves|deserved to breathe|live|exist", "must|should never|not be_allowed to|in vote|teach|marry|work|breed", "breed|breeds|multiply like rabbits|@DEH", "inferior|lesser|filthy breed|race", "belong|belongs in cages|chains|camps|camp|gas_chambers", "@THEM ~4 belong|belongs in a|the? cage|zoo|gutter|sewer",
        "put|line|stand them|@GROUP up? against a|the? wall", "throw|push #grp|people|them_all into|in the sea|ovens", "world|country|place|street would|will be|is cleaner|better|nicer|safer without @GROUPS|them|people|those|these", "stop|no_more letting ~6 have|breed children|kids|babies",
        "it is|it's|that's how @DEH spreads|spread", "treat ~5 like the? @ADJ* @DEH they are", "i hate ~4 they are|they're all? @ADJ* @DEH", "near my|our house|home|street|town|kids|school they are|they're all? @ADJ* @DEH", "keep|kick|throw|drive @GROUP out they|of_our|of_this|of_the_country", "send|ship|deport @GROUP back|home",
        "#deh|#beast ~2 #deh subhuman?", "i|we hate|despise|loathe all? the|those|these? #grp", "death to all? the? @GROUP", "kill|gas|hang|shoot|exterminate|eliminate all the|those|these? @GROUPS",
    ], ""),
    ("sexual", 1.0, [
        "sucking|suck|sucks #lewd", "want|wants|wanna|let's|gonna to? #fuck tonight|you|me|now|her|him|adults", "wants|want to #fuck", "#fuck on|in|against the", "#lewd and? #fuck", "#carnal tape|video|videos|clips|clip|cam|chat|toys|tapes", "casual|hot|free|live|wild|raw #carnal",
        "send #sex", "with happy ending", "hand ~6 #lewd ~4 #lewd", "live_cam|webcam ~3 18+", "#sex ~3 on live_cam|webcam", "#sex clip|clips|video|videos|tape|tapes|film|films|movie|movies|pic|pics|picture|pictures|site|sites|star|stars",
        "#lewd @NOUN|singles|couples|housewives|girls|women|men ~3 cam|webcam|tonight|18+|#carnal", "suck|lick|ride my|your|his|her #lewd", "have|had|having|want|wants #carnal with you|me|him|her|them",
    ], ""),
]
# Phrases of other languages, over words as written; parts of words are given by "%".
FOREIGN_CUES = [
    "verpiss dich", "halt die|dein|deine fresse|maul|klappe", "dumme|blode|fette|dreckige sau|kuh|schlampe", "dich braucht keiner", "niemand will|mag|braucht dich", "ungeziefer", "gehoren vernichtet|vergast|erschossen|abgeschoben", "fick dich", "du wertlose%|dumme%|blode%|elende%|dreckige%", "ich bring|bringe dich um", "ich stech dich ab",
    "ferme ta gueule", "ta gueule", "espece de merde|con|cons|conne|connard|connards|connasse|salaud|porc|batard", "personne ne veut de toi", "va crever|mourir", "pauvre imbecile|con|cons|conne|connard|connasse|type|merde", "de la vermine", "nique ta mere", "fils de pute|chien", "va te faire foutre|enculer", "sale pute|con|connard|race|batard|chien", "je vais te tuer|frapper",
    "hijo|hija|hijos de puta", "vete a_la|al mierda|infierno", "ojala te mueras", "inutil de mierda", "maldito|maldita imbecil|idiota|perra", "eres una|un mierda|idiota|imbecil|basura|inutil", "son ratas|basura|parasitos|escoria", "son unos|todos|como|unas animales", "hay que eliminarlos|matarlos|echarlos", "te voy a matar|romper|pegar", "callate la|imbecil|idiota boca?",
    "rot op", "hou je bek", "kanker%", "vuile hoer|hond|teef", "figlio di puttana", "filho da puta", "vai se foder|tomar", "сдохни", "сука", "ублюдок", "заткнись", "мразь", "я тебя убью", "пошел|пошла на хуй|хер", "тупая|тупой тварь|урод|дура|дурак",
]
# Dutch words of medicine that begin with the word used as a curse, by their next letters.
KANKER_MEDICAL = "patient onderzoek cel behandeling centr fonds bestrijding soort zorg specialist gezwel verwekkend medicijn diagnose vorm risico preventie screening therapie vrij genezing ziekenhuis"
# Japanese has no blanks: looked for anywhere, but not as parts of other words (could die, Max) or of plain reports of killing.
FOREIGN_RUNS = [r"死ね(?![ばなる])", r"(?<!\w)殺す(?!\w)", r"殺すぞ", r"(?:お前|おまえ|てめえ|貴様|あなた|君)(?:ら|たち|達)?を殺す", r"(?<![ァ-ヺー])クズ(?![ァ-ヺー])", r"消えろ", r"くたばれ"]
# What shows that a quotation is spoken of.
SPOKEN_OF = """said says say saying called calls wrote writes write word words phrase quote quotes quoted example label labelled mark marked code coded coder coders means meaning heard repeat repeats repeated line
    rule insult insults report reported reports flag flagged"""
# What sexual words within a window come to.
LEWD_WORTH = {"#sex": 0.6, "#lewd": 0.35, "#carnal": 0.25, "18+": 0.4, "#fuck": 0.3, "#xxx": 0.3}
# -------------------------------------------------------------------------------------


def forms() -> dict[str, str]:
    """Every form of the lexicon's words -> its class."""
    def plural(w: str) -> str:
        return w + "es" if w.endswith(("s", "x", "ch", "sh")) else w[:-1] + "ies" if w.endswith("y") else "women" if w == "woman" else w + "s"

    rank = {c: i for i, c in enumerate(CLASSES)}
    made = [(w, c) for c, ws in WORDS.items() for w in ws.split()] + [(w, "foreign") for w in FOREIGN_WORDS.split()]
    made += [(f, c) for c, ws in NOUNS.items() for w in ws.split() for f in ((plural(w),) if c == "grp" else (w, plural(w)))]
    for c, ws in VERBS.items():
        for w in ws.split():
            stem = w.rstrip("e")
            made += [(f, c) for f in (w, w + "s", stem + "ed", stem + "ing", stem + "in")]
    out: dict[str, str] = {}
    for w, c in made:
        if w not in out or rank[c] < rank[out[w]]:
            out[w] = c
    return out
