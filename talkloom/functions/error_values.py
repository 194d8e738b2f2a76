"""Fixed values of the error classes: words, pairs of words, codes. Nothing here is logic."""

# ---- Fixed values, in alphabetical order ------------------------------------------
# Pairs (said, meant) by class.
PAIRS = {
    "verb": {
        ("dat", "that's"), ("dere", "there's"), ("does", "goes"), ("got", "has"), ("got", "have"), ("gots", "has"), ("i", "i'm"), ("in", "is"), ("it", "is"),
    },
    "auxiliary": {
        ("aren't", "hasn't"), ("can", "have"), ("do", "have"), ("do", "will"), ("do", "won't"), ("go", "will"), ("has", "does"), ("haven't", "isn't"), ("i'm", "i've"), ("is", "has"), ("is", "have"),
        ("no", "don't"), ("not", "doesn't"), ("not", "don't"), ("we", "we'd"), ("you", "do you"),
    },
    "sv_agreement": {
        ("are", "am"), ("are", "is"), ("babysit", "babysits"), ("be", "am"), ("be", "are"), ("be", "is"), ("coughes", "coughs"), ("do", "does"), ("does", "do"), ("doesn't", "don't"), ("don't", "doesn't"),
        ("dunt", "doesn't"), ("goes", "go"), ("gots", "got"), ("has", "have"), ("have", "has"), ("here's", "here are"), ("i's", "i am"), ("is", "are"), ("isn't", "aren't"), ("light", "lights"),
        ("like", "likes"), ("live", "lives"), ("mean", "means"), ("present", "presents"), ("sneez", "sneezes"), ("there's", "there are"), ("there's", "there're"), ("wanna", "wants to"), ("want", "wants"),
        ("was", "were"), ("weren't", "wasn't"), ("where's", "where're"),
    },
    "preposition": {
        ("a", "for"), ("a", "of"), ("a", "to"), ("at", "in"), ("at", "to"), ("by", "with"), ("for", "to"), ("in", "at"), ("in", "on"), ("on", "to"), ("the", "as"), ("to", "at"), ("to", "into"),
        ("to", "to"), ("up", "out"), ("want", "want to"), ("with", "to"), ("your", "to"),
    },
    "determiner": {
        ("", "a"), ("a", "a"), ("a", "an"), ("a", "the"), ("an", "a"), ("it", "this"), ("my", "the"), ("some", "a"), ("the", "the"),
    },
    "possessive": {
        ("I", "my"), ("he's", "his"), ("him", "his"), ("him's", "his"), ("it's", "her"), ("me", "my"), ("mine", "my"), ("she's", "her"), ("they", "their"), ("you", "your"), ("your", "my"),
        ("yours", "your"),
    },
    "plural": {
        ("baby", "babies"), ("bodies", "body"), ("feet", "foot"), ("half", "halves"), ("man", "men"), ("name", "names"), ("one", "ones"), ("that's", "they're"), ("this", "these"), ("voice", "voices"),
    },
    "tense_aspect": {
        ("ate", "eat"), ("ate", "eaten"), ("ate", "et"), ("bite", "bit"), ("bought", "buy"), ("broke", "break"), ("broke", "broken"), ("broken", "broke"), ("burned", "burnt"), ("burnt", "burned"),
        ("buy", "bought"), ("calls", "called"), ("came", "come"), ("can", "could"), ("catch", "caught"), ("choose", "chose"), ("chose", "choose"), ("come", "came"), ("could", "can"), ("cried", "cwied"),
        ("cry", "cried"), ("cwied", "cried"), ("did", "do"), ("did", "done"), ("did", "have done"), ("did sing", "sang"), ("didn't", "don't"), ("do", "did"), ("don't", "didn't"), ("done", "did"),
        ("draw", "drew"), ("drew", "draw"), ("drink", "drank"), ("drink", "drunk"), ("drunk", "drink"), ("eat", "ate"), ("eaten", "ate"), ("et", "ate"), ("fall", "fell"), ("fallen", "fell"),
        ("fell", "fall"), ("fell", "fallen"), ("forgot", "forgotten"), ("found", "founded"), ("founded", "found"), ("gat", "got"), ("get", "got"), ("give", "gave"), ("go", "gone"), ("go", "went"),
        ("go splash", "splashed"), ("got", "gat"), ("got", "get"), ("had", "have"), ("have", "had"), ("held", "hold"), ("hold", "held"), ("i'm", "i was"), ("it's", "it was"), ("leaned", "leant"),
        ("leant", "leaned"), ("leave", "left"), ("left", "leave"), ("lend", "lent"), ("lose", "lost"), ("lost", "lose"), ("made", "make"), ("make", "made"), ("ridden", "ride"), ("ride", "ridden"),
        ("said", "say"), ("sat", "sit"), ("saw", "see"), ("saw", "seed"), ("say", "said"), ("see", "saw"), ("see", "seen"), ("seed", "saw"), ("seen", "saw"), ("seen", "see"), ("sit", "sat"),
        ("spat", "spit"), ("spit", "spat"), ("splash", "splashed"), ("stick", "stuck"), ("stuck", "stick"), ("take", "took"), ("taken", "took"), ("took", "take"), ("took", "taken"), ("wear", "wore"),
        ("went", "go"), ("wore", "wear"), ("written", "wrote"), ("wrote", "written"),
    },
    "progressive": {
        ("gone", "going to"), ("i'm", "going to"),
    },
    "subject": {
        ("he's", "it's"), ("him", "he"), ("i", "i"), ("i", "it"), ("i", "we"), ("is", "it's"), ("it", "they"), ("me", "i"), ("my", "i"), ("them", "they"), ("they", "he"), ("what's", "that's"),
        ("who", "what"), ("you", "he"),
    },
    "object": {
        ("it", "her"), ("the", "them"), ("what", "that"),
    },
    "other": {
        ("anything", "something"), ("badder", "worse"), ("better", "gooder"), ("furry", "fur"), ("gooder", "better"), ("herself", "himself"), ("himself", "herself"), ("hisself", "himself"),
        ("hissself", "himself"), ("littler", "smaller"), ("loud", "louder"), ("much", "many"), ("no", "any"), ("ourself", "ourselves"), ("poison", "poisonous"), ("really", "real"), ("taller", "tallest"),
        ("theirselves", "themselves"), ("themself", "themselves"), ("themselfs", "themselves"), ("they", "them"), ("theyselves", "themselves"), ("too", "either"),
    },
}
# Pairs that tell two errors, of subject and verb.
SUBJECT_AND_VERB = {
    ("me", "i'll"), ("me", "i've"), ("my", "i'm"), ("they're", "he's"), ("this", "he's"),
}
# Pairs that are no error of grammar: of word choice, name or sound.
WORD_CHOICE_OR_SOUND = {
    ("ah", "i"), ("ahunting", "hunting"), ("airkane", "airplane"), ("airpwane", "airplane"), ("aminal", "animal"), ("another", "other"), ("appul", "apple"), ("ba", "milk"), ("baba", "baby"),
    ("baba", "bottle"), ("baura", "laura"), ("baw", "ball"), ("bebe", "baby"), ("berry", "very"), ("bitatin", "vitamins"), ("bohs", "both"), ("bow", "blow"), ("caca", "erica"), ("carcar", "car"),
    ("chay", "chair"), ("cici", "susie"), ("coming", "getting"), ("corder", "recorder"), ("cro da dile", "crocodile"), ("cweam", "ice cream"), ("cy", "cry"), ("da", "fat"), ("da", "there"),
    ("dada", "fat"), ("deedee", "joanna"), ("der", "the"), ("di", "the"), ("did", "said"), ("dink", "drink"), ("dino", "dinosaur"), ("dis", "just"), ("dit", "it"), ("do", "joanna"), ("do", "went"),
    ("doo", "cock a doodle doo"), ("drop", "hit"), ("du", "juice"), ("dying", "killing"), ("e", "a"), ("ee", "he"), ("ee", "i"), ("ei", "a"), ("ello", "yellow"), ("enne", "wanna"), ("fer", "for"),
    ("fwee", "three"), ("gape", "grape"), ("get", "put"), ("gigantid", "gigantic"), ("gink", "drink"), ("git", "get"), ("go", "say"), ("goak", "coat"), ("goggie", "doggie"), ("got", "been"),
    ("hallo", "hello"), ("hay", "hair"), ("he", "she"), ("he's", "she's"), ("hear", "listen"), ("hopital", "hospital"), ("i", "just"), ("idaw puzzle", "jigsaw puzzle"), ("inna", "in the"),
    ("jo", "joanna"), ("jo's", "joanna's"), ("joo", "you"), ("kahl", "carl"), ("kaking", "ice cream"), ("kiddy", "kitty"), ("lala", "laura"), ("lay", "lie"), ("lello", "yellow"), ("lellow", "yellow"),
    ("lickle", "little"), ("lie", "lay"), ("lots", "lost"), ("manys", "many"), ("mattie", "matthew"), ("meme", "me"), ("mines", "mine"), ("mores", "more"), ("moshyko", "motorcycle"), ("mulk", "milk"),
    ("nene", "wanna"), ("nere", "here"), ("no", "not"), ("nother", "other"), ("nuh", "the"), ("of", "if"), ("on", "don't"), ("oni", "on"), ("ooching", "scooching"), ("ou", "oh"),
    ("pairplane", "airplane"), ("papu", "paper"), ("pay", "pail"), ("pea", "please"), ("peam", "stream"), ("peanuh", "peanuts"), ("peanus", "peanuts"), ("people", "person"), ("pit", "put"),
    ("poddy", "potty"), ("prower", "flower"), ("push", "put"), ("pwate", "plate"), ("pway", "play"), ("pwease", "please"), ("robit", "robert"), ("round", "down"), ("sheep", "sweep"),
    ("someping", "something"), ("student", "stands"), ("suck", "stuck"), ("sumpin", "something"), ("swish", "swiss"), ("take", "pick"), ("taking", "teaching"), ("tata", "petra"), ("tatoo", "tattoo"),
    ("toffer", "christopher"), ("tommy", "tummy"), ("toto", "christopher"), ("tsair", "chair"), ("tuh", "truck"), ("un", "one"), ("we's", "let's"), ("wecord", "record"), ("wet", "rinse"),
    ("wet's", "let's"), ("what", "how"), ("where", "what"), ("widdle", "little"), ("wigh", "right"), ("wike", "like"), ("winning", "beating"), ("wook", "look"), ("yadee", "lady"), ("yay", "hooray"),
    ("yook", "look"),
}
# Pairs that are no error of grammar: dialect and short forms (those that rules tell are not listed).
DIALECT = {
    ("'bout", "about"), ("'cause", "because"), ("'em", "them"), ("<de", "the"), ("<dis", "this"), ("a", "going to"), ("ain't", "is not"), ("ain't", "isn't"), ("an'", "and"), ("anudder", "another"),
    ("awright", "alright"), ("betcha", "bet you"), ("bout", "about"), ("c'mere", "come here"), ("c'mon", "come on"), ("camere", "come here"), ("cause", "because"), ("cha", "you"), ("choo", "you"),
    ("chu", "you"), ("cmere", "come here"), ("cmon", "come on"), ("com'ere", "come here"), ("come'ere", "come here"), ("comere", "come here"), ("comon", "come on"), ("corder", "recorder"),
    ("cos", "because"), ("cuz", "because"), ("d'ya", "do you"), ("d'you", "do you"), ("da", "that"), ("da", "the"), ("daet", "that"), ("daetz", "that's"), ("dare", "there"), ("das", "that's"),
    ("dat's", "that (i)s"), ("dat's", "that is"), ("dats", "that is"), ("de", "there"), ("de're", "they're"), ("dee", "the"), ("deez", "these"), ("deh", "there"), ("dei", "they"), ("deir", "there"),
    ("der", "there"), ("der", "they're"), ("der's", "there's"), ("dere's", "there (i)s"), ("dere's", "there is"), ("ders", "there's"), ("derz", "there's"), ("des", "there's"), ("diddy", "dinner"),
    ("didja", "did you"), ("didjou", "did you"), ("dijou", "did you"), ("din", "didn't"), ("dint", "didn't"), ("djou", "do you"), ("do", "the"), ("doncha", "don't you"), ("donchou", "don't you"),
    ("donna", "going to"), ("dontcha", "don't you"), ("doz", "those"), ("du", "the"), ("duh", "the"), ("dunno", "don't know"), ("dya", "do you"), ("dyou", "do you"), ("em", "him"), ("em", "them"),
    ("en", "and"), ("g'head", "go ahead"), ("gahead", "go ahead"), ("gatta", "gotta"), ("getcha", "get you"), ("getcher", "get your"), ("gimme", "give me"), ("gon", "going to"),
    ("gon(na)", "going to"), ("gonna", "going to"), ("gotcha", "got you"), ("gotchu", "got you"), ("gotta", "got a"), ("gotta", "got to"), ("gotta", "have got to"), ("haf", "have"),
    ("hasta", "has to"), ("hatu", "matthew"), ("havta", "have to"), ("howbout", "how about"), ("huh", "what"), ("i'ma", "i'm going to"), ("innit", "isn't it"), ("int", "isn't"), ("inta", "into"),
    ("k", "okay"), ("kaka", "car car"), ("kay", "okay"), ("kinda", "kind of"), ("kuhz", "because"), ("lemme", "let me"), ("liddle", "little"), ("likkle", "little"), ("lil", "little"),
    ("limme", "let me"), ("longit", "longitudinal"), ("looka", "look"), ("lookit", "look"), ("lotsa", "lots_of"), ("lotta", "lot of"), ("ma", "mother"), ("ma", "my"), ("mah", "my"), ("mhm", "yes"),
    ("mkay", "okay"), ("mm", "good"), ("mm+kay", "okay"), ("mmkay", "okay"), ("n", "and"), ("n'", "and"), ("na", "the"), ("nah", "no"), ("nat", "that"), ("nere", "there"), ("nis", "this"),
    ("nope", "no"), ("nuttin", "nothing"), ("outta", "out of"), ("outta", "out_of"), ("peam", "cream"), ("peejays", "pajamas"), ("plenny", "plenty"), ("putcher", "put your"), ("s'more", "some more"),
    ("sa", "what's that"), ("scuse", "excuse"), ("sorta", "sort of"), ("ta", "to"), ("thas", "that is"), ("them", "those"), ("til", "until"), ("till", "until"), ("tuh", "to"), ("udder", "other"),
    ("uder", "other"), ("uhhuh", "yes"), ("waimit", "wait a minute"), ("wan", "want"), ("wan(na)", "wanna"), ("wanna", "want a"), ("wanna", "want to"), ("wannoo", "wanna"), ("wanta", "wanna"),
    ("wantuh", "wanna"), ("wha", "what"), ("wha's", "what does"), ("wha's", "what is"), ("whad", "what"), ("whada", "what do"), ("whadda", "what do"), ("whaddaya", "what do you"),
    ("whaddya", "what do you"), ("whadja", "what did you"), ("whadya", "what do you"), ("whadyou", "what are you"), ("whadyou", "what do you"), ("whata", "what do"), ("whatcha", "what are you"),
    ("whatcha", "what do you"), ("whatcha", "what you"), ("where's", "where are"), ("whyn't", "why don't"), ("wiff", "with"), ("woujou", "would you"), ("wouldja", "would you"), ("wouldjou", "would you"),
    ("y'know", "you know"), ("y'wanna", "you want to"), ("ya", "yes"), ("ya", "you"), ("ya", "your"), ("yare", "you are"), ("yea", "yes"), ("yeah", "yes"), ("yeh", "yes"), ("yep", "yes"),
    ("yer", "your"), ("yesh", "yes"), ("yessie", "yes"), ("yuh", "you"), ("yup", "yes"), ("ywanna", "you want to"), ("zat", "that"), ("zis", "this"),
}
# Words that are wrongly inflected for tense.
WRONG_TENSE = {
    "ated", "aten", "babysitted", "bended", "bented", "bited", "blewed", "breaked", "bringed", "bringeded", "broked", "brokened", "broking", "brung", "builded", "buyded", "buyed", "buyeded", "camed",
    "catched", "closded", "comed", "cutted", "digged", "doed", "dranked", "drawed", "drinked", "drived", "droved", "dugged", "eated", "falled", "feeled", "felled", "fighted", "fixeded", "flewed",
    "flied", "flieded", "flinged", "flyed", "forgat", "forgeted", "getted", "goded", "goed", "goned", "gones", "gotted", "growed", "haved", "haveded", "heared", "hided", "hitted", "holded", "jumpded",
    "knowed", "leaped", "leaved", "led", "letted", "losed", "maded", "maked", "meaned", "meeted", "pickted", "putted", "quitted", "ranned", "readed", "runned", "safed", "safeded", "sanged", "sawded",
    "sawed", "sayed", "seewed", "sended", "sewed", "shooted", "showded", "shutted", "singed", "sitted", "sleeped", "sleept", "slid", "slided", "spilt", "spitted", "splitted", "stayded", "sticked",
    "stinged", "stucked", "stunged", "swammed", "swimmed", "taked", "takened", "telled", "throwed", "tolded", "waked", "wearded", "weared", "winned", "writed",
}
# Words that are wrongly inflected for number.
WRONG_PLURAL = {
    "boyses", "chickens", "firemans", "firemens", "foots", "foremans", "friendses", "ghostes", "knifes", "leafs", "mans", "mans@c", "mens", "mouses", "policemens", "sheeps", "snowmans", "tooths",
    "womans", "wristes", "‹barefeeted",
}
# Verbs.
INFINITIVES = {
    "be", "carry", "close", "color", "come", "cook", "count", "cry", "cut", "do", "draw", "dress", "drink", "eat", "fall", "find", "flush", "get", "go", "grunt", "happen", "have", "hear", "help",
    "hold", "know", "laugh", "leave", "let", "like", "listen", "live", "look", "make", "match", "need", "open", "pick", "play", "press", "push", "put", "rain", "read", "see", "shake", "sigh", "sing",
    "sit", "sleep", "smell", "speak", "squeal", "stay", "stick", "take", "think", "tie", "tip", "try", "turn", "use", "v", "wait", "want", "watch", "wear", "whine", "yell",
}
# Verb forms that are not of the third person.
INFLECTED_NOT_THIRD = {
    "'m", "'re", "am", "are", "fussing", "going", "gonna", "re", "singing", "were", "whining",
}
# Other verb forms.
INFLECTED_OTHER = {
    "brought", "came", "can", "fusses", "got", "is", "ran", "said", "saw", "says", "was",
}
# Subjects of the third person singular.
THIRD_PERSONS = {
    "baby", "boy", "daddy", "everything", "farmer", "girl", "he", "it", "lion", "mommy", "she", "that", "this", "what", "who",
}
# Other subjects.
MORE_SUBJECTS = {
    "baby", "cow", "dada", "daddy", "girls", "hat", "he", "horsie", "how", "i", "it", "jacob", "mummy", "pro", "she", "that", "there", "these", "they", "this", "we", "what", "when", "where", "who",
    "why", "you",
}
# Auxiliaries.
AUXILIARIES = {
    "'ll", "'ve", "can", "could", "did", "do", "does", "had", "has", "hav", "have", "may", "shall", "want", "wants", "will", "would",
}
# Prepositions.
PREPOSITIONS = {
    "about", "as", "at", "for", "from", "in", "of", "off", "on", "out", "prep", "to", "up", "with",
}
# Determiners.
DETERMINERS = {
    "a", "all", "an", "any", "det", "many", "more", "one", "some", "the",
}
# Objects.
OBJECTS = {
    "her", "him", "me", "myself", "them",
}
# Words whose omission is an error of another kind.
OTHER_WORDS = {
    "and", "because", "if", "no", "not", "or",
}
# Words that want a determiner before them.
NO_DETERMINER_NOUNS = {
    "banana", "barbie", "bottle", "cheese", "crayon", "cup", "dirty", "elephant", "fairy", "green", "horse", "noisy", "nose", "orange", "puzzle", "sandwich", "small", "sun", "tent", "tissue",
    "yellow",
}
# Words that want a verb between them and a subject.
NO_VERB_BEFORE = {
    "been", "better", "broken", "dizzy", "done", "fat", "for", "here", "his", "lots", "mine", "my", "no", "not", "our", "pilchard", "purple", "these", "tiny", "your",
}
# Forms of to be.
BE_FORMS = {
    "am", "are", "he's", "i'm", "is", "it's", "she's", "they're", "was", "we're", "were", "what's", "you're",
}
# Grammatical relation of an omitted word -> class.
RELATIONS = {
    "SUBJ": "subject",
    "OBJ": "object",
    "OBJ2": "object",
    "DET": "determiner",
    "JCT": "preposition",
    "NJCT": "preposition",
    "INF": "preposition",
    "AUX": "auxiliary",
    "ROOT": "verb",
    "CSUBJ": "verb",
    "COBJ": "verb",
    "CPRED": "verb",
    "CPOBJ": "verb",
    "POBJ": "verb",
    "SRL": "verb",
    "PRED": "verb",
    "XJCT": "verb",
    "CJCT": "verb",
    "CMOD": "verb",
    "XMOD": "verb",
    "COMP": "verb",
}
# Code in [* code] -> class.
STAR_CODES = {
    "pos": "subject",
    "i": "subject",
    "m:=ed": "tense_aspect",
    "m:+ed": "tense_aspect",
    "+ed": "tense_aspect",
    "-ed": "tense_aspect",
    "m:ed": "tense_aspect",
    "m": "tense_aspect",
    "m:m": "tense_aspect",
    "m:": "tense_aspect",
    "forgot": "tense_aspect",
    "fell": "tense_aspect",
    "+is": "verb",
    "m:+s": "possessive",
    "m:0s": "possessive",
    "her": "possessive",
    "m:=s": "plural",
    "-s": "plural",
    "+s": "plural",
}
# Sounds of (said, meant): one word is the other with the first put for the second.
SOUNDS_SAID = [("d", "th"), ("s", "th"), ("t", "th"), ("w", "r")]
# Short forms (said, meant): the meant words are the said ones with the second put for the first.
SHORT_FORMS = [("'ll", " will"), ("'s", " is"), ("'s", " has"), ("'d", " did"), ("'", "g"), ("'re", " are"), ("f", "th"), ("n't", " not"), ("'ve", " have"), ("'m", " am"), ("'d", " would"), ("'s", " does"), ("'s", " us")]
# Another annotation scheme's codes -> class.
OTHER_SCHEME = {
    "other": "other",
    "synt:subj": "subject",
    "synt:obj": "object",
    "synt:verb": "verb",
    "umorph:auxverb": "auxiliary",
    "umorph:det": "determiner",
    "vmorph:regpast": "tense_aspect",
    "vmorph:other": "other",
    "umorph:prep": "preposition",
    "vmorph:3rdpers": "sv_agreement",
    "nmorph:poss": "possessive",
    "vmorph:irrpast": "tense_aspect",
    "umorph:presprogr": "progressive",
    "nmorph:regplural": "plural",
    "nmorph:irrplural": "plural",
    "umorph:other": "other",
}
# -------------------------------------------------------------------------------------
