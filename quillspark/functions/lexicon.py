"""Word lists and patterns that the measurements are defined by. Kept as given; do not edit."""

ACTION_VERBS = """built created founded organized designed coded launched decided chose led repaired wrote conducted researched
initiated engineered assembled campaigned resolved struggled confronted negotiated volunteered tutored gathered analyzed""".split()

#: Entries of two words never equal a token; they are part of the definition all the same.
PASSIVE_STATE_VERBS = ["felt", "seemed", "was told", "were told", "found myself", "made me", "appeared", "wished", "hoped", "wondered", "endured", "received", "was given", "witnessed"]

FIRST_PERSON = "i my me we our".split()

REFLECTION = [
    r"\brealiz(?:ed|ing|e)\b", r"\bdiscover(?:ed|ing|e)\b", r"\bunderst(?:ood|and|anding)\b", r"\blearn(?:ed|t|ing)\b", r"\btaught me\b", r"\bperspective (?:shifted|changed|broadened)\b",
    r"\bconclud(?:ed|ing|e)\b", r"\bepiphany\b", r"\billuminat(?:ed|ing|e)\b", r"\binsight\b", r"\bcame to know\b", r"\bopened my eyes\b",
]

FORMULAIC = [
    r"\bin conclusion\b", r"\bthis (?:experience )?taught me (?:that|how)\b", r"\bthe lesson (?:i|we) learned\b", r"\blooking back\b", r"\bhas shaped (?:who|what) i am\b", r"\ba testament to\b", r"\btestament of\b",
    r"\bnot only did .+, but (?:also)?\b", r"\bultimately,? (?:this|i)\b", r"\bforever changed\b", r"\bserves as an? (?:poignant|powerful|constant|monumental|reminder|tribute|catalyst)\b",
    r"\bstands as an? (?:imposing|monumental|poignant|powerful|tribute|testament)\b", r"\bpoignant reminder\b", r"\bin an increasingly globalized\b", r"\benduring spirit of\b",
]

CAUSAL = [r"\bbecause\b", r"\btherefore\b", r"\bconsequently\b", r"\bas a result\b", r"\bthus\b", r"\bhence\b", r"\bdue to\b", r"\bled to\b", r"\bfueled by\b", r"\bwhich caused\b", r"\bsince\b"]

TEMPORAL = [r"\binitially\b", r"\bsuddenly\b", r"\bmeanwhile\b", r"\byears later\b", r"\bat that moment\b", r"\bsubsequently\b", r"\beventually\b", r"\bbefore long\b", r"\bthe next morning\b", r"\bover time\b", r"\bafter weeks\b"]

ABSTRACT = """paradigm quintessential foster fostering inextricably dichotomy transformative embodiment myriad tapestry beacon catalyst
catalysts profound pivotal delve nuance nuances testament resonate resonates interconnectedness interconnected holistic multifaceted
unwavering culmination epitome embark embarking symbolizing symbolize poignant grandeur monumental ever-evolving enduring valor
resilience patriotism dissonance intricacies societal symposium symposiums harmonious juxtaposed juxtaposition insurmountable disparate""".split()

CONCRETE = """smell scent sound screamed whispered wooden metal grease soldering kitchen street table clock sweat chalk brass rain dirt
guitar wire microscope hospital notebook stumbled hands fingers cold hot bruise bandage canvas paint flour cleaver linoleum tiles dough
pork dumplings dumpling steam steaming baskets soup pancakes pot pan stove garage bicycle wrench engine piano cello violin strings bridge
wood soil mud stone iron""".split()

STOPWORDS = """a about above after again against ain all am an and any are aren aren't as at be because been before being below between both
but by can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has
hasn hasn't have haven haven't having he he'd he'll he's her here hers herself him himself his how i i'd i'll i'm i've if in into is isn isn't
it it'd it'll it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on once
only or other our ours ourselves out over own re s same shan shan't she she'd she'll she's should should've shouldn shouldn't so some such t
than that that'll the their theirs them themselves then there these they they'd they'll they're they've this those through to too under until
up ve very was wasn wasn't we we'd we'll we're we've were weren weren't what when where which while who whom why will with won won't wouldn
wouldn't y you you'd you'll you're you've your yours yourself yourselves""".split()

#: Of the rule tagger.
PRONOUNS = "i me my myself we us our ours you your he him his she her it its they them their".split()
PREPOSITIONS = "in on at to for with from by about into through during before after above below".split()
BE_VERBS = "is am are was were be been being have has had do does did can could will would shall should".split()

#: Removed once each, in this order, at the start and at the end of a text.
PREFIXES = [
    r"^(?:Here(?:'s| is) (?:an|a|the) (?:college admissions |college |admissions )?essay(?::|;|\.\.\.|\.)?)\s*",
    r"^(?:Title:\s*[^\n]+\n+)", r"^(?:Prompt:\s*[^\n]+\n+)", r"^(?:Sure,?\s+(?:here is|I can provide)[^\n]+\n+)", r"^(?:As requested,?\s+[^\n]+\n+)",
]
SUFFIXES = [r"\n+(?:I hope this essay (?:meets your needs|helps you|captures the prompt)[^\n]*)$", r"\n+(?:Note:\s*[^\n]+)$", r"\n+(?:Word count:\s*\d+[^\n]*)$"]

#: Verdicts: (upper bound of the probability, code, category, colour).
VERDICTS = ((0.35, "LIKELY_HUMAN", "Likely Human", "#3fb950"), (0.65, "UNCERTAIN", "Uncertain / Mixed Evidence", "#e3b341"), (0.85, "LIKELY_AI_ASSISTED", "Likely AI-Assisted / Polished", "#a371f7"), (2.0, "LIKELY_AI_GENERATED", "Likely AI-Generated", "#f85149"))

#: Category, colour and confidence of a text too short to judge.
UNDECIDED = ("Insufficient Evidence", "#8b949e", "N/A (Short Text)")

#: Of the statistical sentence splitter: signs that end a sentence, signs that end a word, the beginning of a word, marks of
#: several signs, numbers, closing marks, and the thresholds of its log-likelihood tests.
SENTENCE_ENDERS = "[.?!]"
WORD_ENDERS = r"[)\";}\]*:@'({\[!?]"
WORD_BEGINNERS = r"[^(\"`{\[:;&#*@)}\]\-,]"
MARKS = r"(?:-{2,}|\.{2,}|(?:\.\s){2,}\.)"
NUMBER = r"^-?[.,]?\d[\d,.\-]*\.?$"
CLOSERS = r"^[\"')\]}]+?(?:\s+|(?=--)|$)"
INNER_MARKS = [";", ":", ",", ".", "!", "?"]
ABBREVIATION_SCORE, COLLOCATION_SCORE, STARTER_SCORE = 0.3, 7.88, 30.0
