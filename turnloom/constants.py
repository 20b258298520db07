"""Published thresholds, word lists and patterns that results depend on.

Everything here is a default; operators take each of them as a parameter.
"""

# --- fixed values: periods, drift and triggers --------------------------------
N_BINS = 7
SENTIMENT_DELTA_MIN = 0.30
TOPIC_JACCARD_MAX = 0.30
TRIGGER_CONVOS_MAX = 5
CONCENTRATION_MIN = 0.5
TOP_TOPICS = 10
TOP_ENTITIES = 10

# --- fixed values: contradiction candidates -----------------------------------
CANDIDATE_MENTIONS_MIN = 3
CANDIDATE_DAYS_MIN = 3
CANDIDATE_LIMIT = 10

# --- fixed values: retrieval and answers --------------------------------------
WEIGHT_COSINE, WEIGHT_RECENCY, WEIGHT_EMOTION = 0.5, 0.3, 0.2
MAX_DAY = 6
TOP_K = 15
TOP_FOR_PAIRS = 5
CONTRADICTION_MIN = 0.6
SIGN_THRESHOLD = 0.05
CONTRADICTION_PENALTY = 0.85
EXCERPT_LENGTH = 180

# --- fixed values: intent ------------------------------------------------------
LABELS = ["reminder", "emotional-support", "action-item", "small-talk", "unknown"]
PER_CLASS = 30
SAMPLE_SEED = 42
MESSAGE_SEED = 7
MAX_FEATURES = 10_000
MIN_DF = 2

# --- fixed values: turn syntax -------------------------------------------------
TURN_PREFIX = r"(?iU)\A\s*User\s*([0-9]+)\s*:\s*"
WORD = r"[A-Za-z']+"

# --- fixed values: entity filters ----------------------------------------------
PROFILE_ENTITY_LABELS = ["PERSON", "ORG", "GPE", "EVENT"]
PROFILE_PRONOUNS = ["i", "you", "we", "they"]
CANDIDATE_ENTITY_LABELS = ["PERSON", "ORG", "GPE"]
CANDIDATE_PRONOUNS = ["i", "you", "we", "they", "he", "she", "it", "u"]
ENTITY_DETERMINERS = [
    "the", "a", "an", "my", "your", "our", "their", "his", "her",
    "this", "that", "these", "those", "some", "any",
]

# --- fixed values: topic stop words added to the base list ---------------------
CHAT_FILLERS = [
    "im", "ive", "ill", "thats", "dont", "youre", "youve", "youll",
    "yeah", "yep", "ok", "okay", "lol", "haha", "hehe",
    "user", "user 1", "user 2",
    "i'm", "i've", "i'll", "i'd",
    "you're", "you've", "you'll", "you'd",
    "we're", "we've", "we'll", "we'd",
    "they're", "they've", "they'll", "they'd",
    "he's", "she's", "it's", "that's", "what's", "there's", "here's",
    "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't",
    "won't", "can't", "couldn't", "shouldn't", "wouldn't", "haven't",
    "hasn't", "hadn't", "let's", "y'all", "ya'll",
]

# --- fixed values: contractions ------------------------------------------------
CONTRACTIONS = (
    r"don'?t|won'?t|can'?t|i'?m|you'?re|we'?re|they'?re|it'?s|that'?s|"
    r"i'?ve|you'?ve|we'?ve|they'?ve|i'?ll|you'?ll|he'?ll|she'?ll|we'?ll|"
    r"they'?ll|isn'?t|aren'?t|wasn'?t|weren'?t|didn'?t|doesn'?t|haven'?t|"
    r"hasn'?t|hadn'?t|wouldn'?t|couldn'?t|shouldn'?t|let'?s|what'?s|"
    r"there'?s|here'?s|gonna|wanna|gotta"
)

# --- fixed values: weak label patterns -----------------------------------------
WEAK_REMINDER = (
    r"remind me|don'?t forget|tomorrow at|schedule\b|set a |set an |reminder|"
    r"in the morning|next week|next month"
)
WEAK_EMOTION = (
    r"feeling|i feel|i'm feeling|sad|anxious|anxiety|sorry to hear|tough day|"
    r"stressed|depress(ed|ing)?|lonely|overwhelmed|crying|exhausted|miserable|"
    r"heart ?broken|burn(ed|t) out"
)
NEED = r"i need to|i have to|gotta|got to|i must|i should"
IMPERATIVE_VERBS = [
    "send", "call", "book", "buy", "finish", "email", "text", "pick",
    "grab", "remind", "schedule", "cancel", "pay", "submit", "order",
    "fix", "review", "check", "update",
]
WEAK_SMALL_TALK = (
    r"lol|haha+|hehe+|how are you|how's it going|how was your day|"
    r"good morning|good night|good evening|hey there|hi there|hello|"
    r"see you|see ya|take care|bye|thanks|thank you|no problem|"
    r"you're welcome|what's up|nice to meet you"
)

# --- fixed values: gold label patterns -----------------------------------------
GOLD_FUTURE_TIME = (
    r"tomorrow|tonight|monday|tuesday|wednesday|thursday|friday|saturday|sunday|"
    r"next (week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|"
    r"at \d{1,2}(:\d{2})?\s*(am|pm)?|in the morning|in the evening|later today"
)
GOLD_EXPLICIT_REMINDER = r"remind me|don'?t forget"
GOLD_REMINDER = r"remind me|don'?t forget|reminder|schedule"
GOLD_STRONG_EMOTION = (
    r"sad|anxious|anxiety|stressed|depress(ed|ing)?|lonely|overwhelmed|"
    r"crying|miserable|heart ?broken|burn(ed|t) out|exhausted|hurt|grieving"
)
GOLD_FIRST_PERSON = r"i|me|my|i'm|im"
GOLD_CONSOLING = r"sorry to hear|that sucks|hugs|sending love|i'm here for you|here for you"
GOLD_DEADLINE = r"today|tomorrow|tonight|before|by"
GOLD_SMALL_TALK = (
    r"lol|haha+|how are you|how's it going|good morning|good night|"
    r"hey there|hi there|hello|see you|take care|bye|thanks|thank you|"
    r"no problem|you're welcome|what's up|nice to meet you"
)

# --- fixed values: seed chunks and demonstration questions ---------------------
SEED_CHUNKS = [
    (1, "User 1: my sister called today, we talked for almost an hour. she's "
        "honestly amazing — i feel so lucky to have her in my life.\n"
        "User 2: that's beautiful — sounds like you two are really close."),
    (4, "User 1: my sister is being impossible again. i can't deal with her "
        "right now, every conversation turns into an argument.\n"
        "User 2: that sounds exhausting. has it been building up for a while?"),
    (6, "User 1: haven't spoken to my sister in a while. not really sure how "
        "she's doing — life just got busy on both sides i guess.\n"
        "User 2: do you think you'll reach out, or just let it be for now?"),
]
DEMO_QUERIES = [
    ("Did I mention anything about my sister?", "your sister"),
    ("What did I say about my sister recently?", "your sister"),
    ("Tell me about my relationship with my sister over time", "your sister"),
]

# --- fixed values: answer wording ----------------------------------------------
NOTE_TONE = "Note: these accounts conflict on emotional tone (one positive, one negative)."
NOTE_FACTS = "Note: these accounts appear inconsistent on factual details."
NOTE_CONSISTENT = "Note: these accounts read as consistent in tone."

# --- fixed values: published rule-based sentiment model (Hutto & Gilbert 2014) --
CAPS_INCREMENT = 0.733
BOOST_INCREMENT = 0.293
NEGATION_FACTOR = -0.74
BOOST_DAMPING = (1.0, 0.95, 0.9)
CONTRAST_BEFORE, CONTRAST_AFTER = 0.5, 1.5
EXCLAIM_INCREMENT, EXCLAIM_MAX = 0.292, 4
QUESTION_INCREMENT, QUESTION_CAP = 0.18, 0.96
NORMALISATION_ALPHA = 15.0
BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "deeply", "enormously",
    "entirely", "especially", "exceptionally", "extremely", "fully", "greatly", "highly", "hugely",
    "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "unbelievably",
    "unusually", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sorta",
]
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "neither", "never", "no", "none", "nope", "nor", "not", "nothing", "nowhere",
    "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt",
    "ain't", "aren't", "can't", "couldn't", "didn't", "doesn't", "don't", "hadn't", "hasn't",
    "haven't", "isn't", "shouldn't", "wasn't", "weren't", "won't", "wouldn't",
]
# A starter word list so the pipeline runs out of the box; pass the full published
# lexicon (sources.tables.read_lexicon) for real work.
STARTER_LEXICON = {
    "amazing": 2.8, "angry": -2.3, "annoying": -1.7, "anxious": -1.0, "argument": -1.5,
    "awesome": 3.1, "awful": -2.0, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "boring": -1.3,
    "broken": -2.1, "close": 0.4, "cool": 1.3, "crying": -2.1, "enjoy": 2.2, "error": -1.7,
    "excited": 1.4, "exhausted": -1.5, "fail": -2.5, "fine": 0.8, "fun": 2.3, "glad": 2.0,
    "good": 1.9, "great": 3.1, "happy": 2.7, "hate": -2.7, "help": 1.7, "helping": 1.2,
    "hope": 1.9, "horrible": -2.5, "hurt": -2.4, "impossible": -1.2, "interesting": 1.7,
    "like": 1.5, "lonely": -1.5, "lost": -1.3, "love": 3.2, "loved": 2.9, "lucky": 1.8,
    "miserable": -2.2, "nice": 1.8, "overwhelmed": -1.0, "perfect": 2.7, "pretty": 2.2,
    "problem": -1.7, "sad": -2.1, "sorry": -0.3, "stressed": -1.4, "terrible": -2.1,
    "thank": 1.5, "thanks": 1.9, "ugly": -2.3, "welcome": 2.0, "win": 2.8, "wonderful": 2.7,
    "worry": -1.9, "worst": -3.1, "wrong": -2.1, "yes": 1.7,
}
NUMBER_WORDS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "zero", "only",
]
