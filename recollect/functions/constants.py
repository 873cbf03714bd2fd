"""Fixed values that results depend on: word lists, patterns, limits and formats, as the data model states them."""

# Limits and weights.
RESERVE_TOKENS = 768
RELEVANCE_FLOOR = 0.01
TOP_K = 24
RECENCY_WEIGHT = 0.001
MAX_STALE = 10
REPLAY_MAX_STALE = 10_000
TRIGGER_TOKENS = 8000
SPAN_TURNS = 6
KEEP_TURNS = 8
MAX_CONTEXT_TOKENS = 32_000
READ_FIT_TOKENS = 28_000
COSINE_SAME = 0.80
BAND = (0.70, 0.88)
LOOP_WINDOWS = (8, 16)
VALIDITY_CEILING = 0.5
P95_LIMIT_MS = 1000

KINDS = ("entity", "number", "decision", "quote")

QUERY_STOPWORDS = (
    "a an and are do does did for how i in is it me my of on or the to was what when where which who with"
).split()
TEMPORAL_TERMS = (
    "before decrease decreased earlier first former from historical history increase increased initial original "
    "previous previously prior started then updated was"
).split()
INVARIANT_NOUNS = ["series", "species"]
IDENTITY_STOPWORDS = "a an the of to for in on per and or number count total amount value range type new current".split()
KEY_STOPWORDS = "the a an of for per to and in on with by current new my our your".split()
SUBJECT_GENERICS = "the a an current new user my our".split()
SLOT_GENERICS = "the our a preferred current new now originally default".split()
ANCHOR_GENERICS = "change detail information service servicing update".split()
IRREGULAR_SINGULARS = {"people": "person", "children": "child", "men": "man", "women": "woman"}
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million half quarter "
    "couple few several dozen once twice"
).split()
CARDINALS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15",
    "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30",
    "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
}
SLOT_ALIASES = {
    "begin": "start", "beginning": "start", "ending": "end", "finish": "end", "lower": "minimum", "min": "minimum",
    "max": "maximum", "upper": "maximum", "refrigerated": "refrigerator", "fridge": "refrigerator", "frozen": "freezer",
    "reps": "repetition", "rep": "repetition", "repetitions": "repetition", "sets": "set",
}
SLOT_ROLES = {
    "amount": "count", "frequency": "frequency", "count": "count", "number": "count", "total": "count", "ratio": "ratio",
    "day": "day", "date": "day", "time": "time", "timing": "time", "location": "location", "place": "location",
    "status": "status", "state": "status", "action": "action", "result": "result", "symptom": "symptom",
    "type": "type", "model": "model", "capacity": "capacity",
}
#: Words of one dimension exclude each other in near-duplicate slots.
SLOT_DIMENSIONS = [
    ["start", "end"], ["minimum", "maximum"], ["refrigerator", "freezer"], ["set", "repetition"],
    ["under", "below", "over", "above"], ["morning", "afternoon", "evening", "night"], ["left", "right"],
    ["front", "rear", "back"], ["first", "second", "third", "fourth", "fifth"],
    ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"],
]
#: Opposite sides that are never the same role.
ROLE_OPPOSITES = [
    (["start", "begin", "opening"], ["end", "finish", "closing"]),
    (["min", "minimum", "low", "lower"], ["max", "maximum", "high", "upper"]),
    (["fridge", "refrigerator", "refrigerated"], ["freezer", "freeze", "frozen"]),
    (["set"], ["rep", "repetition"]),
]

#: Question modes, in order of precedence.
QUESTION_MODES = [
    ("point-in-time", r"\b(?:as of|at the time|on|during|in)\s+(?:\d{4}|(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b)"),
    ("change", r"\b(?:change(?:d)?|switch(?:ed)?|increase(?:d)?|decrease(?:d)?|more or less|less or more|from .{1,80} to)\b"),
    ("previous", r"\b(?:before|earlier|former|initial(?:ly)?|original(?:ly)?|previous(?:ly)?|prior|started|used to)\b"),
    ("aggregation", r"\b(?:across all|all sessions|altogether|average|combined|in total|overall total|sum(?:med)?|taken together)\b"),
]
#: Our own wording; the modes are what results depend on.
MODE_INSTRUCTIONS = {
    "current": "Give the latest value only; labels may differ, later turns win.",
    "previous": "Give the value that held just before the latest one.",
    "change": "Compare the earlier with the later value and give the direction.",
    "aggregation": "Combine the separate contributions; versions of one value count once.",
    "point-in-time": "Give the value that held at the time asked about.",
}

#: Slots by keyword: key, any of these substrings, and what else must hold.
SLOT_KEYS = [
    ("vendor_api.rate_limit", ["rate limit", "ratelimit"], None),
    ("replica.region", ["region", "replica"], r"\b[a-z]{2}-[a-z]+-\d\b"),
    ("infra.host", ["host"], None),
    ("infra.port", ["port"], None),
    ("infra.codename", ["codename", "codenamed"], None),
    ("infra.engine", ["telemetry", "sqlite", "duckdb"], "instead of"),
    ("infra.threshold", ["threshold"], None),
    ("infra.retention", ["retained", "retention"], None),
]
SLOT_OVERRIDES = [
    ("vendor_api", "rate_limit", ["rate limit", "ratelimit"]),
    ("replica", "region", ["region", "replica"]),
    ("infra", "host", ["host"]),
    ("infra", "port", ["port"]),
    ("infra", "codename", ["codename", "codenamed"]),
    ("infra", "threshold", ["threshold"]),
    ("infra", "retention", ["retained", "retention"]),
    ("task_queue", "concurrency", ["concurrent", "concurrency"]),
    ("standby", "site", ["standby site", "standby"]),
]
#: Value patterns by slot, with the group that holds the value; matched in either case.
SLOT_VALUES = {
    "vendor_api.rate_limit": (r"\b\d[\d,]*\s+requests?\s+per\s+minute\b", 0),
    "replica.region": (r"\b[a-z]{2}-[a-z]+-\d\b", 0),
    "infra.host": (r"\bhost\s+(?:is|set\s+to|to)\s+([a-zA-Z0-9_-]+)\b", 1),
    "infra.port": (r"\bport\s+(?:to\s+|is\s+)?(\d+)\b", 1),
    "infra.codename": (r"\b(?:codenamed?|codename\s+(?:is|to|tracked\s+as))\s+([A-Za-z0-9_-]+)\b", 1),
    "infra.engine": (r"\buse\s+([a-zA-Z0-9_-]+)\s+instead\s+of\s+([a-zA-Z0-9_-]+)\b", 1),
    "infra.threshold": (r"\bthreshold\s+(?:is|to|set\s+to)\s+(\d+(?:\.\d+)?)\b", 1),
    "infra.retention": (r"\b(?:retained|retention)\s+(?:for\s+)?([\w\s-]+)\b", 1),
}
HOST_ALONE = r"\bhost\s+([a-zA-Z0-9_-]+)\b"
#: Kinds of facts that are found without a model, by slot; others are entities.
SLOT_KINDS = {"vendor_api.rate_limit": "number", "infra.port": "number", "infra.threshold": "number", "infra.retention": "number", "infra.engine": "decision"}

#: Words that do not count when a fact is mapped to its turn.
FACT_STOPWORDS = (
    "the a an and or but if then else is are was were be been being to of in on at by for with about against between "
    "into through during before after above below from up down out off over under again further once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this that these those am "
    "please remember actually correct correction"
).split()

ABSTENTIONS = [
    r"\b(?:cannot|can't|unable to) (?:answer|determine|find|tell)\b",
    r"\b(?:not enough|insufficient) (?:context|information|memory)\b",
    r"\b(?:memory|context) (?:does not|doesn't) (?:contain|mention|provide)\b",
    r"\b(?:i do not|i don't) know\b",
]
STALE_REASON = r"\b(?:stale|outdated|older|previous)\b"

#: Miss categories in order of precedence, and the signs of each.
MISS_CATEGORIES = ["budget_invalid", "context_overflow", "extraction_drop", "judge_ambiguity", "stale_ghost", "answerer_failure", "summary_loss"]
OVERFLOW_MARKER = "context overflow"
AMBIGUOUS_WORDS = ["ambiguous", "unclear", "partially"]
STALE_MARKERS = ["stale", "outdated", "old value", "previous value", "superseded", "no longer", "earlier value"]
CANNOT_DETERMINE = r"(?:cannot|can't|could not|couldn't|unable to|not able to)\s+determine"
MODEL_SUBJECT = r"\b(?:model|assistant|response|answer|ai)\b"

KEBAB_CASE = r"^[a-z0-9]+(-[a-z0-9]+)*$"
WIKI_LINK = r"\[\[([a-z0-9-]+)\]\]"
