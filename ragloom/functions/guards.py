"""Guards on questions and answers as Column predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines, strings, trim

# Lexicons and marker phrases.
FOUL = (
    "fuck fucking fucker fuckers motherfucker motherfuckers shit shits shitty bullshit bitch bitches bastard bastards "
    "asshole assholes arsehole dickhead dickheads dick dicks cock cocks pussy cunt whore whores slut sluts slutty faggot "
    "faggots retard retarded idiot idiots idiotic stupid dumb moron morons imbecile useless crap crappy suck sucks sucky "
    "damn goddamn hell"
).split() + ["shut up", "kill you"]
WORK = (
    "policy leave salary employee staff report procedure benefit training health safety office budget project program "
    "grant donor fund compliance audit attendance probation contract performance review meeting department team manager "
    "director coordinator volunteer field headquarters branch region district founder ceo chairman president leader "
    "biography awards achievements recognition honors values mission vision history about chapter section article clause "
    "annex appendix handbook manual sop gratuity provident pension allowance overtime appraisal disciplinary grievance "
    "maternity paternity increment bonus insurance resign terminat retire ch."
).split() + ["who is", "tell me about", "what is", "what are", "how much", "how many", "how long"]
LEAK_STRONG = [
    "the user is pointing out", "the user asks", "the user wants", "the user insists", "according to the instructions",
    "per the instructions", "the system requires", "the system says", "but the system", "the system likely expects",
    "i must follow", "i must not", "i must provide", "i need to follow", "in my last response", "my previous response",
    "looking back at the history", "the only compliant action", "the correct action is", "the safe path is",
    "since the user insists", "output only the final response", "wait! looking", "the prompt says", "as an ai",
]
LEAK_SOFT = [
    "let me think", "let me check", "let me double-check", "let me verify", "let me scan", "let me re-read",
    "let me consider", "let me break", "wait,", "hmm,", "scanning again", "first, let me", "now, let me", "i need to",
    "i should", "i will check", "i'll check", "i think", "i believe", "i must", "i can verify", "let me analyze",
    "let me review",
]
NO_INFO = [
    "don't have enough information", "do not have enough information", "cannot answer", "no information", "not found",
    "unable to find", "doesn't contain", "does not contain", "no relevant documents", "no documents found",
]
GREETING = r"^(hello|hi|hey|greetings|good\s*(morning|afternoon|evening))[\s,!\.]*"
FOLLOW_UP = [
    r"^(what about|how about|and what|and how|what if|how long|how many|how much|why|when|where|which|who|does it|is it|are they|do they)",
    r"^(it|they|that|this|those|these)\b",
]
FOLLOW_STOP = ["what", "when", "where", "which", "does", "have", "with", "from", "about", "policy"]


def any_of(x: Column, phrases) -> Column:
    return F.exists(strings(phrases), lambda p: F.contains(x, p))


def is_foul(q: Column) -> Column:
    """Leet digits and symbols read as letters, runs of three or more of a character as one, whole words only."""
    n = F.regexp_replace(F.translate(F.lower(q), "013457@$+", "oieastast"), "[^a-z0-9 ]", " ")
    n = F.regexp_replace(n, r"(.)\1{2,}", "$1")
    return F.coalesce(n.rlike(r"\b(" + "|".join(w.replace(" ", r"\s+") for w in FOUL) + r")\b"), F.lit(False))


def is_casual(q: Column) -> Column:
    """Small talk: no work word, no long question, and one of the small-talk shapes."""
    t = trim(F.lower(q))
    asks, n = F.contains(t, F.lit("?")), F.length(t)
    rest = trim(F.regexp_replace(t, GREETING, ""))
    greeting = (n < 40) & ~asks & t.rlike(GREETING) & ((rest == "") | (F.size(F.split(rest, r"\s+")) <= 3))
    well = t.rlike(r"how\s+(are|'re|is)\s+(you|everyone|the\s+team|things)") | t.rlike(r"(how'?s|how is)\s+(it\s+going|your\s+day|the\s+day)")
    weather = (n < 30) & any_of(t, ["weather", "rain", "sunny", "temperature"])
    mood = t.rlike(r"office\s+(atmosphere|busy|quiet|vibe)")
    thanks = t.rlike(r"^(thanks|thank you|appreciate it|goodbye|bye)")
    self = t.rlike(r"(what'?s?|tell me) your (name|purpose|role|capabilities)") | t.rlike(r"(what can you|how can you) help") | F.contains(t, F.lit("who are you"))
    return ~any_of(t, WORK) & ~(asks & (n > 30)) & (greeting | well | weather | mood | thanks | self)


def is_no_info(a: Column) -> Column:
    return any_of(F.lower(a), NO_INFO)


def leak_markers(a: Column) -> Column:
    """The phrases that show deliberation instead of an answer; empty if it is clean."""
    low = F.lower(a)
    strong = F.filter(strings(LEAK_STRONG), lambda m: F.contains(low, m))
    soft = F.filter(strings(LEAK_SOFT), lambda m: F.contains(low, m))
    none = F.array().cast("array<string>")
    enough = (F.size(soft) >= 3) | ((F.size(soft) >= 2) & (F.length(a) > 1500))
    return F.when(a.isNull() | (F.length(a) < 80), none).when(F.size(strong) > 0, strong).when(enough, soft).otherwise(none)


def _list_item(s: Column) -> Column:
    return s.rlike(r"\A[-*+•–—] ") | s.rlike(r"(?i)\A(\d+|[a-z])[.)]\s+\S")


def is_cut_off(a: Column) -> Column:
    """Forty characters or more without a closing mark at the end, and not stopped between two list items."""
    t = trim(a)
    real = F.filter(F.transform(lines(t), trim), lambda s: s != "")
    tail = F.when(F.size(real) >= 2, F.slice(real, -2, 2))
    both = F.coalesce(F.forall(tail, _list_item), F.lit(False))
    return F.coalesce((F.length(t) >= 40) & ~t.rlike("[.!?\"'’”)\\]}:;]\\z") & ~both, F.lit(False))


def clean_answer(a: Column) -> Column:
    """What follows the last answer label, without a leading label."""
    t = trim(F.coalesce(a, F.lit("")))
    after = trim(F.regexp_replace(t, r"(?is)\A.*answer:", ""))
    return trim(F.regexp_replace(after, r"(?is)\A\s*(analysis|final answer)\s*:\s*", ""))


def is_degenerate(a: Column) -> Column:
    """A line of 30 characters four times, or a sentence of eight words three times."""

    def most(parts: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.array_distinct(parts), lambda p: F.size(F.filter(parts, lambda x: x == p)))), F.lit(0))

    low = F.lower(a)
    long_lines = F.filter(F.transform(lines(low), lambda s: F.regexp_replace(trim(s), r"\s+", " ")), lambda s: F.length(s) >= 30)
    flat = F.regexp_replace(low, r"\s+", " ")
    long_sentences = F.filter(F.transform(F.split(flat, "(?<=[.?!]) "), trim), lambda s: F.size(F.split(s, r"\s+")) >= 8)
    return F.coalesce((most(long_lines) >= 4) | (most(long_sentences) >= 3), F.lit(False))


def providers(config: Column, known: Sequence[str]) -> Column:
    """Those of the known validator names that a setting lists, in its order, each once."""
    return F.filter(F.array_distinct(F.transform(F.split(F.lower(config), ","), trim)), lambda p: p.isin(list(known)))


def error_class(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    quota = any_of(low, ["429", "resource_exhausted", "quota exceeded"])
    away = any_of(low, ["unavailable", "503", "rate", "overloaded", "too many requests", "resource_exhausted"])
    return F.when(quota, "quota").when(away, "unavailable").otherwise("other")


def looks_like_follow_up(q: Column) -> Column:
    low = F.lower(trim(q))
    short = ~F.contains(low, F.lit("?")) & (F.size(F.split(trim(q), r"\s+")) <= 6)
    return (F.length(trim(q)) <= 80) & (low.rlike(FOLLOW_UP[0]) | low.rlike(FOLLOW_UP[1]) | short)


def follow_up(q: Column, last_user: Column, extra_stop: tuple[str, ...] = ()) -> Column:
    """The question with up to five telling words of the last one, if it looks like a follow-up."""
    low = F.lower(trim(q))
    tokens = F.split(F.regexp_replace(F.lower(last_user), r"[^a-z0-9\s-]", " "), r"\s+")
    good = F.filter(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(FOLLOW_STOP + list(extra_stop)) & ~F.contains(low, t))
    # A word that is part of what is carried already adds nothing.
    carry = F.aggregate(good, F.lit(""), lambda acc, t: F.when((F.size(F.split(acc, " ")) >= 5) | F.contains(acc, t), acc).when(acc == "", t).otherwise(F.concat(acc, F.lit(" "), t)))
    return F.when(looks_like_follow_up(q) & (F.coalesce(carry, F.lit("")) != ""), F.concat(trim(q), F.lit(" "), carry)).otherwise(q)
