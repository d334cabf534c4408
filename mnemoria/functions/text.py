"""Text rules: tokens, the triviality gate, cues and suspicious patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"

#: Messages that say nothing, whole.
TRIVIAL_PHRASES = sorted(
    """ah|agreed|all good|alright|brb|bye|cool|duh|ez|fair enough|fine|for real|for sure|gg|good luck|good point|goodbye|got it|great|gtg|ha ha|haha|he he|hello|hey|hi|hm|hmm|i agree|i see|i understand|idk|ikr|imo|k|lmao|lol|makes sense|me too|meh|much appreciated|my bad|my mistake|nah|nice|no|no doubt|no problem|no thats wrong|no worries|nope|noted|np|of course|oh|oh i see|oh no|oh well|ok|ok cool|ok sounds good|ok thanks|okay|omg|oof|oops|perfect|right|rip|same here|see ya|smh|sounds good|sounds great|sup|sure|sure thing|take care|tbh|thank you|thanks|thanks a lot|that makes sense|that works|thats fine|thx|ty|ugh|understood|will do|woo|wow|yay|yeah|yep|yep got it|yes|yes thats right|yikes|yo|you too|youre right""".split("|")
)
#: Words that don't count as content.
TRIVIAL_WORDS = sorted(
    "a ah also an and but bye cool fine great haha hello hey hi hmm i is it just like lol nah nice no oh ok or perfect really right so sure thanks the too uh um very was well wow yeah yes yo".split()
)
CORRECTION_CUES = sorted(["to be clear", "to clarify", "let me clarify", "what i meant", "i meant", "correction:", "not quite", "thats wrong", "actually ", "actually,", "no ", "no,"])
#: In the order in which they are tried; the first that stands in a text gives the alert's severity.
SUSPICIOUS = [
    *(f"{verb} previous" for verb in ("ignore", "ignore all", "disregard")),
    *("system:", "<system>", "assistant:"),
    *(f"<|im_{edge}|>" for edge in ("start", "end")),
    *("you are now", "pretend you are", "act as", "jailbreak"),
    *("override instructions", "new instructions:", "prompt injection"),
]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda x: x != "")


def _one_of(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def normalised(text: Column) -> Column:
    """Letters and digits in lower case, single blanks; other characters vanish without leaving a blank."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}\s]+", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def gate_reason(text: Column, min_words: int = 3, max_trivial: float = 0.8) -> Column:
    """Why a message is not worth saving or searching; null where it is. The first reason that holds is given."""
    n = normalised(text)
    words = F.filter(F.split(n, " "), lambda x: x != "")
    share = F.size(F.filter(words, lambda w: F.array_contains(_one_of(TRIVIAL_WORDS), w))) / F.size(words)
    return (
        F.when(n == "", "empty input")
        .when(n.isin(TRIVIAL_PHRASES), F.concat(F.lit("trivial phrase: "), n))
        .when(F.size(words) < min_words, F.concat(F.lit("too few words: "), F.size(words), F.lit(f" < {min_words}")))
        .when(share > max_trivial, "high trivial ratio")
    )


def is_correction(text: Column) -> Column:
    low = F.lower(text)
    found = [F.contains(low, F.lit(c)) for c in CORRECTION_CUES]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def suspicious_pattern(text: Column) -> Column:
    """The first suspicious pattern that stands in the text, or null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in SUSPICIOUS])


def pattern_severity(pattern: Column) -> Column:
    has = lambda *w: pattern.rlike("|".join(w))
    return F.when(has("ignore", "override"), "Critical").when(has("system", "jailbreak"), "High").when(pattern.isNotNull(), "Medium")
