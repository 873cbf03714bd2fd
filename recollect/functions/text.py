"""Text functions as Catalyst expressions. All take and return columns; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import constants as C


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def token_count(text: Column) -> Column:
    """A quarter of the code points, at least 1; 0 for empty or null text."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def normalised(text: Column) -> Column:
    """Without white space at the ends, in lower case."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def squeezed(text: Column) -> Column:
    """In lower case, white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def blank(text: Column) -> Column:
    """Null or empty: what counts as missing throughout."""
    return text.isNull() | (text == "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def _crude_singular(w: Column) -> Column:
    """-ies to -y and a final -s dropped, in words of five letters or more."""
    ies = (~w.isin(C.INVARIANT_NOUNS)) & (F.length(w) > 4) & w.endswith("ies")
    s = (F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss")
    return F.when(ies, F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(s, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def retrieval_tokens(text: Column) -> Column:
    """Distinct words without query stopwords, singular."""
    kept = F.filter(ascii_words(text), lambda w: ~w.isin(C.QUERY_STOPWORDS))
    return F.array_distinct(F.transform(kept, _crude_singular))


def slot_tokens(text: Column) -> Column:
    """Distinct words with aliases replaced, singular."""
    alias = mapping(C.SLOT_ALIASES)
    return F.array_distinct(F.transform(ascii_words(text), lambda w: _crude_singular(F.coalesce(F.element_at(alias, w), w))))


def singular(w: Column) -> Column:
    irregular = mapping(C.IRREGULAR_SINGULARS)
    n = F.length(w)
    kept_es = w.endswith("ses") | w.endswith("zes") | w.endswith("ches") | w.endswith("shes")
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when(F.element_at(irregular, w).isNotNull(), F.element_at(irregular, w)).when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & w.endswith("es") & ~kept_es, cut(2)).when((n > 3) & w.endswith("s") & ~w.endswith("ss"), cut(1)).otherwise(w)
    )


def identity_tokens(text: Column) -> Column:
    """Distinct singular words of a slot key, without stopwords."""
    kept = F.filter(ascii_words(text), lambda w: ~w.isin(C.IDENTITY_STOPWORDS))
    return F.array_distinct(F.transform(kept, singular))


def subject_part(key: Column) -> Column:
    """Before the last dot; all of a key without one."""
    return F.when(F.instr(key, ".") > 0, F.regexp_extract(key, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(key)


def attribute_part(key: Column) -> Column:
    return F.when(F.instr(key, ".") > 0, F.regexp_extract(key, r"(?s)\.([^.]*)$", 1)).otherwise(F.lit(""))


def canonical_key(key: Column, granularity: str = "full") -> Column:
    """Sorted identity words of the key, or of its subject alone."""
    if granularity not in ("full", "subject"):
        raise ValueError(f"no such granularity: {granularity}")
    return F.array_join(F.array_sort(identity_tokens(key if granularity == "full" else subject_part(key))), " ")


def key_tokens(key: Column) -> Column:
    """Words of two letters or more of a slot key, for blocking."""
    return F.array_distinct(F.filter(ascii_words(F.coalesce(key, F.lit(""))), lambda w: (F.length(w) > 1) & ~w.isin(C.KEY_STOPWORDS)))


def full_fact(key: Column, value: Column) -> Column:
    """``natural key: value``, or the one that is not empty."""
    k, v = F.trim(F.translate(F.coalesce(key, F.lit("")), "._", "  ")), F.trim(F.coalesce(value, F.lit("")))
    return F.when((k != "") & (v != ""), F.concat(k, F.lit(": "), v)).otherwise(F.concat(k, v))


def subject_of(subject: Column, key: Column) -> Column:
    """The subject, or the key up to its first dot."""
    return F.when(~blank(subject), F.trim(F.lower(subject))).when(~blank(key), F.trim(F.lower(F.substring_index(key, ".", 1)))).otherwise("")


def subjects_overlap(a: Column, b: Column) -> Column:
    both = F.array_intersect(F.split(a, r"\s+"), F.split(b, r"\s+"))
    return F.size(F.filter(both, lambda w: (w != "") & ~w.isin(C.SUBJECT_GENERICS))) > 0


def quantity_like(value: Column) -> Column:
    """Has a digit or a number word."""
    letters = F.regexp_extract_all(F.lower(value), F.lit("([a-z]+)"), F.lit(1))
    return F.coalesce(value.rlike(r"\d") | F.arrays_overlap(letters, words(C.NUMBER_WORDS)), F.lit(False))


def value_shape(value: Column) -> Column:
    n = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
    return F.when(blank(value), "missing").when(value.rlike(r"\d"), "numeric").when(value.rlike(r"[\[\]{}]"), "collection").when(n <= 8, "scalar").otherwise("prose")


def slot_roles(tokens: Column) -> Column:
    roles = mapping(C.SLOT_ROLES)
    return F.array_distinct(F.filter(F.transform(tokens, lambda w: F.element_at(roles, w)), lambda r: r.isNotNull()))


def subject_anchors(key: Column) -> Column:
    """Slot words before the first dot that are not generic."""
    return F.array_except(slot_tokens(F.substring_index(key, ".", 1)), words(C.ANCHOR_GENERICS))


def mentions_value(text: Column, value: Column) -> Column:
    """A number as a word of its own, other values of three characters or more anywhere."""
    t, v = squeezed(text), squeezed(value)
    number = F.rlike(t, F.concat(F.lit(r"\b"), v, F.lit(r"\b")))
    return F.coalesce(F.when(v.rlike("^[0-9]+$"), number).otherwise((F.length(v) >= 3) & F.contains(t, v)), F.lit(False))


def needle_form(text: Column) -> Column:
    """In lower case, spelled cardinals as digits, all but letters and digits as single spaces."""
    digits = mapping(C.CARDINALS)
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    spelled = F.array_join(F.transform(parts, lambda w: F.coalesce(F.element_at(digits, w), w)), "")
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def present(needle: Column, text: Column) -> Column:
    """The needle's words stand in the text in a row; an empty needle never does."""
    n, hay = needle_form(needle), needle_form(text)
    return (n != "") & F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))


def value_aware_match(needle: Column, key: Column, value: Column) -> Column:
    """All numbers of the needle are words of the value, and a word of it, if any, of key or value."""
    own = F.filter(F.split(needle_form(needle), " "), lambda w: w != "")
    numbers, rest = F.filter(own, lambda w: w.rlike("^[0-9]+$")), F.filter(own, lambda w: ~w.rlike("^[0-9]+$"))
    of_value = F.split(needle_form(value), " ")
    known = F.concat(F.split(needle_form(key), " "), of_value)
    return (F.size(numbers) > 0) & (F.size(F.array_except(numbers, of_value)) == 0) & ((F.size(rest) == 0) | F.arrays_overlap(rest, known))


def question_mode(question: Column) -> Column:
    out = None
    for mode, pattern in C.QUESTION_MODES:
        test = question.rlike(f"(?i){pattern}")
        out = F.when(test, mode) if out is None else out.when(test, mode)
    return out.otherwise("current")


def mode_instruction(question: Column) -> Column:
    mode = question_mode(question)
    return F.concat(F.lit("Question mode: "), mode, F.lit(". "), F.element_at(mapping(C.MODE_INSTRUCTIONS), mode))


def is_temporal(question: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(question), F.lit("([a-z]+)"), F.lit(1)), words(C.TEMPORAL_TERMS))


def wants_history(question: Column) -> Column:
    return is_temporal(question) | question_mode(question).isin("previous", "change", "point-in-time")


def _any_in(text: Column, parts: list[str]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        out = out | F.contains(text, F.lit(part))
    return out


def slot_key(text: Column) -> Column:
    """The state slot that a text's keywords name, or null. Keywords count anywhere, inside words, too."""
    low, out = F.lower(text), None
    for key, parts, more in C.SLOT_KEYS:
        test = _any_in(low, parts)
        if more:
            test = test & (low.rlike(more) if "\\" in more else F.contains(low, F.lit(more)))
        out = F.when(test, key) if out is None else out.when(test, key)
    return out


def slot_override(text: Column) -> Column:
    """``subject.attribute`` by the wider keyword list, or null."""
    low, out = F.lower(text), None
    for subject, attribute, parts in C.SLOT_OVERRIDES:
        test = _any_in(low, parts)
        out = F.when(test, f"{subject}.{attribute}") if out is None else out.when(test, f"{subject}.{attribute}")
    return out


def slot_value(key: Column, text: Column) -> Column:
    """The value that a text gives for a slot, or null."""
    found = lambda pattern, group: F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))
    out = None
    for slot, (pattern, group) in C.SLOT_VALUES.items():
        value = found(pattern, group)
        if slot == "infra.host":
            alone = found(C.HOST_ALONE, 1)
            value = F.coalesce(value, F.when(~F.lower(alone).isin("is", "to", "set"), alone))
        if slot == "infra.retention":
            trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
            value = F.nullif(F.trim(F.regexp_replace(trimmed, r"(?i) exactly$", "")), F.lit(""))
        out = F.when(key == slot, value) if out is None else out.when(key == slot, value)
    return out


def stated_values(text: Column) -> Column:
    """Known slots that a text gives a value for, as (slot_key, slot_value)."""
    pairs = F.array(*[F.struct(F.lit(slot).alias("slot_key"), slot_value(F.lit(slot), text).alias("slot_value")) for slot in C.SLOT_VALUES])
    return F.filter(pairs, lambda p: p["slot_value"].isNotNull())


def slot_kind(key: Column) -> Column:
    return F.coalesce(F.element_at(mapping(C.SLOT_KINDS), key), F.lit("entity"))


def kind_or_entity(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin(*C.KINDS), k).otherwise("entity")


def derived_key(subject: Column, attribute: Column) -> Column:
    """A slot key from subject and attribute: punctuation other than dots gone, generic words left out."""
    raw = F.translate(F.lower(F.concat(subject, F.lit("."), attribute)), "!\"#$%&'()*+,-/:;<=>?@[\\]^_`{|}~", " " * 31)
    kept = F.filter(F.split(raw, r"\s+"), lambda w: (w != "") & ~w.isin(C.SLOT_GENERICS))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def provenance(turn: Column, session: Column, ts: Column) -> Column:
    parts = F.array(F.concat(F.lit("Turn "), turn.cast("string")), F.when(~blank(session), F.concat(F.lit("Session "), session)), F.when(~blank(ts), F.concat(F.lit("Timestamp "), ts)))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; ")


def fact_line(kind: Column, status: Column, text: Column, turn: Column, session: Column, ts: Column) -> Column:
    stale = F.when(status == "active", "").otherwise(" stale")
    return F.concat(F.lit("- ["), kind, stale, F.lit("] "), text, F.lit(" ("), provenance(turn, session, ts), F.lit(")"))


def summary_prefix(sessions: Column, start: Column, end: Column) -> Column:
    several = ~blank(end) & (end != start)
    span = F.when(several, F.concat(F.lit("Timestamps "), start, F.lit(" to "), end)).otherwise(F.concat(F.lit("Timestamp "), start))
    parts = F.filter(F.array(F.when(F.size(F.coalesce(sessions, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Sessions "), F.array_join(sessions, ", "))), F.when(~blank(start), span)), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, "; "), F.lit("] "))).otherwise("")


def summary_line(text: Column, sessions: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("- "), summary_prefix(sessions, start, end), text)


def turn_line(role: Column, content: Column) -> Column:
    return F.concat(F.upper(role), F.lit(": "), content)


def numbered_turn_line(turn: Column, role: Column, content: Column, session: Column, ts: Column) -> Column:
    """``Turn n [provenance] - ROLE: content``."""
    parts = F.filter(F.array(F.when(~blank(session), F.concat(F.lit("Session "), session)), F.when(~blank(ts), F.concat(F.lit("Timestamp "), ts))), lambda p: p.isNotNull())
    tag = F.when(F.size(parts) > 0, F.concat(F.lit(" ["), F.array_join(parts, "; "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("Turn "), turn.cast("string"), tag, F.lit(" - "), turn_line(role, content))


def month(epoch: Column) -> Column:
    """``YYYY-MM`` in UTC; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def holds_value(text: Column, value: Column) -> Column:
    """The value stands in the text with no letter, digit or underscore on either side."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.rlike(text, quoted)


def without_values(text: Column, values: Column) -> Column:
    """Text, line by line, without the sentences that hold one of the values; emptied lines go."""
    clean = lambda s: ~F.exists(values, lambda v: holds_value(s, v))
    lines = F.transform(F.split(text, "\n"), lambda line: F.array_join(F.filter(sentences(line), clean), " "))
    return F.when(F.size(values) > 0, F.array_join(F.filter(lines, lambda line: line != ""), "\n")).otherwise(text)


def safe_name(text: Column) -> Column:
    """Letters, digits, hyphens and underscores; ``default`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_-]", ""), F.lit("")), F.lit("default"))


def without_fences(text: Column) -> Column:
    """The inside of a code fence, balanced or not."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    inside = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    opened = F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"```$", "")
    return F.when(t.rlike(r"(?s)```(?:json)?\s*(.*?)\s*```"), F.trim(inside)).otherwise(F.regexp_replace(opened, r"^\s+|\s+$", ""))


def siblings_as_list(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    several = t.startswith("{") & t.endswith("}") & t.rlike(r"\}\s*\{")
    return F.when(several, F.concat(F.lit("["), F.regexp_replace(t, r"\}\s*\{", "},{"), F.lit("]"))).otherwise(t)
