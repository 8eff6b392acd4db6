"""Model responses as columns: split off the reasoning, read the final label, handle label lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.numbers import trim_all

# Markers and line formats of the corpus and of the responses.
THOUGHT_START = "<|channel|>analysis<|message|>"
THOUGHT_END = "<|end|><|start|>assistant<|channel|>final<|message|>"
PLAIN_FINAL = "assistantfinal"
THINK_CLOSE = ("</think>", "<\\/think>")
FEATURES_TITLE = "--- Current Sample Features ---"
PLAIN_FEATURES_TITLE = "--- Sample Features ---"
LABEL_LINE = "THE GIVEN PREDICTION LABEL is "
LABEL_LINE_PATTERN = r"(?mdU)^\s*THE GIVEN PREDICTION LABEL is .*$"
PREDICTION = r"\**\s*prediction\s+is\s+\**\s*"
PREDICTION_LOOSE = r"\**\s*prediction\s+is\s*\**\s*[:：]?\s*\**\s*"
NUMBER = r"\**\s*(?:prediction|value|estimate|output)\s*(?:is\s*)?[:=\-]?\s*\**\s*([-+]?\d[\d,]*\.?\d*(?:e[-+]?\d+)?)"


def _before(t: Column, marker: str) -> Column:
    return trim_all(t.substr(F.lit(1), F.locate(marker, t) - 1))


def _after(t: Column, marker: str) -> Column:
    return trim_all(t.substr(F.locate(marker, t) + len(marker), F.length(t)))


def unify_newlines(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\r\n?", "\n")


def _final_of_unmarked(t: Column) -> Column:
    said = r"(?isU)^.*?\bassistant\s*final\b(.*)\z"
    channel = r"(?isU)^.*?<\|channel\|>\s*final\b(.*)\z"
    return (
        F.when(t.rlike(said), trim_all(F.regexp_extract(t, said, 1)))
        .when(t.rlike(channel), trim_all(F.regexp_extract(t, channel, 1)))
        .otherwise(trim_all(F.regexp_replace(t, r"(?iU)^(?:analysis|<analysis>)\s*", "")))
    )


def split_think(raw: Column) -> Column:
    """The reasoning part, NULL when no marker is present; a leading ``analysis`` word is dropped."""
    t = unify_newlines(raw)
    rest = t.substr(F.locate(THOUGHT_START, t) + len(THOUGHT_START), F.length(t))
    think = F.when(
        t.contains(THOUGHT_START) & t.contains(THOUGHT_END),
        F.when(rest.contains(THOUGHT_END), _before(rest, THOUGHT_END)).otherwise(trim_all(rest)),
    )
    for marker in (PLAIN_FINAL, *THINK_CLOSE):
        think = think.when(t.contains(marker), _before(t, marker))
    return F.regexp_replace(think, r"(?iU)^\s*(?:analysis\s*)?", "")


def split_final(raw: Column) -> Column:
    """The answer part of a response; the first marker form that applies decides."""
    t = unify_newlines(raw)
    rest = t.substr(F.locate(THOUGHT_START, t) + len(THOUGHT_START), F.length(t))
    final = F.when(
        t.contains(THOUGHT_START) & t.contains(THOUGHT_END),
        F.when(rest.contains(THOUGHT_END), _after(rest, THOUGHT_END)).otherwise(F.lit("")),
    )
    for marker in (PLAIN_FINAL, *THINK_CLOSE):
        final = final.when(t.contains(marker), _after(t, marker))
    return final.otherwise(_final_of_unmarked(t))


def compose_response(think: Column, final: Column) -> Column:
    """Reasoning and answer joined with thought markers; without reasoning just the answer."""
    return F.when(F.coalesce(think, F.lit("")) == "", final).otherwise(
        F.concat(F.lit(THOUGHT_START), think, F.lit(THOUGHT_END), final)
    )


def _matches(text: Column, pattern: str, at_line_start: bool) -> Column:
    flags, anchor = ("(?imdU)", r"^\s*") if at_line_start else ("(?iU)", "")
    return F.regexp_extract_all(text, F.lit(f"{flags}{anchor}{pattern}"), F.lit(1))


def _last(matches: Column) -> Column:
    return F.try_element_at(matches, F.lit(-1))


def parse_yes_no(final: Column) -> Column:
    """Last ``Prediction is yes|no``: at a line start first, then anywhere."""
    text = F.lower(trim_all(final))
    pattern = PREDICTION + r"(yes|no)\b"
    return F.coalesce(_last(_matches(text, pattern, True)), _last(_matches(text, pattern, False)))


def parse_yes_no_or_digit(final: Column) -> Column:
    """As :func:`parse_yes_no`, with an optional colon and with 0/1 standing for no/yes."""
    text = F.lower(trim_all(final))

    def word(at_start):
        return _last(_matches(text, PREDICTION_LOOSE + r"(yes|no)\b", at_start))

    def digit(at_start):
        found = _last(_matches(text, PREDICTION_LOOSE + r"([01])\b", at_start))
        return F.when(found == "1", "yes").when(found == "0", "no")

    return F.coalesce(word(True), digit(True), word(False), digit(False))


def normalize_class(value: Column, labels: list[str]) -> Column:
    """Lower-case words with ``-`` and blanks turned to ``_``; NULL when not one of the labels."""
    s = F.translate(F.lower(trim_all(value)), "- ", "__")
    return F.when(s.isin(*labels), s)


def normalize_exact(value: Column, labels: list[str]) -> Column:
    """Exact label after trimming; otherwise the label that differs only in case, words only."""
    s = trim_all(value)
    out = F.when(s.isin(*labels), s)
    for label in labels:
        if label.isalpha():
            out = out.when(F.lower(s) == label.lower(), F.lit(label))
    return out


def parse_class(final: Column, token: str, normalise) -> Column:
    """Last match that normalises to a known label: line starts first, then anywhere."""
    text = F.lower(trim_all(final))
    pattern = PREDICTION + f"([{token}]+)\\b"

    def pick(at_start):
        known = F.filter(F.transform(_matches(text, pattern, at_start), normalise), lambda v: v.isNotNull())
        return _last(known)

    return F.coalesce(pick(True), pick(False))


def parse_numeric(final: Column) -> Column:
    """Last number after prediction/value/estimate/output; ``$`` and thousands commas are ignored."""
    text = F.replace(F.lower(trim_all(final)), F.lit("$"), F.lit(""))
    at_start = _last(_matches(text, NUMBER, True))
    token = F.coalesce(at_start, _last(_matches(text, NUMBER, False)))
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def label_line(label: Column) -> Column:
    return F.concat(F.lit(LABEL_LINE), label, F.lit("."))


def append_label(text: Column, label: Column) -> Column:
    """Add the given-label line once, after one blank line unless the text already ends a line."""
    line = label_line(label)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", line)
        .when(text.rlike(LABEL_LINE_PATTERN), text)
        .when(text.endswith("\n"), F.concat(text, line))
        .otherwise(F.concat(text, F.lit("\n\n"), line))
    )


def strip_label(text: Column) -> Column:
    """Drop given-label lines, then fold three or more line ends to two and trim."""
    bare = F.regexp_replace(text, LABEL_LINE_PATTERN, "")
    return trim_all(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def features_text(text: Column, accept_plain_title: bool = False) -> Column:
    """Text between the features title and the first label line; NULL when either is absent."""
    title = F.locate(FEATURES_TITLE, text)
    size = F.lit(len(FEATURES_TITLE))
    if accept_plain_title:
        plain = F.locate(PLAIN_FEATURES_TITLE, text)
        size = F.when(title > 0, size).otherwise(F.lit(len(PLAIN_FEATURES_TITLE)))
        title = F.when(title > 0, title).otherwise(plain)
    head = F.regexp_extract(text, r"(?sU)\A(.*?)(?:(?m)^\s*THE GIVEN PREDICTION LABEL is )", 1)
    has_label = text.rlike(LABEL_LINE_PATTERN)
    end = F.length(head) + 1
    return F.when(
        has_label & (title > 0) & (end >= title),
        trim_all(text.substr(title + size, end - title - size)),
    )
