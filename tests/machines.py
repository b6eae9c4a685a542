"""Plain sequential versions of the cleaning passes, written from the rules, to test the column versions against.

Patterns are the library's fixed values, in Python's spelling.
"""

import re

from treatise.functions import text as fixed


def _pattern(value):
    return re.compile(value.removeprefix("(?d)").replace(r"\z", r"\Z"))


PARENT, NESTED, END, BAND, CITATION = map(_pattern, (fixed.PARENT_BULLET, fixed.NESTED_BULLET, fixed.SENTENCE_END, fixed.AGE_BAND, fixed.CITATION_ONLY))
LINK_TAIL = _pattern(fixed.URL_TAIL)
#: Reasons that a text gives by itself, the first that holds.
ALONE = {"interactive_element_placeholder": _pattern(fixed.PLACEHOLDER), "url_only": _pattern(fixed.URL_ONLY)}


def holds(pattern, text):
    return pattern.search(text.strip()) is not None


def ends(text):
    return holds(END, text)


def band(text):
    return holds(BAND, text)


def bullet(text):
    return holds(PARENT, text) or holds(NESTED, text)


def label(text):
    known = text.strip().casefold() in ("did you know…", "months milestones")
    return known or not (len(text.strip()) > 60 or bullet(text) or ends(text))


def lower_prose(text):
    first = next(filter(str.isalpha, text), "")
    return first.islower() and not bullet(text)


def glue(left, right, why):
    """Units are (text, sources, reasons)."""
    between = "\n" if bullet(right[0]) else " "
    return between.join((left[0].rstrip(), right[0].lstrip())), left[1] + right[1], [*left[2], *right[2], why]


def backward(units, test):
    """test(last, unit) gives a reason or None."""
    out = []
    for u in units:
        why = test(out[-1], u) if out else None
        out[-1:] = [glue(out[-1], u, why)] if why else out[-1:] + [u]
    return out


def forward(units, opens, why):
    out, rest = [], list(units)
    while rest:
        u = rest.pop(0)
        out.append(glue(u, rest.pop(0), why) if opens(u[0]) and rest else u)
    return out


def fits(a, b):
    return len(a[0]) + 1 + len(b[0]) <= 3000


def bullets(last, unit):
    if not fits(last, unit):
        return None
    if holds(NESTED, unit[0]):
        return "nested_bullet_backward"
    return "adjacent_bullets" if holds(PARENT, unit[0]) and holds(PARENT, last[0]) else None


def passes(texts):
    units = [(t, [i], []) for i, t in enumerate(texts)]
    units = backward(units, lambda a, u: "short_continuation_backward" if len(u[0].strip()) <= 40 and not bullet(u[0]) and not band(u[0]) and not ends(a[0]) else None)
    units = forward(units, band, "age_band_forward")
    units = forward(units, label, "short_label_forward")
    units = backward(units, bullets)
    units = backward(units, lambda a, u: "artifact_continuation_backward" if fits(a, u) and (holds(CITATION, u[0]) or lower_prose(u[0])) else None)
    units = backward(units, lambda a, u: "label_sentence_completion" if "short_label_forward" in a[2] and not re.search("[•●◦▪]", a[0]) and not ends(a[0]) and fits(a, u) else None)
    return units


def noise(texts):
    """The reason why each text goes, None for those that stay."""
    out = []
    for at, text in enumerate(texts):
        alone = [why for why, pattern in ALONE.items() if holds(pattern, text)]
        if any(t.strip().casefold() == "media attributions" for t in texts[: at + 1]):
            out.append("media_attribution_tail")
        elif alone:
            out.append(alone[0])
        else:
            # What is left of a link that was cut: short, with a slash, right after a link or another such rest.
            rest = len(text.strip()) <= 40 and "/" in text and holds(LINK_TAIL, text)
            out.append("orphan_url_tail" if rest and out and out[-1] in ("url_only", "orphan_url_tail") else None)
    return out
